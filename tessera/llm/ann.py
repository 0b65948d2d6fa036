"""Nearest neighbours by vantage-point trees per shard.

Pivots, a bounded sample, cut the space into cells at two levels: a vector goes to the region of its
nearest upper pivot and in it to the cell of its nearest lower one. The number of cells grows with the
table up to MOST_CELLS, so a cell is a shard of about the size wanted. A cell that is larger than two
shards, as copies of one vector make it, or a table of more than MOST_CELLS shards, is cut into several
by row number, so that no task holds more than some 2 * shard_rows vectors, however large the table. Each shard has a
vantage-point tree, which splits at the median distance from a vantage point and ends in leaves scanned whole.

A query first searches a shard of its own cell. Its k-th distance then bounds the other shards: the
triangle inequality gives a least distance to a cell (outside its or its region's radius, or beyond
the bisector of two pivots of a level), and shards whose least distance times `factor` is over the
bound are left out; inside a tree the same rule prunes subtrees. With factor 1 nothing that could count is left out and the
search is exact; larger factors prune more. Queries are a stated set, sent to shards in rows, never
crossed with the vectors.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
with a null vec_id. Vectors of different lengths have no distance: each length is searched by itself. A query's own row is no candidate;
another row of the same vec_id is. Ties go to the smaller vec_id. Fewer candidates than k: all of
them. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: Cells, at least and at most; vectors that pivots are chosen from, for each cell; vectors of one shard, about; of one leaf.
LEAST_CELLS, MOST_CELLS, SAMPLE, SHARD_ROWS, LEAF = 16, 16_384, 4, 2_500, 64
#: Queries of one block, for each core of the cluster.
QUERY_BLOCK = 20_000
#: Relative slack for rounding in bounds, so exact ties are still visited.
SLACK = 1e-9
RESULT = "query_id long, rank int, vec_id long, score double"


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, each row's sum on its own."""
    gap = vectors - query
    return np.sqrt((gap * gap).sum(axis=1))


class Tree:
    """A vantage-point tree over rows of a matrix."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.vectors, self.rng = vectors, np.random.default_rng(seed)
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple] = []  # (start, end, vantage row or -1, inner radius, outer radius, inside, outside)
        self.root = self._build(0, len(vectors), leaf)

    def _build(self, start: int, end: int, leaf: int) -> int:
        number = len(self.nodes)
        self.nodes.append((start, end, -1, 0.0, 0.0, -1, -1))
        if end - start <= leaf:
            return number
        rows = self.order[start:end]
        vantage = int(rows[self.rng.integers(len(rows))])
        gap = distances(self.vectors[rows], self.vectors[vantage])
        half = len(rows) // 2
        by = np.argpartition(gap, half)
        inner, outer = gap[by[:half]].max(), gap[by[half:]].min()
        if gap.max() == gap.min():
            return number  # all at one distance: a leaf, scanned whole
        self.order[start:end] = rows[by]
        inside = self._build(start, start + half, leaf)
        outside = self._build(start + half, end, leaf)
        self.nodes[number] = (start, end, vantage, float(inner), float(outer), inside, outside)
        return number

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, rows: np.ndarray, k: int, bound: float, factor: float) -> list[tuple[float, int]]:
        """The k least (distance, id) of rows other than `own`, up to `bound`."""
        best: list[tuple[float, int]] = []
        stack = [(0.0, self.root)]
        while stack:
            low, number = stack.pop()
            if low * factor > bound * (1 + SLACK):
                continue
            start, end, vantage, inner, outer, inside, outside = self.nodes[number]
            if vantage < 0:
                at = self.order[start:end]
                gap = distances(self.vectors[at], query)
                near = np.flatnonzero((gap <= bound) & (rows[at] != own))
                if len(near):
                    best = sorted(best + list(zip(gap[near].tolist(), ids[at[near]].tolist(), strict=True)))[:k]
                    if len(best) == k:
                        bound = min(bound, best[-1][0])
                continue
            d = float(distances(self.vectors[vantage : vantage + 1], query)[0])
            slack = SLACK * (d + outer + 1e-300)
            sides = [(max(low, d - inner - slack), inside), (max(low, outer - d - slack), outside)]
            stack += sorted(sides, reverse=True)
        return best


def usable(vector: Column) -> Column:
    """Not null or empty, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


class Cells:
    """Two levels of pivots over a sample, drawn at random so that cells and regions come out alike."""

    def __init__(self, sample: np.ndarray, n: int, seed: int):
        rng = np.random.default_rng(seed)
        different = np.unique(sample, axis=0)
        self.low = different[rng.permutation(len(different))[:n]]
        self.up = self.low[: int(np.ceil(np.sqrt(len(self.low))))]
        self.region = np.argmin(np.stack([distances(self.low, p) for p in self.up], axis=1), axis=1)
        self.members = [np.flatnonzero(self.region == g) for g in range(len(self.up))]

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's cell, its distance to the cell's pivot and to its region's."""
        up = np.stack([distances(v, p) for p in self.up], axis=1)
        region = up.argmin(axis=1)
        cell, gap = np.zeros(len(v), np.int64), np.zeros(len(v))
        for g in np.unique(region):
            rows = np.flatnonzero(region == g)
            low = np.stack([distances(v[rows], self.low[i]) for i in self.members[g]], axis=1)
            best = low.argmin(axis=1)
            cell[rows], gap[rows] = self.members[g][best], low[np.arange(len(rows)), best]
        return cell, gap, up[np.arange(len(v)), region]

    def least(self, query: np.ndarray, radius: np.ndarray, up_radius: np.ndarray) -> np.ndarray:
        """A least distance from the query to any vector of each cell (infinite radii: to nothing)."""
        up, low = distances(self.up, query), distances(self.low, query)
        out = low - radius
        near = int(up.argmin())
        apart = distances(self.up, self.up[near])
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = np.where(apart > 0, (up**2 - up[near] ** 2) / (2 * apart), 0.0)
            outer = np.maximum(up - up_radius, beyond)
            for g, m in enumerate(self.members):
                first = int(low[m].argmin())
                gap = distances(self.low[m], self.low[m[first]])
                side = np.where(gap > 0, (low[m] ** 2 - low[m[first]] ** 2) / (2 * gap), 0.0)
                out[m] = np.maximum(np.maximum(out[m], side), outer[g])
        return out - SLACK * (low + up.max() + 1)


def nearest(df: DataFrame, is_query: Column, *, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, seed: int = 7) -> DataFrame:
    """Rows of (query_id, rank, vec_id, score) of the k nearest found for each row with is_query."""
    if factor < 1:
        raise ValueError("factor is 1 (exact) or more")
    spark = df.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    rows = rows.where(usable(F.col("v"))).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("total"), F.count_if("ask").alias("asked"))
    out = spark.createDataFrame([], RESULT)
    for length in lengths.where("asked > 0").collect():  # a row a length of vectors
        out = out.unionByName(_nearest(rows.where(F.size("v") == length.n), length.n, length.total, k, factor, shard_rows, seed))
    return out


def _nearest(rows: DataFrame, width: int, total: int, k: int, factor: float, shard_rows: int, seed: int) -> DataFrame:
    """nearest() of rows (id, v, ask, row) whose vectors have one length."""
    spark = rows.sparkSession
    wanted = min(MOST_CELLS, max(LEAST_CELLS, total // shard_rows))
    taken = rows.orderBy(F.xxhash64("row", F.lit(seed)), "row").limit(SAMPLE * wanted).select("v").collect()
    made = Cells(np.array([r.v for r in taken]), wanted, seed)
    shared = spark.sparkContext.broadcast(made)  # MOST_CELLS vectors at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, gap, up = shared.value.place(_matrix(batch.column(1), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap), pa.array(up)], names=["id", "v", "ask", "row", "cell", "gap", "up"])

    placed = materialise(rows.mapInArrow(place, "id long, v array<double>, ask boolean, row long, cell int, gap double, up double"), "placed")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"), F.max("up").alias("up")).collect()  # a row a cell
    most = 2 * shard_rows
    shards = np.zeros(len(made.low), np.int64)
    radius, up_radius = np.full(len(made.low), -np.inf), np.full(len(made.up), -np.inf)
    for r in sizes:
        shards[r.cell] = 1 if r.n <= most else -(-r.n // most)
        radius[r.cell] = r.radius
        up_radius[made.region[r.cell]] = max(up_radius[made.region[r.cell]], r.up)
    first = np.cumsum(shards) - shards
    cell_map = spark.createDataFrame([(r.cell, int(shards[r.cell]), int(first[r.cell])) for r in sizes], "cell int, pieces int, start int")
    salted = placed.join(F.broadcast(cell_map), "cell")  # a row a cell
    shard = F.col("start") + F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")
    vectors = salted.select(shard.alias("shard"), "id", "v", "row")
    queries = placed.where("ask")

    home = salted.where("ask").select(shard.alias("shard"), "id", "v", "row", F.lit(float("inf")).alias("bound"))
    found = _search(vectors, home, width, k, factor)
    found = materialise(found, "home-found")
    bounds = found.groupBy("query_row").agg(F.max("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    bounds = bounds.select(F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("kth")).otherwise(float("inf")).alias("bound"))
    asked = queries.join(bounds, "row", "left").select("id", "v", "row", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            v = _matrix(batch.column(1), width) if batch.num_rows else np.zeros((0, width))
            bound = batch.column(3).to_numpy()
            to, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(len(v)):
                open_ = np.flatnonzero((shards > 0) & (np.maximum(cells.least(v[i], radius, up_radius), 0.0) * factor <= bound[i]))
                many = shards[open_]
                to.append(np.repeat(first[open_], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                who.append(np.full(len(to[-1]), i))
            pick = pa.array(np.concatenate(who))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int32)), *[c.take(pick) for c in batch.columns]], names=["shard", "id", "v", "row", "bound"])

    away = asked.mapInArrow(spread, "shard int, id long, v array<double>, row long, bound double")
    done = home.select("row", "shard")  # searched already
    away = away.join(done, ["row", "shard"], "left_anti").select("shard", "id", "v", "row", "bound")
    whole = found.unionByName(_search(vectors, away, width, k, factor))
    ranked = whole.groupBy("query_id", "query_row").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def _search(vectors: DataFrame, queries: DataFrame, width: int, k: int, factor: float) -> DataFrame:
    """(query_id, query_row, vec_id, score): each query row's k nearest in its shard, within its bound."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("row", kind="stable")
            v = np.stack(left["v"].to_numpy()).reshape(len(left), width)
            ids, rows = left["id"].to_numpy(), left["row"].to_numpy()
            tree = Tree(v, seed=int(key[0]))
            for q, row, ask, bound in zip(right["id"], right["row"], right["v"], right["bound"], strict=True):
                out += [(q, row, i, d) for d, i in tree.search(np.asarray(ask), ids, row, rows, k, bound, factor)]
        return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score"]).astype({"query_id": "int64", "query_row": "int64", "vec_id": "int64", "score": "float64"})

    # queries come in blocks; each block of a shard is a group with a copy of the shard's vectors
    queries = materialise(queries, "asked")
    blocks = max(1, -(-queries.count() // (QUERY_BLOCK * max(1, vectors.sparkSession.sparkContext.defaultParallelism))))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    vectors = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else vectors.withColumn("block", F.lit(0))
    return vectors.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(run, "query_id long, query_row long, vec_id long, score double")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
