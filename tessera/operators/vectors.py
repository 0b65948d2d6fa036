"""Vector collections: normalisation, retrieval, and metrics over all pairs of a bounded subset.

Metrics over pairs take at most MOST_ROWS rows, which the caller draws with `metric_rows`; that
bound is checked, so the matrix that is sent to the tasks is bounded too. What only needs moments
is computed from moments over any number of rows, without pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays, hashing
from tessera.operators.ordering import with_ordinal
from tessera.sources.work import work_table

METRIC_ROWS, MOST_ROWS = 4_096, 10_000


def metric_rows(df: DataFrame, n: int = METRIC_ROWS, seed: int = 0) -> DataFrame:
    """The n rows of the least hash of their id: the subset that pair metrics are defined on."""
    return df.orderBy(hashing.draw_key(F.col("vec_id"), seed), "vec_id").limit(n)


def pairs_of_views(df: DataFrame, dim: int = 32) -> DataFrame:
    """(vec_id, s, t): a student's view, the first `dim` components normalised anew, and the teacher's."""
    t = arrays.doubles(F.col("embedding"))
    return df.select("vec_id", arrays.truncated(t, dim).alias("s"), arrays.unit(t).alias("t"))


def mean_vector(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, mean): one row a component; a task sends one partial sum a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)).astype(np.float64)
                total, n = total + x.sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(len(total)), pa.int32()), "s": total, "n": np.full(len(total), n)})

    parts = df.select(F.col(vector).alias("v")).where("v is not null").mapInArrow(run, "dim int, s double, n long")
    return parts.groupBy("dim").agg((F.sum("s") / F.sum("n")).alias("mean"))


def centred(df: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """(vec_id, v): vectors less their mean, normalised. The mean is one row."""
    mean = mean_vector(df).agg(F.array_sort(F.collect_list(F.struct("dim", "mean")))["mean"].alias("m"))
    moved = df.crossJoin(F.broadcast(mean)).select("vec_id", F.zip_with(arrays.doubles(F.col("embedding")), "m", lambda x, m: x - m).alias("c"))
    return moved.select("vec_id", arrays.unit(F.col("c"), epsilon).alias("v"))


def top_k(df: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k rows of df with the greatest dot product with the one query row's vector."""
    one = query.select(arrays.unit(arrays.doubles(F.col("embedding"))).alias("q"))
    scored = df.crossJoin(F.broadcast(one)).select("vec_id", arrays.dot(arrays.unit(arrays.doubles(F.col("embedding"))), F.col("q")).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def top_k_each(df: DataFrame, queries: DataFrame, k: int, chunk: int = 16_384, block: int = 8_192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows of df with the greatest cosine, the
    least id among ties (of nine decimals). Rows are dealt to chunks and queries to blocks; a chunk meets a
    block in one task, which keeps k rows a query. Null vectors take no part."""
    unit = arrays.unit(arrays.doubles(F.col("embedding"))).alias("v")

    def dealt(rows: DataFrame, own: str, size: int) -> tuple[DataFrame, int]:
        held = work_table(rows.where("v is not null").withColumn("_n", F.monotonically_increasing_id()), own)
        cells = max(1, -(-held.count() // size))
        return held.withColumn(own, F.pmod(F.xxhash64("_n"), F.lit(cells)).cast("int")).drop("_n"), cells

    def shown(rows: DataFrame, other: str, cells: int) -> DataFrame:
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

    rows, chunks = dealt(df.select("vec_id", unit), "chunk", chunk)
    asked, blocks = dealt(queries.select(F.col("vec_id").alias("query_id"), unit), "block", block)
    rows, asked = shown(rows, "block", blocks), shown(asked, "chunk", chunks)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, who, best, of = left["vec_id"].to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            v, q, asks = _matrix(left["v"].combine_chunks()), _matrix(right["v"].combine_chunks()), right["query_id"].to_numpy()
            for start in range(0, len(q), 128):
                for ask, score in zip(asks[start : start + 128], np.round(q[start : start + 128] @ v.T, 9), strict=True):
                    near = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
                    near = near[np.lexsort((ids[near], -score[near]))[:k]]
                    who.append(np.full(len(near), ask))
                    best.append(score[near])
                    of.append(ids[near])
        return pa.table({"query_id": np.concatenate(who), "vec_id": np.concatenate(of), "score": np.concatenate(best)})

    out = rows.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    ranked = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    found = ranked.select("query_id", F.posexplode("best").alias("rank", "b"))
    return found.select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def against_all(views: DataFrame, fields: str, rows) -> DataFrame:
    """`rows(block, all)` of each block of (ids, S, T) against all rows: ids rise, matrices are double."""
    held = views.orderBy("vec_id").limit(MOST_ROWS + 1).toArrow()
    if held.num_rows > MOST_ROWS:
        raise ValueError(f"pair metrics take {MOST_ROWS} rows at most; draw metric_rows first")
    ids = held["vec_id"].to_numpy()
    s, t = (_matrix(held[c].combine_chunks()) for c in ("s", "t"))
    shared = views.sparkSession.sparkContext.broadcast((ids, s, t))  # MOST_ROWS rows at most
    tasks = max(1, min(64, len(ids) // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everything = shared.value
        for batch in batches:
            for part in batch.column(0).to_pylist():
                at = np.arange(part, len(everything[0]), tasks)
                for chunk in np.array_split(at, max(1, len(at) // 128)):
                    if len(chunk):
                        yield pa.RecordBatch.from_pydict(rows(tuple(x[chunk] for x in everything), everything))

    return views.sparkSession.range(0, tasks, 1, tasks).mapInArrow(run, fields)


def cosines(views: DataFrame) -> DataFrame:
    """(i, j, s, t): both views' cosines of each pair i < j."""

    def rows(block, all_):
        ss, tt = block[1] @ all_[1].T, block[2] @ all_[2].T
        r, c = np.nonzero(block[0][:, None] < all_[0][None, :])
        return {"i": block[0][r], "j": all_[0][c], "s": ss[r, c], "t": tt[r, c]}

    return against_all(views, "i long, j long, s double, t double", rows)


def neighbours(views: DataFrame) -> DataFrame:
    """(vec_id, s_nn, t_nn): the nearest other row in each view, the least id among ties."""

    def rows(block, all_):
        out = {"vec_id": block[0]}
        own = block[0][:, None] == all_[0][None, :]
        for name, k in (("s_nn", 1), ("t_nn", 2)):
            cos = np.round(block[k] @ all_[k].T, 12)  # ties are ties whatever the block
            cos[own] = -np.inf
            out[name] = all_[0][cos.argmax(axis=1)] if len(all_[0]) > 1 else np.full(len(block[0]), -1)
        return out

    return against_all(views, "vec_id long, s_nn long, t_nn long", rows)


def soft_retrieval(views: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(vec_id, loss): cross entropy of the student's softmax over the others under the teacher's."""
    return against_all(views, "vec_id long, loss double", lambda block, all_: _soft_losses(block, all_, temperature))


def soft_retrieval_batches(views: DataFrame, batch: int = 256, temperature: float = 0.05, seed: int = 0) -> DataFrame:
    """(batch, vec_id, loss): soft_retrieval of every row against the others of its batch. Batches are dealt
    in the order of a hash of vec_id, as a training run does; in one of a single row there are no others
    and no loss. A task holds one batch."""
    placed = with_ordinal(views.withColumn("_key", hashing.draw_key(F.col("vec_id"), seed)), "_ord", "_key", "vec_id")
    placed = placed.select(F.floor(F.col("_ord") / batch).alias("batch"), "vec_id", "s", "t")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        every = (rows["vec_id"].to_numpy(), _matrix(rows["s"].combine_chunks()), _matrix(rows["t"].combine_chunks()))
        found = _soft_losses(every, every, temperature) if len(np.unique(every[0])) > 1 else {"vec_id": every[0][:0], "loss": np.zeros(0)}
        return pa.table({"batch": pa.array([key[0].as_py()] * len(found["loss"]), pa.int64()), **found})

    return placed.groupBy("batch").applyInArrow(run, "batch long, vec_id long, loss double")


def _soft_losses(block: tuple, all_: tuple, temperature: float) -> dict:
    """Of rows (ids, S, T) against all: what is of the same id does not count."""
    own = block[0][:, None] == all_[0][None, :]
    logs = []
    for k in (1, 2):
        z = block[k] @ all_[k].T / temperature
        z[own] = -np.inf
        z -= z.max(axis=1, keepdims=True)
        logs.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
    q, p = logs
    return {"vec_id": block[0], "loss": -np.where(own, 0.0, np.exp(p) * np.where(own, 0.0, q)).sum(axis=1)}


def pearson(a: str, b: str) -> Column:
    """Two-pass by central moments Spark keeps; 1e-12 on the denominator makes constants give 0."""
    n = F.count(F.lit(1))
    return F.covar_pop(a, b) * n / (F.sqrt(F.var_pop(a) * n * F.var_pop(b) * n) + 1e-12)


def moments(vectors: DataFrame) -> DataFrame:
    """(a, row, s, n): row a of the second moments of the vectors `v`, component a's sum, the number of
    rows. A task sends its own d x d sums once, and the tasks' rows of a component are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, total, n = 0.0, 0.0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                square, total, n = square + x.T @ x, total + x.sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.arange(len(total)), pa.int32()), "row": pa.array(list(square)), "s": total, "n": np.full(len(total), n)})

    def add(part: pa.Table) -> pa.Table:
        square = _matrix(part["row"].combine_chunks()).sum(axis=0)
        return pa.table({"a": part["a"].slice(0, 1), "row": pa.array([square]), "s": [sum(part["s"].to_pylist())], "n": pa.array([sum(part["n"].to_pylist())], pa.int64())})

    fields = "a int, row array<double>, s double, n long"
    parts = vectors.select(F.col("v").cast("array<double>")).where("v is not null").mapInArrow(run, fields)
    return parts.groupBy("a").applyInArrow(add, fields)  # a row of each task


def gram_mse(views: DataFrame) -> DataFrame:
    """Mean square difference of the views' Gram matrices, all cells, by d x d moments: no pairs."""
    width = views.select(F.max(F.size("s")).alias("d"))  # one row
    both = moments(views.select(F.concat("s", "t").alias("v"))).crossJoin(F.broadcast(width))
    signs = F.transform("row", lambda m, b: F.when((F.col("a") < F.col("d")) == (b < F.col("d")), m * m).otherwise(-m * m))
    return both.agg((F.sum(F.aggregate(signs, F.lit(0.0), lambda t, x: t + x)) / F.max("n") / F.max("n")).alias("loss"))


def covariance(vectors: DataFrame) -> DataFrame:
    """(a, row): scatter matrix of the rows less their mean."""
    cells = moments(vectors)
    sums = cells.agg(F.array_sort(F.collect_list(F.struct("a", "s")))["s"].alias("sums"))  # d numbers
    both = cells.crossJoin(F.broadcast(sums))
    return both.select("a", F.zip_with("row", "sums", lambda m, t: m - F.col("s") * t / F.col("n")).alias("row"))


def mean_cosine(vectors: DataFrame) -> DataFrame:
    """Mean off-diagonal cosine in closed form: (|sum|^2 - sum |v|^2) / (n (n - 1))."""
    own = F.element_at("row", F.col("a") + 1)
    return moments(vectors).agg(((F.sum(F.col("s") * F.col("s")) - F.sum(own)) / (F.max("n") * (F.max("n") - 1))).alias("mean_cosine"))


def participation_ratio(vectors: DataFrame) -> DataFrame:
    cells = covariance(vectors)
    trace = F.sum(F.element_at("row", F.col("a") + 1))
    squares = F.sum(F.aggregate("row", F.lit(0.0), lambda t, x: t + x * x))
    return cells.agg((trace * trace / squares).alias("participation_ratio"))


def effective_rank(vectors: DataFrame) -> DataFrame:
    """exp of the entropy of the scatter matrix's eigenvalues; the d x d matrix goes to the driver."""
    cells = sorted((r.a, r.row) for r in covariance(vectors).collect())
    p = np.clip(np.linalg.eigvalsh(np.array([row for _, row in cells])), 0, None) if cells else np.ones(1)
    p = p / p.sum()
    rank = float(np.exp(-(p * np.log(p + 1e-12)).sum()))
    return vectors.sparkSession.createDataFrame([(round(rank, 6),)], "effective_rank double")


def hub_skew(nearest: DataFrame, column: str) -> DataFrame:
    """Third standardised moment of how often a row is the nearest; rows never chosen count as 0."""
    degree = nearest.groupBy(F.col(column).alias("vec_id")).agg(F.count(F.lit(1)).alias("k"))
    every = nearest.select("vec_id").join(degree, "vec_id", "left").select(F.coalesce("k", F.lit(0)).cast("double").alias("k"))
    stats = every.agg(F.avg("k").alias("m"), F.stddev_pop("k").alias("sd"))
    gap = F.col("k") - F.col("m")
    return every.crossJoin(F.broadcast(stats)).agg((F.avg(gap * gap * gap) / (F.max(F.col("sd") * F.col("sd") * F.col("sd")) + 1e-12)).alias("hub_skew"))
