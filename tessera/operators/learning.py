"""Probes and clusterings of vectors by the library's own distributed models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.operators import statistics
from tessera.operators.ordering import with_ordinal
from tessera.sources.work import work_table


def featured(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def few_shot_probe(rows: DataFrame, per_label: int = 8, draws: int = 10, seed: int = 0) -> DataFrame:
    """(run, item, y, p): each draw's model on the rows (item, label, embedding) that it does not train on."""
    rows = work_table(featured(rows), "featured")
    drawn = work_table(statistics.few_shot(rows.select("item", "label"), per_label, draws, seed).select("draw", "item"), "drawn")
    out = None
    for draw in range(draws):  # ten small models
        train = rows.join(drawn.where(F.col("draw") == draw), "item", "left_semi")
        model = LogisticRegression(maxIter=100, labelCol="label").fit(train)
        test = model.transform(rows.join(drawn.where(F.col("draw") == draw), "item", "left_anti"))
        part = test.select(F.lit(draw).alias("run"), "item", F.col("label").alias("y"), F.col("prediction").cast("int").alias("p"))
        out = part if out is None else out.unionAll(part)
    return out


def cross_validated_probe(rows: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """(run, item, y, p): each fold predicted by the model of the other folds."""
    rows = work_table(featured(statistics.folds(rows, k, seed)), "folds")
    out = None
    for fold in range(k):
        model = LogisticRegression(maxIter=100, labelCol="label").fit(rows.where(F.col("fold") != fold))
        part = model.transform(rows.where(F.col("fold") == fold)).select(F.lit(fold).alias("run"), "item", F.col("label").alias("y"), F.col("prediction").cast("int").alias("p"))
        out = part if out is None else out.unionAll(part)
    return out


def drawn_batches(spark, runs: int, starts: int, steps: int, batch: int, first: int, n: int, seed: int) -> DataFrame:
    """(run, start, step, slot, ord): the rows that each start of each run sees, in its order; `first` rows of
    step -1 to begin with. A row is drawn among the run's own resample of the n rows."""
    total = runs * starts * (first + steps * batch)
    at = F.col("id") % (first + steps * batch)
    start = F.call_function("div", F.col("id"), F.lit(first + steps * batch))
    rows = spark.range(total).select(F.call_function("div", start, F.lit(starts)).alias("run"), (start % starts).alias("start"), F.when(at < first, F.lit(-1)).otherwise(F.call_function("div", at - first, F.lit(batch))).cast("long").alias("step"), at.alias("slot"))
    drawn = F.pmod(hashing.draw_number(F.lit("batch"), F.col("run"), F.col("start"), F.col("slot"), seed), F.lit(n))
    return rows.withColumn("_j", drawn).select("run", "start", "step", "slot", F.pmod(hashing.draw_number(F.col("run"), F.col("_j"), seed), F.lit(n)).alias("ord"))


def seeded(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the points as first centres, each drawn by its squared distance to those before it."""
    centres = [points[rng.integers(len(points))]]
    gap = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = np.cumsum(gap)
        at = int(np.searchsorted(total, rng.random() * total[-1], "right")) if total[-1] > 0 else int(rng.integers(len(points)))
        centres.append(points[min(at, len(points) - 1)])
        gap = np.minimum(gap, ((points - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first nearest centre, the squared distance to it) of each point."""
    gap = np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)
    at = gap.argmin(axis=1)
    return at, gap[np.arange(len(points)), at]


def trained(first: np.ndarray, batches: list[np.ndarray], k: int, rng: np.random.Generator) -> np.ndarray:
    """Mini-batch k-means: every batch moves each centre by its points' mean, with the rate points seen
    now to points seen ever."""
    centres, seen = seeded(first, k, rng), np.zeros(k)
    for points in batches:
        at, _ = nearest_centre(points, centres)
        m = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, weights=x, minlength=k) for x in points.T], axis=1)
        seen += m
        some = m > 0
        centres[some] += (total[some] - m[some, None] * centres[some]) / seen[some, None]
    return centres


def minibatch_centres(rows: DataFrame, n: int, k: int, runs: int, starts: int = 3, batch: int = 500, steps: int = 40, seed: int = 0) -> DataFrame:
    """(run, start, centres) of mini-batch k-means on rows (ord, embedding), ord 0 to n-1. A task holds one
    start's batches, steps * batch vectors whatever n is."""
    drawn = drawn_batches(rows.sparkSession, runs, starts, steps, batch, 3 * batch, n, seed)
    seen = drawn.join(rows.select("ord", F.col("embedding").cast("array<double>").alias("v")), "ord")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("slot")
        v, step = np.stack(part["v"].to_numpy()), part["step"].to_numpy()
        batches = [v[step == s] for s in range(steps)]
        centres = trained(v[step == -1], batches, k, np.random.default_rng([seed, int(key[0]), int(key[1])]))
        return pd.DataFrame({"run": [key[0]], "start": [key[1]], "centres": [centres.tolist()]})

    return seen.groupBy("run", "start").applyInPandas(run, "run long, start long, centres array<array<double>>")


def clustered(rows: DataFrame, n: int, k: int, runs: int, starts: int = 3, seed: int = 0, steps: int = 40) -> DataFrame:
    """(run, item, y, c): each run's resample of rows (ord, item, label, embedding) in the clusters of its
    best start, the one of the least sum of squared distances over the whole resample."""
    spark = rows.sparkSession
    found = minibatch_centres(rows, n, k, runs, starts, seed=seed, steps=steps).collect()
    centres = {(r.run, r.start): np.array(r.centres) for r in found}
    shared = spark.sparkContext.broadcast(centres)  # k centres for each start of each run
    picked = rows.select("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))).alias("run")).select("run", F.pmod(hashing.draw_number(F.col("run"), F.col("ord"), seed), F.lit(n)).alias("ord"))
    sample = picked.join(rows, "ord").select("run", "item", F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            of = batch.column(0).to_numpy()
            c, d = np.zeros((len(of), starts), np.int32), np.zeros((len(of), starts))
            for r in np.unique(of):
                for s in range(starts):
                    c[of == r, s], d[of == r, s] = nearest_centre(v[of == r], shared.value[int(r), s])
            ends = pa.array(np.arange(len(of) + 1, dtype=np.int32) * starts)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (c, d)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["run", "item", "y", "c", "d"])

    kinds = {f.name: f.dataType.simpleString() for f in sample.schema}
    placed = work_table(sample.mapInArrow(run, f"run long, item {kinds['item']}, y {kinds['y']}, c array<int>, d array<double>"), "clustered")
    cost = placed.groupBy("run").agg(F.array(*[F.sum(F.get("d", F.lit(s))) for s in range(starts)]).alias("cost"))
    best = cost.select("run", (F.array_position("cost", F.array_min("cost")) - 1).cast("int").alias("best"))
    return placed.join(F.broadcast(best), "run").select("run", "item", "y", F.get("c", F.col("best")).alias("c"))  # a row a run


def clustering_scores(rows: DataFrame, runs: int = 10, seed: int = 0) -> DataFrame:
    """One row: v-measure (mean, population deviation) and adjusted Rand index over bootstrap resamples,
    each clustered by mini-batches into as many clusters as there are labels, the best of three starts."""
    rows = work_table(with_ordinal(rows, "ord", "item"), "ordered")
    n, k = rows.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    found = work_table(clustered(rows, n, k, runs, seed=seed), "scored")
    scores = []
    for run in range(runs):  # ten contingency tables
        part = found.where(F.col("run") == run)
        scores.append((run, *statistics.v_measure(part).crossJoin(statistics.adjusted_rand(part)).first()))
    made = rows.sparkSession.createDataFrame(scores, "run int, v double, a double")
    return made.agg(F.avg("v").alias("v_measure"), F.stddev_pop("v").alias("v_measure_sd"), F.avg("a").alias("ari"), F.lit(n).alias("n"), F.lit(k).alias("n_clusters"))
