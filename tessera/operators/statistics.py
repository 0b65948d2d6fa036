"""Bootstrap, paired comparison, classification and clustering scores, draws."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import draws, hashing
from tessera.sources import matrix, store
from tessera.sources.work import scratch_path


def accuracy(rows: DataFrame) -> DataFrame:
    """Of (run, item, y, p): mean, population deviation over runs."""
    runs = rows.groupBy("run").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("a"))
    return runs.agg(F.avg("a").alias("mean"), F.stddev_pop("a").alias("sd"))


def item_means(rows: DataFrame) -> DataFrame:
    """Of (run, item, y, p): each item's share of right answers over the runs that had it."""
    return rows.groupBy("item").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("mean"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """Of (y, p): mean F1 over the union of true and predicted labels, 0 where it is undefined."""
    hit = (F.col("y") == F.col("p")).cast("int")
    counts = rows.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("tp"))
    sides = counts.select(F.col("y").alias("label"), "n", "tp").unionAll(counts.select(F.col("p").alias("label"), "n", F.lit(0).cast("long").alias("tp")))
    labels = sides.groupBy("label").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))  # n: true + predicted
    return labels.agg(F.avg(2.0 * F.col("tp") / F.col("n")).alias("macro_f1"))


def contingency(rows: DataFrame) -> DataFrame:
    """(y, c, n) with the margins ny and nc and the total."""
    cells = rows.groupBy("y", "c").agg(F.count(F.lit(1)).alias("n"))
    by = lambda k: Window.partitionBy(*k)
    return cells.withColumns({"ny": F.sum("n").over(by(["y"])), "nc": F.sum("n").over(by(["c"]))}).crossJoin(cells.agg(F.sum("n").alias("total")))


def v_measure(rows: DataFrame) -> DataFrame:
    """Harmonic mean of homogeneity and completeness; 1 where an entropy is 0."""
    cells = contingency(rows)
    n, total = F.col("n"), F.col("total")
    h = cells.agg(
        (-F.sum(n / total * F.log(F.col("ny") / total))).alias("hy"),
        (-F.sum(n / total * F.log(F.col("nc") / total))).alias("hc"),
        (-F.sum(n / total * F.log(n / F.col("nc")))).alias("hyc"),
        (-F.sum(n / total * F.log(n / F.col("ny")))).alias("hcy"),
    )
    hom = F.when(F.col("hy") == 0, 1.0).otherwise(1 - F.col("hyc") / F.col("hy"))
    com = F.when(F.col("hc") == 0, 1.0).otherwise(1 - F.col("hcy") / F.col("hc"))
    return h.select(F.when(hom + com == 0, 0.0).otherwise(2 * hom * com / (hom + com)).alias("v_measure"))


def adjusted_rand(rows: DataFrame) -> DataFrame:
    two = lambda x: x * (x - 1) / 2
    cells = rows.groupBy("y", "c").agg(F.count(F.lit(1)).alias("n"))
    sums = [cells.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("total"))]
    for k, name in (("y", "sy"), ("c", "sc")):
        sums.append(cells.groupBy(k).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias(name)))
    row = sums[0].crossJoin(sums[1]).crossJoin(sums[2])
    expected = F.col("sy") * F.col("sc") / two(F.col("total"))
    most = (F.col("sy") + F.col("sc")) / 2
    return row.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def few_shot(rows: DataFrame, per_label: int, draws: int, seed: int = 0) -> DataFrame:
    """(draw, label, item): per draw and label the items of the least hash, as many as there are at most.

    The rank is only asked for up to `per_label`, so each task keeps that many rows of a draw and label
    before the exchange (a window group limit), however common a label is.
    """
    each = rows.withColumn("draw", F.explode(F.array(*[F.lit(d) for d in range(draws)])))
    rank = F.row_number().over(Window.partitionBy("draw", "label").orderBy(hashing.draw_key(F.col("item"), F.col("draw"), seed), "item"))
    return each.withColumn("_r", rank).where(F.col("_r") <= per_label).drop("_r")


def folds(rows: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """(item, label, fold): labels dealt evenly to the folds in the order of a hash.

    A label is cut into cells by the hash's first digits; a rank is that within the cell plus the
    rows of the cells before, so no task ranks a whole label.
    """
    keyed = rows.withColumn("_key", hashing.draw_key(F.col("item"), seed))
    keyed = keyed.withColumn("_cell", F.substring("_key", 1, 2))
    counts = keyed.groupBy("label", "_cell").agg(F.count(F.lit(1)).alias("_k"))
    before = F.sum("_k").over(Window.partitionBy("label").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("label", "_cell", F.coalesce(before, F.lit(0)).alias("_before"))  # 256 rows a label at most
    rank = F.row_number().over(Window.partitionBy("label", "_cell").orderBy("_key", "item"))
    placed = keyed.withColumn("_rank", rank).join(starts.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")) & (keyed["_cell"] == starts["_cell"]))
    return placed.withColumn("fold", F.pmod(F.col("_before") + F.col("_rank") - 1, F.lit(k)).cast("int")).select(*rows.columns, "fold")


#: Scores that a bootstrap's task holds (8 bytes each, read from one file). Slots of a replicate that are drawn
#: together, replicates hashed at a time, and draws of a task (a second or two, however many scores there are;
#: reading the scores it holds comes to it).
HELD_SCORES, SLOTS, TOGETHER, TASK_DRAWS = 20_000_000, 1 << 16, 8, 1 << 22


def bootstrap(scores: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """One row: mean, lo and hi (2.5 and 97.5 percentiles) of the mean of resampled scores (ord, x).

    ord is 0..n-1. Replicate b takes for slot i the score of a hashed ordinal. The scores are a file in the
    shared folder, written and read by tasks; a task draws SLOTS slots of some replicates at a time, so
    replicates and slots are both dealt out and a row is a sum of many draws. Of more than HELD_SCORES scores a
    task reads one range, and the drawn ordinals (4 bytes each) are dealt to the tasks of their range.
    Null scores count in no mean.
    """
    size = scores.count()
    sums = _drawn_sums(scores, size, replicates, seed).groupBy("b").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    means = sums.select("b", F.when(F.col("k") > 0, F.col("s") / F.col("k")).alias("m"))
    bounds = means.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return scores.agg(F.avg("x").alias("mean")).crossJoin(bounds)


def _drawn_sums(scores: DataFrame, size: int, replicates: int, seed: int) -> DataFrame:
    """(b, s, k): sums and counts of the drawn scores, of some slots of a replicate in a row."""
    spark = scores.sparkSession
    path = scratch_path(spark, "scores") + "/scores.npy"
    if size:
        matrix.write(scores.select("ord", F.array(F.col("x").cast("double")).alias("v")), path, "v", "ord", dtype="<f8")
    cells = replicates * -(-size // SLOTS)  # those of the same slots side by side
    tasks = max(1, min(cells, max(spark.sparkContext.defaultParallelism, -(-size * replicates // TASK_DRAWS))))
    ranges = max(1, -(-size // max(1, HELD_SCORES)))
    held, shares = -(-size // ranges), -(-tasks // ranges)  # scores of a range, tasks that look up in it

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Cells, their replicates and a row of drawn ordinals each, TOGETHER at most."""
        at = -1
        for batch in batches:
            cell = batch.column(0).to_numpy()
            part, b = np.divmod(cell, replicates)
            for p in np.unique(part).tolist():
                if p != at:
                    at, tails = p, [b"%d|%d" % (i, seed) for i in range(p * SLOTS, min((p + 1) * SLOTS, size))]
                some = np.flatnonzero(part == p)
                for i in range(0, len(some), TOGETHER):
                    rows = some[i : i + TOGETHER]
                    found = draws.digests([b"%d|" % x for x in b[rows].tolist()], tails, 1)[0]
                    yield cell[rows], b[rows], found if size >> 32 else found % np.uint32(size)

    def scores_of(number: int) -> tuple[np.ndarray, np.ndarray]:
        """A range's scores, 0 for null ones, and which are known."""
        start = matrix.read_header(path).start
        with store.open_input(path) as file:
            file.seek(start + 8 * held * number)
            found = np.frombuffer(file.read(8 * min(held, size - held * number)), "<f8")
        known = ~np.isnan(found)
        return np.where(known, found, 0.0), known

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = None
        for _, b, ordinals in drawn(batches):
            if filled is None:
                filled, known = scores_of(0)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(filled[ordinals].sum(axis=1)), pa.array(known[ordinals].sum(axis=1))], names=["b", "s", "k"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = held * np.arange(ranges + 1)
        for cell, b, ordinals in drawn(batches):
            rows = []
            for c, x, row in zip(cell.tolist(), b.tolist(), np.sort(ordinals, axis=1), strict=True):
                cuts = np.searchsorted(row, firsts).tolist()
                rows += [(r * shares + c % shares, x, (row[i:j] - np.uint32(r * held)).tobytes()) for r, (i, j) in enumerate(pairwise(cuts)) if i < j]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["task", "b", "places"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None
        for batch in batches:
            s, k = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, (task, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                if number != task // shares:  # one a task
                    number = task // shares
                    filled, known = scores_of(number)
                at = np.frombuffer(places.as_buffer(), np.uint32)
                s[i], k[i] = filled[at].sum(), known[at].sum()
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(s), pa.array(k)], names=["b", "s", "k"])

    each = spark.range(0, cells, 1, tasks)
    if ranges == 1:
        return each.mapInArrow(sums, "b long, s double, k long")
    dealt = each.mapInArrow(deal, "task long, b long, places binary").repartitionById(ranges * shares, F.col("task").cast("int"))
    return dealt.mapInArrow(look_up, "b long, s double, k long")


def cluster_bootstrap(scores: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """As bootstrap, whole groups (grp 0..g-1) at a time; the mean is over the drawn groups' items."""
    groups = scores.groupBy("grp").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("k"))
    g = groups.agg(F.count(F.lit(1)).alias("g"))
    slots = groups.select("grp").crossJoin(F.broadcast(g)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = slots.select("b", F.pmod(hashing.draw_number(F.col("b"), F.col("grp"), seed), F.col("g")).alias("grp"))
    means = drawn.join(groups, "grp").groupBy("b").agg((F.sum("s") / F.sum("k")).alias("m"))
    mean = scores.agg(F.avg("x").alias("mean"))
    return mean.crossJoin(means.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi")))
