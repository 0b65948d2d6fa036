"""Points in ranges of any length, by an equi-join on dyadic blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.work import work_table

#: Levels of blocks (a block of level k is 2**k positions long); from SPLIT on a block's points are dealt to several tasks.
LEVELS, SPLIT, MOST_PARTS = 62, 16, 256


def blocks(start: Column, end: Column) -> Column:
    """The dyadic blocks that make up [start, end), start at least 0: two of each level at most."""

    def step(held: Column, level: Column) -> Column:
        a, b = held["a"], held["b"]
        odd_a, odd_b = (a < b) & (a % 2 == 1), (a + (a % 2) < b) & (b % 2 == 1)
        block = lambda at: F.array(F.struct(level.alias("level"), at.alias("block")))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        out = F.concat(held["out"], F.when(odd_a, block(a)).otherwise(none), F.when(odd_b, block(b - 1)).otherwise(none))
        up = lambda x, odd, by: F.call_function("shiftright", x + F.when(odd, by).otherwise(0), F.lit(1)).cast("long")
        return F.struct(up(a, odd_a, 1).alias("a"), up(b, odd_b, -1).alias("b"), out.alias("out"))

    zero = F.struct(start.cast("long").alias("a"), end.cast("long").alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), zero, step, lambda held: held["out"])


def _parts(level: Column) -> Column:
    """Tasks that a block's points are dealt to: more for each level over SPLIT."""
    return F.least(F.pow(F.lit(2.0), F.greatest(level - SPLIT, F.lit(0))), F.lit(float(MOST_PARTS))).cast("int")


def points_in_ranges(points: DataFrame, ranges: DataFrame, point: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """points joined with each range [start, end) that holds their position. Ranges may have any lengths,
    overlap and repeat; one that is empty, null or ends before it starts holds nothing. Positions and
    starts are 0 or more.

    A point has one block of each level, so it meets a range in one block exactly: nothing is compared
    after the join. Only levels that ranges use are looked at (a row a level comes to the driver).
    Large blocks, which may hold very many points, are dealt to several tasks.
    """
    cut = ranges.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(blocks(F.col(start), F.col(end))))
    cut = work_table(cut.select(*ranges.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")), "range-blocks")
    levels = sorted(r["_level"] for r in cut.select("_level").distinct().collect())
    cut = cut.withColumn("_part", F.explode(F.sequence(F.lit(0), _parts(F.col("_level")) - 1)))
    at = F.array(*[F.lit(k) for k in levels]).cast("array<int>")
    placed = points.where(F.col(point) >= 0).withColumn("_level", F.explode(at))
    placed = placed.withColumn("_block", F.call_function("shiftright", F.col(point).cast("long"), F.col("_level"))).withColumn("_part", F.pmod(F.hash(point), _parts(F.col("_level"))))
    return placed.join(cut, ["_level", "_block", "_part"]).drop("_level", "_block", "_part")
