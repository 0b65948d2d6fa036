"""Content-keyed vector caches, positional shards, coverage, resume bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import hashing


def last_wins(lines: DataFrame) -> DataFrame:
    """(k, e): of cache lines (line, k, e) with the same key the last; blank ones have no key."""
    latest = F.max_by("e", "line").alias("e")
    return lines.where(F.col("k").isNotNull()).groupBy("k").agg(latest)


def missing(sentences: DataFrame, cache: DataFrame) -> DataFrame:
    """Sentences with key k that the cache lacks."""
    return sentences.join(cache.select("k"), "k", "left_anti")


def aligned(sentences: DataFrame, cache: DataFrame) -> DataFrame:
    """Sentences with their vectors: input order is in `pos`, repeated sentences stay, misses go."""
    return sentences.join(cache, "k")


def coverage(total: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row: input_total, embedded, coverage (4 decimals; 0 of nothing) and complete."""
    counts = total.agg(F.count(F.lit(1)).alias("input_total")).crossJoin(embedded.agg(F.count(F.lit(1)).alias("embedded")))
    share = F.when(F.col("input_total") == 0, F.lit(0.0)).otherwise(F.bround(F.col("embedded") / F.col("input_total"), 4))
    return counts.select("input_total", "embedded", share.alias("coverage"), (F.col("embedded") >= F.col("input_total")).alias("complete"))


def shard_ranges(spark, n: int, size: int) -> DataFrame:
    """(shard_start, shard_end) that cover 0..n; a size of 0 or less is one shard."""
    size = size if size > 0 else max(n, 1)
    starts = spark.range(0, n, size) if n else spark.range(0)
    return starts.select(F.col("id").alias("shard_start"), F.least(F.col("id") + size, F.lit(n)).alias("shard_end"))


def missing_shards(ranges: DataFrame, done: DataFrame) -> DataFrame:
    return ranges.join(done.select("shard_start"), "shard_start", "left_anti")


def rows_in_shards(rows: DataFrame, done: DataFrame, size: int) -> DataFrame:
    """Rows whose position is in a finished shard: an equi-join, as all shards start at multiples of size."""
    start = (F.floor(F.col("pos") / size) * size).cast("long")
    return rows.withColumn("shard_start", start).join(done.select("shard_start"), "shard_start", "left_semi")


def is_prefix(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row: whether the previous sentences are the first ones of the current (null-safe)."""
    both = previous.select("pos", F.col("sentence").alias("a")).join(current.select("pos", F.col("sentence").alias("b"), F.lit(True).alias("there")), "pos", "left")
    same = F.coalesce(F.col("there"), F.lit(False)) & F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("is_prefix"), F.count(F.lit(1)).alias("n_previous"))


def seedable(ranges: DataFrame, n_previous: DataFrame) -> DataFrame:
    """Shards wholly inside what an earlier session made."""
    return ranges.crossJoin(F.broadcast(n_previous)).where("is_prefix and shard_end <= n_previous").select("shard_start", "shard_end")


def assembled(parts: DataFrame, n: int) -> DataFrame:
    """parts (part, pos, ...) if their sizes add up to n, in one row the check: rows, distinct and whole."""
    return parts.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("pos").alias("positions")).withColumn("whole", (F.col("rows") == n) & (F.col("positions") == n))


def changed_settings(current: DataFrame, saved: DataFrame) -> DataFrame:
    """(key, current, saved): settings of the current run that the saved one has otherwise or lacks."""
    both = current.select("key", F.col("value").alias("current")).join(saved.select("key", F.col("value").alias("saved")), "key", "left")
    return both.where(~F.col("current").eqNullSafe(F.col("saved")))


def newest(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(run, source, epoch): the newer state of each run, the local one if they are equal; a remote one
    of another fingerprint is refused."""
    both = local.select("run", F.col("epoch").alias("le"), F.col("fingerprint").alias("lf")).join(remote.select("run", F.col("epoch").alias("re"), F.col("fingerprint").alias("rf")), "run", "full")
    source = F.when(F.col("re").isNull(), "local").when(F.col("le").isNull(), "remote").when(F.col("re") <= F.col("le"), "local").when(F.col("lf") != F.col("rf"), "refused").otherwise("remote")
    picked = both.withColumn("source", source)
    return picked.select("run", "source", F.when(F.col("source") == "remote", F.col("re")).otherwise(F.col("le")).alias("epoch"))


def run_keys(texts: DataFrame, **settings) -> DataFrame:
    return texts.select("*", hashing.config_key(F.col("corpus"), **settings).alias("config_key"))
