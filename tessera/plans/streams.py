"""Queries that run as streams until all input is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays, hashing
from tessera.plans.corpus import BYTES, DISTINCT, mixed
from tessera.plans.registry import query, table
from tessera.sources.work import scratch_path, work_table
from tessera.streaming import corpus, limits, sinks


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table's folder, or the folder of its one file, as a stream of files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{sf}/{name}.parque[t]")


@query(f"WITH {DISTINCT} SELECT sentence FROM firsts")
def stream_sentence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.run_once(corpus.distinct_sentences(_stream(spark, sf, "documents")), "stream-dedup")


@query(f"""WITH kept AS (SELECT doc_id AS doc_idx, text FROM documents WHERE length(text) > 200), {mixed('doc_idx', 0)}, toks AS (SELECT doc_idx, h, {BYTES.format('text')} AS ids FROM hashed),
    s AS (SELECT doc_idx, h, ids, unnest(range(0, len(ids), 126)) AS s FROM toks), w AS (SELECT doc_idx, h, (s // 126)::INT AS win_idx, ids[s + 1 : s + 126] AS piece FROM s)
    SELECT doc_idx, win_idx, CASE WHEN h < 0.05 THEN 'val' ELSE 'train' END AS side, array_to_string([3] || piece || [4] || [0 FOR i IN range(126 - len(piece))], ',') AS ids FROM w WHERE len(piece) >= 32""")
def stream_split_windows(spark: SparkSession, sf: str) -> DataFrame:
    made = corpus.split_windows(_stream(spark, sf, "documents"), 0.05, 0)
    return corpus.run_once(made, "stream-windows").withColumn("ids", arrays.joined(F.col("ids"))).select("doc_idx", "win_idx", "side", "ids")


WINDOWS = f"""WITH kept AS (SELECT doc_id AS doc_idx, text FROM documents WHERE length(text) > 200), {mixed('doc_idx', 0)}, w AS (SELECT doc_idx, h, strlen(text) // 126 + (strlen(text) % 126 >= 32)::INT AS wins FROM hashed)"""


#: Rows of a file of a stream, about.
FILE_ROWS = 50_000


def _in_files(spark: SparkSession, sf: str, name: str, order: str, parts: int) -> DataFrame:
    """The table as a stream of files in an order: a part, of one file or of as many as keep a file at about
    FILE_ROWS rows, is a micro-batch, so no task writes or reads a part that grows with the table."""
    folder, rows = scratch_path(spark, f"files-{name}"), table(spark, sf, name)
    files = -(-rows.count() // (parts * FILE_ROWS)) or 1
    cut = work_table(rows.repartitionByRange(parts * files, order).withColumn("_part", F.floor(F.spark_partition_id() / files)), "parts")
    sizes = {r._part: r["count"] for r in cut.groupBy("_part").count().collect()}  # a row a part
    if min(sizes.values(), default=0) < 1000 * files:
        files = 1  # some file might have no row and not be written
    for part in range(parts) if files == 1 else sorted(sizes):  # one after the other, as a stream takes files by the time they are written
        rest = cut.where(F.col("_part") == part).drop("_part")
        (rest.coalesce(1) if files == 1 else rest.repartition(files)).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query(WINDOWS + " SELECT CASE WHEN h < 0.05 THEN 'val' ELSE 'train' END AS side, sum(wins)::BIGINT AS windows, count(*) FILTER (wins > 0) AS docs FROM w GROUP BY 1")
def stream_two_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """One pass to two sinks, broken between them in its second micro-batch and run again: each window once."""
    stream, folder = _in_files(spark, sf, "documents", "doc_id", 4), scratch_path(spark, "two-sinks")
    made = corpus.split_windows(stream, 0.05, 0).select("doc_idx", "win_idx", "side")
    parts = {side: (lambda batch, side=side: batch.where(F.col("side") == side)) for side in ("train", "val")}
    sinks.run(made, folder, parts, broken_after="train")
    sinks.run(made, folder, parts)
    both = sinks.read(spark, folder, "train").unionByName(sinks.read(spark, folder, "val"))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("doc_idx").alias("docs"))


@query("SELECT count(*) AS events, sum(event_id)::BIGINT AS ids, round(sum(value), 3) AS total FROM events")
def stream_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A stream stopped after two micro-batches and run again from its checkpoint; what the snapshot of all
    items holds."""
    stream, folder = _in_files(spark, sf, "events", "ts", 5), scratch_path(spark, "resumed")
    parts = {"events": lambda batch: batch}
    sinks.run(stream, folder, parts, stop_before=2)
    sinks.counted("events", spark, folder, 1)
    sinks.run(stream, folder, parts)
    sinks.counted("events", spark, folder, 1)
    n = table(spark, sf, "events").count()
    held = sinks.snapshot(spark, folder, "events", n)
    return held.agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 3).alias("total"))


@query()
def rate_limiter_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The limiter's waits as a stream with state and timers for each user."""
    return corpus.run_once(limits.limited(_in_files(spark, sf, "events", "ts", 3), rpm=3, tpm=500.0), "limiter")


@query("WITH s AS (SELECT doc_id, sha1('teacher|passage|full' || chr(0) || text) AS k FROM documents) SELECT DISTINCT k FROM s WHERE k NOT IN (SELECT k FROM s JOIN labels USING (doc_id))")
def stream_cache_fill(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    known = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(hashing.cache_key(F.col("text"), "teacher", "passage", None).alias("k")).distinct()
    return corpus.run_once(_stream(spark, sf, "documents"), "stream-cache", lambda batch: corpus.cache_fill(batch, known)).select("k").distinct()


@query("SELECT epoch_us(ts) // 86400000000 AS day, count(*) AS requests, round(sum(value), 3) AS tokens FROM events GROUP BY 1")
def stream_daily_usage(spark: SparkSession, sf: str) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("day")
    parts = corpus.run_once(_stream(spark, sf, "events"), "stream-usage", lambda batch: batch.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")))
    return parts.groupBy("day").agg(F.sum("n").alias("requests"), F.round(F.sum("s"), 3).alias("tokens"))
