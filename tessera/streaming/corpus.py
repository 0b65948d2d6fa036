"""Structured Streaming forms of corpus operators. With availableNow each gives the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.operators import corpus, tokens
from tessera.sources.work import scratch_path


def read_files(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)


def run_once(stream: DataFrame, tag: str, each=None) -> DataFrame:
    """Take all that is there, through a checkpoint, and read what was written. `each(batch, path)`
    writes a micro-batch under a path of its own number, so a repeated batch overwrites itself."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, tag), scratch_path(spark, f"{tag}-state")

    def write(batch: DataFrame, number: int) -> None:
        made = batch if each is None else each(batch)
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def distinct_sentences(docs: DataFrame) -> DataFrame:
    """Each sentence when it is first seen. State holds every sentence's hash group, as long as the
    stream lives: without event time there is no point after which one may be forgotten."""
    return corpus.sentences(docs).select("sentence").dropDuplicates(["sentence"])


def split_windows(docs: DataFrame, share: float, seed: int) -> DataFrame:
    """One pass: byte windows with the side of their document, for two sinks. The document's own id is
    hashed, as a stream has no ordinals."""
    kept = corpus.long_documents(docs).select(F.col("doc_id").alias("doc_idx"), "text")
    sided = tokens.byte_windows(kept).withColumn("side", F.when(hashing.split_hash(F.col("doc_idx"), seed) < share, "val").otherwise("train"))
    return sided


def cache_fill(docs: DataFrame, known: DataFrame) -> DataFrame:
    """A micro-batch's keys that the durable cache lacks: at-least-once delivery stays idempotent by key."""
    keyed = docs.select("doc_id", hashing.cache_key(F.col("text"), "teacher", "passage", None).alias("k"))
    return keyed.join(known, "k", "left_anti").dropDuplicates(["k"])
