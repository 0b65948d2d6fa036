"""Streams that are stopped and go on: batches written once to several sinks, snapshots, restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.artifacts import exists

Sinks = dict[str, Callable[[DataFrame], DataFrame]]


class Stopped(Exception):
    """A stream stopped on purpose before a micro-batch."""


def run(stream: DataFrame, folder: str, sinks: Sinks, stop_before: int | None = None, broken_after: str | None = None) -> None:
    """Take what is there. Each micro-batch is held once and written to every sink under its own number,
    so a batch that is repeated after a failure overwrites itself in all of them: each sink has each
    row once. State is kept in the folder; run again, the stream goes on where it was.

    stop_before: a batch number to stop at. broken_after: a sink after which batch 1 fails once.
    """

    def write(batch: DataFrame, number: int) -> None:
        if stop_before is not None and number >= stop_before:
            raise Stopped(f"before batch {number}")
        batch = batch.persist()
        try:
            for name, part in sinks.items():
                part(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
                if name == broken_after and number == 1:
                    raise Stopped(f"in batch {number} after {name}")
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception as failed:
        if "Stopped" not in str(failed):
            raise


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}").drop("batch")


def counted(name: str, spark: SparkSession, folder: str, every: int) -> None:
    """A snapshot of sink `name` for each full `every` items that it holds, by (batch, items so far): it is
    the list of batches that make it up, so that it costs a few rows, and is read with `snapshot`."""
    sizes = spark.read.parquet(f"{folder}/{name}").groupBy("batch").count().orderBy("batch").collect()  # a row a batch
    total = 0
    for r in sizes:
        before, total = total, total + r["count"]
        if total // every > before // every:
            where = f"{folder}/snapshots/items={total}"
            if not exists(spark, where):
                batches = [(x.batch,) for x in sizes if x.batch <= r.batch]
                spark.createDataFrame(batches, "batch int").write.parquet(where)


def snapshot(spark: SparkSession, folder: str, name: str, items: int) -> DataFrame:
    batches = spark.read.parquet(f"{folder}/snapshots/items={items}")
    return spark.read.parquet(f"{folder}/{name}").join(F.broadcast(batches), "batch", "left_semi").drop("batch")
