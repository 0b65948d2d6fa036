"""Published folders: staged, checked, then renamed; sidecars, states, matrices and task tables.

Every path goes through the file system that Spark knows for it, so any such store will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cache
from tessera.sources import readers


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _files(spark, path)
    return store.exists(where)


def publish(spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[str], bool] | None = None) -> None:
    """Let `write` fill a staging folder beside `path`, `check` it, and put it in the place of `path`.

    Readers see the folder as it was or as it is. What fails or does not pass the check is removed.
    """
    mark = uuid.uuid4().hex
    staging, aside = f"{path.rstrip('/')}.{mark}.new", f"{path.rstrip('/')}.{mark}.old"
    store, target = _files(spark, path)
    new, old = _files(spark, staging)[1], _files(spark, aside)[1]
    try:
        write(staging)
        if check is not None and not check(staging):
            raise ValueError(f"{path}: what was written does not pass its check")
        if store.exists(target):
            store.rename(target, old)
        if not store.rename(new, target):
            if store.exists(old):
                store.rename(old, target)
            raise OSError(f"{path}: could not be put in place")
    finally:
        store.delete(new, True)
        if store.exists(target):
            store.delete(old, True)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, published by a rename."""

    def write(staging: str) -> None:
        store, where = _files(spark, staging)
        out = store.create(where, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    publish(spark, path, write)


def write_json(spark: SparkSession, path: str, row: DataFrame) -> None:
    """A one-row table as one JSON object."""
    write_bytes(spark, path, row.toJSON().first().encode())


def write_aligned(spark: SparkSession, folder: str, sentences: DataFrame, embedded: DataFrame, **settings) -> None:
    """embedded (pos, sentence, e), a part of the sentences in their order, with a sidecar of its coverage."""
    counts = cache.coverage(sentences, embedded)
    width = embedded.agg(F.max(F.size("e")).alias("width"))
    row = counts.crossJoin(width).select(*[F.lit(v).alias(k) for k, v in settings.items()], "*")

    def write(staging: str) -> None:
        embedded.repartitionByRange("pos").sortWithinPartitions("pos").write.parquet(f"{staging}/rows")
        write_json(spark, f"{staging}/meta.json", row)

    publish(spark, folder, write, lambda staging: spark.read.parquet(f"{staging}/rows").count() == embedded.count())


def read_aligned(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/rows"), readers.read_meta(spark, f"{folder}/meta.json", schema)


def write_state(spark: SparkSession, folder: str, step: int, state: DataFrame) -> None:
    """A step's state, one JSON object, as the folder's subfolder of that number."""
    publish(spark, f"{folder}/{step}", lambda staging: write_json(spark, f"{staging}/state.json", state))


def read_state(spark: SparkSession, folder: str, schema: str, step: int | None = None) -> DataFrame | None:
    """The newest state of a folder, or that of a step: (step, fields of schema). None if there is none.
    Folders without a number, and what is still staged, are no states."""
    store, where = _files(spark, folder)
    names = [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []
    steps = [int(n) for n in names if n.isdigit()]
    wanted = step if step is not None else max(steps, default=None)
    if wanted is None or wanted not in steps:
        return None
    return readers.read_meta(spark, f"{folder}/{wanted}/state.json", schema).select(F.lit(wanted).alias("step"), "*")


def finished_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard_start) of the shards that a folder has: a shard's folder is there once it is whole."""
    store, where = _files(spark, folder)
    names = [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []
    starts = [(int(n.partition("=")[2]),) for n in names if n.startswith("shard_start=") and n.partition("=")[2].isdigit()]
    return spark.createDataFrame(starts, "shard_start long")


def read_task(spark: SparkSession, root: str, name: str, revision: str, splits: tuple[str, ...]) -> DataFrame:
    """(split, columns) of a task's splits at a pinned revision: root/name/revision/split."""
    parts = [spark.read.parquet(f"{root}/{name}/{revision}/{split}").select(F.lit(split).alias("split"), "*") for split in splits]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
