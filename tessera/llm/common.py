"""Work tables in the cluster's shared folder, and batch helpers for Arrow operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at a time (a longer single document is one step).
STEP_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where it is unset and all runs in one
    process (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
        if not found and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="tessera-")
            context.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths that open scopes have seen made.
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Notes the work tables made inside; all that are still in the list at the end are deleted."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        for path in made:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; its files go when the scope around it or the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a work table to the shared folder and read it again: lineage ends there, and a lost
    executor costs only its running tasks."""
    path = work_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.work_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete work tables of materialise() that nothing will read again."""
    for df in tables:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.work_path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have (names are told apart without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_filter(keys: DataFrame, bits: int = 22) -> Column:
    """A Bloom filter of the one column of `keys`: 2**bits bits in an array of longs, one scalar.

    With very many keys for its size (see filter_bits) it lets everything through, which costs time and
    changes no result: what passes is always joined with the keys themselves.
    """
    words = 1 << (bits - 6)
    at = F.explode(F.array(*_places(F.xxhash64(keys.columns[0]), bits)))
    found = keys.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    every = keys.sparkSession.range(words).join(found, F.col("id") == F.col("w"), "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("f")).select("f.b").scalar()


def _places(hash_: Column, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1).cast("long")
    return [hash_.bitwiseAND(mask), F.shiftrightunsigned(hash_, 32).bitwiseAND(mask)]


def may_be_in(column: Column, filter_: Column, bits: int = 22) -> Column:
    """False only if the column's value is not among the keys of key_filter()."""
    out = F.lit(True)
    for place in _places(F.xxhash64(column), bits):
        word = F.get(filter_, F.shiftright(place, 6).cast("int"))
        out = out & (F.call_function("shiftright", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return out


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `limit` bytes of `column`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def bits_for(rows: int, most: int = 27) -> int:
    """The size of a filter for so many keys, as its logarithm: 16 bits a key, between 2**16 and 2**most
    (16 MB; with more than 8 million keys it lets more through, which changes no result)."""
    return min(most, max(16, (16 * rows).bit_length()))


def filter_bits(keys: DataFrame, most: int = 27) -> int:
    """bits_for() the rows of a work table."""
    return bits_for(keys.count(), most)


def dealt_join(rows: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, spread: str, parts: int = 64, bits: int = 22, how: str = "inner") -> DataFrame:
    """rows joined with `one`, which has a row at most for each value of `keys`; how: inner or left.

    hot is a work table of the first key's values that very many rows have. Rows of a key that the filter of the hot ones
    lets through are dealt to `parts` tasks by column `spread`, and that key's row is copied to each of
    them; both sides ask the same filter, so a match is never lost.
    """
    filter_ = key_filter(hot, bits)
    wide = may_be_in(F.col(keys[0]), filter_, bits)
    part = fresh(rows, "part")
    left = rows.withColumn(part, F.when(wide, F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(F.lit(0).cast("long")))
    copies = F.when(wide, F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return left.join(one.withColumn(part, F.explode(copies)), [*keys, part], how).drop(part)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows (a work table) less those whose `key` is in `gone` (a work table of that column), without the
    column. Only rows that the filter of `gone` lets through are dealt out for the join."""
    bits = filter_bits(gone)
    maybe = may_be_in(F.col(key), key_filter(gone, bits), bits)
    return rows.where(~maybe).unionByName(rows.where(maybe).join(gone, key, "left_anti")).drop(key)
