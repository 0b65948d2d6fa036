"""Files written and digested by tasks, as streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import store
from tessera.sources.work import scratch_path, work_table


def write_each(rows: DataFrame, folder: str, name: Column, content: Column) -> DataFrame:
    """(path, bytes) of a file for each row; a task that runs again writes the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = [], []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                with store.Output(f"{folder}/{n}") as out:
                    out.write(raw)
                paths.append(f"{folder}/{n}")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.select(name.cast("string"), content).mapInArrow(run, "path string, bytes long")


def digests(files: DataFrame, algorithm: str = "sha256", block: int = store.CHUNK) -> DataFrame:
    """files (path, ...) with the digest of each and its size, read block by block: a file may be larger
    than memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                state, size = hashlib.new(algorithm), 0
                with store.open_input(path) as file:
                    for piece in store.chunks(file, block):
                        state.update(piece)
                        size += len(piece)
                found.append(state.hexdigest())
                sizes.append(size)
            yield batch.append_column("digest", pa.array(found, pa.string())).append_column("size", pa.array(sizes, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{fields}, digest string, size long")


def digest_in_order(rows: DataFrame, column: str, *order: str, between: bytes = b"\0", algorithm: str = "sha1") -> DataFrame:
    """One row (digest, n): the digest of all texts of a column in an order, `between` between them; null of none.

    Tasks write their ranges of the order as files of the shared folder. Such a digest is sequential, so one task
    then reads the files, block by block, whatever their size; the driver sees none of them.
    """
    folder = scratch_path(rows.sparkSession, "digest-parts")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n = TaskContext.get().partitionId(), 0  # as high as the range
        with store.Output(f"{folder}/{number}") as out:
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    out.write(between * (n > 0) + text.encode())
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([f"{folder}/{number}"]), pa.array([n])], names=["number", "part", "n"])

    dealt = rows.select(column, *order).repartitionByRange(*order).sortWithinPartitions(*order).select(column)
    parts = work_table(dealt.mapInArrow(part, "number long, part string, n long"), "digest-list")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, total = hashlib.new(algorithm), 0
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                state.update(between * (total > 0))
                with store.open_input(path) as file:
                    for block in store.chunks(file):
                        state.update(block)
                total += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()]), pa.array([total])], names=["digest", "n"])

    # a row a range, in one task
    made = parts.repartition(1).sortWithinPartitions("number").select("part", "n").mapInArrow(join, "digest string, n long")
    return made.agg(F.max("digest").alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
