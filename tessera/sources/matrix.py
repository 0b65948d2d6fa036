"""Matrix files (.npy) and records of fixed width: scanned by byte ranges, read by row number.

A Spark data source plans a file as ranges of rows from its header alone; a task seeks to its range and
reads it block by block. Rows of given numbers are sought one by one (`take_rows`). A file may be
larger than any task's or the driver's memory.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources import store
from tessera.sources.work import scratch_path, work_table

MAGIC = b"\x93NUMPY"
#: Bytes of one task's range, and of one block of it.
RANGE, BLOCK = 64 << 20, 1 << 20
TYPES = {"<f4": (pa.float32(), "array<float>"), "<f2": (pa.float32(), "array<float>"), "<f8": (pa.float64(), "array<double>"), "<i4": (pa.int32(), "array<int>"), "<i8": (pa.int64(), "array<long>")}


@dataclass
class Header:
    """What a file says of itself: its numbers' type, rows, width, and where the rows begin."""

    dtype: str
    rows: int
    width: int
    start: int

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.dtype).itemsize


def read_header(path: str) -> Header:
    """The header only, whatever the file's size."""
    with store.open_input(path) as file:
        head = file.read(10)
        if head[:6] != MAGIC:
            raise ValueError(f"{path}: no matrix file")
        if head[6] == 1:
            size, start = struct.unpack("<H", head[8:10])[0], 10
        else:
            size, start = struct.unpack("<I", head[8:10] + file.read(2))[0], 12
        said = ast.literal_eval(file.read(size).decode("latin-1"))
    shape = said["shape"]
    if len(shape) != 2 or said["fortran_order"] or said["descr"] not in TYPES:
        raise ValueError(f"{path}: {said} is no row-major matrix of {sorted(TYPES)}")
    return Header(said["descr"], shape[0], shape[1], start + size)


def header_bytes(dtype: str, rows: int, width: int) -> bytes:
    text = f"{{'descr': '{dtype}', 'fortran_order': False, 'shape': ({rows}, {width}), }}"
    text += " " * (-(len(text) + 11) % 64) + "\n"
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(text)) + text.encode()


def as_lists(block: np.ndarray) -> pa.Array:
    kind = TYPES[block.dtype.newbyteorder("<").str][0]
    flat = pa.array(np.ascontiguousarray(block).ravel().astype(kind.to_pandas_dtype(), copy=False), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * block.shape[1]), flat)


@dataclass
class Rows(InputPartition):
    start: int
    stop: int


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.header = path, size, read_header(path)

    def partitions(self) -> list[Rows]:
        step = max(1, self.size // max(self.header.row_bytes, 1))
        return [Rows(a, min(a + step, self.header.rows)) for a in range(0, self.header.rows, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        head, step = self.header, max(1, BLOCK // max(self.header.row_bytes, 1))
        with store.open_input(self.path) as file:
            file.seek(head.start + partition.start * head.row_bytes)
            for a in range(partition.start, partition.stop, step):
                b = min(a + step, partition.stop)
                raw = file.read((b - a) * head.row_bytes)
                block = np.frombuffer(raw, head.dtype).reshape(b - a, head.width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), as_lists(block)], names=["pos", "v"])


class MatrixSource(DataSource):
    """spark.read.format("matrix").load(path): (pos, v). Option `bytes`: of one task's range."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return f"pos long, v {TYPES[read_header(self.options['path']).dtype][1]}"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("bytes", RANGE)))


def scan(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").option("bytes", size).load(path)


def take_rows(wanted: DataFrame, path: str, column: str = "pos") -> DataFrame:
    """wanted with v, the row of the file that its `column` numbers; null where there is none. Repeated
    numbers and their order stay; each task seeks its rows in rising order within a batch."""
    kind = TYPES[read_header(path).dtype][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = read_header(path)
        with store.open_input(path) as file:
            for batch in batches:
                at = batch.schema.get_field_index(column)
                numbers = batch.column(at).fill_null(-1).to_numpy().astype(np.int64)
                here = (numbers >= 0) & (numbers < head.rows)
                different, back = np.unique(numbers[here], return_inverse=True)
                block = np.zeros((len(different), head.width), head.dtype)
                for k, number in enumerate(different.tolist()):
                    file.seek(head.start + number * head.row_bytes)
                    block[k] = np.frombuffer(file.read(head.row_bytes), head.dtype)
                place = np.full(len(numbers), -1)
                place[here] = back
                yield batch.append_column("v", as_lists(block).take(pa.array(place, mask=place < 0)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    return wanted.mapInArrow(run, f"{fields}, v {kind}")


def write(rows: DataFrame, path: str, vector: str, *order: str, dtype: str = "<f4") -> None:
    """The vectors in an order as one file. Rows are dealt to ranges of the order once, and each task
    writes its own range; one task then joins them block by block, so no whole file is in memory anywhere."""
    folder = scratch_path(rows.sparkSession, "matrix-parts")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()  # as high as the range
        made, n, least, most = f"{folder}/{number}.bin", 0, None, None
        with store.Output(made) as file:
            for batch in batches:
                if batch.num_rows:
                    sizes = pc.min_max(pc.fill_null(pc.list_value_length(batch.column(0)), -1)).as_py()
                    n, least, most = n + batch.num_rows, min(sizes["min"], sizes["min"] if least is None else least), max(sizes["max"], most or 0)
                    file.write(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(dtype).tobytes())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, made, n, least, most)], names=["number", "part", "n", "least", "most"])

    dealt = rows.select(vector, *order).repartitionByRange(*order).sortWithinPartitions(*order).select(vector)
    parts = work_table(dealt.mapInArrow(part, "number long, part string, n long, least long, most long"), "matrix-list")
    n, least, width = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("least"), F.max("most")).first()
    if width != least:
        raise ValueError("vectors of different lengths, or null ones, are no matrix")
    head = header_bytes(dtype, n, width or 0)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with store.Output(path) as out:
            out.write(head)
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with store.open_input(name) as file:
                        for block in store.chunks(file):
                            out.write(block)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    # a row a range of rows, in one task
    parts.coalesce(1).sortWithinPartitions("number").select("part").mapInArrow(join, "path string").collect()
