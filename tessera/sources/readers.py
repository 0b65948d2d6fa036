"""Readers and writers of the file forms a corpus takes. Paths go through Spark, so any store it
knows will do."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import text
from tessera.operators import cache

CACHE_SCHEMA = "k string, e array<float>"
#: Bytes of text that a task encodes at a time (a longer text is alone or at the end of a step).
STEP_BYTES = 1 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without white space at their ends; blank ones are dropped."""
    return spark.read.text(path).select(text.stripped(F.col("value")).alias("sentence")).where(F.length("sentence") > 0)


def write_lines(df: DataFrame, path: str, column: str = "sentence") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(k, e) of JSON lines {"k": ..., "e": [...]}: of a key's lines the last in (file, line) order."""
    lines = spark.read.schema(CACHE_SCHEMA).json(path)
    placed = lines.withColumn("line", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return cache.last_wins(placed)


def append_cache(df: DataFrame, path: str) -> None:
    df.select("k", "e").write.mode("append").json(path)


def read_list(spark: SparkSession, path: str, element: str = "string") -> DataFrame:
    """(pos, value) of files that each hold one JSON list."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<{element}>").alias("v"))
    return whole.select(F.posexplode("v").alias("pos", "value"))


def read_meta(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON object as one row; unknown fields are dropped, missing ones are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def as_half(vector):
    """Components rounded to 16-bit floats, as a shard stores them."""

    @F.arrow_udf("array<float>")
    def rounded(column: pa.Array) -> pa.Array:
        halves = column.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=None), pa.array(halves), mask=column.is_null() if column.null_count else None)

    return rounded(vector)


def write_windows(windows: DataFrame, path: str) -> None:
    """Windows (with `side`) as one folder a side."""
    windows.write.mode("overwrite").partitionBy("side").parquet(path)


def encode_with(df: DataFrame, tokenizer_json: str, column: str = "text") -> DataFrame:
    """df's item_id and ids by a tokenizer of the `tokenizers` library, in steps of bounded size, one load a worker."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(shared.value)
        for batch in batches:
            for first, last in _steps(batch.column(1)):
                ids = _encoded(tokenizer, batch.column(1).slice(first, last - first))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], names=["item_id", "ids"])

    return df.select("item_id", F.col(column).alias("_text")).mapInArrow(run, "item_id long, ids array<int>")


def used_ids(df: DataFrame, tokenizer_json: str, column: str = "text") -> DataFrame:
    """(id): the different ids of encode_with. A task passes each of its ids on once."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(shared.value)
        seen = np.zeros(max(tokenizer.get_vocab().values(), default=-1) + 1, bool)
        for batch in batches:
            for first, last in _steps(batch.column(0)):
                for ids in _encoded(tokenizer, batch.column(0).slice(first, last - first)):
                    seen[ids] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], names=["id"])

    return df.select(F.col(column).alias("_text")).mapInArrow(run, "id int").distinct()


@lru_cache(maxsize=1)
def _loaded(tokenizer_json: str):
    """One tokenizer a worker: one for each task would leave its pieces between those of the next."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores; threads would each hold memory of their own
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json)


def _steps(column: pa.Array) -> list[tuple[int, int]]:
    """Parts of a batch of STEP_BYTES of text."""
    step = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy()) // STEP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(column)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _encoded(tokenizer, column: pa.Array) -> list[np.ndarray]:
    """The ids of a step's texts. An encoding has a hundred bytes a token: those of a step only are held at a time."""
    texts = [t or "" for t in column.to_pylist()]
    return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def decoded_entries(ids: DataFrame, tokenizer_json: str) -> DataFrame:
    """(id, piece): entries of a vocabulary by number, decoded."""
    shared = ids.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        for batch in batches:
            pieces = tokenizer.decode_batch([[i] for i in batch.column(0).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.string())], names=["id", "piece"])

    return ids.select("id").mapInArrow(run, "id int, piece string")
