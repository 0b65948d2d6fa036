"""Removal of repeated token windows by Rabin-Karp hashes counted in Spark.

Words are runs of bytes other than ASCII white space, a window is `size` consecutive words of one
document. A word goes if some window that covers it has a word sequence that also starts earlier
(smaller doc_id, or the same document and an earlier start); all windows are judged on the input.
Covered words of overlapping windows merge into maximal intervals.

1. Texts of equal words are one unit; its first document keeps them, in the others every window
   started earlier. Units are numbered in the order of their first documents.
2. Every window holds one anchor: the run of ANCHOR words with the least Rabin-Karp hash, leftmost.
   Equal windows have equal anchors, so a window whose anchor occurs once in the corpus is unique.
   Anchors, about a sixth of all positions, are counted in Spark.
3. The windows with repeated anchors are hashed (two Rabin-Karp hashes of 64 bits, of words hashed
   twice and independently) and grouped in Spark to the least (unit, position): those stay, all other
   repeated windows are removed. Of n different windows two share all 128 bits with a probability of
   about n * n / 2**129: 1e-13 for 1e13 windows, some 100 TB of text.

No step sends a group of equal keys to one task: each aggregate combines on the map side, and the
joins can be split by Spark. Texts travel once, compressed. Null text has no words, a null doc_id
comes before all others; rows with equal doc_id and equal words do not precede one another, those of
equal doc_id and other words do so in the order of their words' digests. Extra columns are ignored. Every row gives one row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dealt_join, key_filter, materialise, may_be_in, steps
from tessera.llm.words import GOLDEN, U64, Words, mix, polynomial, sliding_argmin, starts_within

SIZE = 20
#: Words of an anchor.
ANCHOR = 8
#: Places of an anchor from which it is dealt to several tasks; bits of the filter of repeated anchors.
HOT, FILTER_BITS = 2_000, 24
NO_WORDS = hashlib.sha256(b"").hexdigest()


def windows(words: Words, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, row, anchor's first word, anchor's hash) of each window."""
    start = starts_within(words.first, size)
    if not len(start):
        return start, start, start, np.zeros(0, U64)
    hashes = polynomial(words.hash, anchor)
    at = sliding_argmin(hashes, size - anchor + 1)[start]
    return start, np.searchsorted(words.first, start, "right") - 1, at, hashes[at]


def _keys(texts: list[str]) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    joined = [b" ".join(t.encode().split()) for t in texts]
    digests = [hashlib.sha256(j).digest() for j in joined]
    return joined, np.frombuffer(b"".join(d[:16] for d in digests), dtype="<i8").reshape(-1, 2), digests


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def _units(texts: DataFrame, spark) -> tuple[DataFrame, int, int]:
    """(k1, k2, ord, unit, copies) of each distinct word sequence, unit rising with ord, and the bits of a position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "_text"):
            joined, keys, _ = _keys(batch.column(1).to_pylist())
            n = [j.count(b" ") + 1 if j else 0 for j in joined]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n, pa.int32())], names=["_id", "k1", "k2", "n"])

    slim = texts.mapInArrow(run, f"_id {texts.schema['_id'].dataType.simpleString()}, k1 long, k2 long, n int")
    low = F.lit(-(2**63)).cast("long")
    found = slim.groupBy("k1", "k2").agg(F.min(F.coalesce(F.col("_id").cast("long"), low)).alias("ord"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    found = materialise(found, "units")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = found.repartitionByRange(parts, "ord").sortWithinPartitions("ord", "k1", "k2").withColumn("_m", F.monotonically_increasing_id())
    placed = materialise(placed, "units-in-order")
    index = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    most = placed.agg(F.max(F.shiftright("_m", 33)), F.max(index), F.max("n")).first()
    part_bits, index_bits, position_bits = (int(x or 0).bit_length() for x in most)
    if part_bits + index_bits + position_bits > 62:
        raise ValueError("more documents and words than 62 bits can number")
    unit = F.shiftleft(F.shiftright("_m", 33), index_bits).bitwiseOR(index)
    return placed.select("k1", "k2", "ord", unit.alias("unit"), "copies"), position_bits


def _anchors(texts: DataFrame, size: int, anchor: int) -> DataFrame:
    """(anchor, short): the hash of each anchor of each document with 48 bits of the key of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "_text"):
            words = Words(batch.column(1))
            _, row, at, hashes = windows(words, size, anchor)
            if not len(row):
                continue
            change = np.concatenate([[True], at[1:] != at[:-1]])
            row, hashes = row[change], hashes[change]
            _, keys, _ = _keys(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(keys[row, 0] & ((1 << 48) - 1))], names=["anchor", "short"])

    return texts.mapInArrow(run, "anchor long, short long")


def _flagged(batch_sets: pa.Array, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which (row, hash) are in their row's set."""
    counts = np.diff(batch_sets.offsets.to_numpy())
    owner = np.repeat(np.arange(len(counts)), counts)
    listed = batch_sets.flatten().to_numpy(zero_copy_only=False).view(U64)
    return np.isin(mix(hashes + row.astype(U64) * GOLDEN), mix(listed + owner.astype(U64) * GOLDEN))


def _unpacked(column: pa.Array) -> tuple[list[bytes], Words]:
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [unpack(x) for x in column.to_pylist()]
    return raw, Words(pa.array(raw, pa.large_binary()).cast(pa.large_string()))


def remove_repeats(df: DataFrame, *, size: int = SIZE, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Each row's n_words, n_removed and kept_sha256 (kept words joined by a space); with_text adds kept_text."""
    if not 0 < anchor <= size:
        raise ValueError("an anchor has 1 to `size` words")
    spark = df.sparkSession
    texts = _texts(df, id_col, text_col)
    units, shift = _units(texts, spark)

    anchors = _anchors(texts, size, anchor)
    repeated = materialise(anchors.groupBy("anchor").count().where("count > 1"), "repeated-anchors")
    # only anchors that a filter of the repeated ones lets through are dealt out; very common ones to many tasks
    keys = repeated.select("anchor")
    some = anchors.where(may_be_in(F.col("anchor"), key_filter(keys, FILTER_BITS), FILTER_BITS))
    found = dealt_join(some, keys, ["anchor"], repeated.where(F.col("count") >= HOT).select("anchor"), "short")
    marks = found.groupBy("short").agg(F.collect_set("anchor").alias("marks"))
    short = F.col("k1").bitwiseAND(F.lit((1 << 48) - 1))
    info = units.withColumn("short", short).join(marks, "short", "left").select("short", "k1", "k2", "ord", "unit", "marks")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in steps(batches, "_text"):
            joined, keys, digests = _keys(batch.column(1).to_pylist())
            n = [j.count(b" ") + 1 if j else 0 for j in joined]
            arrays = [batch.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(keys[:, 0] & ((1 << 48) - 1)), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array([squeeze(j) for j in joined], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "k1", "k2", "short", "n_words", "sha", "packed"])

    kind = texts.schema["_id"].dataType.simpleString()
    packed = texts.mapInArrow(pack, f"_id {kind}, k1 long, k2 long, short long, n_words long, sha binary, packed binary")
    # all copies of one text meet its row: those of a text with very many are dealt to several tasks
    many = units.where(F.col("copies") >= HOT).select(short.alias("short"))
    packed = packed.withColumn("_deal", F.monotonically_increasing_id())
    both = dealt_join(packed, info, ["short", "k1", "k2"], many, "_deal")
    low = F.lit(-(2**63)).cast("long")
    first = F.coalesce(F.col("_id").cast("long"), low) == F.col("ord")
    judge = first & F.col("marks").isNotNull() & (F.col("n_words") >= size)
    need = (judge | F.lit(with_text)) if with_text else judge
    both = both.select("_id", "n_words", "sha", "unit", first.alias("first"), judge.alias("judge"), F.when(judge, F.col("marks")).alias("marks"), F.when(need, F.col("packed")).alias("packed"))
    both = materialise(both, "judged")

    gone = ~F.col("first") & (F.col("n_words") >= size)
    direct = both.where(~F.col("judge")).select(
        F.col("_id").alias(id_col),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(gone, F.lit(NO_WORDS)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
        *([F.when(~gone, F.col("packed")).alias("_packed")] if with_text else []),
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "packed", 1 << 20):
            _, words = _unpacked(batch.column(2))
            start, row, _, hashes = windows(words, size, anchor)
            some = _flagged(batch.column(1), row, hashes)
            start, row = start[some], row[some]
            if not len(start):
                continue
            h1 = polynomial(words.hash, size)[start].view(np.int64)
            h2 = polynomial(words.again(1), size, 1)[start].view(np.int64)
            place = (batch.column(0).to_numpy()[row] << shift) | (start - words.first[row])
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(place)], names=["h1", "h2", "place"])

    judged = both.where("judge")
    least = judged.select("unit", "marks", "packed").mapInArrow(hashed, "h1 long, h2 long, place long").groupBy("h1", "h2").agg(F.min("place").alias("place"))
    stay = least.select(F.shiftright("place", shift).alias("unit"), F.col("place").bitwiseAND(F.lit((1 << shift) - 1)).cast("int").alias("p"))
    stay = stay.groupBy("unit").agg(F.collect_list("p").alias("stay"))
    last = judged.join(stay, "unit", "left").select("_id", "n_words", "marks", "packed", F.coalesce("stay", F.array().cast("array<int>")).alias("stay"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in steps(batches, "packed", 1 << 20):
            raw, words = _unpacked(batch.column(3))
            start, row, _, hashes = windows(words, size, anchor)
            some = _flagged(batch.column(2), row, hashes)
            starts = batch.column(4)
            counts = np.diff(starts.offsets.to_numpy())
            kept = np.repeat(words.first[:-1], counts) + starts.flatten().to_numpy(zero_copy_only=False)
            goes = np.zeros(len(words) + 1, dtype=bool)
            goes[start[some]] = True
            goes[kept] = False
            edge = np.zeros(len(words) + size + 1, dtype=np.int64)
            edge[np.flatnonzero(goes)] += 1
            edge[np.flatnonzero(goes) + size] -= 1
            covered = np.cumsum(edge)[: len(words)] > 0
            removed, shas, left = [], [], []
            for i, text in enumerate(raw):
                a, b = words.first[i], words.first[i + 1]
                mask = covered[a:b]
                n = int(mask.sum())
                removed.append(n)
                if n:
                    pieces = text.split()
                    text = b" ".join([pieces[k] for k in np.flatnonzero(~mask)])
                shas.append(hashlib.sha256(text).hexdigest())
                left.append(squeeze(text) if with_text else b"")
            arrays = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas)]
            names = [id_col, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(left, pa.binary()))
                names.append("_packed")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", _packed binary" * with_text
    out = direct.unionByName(last.mapInArrow(cut, fields))
    return _with_text(out) if with_text else out


def _with_text(out: DataFrame) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor().decompress
        for batch in steps(batches, "_packed", 1 << 20):
            texts = [None if x is None else loose(x).decode() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(["" if t is None else t for t in texts], pa.string())], names=[*batch.schema.names[:4], "kept_text"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:4])
    return out.mapInArrow(unpack, f"{head}, kept_text string")
