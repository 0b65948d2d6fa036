"""Token windows and masked examples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays, draws, numbers, text

#: Windows that a task makes at a time.
STEP_WINDOWS = 1 << 14
#: Windows that a task masks at a time.
STEP_MASKED = 1 << 12
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def byte_windows(kept: DataFrame, length: int = 128, least: int = arrays.MIN_WINDOW) -> DataFrame:
    """(doc_idx, win_idx, ids): the framed windows of byte tokens; those of fewer tokens are dropped.

    A batch's bytes become ids in one step; a document of n bytes starts a window at every `body` bytes
    while `least` are left.
    """
    return _texts(kept).mapInArrow(_windowing(length, least), "doc_idx long, win_idx int, ids array<int>")


def _texts(kept: DataFrame) -> DataFrame:
    return kept.select("doc_idx", text.or_empty(F.col("text")).alias("text"))


def _windowing(length: int, least: int) -> Step:
    body = length - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            if not batch.num_rows:
                continue
            ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if ends[-1] else np.zeros(0, np.uint8)
            size = np.diff(ends)
            count = size // body + (size % body >= least)
            for first in range(0, int(count.sum()), STEP_WINDOWS):
                total = np.cumsum(count)
                number = np.arange(first, min(first + STEP_WINDOWS, int(total[-1])))
                row = np.searchsorted(total, number, "right")
                win = number - (total - count)[row]
                start = ends[row] + win * body
                filled = np.minimum(body, ends[row + 1] - start)
                place = np.arange(body)
                inside = place < filled[:, None]
                ids = np.full((len(number), length), arrays.PAD, dtype=np.int32)
                ids[:, 0] = arrays.CLS
                ids[:, 1 : length - 1][inside] = data[(start[:, None] + place)[inside]].astype(np.int32) + arrays.SPECIALS
                ids[np.arange(len(number)), filled + 1] = arrays.SEP
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, length, dtype=np.int32)), pa.array(ids.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(win.astype(np.int32)), lists], names=["doc_idx", "win_idx", "ids"])

    return run


def window_counts(n_tokens, length: int, least: int):
    """How many windows a document of n tokens gives: whole ones and a rest of `least` or more."""
    body = length - 2
    rest = (n_tokens % body >= least).cast("int")
    return (F.floor(n_tokens / body) + rest).cast("long")


def masked_examples(windows: DataFrame, length: int, share: float, seed: int, epoch: int = 0) -> DataFrame:
    """The five arrays of masked-language examples. Which ids are masked depends on the window, epoch
    and seed alone: the maskable ones of the least hash (`hashing.draw_key` of doc_idx, win_idx, place,
    epoch and seed), all replaced by the mask id. A task hashes STEP_MASKED windows at a time."""
    keys = windows.select(F.col("doc_idx").cast("long"), F.col("win_idx").cast("int"), F.col("ids").cast("array<int>"))
    return keys.mapInArrow(_masking(length, share, seed, epoch), _fields(()))


def masked_windows(kept: DataFrame, length: int, share: float, seed: int, epoch: int = 0, least: int = arrays.MIN_WINDOW, joined: Sequence[str] = ()) -> DataFrame:
    """masked_examples of byte_windows: a task cuts its texts and masks the windows, which go through no
    rows in between. The arrays named in `joined` come as text, as `arrays.joined` gives them."""
    windows, masked = _windowing(length, least), _masking(length, share, seed, epoch, joined)
    return _texts(kept).select(F.col("doc_idx").cast("long"), "text").mapInArrow(lambda batches: masked(windows(batches)), _fields(joined))


ARRAYS = {"input_ids": "int", "attention_mask": "int", "positions": "int", "targets": "int", "weights": "float"}


def _fields(joined: Sequence[str]) -> str:
    return ", ".join(["doc_idx long, win_idx int", *[f"{name} string" if name in joined else f"{name} array<{kind}>" for name, kind in ARRAYS.items()]])


def _masking(length: int, share: float, seed: int, epoch: int, joined: Sequence[str] = ()) -> Step:
    most = numbers.n_predictions(share, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, STEP_MASKED):
                part = batch.slice(first, STEP_MASKED)
                heads = [b"".join(b"%d|" % x for x in pair if x is not None) for pair in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                sizes = pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy()
                n, width = len(sizes), int(sizes.max())
                inside = np.arange(width) < sizes[:, None]
                ids = np.full((n, width), arrays.PAD, np.int32)
                ids[inside] = part.column(2).flatten().to_numpy()
                may = inside & (ids >= arrays.SPECIALS)
                tails = [b"%d|%d|%d" % (i, epoch, seed) for i in range(width)]
                key = np.where(may, draws.digests(heads, tails, 1)[0], np.uint32(2**32 - 1))
                able = may.sum(axis=1)
                count = np.where(able > 0, np.minimum(np.minimum(np.maximum(np.rint(able * share), 1), able), most), 0).astype(np.int32)
                ranked = np.sort(key, axis=1)
                last = np.take_along_axis(ranked, np.maximum(count - 1, 0)[:, None], axis=1) if width else key
                chosen = may & (key <= last)
                for row in np.flatnonzero(chosen.sum(axis=1) > count):  # the last is equal to others in 32 bits: by all of them
                    order = np.lexsort([*draws.digests([heads[row]], tails)[::-1, 0], ~may[row]])
                    chosen[row] = False
                    chosen[row, order[: count[row]]] = True
                row, place = np.nonzero(chosen)
                slots = np.arange(most) < count[:, None]
                positions, targets = np.zeros((2, n, most), np.int32)
                positions[slots], targets[slots] = place, ids[row, place]
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                filled = pa.array(np.arange(n + 1, dtype=np.int32) * most)
                lists = [(ends, np.where(chosen, np.int32(arrays.MASK), ids)[inside]), (ends, (ids[inside] != arrays.PAD).astype(np.int32)), (filled, positions.ravel()), (filled, targets.ravel()), (filled, slots.ravel().astype(np.float32))]
                made = [arrays.joined_lists(e, v) if name in joined else pa.ListArray.from_arrays(e, pa.array(v)) for name, (e, v) in zip(ARRAYS, lists, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_idx", "win_idx", *ARRAYS])

    return run


def token_bags(rows: DataFrame) -> DataFrame:
    """(item_id, token_id, n): how often each byte token stands in each text. A row's bytes are counted
    where they are; rows of the same item_id are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            if not batch.num_rows:
                continue
            ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            for first in range(0, len(column), 256):
                last = min(first + 256, len(column))
                data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[first] : ends[last]]
                owner = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
                counts = np.bincount(owner * 256 + data, minlength=(last - first) * 256)
                cell = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + cell // 256)), pa.array((cell % 256 + arrays.SPECIALS).astype(np.int32)), pa.array(counts[cell])], names=["item_id", "token_id", "n"])

    kind = rows.schema["item_id"].dataType.simpleString()
    each = rows.select("item_id", text.or_empty(F.col("text")).alias("text")).mapInArrow(run, f"item_id {kind}, token_id int, n long")
    return each.groupBy("item_id", "token_id").agg(F.sum("n").alias("n"))
