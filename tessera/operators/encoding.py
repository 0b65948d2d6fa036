"""Encoders of text as an iterator operator: one model a worker, batches by length, results in input order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Encoder = Callable[[list[str]], np.ndarray]


class OutOfMemory(Exception):
    """What an encoder raises for a batch that is too large for it."""


def batches_by_length(lengths: list[int], budget: int, most: int) -> list[list[int]]:
    """Places by rising length in batches of `most` at most whose padded size, items times the longest,
    stays in the budget; an item over it is alone. Equal lengths keep their order."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        size = -(-max(lengths[i], 1) // 8) * 8
        if out and len(out[-1]) < most and (len(out[-1]) + 1) * size <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def encoded(texts: list[str], encoder: Encoder, most: list[int], budget: int) -> np.ndarray:
    """A row for each text, in their order. A batch that is too large is halved, for good: `most` is
    kept by the worker; a single text that is too large is an error."""
    out, waiting = None, batches_by_length([len(t) for t in texts], budget, most[0])
    while waiting:
        places = waiting.pop(0)
        if len(places) > most[0]:
            waiting = [places[i : i + most[0]] for i in range(0, len(places), most[0])] + waiting
            continue
        try:
            made = encoder([texts[i] for i in places])
        except OutOfMemory:
            if len(places) == 1:
                raise
            most[0] = max(1, len(places) // 2)
            waiting.insert(0, places)
            continue
        if out is None:
            out = np.empty((len(texts), made.shape[1]), np.float32)
        out[places] = made
    return out if out is not None else np.empty((0, 0), np.float32)


def encode(df: DataFrame, make: Callable[[], Encoder], *, text_col: str = "text", result: str = "e", most: int = 64, budget: int = 16_384, owns_batching: bool = False) -> DataFrame:
    """df with `result`, its text's vector by make(), which each worker calls once. Null text is encoded as
    empty text. owns_batching: the encoder takes any number of texts and batches them itself."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, limit = None, [most]
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            if not texts:
                continue
            encoder = encoder or make()
            made = np.asarray(encoder(texts), np.float32) if owns_batching else encoded(texts, encoder, limit, budget)
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * made.shape[1])
            yield batch.append_column(result, pa.ListArray.from_arrays(ends, pa.array(made.ravel())))

    return df.mapInArrow(run, f"{fields}, `{result}` array<float>")


def hash_encoder(width: int = 8, too_many: int | None = None) -> Callable[[], Encoder]:
    """A stand-in for a model: unit vectors from a text's SHA-256; too_many: padded characters that it refuses."""

    def make() -> Encoder:
        def run(texts: list[str]) -> np.ndarray:
            if too_many and len(texts) * max(map(len, texts)) > too_many and len(texts) > 1:
                raise OutOfMemory
            raw = np.stack([np.frombuffer(hashlib.sha256(t.encode()).digest(), ">u2")[:width] for t in texts]).astype(np.float64) / 65_535 - 0.5
            return (raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))).astype(np.float32)

        return run

    return make
