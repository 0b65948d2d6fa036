"""Calls of a service that limits and fails, as an iterator operator: back off, halve, skip, resume."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import store

Client = Callable[[list[tuple[int, str]], int], list[float]]


class Limited(Exception):
    """The service has had too many requests for now."""


class Failed(Exception):
    """The service could not take this batch."""


def backoff(tries: int) -> int:
    return min(60, 2**tries)


def call_all(items: list[tuple[int, str]], client: Client, size: int, retries: int, done: Callable[[list[tuple[int, str]]], list[float] | None], commit: Callable[[list[tuple[int, str]], list[float]], None]) -> tuple[list[tuple[int, float | None, str, int, int]], int]:
    """((item, result, outcome, batch size, seconds waited) of each item in order, calls made).

    A limited call waits and is made again, `retries` times at most since the last success; after that
    the rest is left ("stopped"). A failed batch is halved and tried again from the same item; a single item that
    fails is skipped. After any success or skip the size is whole again. A batch that `done` knows is not
    called again.
    """
    out, at, now, limited, waited, calls = [], 0, size, 0, 0, 0
    while at < len(items):
        batch = items[at : at + now]
        known = done(batch)
        if known is None:
            calls += 1
            try:
                known = client(batch, calls)
            except Limited:
                limited += 1
                if limited > retries:
                    out += [(i, None, "stopped", 0, waited) for i, _ in items[at:]]
                    break
                waited += backoff(limited)
                continue
            except Failed:
                if now > 1 and len(batch) > 1:
                    now = max(1, len(batch) // 2)
                    continue
                out.append((batch[0][0], None, "skipped", 1, waited))
                at, now = at + 1, size
                continue
            commit(batch, known)
        limited = 0
        out += [(i, x, "done", len(batch), waited) for (i, _), x in zip(batch, known, strict=True)]
        at, now = at + len(batch), size
    return out, calls


class Journal:
    """Finished batches as files of the shared folder, named by their items: a task that starts again
    finds what an earlier one has finished."""

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, batch: list[tuple[int, str]]) -> str:
        return f"{self.folder}/{hashlib.sha1(json.dumps(batch).encode()).hexdigest()}.json"

    def done(self, batch: list[tuple[int, str]]) -> list[float] | None:
        path = self._path(batch)
        if not store.exists(path):
            return None
        with store.open_input(path) as file:
            return json.loads(file.read())

    def commit(self, batch: list[tuple[int, str]], results: list[float]) -> None:
        with store.Output(self._path(batch)) as out:
            out.write(json.dumps(results).encode())


def called(rows: DataFrame, make: Callable[[], Client], folder: str, *, shard: str = "shard", size: int = 16, retries: int = 7) -> DataFrame:
    """(shard, item, result, outcome, size, waited) of rows (shard, item, text), a shard of bounded size after
    the other by item. Waiting is counted, and slept only by the client's own make."""
    order = rows.select(F.col(shard).cast("long").alias("shard"), F.col("item").cast("long").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    order = order.repartition("shard").sortWithinPartitions("shard", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, journal, held, items = make(), Journal(folder), None, []

        def finished():
            got, _ = call_all(items, client, size, retries, journal.done, journal.commit)
            columns = list(zip(*got, strict=True))
            kinds = (pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([held] * len(got), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["shard", "item", "result", "outcome", "size", "waited"])

        for batch in batches:
            for s, i, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if s != held and items:
                    yield finished()
                    items = []
                held = s
                items.append((i, t))
        if items:
            yield finished()

    return order.mapInArrow(run, "shard long, item long, result double, outcome string, size int, waited int")


def hash_client(limit_share: int = 2, fail_share: int = 23) -> Callable[[], Client]:
    """A stand-in for a service: the result is a text's length; calls are limited, and items fail,
    by hashes of what is sent."""

    def make() -> Client:
        seen: dict[str, int] = {}

        def run(batch: list[tuple[int, str]], call: int) -> list[float]:
            key = hashlib.sha1(json.dumps([i for i, _ in batch]).encode()).hexdigest()
            seen[key] = seen.get(key, 0) + 1
            if seen[key] <= int(key, 16) % limit_share:
                raise Limited
            if any(int(hashlib.sha1(str(i).encode()).hexdigest(), 16) % fail_share == 0 for i, _ in batch):
                raise Failed
            return [float(len(t)) for _, t in batch]

        return run

    return make
