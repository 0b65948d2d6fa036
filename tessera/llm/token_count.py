"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast hash table of the corpus's frequent pre-tokens (runs between white space)
with their token counts; it is found by a heavy-hitter pass over all documents in which each task
passes on a bounded summary. Tier two is each worker's bounded cache; what both miss is encoded by
the tokenizer itself. Pre-tokens never cross the network, only the bounded summaries do. The tiers
change only the speed: a count is always the tokenizer's own.

This holds for tokenizers whose pre-tokenisation drops white space (so no token spans it) and whose
special strings hold no white space; `encode` of each run alone then gives the text's tokens. A model
for which it does not hold on the frequent runs is refused. Null
text counts as empty: 0 tokens. Each row gives one row, repeated rows included.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import steps

#: Python's split() also splits at these, which a regular expression's \s does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Rows of a task's summary, rows of the broadcast table, and runs a task tracks before it prunes.
SUMMARY, TABLE, TRACKED = 512, 16_384, 200_000


class Counts:
    """One worker's counter: text to the number of its tokens."""

    def __init__(self, model: str, frequent: dict[str, int], cache_size: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.frequent, self.cache, self.cache_size = frequent, dict(frequent), cache_size + len(frequent)

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> int:
        if ODD_SPACE.search(text):
            return self._encode([text])[0]
        words = text.split()
        found = list(map(self.cache.get, words))
        if None in found:
            missing = list(set(words).difference(self.cache))
            if len(self.cache) + len(missing) > self.cache_size:
                self.cache = dict(self.frequent)
                missing = list(set(words).difference(self.cache))
            self.cache.update(zip(missing, self._encode(missing), strict=True))
            found = map(self.cache.__getitem__, words)
        return sum(found)


def frequent_pretokens(df: DataFrame, text_col: str = "text", table: int = TABLE) -> list[str]:
    """The corpus's most frequent runs between white space: of each task's summary of SUMMARY
    runs at most, the `table` largest sums. All documents are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in steps(batches, "_text"):
            for text in batch.column(0).to_pylist():
                seen.update(text.split())
            if len(seen) > TRACKED:
                seen = Counter(dict(seen.most_common(TRACKED // 4)))
        top = seen.most_common(SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["run", "n"])

    found = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, "run string, n long")
    rows = found.groupBy("run").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "run").limit(table).collect()
    return [r.run for r in rows if len(r.run) <= 64]


def _refuse_spanning(encode: Counts, words: list[str]) -> None:
    """An error for a tokenizer to which white space between runs is more than a gap."""
    probe = words[:2_000] or ["a", "b."]
    alone = sum(encode._encode(probe))
    for space in (" ", "\n", "\t  "):
        if encode._encode([space + space.join(probe) + space])[0] != alone:
            raise ValueError("this tokenizer's tokens span white space: its runs cannot be counted one by one")


def count_tokens(df: DataFrame, model: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit). `model` is the
    tokenizer's JSON. Two scans, no shuffle of pre-tokens."""
    context = df.sparkSession.sparkContext
    words = frequent_pretokens(df, text_col)
    encode = Counts(model, {})
    _refuse_spanning(encode, words)
    shared = context.broadcast((model, {w: encode(w) for w in words}))  # TABLE rows of 64 letters at most
    slim = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    fields = f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counter = Counts(*shared.value)
        for batch in steps(batches, "_text"):
            n = [counter(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return slim.mapInArrow(run, fields)
