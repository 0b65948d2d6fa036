"""Alignment of two tokenizers over a corpus: which tokens cover the same bytes, and how often.

A is a byte-level BPE of the `tokenizers` library, applied to a space and the text; B is a sentencepiece
model that adds this space itself. Where tokens of both end at one byte, the text is cut into groups;
a token of A and one of B are linked where their bytes overlap. A pair's count is the number of
documents (rows) that hold it linked.

1. Each task packs the linked pairs into int64 keys, A << 20 | B, and counts documents by key with
   np.unique; partial counts leave it in sorted blocks of bounded size, and each document's distinct
   keys go to a work table, so that texts are encoded once.
2. The partial counts are dealt to ranges of keys and sorted; equal keys are summed as runs. Each
   range is written as a shard of two sorted arrays to the shared folder.
3. Tasks over the documents' keys map the shards into memory and find them by searchsorted. (Where the
   shared folder is no mounted one, a shard is read through Arrow's file systems when first needed.)

Texts are handled in units: words with the space before them, marks after a word, line feeds. Neither
vocabulary has a token across such a cut (`Pair` checks both, and takes whole texts as units otherwise),
so a unit's tokens, groups and links do not depend on its neighbours. A text with other white space, or
with two such characters in a row, is cut at single spaces only. Units are kept in bounded caches of each worker.

Null and empty texts, and texts whose tokens' bytes are not a space and the text, have no tokens: zeros
and an empty groups_sha256. Repeated rows count as documents of their own. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import materialise, release, steps, work_path
from tessera.llm.sp_codec import byte_letters

#: Bits of a token id of B in a key; bits of a key.
B_BITS, KEY_BITS = 20, 40
CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space other than single spaces and line feeds between other characters.
LOOSE = re.compile(r"\s(?:\s|(?<![ \n])|$)")
LETTER, MARK = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
UNIT = re.compile(rf"\n| ?[{LETTER}]+(?=[\s{MARK}]|$)|[{MARK}]+(?=\s|$)| ?\S+")
#: A cut of UNIT within a token of B.
ACROSS = re.compile(rf"[{LETTER}][{MARK}]|\n.|.\n", re.DOTALL)
#: Units that are encoded as one text.
TOGETHER = 500
#: Keys that a task holds before it passes them on.
HELD = 1_000_000
SPACE_SIGN = "▁"


class Pair:
    """The two tokenizers of a worker, with the bytes of every token."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings are plain text
        # the space before the text is given to it, as units in mid-text have none or their own
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(b_model)
        normal = proto.normalizer_spec
        adds = normal.add_dummy_prefix and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap
        normal.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        if not adds:
            raise ValueError("a model that changes its text, or adds no space before it")
        byte = {x: i for i, x in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        if len(self.a_bytes) >> KEY_BITS - B_BITS or len(pieces) >> B_BITS:
            raise ValueError("a vocabulary of more than 2**20 tokens")
        rules = json.loads(a_json)
        steps_ = rules.get("pre_tokenizer") or {}
        plain = steps_.get("type") == "ByteLevel" and steps_.get("use_regex") and not steps_.get("add_prefix_space") and not rules.get("normalizer")
        plain = plain and all(" " not in t["content"] for t in rules.get("added_tokens") or [])
        spaced = [p for p in pieces if SPACE_SIGN in p.lstrip(SPACE_SIGN) or (p.startswith(SPACE_SIGN * 2) and p.strip(SPACE_SIGN))]
        self.cuts = bool(plain) and not spaced and not any(ACROSS.search(p) for p in pieces)

    def units(self, text: str) -> list[str]:
        """The units of a space and the text."""
        whole = " " + text
        if not self.cuts:
            return [whole]
        return CUT.split(whole) if text[:1].isspace() or LOOSE.search(text) else UNIT.findall(whole)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = []
        for i in range(0, len(texts), 64):  # its results hold much more than the ids
            a += [x.ids for x in self.a.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def gives_back(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = text.encode()
        return b"".join(map(self.b_bytes.__getitem__, b)) == whole == b"".join(map(self.a_bytes.__getitem__, a))


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by a sort, which is faster than its hash table here."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Units:
    """A worker's bounded cache of units: numbers of tokens, groups and links, spelled groups, keys."""

    def __init__(self, pair: Pair, size: int = 200_000):
        self.pair, self.size = pair, size
        self.lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in (pair.a_bytes, pair.b_bytes)]
        self.digits = [str(i) for i in range(max(map(len, self.lengths)))]
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        # has tokens, n_a, n_b, n_groups, n_links
        self.numbers, self.used = np.zeros((5, 1024), np.int64), 0
        self.keys, self.ends = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]

    def learn(self, wanted: set[str]) -> None:
        missing = wanted.difference(self.at)
        if len(self.at) + len(missing) > self.size and self.at:
            self._clear()
            missing = wanted
        if missing:
            self._add(list(missing))

    def _encoded(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[int], list[int]]:
        """(units in the order taken, which have tokens, their bytes, tokens of A and of B in a row).
        Words after a space are encoded many at a time."""
        pair = self.pair
        words = [u for u in units if u[:1] == " " and u.split() == [u[1:]]] if pair.cuts else []
        joined = set(words)
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)] + [[u] for u in units if u not in joined]
        order, good, fa, fb = [], [], [], []
        while parts:
            texts = ["".join(p) for p in parts]
            again = []
            for part, text, a, b in zip(parts, texts, *pair.encode(texts), strict=True):
                if pair.gives_back(text, a, b):
                    order.extend(part)
                    good += [True] * len(part)
                    fa.extend(a)
                    fb.extend(b)
                elif len(part) > 1:
                    again += [[u] for u in part]
                else:  # a unit that one of them does not give back has no tokens
                    order.extend(part)
                    good.append(False)
            parts = again
        good = np.array(good, bool)
        sizes = np.fromiter((len(u.encode()) for u in order), np.int64, len(order)) * good
        return order, good, sizes, fa, fb

    def _add(self, units: list[str]) -> None:
        n = len(units)
        units, good, sizes, fa, fb = self._encoded(units)
        fa, fb = np.array(fa, np.int64), np.array(fb, np.int64)
        ends_a, ends_b = np.cumsum(self.lengths[0][fa]), np.cumsum(self.lengths[1][fb])
        bounds = _distinct(np.concatenate([ends_a, ends_b]))
        keys = fa[np.searchsorted(ends_a, bounds)] << B_BITS | fb[np.searchsorted(ends_b, bounds)]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        unit_end = np.concatenate([[0], np.cumsum(sizes)])  # bytes before each unit, and in all
        na, nb, n_groups, n_links = (np.diff(np.searchsorted(x, unit_end, "right")) for x in (ends_a, ends_b, common, bounds))
        grown = self.used + n
        if grown > self.numbers.shape[1]:
            self.numbers = np.concatenate([self.numbers, np.zeros((5, grown), np.int64)], axis=1)
        block = self.numbers[:, self.used : grown]
        block[0], block[1], block[2], block[3], block[4] = good, na, nb, n_groups, n_links
        self.keys.append(keys)
        self.ends.append(self.ends[-1][-1] + np.cumsum(n_links))
        self.groups += self._spelled(fa, fb, ends_a, ends_b, common, n_groups)
        self.at.update(zip(units, range(self.used, grown), strict=True))
        self.used = grown

    def _spelled(self, fa, fb, ends_a, ends_b, common, n_groups) -> list[str]:
        digits = self.digits
        da, db = [digits[i] for i in fa.tolist()], [digits[i] for i in fb.tolist()]
        ca, cb = (np.searchsorted(ends_a, common) + 1).tolist(), (np.searchsorted(ends_b, common) + 1).tolist()
        parts, i, j = [], 0, 0
        for k, m in zip(ca, cb, strict=True):
            parts.append((da[i] if k == i + 1 else ",".join(da[i:k])) + "|" + (db[j] if m == j + 1 else ",".join(db[j:m])))
            i, j = k, m
        out, i = [], 0
        for n in n_groups.tolist():
            out.append(parts[i] if n == 1 else ";".join(parts[i : i + n]))
            i += n
        return out

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of units of each text, the units' places in the cache, text after text)."""
        cut = [self.pair.units(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        return n, np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))

    def sums(self, n: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The numbers of each text, zeros for one that holds a unit without tokens."""
        total = np.concatenate([np.zeros((5, 1), np.int64), np.cumsum(self.numbers[:, places], axis=1)], axis=1)
        ends = np.concatenate([[0], np.cumsum(n)])
        sums = np.diff(total[:, ends], axis=1)
        sums[0] = (sums[0] == n) & (n > 0)
        return sums * sums[0]

    def keys_of(self, good: np.ndarray, n: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, key, number of links) of each distinct key of the good texts, text after text."""
        owner, some = np.repeat(np.arange(len(n)), n), np.repeat(good, n)
        pairs, times = np.unique(owner[some] * self.used + places[some], return_counts=True)
        owner, unit = pairs // self.used, pairs % self.used
        self.keys, self.ends = [np.concatenate(self.keys)], [np.concatenate(self.ends)]
        ends = self.ends[0]
        starts, size = ends[unit], ends[unit + 1] - ends[unit]
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        both = np.repeat(owner, size) << KEY_BITS | self.keys[0][at]
        order = np.argsort(both)
        both, times = both[order], np.repeat(times, size)[order]
        if not len(both):
            return both, both, both
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        return both[first] >> KEY_BITS, both[first] & ((1 << KEY_BITS) - 1), np.add.reduceat(times, first)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(back, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


NAMES = ["n_a", "n_b", "n_groups", "n_links"]


def _encoded_rows(texts: DataFrame, shared, held: int, with_groups: bool) -> DataFrame:
    """A row for each text, with its numbers and distinct keys, and rows of partial counts (pair, n)."""
    kind = texts.schema["_id"].dataType.simpleString()
    fields = f"_id {kind}, {', '.join(f'{n} long' for n in NAMES)}, sha string, groups string, keys array<long>, times array<long>, pair long, n long"
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def rows(size: int, **columns) -> pa.RecordBatch:
        arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(Pair(*shared.value))
        keys, counts, size = [], [], 0

        def block(k, c):
            for i in range(0, len(k), 100_000):
                part = k[i : i + 100_000]
                yield rows(len(part), pair=pa.array(part), n=pa.array(c[i : i + 100_000]))

        for batch in steps(batches, "_text", 2 << 20):
            m = batch.num_rows
            n, places = units.of(batch.column(1).to_pylist())
            sums = units.sums(n, places)
            good = sums[0] > 0
            spelled, start, all_groups, listed = [], 0, units.groups, places.tolist()
            for ok, k in zip(good.tolist(), n.tolist(), strict=True):
                spelled.append(";".join([all_groups[p] for p in listed[start : start + k]]) if ok else "")
                start += k
            owner, key, times = units.keys_of(good, n, places)
            ends = pa.array(np.searchsorted(owner, np.arange(m + 1)), pa.int32())
            columns = dict(zip(NAMES, map(pa.array, sums[1:]), strict=True))
            columns["sha"] = pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in spelled], pa.string())
            columns |= {"keys": pa.ListArray.from_arrays(ends, pa.array(key)), "times": pa.ListArray.from_arrays(ends, pa.array(times))}
            if with_groups:
                columns["groups"] = pa.array(spelled, pa.string())
            yield rows(m, _id=batch.column(0), **columns)
            k, c = np.unique(key, return_counts=True)
            keys, counts, size = [*keys, k], [*counts, c], size + len(k)
            if size > held:
                k, c = _merged(keys, counts)
                keys, counts, size = [k], [c], len(k)
                if size > held // 2:
                    yield from block(k, c)
                    keys, counts, size = [], [], 0
        if keys:
            yield from block(*_merged(keys, counts))

    return texts.mapInArrow(run, fields)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Equal neighbouring keys of sorted batches summed, across batches too."""
    key, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pair, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        keys, sums = pair[at], np.add.reduceat(n, at)
        if key is not None:
            if keys[0] == key:
                sums[0] += held
            else:
                keys, sums = np.concatenate([[key], keys]), np.concatenate([[held], sums])
        key, held = keys[-1], sums[-1]
        yield keys[:-1], sums[:-1]
    if key is not None:
        yield np.array([key], np.int64), np.array([held], np.int64)


def _write(folder: str, name: str, array: np.ndarray) -> str:
    """An array as a file of the shared folder, whole or not at all; a task run twice writes it twice."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        os.makedirs(url.path, exist_ok=True)
        path, draft = os.path.join(url.path, name), os.path.join(url.path, f".{uuid.uuid4().hex}")
        with open(draft, "wb") as file:
            np.save(file, array)
        os.replace(draft, path)
        return path
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    raw = io.BytesIO()
    np.save(raw, array)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/{name}") as file:
        file.write(raw.getvalue())
    return f"{folder}/{name}"


def _read(path: str) -> np.ndarray:
    if "://" not in path:
        return np.load(path, mmap_mode="r")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as file:
        return np.load(io.BytesIO(file.read()))


class Shards:
    """Counts by key from sorted shards, each mapped into memory when first asked."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        rows = sorted(rows)
        self.first = np.array([r[0] for r in rows], np.int64)
        self.paths = [r[1:] for r in rows]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """keys: sorted. 0 for one that no shard has."""
        out = np.zeros(len(keys), np.int64)
        cut = np.searchsorted(keys, self.first)
        for i, (start, stop) in enumerate(zip(cut, [*cut[1:], len(keys)], strict=True)):
            if start < stop:
                if i not in self.open:
                    self.open[i] = tuple(map(_read, self.paths[i]))
                pairs, counts = self.open[i]
                at = np.minimum(np.searchsorted(pairs, keys[start:stop]), len(pairs) - 1)
                out[start:stop] = np.where(pairs[at] == keys[start:stop], counts[at], 0)
        return out


def _encoded(df: DataFrame, a_json: str, b_model: bytes, id_col: str, text_col: str, held: int = HELD, with_groups: bool = False) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((a_json, b_model))  # bounded by the vocabulary files
    return materialise(_encoded_rows(_texts(df, id_col, text_col), shared, held, with_groups), "encoded")


def _in_order(encoded: DataFrame) -> DataFrame:
    parts = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return encoded.where("pair is not null").select("pair", "n").repartitionByRange(parts, "pair").sortWithinPartitions("pair")


def pair_counts(df: DataFrame, a_json: str, b_model: bytes, *, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """(a, b, n): the number of documents that hold tokens a and b linked, for each pair that any holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sums in _runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array((keys >> B_BITS).astype(np.int32)), pa.array((keys & ((1 << B_BITS) - 1)).astype(np.int32)), pa.array(sums)], names=["a", "b", "n"])

    return _in_order(_encoded(df, a_json, b_model, id_col, text_col, held)).mapInArrow(run, "a int, b int, n long")


def _shards(encoded: DataFrame) -> tuple[list[tuple[int, str, str]], np.ndarray]:
    """The written shards and the highest count of each A id."""
    folder = work_path(encoded.sparkSession, "pair-shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(_runs(batches))  # a range of the distinct pairs, 16 bytes each
        if not found:
            return
        pairs, counts = np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])
        paths = [_write(folder, f"{int(pairs[0])}.{kind}.npy", x) for kind, x in (("pairs", pairs), ("counts", counts))]
        a = pairs >> B_BITS
        at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        fields = [pa.array(a[at]), pa.array(np.maximum.reduceat(counts, at)), pa.array([int(pairs[0])] + [None] * (len(at) - 1), pa.int64())]
        fields += [pa.array([p] + [None] * (len(at) - 1), pa.string()) for p in paths]
        yield pa.RecordBatch.from_arrays(fields, names=["a", "best", "first", "pairs", "counts"])

    written = materialise(_in_order(encoded).mapInArrow(run, "a long, best long, first long, pairs string, counts string"), "shards")
    rows = [(r["first"], r.pairs, r.counts) for r in written.where("first is not null").select("first", "pairs", "counts").collect()]  # one a range
    best = written.groupBy("a").agg(F.max("best").alias("best")).collect()  # one a token of A's vocabulary
    top = np.zeros(max((r.a for r in best), default=0) + 1, np.int64)
    for r in best:
        top[r.a] = r.best
    release(written)
    return rows, top


def align(df: DataFrame, a_json: str, b_model: bytes, *, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Each row's n_a, n_b, n_groups, n_links, n_best (links whose count is their A id's highest), count_sum
    (over links) and groups_sha256 (of `a1,a2|b1;a3|b2,b3`); with_groups adds that text. Texts are
    encoded once and never shuffled."""
    encoded = _encoded(df, a_json, b_model, id_col, text_col, with_groups=with_groups)
    rows, top = _shards(encoded)
    best = df.sparkSession.sparkContext.broadcast(top)  # a number a token of A
    docs = encoded.where("pair is null").select("_id", *NAMES, "sha", "keys", "times", *["groups"] * with_groups)
    fields = f"`{id_col}` {docs.schema['_id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in NAMES)}, groups_sha256 string, n_best long, count_sum long" + ", groups string" * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(rows)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ends = batch.column(6).flatten().to_numpy(), batch.column(6).offsets.to_numpy()
            times = batch.column(7).flatten().to_numpy()
            found, back = np.unique(keys, return_inverse=True)
            counts = shards(found)
            is_best = counts == best.value[found >> B_BITS]
            sums = []
            for values in (is_best, counts):
                total = np.concatenate([[0], np.cumsum(values[back] * times)])
                sums.append(pa.array(np.diff(total[ends - ends[0]])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *sums, *batch.columns[8:]], names=[id_col, *NAMES, "groups_sha256", "n_best", "count_sum", *["groups"] * with_groups])

    return docs.mapInArrow(run, fields)
