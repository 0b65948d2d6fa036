"""Near-duplicate classes by DartMinHash signatures of weighted word shingles and a banded join.

A document is the multiset of its runs of SHINGLE words (A-Z folded to lower case; a document of
fewer words is one shingle). Darts are hashed points of each element's weight-by-rank region: the
process of an element does not depend on the document, a document takes the darts under its weights
and up to a rank that gives about K ln K + 2 K darts in all, and keeps the earliest for each of the
K coordinates. Two documents agree in a coordinate with the probability of their weighted Jaccard
similarity. Signatures are cut into BANDS bands; documents that share a band are a bucket.

Links are pairs of similarity 0.8 or more (weighted Jaccard of the shingles, from the whole texts);
classes are the components of the links. No pair is ever a row. A bucket is dealt into blocks of at most
about BLOCK documents and BLOCK_MASS shingles; a task has the texts of one block and gets all its
similarities from an inverted list of its shingles. It returns a forest of the links, one row a
document at most. Buckets with the same members are compared once. Then, in buckets of several blocks
that hold several classes, the documents outside the bucket's largest class are shown to the
other blocks. So each pair of a bucket is compared or lies in one class: no link between different
candidates is lost. The work beyond a linear pass is that of documents that are like many others
and linked to few, and it is done in blocks of bounded size.

Copies of the same words are one unit from the start. Null and empty texts are copies of each other.
The document with the least id of a class stays (null last; among equal ids one row). Extra columns
are ignored. Every row gives one row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dealt_join, fresh, key_filter, materialise, may_be_in, release, steps, without
from tessera.llm.graph import components
from tessera.llm.words import GOLDEN, U64, Words, mix, polynomial, starts_within

SHINGLE, THRESHOLD = 5, 0.8
#: 30 bands of 5 coordinates: a pair of similarity 0.8 is missed with probability 7e-6.
BANDS, ROWS = 30, 5
K = BANDS * ROWS
#: Documents and shingles of a block, about. They bound a task's memory; every pair of a bucket is met all the same.
BLOCK, BLOCK_MASS = 256, 1 << 18
#: Rows of a class from which it is dealt to several tasks.
HOT = 500


def uniform(x: np.ndarray) -> np.ndarray:
    """A number over 0 and up to 1 from the high bits of each hash."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_minhash(element: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int, k: int = K, seed: int = 1) -> np.ndarray:
    """(rows, k) signatures of weighted sets: element hash, weight over 0 and row of each entry.

    An entry of weight w has unit cells up to w on its weight axis, the last one cut at w; along each
    cell darts follow one another in rank by exponential gaps. Rows without entries get zeros.
    """
    weight = weight.astype(np.float64)
    mass = np.bincount(row, weights=weight, minlength=rows)
    levels = np.ceil(weight).astype(np.int64)
    entry = np.repeat(np.arange(len(element)), levels)
    level = np.arange(len(entry)) - np.repeat(np.cumsum(levels) - levels, levels)
    cell = mix(element[entry] + (level + 1).astype(U64) * GOLDEN + U64(seed * 0xD6E8FEB86659FD93 % 2**64))
    room = np.minimum(weight[entry] - level, 1.0)
    owner = row[entry]
    signature = np.zeros((rows, k), dtype=U64)
    todo = mass > 0
    darts = k * math.log(k) + 2 * k
    while todo.any():
        limit = np.where(todo, darts / np.where(mass > 0, mass, 1.0), 0.0)
        best = np.full(rows * k, np.inf)
        which = np.flatnonzero(todo[owner])
        rank = np.zeros(len(which))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        turn = 0
        while len(which):
            turn += 1
            dart = mix(cell[which] + U64(turn * 0xA0761D6478BD642F % 2**64))
            rank = rank - np.log(uniform(dart))
            under = rank < limit[owner[which]]
            which, rank, dart = which[under], rank[under], dart[under]
            inside = uniform(mix(dart + GOLDEN)) <= room[which]
            place = owner[which][inside] * k + (mix(dart[inside] ^ GOLDEN) % U64(k)).astype(np.int64)
            np.minimum.at(best, place, rank[inside])
            found.append((place, rank[inside], dart[inside]))
        for place, rank, dart in found:
            first = rank == best[place]
            signature.reshape(-1)[place[first]] = dart[first]
        full = np.isfinite(best).reshape(rows, k).all(axis=1)
        todo &= ~full  # a row with an empty coordinate is thrown again, to twice the rank
        darts *= 2
    return signature


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, row) of the distinct shingles of each row, by row and hash."""
    start = starts_within(words.first, size)
    hashes = polynomial(words.hash, size)[start] if len(start) else np.zeros(0, U64)
    row = np.searchsorted(words.first, start, "right") - 1
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        alone = [polynomial(words.hash[words.first[i] : words.first[i + 1]], int(count[i]))[0] for i in short]
        hashes, row = np.concatenate([hashes, np.array(alone, dtype=U64)]), np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    if not len(row):
        return hashes, row, row
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]))
    return hashes[new], np.diff(np.append(new, len(row))), row[new]


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(rows, bands): one hash for the coordinates of each band."""
    rows, k = signature.shape
    parts = signature.reshape(rows, bands, k // bands)
    out = np.broadcast_to((np.arange(1, bands + 1).astype(U64) * GOLDEN), (rows, bands)).copy()
    for i in range(k // bands):
        out = mix((out ^ parts[:, :, i]) + GOLDEN)
    return out


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n items' component, for links a[i], b[i]."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_within(hashes: np.ndarray, count: np.ndarray, row: np.ndarray, group: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j), i < j, of rows of the same group with a similarity of `threshold` or more.

    Entries (hash, count, row) are those of shingles(); group[r] is the group of row r, ascending.
    Equal shingles of a group stand together once sorted, by row; their d-th neighbours are added up.
    """
    n = len(group)
    mass = np.bincount(row, weights=count, minlength=n)
    first = np.searchsorted(group, group, "left")
    size = np.searchsorted(group, group, "right") - first
    # the cell of rows i and j of a group: base[i] + (place of j)
    base = np.cumsum(size) - size
    key = mix(hashes ^ mix(group[row].astype(U64) + GOLDEN))
    order = np.argsort(key, kind="stable")
    key, at, weight = key[order], row[order], count[order]
    common = np.zeros(int(size.sum()))
    here, step = np.arange(len(key)), 0
    while True:
        step += 1
        here = here[here + step < len(key)]
        here = here[key[here + step] == key[here]]
        if not len(here):
            break
        i, j = at[here], at[here + step]
        np.add.at(common, base[i] + j - first[i], np.minimum(weight[here], weight[here + step]))
    cell = np.flatnonzero(common)
    i = np.searchsorted(base, cell, "right") - 1
    j = first[i] + cell - base[i]
    near = common[cell] >= threshold * (mass[i] + mass[j] - common[cell])
    return i[near], j[near]


class Shown:
    """A block of documents that others are compared with."""

    def __init__(self, hashes: np.ndarray, count: np.ndarray, row: np.ndarray, rows: int):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.count, self.row, self.rows = hashes[order], count[order], row[order], rows
        self.mass = np.bincount(row, weights=count, minlength=rows)

    def near(self, hashes: np.ndarray, count: np.ndarray, row: np.ndarray, rows: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (other, member) with a similarity of `threshold` or more."""
        low = np.searchsorted(self.hashes, hashes, "left")
        many = np.searchsorted(self.hashes, hashes, "right") - low
        common = np.zeros(rows * self.rows)
        ends = np.cumsum(many)
        start = 0
        while start < len(many):  # some millions of matches at a time
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 21), "right")))
            some = many[start:stop]
            entry = np.repeat(np.arange(start, stop), some)
            place = np.arange(len(entry)) - np.repeat(np.cumsum(some) - some, some) + low[entry]
            np.add.at(common, row[entry] * self.rows + self.row[place], np.minimum(count[entry], self.count[place]))
            start = stop
        mass = np.bincount(row, weights=count, minlength=rows)
        cell = np.flatnonzero(common)
        i, j = np.divmod(cell, self.rows)
        near = common[cell] >= threshold * (mass[i] + self.mass[j] - common[cell])
        return i[near], j[near]


def _normal(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())  # bytes.lower() folds A-Z only


def _shingles_of(packed: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return shingles(Words(pa.array([unpack(x) for x in packed.to_pylist()], pa.large_binary()).cast(pa.large_string())), size)


def _signed(df: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """_id, _row, the digest k1, k2 of each text's words, the words packed, their shingles' number and bands."""
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in steps(batches, "_text", 1 << 19):
            normal = [_normal(t) for t in batch.column(1).to_pylist()]
            keys = np.frombuffer(b"".join(hashlib.sha256(x).digest()[:16] for x in normal), dtype="<i8").reshape(-1, 2)
            hashes, count, row = shingles(Words(pa.array(normal, pa.large_binary()).cast(pa.large_string())), size)
            mass = np.bincount(row, weights=count, minlength=len(normal)).astype(np.int64)
            some = np.flatnonzero(mass)  # rows with words
            found = np.zeros(0, np.int64)
            if len(some):
                found = band_hashes(dart_minhash(hashes, count, np.searchsorted(some, row), len(some), bands * rows), bands).reshape(-1).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(mass > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([squeeze(x) for x in normal], pa.binary()), pa.array(mass), lists], names=["_id", "k1", "k2", "packed", "mass", "bands"])

    out = texts.mapInArrow(run, f"_id {kind}, k1 long, k2 long, packed binary, mass long, bands array<long>")
    return materialise(out.withColumn("_row", F.monotonically_increasing_id()), "near-rows")


def _placed(units: DataFrame) -> DataFrame:
    """(bucket, unit, block, blocks): the members of each bucket of several units; of buckets with the same
    members one."""
    buckets = units.select("unit", "mass", F.explode("bands").alias("bucket"))
    marks = [F.bit_xor(F.xxhash64("unit", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    several = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("m"), *marks).where("n > 1")
    sets = several.groupBy("n", "m", "x1", "x2").agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.ceil(F.col("m") / BLOCK_MASS), F.floor(F.col("n") / 4)), F.lit(1)).cast("long")
    sets = materialise(sets.select("bucket", blocks.alias("blocks")), "near-buckets")
    # most buckets have one member; only what a filter of the others lets through is dealt out again
    members = buckets.where(may_be_in(F.col("bucket"), key_filter(sets.select("bucket")))).join(sets, "bucket")
    members = materialise(members.select("bucket", "unit", F.pmod(F.xxhash64("unit", "bucket"), "blocks").alias("block"), "blocks"), "near-members")
    release(sets)
    return members


def _sorted_by(df: DataFrame, keys: list[str], *then: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *then)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, weight: str, limit: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches cut between groups of the first `keys` columns: tables of whole groups of at
    least `limit` bytes of column `weight` or the last, with the number of each row's group."""
    held: list[pa.RecordBatch] = []
    size = 0

    def numbered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        columns = [table.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(table.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return table, np.cumsum(new)

    for batch in steps(batches, weight, limit):
        held.append(batch)
        size += batch.column(weight).nbytes
        if size >= limit:
            table, group = numbered(pa.Table.from_batches(held))
            cut = int(np.searchsorted(group, group[-1], "left"))  # the last group may go on
            if cut:
                yield table.slice(0, cut), group[:cut]
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.column(weight).nbytes for b in held) if cut else 0
    if held:
        yield numbered(pa.Table.from_batches(held))


def _links_in_blocks(members: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (a, b), a forest for each block of (bucket, block, unit, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_groups(batches, 2, "packed", 1 << 18):
            unit = table.column("unit").to_numpy()
            i, j = near_within(*_shingles_of(table.column("packed"), size), group, threshold)
            root = _least(i, j, len(unit))
            child = np.flatnonzero(root != np.arange(len(unit)))
            yield pa.RecordBatch.from_arrays([pa.array(unit[root[child]]), pa.array(unit[child])], names=["a", "b"])

    return _sorted_by(members.select("bucket", "block", "unit", "packed"), ["bucket", "block"]).mapInArrow(run, "a long, b long")


def _links_across(shown: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (a, b) between labels: of documents of role 1 with those of role 0 of the block they are shown to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, block = None, [], None
        for batch in steps(batches, "packed", 1 << 18):
            place = list(zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), batch.column("role").to_pylist(), strict=True))
            start = 0
            while start < len(place):
                stop = start
                while stop < len(place) and place[stop] == place[start]:
                    stop += 1
                part = batch.slice(start, stop - start)
                if place[start][:2] != key:
                    key, members, block = place[start][:2], [], None
                if place[start][2] == 0:
                    members.append(part)
                elif members:
                    if block is None:
                        whole = pa.Table.from_batches(members)
                        labels = whole.column("label").to_numpy()
                        block = Shown(*_shingles_of(whole.column("packed"), size), whole.num_rows)
                    own = part.column("label").to_numpy()
                    i, j = block.near(*_shingles_of(part.column("packed"), size), part.num_rows, threshold)
                    other = own[i] != labels[j]
                    pairs = np.unique(np.stack([own[i[other]], labels[j[other]]], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
                start = stop

    columns = ["bucket", "block", "role", "unit", "label", "packed"]
    return _sorted_by(shown.select(*columns), ["bucket", "block"], "role").mapInArrow(run, "a long, b long")


def classes(rows: DataFrame, units: DataFrame, *, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame | None:
    """(unit, label) of the units that have links (None: no links). rows has `_row` and `packed`; units
    has unit, mass and bands, and its unit is the `_row` of its text."""
    placed = _placed(units)
    needed = key_filter(placed.select("unit"))
    texts = rows.select(F.col("_row").alias("unit"), "packed").where(may_be_in(F.col("_row"), needed))
    links = materialise(_links_in_blocks(placed.join(texts, "unit"), size, threshold), "near-links")
    labels = components(links)

    wide = placed.where("blocks > 1")
    if labels is not None:
        wide = wide.join(labels, "unit", "left").withColumn("label", F.coalesce("label", "unit"))
    else:
        wide = wide.withColumn("label", F.col("unit"))
    wide = materialise(wide, "near-wide")
    each = wide.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = each.groupBy("bucket").agg(F.max_by("label", "n").alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    mixed = materialise(wide.join(mixed.select("bucket", "top"), "bucket"), "near-mixed")
    apart = mixed.where("label <> top").withColumn("home", F.col("block"))
    guests = apart.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).where("block <> home")
    columns = ["bucket", "block", "unit", "label"]
    shown = mixed.select(*columns, F.lit(0).alias("role")).unionByName(guests.select(*columns, F.lit(1).alias("role")))
    more = materialise(_links_across(shown.join(texts, "unit"), size, threshold).distinct(), "near-links")
    higher = components(more)
    release(placed, links, wide, mixed, more)
    if higher is None:
        return labels
    base = labels if labels is not None else higher.select("unit", F.col("unit").alias("label"))
    base = base.unionByName(higher.select("unit", F.col("unit").alias("label")).join(base.select("unit"), "unit", "left_anti"))
    return base.join(higher.select(F.col("unit").alias("label"), F.col("label").alias("top")), "label", "left").select("unit", F.coalesce("top", "label").alias("label"))


def _classed(df: DataFrame, id_col: str, text_col: str, size: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """_id, _row and label of each row."""
    signed = _signed(df, id_col, text_col, size, bands, rows)
    units = materialise(signed.groupBy("k1", "k2").agg(F.min("_row").alias("unit"), F.count(F.lit(1)).alias("copies")), "near-keys")
    own = F.when(F.col("_row") == F.col("unit"), F.col("bands"))
    members = dealt_join(signed.drop("packed"), units.select("k1", "k2", "unit"), ["k1", "k2"], units.where(F.col("copies") >= HOT).select("k1"), "_row")
    members = materialise(members.select("_id", "_row", "unit", "mass", own.alias("bands")), "near-units")
    release(units)
    labels = classes(signed, members.where("_row = unit").select("unit", "mass", "bands"), size=size, threshold=threshold)
    release(signed)
    members = members.select("_id", "_row", "unit")
    if labels is None:
        return members.withColumn("label", F.col("unit"))
    return members.join(labels, "unit", "left").withColumn("label", F.coalesce("label", "unit"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Each row's id_col, class_id (the id that stays), class_size and kept."""
    classed = materialise(_classed(df, id_col, text_col, size, threshold, bands, rows), "classed")
    place = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_row").alias("r"))
    stays = materialise(classed.groupBy("label").agg(F.min(place).alias("_best"), F.count(F.lit(1)).alias("class_size")), "near-classes")
    out = dealt_join(classed, stays, ["label"], stays.where(F.col("class_size") >= HOT).select("label"), "_row")
    return out.select(F.col("_id").alias(id_col), F.col("_best.i").alias("class_id"), "class_size", (F.col("_best.r") == F.col("_row")).alias("kept"))


def drop_near_copies(df: DataFrame, **options) -> DataFrame:
    """The rows of df that stay, with all its columns. A numbered copy in the shared folder tells
    rows with equal or null ids apart; only rows that a fixed filter of the dropped ones lets through are joined."""
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    number = fresh(df, "_n")
    own = materialise(df.withColumn(number, F.monotonically_increasing_id()), "rows")
    keyed = own.select(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col(number).alias("n")).alias("_key"), F.col(text_col).alias("_t"))
    gone = near_duplicates(keyed, id_col="_key", text_col="_t", **options).where(~F.col("kept")).select(F.col("_key.n").alias(number))
    return without(own, materialise(gone, "gone"), number)
