"""Lexical features of texts in long form: TF-IDF, trigram projection, latent semantic analysis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays, text
from tessera.operators import vectors
from tessera.sources.work import work_table


def word_terms(column: Column) -> Column:
    """Lower-case words of two letters or more."""
    return F.regexp_extract_all(F.lower(text.or_empty(column)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def edge_grams(column: Column, least: int = 3, most: int = 5) -> Column:
    """Character runs within each word between two spaces; a word shorter than a run's length is taken
    whole, once."""
    words = F.transform(text.word_list(F.lower(column)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    none = F.array().cast("array<string>")

    def runs(word: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1)))
        return F.when(F.length(word) > n, F.transform(starts, lambda i: F.substr(word, i, F.lit(n)))).otherwise(none)

    def grams(word: Column) -> Column:
        whole = F.when(F.length(word) <= most, F.array(word)).otherwise(none)
        return F.concat(*[runs(word, n) for n in range(least, most + 1)], whole)

    return F.flatten(F.transform(words, grams))


#: Terms whose weights go to every task (some 100 bytes each there), and texts that a task counts.
HELD_TERMS, TASK_TEXTS = 1 << 19, 1 << 12


def tfidf(rows: DataFrame, terms: Column, min_df: int = 2) -> DataFrame:
    """(item_id, term, weight): 1 + ln tf times ln((1 + n) / (1 + df)) + 1, rows of unit length.

    Texts are dealt by item, and what is counted or summed by item stays there. The HELD_TERMS terms of most
    items, nearly all entries, get their weights from a broadcast; only entries of the others are exchanged,
    for a join with theirs, and come back to their items.
    """
    size = rows.count()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXTS))
    counts = rows.repartition(parts, "item_id").select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    idf = work_table(df.withColumn("idf", F.log((1 + F.lit(size)) / (1 + F.col("df"))) + 1), "idf")
    w = ((1 + F.log("tf")) * F.col("idf")).alias("w")
    if idf.count() <= HELD_TERMS:
        raw = counts.join(F.broadcast(idf), "term").select("item_id", "term", w)
    else:
        held = work_table(idf.orderBy(F.desc("df"), "term").limit(HELD_TERMS).select("term", "idf"), "held")
        near = counts.join(F.broadcast(held), "term").select("item_id", "term", w)
        far = counts.join(F.broadcast(held), "term", "left_anti").join(idf, "term").select("item_id", "term", w)
        raw = near.unionByName(far.repartition(parts, "item_id"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("item_id")))
    return raw.select("item_id", "term", (F.col("w") / norm).alias("weight"))


def trigram_projection(rows: DataFrame, dim: int = 64, buckets: int = 65_536, seed: int = 0) -> DataFrame:
    """(item_id, dim, x): sums of a Gaussian vector for each trigram's bucket, of unit length. The
    vectors come from a hash of (bucket, dim), so nothing is sent to the tasks; an item's buckets, `buckets`
    numbers at most, meet in one row, and what is exchanged does not grow with dim."""
    grams = rows.select("item_id", F.explode(text.char_grams(F.col("text"))).alias("gram"))
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets))
    counts = grams.groupBy("item_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("item_id").agg(F.collect_list(F.struct("bucket", "n")).alias("held"))

    def uniform(cell: Column, d: Column, tag: str) -> Column:
        return (F.pmod(F.xxhash64(cell["bucket"], d, F.lit(seed), F.lit(tag)), F.lit(1 << 52)) + 1) / float(1 << 52)

    def total(d: Column) -> Column:
        normal = lambda c: F.sqrt(-2 * F.log(uniform(c, d, "r"))) * F.cos(2 * np.pi * uniform(c, d, "a"))
        return F.aggregate("held", F.lit(0.0), lambda s, c: s + c["n"] * normal(c))

    sums = held.select("item_id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), total).alias("x"))
    return sums.select("item_id", F.posexplode(arrays.unit(F.col("x"))).alias("dim", "x"))


def latent_semantics(weights: DataFrame, dim: int = 300, sketch: int = 16, seed: int = 0) -> DataFrame:
    """(item_id, dim, x): truncated singular vectors of the TF-IDF rows, of unit length.

    A randomised range finder: the rows are projected on hashed Gaussian directions, twice through
    the matrix. A row or a term has one array of dim + sketch numbers, tasks add up their own, and only
    Gram matrices of that width come to the driver.
    """
    sizes = weights.agg(F.countDistinct("item_id"), F.countDistinct("term")).first()
    k = min(dim, max(1, min(sizes) - 1))
    wide = min(k + sketch, min(sizes))
    rows = _summed(weights.select("item_id", "weight", F.xxhash64("term", F.lit(seed)).alias("y")), "item_id", wide)
    for _ in range(2):
        terms = _summed(weights.join(_orthonormal(rows), "item_id").select("term", "weight", "y"), "term", wide)
        rows = _summed(weights.join(_orthonormal(terms), "term").select("item_id", "weight", "y"), "item_id", wide)
    values, turn = np.linalg.eigh(_gram(rows))
    turned = _times(rows, turn[:, np.argsort(values)[::-1][:k]])
    unit = F.transform("y", lambda x: x / (F.sqrt(F.aggregate("y", F.lit(0.0), lambda s, z: s + z * z)) + 1e-12))
    return turned.select("item_id", F.posexplode(unit).alias("dim", "x"))


def _directions(hashes: np.ndarray, wide: int) -> np.ndarray:
    """(len(hashes), wide) standard normal numbers, the same for the same hash."""

    def uniform(tag: int) -> np.ndarray:
        x = hashes.view(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(wide, dtype=np.uint64) * np.uint64(2) + np.uint64(tag + 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53

    return np.sqrt(-2 * np.log(uniform(0))) * np.cos(2 * np.pi * uniform(1))


def _summed(entries: DataFrame, key: str, wide: int) -> DataFrame:
    """(key, y): sums of weight times y, an array or the hash of a random direction, over each key's
    entries (key, weight, y). A task adds up the entries of a batch before the exchange."""
    random = entries.schema["y"].dataType.simpleString() == "bigint"
    fields = f"{key} {entries.schema[key].dataType.simpleString()}, y array<double>"

    def added(keys: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        coded = keys.dictionary_encode()
        sums = np.zeros((len(coded.dictionary), wide))
        np.add.at(sums, coded.indices.to_numpy(), values)
        ends = np.arange(0, sums.size + 1, wide, dtype=np.int32)
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.reshape(-1)))], names=[key, "y"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                y = batch.column(2)
                values = _directions(y.to_numpy(), wide) if random else y.flatten().to_numpy(zero_copy_only=False).reshape(len(y), wide)
                yield added(batch.column(0), values * batch.column(1).to_numpy()[:, None])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last key may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks().to_batches()[0]
            found = added(both.column(0), both.column(1).flatten().to_numpy(zero_copy_only=False).reshape(both.num_rows, wide))
            yield found.slice(0, found.num_rows - 1)
            held = found.slice(found.num_rows - 1)
        if held is not None:
            yield held

    sums = entries.select(key, "weight", "y").mapInArrow(partial, fields).repartition(key).sortWithinPartitions(key)
    return work_table(sums.mapInArrow(whole, fields), "sums")


def _gram(rows: DataFrame) -> np.ndarray:
    cells = sorted((r.a, r.row) for r in vectors.moments(rows.select(F.col("y").alias("v"))).collect())
    return np.array([row for _, row in cells])


def _orthonormal(rows: DataFrame) -> DataFrame:
    values, turn = np.linalg.eigh(_gram(rows))
    return _times(rows, turn / np.sqrt(np.maximum(values, 1e-12 * values.max())))


def _times(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """rows (key, y) times a small matrix."""
    shared = rows.sparkSession.sparkContext.broadcast(matrix)  # dim + sketch squared at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(shared.value)))
            turned = y @ shared.value
            ends = np.arange(0, turned.size + 1, turned.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(turned.reshape(-1)))], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
