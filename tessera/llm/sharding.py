"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Count the rows of each input partition.
2. Draw on the driver how many rows each partition sends to each shard: row by row from the
   multivariate hypergeometric law, so partition totals and shard sizes are both exact.
3. Permute each partition locally, by a sort within it, and cut it by its row of the matrix.
4. After the exchange permute each shard: rows get random 64-bit keys, each shard is cut into key
   ranges of bounded size, ranks within a range plus the range's offset are the gapless slots.

The random keys are drawn once and kept in a work table in the shared folder, so a lost executor
cannot change them. Law "rows": shard sizes differ by one at most. Null text has size 1 and the
checksum of an empty text. Equal rows are different rows, each gets its own slot; an empty table
gives an empty result; the input's other columns are carried if their names are in `carry`, whatever
they are, but for `shard` and `slot`, which the result has anew.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, release

#: Rows of one key range of a shard, at least; of large inputs the square root of all rows.
RANGE_ROWS = 250
#: Bytes of the communication matrix up to which it is sent to every task; a larger one is joined.
CUTS_BYTES = 64 << 20


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[p] rows of partition p dealt to `shards` shards whose sizes differ by one at most."""
    total = int(sum(counts))
    left = np.full(shards, total // shards, dtype=np.int64)
    rng = np.random.default_rng(seed)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        rest, need = int(left.sum()), int(n)
        for s in range(shards - 1):
            rest -= int(left[s])
            out[p, s] = _hypergeometric(rng, int(left[s]), rest, need)
            need -= int(out[p, s])
        out[p, shards - 1] = need
        left -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A draw of n from good + bad; beyond numpy's limit of 10**9 by inversion over the values within
    12 standard deviations of the mode (the rest has no mass in double precision)."""
    if n == 0 or good == 0 or bad == 0:
        return n if bad == 0 else 0
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    wide = int(12 * (n * (good / total) * (bad / total)) ** 0.5) + 12
    k = np.arange(max(0, n - bad, mode - wide), min(n, good, mode + wide) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[1:]) - np.log(bad - n + k[1:])
    weight = np.concatenate([[0.0], np.cumsum(step)])
    law = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(np.searchsorted(law, rng.random() * law[-1], "right"), len(k) - 1)])


def shuffle_to_shards(df: DataFrame, shards: int = 8, *, seed: int = 20_260_101, carry: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The columns `carry` (all, if None) of each row with its shard and slot, which take the place of
    input columns of these names."""
    names = [c for c in (df.columns if carry is None else carry) if c.lower() not in ("shard", "slot")]
    spark = df.sparkSession
    number = F.monotonically_increasing_id()
    carried = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("int")
    rows = df.select(carried.alias("carried"), F.xxhash64(F.lit(seed), number).alias("key"), F.xxhash64(F.lit(seed + 1), number, F.lit("slot")).alias("place"))
    # the local permutation: each partition sorted by its own keys, without an exchange; the numbers
    # given after it hold the partition and the rank in it
    sorted_ = rows.sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id())
    rank = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rows = materialise(sorted_.select("carried", "place", F.shiftright("at", 33).cast("int").alias("part"), rank.alias("rank")), "shard-rows")

    counts = rows.groupBy("part").count().orderBy("part").collect()  # one number a partition
    matrix = communication_matrix([r["count"] for r in counts], shards, seed)
    sent = matrix.sum(axis=0)
    cuts = spark.createDataFrame([(r["part"], [int(x) for x in np.cumsum(m)]) for r, m in zip(counts, matrix, strict=True)], "part int, cuts array<long>")
    dealt = rows.join(F.broadcast(cuts) if matrix.nbytes <= CUTS_BYTES else cuts, "part")

    range_rows = max(range_rows, math.isqrt(int(sent.sum())))
    pieces = [max(1, -(-int(n) // range_rows)) for n in sent]
    sizes = F.array(*[F.lit(n) for n in pieces])
    dealt = dealt.withColumn("shard", F.size(F.filter("cuts", lambda x: x < F.col("rank"))))
    # the top 31 bits of the second key, scaled to the shard's number of ranges
    top = F.shiftrightunsigned("place", 33)
    dealt = dealt.withColumn("range", F.shiftright(top * F.element_at(sizes, F.col("shard") + 1), 31).cast("int"))
    dealt = materialise(dealt.select("carried", "shard", "range", "place"), "shard-dealt")
    release(rows)
    ranges = dealt.groupBy("shard", "range").count()
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "range").orderBy("place")
    out = dealt.withColumn("rank", F.row_number().over(within)).join(offsets, ["shard", "range"])
    slot = (F.col("before") + F.col("rank") - 1).cast("long").alias("slot")
    return out.select(*(["carried.*"] if names else []), "shard", slot)


def write_shards(df: DataFrame, path: str, shards: int = 8, **options) -> None:
    """The whole rows as one folder of Parquet a shard, files in slot order; input columns named shard
    or slot are replaced."""
    dealt = shuffle_to_shards(df, shards, **options)
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8, *, seed: int = 20_260_101, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest form: id_col, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shuffle_to_shards(slim, shards, seed=seed)
    return out.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
