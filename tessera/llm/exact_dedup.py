"""Exact dedup by a log-structured merge index of text digests, in DataFrame operations only.

Rows reach the index in memtables of MEMTABLE rows about, by the task that read them (from 8 up to 32;
beyond 8 million rows they grow). A flush combines a memtable by
digest (the identifier that stays, the number of rows) and writes it as a run sorted by digest, with
a Bloom filter sized by its digests. A digest of one row that no other run's filter holds is settled there
and then. What the filters let through is compacted level by level, FAN runs into one. Digests of
several rows are hits: only rows that a filter of the hits lets through are dealt out with their
texts, and each is compared byte by byte with the text of the row that stays; a row that differs in spite
of an equal digest forms a group by its whole text. Filters change the work, never the result.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
with the largest identifier stays (a null identifier is the smallest; of rows that share even
that, one stays). A general index keeps either end: keep="largest" or "smallest". Other
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bits_for, dealt_join, filter_bits, fresh, key_filter, materialise, may_be_in, release, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a memtable, about; runs, at least and at most, as an entry asks every other run's filter; runs
#: that a compaction makes one.
MEMTABLE, LEAST_RUNS, MOST_RUNS, FAN = 1 << 18, 8, 32, 4
#: Rows of one digest from which they are dealt to several tasks.
HOT = 2_000
#: Copies of one text that are compared with it in one task, about.
COPIES = 1000


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else. All-ASCII texts take Spark's byte-wise lower()."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


class MergeIndex:
    """Runs of (digest, keep, rows). `keep` is the identifier that stays."""

    def __init__(self, rows: int, keep: str = "largest"):
        self.pick = {"largest": F.max, "smallest": F.min}[keep]
        self.runs = min(MOST_RUNS, max(LEAST_RUNS, -(-rows // MEMTABLE)))
        self.level: DataFrame | None = None

    def flush(self, rows: DataFrame, digest: str, ident: str) -> None:
        """Every memtable's rows combined by digest, each as a sorted run."""
        rows = rows.select(F.pmod(F.spark_partition_id(), F.lit(self.runs)).alias("run"), F.col(digest).alias("digest"), F.col(ident).alias("keep"), F.lit(1).cast("long").alias("rows"))
        self.level = self._merge(rows, "run-0")

    def _merge(self, rows: DataFrame, tag: str) -> DataFrame:
        merged = rows.groupBy("run", "digest").agg(self.pick("keep").alias("keep"), F.sum("rows").alias("rows"))
        return materialise(merged.sortWithinPartitions("run", "digest"), tag)

    def settle(self) -> tuple[DataFrame, DataFrame]:
        """(digests of one row that no other run's filter holds, all other entries) of the flushed runs."""
        sizes = {r.run: r["count"] for r in self.level.groupBy("run").count().collect()}  # a row a run
        bits = bits_for(max(sizes.values(), default=0), 24)
        filters = [key_filter(self.level.where(F.col("run") == i).select("digest"), bits) for i in sorted(sizes)]
        elsewhere = F.lit(False)
        for i, other in zip(sorted(sizes), filters, strict=True):
            elsewhere = elsewhere | ((F.col("run") != i) & may_be_in(F.col("digest"), other, bits))
        marked = self.level.withColumn("open", (F.col("rows") > 1) | elsewhere)
        return marked.where(~F.col("open")).drop("open"), marked.where("open").drop("open")

    def compact(self, entries: DataFrame) -> DataFrame:
        """The entries of all runs as one level: (digest, keep, rows), FAN runs into one at a time."""
        runs, depth = self.runs, 0
        while runs > 1:
            runs, depth = -(-runs // FAN), depth + 1
            merged = self._merge(entries.withColumn("run", F.floor(F.col("run") / FAN).cast("int")), f"run-{depth}")
            if depth > 1:
                release(entries)
            entries = merged
        return entries.drop("run")


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row for each row of df: its id_col, keep_id, group_size, kept and text_sha256."""
    docs = df.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    docs = docs.select("_id", "_text", F.unhex(F.sha2("_text", 256)).alias("_digest"))

    index = MergeIndex(df.count(), keep)
    index.flush(docs, "_digest", "_id")
    settled, entries = index.settle()
    level = index.compact(entries)
    alone = settled.select("digest", "keep", "rows").unionByName(level.where("rows = 1"))
    single = alone.select(F.col("keep").alias("_id"), F.col("keep").alias("keep_id"), F.col("rows").alias("group_size"), F.lit(True).alias("kept"), "digest")

    hits = materialise(level.where("rows > 1").withColumnRenamed("digest", "_digest"), "hits")
    bits = filter_bits(hits)
    among = docs.withColumn("_row", F.monotonically_increasing_id()).where(may_be_in(F.col("_digest"), key_filter(hits.select("_digest"), bits), bits))
    hot = hits.where(F.col("rows") >= HOT).select("_digest")
    members = materialise(dealt_join(among, hits, ["_digest"], hot, "_row"), "members")
    stays = members.where(F.col("_id").eqNullSafe(F.col("keep"))).groupBy("_digest").agg(F.min("_row").alias("_row"))
    # Many copies of one text meet its sample in several tasks: the sample is dealt to each of their parts.
    parts = F.ceil(F.col("rows") / COPIES)
    sample = members.join(stays, ["_digest", "_row"]).select("_digest", F.col("_row").alias("_first"), F.col("_text").alias("_sample"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    dealt = members.withColumn("_part", F.pmod(F.xxhash64("_row"), parts))
    variant = F.when(F.col("_text") != F.col("_sample"), F.col("_text"))
    checked = dealt.join(sample, ["_digest", "_part"]).select("_digest", "_id", "_row", "keep", "rows", "_first", variant.alias("_variant"))
    checked = materialise(checked, "checked")
    release(hits, members)
    columns = ["_id", F.col("keep").alias("keep_id"), F.col("rows").alias("group_size"), (F.col("_first") == F.col("_row")).alias("kept"), F.col("_digest").alias("digest")]
    if checked.where("_variant is not null").limit(1).count():
        grouped = _with_variants(checked, keep).select(*columns)
    else:
        grouped = checked.select(*columns)
    return single.unionByName(grouped).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _with_variants(checked: DataFrame, keep: str) -> DataFrame:
    """checked with the groups of texts that share a digest and differ: keep, rows and _first by whole text."""
    place = F.struct(F.col("_id").alias("i"), F.col("_row").alias("r"))
    best = F.max(place) if keep == "largest" else F.min(place)
    groups = checked.groupBy("_digest", "_variant").agg(best.alias("_best"), F.count(F.lit(1)).alias("_size"))
    found = checked.alias("c").join(groups.alias("g"), (F.col("c._digest") == F.col("g._digest")) & F.col("c._variant").eqNullSafe(F.col("g._variant")))
    return found.select("c._digest", "c._id", "c._row", F.col("_best.i").alias("keep"), F.col("_size").alias("rows"), F.col("_best.r").alias("_first"))


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of df that stay, with all its columns. Rows are told apart by a number given to them
    in a copy in the shared folder, so rows with equal or null identifiers are handled too; only rows
    that a fixed filter of the dropped ones lets through are joined."""
    number = fresh(df, "_n")
    own = materialise(df.withColumn(number, F.monotonically_increasing_id()), "rows")
    order = own.select(F.struct(F.col(id_col).alias("i"), F.col(number).alias("n")).alias("_key"), F.col(text_col).alias("_t"))
    gone = exact_dedup(order, id_col="_key", text_col="_t", keep=keep).where(~F.col("kept")).select(F.col("_key.n").alias(number))
    return without(own, materialise(gone, "gone"), number)
