"""Queries that write a file form to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays, hashing
from tessera.operators import corpus, tokens
from tessera.plans.corpus import CUT, KEPT, mixed
from tessera.plans.registry import query, table
from tessera.sources import readers
from tessera.sources.work import scratch_path


@query(r"SELECT trim(line) AS sentence, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    readers.write_lines(table(spark, sf, "documents"), path, "text")
    return readers.read_lines(spark, path).groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha1('m|passage|full' || chr(0) || vec_id) AS k, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def jsonl_cache(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "cache")
    rows = table(spark, sf, "embeddings").select(hashing.cache_key(F.col("vec_id").cast("string"), "m", "passage", None).alias("k"), F.col("embedding").alias("e"))
    readers.append_cache(rows, path)
    back = readers.read_cache(spark, path)
    return back.select("k", F.size("e").cast("long").alias("n"), F.round(F.aggregate(arrays.doubles(F.col("e")), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS pos, text AS value FROM benchmark")
def json_list(spark: SparkSession, sf: str) -> DataFrame:
    """The list is one file, as its form has it: a benchmark's sentences."""
    path = scratch_path(spark, "list")
    listed = F.array_sort(F.collect_list(F.struct("item_id", "text")))["text"]
    table(spark, sf, "benchmark").agg(F.to_json(listed).alias("value")).write.text(path)
    return readers.read_list(spark, path)


@query("SELECT label, count(*) AS n, 64 AS width FROM embeddings GROUP BY 1")
def shard_files(spark: SparkSession, sf: str) -> DataFrame:
    """Half-precision shards partitioned by range start; only the folders asked for are read."""
    path = scratch_path(spark, "shards")
    rows = table(spark, sf, "embeddings").select("vec_id", "label", readers.as_half(F.col("embedding")).alias("e"), (F.floor(F.col("vec_id") / 64) * 64).alias("shard_start"))
    rows.write.partitionBy("shard_start").parquet(path)
    return spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("e")).alias("width"))


@query(f"WITH {CUT}, {mixed('doc_idx', 0)}, w AS (SELECT CASE WHEN h < 0.01 THEN 'val' ELSE 'train' END AS side, doc_idx, ids FROM windows JOIN hashed USING (doc_idx)) SELECT side, count(*) AS windows, count(DISTINCT doc_idx) AS docs, sum(list_sum(ids))::BIGINT AS id_sum FROM w GROUP BY 1")
def partitioned_windows(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "windows")
    kept = corpus.document_split(corpus.kept_documents(table(spark, sf, "documents")), 0.01, 0)
    sides = kept.select("doc_idx", F.when(F.col("is_val"), "val").otherwise("train").alias("side"))
    readers.write_windows(tokens.byte_windows(kept).join(sides, "doc_idx"), path)
    total = F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x))
    return spark.read.parquet(path).groupBy("side").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("doc_idx").alias("docs"), total.alias("id_sum"))


@query(f"WITH {KEPT} SELECT 128 AS seq_len, count(*) AS n_docs, 'bytes' AS tokenizer, NULL::VARCHAR AS extra FROM kept")
def meta_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """A one-object sidecar with a field that this reader does not know, and without one that it does."""
    path = scratch_path(spark, "meta")
    docs = corpus.long_documents(table(spark, sf, "documents"))
    docs.agg(F.lit(128).alias("seq_len"), F.count(F.lit(1)).alias("n_docs"), F.lit("bytes").alias("tokenizer"), F.lit(1).alias("newer")).write.json(path)
    return readers.read_meta(spark, path, "seq_len int, n_docs long, tokenizer string, extra string")


@query()
def bpe_encode(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n_tokens) of every document by an installed public vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        found = readers.encode_with(table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text"), file.read())
    return found.select(F.col("item_id").alias("doc_id"), F.size("ids").alias("n_tokens"))
