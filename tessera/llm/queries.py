"""The queries of this subpackage, op1 to op13, and their SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import alignment, ann, exact_dedup, lm_score, neardup, packing, pii, prefix_trie, sharding, sp_codec, substring_dedup, token_count, toxicity

#: Bounds are pruned at 1/1.15 of the exact search's; recall is measured in the tests.
ANN_FACTOR = 1.15


def _read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir), 8)


def op2_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_read(spark, sf_dir))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = sp_codec.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return sp_codec.encode_decode(_read(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op5_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.vec_id % 100 == 0, k=10, factor=ANN_FACTOR)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return token_count.count_tokens(_read(spark, sf_dir), file.read(), limit=2048)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.checked(_read(spark, sf_dir), pii.key_of(spark))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return alignment.align(_read(spark, sf_dir), a.read(), b.read())


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    return lm_score.score(docs, lm_score.fit(docs))


QUERIES = {f.__name__: f for f in (op1_hypergeometric_shards, op2_best_fit_pack, op3_dart_minhash, op4_byte_bpe, op5_vantage_point_search, op6_exact_dedup, op7_substring_dedup, op8_token_counts, op9_toxicity, op10_pii_surrogates, op11_prefix_trie, op12_tokenizer_alignment, op13_context_mixing)}

#: crc32 of a conversation's decimal number, byte by byte and bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)))"""

ORACLE_SQL = {
    "op11_prefix_trie": f"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) - 1 AS p
                   FROM conversations WHERE conv_id IS NOT NULL),
             ids AS (SELECT c, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
             turns AS (SELECT i.c, 0 AS own, p, role, text FROM ids i JOIN t ON t.c = i.c - i.c % 20 WHERE p < h
                       UNION ALL SELECT i.c, 1, p, role, text FROM ids i JOIN t ON t.c = i.c WHERE p >= h),
             paths AS (SELECT c, row_number() OVER w AS d, list(struct_pack(role, text)) OVER w AS path, text FROM turns WINDOW w AS (PARTITION BY c ORDER BY own, p ROWS UNBOUNDED PRECEDING)),
             members AS (SELECT c, d, min(c) OVER (PARTITION BY d, path) AS r, text FROM paths UNION ALL SELECT c, 0, min(c) OVER (), '' FROM ids),
             lens AS (SELECT c, max(d) AS len FROM members GROUP BY c),
             nodes AS (SELECT r, d, count(*) AS n, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS w FROM members GROUP BY r, d),
             kids AS (SELECT m.r, m.d, count(*) AS k FROM nodes x JOIN members m ON m.c = x.r AND m.d = x.d - 1 GROUP BY m.r, m.d),
             sub AS (SELECT m.r, m.d, sum((x.n - 1) * x.w) AS saved, count(*) FILTER (WHERE k.k IS NULL) AS leaves
                     FROM nodes x LEFT JOIN kids k ON k.r = x.r AND k.d = x.d JOIN members m ON m.c = x.r AND m.d <= x.d GROUP BY m.r, m.d),
             ends AS (SELECT m.r, m.d, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS e FROM members m JOIN lens l ON l.c = m.c AND l.len = m.d GROUP BY m.r, m.d)
        SELECT x.r AS conv_id, x.d AS depth, p.r AS parent_conv_id, x.n AS n_convs, coalesce(k.k, 0) AS n_children, s.leaves AS n_leaves,
               s.saved::BIGINT AS saved_tokens, coalesce(e.e, sha256('')) AS ends_sha256
        FROM nodes x JOIN sub s ON s.r = x.r AND s.d = x.d LEFT JOIN kids k ON k.r = x.r AND k.d = x.d
             LEFT JOIN members p ON p.c = x.r AND p.d = x.d - 1 LEFT JOIN ends e ON e.r = x.r AND e.d = x.d
    """,
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
}
