"""Queries over documents: filters, sentences, splits, token windows, masked examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays, hashing, numbers, text
from tessera.operators import corpus, prefix, tokens
from tessera.plans.registry import query, table
from tessera.sources import files

SPACES = r"regexp_replace({}, '\s+', ' ', 'g')"
PIECES = r"string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?…])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))"
#: (doc_id, sent_pos, sentence)
SENTENCES = rf"""
    pieces AS (SELECT doc_id, {PIECES} AS parts FROM documents),
    placed AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS sent_pos FROM pieces),
    cleaned AS (SELECT doc_id, sent_pos::INT AS sent_pos, trim({SPACES.format('part')}) AS sentence FROM placed),
    sentences AS (SELECT * FROM cleaned WHERE length(sentence) BETWEEN 20 AND 300)"""
DISTINCT = SENTENCES + """,
    firsts AS (SELECT * FROM sentences QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY doc_id, sent_pos) = 1)"""
KEPT = "kept AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM documents WHERE length(text) > 200)"


def horner(digits: str) -> str:
    value = "0::BIGINT"
    for k in range(8):
        value = f"(({value}) * 1048576 + ('0x' || substr({digits}, {5 * k + 1}, 5))::BIGINT) % 1000000"
    return value


def mixed(doc: str, seed: int) -> str:
    """A chain of CTEs h1..h6 over rows(*, x)."""
    start = f"(((({doc})::HUGEINT * 2654435761) % 4294967296 + {seed * 2246822507 % 2**32}) % 4294967296)::BIGINT"
    return (
        f"m0 AS (SELECT *, {start} AS x FROM kept), m1 AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM m0), m2 AS (SELECT * REPLACE (((x::HUGEINT * 2146121005) % 4294967296)::BIGINT AS x) FROM m1), "
        "m3 AS (SELECT * REPLACE (xor(x, x >> 15) AS x) FROM m2), m4 AS (SELECT * REPLACE (((x::HUGEINT * 2221713035) % 4294967296)::BIGINT AS x) FROM m3), "
        "hashed AS (SELECT * EXCLUDE (x), xor(x, x >> 16) / 4294967296.0::DOUBLE AS h FROM m4)"
    )


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 200")
def doc_length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.long_documents(table(spark, sf, "documents")).select("doc_id", F.length("text").cast("long").alias("n"))


@query(f"WITH {KEPT} SELECT doc_idx, doc_id FROM kept WHERE doc_idx < 500")
def doc_ordinal_first_n(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 long documents, from a prefix of the corpus that holds them."""
    return prefix.first_kept(table(spark, sf, "documents"), 500).select("doc_idx", "doc_id")


@query(f"""WITH ring AS (SELECT {list(corpus.RING)!r} AS s), ids AS (SELECT doc_id AS i FROM documents)
    SELECT i AS doc_id, s[i % 5 + 1] || ' ' || s[(i + 1) % 5 + 1] || ' ' || s[(i + 2) % 5 + 1] || ' ' || s[(i + 3) % 5 + 1] AS text FROM ids, ring""")
def synthetic_source(spark: SparkSession, sf: str) -> DataFrame:
    """A synthetic document for each number of the table."""
    return corpus.ring_documents(table(spark, sf, "documents"))


@query(f"WITH {SENTENCES} SELECT * FROM sentences")
def sentence_extract(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sentences(table(spark, sf, "documents"))


@query(f"WITH {SENTENCES} SELECT * FROM sentences WHERE regexp_matches(sentence, '[À-ɏ]')")
def sentence_script_filter(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sentences(table(spark, sf, "documents"), script="À-ɏ")


@query(f"WITH {DISTINCT} SELECT * FROM firsts")
def sentence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.distinct_sentences(corpus.sentences(table(spark, sf, "documents")))


@query(f"WITH {DISTINCT} SELECT row_number() OVER (ORDER BY doc_id, sent_pos) - 1 AS pos, doc_id, sentence FROM firsts QUALIFY pos < 5000")
def sentence_dedup_first_n(spark: SparkSession, sf: str) -> DataFrame:
    """The first 5,000 distinct sentences, from a prefix of the corpus that holds them."""
    return prefix.first_sentences(table(spark, sf, "documents"), 5000)


@query(f"""WITH {DISTINCT}, b AS (SELECT *, {horner("sha1('7' || chr(0) || sentence)")} AS bucket FROM firsts)
    SELECT CASE WHEN bucket < 50000 THEN 'val' ELSE 'train' END AS side, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars FROM b GROUP BY 1""")
def sentence_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus.content_split(corpus.distinct_sentences(corpus.sentences(table(spark, sf, "documents"))), 0.05, 7)
    side = F.when(F.col("is_val"), "val").otherwise("train").alias("side")
    return found.groupBy(side).agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("chars"))


@query(f"WITH {DISTINCT}, b AS (SELECT *, {horner("sha1('0' || chr(0) || sentence)")} AS bucket FROM firsts) SELECT doc_id, sent_pos, bucket, bucket < 20000 AS is_val FROM b")
def content_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus.distinct_sentences(corpus.sentences(table(spark, sf, "documents")))
    return corpus.content_split(found, 0.02, 0).select("doc_id", "sent_pos", "bucket", "is_val")


@query(f"WITH {KEPT}, {mixed('doc_idx', 3)} SELECT doc_idx, doc_id, h, h < 0.01 AS is_val FROM hashed")
def doc_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.document_split(corpus.kept_documents(table(spark, sf, "documents"), carry=()), 0.01, 3).select("doc_idx", "doc_id", "h", "is_val")


@query(f"WITH {DISTINCT} SELECT doc_id, sent_pos, substr(sha1('0' || chr(1) || sentence), 1, 16) AS order_key FROM firsts ORDER BY order_key, doc_id, sent_pos LIMIT 4096")
def metric_subset(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus.distinct_sentences(corpus.sentences(table(spark, sf, "documents")))
    return corpus.metric_subset(found, 4096, 0).select("doc_id", "sent_pos", "order_key")


BYTES = "[('0x' || substr(hex(encode(coalesce({0}, ''))), 2 * i - 1, 2))::INT + 5 FOR i IN range(1, strlen(coalesce({0}, '')) + 1)]"
CUT = f"""{KEPT}, toks AS (SELECT doc_idx, {BYTES.format('text')} AS ids FROM kept),
    starts AS (SELECT doc_idx, ids, unnest(range(0, len(ids), 126)) AS s FROM toks),
    wins AS (SELECT doc_idx, (s // 126)::INT AS win_idx, ids[s + 1 : s + 126] AS piece FROM starts),
    windows AS (SELECT doc_idx, win_idx, [3] || piece || [4] || [0 FOR i IN range(126 - len(piece))] AS ids FROM wins WHERE len(piece) >= 32)"""


@query(f"WITH {CUT} SELECT doc_idx, win_idx, array_to_string(ids, ',') AS ids FROM windows")
def byte_windows(spark: SparkSession, sf: str) -> DataFrame:
    found = tokens.byte_windows(corpus.kept_documents(table(spark, sf, "documents")))
    return found.withColumn("ids", arrays.joined(F.col("ids")))


@query(f"""WITH {KEPT}, {mixed('doc_idx', 0)}, n AS (SELECT doc_idx, h < 0.01 AS is_val, strlen(text) AS t FROM hashed),
    w AS (SELECT *, t // 126 + (t % 126 >= 32)::INT AS wins FROM n)
    SELECT CASE WHEN is_val THEN 'val' ELSE 'train' END AS side, count(*) AS docs, sum(wins)::BIGINT AS windows, count(*) FILTER (wins > 0) AS docs_with_windows, max(doc_idx) + 1 AS next_doc FROM w GROUP BY 1""")
def window_split_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Both ways to count a side's documents: all of them, and those with a window."""
    kept = corpus.document_split(corpus.kept_documents(table(spark, sf, "documents"), carry=(F.octet_length("text").alias("bytes"),)), 0.01, 0)
    rows = kept.withColumn("wins", tokens.window_counts(F.col("bytes"), 128, 32))
    side = F.when(F.col("is_val"), "val").otherwise("train").alias("side")
    return rows.groupBy(side).agg(F.count(F.lit(1)).alias("docs"), F.sum("wins").alias("windows"), F.count_if(F.col("wins") > 0).alias("docs_with_windows"), (F.max("doc_idx") + 1).alias("next_doc"))


@query(f"WITH t AS (SELECT item_id, {BYTES.format('text')}[1:64] AS ids FROM benchmark) SELECT item_id, array_to_string(ids || [0 FOR i IN range(64 - len(ids))], ',') AS ids, len(ids) AS n_mask FROM t")
def encode_plain(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select("item_id", arrays.padded(text.utf8_tokens(F.col("text")), 64).alias("row"))
    return rows.select("item_id", arrays.joined(F.col("row")).alias("ids"), F.aggregate(arrays.attention(F.col("row")), F.lit(0), lambda s, x: s + x).cast("long").alias("n_mask"))


@query(f"WITH t AS (SELECT item_id, {BYTES.format('text')}[1:62] AS ids FROM benchmark) SELECT item_id, array_to_string([3] || ids || [4] || [0 FOR i IN range(62 - len(ids))], ',') AS ids, len(ids) + 2 AS n_mask FROM t")
def encode_framed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select("item_id", arrays.framed(text.utf8_tokens(F.col("text")), 64).alias("row"))
    return rows.select("item_id", arrays.joined(F.col("row")).alias("ids"), F.aggregate(arrays.attention(F.col("row")), F.lit(0), lambda s, x: s + x).cast("long").alias("n_mask"))


EXAMPLES = """t AS (SELECT item_id AS doc_idx, 0 AS win_idx, [3] || {0}[1:62] || [4] || [0 FOR i IN range(62 - len({0}[1:62]))] AS ids FROM benchmark),
    slots AS (SELECT doc_idx, win_idx, unnest(ids) AS id, unnest(range(64)) AS pos FROM t),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_idx ORDER BY (id < 5)::INT, sha1(concat_ws('|', doc_idx, win_idx, pos, 0, 11))) AS r, sum((id >= 5)::INT) OVER (PARTITION BY doc_idx) AS m FROM slots),
    marked AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE least(greatest(round_even(m * 0.15, 0), 1), m, 10) END AS n, id >= 5 AND r <= least(greatest(round_even(m * 0.15, 0), 1), m, 10) AS hit FROM ranked),
    rows AS (SELECT doc_idx, win_idx, any_value(n)::INT AS n_masked, array_to_string(list(CASE WHEN hit THEN 1 ELSE id END ORDER BY pos), ',') AS input_ids,
        coalesce(list(pos ORDER BY pos) FILTER (hit), []) AS p, coalesce(list(id ORDER BY pos) FILTER (hit), []) AS g FROM marked GROUP BY 1, 2)""".format(BYTES.format("text"))


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_idx"), F.lit(0).alias("win_idx"), arrays.framed(text.utf8_tokens(F.col("text")), 64).alias("ids"))
    return tokens.masked_examples(rows, 64, 0.15, seed=11)


@query(f"WITH {EXAMPLES} SELECT doc_idx, win_idx, input_ids, array_to_string(p || [0 FOR i IN range(10 - n_masked)], ',') AS positions, array_to_string(g || [0 FOR i IN range(10 - n_masked)], ',') AS targets, n_masked AS n_weights FROM rows")
def mlm_mask_examples(spark: SparkSession, sf: str) -> DataFrame:
    made = _examples(spark, sf)
    return made.select("doc_idx", "win_idx", *[arrays.joined(F.col(c)).alias(c) for c in ("input_ids", "positions", "targets")], F.aggregate("weights", F.lit(0.0), lambda s, x: s + x).cast("int").alias("n_weights"))


@query(f"WITH {EXAMPLES} SELECT n_masked, count(*) AS rows FROM rows GROUP BY 1")
def mask_contract_counts(spark: SparkSession, sf: str) -> DataFrame:
    masked = F.size(F.filter("input_ids", lambda x: x == arrays.MASK))
    return _examples(spark, sf).groupBy(masked.alias("n_masked")).agg(F.count(F.lit(1)).alias("rows"))


CORPUS_EXAMPLES = CUT + """, slots AS (SELECT doc_idx, win_idx, unnest(ids) AS id, unnest(range(128)) AS pos FROM windows),
    ranked AS (SELECT *, row_number() OVER w AS r, sum((id >= 5)::INT) OVER (PARTITION BY doc_idx, win_idx) AS m FROM slots WINDOW w AS (PARTITION BY doc_idx, win_idx ORDER BY (id < 5)::INT, sha1(concat_ws('|', doc_idx, win_idx, pos, 0, 11)))),
    counted AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE least(greatest(round_even(m * 0.15, 0), 1), m, 19) END AS n FROM ranked), marked AS (SELECT *, id >= 5 AND r <= n AS hit FROM counted),
    rows AS (SELECT doc_idx, win_idx, any_value(n)::INT AS n_masked, array_to_string(list(CASE WHEN hit THEN 1 ELSE id END ORDER BY pos), ',') AS input_ids,
        coalesce(list(pos ORDER BY pos) FILTER (hit), []) AS p, coalesce(list(id ORDER BY pos) FILTER (hit), []) AS g FROM marked GROUP BY 1, 2)"""


def _corpus_examples(spark: SparkSession, sf: str, joined: Sequence[str] = ()) -> DataFrame:
    return tokens.masked_windows(corpus.kept_documents(table(spark, sf, "documents")), 128, 0.15, seed=11, joined=joined)


@query(f"WITH {CORPUS_EXAMPLES} SELECT doc_idx, win_idx, input_ids, array_to_string(p || [0 FOR i IN range(19 - n_masked)], ',') AS positions, array_to_string(g || [0 FOR i IN range(19 - n_masked)], ',') AS targets, n_masked AS n_weights FROM rows")
def mlm_mask_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Every window of every document, as mlm_mask_examples has the first bytes of the items."""
    made = _corpus_examples(spark, sf, ("input_ids", "positions", "targets"))
    return made.select("doc_idx", "win_idx", "input_ids", "positions", "targets", F.aggregate("weights", F.lit(0.0), lambda s, x: s + x).cast("int").alias("n_weights"))


@query(f"WITH {CORPUS_EXAMPLES} SELECT n_masked, count(*) AS rows FROM rows GROUP BY 1")
def mask_corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    masked = F.size(F.filter("input_ids", lambda x: x == arrays.MASK))
    return _corpus_examples(spark, sf).groupBy(masked.alias("n_masked")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH t AS (SELECT doc_id, unnest({BYTES.format('text')}) AS token_id FROM documents) SELECT doc_id, token_id, count(*) AS n FROM t GROUP BY ALL")
def bow_corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_bags(table(spark, sf, "documents").withColumnRenamed("doc_id", "item_id")).withColumnRenamed("item_id", "doc_id")


@query(f"WITH t AS (SELECT item_id, unnest({BYTES.format('text')}) AS token_id FROM benchmark) SELECT item_id, token_id, count(*) AS n FROM t GROUP BY ALL")
def bow_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_bags(table(spark, sf, "benchmark"))


@query(r"""SELECT lang, count(*) AS docs, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')))::BIGINT AS words, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS tokens,
    round(sum(strlen(text)) / sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))), 6) AS fertility, round(sum(length(text)) / sum(strlen(text)), 6) AS chars_per_token FROM documents GROUP BY 1""")
def corpus_fertility(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", text.word_count(F.col("text")).alias("w"), F.length("text").alias("c"), F.octet_length("text").alias("t"))
    sums = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"), F.sum("c").alias("chars"), F.sum("t").alias("tokens"))
    return sums.withColumn("fertility", F.round(F.col("tokens") / F.col("words"), 6)).withColumn("chars_per_token", F.round(F.col("chars") / F.col("tokens"), 6))


@query("""WITH f AS (SELECT lang, sum(strlen(text)) / sum(length(text)) AS v FROM documents GROUP BY 1) SELECT a.lang, round(a.v / b.v, 6) AS ratio FROM f a, f b WHERE b.lang = 'en'""")
def fertility_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").groupBy("lang").agg((F.sum(F.octet_length("text")) / F.sum(F.length("text"))).alias("v"))
    base = rows.where("lang = 'en'").select(F.col("v").alias("base"))  # one row
    return rows.crossJoin(F.broadcast(base)).select("lang", F.round(F.col("v") / F.col("base"), 6).alias("ratio"))


@query("SELECT doc_id, greatest(1, floor(length(coalesce(text, '')) / 3.0)::INT + 1) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", numbers.estimated_tokens(F.length(text.or_empty(F.col("text")))).alias("tokens"))


@query("SELECT sha1(string_agg(text, chr(0) ORDER BY item_id)) AS digest, count(*) AS n FROM benchmark")
def corpus_digest(spark: SparkSession, sf: str) -> DataFrame:
    """One digest of an ordered corpus file: by its nature a sequential pass, over a corpus that its
    caller holds in one file."""
    listed = F.array_sort(F.collect_list(F.struct("item_id", "text")))
    return table(spark, sf, "benchmark").agg(F.sha1(F.array_join(listed["text"], "\x00")).alias("digest"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {DISTINCT} SELECT sha1(string_agg(sentence, chr(0) ORDER BY doc_id, sent_pos)) AS digest, count(*) AS n FROM firsts")
def sentence_digest(spark: SparkSession, sf: str) -> DataFrame:
    """corpus_digest of the documents' distinct sentences: sorted and written by the tasks, then one pass of a
    task over the files."""
    return files.digest_in_order(corpus.distinct_sentences(corpus.sentences(table(spark, sf, "documents"))), "sentence", "doc_id", "sent_pos")


@query("SELECT item_id, unnest([' ' || trim(text) || ' ']) AS padded, substr(' ' || trim(text) || ' ', i::INT, 3) AS gram, i::INT AS at FROM benchmark, unnest(range(1, length(trim(text)) + 1)) AS u(i)".replace("unnest([' ' || trim(text) || ' ']) AS padded, ", ""))
def char_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select("item_id", F.posexplode(text.char_grams(F.col("text"))).alias("at", "gram"))
    return rows.select("item_id", "gram", (F.col("at") + 1).alias("at"))


@query("SELECT doc_id, sha1('teacher|passage|full' || chr(0) || text) AS k FROM documents")
def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", hashing.cache_key(F.col("text"), "teacher", "passage", None).alias("k"))
