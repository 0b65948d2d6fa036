"""Queries over caches, shards, settings, request logs, schedules and small bookkeeping tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing, numbers, text
from tessera.operators import cache, calls, encoding, limits, ranges
from tessera.plans.registry import query, table
from tessera.sources.work import scratch_path

KEYED = "sents AS (SELECT doc_id AS pos, text AS sentence, sha1('teacher|passage|full' || chr(0) || text) AS k FROM documents), cache AS (SELECT DISTINCT k FROM sents JOIN labels ON pos = doc_id)"


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("sentence"))
    return rows.withColumn("k", hashing.cache_key(F.col("sentence"), "teacher", "passage", None))


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents' texts are the cached ones."""
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("pos"))
    return _sentences(spark, sf).join(known, "pos", "left_semi").select("k").distinct()


@query(f"WITH {KEYED} SELECT pos, k FROM sents WHERE k NOT IN (SELECT k FROM cache)")
def cache_missing(spark: SparkSession, sf: str) -> DataFrame:
    return cache.missing(_sentences(spark, sf), _cache(spark, sf)).select("pos", "k")


@query(f"WITH {KEYED} SELECT pos, k FROM sents JOIN cache USING (k)")
def cache_aligned(spark: SparkSession, sf: str) -> DataFrame:
    return cache.aligned(_sentences(spark, sf), _cache(spark, sf)).select("pos", "k")


@query(f"WITH {KEYED}, c AS (SELECT (SELECT count(*) FROM sents) AS input_total, (SELECT count(*) FROM sents JOIN cache USING (k)) AS embedded) SELECT *, round_even(embedded / input_total, 4) AS coverage, embedded >= input_total AS complete FROM c")
def cache_join_coverage(spark: SparkSession, sf: str) -> DataFrame:
    sents = _sentences(spark, sf)
    return cache.coverage(sents, cache.aligned(sents, _cache(spark, sf)))


@query("SELECT sha1(source) AS k, arg_max(n_chars, doc_id) AS e FROM documents GROUP BY source")
def cache_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("line"), F.sha1("source").alias("k"), F.col("n_chars").alias("e"))
    return cache.last_wins(lines)


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT s AS shard_start, least(s + 64, n) AS shard_end FROM n, unnest(range(0, n, 64)) u(s)")
def shard_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return cache.shard_ranges(spark, table(spark, sf, "embeddings").count(), 64)


DONE = "n AS (SELECT count(*) AS n FROM embeddings), r AS (SELECT s AS shard_start, least(s + 64, n) AS shard_end FROM n, unnest(range(0, n, 64)) u(s)), done AS (SELECT * FROM r WHERE (shard_start / 64) % 3 <> 1)"


def _shards(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ranges = cache.shard_ranges(spark, table(spark, sf, "embeddings").count(), 64)
    return ranges, ranges.where("(shard_start div 64) % 3 <> 1")


@query(f"WITH {DONE} SELECT r.* FROM r ANTI JOIN done USING (shard_start)")
def shard_missing(spark: SparkSession, sf: str) -> DataFrame:
    return cache.missing_shards(*_shards(spark, sf))


@query(f"WITH {DONE} SELECT vec_id AS pos, shard_start FROM embeddings JOIN done ON vec_id >= shard_start AND vec_id < shard_end")
def shard_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"))
    return cache.rows_in_shards(rows, _shards(spark, sf)[1], 64).select("pos", "shard_start")


@query("WITH r AS (SELECT doc_id, doc_id // 2 AS a, doc_id // 2 + n_chars % 37 + CASE WHEN doc_id % 100 = 0 THEN 5000 ELSE 0 END AS b FROM documents) SELECT doc_id, vec_id FROM r JOIN embeddings ON vec_id >= a AND vec_id < b")
def ranges_of_any_length(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors in ranges of mixed length, some over the whole table, overlapping."""
    a = F.floor(F.col("doc_id") / 2)
    length = F.col("n_chars") % 37 + F.when(F.col("doc_id") % 100 == 0, 5000).otherwise(0)
    made = table(spark, sf, "documents").select("doc_id", a.alias("start"), (a + length).alias("end"))
    return ranges.points_in_ranges(table(spark, sf, "embeddings").select("vec_id"), made, "vec_id").select("doc_id", "vec_id")


@query()
def called_service(spark: SparkSession, sf: str) -> DataFrame:
    """Every document sent to a service that limits and fails by hashes: outcome, batch, seconds of back-off."""
    rows = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 256).alias("shard"), F.col("doc_id").alias("item"), "text")
    return calls.called(rows, calls.hash_client(), scratch_path(spark, "calls"))


HEX = "(('0x' || substr(sha256(coalesce(text, '')), 4 * {0} + 1, 4))::INT / 65535.0::DOUBLE - 0.5)"


@query("WITH v AS (SELECT doc_id, [" + ", ".join(HEX.format(i) for i in range(8)) + "] AS x FROM documents), n AS (SELECT doc_id, x, sqrt(list_sum([c * c FOR c IN x])) AS n FROM v) SELECT doc_id, " + ", ".join(f"(x[{i + 1}] / n)::FLOAT AS e{i}" for i in range(8)) + " FROM n")
def encoded_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document by an encoder that a worker loads once, batched by length and put back in order."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    made = encoding.encode(docs, encoding.hash_encoder(8, too_many=40_000))
    return made.select("doc_id", *[F.get("e", F.lit(i)).alias(f"e{i}") for i in range(8)])


@query(f"WITH {DONE} SELECT sum(shard_end - shard_start)::BIGINT AS embedded, (SELECT n FROM n) AS n FROM done")
def shard_embedded_count(spark: SparkSession, sf: str) -> DataFrame:
    ranges, done = _shards(spark, sf)
    return done.agg(F.sum(F.col("shard_end") - F.col("shard_start")).alias("embedded")).crossJoin(ranges.agg(F.max("shard_end").alias("n")))


@query("WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT count(*) AS n_previous FROM documents WHERE doc_id < 150) SELECT s AS shard_start, least(s + 32, n) AS shard_end FROM n, p, unnest(range(0, n, 32)) u(s) WHERE least(s + 32, n) <= n_previous")
def shard_seed_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The earlier session made the first 150 documents; its whole shards are taken over."""
    current = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("sentence"))
    return cache.seedable(cache.shard_ranges(spark, current.count(), 32), cache.is_prefix(current.where("pos < 150"), current))


@query("SELECT count(*) AS rows, count(DISTINCT vec_id) AS positions, true AS whole FROM embeddings")
def assemble_guard(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"))
    return cache.assembled(rows, rows.count())


@query("WITH c AS (SELECT source AS key, CASE WHEN source = 'src3' THEN NULL ELSE count(*)::VARCHAR END AS value FROM documents GROUP BY 1), s AS (SELECT source AS key, (count(*) FILTER (lang <> 'fr' OR source < 'src15'))::VARCHAR AS value FROM documents WHERE source <> 'src7' GROUP BY 1) SELECT c.key, c.value AS current, s.value AS saved FROM c LEFT JOIN s USING (key) WHERE c.value IS DISTINCT FROM s.value")
def fingerprint_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's number of documents as a setting, against a saved run's, which lacks one and has some otherwise."""
    docs = table(spark, sf, "documents")
    current = docs.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    current = current.withColumn("value", F.when(F.col("key") != "src3", F.col("value")))
    saved = docs.where("source <> 'src7'").groupBy(F.col("source").alias("key")).agg(F.count_if((F.col("lang") != "fr") | (F.col("source") < "src15")).cast("string").alias("value"))
    return cache.changed_settings(current, saved)


@query("""WITH l AS (SELECT source AS run, (count(*) % 5)::INT AS le, max(lang) AS lf FROM documents WHERE doc_id % 2 = 0 AND source <> 'src4' GROUP BY 1), r AS (SELECT source AS run, (count(*) % 5)::INT AS re, max(lang) FILTER (doc_id % 3 = 0) AS rf FROM documents WHERE doc_id % 2 = 1 AND source <> 'src9' GROUP BY 1),
    t AS (SELECT * FROM l FULL JOIN r USING (run)), s AS (SELECT *, CASE WHEN re IS NULL THEN 'local' WHEN le IS NULL THEN 'remote' WHEN re <= le THEN 'local' WHEN lf <> rf THEN 'refused' ELSE 'remote' END AS source FROM t) SELECT run, source, CASE WHEN source = 'remote' THEN re ELSE le END AS epoch FROM s""")
def newest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """A run for each source: its even documents' state here, its odd ones' elsewhere."""
    docs = table(spark, sf, "documents")
    epoch = (F.count(F.lit(1)) % 5).cast("int").alias("epoch")
    local = docs.where("doc_id % 2 = 0 and source <> 'src4'").groupBy(F.col("source").alias("run")).agg(epoch, F.max("lang").alias("fingerprint"))
    remote = docs.where("doc_id % 2 = 1 and source <> 'src9'").groupBy(F.col("source").alias("run")).agg(epoch, F.max(F.when(F.col("doc_id") % 3 == 0, F.col("lang"))).alias("fingerprint"))
    return cache.newest(local, remote)


@query("SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens FROM events WINDOW w AS (ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def rate_window(spark: SparkSession, sf: str) -> DataFrame:
    return limits.trailing(table(spark, sf, "events")).select("event_id", "requests", F.round("tokens", 4).alias("tokens"))


@query("SELECT event_id, epoch_us(ts) // 86400000000 AS day, row_number() OVER (PARTITION BY epoch_us(ts) // 86400000000 ORDER BY ts, event_id) <= 100 AS admitted FROM events")
def daily_cap(spark: SparkSession, sf: str) -> DataFrame:
    return limits.daily(table(spark, sf, "events"), 100).select("event_id", "day", "admitted")


@query("""WITH s AS (SELECT *, user_id, event_type, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW))
    SELECT event_type, max(n) AS busiest, count(*) AS requests FROM s GROUP BY 1""")
def busiest_minute(spark: SparkSession, sf: str) -> DataFrame:
    rows = limits.trailing(table(spark, sf, "events"), "event_type")
    return rows.groupBy("event_type").agg(F.max("requests").alias("busiest"), F.count(F.lit(1)).alias("requests"))


@query()
def rate_limiter_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Waits of a limiter that admits 3 requests a minute of each user; one user's requests follow one another."""
    return limits.replay(table(spark, sf, "events"), rpm=3, tpm=500.0)


@query("WITH t AS (SELECT event_id AS step FROM events) SELECT step, round(CASE WHEN step < 30 THEN 0.001 * step / 30 WHEN step < 850 THEN 0.001 ELSE 0.001 * (1 - sqrt(least((step - 850) / 150.0, 1.0))) END, 9) AS lr FROM t")
def lr_trapezoid(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a step of a schedule of 1,000 steps; later ones stay at its end."""
    return table(spark, sf, "events").select(F.col("event_id").alias("step")).select("step", F.round(numbers.trapezoid(F.col("step"), 1000, 0.001), 9).alias("lr"))


@query("WITH t AS (SELECT event_id AS step FROM events) SELECT step, round(CASE WHEN step < 100 THEN 0.001 * step / 100 ELSE 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least((step - 100) / 900.0, 1.0)))) END, 9) AS lr FROM t")
def lr_warmup_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a step of a schedule of 1,000 steps; later ones stay at its end."""
    return table(spark, sf, "events").select(F.col("event_id").alias("step")).select("step", F.round(numbers.warmup_cosine(F.col("step"), 1000, 0.001, 100), 9).alias("lr"))


@query("""WITH s AS (SELECT event_id, value, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS best FROM events)
    SELECT event_id, value > best AS is_best FROM s""")
def running_best(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events that are over all earlier ones of theirs."""
    return limits.best_so_far(table(spark, sf, "events"), "user_id").select("event_id", "is_best")


@query("""WITH RECURSIVE x AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY n, doc_id) AS r, n FROM (SELECT doc_id // 256 AS shard, doc_id, strlen(text) // 100 + 1 AS n FROM documents)),
    g AS (SELECT shard, r, 0::BIGINT AS grp, 1::BIGINT AS size FROM x WHERE r = 1 UNION ALL SELECT x.shard, x.r, CASE WHEN (g.size + 1) * x.n > 512 THEN g.grp + 1 ELSE g.grp END, CASE WHEN (g.size + 1) * x.n > 512 THEN 1 ELSE g.size + 1 END FROM g JOIN x ON x.shard = g.shard AND x.r = g.r + 1)
    SELECT shard, grp, count(*) AS n_items FROM g GROUP BY 1, 2""")
def micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    shard = F.floor(F.col("doc_id") / 256).alias("shard")
    rows = table(spark, sf, "documents").select(shard, "doc_id", F.floor(F.octet_length("text") / 100 + 1).cast("long").alias("n"))
    return limits.micro_batches(rows, "shard", 512)


@query("SELECT item_id, 'Instruct: Given a web search query, retrieve relevant passages that answer the query' || chr(10) || 'Query:' || text AS query, text AS passage FROM benchmark")
def instruction_format(spark: SparkSession, sf: str) -> DataFrame:
    ask = text.instruction_for(F.lit("query"), F.lit(""), limits.DEFAULT_INSTRUCTION)
    rows = table(spark, sf, "benchmark")
    return rows.select("item_id", text.formatted(F.col("text"), F.lit("query"), ask).alias("query"), text.formatted(F.col("text"), F.lit("passage"), ask).alias("passage"))


#: A name in nine forms for each document, of its language and source.
SPEC_SQL = "CASE doc_id % 9 WHEN 0 THEN 'hf://' || lang || '/' || source WHEN 1 THEN lang || '/' || source WHEN 2 THEN './' || lang || '/' || source WHEN 3 THEN '~/' || lang WHEN 4 THEN lang || '/' || source || '.json' WHEN 5 THEN lang WHEN 6 THEN lang || '/' || source || '/x' WHEN 7 THEN '-' || lang || '/' || source ELSE 'A.' || lang || '-c/' || source || '_e' END"


def _specs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, spec)"""
    lang, source = F.col("lang"), F.col("source")
    forms = [F.concat(F.lit("hf://"), lang, F.lit("/"), source), F.concat(lang, F.lit("/"), source), F.concat(F.lit("./"), lang, F.lit("/"), source), F.concat(F.lit("~/"), lang), F.concat(lang, F.lit("/"), source, F.lit(".json")), lang, F.concat(lang, F.lit("/"), source, F.lit("/x")), F.concat(F.lit("-"), lang, F.lit("/"), source), F.concat(F.lit("A."), lang, F.lit("-c/"), source, F.lit("_e"))]
    return table(spark, sf, "documents").select("doc_id", F.get(F.array(*forms), (F.col("doc_id") % 9).cast("int")).alias("spec"))


@query(f"SELECT doc_id, spec, spec LIKE 'hf://%' OR (NOT (spec LIKE '.%' OR spec LIKE '/%' OR spec LIKE '~%' OR spec LIKE '%.json') AND regexp_full_match(spec, '[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9._-]+')) AS is_hub, regexp_replace(spec, '^hf://', '') AS bare FROM (SELECT doc_id, {SPEC_SQL} AS spec FROM documents)")
def hub_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _specs(spark, sf).select("doc_id", "spec", text.is_hub_id(F.col("spec")).alias("is_hub"), text.without_hub_prefix(F.col("spec")).alias("bare"))


#: What an event's number and type make of it as an error.
ERROR_SQL = "CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 200 WHEN 3 THEN NULL ELSE 503 END AS code, CASE event_id % 7 WHEN 0 THEN 'Quota exceeded for ' || event_type WHEN 1 THEN event_type || ': CUDA out of memory' WHEN 2 THEN 'RESOURCE_EXHAUSTED' WHEN 3 THEN NULL ELSE event_type END AS msg, CASE WHEN event_id % 11 = 0 THEN 'OutOfMemoryError' WHEN event_id % 11 = 1 THEN NULL ELSE event_type END AS kind"


@query(f"SELECT event_id, coalesce(code = 429, false) OR regexp_matches(lower(coalesce(msg, '')), '429|resource_exhausted|quota|rate limit') AS limited, coalesce(kind = 'OutOfMemoryError', false) OR contains(lower(coalesce(msg, '')), 'out of memory') AS oom FROM (SELECT event_id, {ERROR_SQL} FROM events)")
def error_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as an error of a service: its code, message and kind follow from its number and type."""
    kind, n = F.col("event_type"), F.col("event_id")
    pick = lambda m, *values: F.get(F.array(*values), (n % m).cast("int"))
    code = pick(5, *[F.lit(x).cast("int") for x in (429, 500, 200, None, 503)])
    said = pick(7, F.concat(F.lit("Quota exceeded for "), kind), F.concat(kind, F.lit(": CUDA out of memory")), F.lit("RESOURCE_EXHAUSTED"), F.lit(None).cast("string"), kind, kind, kind)
    named = F.when(n % 11 == 0, "OutOfMemoryError").when(n % 11 != 1, kind)
    return table(spark, sf, "events").select("event_id", text.rate_limited(code, said).alias("limited"), text.out_of_memory(named, said).alias("oom"))


@query("""WITH t AS (SELECT event_id, event_id % 200 AS i FROM events) SELECT event_id, i, least(60.0, power(2.0, i)) AS backoff, greatest(least(16384, (i * 200) // 2), 512) AS budget, (ceil(i / 8) * 8)::INT AS padded,
    round(exp(least(i / 8.0, 20.0)), 3) AS ppl, (round_even(i * 64 * 8.0 / 3 / 64, 0) * 64)::INT AS mlp, (i * 97 // 3600) || ':' || lpad((i * 97 % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((i * 97 % 60)::VARCHAR, 2, '0') AS clock FROM t""")
def scalar_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The small rules for every event's number, modulo 200."""
    i = F.col("i")
    return table(spark, sf, "events").select("event_id", (F.col("event_id") % 200).alias("i")).select(
        "event_id",
        "i",
        numbers.backoff_seconds(i).alias("backoff"),
        numbers.clamped_budget(F.lit(16384), i * 200, 512).alias("budget"),
        numbers.padded_length(i).alias("padded"),
        F.round(numbers.perplexity(i / 8), 3).alias("ppl"),
        numbers.mlp_width(i * 64).alias("mlp"),
        numbers.clock(i * 97).alias("clock"),
    )


#: A file's path for each document: of a step, of a named folder, or of none.
PATH_SQL = "CASE doc_id % 4 WHEN 0 THEN (doc_id % 30 * 10) || '/' || source || '.bin' WHEN 1 THEN source || '/' || lang WHEN 2 THEN (doc_id % 7) || 'a/x' ELSE (doc_id % 50)::VARCHAR END"


@query(f"SELECT DISTINCT split_part(p, '/', 1)::BIGINT AS step, split_part(p, '/', 1) <> '20' AS obsolete FROM (SELECT {PATH_SQL} AS p FROM documents) WHERE contains(p, '/') AND regexp_full_match(split_part(p, '/', 1), '[0-9]+')")
def checkpoint_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The steps among the folders of the documents' paths; 20 is the current one."""
    n = F.col("doc_id")
    forms = [F.concat((n % 30 * 10).cast("string"), F.lit("/"), "source", F.lit(".bin")), F.concat("source", F.lit("/"), "lang"), F.concat((n % 7).cast("string"), F.lit("a/x")), (n % 50).cast("string")]
    return limits.steps(table(spark, sf, "documents").select(F.get(F.array(*forms), (n % 4).cast("int")).alias("path")), current=20)


@query("SELECT lang, list_sort(list_distinct(list(source))) AS known, len(list_filter(['src0', 'src1', 'nope'], lambda x: NOT list_contains(list(source), x))) AS unknown FROM documents GROUP BY lang".replace("list_sort(list_distinct(list(source))) AS known, ", ""))
def unknown_names(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.array(F.lit("src0"), F.lit("src1"), F.lit("nope"))
    return table(spark, sf, "documents").groupBy("lang").agg(F.collect_set("source").alias("s")).select("lang", F.size(F.array_except(asked, F.col("s"))).cast("long").alias("unknown"))
