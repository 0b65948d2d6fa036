"""Queries over orders, batches, losses, progress and vocabularies of a training run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import arrays, hashing, numbers, text
from tessera.operators import batches, corpus, limits, statistics, tokens, training, vectors
from tessera.operators.ordering import with_ordinal
from tessera.plans.bookkeeping import SPEC_SQL, _specs
from tessera.plans.corpus import BYTES, CUT, horner
from tessera.plans.registry import query, table
from tessera.sources import readers
from tessera.sources.work import scratch_path


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id")


@query(f"WITH {CUT} SELECT row_number() OVER (ORDER BY sha1(concat_ws('|', doc_idx || '-' || win_idx, 5, 0)), doc_idx || '-' || win_idx) - 1 AS pos, doc_idx, win_idx FROM windows")
def shuffled_windows(spark: SparkSession, sf: str) -> DataFrame:
    """All windows of the corpus in one seeded order."""
    windows = tokens.byte_windows(corpus.kept_documents(table(spark, sf, "documents"))).select("doc_idx", "win_idx", F.concat_ws("-", "doc_idx", "win_idx").alias("id"))
    return batches.shuffled(windows, "id", 5).select("pos", "doc_idx", "win_idx")


ORDER = "o AS (SELECT epoch::INT AS epoch, vec_id, row_number() OVER (PARTITION BY epoch ORDER BY sha1(concat_ws('|', vec_id, {seed}, epoch)), vec_id) - 1 AS pos FROM embeddings, unnest(range({n})) e(epoch))"
BATCHES = ORDER.format(seed=7, n=3) + ", b AS (SELECT epoch, pos, pos // 64 AS batch, vec_id FROM o WHERE pos // 64 < (SELECT count(*) // 64 FROM embeddings))"


@query(f"WITH {ORDER.format(seed=3, n=4)} SELECT * FROM o")
def epoch_permutations(spark: SparkSession, sf: str) -> DataFrame:
    return batches.epochs(_ids(spark, sf), "vec_id", 3, 4).select("epoch", "vec_id", "pos")


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    return batches.batched(batches.epochs(_ids(spark, sf), "vec_id", 7, 3), 64).select("epoch", "pos", "batch", "vec_id")


@query(f"WITH {BATCHES} SELECT * FROM b")
def epoch_batches(spark: SparkSession, sf: str) -> DataFrame:
    return _batches(spark, sf)


@query(f"WITH {BATCHES} SELECT * FROM b WHERE (epoch, batch) >= (1, 3)")
def resumed_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batches.resumed(_batches(spark, sf), 1, 3)


@query("WITH p AS (SELECT i, j, j * (j - 1) // 2 + i AS id FROM (SELECT unnest(range(n)) AS j FROM (SELECT count(*) AS n FROM embeddings)) t, unnest(range(j)) u(i)) SELECT i, j FROM p ORDER BY sha1(concat_ws('|', id, 0)) LIMIT 20000")
def pair_sample(spark: SparkSession, sf: str) -> DataFrame:
    return batches.pair_sample(spark, _ids(spark, sf).count(), 20_000)


@query("SELECT doc_id AS pos, doc_id // 512 AS shard, length(text)::INT AS length, (ceil(length(text) / 8) * 8)::INT AS padded, row_number() OVER (PARTITION BY doc_id // 512 ORDER BY ceil(length(text) / 8), length(text), doc_id) - 1 AS rank FROM documents")
def length_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.length("text").alias("n"))
    return batches.by_length(rows, F.col("n"), F.floor(F.col("pos") / 512)).select("pos", "shard", "length", "padded", "rank")


@query("SELECT least(500, (SELECT count(*) FROM documents WHERE length(text) > 200)) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT text FROM documents WHERE length(text) > 200 ORDER BY doc_id LIMIT 500)")
def tokenizer_sample(spark: SparkSession, sf: str) -> DataFrame:
    """What a tokenizer would be made from: the first 500 kept documents, or all of them."""
    kept = corpus.long_documents(table(spark, sf, "documents")).orderBy("doc_id").limit(500)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


LOSSES = "e AS (SELECT vec_id, (vec_id % 3 <> 0)::INT::DOUBLE AS w, ln(list_sum([exp(x::DOUBLE) FOR x IN embedding])) - embedding[label + 1] AS ce FROM embeddings)"


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as scores of 64 tokens, labels as targets; every third slot has no weight."""
    ce = training.cross_entropy(arrays.doubles(F.col("embedding")), F.col("label"))
    return table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 3 != 0).cast("double").alias("w"), ce.alias("ce"))


@query(f"WITH {LOSSES} SELECT round(sum(ce * w) / greatest(sum(w), 1.0), 6) AS loss FROM e")
def masked_loss(spark: SparkSession, sf: str) -> DataFrame:
    return training.weighted_mean(_losses(spark, sf), "ce", "w").select(F.round("loss", 6).alias("loss"))


@query(f"WITH {LOSSES}, b AS (SELECT vec_id // 8 AS batch, sum(ce * w) / greatest(sum(w), 1.0) AS loss FROM e GROUP BY 1 ORDER BY 1 LIMIT 32) SELECT round(coalesce(avg(loss), 0.0), 6) AS loss FROM b")
def held_out_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = _losses(spark, sf).groupBy(F.floor(F.col("vec_id") / 8).alias("batch"))
    each = rows.agg((F.sum(F.col("ce") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1.0))).alias("loss"))
    return training.mean_of_first(each).select(F.round("loss", 6).alias("loss"))


@query(f"""WITH t AS (SELECT item_id, {BYTES.format('text')}[1:62] AS ids FROM benchmark), r AS (SELECT item_id, [3] || ids || [4] || [0 FOR i IN range(62 - len(ids))] AS ids, len(ids) AS n FROM t)
    SELECT item_id, d::INT AS dim, round(list_sum([CASE WHEN x >= 5 THEN (x * (d + 1)) % 7 ELSE 0 END FOR x IN ids])::DOUBLE / greatest(n, 1), 6) AS value FROM r, unnest(range(4)) u(d)""")
def pooled_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of four numbers made from each id, averaged over the content ids of a row."""
    rows = table(spark, sf, "benchmark").select("item_id", arrays.framed(text.utf8_tokens(F.col("text")), 64).alias("ids"))
    states = F.transform("ids", lambda x: F.array(*[(x * (d + 1) % 7).cast("double") for d in range(4)]))
    return rows.select("item_id", F.posexplode(training.pooled(F.col("ids"), states, 4)).alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS step, epoch_us(ts) / 1000000.0 AS seconds, value FROM events), w AS (SELECT step // 100 AS win, count(*) AS n, avg(value) AS loss, min(seconds) AS a, max(seconds) AS b, max(step) AS last FROM s GROUP BY 1),
    r AS (SELECT *, n / greatest(b - coalesce(lag(b) OVER (ORDER BY win), a), 1e-6) AS rate FROM w) SELECT win AS "window", n, round(loss, 6) AS loss, round(rate, 6) AS rate, round((200000 - last - 1) / greatest(rate, 1e-9), 2) AS eta FROM r""")
def loss_windows(spark: SparkSession, sf: str) -> DataFrame:
    log = with_ordinal(table(spark, sf, "events").select("ts", "event_id", "value"), "step", "ts", "event_id")
    found = training.loss_windows(log.select("step", (limits.micros("ts") / 1_000_000).alias("seconds"), F.col("value").alias("loss")), 100, 200_000)
    return found.select("window", "n", F.round("loss", 6).alias("loss"), F.round("rate", 6).alias("rate"), F.round("eta", 2).alias("eta"))


@query("SELECT s AS snapshot, s * 300 AS embedded FROM (SELECT count(*) // 300 AS n FROM labels), unnest(range(1, n + 1)) u(s)")
def cache_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot written after each 300 labels, each read back and counted."""
    folder, rows = scratch_path(spark, "snapshots"), with_ordinal(table(spark, sf, "labels").select("doc_id"), "pos", "doc_id")
    whole = training.snapshots(rows, 300)
    parts = rows.withColumn("snapshot", F.floor(F.col("pos") / 300) + 1).join(F.broadcast(whole), "snapshot")  # a row a snapshot
    parts.select("pos", "snapshot").write.partitionBy("snapshot").parquet(folder)
    held = spark.read.schema("pos long, snapshot long").parquet(folder).select(F.col("snapshot").alias("part"))
    return whole.select("snapshot").join(held.groupBy("part").agg(F.count(F.lit(1)).alias("n")), F.col("part") <= F.col("snapshot")).groupBy("snapshot").agg(F.sum("n").alias("embedded"))


@query("""WITH c AS (SELECT event_id AS call, event_id % 9 AS l, event_id % 11 AS b FROM events)
    SELECT call, list_sum([CASE WHEN i <= least(l, 6) THEN least(60.0::DOUBLE, power(2.0::DOUBLE, i)) ELSE 0.0::DOUBLE END FOR i IN range(1, 7)]) AS waited, l > 6 AS gave_up, greatest(1, floor(100 / power(2, b)))::INT AS batch, b > 6 AS skipped FROM c""")
def retry_plan(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").select(F.col("event_id").alias("call"), F.pmod("event_id", F.lit(9)).alias("limited"), F.pmod("event_id", F.lit(11)).alias("broken"))
    return training.retry_plan(calls, 100, 6)


@query("WITH n AS (SELECT (CASE WHEN p_partkey % 10 = 0 THEN 'tok/embedding/' ELSE 'layers/' END) || p_partkey AS path, p_size::BIGINT * (p_partkey % 384 + 1) AS n FROM part) SELECT sum(n)::BIGINT AS total, (sum(n) FILTER (contains(path, 'embedding')))::BIGINT AS embedding, (sum(n) FILTER (NOT contains(path, 'embedding')))::BIGINT AS non_embedding FROM n")
def parameter_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a tensor of its size times a width that follows from its key."""
    key = F.col("p_partkey")
    path = F.concat(F.when(key % 10 == 0, "tok/embedding/").otherwise("layers/"), key.cast("string"))
    return training.parameter_counts(table(spark, sf, "part").select(path.alias("path"), F.array(F.col("p_size").cast("int"), (key % 384 + 1).cast("int")).alias("shape")))


@query("SELECT p_partkey, p_size::INT AS heads, (p_size * (p_partkey % 100 + 1) // p_size)::INT AS head_dim, 32000 * (p_size * (p_partkey % 100 + 1) // p_size) AS embedding_parameters FROM part")
def head_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's size as heads of a model whose width is a multiple of them."""
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("int").alias("heads"), (F.col("p_size") * (F.col("p_partkey") % 100 + 1)).cast("int").alias("hidden"))
    width = training.head_width(F.col("hidden"), F.col("heads"))
    return rows.select("p_partkey", "heads", width.cast("int").alias("head_dim"), (width * 32000).cast("long").alias("embedding_parameters"))


@query(f"""WITH s AS (SELECT unnest({list(training.SPECIAL_TOKENS)!r}) AS token, unnest(range(5)) AS id), w AS (SELECT DISTINCT source AS name, lang AS token FROM documents), n AS (SELECT DISTINCT name FROM w),
    v AS (SELECT name, token, 4 + row_number() OVER (PARTITION BY name ORDER BY token) AS id FROM w UNION ALL SELECT name, token, CASE WHEN name = 'src2' THEN (id + 1) % 5 ELSE id END FROM n, s WHERE name <> 'src5' OR id <> 1)
    SELECT name, (SELECT count(*) FROM s JOIN v x USING (token, id) WHERE x.name = v.name) = 5 AS specials, bool_or(token = '[PAD]' AND id = 0) AS padding, count(*) AS size, count(*) = 9 AS as_requested FROM v GROUP BY name""")
def vocabulary_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A vocabulary for each source: the special tokens, then its languages; one source lacks a token, another has them moved."""
    words = table(spark, sf, "documents").select(F.col("source").alias("name"), F.col("lang").alias("token")).distinct()
    own = words.withColumn("id", (F.row_number().over(Window.partitionBy("name").orderBy("token")) + 4).cast("int"))  # a language each
    specials = words.select("name").distinct().select("name", F.posexplode(F.array(*[F.lit(t) for t in training.SPECIAL_TOKENS])).alias("at", "token"))
    moved = F.when(F.col("name") == "src2", (F.col("at") + 1) % 5).otherwise(F.col("at")).cast("int")
    specials = specials.where("name <> 'src5' or at <> 1").select("name", "token", moved.alias("id"))
    return training.vocabulary_checks(own.unionByName(specials).withColumn("requested", F.lit(9)))


@query(r"WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS piece FROM documents) SELECT count(*) AS entries, count(*) FILTER (regexp_matches(piece, '[À-ɏ]')) AS with_script FROM w WHERE piece <> ''")
def script_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct words of the documents as a vocabulary."""
    words = table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("piece")).where("piece <> ''").distinct()
    return training.script_entries(words, "À-ɏ")


@query()
def vocabulary_script(spark: SparkSession, sf: str) -> DataFrame:
    """Of the entries of an installed byte-level vocabulary that the documents use: how many have a letter of
    another script, once decoded."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        model = file.read()
    used = readers.used_ids(table(spark, sf, "documents"), model)
    return training.script_entries(readers.decoded_entries(used, model), "À-ɏ")


HUB = "spec LIKE 'hf://%' OR (NOT (spec LIKE '.%' OR spec LIKE '/%' OR spec LIKE '~%' OR spec LIKE '%.json') AND regexp_full_match(spec, '[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9._-]+'))"


@query(f"""WITH f AS (SELECT doc_id, {SPEC_SQL} AS spec, doc_id % 5 = 2 AS folder, doc_id % 10 = 2 AS inner_, doc_id % 3 = 0 AS file, n_chars AS size, doc_id % 7 = 1 AS parent FROM documents)
    SELECT doc_id, spec, CASE WHEN folder THEN CASE WHEN inner_ THEN 'folder' ELSE 'error' END WHEN file THEN CASE WHEN size <= 500 THEN 'file' ELSE 'train' END WHEN ({HUB}) AND (spec LIKE 'hf://%' OR NOT parent) THEN 'hub' ELSE 'train' END AS source FROM f""")
def tokenizer_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """What each document's name stands for, given what its row says is there; 500 entries are asked for."""
    n = F.col("doc_id")
    rows = _specs(spark, sf).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    found = training.resolution(F.col("spec"), n % 5 == 2, n % 10 == 2, n % 3 == 0, F.col("n_chars"), F.lit(500), text.is_hub_id(F.col("spec")), n % 7 == 1)
    return rows.select("doc_id", "spec", found.alias("source"))


def _gauss(parts: str) -> str:
    number = f"('0x' || substr(sha1(concat_ws('|', {parts}, '{{}}')), 1, 8))::BIGINT"
    return f"sqrt(-2 * ln(({number.format('u')} + 1) / 4294967296.0::DOUBLE)) * cos(2 * pi() * {number.format('v')} / 4294967296.0::DOUBLE)"


@query(f"""WITH t AS (SELECT item_id, unnest({BYTES.format('text')}) AS token_id FROM benchmark), b AS (SELECT item_id, token_id, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1),
    p AS (SELECT token_id, d::INT AS dim, {_gauss('token_id, d, 0')} / sqrt(261) AS p FROM (SELECT DISTINCT token_id FROM b), unnest(range(8)) u(d)), s AS (SELECT item_id, dim, sum(n * p) AS s FROM b JOIN p USING (token_id) GROUP BY 1, 2)
    SELECT item_id, dim, round(s / (norm + 1e-8) + 0.01::DOUBLE * {_gauss('item_id, dim, 1')}, 6) AS value FROM s JOIN m USING (item_id)""")
def projected_bags(spark: SparkSession, sf: str) -> DataFrame:
    """A teacher of eight dimensions made from the items' bags of bytes."""
    found = training.projected_bags(tokens.token_bags(table(spark, sf, "benchmark")), 261, 8, 0)
    return found.withColumn("value", F.round("value", 6))


SIDES = f"k AS (SELECT vec_id, embedding, {horner('''sha1('0' || chr(0) || vec_id)''')} < 100000 AS is_val FROM embeddings)"


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumn("is_val", hashing.content_bucket(F.col("vec_id").cast("string"), 0) < 100_000)


@query(f"WITH {SIDES}, p AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64))::INT AS dim FROM k WHERE NOT is_val) SELECT dim, round(avg(x), 6) AS mean FROM p GROUP BY 1")
def train_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors' mean over the training side only."""
    return vectors.mean_vector(_sides(spark, sf).where("not is_val")).select("dim", F.round("mean", 6).alias("mean"))


@query(f"WITH {SIDES} SELECT 'val' AS side, vec_id FROM k WHERE is_val UNION ALL SELECT 'train', vec_id FROM k WHERE NOT is_val")
def gathered_sides(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of each side, gathered by a semi-join on their positions."""
    sides = _sides(spark, sf).select("vec_id", "is_val")
    rows = _ids(spark, sf)
    parts = [rows.join(sides.where(w).select("vec_id"), "vec_id", "left_semi").select(F.lit(n).alias("side"), "vec_id") for n, w in (("val", "is_val"), ("train", "not is_val"))]
    return parts[0].unionByName(parts[1])


@query("SELECT doc_id AS pos, length(text) AS chars, embedding[1]::DOUBLE AS first, strlen(text) AS tokens FROM documents JOIN embeddings ON doc_id = vec_id")
def positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts, vectors and token counts that stand at the same position."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text")
    at = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.element_at("embedding", 1).cast("double").alias("first"))
    counts = docs.select("pos", F.octet_length("text").cast("long").alias("tokens"))
    return docs.select("pos", F.length("text").cast("long").alias("chars")).join(at, "pos").join(counts, "pos")


DRAWS = "d AS (SELECT unnest(range(10))::INT AS draw), r AS (SELECT draw, label, vec_id AS item, row_number() OVER (PARTITION BY draw, label ORDER BY sha1(concat_ws('|', vec_id, draw, 0)), vec_id) AS r FROM embeddings, d), few AS (SELECT draw, item FROM r WHERE r <= 8)"


@query(f"WITH {DRAWS}, u AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS pos FROM (SELECT DISTINCT item FROM few)) SELECT draw, item, pos FROM few JOIN u USING (item)")
def union_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each draw's rows in the union of all draws, which is embedded once."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "label")
    few = statistics.few_shot(rows, 8, 10).select("draw", "item")
    return few.join(with_ordinal(few.select("item").distinct(), "pos", "item"), "item").select("draw", "item", "pos")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'RETRIEVAL_QUERY' ELSE 'RETRIEVAL_DOCUMENT' END AS task, substr(text, 1, 90) AS wide, substr(text, 1, 80) AS narrow FROM conversations")
def task_types(spark: SparkSession, sf: str) -> DataFrame:
    """Users' turns as queries, all others as passages; what a log line shows of each."""
    kinds = F.create_map(*[F.lit(x) for pair in training.TASKS.items() for x in pair])
    kind = F.when(F.col("role") == "user", "query").otherwise("passage")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.element_at(kinds, kind).alias("task"), text.shown(F.col("text"), 90).alias("wide"), text.shown(F.col("text"), 80).alias("narrow"))


@query("SELECT vec_id FROM embeddings ORDER BY sha1(concat_ws('|', vec_id, 0)), vec_id LIMIT 4000")
def geometry_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The 4,000 rows that a geometry panel is drawn from."""
    return vectors.metric_rows(table(spark, sf, "embeddings"), 4_000).select("vec_id")


@query("""WITH u AS (SELECT vec_id, [x / (sqrt(list_sum([y::DOUBLE * y FOR y IN embedding])) + 1e-12) FOR x IN embedding] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(q.v, r.v), 9) AS score FROM u q, u r WHERE q.vec_id % 100 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM k WHERE rank <= 5""")
def retrieval_each(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth row as a query against all rows."""
    rows = table(spark, sf, "embeddings")
    return vectors.top_k_each(rows, rows.where("vec_id % 100 = 0"), 5).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id % 100 AS item, round(avg(((n_chars > 1000)::INT = quality)::INT), 6) AS mean FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def item_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Each item's share of right answers over its runs: a hundred items, each in several documents."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    answers = rows.select(F.pmod("doc_id", F.lit(100)).alias("item"), F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"))
    return statistics.item_means(answers).select("item", F.round("mean", 6).alias("mean"))


@query()
def normalised_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha1(text.normalised(F.col("text"))).alias("digest"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT event_id, epoch_us(ts) // 1000000 % 20000 AS s FROM events)")
def short_clocks(spark: SparkSession, sf: str) -> DataFrame:
    """The seconds of every event's time, modulo 20,000, as a clock."""
    seconds = F.floor(limits.micros("ts") / 1_000_000) % 20_000
    return table(spark, sf, "events").select("event_id", numbers.short_clock(seconds).alias("clock"))


@query("WITH d AS (SELECT *, (epoch_us(ts) + 7200000000) // 86400000000 AS day FROM events), u AS (SELECT day, least(count(*), 100) AS used FROM d WHERE event_id % 3 = 0 GROUP BY 1) SELECT event_id, day, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) + coalesce(used, 0) <= 100 AS admitted FROM d LEFT JOIN u USING (day) WHERE event_id % 3 <> 0")
def daily_cap_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Days of a clock two hours ahead. An earlier run took every third event, and left what it used of each
    day in a table, which this run reads back."""
    events, path = table(spark, sf, "events"), scratch_path(spark, "usage")
    first = limits.daily(events.where("event_id % 3 = 0"), 100, "+02:00").where("admitted")
    first.groupBy("day").agg(F.count(F.lit(1)).alias("used")).write.parquet(path)
    return limits.daily(events.where("event_id % 3 <> 0"), 100, "+02:00", spark.read.parquet(path)).select("event_id", "day", "admitted")