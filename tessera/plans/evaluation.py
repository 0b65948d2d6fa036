"""Queries over scores, labels and lexical features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features, learning, statistics
from tessera.operators.ordering import with_ordinal
from tessera.plans.registry import ORACLE_SQL, query, table

DRAW = "('0x' || substr(sha1({}), 1, 8))::BIGINT"


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "label", "embedding")


@query("""WITH d AS (SELECT unnest(range(10))::INT AS draw), r AS (SELECT draw, label, vec_id AS item, row_number() OVER (PARTITION BY draw, label ORDER BY sha1(concat_ws('|', vec_id, draw, 0)), vec_id) AS r FROM embeddings, d) SELECT draw, label, item FROM r WHERE r <= 8""")
def few_shot_draw(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.few_shot(_classes(spark, sf).drop("embedding"), 8, 10).select("draw", "label", "item")


@query("WITH d AS (SELECT unnest(range(10))::INT AS draw), r AS (SELECT draw, label, vec_id AS item, row_number() OVER (PARTITION BY draw, label ORDER BY sha1(concat_ws('|', vec_id, draw, 0)), vec_id) AS r FROM embeddings, d) SELECT DISTINCT item FROM r WHERE r <= 8")
def few_shot_union(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.few_shot(_classes(spark, sf).drop("embedding"), 8, 10).select("item").distinct()


@query("SELECT vec_id AS item, label, ((row_number() OVER (PARTITION BY label ORDER BY sha1(concat_ws('|', vec_id, 0)), vec_id) - 1) % 5)::INT AS fold FROM embeddings")
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.folds(_classes(spark, sf)).select("item", "label", "fold")


@query("SELECT DISTINCT label FROM embeddings")
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("label").distinct()


#: A stated guess for each labelled document: whether it has over 1,000 characters, and its source's last digit.
GUESSES = "g AS (SELECT l.doc_id, quality AS y, (n_chars > 1000)::INT AS p, toxic AS t, source AS c, lang FROM labels l JOIN documents d USING (doc_id))"


def _guesses(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"), F.col("toxic").alias("t"), F.col("source").alias("c"), "lang")


@query(f"WITH {GUESSES}, s AS (SELECT y AS label, 1 AS n, (y = p)::INT AS tp FROM g UNION ALL SELECT p, 1, 0 FROM g), f AS (SELECT label, 2.0 * sum(tp) / sum(n) AS f FROM s GROUP BY 1) SELECT round(avg(f), 6) AS macro_f1 FROM f")
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.macro_f1(_guesses(spark, sf)).select(F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {GUESSES}, r AS (SELECT lang, avg((y = p)::INT) AS a FROM g GROUP BY 1) SELECT round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS sd FROM r")
def accuracy_over_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = statistics.accuracy(_guesses(spark, sf).withColumnRenamed("lang", "run"))
    return rows.select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


CELLS = GUESSES + ", k AS (SELECT t AS y, c, count(*) AS n FROM g GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER () AS nn FROM k)"


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _guesses(spark, sf).select(F.col("t").alias("y"), "c")


@query(f"WITH {CELLS}, h AS (SELECT -sum(n / nn * ln(ny / nn)) AS hy, -sum(n / nn * ln(nc / nn)) AS hc, -sum(n / nn * ln(n / nc)) AS hyc, -sum(n / nn * ln(n / ny)) AS hcy FROM m) SELECT round(2 * (1 - hyc / hy) * (1 - hcy / hc) / ((1 - hyc / hy) + (1 - hcy / hc)), 6) AS v_measure FROM h")
def v_measure(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.v_measure(_clusters(spark, sf)).select(F.round("v_measure", 6).alias("v_measure"))


@query(f"""WITH {CELLS}, a AS (SELECT sum(n * (n - 1) / 2) AS b, sum(n) AS t FROM k), y AS (SELECT sum(m * (m - 1) / 2) AS s FROM (SELECT sum(n) AS m FROM k GROUP BY y)), z AS (SELECT sum(m * (m - 1) / 2) AS s FROM (SELECT sum(n) AS m FROM k GROUP BY c))
    SELECT round((b - y.s * z.s / (t * (t - 1) / 2)) / ((y.s + z.s) / 2 - y.s * z.s / (t * (t - 1) / 2)), 6) AS ari FROM a, y, z""")
def ari(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.adjusted_rand(_clusters(spark, sf)).select(F.round("ari", 6).alias("ari"))


SCORES = GUESSES + ", s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, (y = p)::INT::DOUBLE AS x, (y = t)::INT::DOUBLE AS z, lang, c FROM g), n AS (SELECT count(*) AS n FROM s), b AS (SELECT unnest(range(200)) AS b)"
DRAWN = "drawn AS (SELECT b, " + DRAW.format("concat_ws('|', b, ord, 0)") + " % n AS ord FROM s, n, b)"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return with_ordinal(_guesses(spark, sf).select("doc_id", (F.col("y") == F.col("p")).cast("double").alias("x"), (F.col("y") == F.col("t")).cast("double").alias("z")), "ord", "doc_id")


def _rounded(row: DataFrame) -> DataFrame:
    return row.select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


@query(f"WITH {SCORES}, {DRAWN}, m AS (SELECT b, avg(x) AS m FROM drawn JOIN s USING (ord) GROUP BY 1) SELECT round((SELECT avg(x) FROM s), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(statistics.bootstrap(_scores(spark, sf).select("ord", "x"), 200))


@query(f"WITH {SCORES}, {DRAWN}, m AS (SELECT b, avg(x - z) AS m FROM drawn JOIN s USING (ord) GROUP BY 1), q AS (SELECT round((SELECT avg(x - z) FROM s), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m) SELECT *, lo > 0 OR hi < 0 AS significant FROM q")
def paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    row = _rounded(statistics.bootstrap(_scores(spark, sf).select("ord", (F.col("x") - F.col("z")).alias("x")), 200))
    return row.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


GROUPED = SCORES + ", gs AS (SELECT right(c, -3)::BIGINT AS grp, sum(x) AS s, count(*) AS k FROM s GROUP BY 1), gd AS (SELECT b, " + DRAW.format("concat_ws('|', b, grp, 0)") + " % (SELECT count(*) FROM gs) AS grp FROM gs, b)"


@query(f"WITH {GROUPED}, m AS (SELECT b, sum(s) / sum(k) AS m FROM gd JOIN gs USING (grp) GROUP BY 1) SELECT round((SELECT avg(x) FROM s), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m".replace("right(c, -3)", "substr(c, 4)"))
def bootstrap_ci_grouped(spark: SparkSession, sf: str) -> DataFrame:
    """Groups are the sources, which are numbered from 0."""
    rows = _guesses(spark, sf).select(F.substring("c", 4, 9).cast("long").alias("grp"), (F.col("y") == F.col("p")).cast("double").alias("x"))
    return _rounded(statistics.cluster_bootstrap(rows, 200))


#: The SQL of the three queries above has 200 replicates; the whole job has these.
REPLICATES = 2_000


def _whole(name: str) -> str:
    return ORACLE_SQL[name].replace("unnest(range(200)) AS b", f"unnest(range({REPLICATES})) AS b")


@query(_whole("bootstrap_ci"))
def bootstrap_ci_2000(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(statistics.bootstrap(_scores(spark, sf).select("ord", "x"), REPLICATES))


@query(_whole("paired_delta"))
def paired_delta_2000(spark: SparkSession, sf: str) -> DataFrame:
    row = _rounded(statistics.bootstrap(_scores(spark, sf).select("ord", (F.col("x") - F.col("z")).alias("x")), REPLICATES))
    return row.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


@query(_whole("bootstrap_ci_grouped"))
def bootstrap_ci_grouped_2000(spark: SparkSession, sf: str) -> DataFrame:
    rows = _guesses(spark, sf).select(F.substring("c", 4, 9).cast("long").alias("grp"), (F.col("y") == F.col("p")).cast("double").alias("x"))
    return _rounded(statistics.cluster_bootstrap(rows, REPLICATES))


@query(f"WITH {GUESSES}, m AS (SELECT 'length' AS model, avg((y = p)::INT) AS score FROM g UNION ALL SELECT 'toxic', avg((y = t)::INT) FROM g UNION ALL SELECT 'ones', avg(y) FROM g) SELECT model, round(score, 6) AS score FROM m ORDER BY m.score DESC, model LIMIT 1")
def strongest_baseline(spark: SparkSession, sf: str) -> DataFrame:
    g = _guesses(spark, sf)
    long = g.select(F.explode(F.map_from_arrays(F.array(F.lit("length"), F.lit("toxic"), F.lit("ones")), F.array((F.col("y") == F.col("p")).cast("double"), (F.col("y") == F.col("t")).cast("double"), F.col("y").cast("double")))).alias("model", "x"))
    means = long.groupBy("model").agg(F.avg("x").alias("s"))
    return means.orderBy(F.desc("s"), "model").limit(1).select("model", F.round("s", 6).alias("score"))


@query("SELECT 'benchmark' AS split, item_id, text FROM benchmark UNION ALL SELECT 'documents', doc_id, text FROM documents")
def union_splits(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("split"), "item_id", "text")
    return one.unionByName(table(spark, sf, "documents").select(F.lit("documents").alias("split"), F.col("doc_id").alias("item_id"), "text"))


TFIDF = """c AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM benchmark),
    w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN d USING (term), n) SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w"""


@query(r"WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark), " + TFIDF)
def tfidf_word(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark")
    return features.tfidf(rows, features.word_terms(F.col("text"))).withColumn("weight", F.round("weight", 6))


@query(r"""WITH p AS (SELECT item_id, ' ' || unnest(regexp_split_to_array(trim(lower(text)), '\s+')) || ' ' AS w FROM benchmark), l AS (SELECT unnest([3, 4, 5]) AS k),
    t AS (SELECT item_id, substr(w, i::INT, k) AS term FROM p, l, unnest(range(1, greatest(length(w) - k + 2, 1))) u(i) WHERE length(w) > k UNION ALL SELECT item_id, w FROM p WHERE length(w) <= 5), """ + TFIDF)
def tfidf_char_wb(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark")
    return features.tfidf(rows, features.edge_grams(F.col("text"))).withColumn("weight", F.round("weight", 6))


@query(r"WITH t AS (SELECT doc_id AS item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents), " + TFIDF.replace("FROM benchmark", "FROM documents"))
def tfidf_word_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Word weights of every document."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return features.tfidf(rows, features.word_terms(F.col("text"))).withColumn("weight", F.round("weight", 6))


@query()
def trigram_projection(spark: SparkSession, sf: str) -> DataFrame:
    return features.trigram_projection(table(spark, sf, "benchmark"), 64)


@query()
def lsa(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark")
    return features.latent_semantics(features.tfidf(rows, features.word_terms(F.col("text"))))


@query()
def few_shot_probe(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.accuracy(learning.few_shot_probe(_classes(spark, sf)))


@query()
def cross_validated_probe(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.accuracy(learning.cross_validated_probe(_classes(spark, sf)))


@query()
def clustering_scores(spark: SparkSession, sf: str) -> DataFrame:
    return learning.clustering_scores(_classes(spark, sf))
