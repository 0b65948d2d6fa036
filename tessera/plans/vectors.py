"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays
from tessera.operators import vectors
from tessera.operators.ordering import with_ordinal
from tessera.plans.registry import query, table

UNIT = "[x / (sqrt(list_sum([y * y FOR y IN {0}])) + {1}) FOR x IN {0}]"
#: The two views of every row, and of the rows that pair metrics are defined on.
ALL_VIEWS = f"""every_cut AS (SELECT vec_id, embedding::DOUBLE[] AS e, (embedding::DOUBLE[])[1:32] AS h FROM embeddings),
    all_views AS (SELECT vec_id, {UNIT.format('h', '1e-12')} AS s, {UNIT.format('e', '1e-12')} AS t FROM every_cut)"""
VIEWS = ALL_VIEWS + ", views AS (SELECT * FROM all_views ORDER BY sha1(concat_ws('|', vec_id, 0)), vec_id LIMIT 4096)"
PAIRS = VIEWS + ", pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.s, b.s) AS s, list_dot_product(a.t, b.t) AS t FROM views a JOIN views b ON a.vec_id < b.vec_id)"
NEAREST = VIEWS + """, every AS (SELECT a.vec_id, b.vec_id AS o, round(list_dot_product(a.s, b.s), 12) AS s, round(list_dot_product(a.t, b.t), 12) AS t FROM views a JOIN views b ON a.vec_id <> b.vec_id),
    nearest AS (SELECT vec_id, (min(struct_pack(k := -s, o := o))).o AS s_nn, (min(struct_pack(k := -t, o := o))).o AS t_nn FROM every GROUP BY 1)"""


def _views(spark: SparkSession, sf: str) -> DataFrame:
    """Of the rows that pair metrics are defined on."""
    return vectors.pairs_of_views(vectors.metric_rows(table(spark, sf, "embeddings")))


def _all_views(spark: SparkSession, sf: str) -> DataFrame:
    """Of every row: for means and moments."""
    return vectors.pairs_of_views(table(spark, sf, "embeddings"))


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, {UNIT.format('e', '1e-12')} AS v FROM e) SELECT vec_id, unnest(range(64))::INT AS dim, round(unnest(v), 6) AS x FROM u")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", arrays.unit(arrays.doubles(F.col("embedding"))).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH e AS (SELECT vec_id, (embedding::DOUBLE[])[1:32] AS e FROM embeddings), u AS (SELECT vec_id, {UNIT.format('e', '1e-12')} AS v FROM e) SELECT vec_id, unnest(range(32))::INT AS dim, round(unnest(v), 6) AS x FROM u")
def matryoshka(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", arrays.truncated(arrays.doubles(F.col("embedding")), 32).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("WITH p AS (SELECT unnest(range(64))::INT AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT dim, round(avg(x), 6) AS mean FROM p GROUP BY 1")
def mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.mean_vector(table(spark, sf, "embeddings")).withColumn("mean", F.round("mean", 6))


@query("""WITH p AS (SELECT vec_id, unnest(range(64))::INT AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings), c AS (SELECT vec_id, dim, x - avg(x) OVER (PARTITION BY dim) AS x FROM p)
    SELECT vec_id, dim, round(x / (sqrt(sum(x * x) OVER (PARTITION BY vec_id)) + 1e-8), 6) AS x FROM c""")
def center_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.centred(table(spark, sf, "embeddings")).select("vec_id", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10")
def retrieval_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return vectors.top_k(rows, rows.where("vec_id = 0"), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {PAIRS} SELECT count(*) AS pairs, round(avg(s), 6) AS mean_s, round(avg(t), 6) AS mean_t, round(min(t), 6) AS least_t, round(max(t), 6) AS most_t FROM pairs")
def pairwise_cosine(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c, n: F.round(c, 6).alias(n)
    return vectors.cosines(_views(spark, sf)).agg(F.count(F.lit(1)).alias("pairs"), r(F.avg("s"), "mean_s"), r(F.avg("t"), "mean_t"), r(F.min("t"), "least_t"), r(F.max("t"), "most_t"))


@query(f"WITH {NEAREST} SELECT * FROM nearest")
def nn_top1(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.neighbours(_views(spark, sf))


@query(f"WITH {NEAREST} SELECT round(avg((s_nn = t_nn)::INT), 6) AS top1_nn_agreement FROM nearest")
def nn_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.neighbours(_views(spark, sf)).agg(F.round(F.avg((F.col("s_nn") == F.col("t_nn")).cast("double")), 6).alias("top1_nn_agreement"))


@query(f"WITH {PAIRS} SELECT round(covar_pop(s, t) / (sqrt(var_pop(s) * var_pop(t)) + 1e-12), 6) AS pearson FROM pairs")
def pearson_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.cosines(_views(spark, sf)).agg(F.round(vectors.pearson("s", "t"), 6).alias("pearson"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with the ordinal ranks of both cosines (ties by the pair), from 0."""
    pairs = vectors.cosines(_views(spark, sf)).withColumns({"s": F.round("s", 10), "t": F.round("t", 10)})
    return with_ordinal(with_ordinal(pairs, "rs", "s", "i", "j"), "rt", "t", "i", "j")


RANKED = PAIRS + ", ranked AS (SELECT (row_number() OVER (ORDER BY round(s, 10), i, j))::DOUBLE AS rs, (row_number() OVER (ORDER BY round(t, 10), i, j))::DOUBLE AS rt FROM pairs)"


@query(f"WITH {RANKED} SELECT round(covar_pop(rs, rt) / (sqrt(var_pop(rs) * var_pop(rt)) + 1e-12), 5) AS spearman FROM ranked")
def spearman_agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ranked(spark, sf).select(F.col("rs").cast("double").alias("rs"), F.col("rt").cast("double").alias("rt"))
    return rows.agg(F.round(vectors.pearson("rs", "rt"), 5).alias("spearman"))


@query(f"WITH {NEAREST}, pairs AS (SELECT * FROM every WHERE vec_id < o) SELECT (SELECT round(covar_pop(s, t) / (sqrt(var_pop(s) * var_pop(t)) + 1e-12), 6) FROM pairs) AS pearson, (SELECT round(avg((s_nn = t_nn)::INT), 6) FROM nearest) AS top1_nn_agreement, (SELECT count(*) FROM views) AS n")
def similarity_agreement(spark: SparkSession, sf: str) -> DataFrame:
    views = _views(spark, sf)
    one = vectors.cosines(views).agg(F.round(vectors.pearson("s", "t"), 6).alias("pearson"))
    two = vectors.neighbours(views).agg(F.round(F.avg((F.col("s_nn") == F.col("t_nn")).cast("double")), 6).alias("top1_nn_agreement"), F.count(F.lit(1)).alias("n"))
    return one.crossJoin(two)


@query(f"WITH {ALL_VIEWS} SELECT round(avg(1 - list_dot_product(s, t[1:32])), 6) AS loss FROM all_views")
def loss_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """The student's view against the teacher's first components (a student has the teacher's width)."""
    return _all_views(spark, sf).agg(F.round(F.avg(1 - arrays.dot(F.col("s"), F.slice("t", 1, 32))), 6).alias("loss"))


@query(f"WITH {VIEWS} SELECT round(avg(power(list_dot_product(a.s, b.s) - list_dot_product(a.t, b.t), 2)), 6) AS loss FROM all_views a, all_views b")
def loss_gram_mse(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.gram_mse(_all_views(spark, sf)).select(F.round("loss", 6).alias("loss"))


SOFT_LOSSES = """, z AS (SELECT a.vec_id, list_dot_product(a.s, b.s) / 0.05 AS zs, list_dot_product(a.t, b.t) / 0.05 AS zt FROM {0} a JOIN {0} b ON a.vec_id <> b.vec_id{1}),
    m AS (SELECT *, max(zs) OVER w AS ms, max(zt) OVER w AS mt FROM z WINDOW w AS (PARTITION BY vec_id)), e AS (SELECT *, sum(exp(zs - ms)) OVER w AS es, sum(exp(zt - mt)) OVER w AS et FROM m WINDOW w AS (PARTITION BY vec_id)),
    l AS (SELECT vec_id, -sum(exp(zt - mt) / et * (zs - ms - ln(es))) AS loss FROM e GROUP BY 1)"""
SOFT = VIEWS + SOFT_LOSSES.format("views", "")
BATCHED = ALL_VIEWS + ", batched AS (SELECT *, (row_number() OVER (ORDER BY sha1(concat_ws('|', vec_id, 0)), vec_id) - 1) // 256 AS batch FROM all_views)"


@query(f"WITH {SOFT} SELECT round(avg(loss), 6) AS loss FROM l")
def loss_kl(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.soft_retrieval(_views(spark, sf)).agg(F.round(F.avg("loss"), 6).alias("loss"))


@query(f"WITH {BATCHED}{SOFT_LOSSES.format('batched', ' AND a.batch = b.batch')} SELECT batch, count(*) AS n, round(avg(loss), 6) AS loss FROM l JOIN batched USING (vec_id) GROUP BY 1")
def loss_kl_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Every row, in batches of 256: each batch's mean."""
    each = vectors.soft_retrieval_batches(_all_views(spark, sf))
    return each.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


@query(f"WITH {SOFT} SELECT round(1.0 * (SELECT avg(1 - list_dot_product(s, t[1:32])) FROM all_views) + 0.5 * (SELECT avg(loss) FROM l), 6) AS loss")
def loss_combined(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine part of all rows; the other compares pairs."""
    views = _views(spark, sf)
    one = _all_views(spark, sf).agg(F.avg(1 - arrays.dot(F.col("s"), F.slice("t", 1, 32))).alias("a"))
    return one.crossJoin(vectors.soft_retrieval(views).agg(F.avg("loss").alias("b"))).select(F.round(F.col("a") + 0.5 * F.col("b"), 6).alias("loss"))


@query(f"WITH {ALL_VIEWS} SELECT round(avg(list_dot_product(a.t, b.t)), 6) AS mean_cosine FROM all_views a JOIN all_views b ON a.vec_id < b.vec_id")
def geometry_mean_cos(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.mean_cosine(_all_views(spark, sf).select(F.col("t").alias("v"))).select(F.round("mean_cosine", 6).alias("mean_cosine"))


@query(f"WITH {PAIRS} SELECT round(stddev_pop(t), 6) AS cosine_sd FROM pairs")
def geometry_cos_sd(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.cosines(_views(spark, sf)).agg(F.round(F.stddev_pop("t"), 6).alias("cosine_sd"))


@query(f"""WITH {ALL_VIEWS}, p AS (SELECT vec_id, unnest(range(64)) AS d, unnest(t) AS x FROM all_views), c AS (SELECT vec_id, d, x - avg(x) OVER (PARTITION BY d) AS x FROM p),
    s AS (SELECT a.d AS a, b.d AS b, sum(a.x * b.x) AS c FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2) SELECT round(power(sum(c) FILTER (a = b), 2) / sum(c * c), 4) AS participation_ratio FROM s""")
def geometry_pr(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.participation_ratio(_all_views(spark, sf).select(F.col("t").alias("v"))).select(F.round("participation_ratio", 4).alias("participation_ratio"))


@query()
def geometry_erank(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.effective_rank(_all_views(spark, sf).select(F.col("t").alias("v")))


@query(f"""WITH {NEAREST}, k AS (SELECT v.vec_id, count(n.vec_id)::DOUBLE AS k FROM views v LEFT JOIN nearest n ON n.t_nn = v.vec_id GROUP BY 1), m AS (SELECT avg(k) AS m, stddev_pop(k) AS sd FROM k)
    SELECT round(avg(power(k - m, 3)) / (max(power(sd, 3)) + 1e-12), 6) AS hub_skew FROM k, m""")
def geometry_hub_skew(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.hub_skew(vectors.neighbours(_views(spark, sf)), "t_nn").select(F.round("hub_skew", 6).alias("hub_skew"))
