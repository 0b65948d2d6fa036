"""Operators against plain restatements: boundaries, growth, order, resumption."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, hashing, numbers, text
from tessera.operators import cache, corpus, features, learning, limits, statistics, tokens, vectors
from tessera.operators.ordering import with_ordinal
from tessera.sources import readers


def col(spark, values, expression, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


SPACES = "plain. next! x?\ny… nb. em\n\n\n a  b\t\tc \x0b"


def test_sentences_follow_the_rule(spark):
    values = [SPACES, "", None, "One. Two.Three", ".\n.", " lead\n"]
    plain = lambda t: [re.sub(r"\s+", " ", p).strip() for p in re.split(r"(?<=[.!?…])\s+|\n+", t or "")]
    assert col(spark, values, text.sentences) == [plain(v) for v in values]


def test_length_boundaries(spark):
    docs = spark.createDataFrame([(1, "a" * 200), (2, "a" * 201), (3, None), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in corpus.long_documents(docs).collect()] == [2]
    rows = spark.createDataFrame([(n, "b" * n) for n in (19, 20, 300, 301)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus.sentences(rows).collect()) == [20, 300]


def test_georgian_script_by_default(spark):
    rows = spark.createDataFrame([(1, "ქართული ენა არის ქართველური ენა."), (2, "no such letters in this one.")], "doc_id long, text string")
    assert [r.doc_id for r in corpus.sentences(rows, script=text.GEORGIAN).collect()] == [1]


def test_document_hash(spark):
    def plain(doc, seed):
        x = (doc * 0x9E3779B1 + seed * 0x85EBCA6B) & 0xFFFFFFFF
        x ^= x >> 16
        x = x * 0x7FEB352D & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 0x846CA68B & 0xFFFFFFFF
        return (x ^ x >> 16) / 2**32

    for seed in (0, 3, 12345):
        got = col(spark, [0, 1, 2, 77, 2**31, 2**32 - 1, 2**40 + 5], lambda x: hashing.split_hash(x, seed), "x long")
        assert got == [plain(d, seed) for d in (0, 1, 2, 77, 2**31, 2**32 - 1, 2**40 + 5)]


def test_content_hashes(spark):
    values = ["", "abc", "ქართული", "x" * 500]
    assert col(spark, values, lambda x: hashing.content_bucket(x, 9)) == [int(hashlib.sha1(f"9\x00{v}".encode()).hexdigest(), 16) % 1_000_000 for v in values]
    assert col(spark, values, lambda x: hashing.content_order(x, 9)) == [hashlib.sha1(f"9\x01{v}".encode()).hexdigest()[:16] for v in values]
    assert col(spark, values, lambda x: hashing.cache_key(x, "m", "query", 0)) == [hashlib.sha1(f"m|query|full\x00{v}".encode()).hexdigest() for v in values]


def test_config_key_names_the_backend_only_if_other(spark):
    one = lambda **k: col(spark, ["chash"], lambda x: hashing.config_key(x, "m", "passage", 8, 512, "", **k))[0]
    assert one() == hashlib.sha1(b"m|passage|8|512|\x00chash").hexdigest()[:16]
    assert one(backend="vllm") == hashlib.sha1(b"m|passage|8|512||vllm\x00chash").hexdigest()[:16]


def test_split_is_stable_when_the_corpus_grows(spark):
    found = spark.createDataFrame([(i, 0, f"sentence number {i}") for i in range(100)], "doc_id long, sent_pos int, sentence string")
    few = {r.doc_id for r in corpus.content_split(found.where("doc_id < 60"), 0.3, 0).where("is_val").collect()}
    many = {r.doc_id for r in corpus.content_split(found, 0.3, 0).where("is_val").collect()}
    assert few == {d for d in many if d < 60} and len(many) > 10


def test_subset_follows_the_text_not_its_place(spark):
    rows = [(i, 0, f"sentence number {i}") for i in range(500)]
    pick = lambda r: {x.sentence for x in corpus.metric_subset(spark.createDataFrame(r, "doc_id long, sent_pos int, sentence string"), 50, 0).collect()}
    turned = [(499 - i, 0, s) for i, _, s in rows]
    assert pick(rows) == pick(turned) and len(pick(rows)) == 50


def test_first_occurrence_stays(spark):
    rows = [(2, 0, "b"), (1, 1, "b"), (1, 0, "a"), (3, 0, "a"), (3, 1, "c")]
    found = spark.createDataFrame(rows, "doc_id long, sent_pos int, sentence string")
    assert sorted(map(tuple, corpus.first_distinct(found, 2).collect())) == [(0, 1, "a"), (1, 1, "b")]


def test_text_column_choice(spark):
    pick = lambda s: corpus.pick_text_column(spark.createDataFrame([], s).schema)
    assert (pick("id int, body string, content string"), pick("id int, note string"), pick("id int, n int")) == ("content", "note", "id")


def test_ordinals_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert sorted((r.k, r.o) for r in with_ordinal(rows, "o", "k").collect()) == [(i, i) for i in range(1000)]
    assert with_ordinal(rows.where("k < 0"), "o", "k").count() == 0


def test_row_layouts(spark):
    ids = F.array(*[F.lit(i) for i in (10, 11, 12)])
    row = spark.range(1).select(arrays.framed(ids, 8).alias("f"), arrays.padded(ids, 2).alias("cut"), arrays.padded(ids, 5).alias("pad")).first()
    assert (row.f, row["cut"], row.pad) == ([3, 10, 11, 12, 4, 0, 0, 0], [10, 11], [10, 11, 12, 0, 0])
    assert col(spark, ["é!", "", None], text.utf8_tokens) == [[200, 174, 38], [], []]


def test_windows_by_slices(spark):
    docs = spark.createDataFrame([(n, "a" * n) for n in (0, 31, 32, 126, 126 + 31, 126 + 32, 400)], "doc_idx long, text string")
    got = sorted((r.doc_idx, r.win_idx, len([i for i in r.ids if i >= 5])) for r in tokens.byte_windows(docs).collect())
    want = [(n, k, min(126, n - k * 126)) for n in (0, 31, 32, 126, 157, 158, 400) for k in range(-(-n // 126)) if min(126, n - k * 126) >= 32]
    assert got == want
    counted = {r.doc_idx: r.c for r in docs.select("doc_idx", tokens.window_counts(F.length("text"), 128, 32).alias("c")).collect()}
    assert counted == {n: sum(1 for w in want if w[0] == n) for n in counted}


def test_mask_contract(spark):
    rows = [(0, 0, [3, *range(10, 20), 4] + [0] * 5), (1, 0, [3, 4] + [0] * 15), (2, 0, [3, *range(10, 20), 4] + [0] * 5)]
    windows = spark.createDataFrame(rows, "doc_idx long, win_idx int, ids array<int>")
    made = {r.doc_idx: r for r in tokens.masked_examples(windows, 17, 0.30, seed=1).collect()}
    for i, (_, _, ids) in enumerate(rows):
        r, n = made[i], (3 if i != 1 else 0)
        assert len(r.positions) == len(r.targets) == len(r.weights) == 5 and sum(r.weights) == n
        for p, t in list(zip(r.positions, r.targets, strict=True))[:n]:
            assert ids[p] == t >= 5 and r.input_ids[p] == 1
        assert sum(a != b for a, b in zip(ids, r.input_ids, strict=True)) == n
    assert made[0].positions != made[2].positions
    again = {r.doc_idx: r for r in tokens.masked_examples(windows.where("doc_idx = 2"), 17, 0.30, seed=1).collect()}
    assert again[2] == made[2]


def test_schedules(spark):
    rows = spark.range(1001).select(numbers.trapezoid(F.col("id"), 1000, 1.0).alias("t"), numbers.warmup_cosine(F.col("id"), 1000, 1.0, 100).alias("c")).collect()
    assert rows[0].t == 0 and rows[30].t == rows[849].t == 1 and rows[1000].t == 0 and rows[100].c == 1
    assert math.isclose(rows[1000].c, 0.1) and numbers.n_predictions(0.15, 128) == 19


def test_cache_resumes_to_the_same(spark):
    sents = spark.createDataFrame([(i, f"k{i % 7}") for i in range(20)], "pos long, k string")
    held = spark.createDataFrame([("k1", [1.0]), ("k2", [2.0])], "k string, e array<float>")
    rest = cache.missing(sents, held).select("k").distinct()
    assert sorted(r.k for r in rest.collect()) == ["k0", "k3", "k4", "k5", "k6"]
    whole = held.unionByName(rest.withColumn("e", F.array(F.lit(0.0).cast("float"))))
    assert cache.missing(sents, whole).count() == 0 and cache.aligned(sents, whole).count() == 20
    row = cache.coverage(sents, cache.aligned(sents, held)).first()
    assert (row.input_total, row.embedded, row.coverage, row.complete) == (20, 6, 0.3, False)
    none = cache.coverage(sents.limit(0), sents.limit(0)).first()
    assert (none.coverage, none.complete) == (0.0, True)


def test_last_cache_line_wins(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text('{"k":"a","e":[1]}\n\n{"k":"b","e":[2]}\n{"k":"a","e":[3]}\n')
    assert sorted((r.k, r.e) for r in readers.read_cache(spark, str(tmp_path / "c")).collect()) == [("a", [3.0]), ("b", [2.0])]


def test_shards(spark):
    ranges = lambda n, s: sorted(map(tuple, cache.shard_ranges(spark, n, s).collect()))
    assert ranges(100, 32) == [(0, 32), (32, 64), (64, 96), (96, 100)] and ranges(0, 8) == [] and ranges(5, 0) == [(0, 5)]
    done = spark.createDataFrame([(0, 32), (64, 96)], "shard_start long, shard_end long")
    rows = spark.range(100).withColumnRenamed("id", "pos")
    assert cache.rows_in_shards(rows, done, 32).count() == 64
    now = rows.withColumn("sentence", F.concat(F.lit("s"), "pos"))
    seed = lambda old: sorted(r.shard_start for r in cache.seedable(cache.shard_ranges(spark, 100, 32), cache.is_prefix(old, now)).collect())
    assert seed(now.where("pos < 70")) == [0, 32]
    assert seed(now.where("pos < 70").withColumn("sentence", F.when(F.col("pos") == 3, "other").otherwise(F.col("sentence")))) == []


@pytest.mark.parametrize("sizes,budget", [([4, 6, 7, 11, 12, 12, 19, 28, 40, 61], 120), ([80, 95, 110], 20), ([1, 5, 9, 9], 900), ([], 50)])
def test_micro_batches(spark, sizes, budget):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes)], "shard long, doc_id long, n long")
    got = [r.n_items for r in limits.micro_batches(rows, "shard", budget).orderBy("grp").collect()]
    assert sum(got) == len(sizes)
    at = 0
    for n in got:
        assert n == 1 or n * max(sizes[at : at + n]) <= budget
        assert at + n == len(sizes) or (n + 1) * max(sizes[at : at + n + 1]) > budget
        at += n


def test_limiter_replay_keeps_its_limits(spark):
    rng = random.Random(4)
    rows = [(i, 1_700_000_000 + rng.randint(0, 300), rng.randint(0, 1), float(rng.randint(1, 9))) for i in range(120)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").withColumn("ts", F.timestamp_seconds("s"))
    out = limits.replay(events, rpm=5, tpm=30.0).join(events, "event_id").collect()
    for user in (0, 1):
        starts = sorted((r.start_us, r.value) for r in out if r.user_id == user)
        for s, _ in starts:
            minute = [v for t, v in starts if s - 60_000_000 < t <= s]
            assert len(minute) <= 5 and sum(minute) <= 30.0
    assert all(r.waited_us >= 0 for r in out)


def test_trailing_minute_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 400_000_000)) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, us long").withColumns({"ts": F.timestamp_micros("us"), "value": F.lit(1.0)})
    got = {r.event_id: r.requests for r in limits.trailing(events).collect()}
    assert got == {i: sum(u - 60_000_000 < v <= u for _, v in rows) for i, u in rows}


def test_agreement_is_numpys(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(size=(24, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(t)]
    views = vectors.pairs_of_views(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 6)
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
    s, u = unit(t[:, :6]), unit(t)
    a, b = (s @ s.T)[np.triu_indices(24, 1)], (u @ u.T)[np.triu_indices(24, 1)]
    assert math.isclose(vectors.cosines(views).agg(vectors.pearson("s", "t")).first()[0], np.corrcoef(a, b)[0, 1], abs_tol=1e-9)
    assert math.isclose(vectors.gram_mse(views).first()[0], ((s @ s.T - u @ u.T) ** 2).mean(), abs_tol=1e-12)
    c = u - u.mean(axis=0)
    p = np.linalg.svd(c, compute_uv=False) ** 2
    p = p / p.sum()
    v = views.select(F.col("t").alias("v"))
    assert math.isclose(vectors.participation_ratio(v).first()[0], 1 / (p**2).sum(), rel_tol=1e-9)
    assert math.isclose(vectors.effective_rank(v).first()[0], np.exp(-(p * np.log(p + 1e-12)).sum()), rel_tol=1e-5)


def test_constant_vectors_and_guard(spark):
    rows = spark.range(5).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    views = vectors.pairs_of_views(rows, 1)
    assert vectors.cosines(views).agg(vectors.pearson("s", "t")).first()[0] == 0
    assert {r.vec_id: r.t_nn for r in vectors.neighbours(views).collect()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0}
    many = spark.range(10_001).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))
    with pytest.raises(ValueError, match="10000 rows"):
        vectors.cosines(vectors.pairs_of_views(many, 1))


def test_scores_of_small_classes(spark):
    rows = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(20)], "item long, label string")
    drawn = statistics.few_shot(rows, 8, 2).groupBy("draw", "label").count().collect()
    assert {(r.draw, r.label): r["count"] for r in drawn} == {(d, x): n for d in (0, 1) for x, n in (("a", 3), ("b", 8))}
    one = spark.createDataFrame([(1, 1)] * 4, "y int, c int")
    assert statistics.v_measure(one).first()[0] == 1.0 and statistics.adjusted_rand(one).first()[0] == 1.0
    assert statistics.macro_f1(spark.createDataFrame([(0, 1), (0, 0), (2, 2)], "y int, p int")).first()[0] == pytest.approx((2 / 3 + 0 + 1) / 3)


def test_bootstrap_brackets_the_mean(spark):
    rows = spark.range(200).select(F.col("id").alias("ord"), (F.col("id") % 4 == 0).cast("double").alias("x"))
    row = statistics.bootstrap(rows, 300).first()
    assert row.mean == 0.25 and 0.17 < row.lo < 0.25 < row.hi < 0.33


def test_features_have_unit_length(spark):
    rows = spark.createDataFrame([(0, "red fish blue fish"), (1, "one fish two fish"), (2, "red red wine")], "item_id long, text string")
    for made in (features.tfidf(rows, features.word_terms(F.col("text"))).withColumnRenamed("weight", "x"), features.trigram_projection(rows, 8)):
        sums = made.groupBy("item_id").agg(F.sum(F.col("x") * F.col("x")).alias("s")).collect()
        assert all(r.s == pytest.approx(1.0) for r in sums)
    assert col(spark, ["ab cdef", "a"], features.edge_grams) == [[" ab", "ab ", " ab ", " cd", "cde", "def", "ef ", " cde", "cdef", "def ", " cdef", "cdef "], [" a "]]


def test_clusters_and_probe_find_separate_classes(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 6)) * 4
    rows = [(i, i % 4, [float(x) for x in centre[i % 4] + rng.normal(size=6)]) for i in range(120)]
    rows = spark.createDataFrame(rows, "item long, label int, embedding array<double>")
    assert statistics.accuracy(learning.few_shot_probe(rows, draws=1)).first()["mean"] > 0.9
    found = learning.clustered(rows.withColumn("ord", F.col("item")), 120, 4, runs=1)
    assert statistics.v_measure(found).first()[0] > 0.8


def test_weights_of_held_and_of_joined_terms_are_the_same(spark, monkeypatch):
    texts = [(i % 30 if i % 17 else None, " ".join(f"w{j}" for j in range(2, 60) if i % j == 0 or j > 50 - i % 7) + " w2 w2") for i in range(1, 90)] + [(31, None), (32, "")]
    rows = spark.createDataFrame(texts, "item_id long, text string").repartition(5)
    tf = collections.Counter((i, t) for i, text in texts for t in (text or "").split())
    df = collections.Counter(t for _, t in tf)
    w = {k: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[k[1]])) + 1) for k, n in tf.items() if df[k[1]] >= 2}
    norms = collections.Counter()
    for (i, _), x in w.items():
        norms[i] += x * x
    want = {k: pytest.approx(x / math.sqrt(norms[k[0]])) for k, x in w.items()}
    for most in (1 << 19, 7, 1):
        monkeypatch.setattr(features, "HELD_TERMS", most)
        made = features.tfidf(rows, features.word_terms(F.col("text")))
        got = made.collect()
        assert len(got) == len(want) and {(r.item_id, r.term): r.weight for r in got} == want
        plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # before, every entry was exchanged by its term and twice by its item
        assert most < 1 << 19 or plan.count("Exchange hashpartitioning") == 1
