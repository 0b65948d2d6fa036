"""Orders, samples, losses, windows and published folders against plain restatements."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import text
from tessera.operators import batches, features, limits, statistics, tokens, training
from tessera.sources import artifacts, readers
from tessera.sources.work import scratch_path


@pytest.mark.parametrize("n, k", [(0, 5), (1, 5), (2, 5), (40, 100), (40, 780), (40, 10_000)])
def test_pairs_are_different_and_in_order(spark, n, k):
    pairs = [(r.i, r.j) for r in batches.pair_sample(spark, n, k, seed=3).collect()]
    assert len(pairs) == len(set(pairs)) == min(k, n * (n - 1) // 2)
    assert all(0 <= i < j < n for i, j in pairs)


def test_least_by_hash_is_the_sorted_prefix(spark):
    rows = spark.range(5000)
    got = sorted(r.id for r in batches.least_by_hash(rows, 777, F.col("id"), 4).collect())
    import hashlib

    want = sorted(range(5000), key=lambda i: hashlib.sha1(f"{i}|4".encode()).hexdigest())[:777]
    assert got == sorted(want)


def test_epochs_cover_all_rows_in_other_orders(spark):
    rows = batches.epochs(spark.range(100).withColumnRenamed("id", "vec_id"), "vec_id", 1, 3).collect()
    orders = [[r.vec_id for r in sorted(rows, key=lambda r: r.pos) if r.epoch == e] for e in range(3)]
    assert all(sorted(o) == list(range(100)) for o in orders) and len(set(map(tuple, orders))) == 3
    whole = batches.batched(spark.createDataFrame(rows), 32)
    assert whole.groupBy("epoch").count().collect()[0]["count"] == 96


def plain_windows(raw, length, least):
    body, out = length - 2, []
    for at in range(0, len(raw), body):
        piece = [b + 5 for b in raw[at : at + body]]
        if len(piece) >= least:
            out.append([3, *piece, 4] + [0] * (body - len(piece)))
    return out


def test_byte_windows_of_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(tokens, "STEP_WINDOWS", 3)
    rng = random.Random(2)
    texts = [None, "", "x" * 31, "y" * 32, "ж" * 63, "z" * 126, "z" * 127, "z" * 157, "z" * 158] + ["".join(rng.choices("abcдß€", k=rng.randint(0, 700))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string").repartition(3)
    got = sorted((r.doc_idx, r.win_idx, list(r.ids)) for r in tokens.byte_windows(df).collect())
    want = [(i, w, ids) for i, t in enumerate(texts) for w, ids in enumerate(plain_windows((t or "").encode(), 128, 32))]
    assert got == want
    assert tokens.byte_windows(df.limit(0)).count() == 0


def test_bootstrap_is_the_same_held_or_joined(spark, monkeypatch):
    rng = random.Random(7)
    scores = spark.createDataFrame([(i, rng.random()) for i in range(150)], "ord long, x double")
    held = statistics.bootstrap(scores, 60).first()
    monkeypatch.setattr(statistics, "HELD_SCORES", 0)
    assert tuple(held) == pytest.approx(tuple(statistics.bootstrap(scores, 60).first()), abs=1e-12)


def test_folds_are_even_within_labels(spark):
    rows = spark.range(503).select(F.col("id").alias("item"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2).alias("label"))
    found = statistics.folds(rows).groupBy("label", "fold").count().collect()
    assert sum(r["count"] for r in found) == 503
    for label in (None, 0, 1):
        sizes = [r["count"] for r in found if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def replayed(batch, limited, broken, retries):
    """A call's fate, step by step."""
    waited, tries = 0.0, 0
    for _ in range(limited):
        tries += 1
        if tries > retries:
            return waited, True
        waited += min(60, 2**tries)
    return waited, False


def test_retries_step_by_step(spark):
    calls = [(i, i % 10, i % 12) for i in range(120)]
    rows = training.retry_plan(spark.createDataFrame(calls, "call int, limited int, broken int"), 100, 7).collect()
    for r in rows:
        _, limited, broken = calls[r.call]
        assert (r.waited, r.gave_up) == replayed(100, limited, broken, 7)
        size, skipped = 100, False
        for _ in range(broken):
            if size == 1:
                skipped = True
            size = max(1, size // 2)
        assert (r.batch, r.skipped) == (size, skipped)


def test_losses_without_slots_or_batches_are_zero(spark):
    none = spark.createDataFrame([], "ce double, w double")
    assert training.weighted_mean(none, "ce", "w").first().loss == 0.0
    assert training.weighted_mean(spark.createDataFrame([(2.0, 0.25)], none.schema), "ce", "w").first().loss == 0.5
    assert training.mean_of_first(spark.createDataFrame([], "batch int, loss double")).first().loss == 0.0


def test_pooling_counts_content_only(spark):
    row = spark.createDataFrame([([3, 9, 1, 5, 4, 0], [[float(i), 1.0] for i in range(6)]), ([3, 4], [[1.0, 1.0], [2.0, 2.0]])], "ids array<int>, states array<array<double>>")
    assert [r.p for r in row.select(training.pooled(F.col("ids"), F.col("states"), 2).alias("p")).collect()] == [[2.0, 1.0], [0.0, 0.0]]


def test_heads_must_divide_the_width(spark):
    with pytest.raises(Exception, match="do not divide"):
        spark.createDataFrame([(5,)], "h int").select(training.head_width(F.lit(768), F.col("h"))).collect()


def test_normal_form_is_that_of_the_standard(spark, sf):
    odd = ["ﬁne", "Å", "é", None, "", "plain", "①²", "ﷺ"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in odd], "t string").select(text.normalised(F.col("t")).alias("t")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in odd]
    import hashlib

    docs = {r.doc_id: hashlib.sha1(unicodedata.normalize("NFKC", r.text).encode()).hexdigest() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.digest for r in plans.QUERIES["normalised_texts"](spark, sf).collect()} == docs


def test_batch_encoding_is_that_of_one_by_one(spark, sf):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        raw = file.read()
    one = Tokenizer.from_str(raw)
    rows = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {r.item_id: one.encode(r.text, add_special_tokens=False).ids for r in rows.collect()}
    assert {r.item_id: list(r.ids) for r in readers.encode_with(rows, raw).collect()} == want
    docs = {r.doc_id: one.encode(r.text or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in plans.QUERIES["bpe_encode"](spark, sf).collect()} == {d: len(ids) for d, ids in docs.items()}
    pieces = [one.decode([i], skip_special_tokens=False) for i in {i for ids in docs.values() for i in ids}]
    found = plans.QUERIES["vocabulary_script"](spark, sf).first()
    assert (found.entries, found.with_script) == (len(pieces), sum(any("À" <= c <= "ɏ" for c in p) for p in pieces))


def test_a_failed_publication_changes_nothing(spark):
    path = scratch_path(spark, "published")
    artifacts.publish(spark, path, lambda p: spark.range(5).write.parquet(p))
    for write, check in ((lambda p: spark.range(9).write.parquet(p), lambda p: False), (lambda p: 1 / 0, None)):
        with pytest.raises((ValueError, ZeroDivisionError)):
            artifacts.publish(spark, path, write, check)
        assert spark.read.parquet(path).count() == 5
    store, where = artifacts._files(spark, path)
    assert not [x for x in store.listStatus(where.getParent()) if x.getPath().getName().startswith(where.getName() + ".")]


def test_states_of_an_empty_folder_and_of_a_missing_step(spark):
    folder = scratch_path(spark, "states")
    assert artifacts.read_state(spark, folder, "a int") is None
    artifacts.write_state(spark, folder, 4, spark.createDataFrame([(1,)], "a int"))
    assert artifacts.read_state(spark, folder, "a int, b int", 5) is None
    assert tuple(artifacts.read_state(spark, folder, "a int, b int").first()) == (4, 1, None)


def test_half_precision_of_nulls_and_empty_vectors(spark):
    rows = [[1.0, 0.1], None, [], [70000.0]]
    got = [r.e for r in spark.createDataFrame([(v,) for v in rows], "v array<float>").select(readers.as_half(F.col("v")).alias("e")).collect()]
    assert got[1] is None and got[2] == [] and got[0] == [1.0, float(np.float16(0.1))] and math.isinf(got[3][0])


def test_daily_caps_at_local_midnight(spark):
    rows = [(i, f"2024-05-0{1 + i // 5} {22 if i % 5 else 1}:0{i % 5}:00", 1.0) for i in range(15)]
    events = spark.createDataFrame(rows, "event_id long, t string, value double").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    plain = {r.event_id: r.admitted for r in limits.daily(events, 2).collect()}
    assert sorted(i for i, a in plain.items() if a) == [0, 1, 5, 6, 10, 11]
    days = {r.event_id: r.day for r in limits.daily(events, 2, "+03:00").collect()}
    assert days[1] == days[0] + 1 == days[5]
    assert all(r.admitted for r in limits.daily(events, 0).collect())


def test_latent_semantics_is_the_truncated_svd(spark):
    rng = np.random.default_rng(4)
    dense = rng.random((30, 5)) @ rng.random((5, 50)) + 0.01 * rng.random((30, 50))  # five topics and noise
    rows = [(i, f"t{j}", float(dense[i, j])) for i in range(30) for j in range(50) if dense[i, j]]
    weights = spark.createDataFrame(rows, "item_id long, term string, weight double").repartition(5)
    for dim in (5, 300):
        found = np.zeros((30, min(dim, 29)))
        for r in features.latent_semantics(weights, dim).collect():
            found[r.item_id, r.dim] = r.x
        u, s, _ = np.linalg.svd(dense)
        want = (u[:, : found.shape[1]] * s[: found.shape[1]])
        want /= np.linalg.norm(want, axis=1, keepdims=True)
        assert np.abs(found @ found.T - want @ want.T).max() < 1e-6


def test_trigram_projection_by_definition(spark):
    xxhash = pytest.importorskip("xxhash")

    def spark_hash(*parts):
        seed = 42
        for p in parts:
            raw = p.encode() if isinstance(p, str) else int(p).to_bytes(8 if isinstance(p, np.int64) else 4, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
        return seed - (1 << 64) if seed >> 63 else seed

    texts = ["some text here", "a", "", "ttt ttt"]
    got = np.zeros((4, 8))
    for r in features.trigram_projection(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"), 8).collect():
        got[r.item_id, r.dim] = r.x
    for i, t in enumerate(texts):
        padded, want = f" {t} ", np.zeros(8)
        for a in range(len(padded) - 2):
            bucket = np.int64(spark_hash(padded[a : a + 3]) % 65_536)
            for d in range(8):
                u, v = ((spark_hash(bucket, d, 0, tag) % (1 << 52) + 1) / (1 << 52) for tag in "ra")
                want[d] += math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)
        assert got[i] == pytest.approx(want / (np.linalg.norm(want) + 1e-12), abs=1e-9)


def test_probes_are_scored_on_rows_they_do_not_train_on(spark):
    from tessera.operators import learning

    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, i % 3, [float(x) for x in rng.normal(size=4) + 6 * (i % 3)]) for i in range(90)], "item long, label int, embedding array<double>")
    few = learning.few_shot_probe(rows, per_label=4, draws=2).collect()
    assert all(sum(r.run == d for r in few) == 90 - 12 for d in (0, 1)) and sum(r.y == r.p for r in few) / len(few) > 0.95
    folds = learning.cross_validated_probe(rows).collect()
    assert sorted(r.item for r in folds) == list(range(90)) and sum(r.y == r.p for r in folds) / 90 > 0.95
