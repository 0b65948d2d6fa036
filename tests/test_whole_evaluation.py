"""Evaluation queries with all draws, dimensions, resamples and labels."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import learning


def test_probe_has_ten_draws(spark, sf, monkeypatch):
    seen = []
    probe = learning.few_shot_probe
    monkeypatch.setattr(learning, "few_shot_probe", lambda rows, per_label=8, draws=10, seed=0: (seen.append(draws), probe(rows, per_label, 1, seed))[1])
    plans.QUERIES["few_shot_probe"](spark, sf)
    assert seen == [10]


def test_lsa_has_all_dimensions(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    assert plans.QUERIES["lsa"](spark, sf).agg(F.max("dim")).first()[0] + 1 == min(300, items - 1)


def test_clustering_is_resampled_with_a_cluster_a_label(spark, tmp_path):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(3, 6)) * 9
    rows = [(i, i % 3, [float(x) for x in centre[i % 3] + rng.normal(size=6)]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    row = plans.QUERIES["clustering_scores"](spark, str(tmp_path)).first()
    assert (row.n, row.n_clusters) == (60, 3) and row.v_measure > 0.8 and row.v_measure_sd >= 0 and row.ari > 0.7


def number(*parts):
    return int(hashlib.sha1("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def plain_minibatch(points, n, k, run, start, steps, seed):
    """One start of mini-batch k-means in plain NumPy, point after point, with the same draws."""
    order = [number(run, number("batch", run, start, slot, seed) % n, seed) % n for slot in range(1500 + steps * 500)]
    rng = np.random.default_rng([seed, run, start])
    first = points[order[:1500]]
    centres = [first[rng.integers(1500)]]
    while len(centres) < k:
        gap = np.array([min(((p - c) ** 2).sum() for c in centres) for p in first])
        total = gap.cumsum()
        centres.append(first[int((total <= rng.random() * total[-1]).sum())])
    centres, seen = np.array(centres), [0] * k
    for step in range(steps):
        batch = points[order[1500 + step * 500 : 2000 + step * 500]]
        near = [min(range(k), key=lambda c: ((p - centres[c]) ** 2).sum()) for p in batch]
        for c in range(k):  # one point at a time, with the rate 1 / (points seen so far)
            for p, own in zip(batch, near, strict=True):
                if own == c:
                    seen[c] += 1
                    centres[c] = centres[c] + (p - centres[c]) / seen[c]
    return centres


def test_minibatch_centres_are_the_plain_ones(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(90, 4)) + rng.integers(0, 3, size=(90, 1)) * 5
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "ord long, embedding array<double>")
    found = learning.minibatch_centres(rows, 90, 3, runs=2, starts=2, steps=3, seed=5).collect()
    assert len(found) == 4
    for r in found:
        assert np.allclose(r.centres, plain_minibatch(points, 90, 3, r.run, r.start, 3, 5))


def test_the_best_start_is_taken_over_the_whole_resample(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(70, 3)) + rng.integers(0, 4, size=(70, 1)) * 6
    rows = spark.createDataFrame([(i, 1000 + i, 0, [float(x) for x in p]) for i, p in enumerate(points)], "ord long, item long, label int, embedding array<double>")
    centres = {(r.run, r.start): np.array(r.centres) for r in learning.minibatch_centres(rows, 70, 4, runs=2, starts=3, steps=2, seed=1).collect()}
    got = {}
    for r in learning.clustered(rows, 70, 4, runs=2, seed=1, steps=2).collect():
        got.setdefault(r.run, []).append((r["item"] - 1000, r.c))
    for run in (0, 1):
        drawn = [number(run, i, 1) % 70 for i in range(70)]
        gap = {s: np.array([((points[i] - centres[run, s]) ** 2).sum(axis=1) for i in drawn]) for s in range(3)}
        best = min(range(3), key=lambda s: gap[s].min(axis=1).sum())
        assert sorted(got[run]) == sorted((i, int(g.argmin())) for i, g in zip(drawn, gap[best], strict=True))
