"""Searches in chunks and blocks, losses in batches, against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from tessera.operators import vectors


@pytest.mark.parametrize("chunk, block", [(16_384, 8_192), (17, 3), (1, 100)])
def test_top_k_of_each_query_is_that_of_a_full_sort(spark, chunk, block):
    rng = np.random.default_rng(6)
    e = np.concatenate([rng.normal(size=(60, 5)), np.tile([1.0, 0, 0, 0, 0], (12, 1))])  # ties among copies
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)] + [(900, None)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in vectors.top_k_each(rows, rows.where("vec_id % 10 = 0"), 4, chunk, block).collect())
    unit = e / (np.linalg.norm(e, axis=1, keepdims=True) + 1e-12)
    want = []
    for q in range(0, len(e), 10):
        ranked = sorted((-round(float(unit[q] @ v), 9), i) for i, v in enumerate(unit))[:4]
        want += [(q, r + 1, i, pytest.approx(-s, abs=2e-9)) for r, (s, i) in enumerate(ranked)]
    assert got == want


def test_top_k_of_few_or_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in sorted(vectors.top_k_each(rows, rows.where("vec_id = 2"), 5).collect())] == [(1, 2), (2, 1)]
    assert vectors.top_k_each(rows.limit(0), rows, 5).count() == vectors.top_k_each(rows, rows.limit(0), 5).count() == 0


def test_a_batch_of_one_has_no_loss_and_others_are_plain(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=(13, 40))
    views = vectors.pairs_of_views(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "vec_id long, embedding array<double>"))
    got = {(r.batch, r.vec_id): r.loss for r in vectors.soft_retrieval_batches(views, batch=4).collect()}
    order = sorted(range(13), key=lambda i: hashlib.sha1(f"{i}|0".encode()).hexdigest())
    want = {}
    for batch, at in enumerate(range(0, 12, 4)):
        own = order[at : at + 4]
        for i in own:
            logs = []
            for d in (32, 40):
                z = {j: float(e[i, :d] @ e[j, :d] / np.linalg.norm(e[i, :d]) / np.linalg.norm(e[j, :d])) / 0.05 for j in own if j != i}
                top = max(z.values()) + math.log(math.fsum(math.exp(x - max(z.values())) for x in z.values()))
                logs.append({j: x - top for j, x in z.items()})
            want[batch, i] = -math.fsum(math.exp(logs[1][j]) * logs[0][j] for j in logs[0])
    assert got == pytest.approx(want, abs=1e-9)  # order[12] is alone
    assert vectors.soft_retrieval_batches(views.limit(0)).count() == 0
