"""Losses and moments take every row, also where pair metrics take their subset."""

import math

import numpy as np
import pytest

from tessera import plans
from tessera.operators import vectors


def test_rows_over_the_subset_count(spark, tmp_path):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(vectors.METRIC_ROWS + 300, 36)) + 0.3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(e)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1))[:, None]
    t, s, n = unit(e), unit(e[:, :32]), len(e)
    # pair after pair, a row of pairs at a time
    cosines, gaps = 0.0, 0.0
    for i in range(n):
        of_t, of_s = t @ t[i], s @ s[i]
        gaps += float(((of_s - of_t) ** 2).sum())
        cosines += float(of_t[:i].sum() + of_t[i + 1 :].sum())
    # the scatter matrix's eigenvalues, as shares of its trace
    scatter = sum(np.outer(x, x) for x in t) - n * np.outer(t.mean(axis=0), t.mean(axis=0))
    share = [max(x, 0.0) / np.trace(scatter) for x in np.linalg.eigvalsh(scatter)]
    want = {
        "loss_cosine": sum(1 - float(a @ b[:32]) for a, b in zip(s, t, strict=True)) / n,
        "loss_gram_mse": gaps / n**2,
        "geometry_mean_cos": cosines / (n * (n - 1)),
        "geometry_pr": 1 / math.fsum(x * x for x in share),
        "geometry_erank": math.exp(-math.fsum(x * math.log(x + 1e-12) for x in share)),
    }
    for name, value in want.items():
        assert plans.QUERIES[name](spark, str(tmp_path)).first()[0] == pytest.approx(value, abs=1e-4 if name == "geometry_pr" else 2e-6), name
