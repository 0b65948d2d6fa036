"""op5 against brute force."""

import numpy as np
import pytest

from tessera.llm import ann, queries


def brute(rows, k=10, every=100):
    """(query_id, rank, vec_id, score) over (vec_id, vector) rows that take part, each length by itself."""
    rows = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = []
    for n, (q, v) in enumerate(rows):
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for m, (i, x) in enumerate(rows) if m != n and len(x) == len(v))
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return sorted(out)


def result(df, **options):
    return sorted(map(tuple, ann.nearest(df, df.vec_id % 100 == 0, **options).collect()))


def test_exact_at_factor_one(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got, want = result(df, shard_rows=60), brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-14)


@pytest.mark.parametrize("dim", [2, 16])
def test_ties_copies_and_awkward_vectors(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(round(x, 1)) for x in rng.normal(size=dim)]) for i in range(400)]
    rows += [(1000 + i, [1.0] * dim) for i in range(300)] + [(100, rows[3][1]), (100, rows[3][1])]
    rows += [(2000, None), (2100, []), (2200, [0.0] * dim), (2300, [None] + [1.0] * (dim - 1)), (2400, [float("nan")] * dim), (2500, [float("inf")] * dim), (None, [1.0] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    rows += [(2600 + 50 * i, [float(i)] * (dim + 1)) for i in range(5)] + [(3000, [2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, row string, cell int")
    got, want = result(df, shard_rows=70), brute(rows)
    assert [x[:3] for x in got] == [x[:3] for x in want]


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert result(spark.createDataFrame([], schema)) == []
    assert result(spark.createDataFrame([(100, [1.0, 2.0])], schema)) == []
    assert [x[:3] for x in result(spark.createDataFrame([(100, [1.0, 2.0]), (7, [1.0, 1.0])], schema))] == [(100, 1, 7)]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = {x[:1] + x[2:3] for x in brute([(r.vec_id, r.embedding) for r in df.collect()])}
    got = {(r.query_id, r.vec_id) for r in queries.QUERIES["op5_vantage_point_search"](spark, sf).collect()}
    assert len(got & want) / len(want) >= 0.95
