"""op7 against a brute-force pass over all windows."""

import hashlib
import random

import pytest

from tessera.llm import substring_dedup
from tessera.llm.words import Words


def brute(rows, size=20):
    seen = {}
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is not None, i or 0)
    for i, words in docs:
        for p in range(len(words) - size + 1):
            key = tuple(words[p : p + size])
            seen[key] = min(seen.get(key, ((9,), 0)), (order(i), p))
    out = []
    for i, words in docs:
        gone = [False] * len(words)
        for p in range(len(words) - size + 1):
            if seen[tuple(words[p : p + size])] < (order(i), p):
                gone[p : p + size] = [True] * size
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df, **options):
    return sorted(map(tuple, substring_dedup.remove_repeats(df, **options).collect()), key=repr)


def test_words_are_runs_between_ascii_space():
    import pyarrow as pa

    texts = ["a bb\tccc  ", "", None, "d", " x\x0b\x0cÄ\xa0y ", "longer-than-eight-bytes longer-than-eight-bytez"]
    w = Words(pa.array(texts))
    want = [x for t in texts for x in (t or "").encode().split()]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)] == want
    assert len(set(w.hash.tolist())) == len(set(want))
    assert w.first.tolist() == [0, 3, 3, 3, 4, 6, 8]


def test_op7_over_documents(docs, odd, empty):
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert result(odd) == brute(rows)
    assert result(empty) == []


@pytest.mark.parametrize("seed", range(3))
def test_dense_repeats(spark, seed):
    """Few words and short windows: overlaps, self-overlaps, chains and copies."""
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 3)] + [(200, "a " * 40), (201, " b" + " a" * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, anchor in ((4, 2), (6, 6), (5, 1)):
        assert result(df, size=size, anchor=anchor) == brute(rows, size)


def test_kept_text(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, "start " + " ".join(words[10:45]) + " end"), (3, " ".join(words)), (4, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(df, with_text=True).collect()}
    assert got == {1: rows[0][1], 2: "start end", 3: "", 4: "short text"}


def test_a_hundred_thousand_copies_of_one_text(spark):
    """Copies of one text are dealt to several tasks: all but the first lose every word."""
    from pyspark.sql import functions as F

    hot = " ".join(f"w{i}" for i in range(25))
    df = spark.range(100_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit(hot).alias("text"))
    df = df.unionByName(spark.createDataFrame([(200_000, "x y z " + hot), (200_001, "alone")], "doc_id long, text string"))
    found = substring_dedup.remove_repeats(df).groupBy("n_words", "n_removed").count().collect()
    assert {(r.n_words, r.n_removed, r["count"]) for r in found} == {(25, 0, 1), (25, 25, 99_999), (28, 25, 1), (1, 0, 1)}


def test_words_are_hashed_twice_and_independently():
    """Words that one hash cannot tell apart, the other can: neither follows from the other."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm.words import Words

    w = Words(pa.array([" ".join(f"word{i}" for i in range(20_000))]))
    one, two = w.hash, w.again(1)
    assert len(set(one.tolist())) == len(set(two.tolist())) == 20_000
    low = lambda x: (x & np.uint64(255)).astype(int)
    same = np.flatnonzero(low(one) == low(one)[0])
    assert len(same) > 40 and len(set(low(two)[same])) > 30
