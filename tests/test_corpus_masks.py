"""Masks and bags over the whole corpus, by brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import arrays, draws
from tessera.operators import tokens


def test_masks_cover_every_window(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    kept = [r.text.encode() for r in sorted((r for r in docs if len(r.text or "") > 200), key=lambda r: r.doc_id)]
    want = {(i, k // 126): [b + 5 for b in raw[k : k + 126]] for i, raw in enumerate(kept) for k in range(0, len(raw), 126) if len(raw) - k >= 32}
    made = plans.QUERIES["mlm_mask_corpus"](spark, sf).collect()
    assert len(made) == len(want) > len(kept) and {(r.doc_idx, r.win_idx) for r in made} == set(want)
    counts = Counter()
    for r in made:
        ids, positions, targets = ([int(x) for x in r[c].split(",")] for c in ("input_ids", "positions", "targets"))
        plain, n = want[r.doc_idx, r.win_idx], r.n_weights
        assert n == min(max(round(len(plain) * 0.15), 1), 19) == ids.count(1) and len(ids) == 128 and len(positions) == 19
        for p, t in zip(positions[:n], targets[:n], strict=True):
            assert ids[p] == 1
            ids[p] = t
        assert ids == [3, *plain, 4] + [0] * (126 - len(plain))
        counts[n] += 1
    assert {r.n_masked: r.rows for r in plans.QUERIES["mask_corpus_counts"](spark, sf).collect()} == counts


def test_bags_cover_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r.doc_id, b + 5) for r in docs for b in (r.text or "").encode())
    assert {(r.doc_id, r.token_id): r.n for r in plans.QUERIES["bow_corpus_counts"](spark, sf).collect()} == want


def test_windows_are_cut_and_masked_by_one_task(spark):
    texts = [None, "", "x" * 31, "y" * 158, "ж" * 300, "z" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string")
    text = ("input_ids", "positions", "targets")
    apart = tokens.masked_examples(tokens.byte_windows(docs), 128, 0.15, 11)
    want = apart.select(*[arrays.joined(F.col(c)).alias(c) if c in text else c for c in apart.columns]).collect()
    once = tokens.masked_windows(docs, 128, 0.15, 11, joined=text)
    assert sorted(once.collect(), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2]) and len(want) == 2 + 5 + 40
    # before, windows went to rows and back between two Python processes of a task
    made = plans.QUERIES["mlm_mask_corpus"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_places_equal_in_the_first_word_are_ordered_by_the_others(monkeypatch):
    whole = draws.digests

    def coarse(heads, tails, words=5):
        found = whole(heads, tails)
        found[0] &= np.uint32(1 << 31)
        return found[:words]

    monkeypatch.setattr(draws, "digests", coarse)
    ids = [3, *range(10, 60), 4, 0]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8], pa.int64()), pa.array([0, 1], pa.int32()), pa.array([ids, ids], pa.list_(pa.int32()))], names=["doc_idx", "win_idx", "ids"])
    (made,) = tokens._masking(128, 0.15, 11, 0)(iter([batch]))
    for r in made.to_pylist():
        order = sorted(range(1, 51), key=lambda i: tuple(coarse([b"%d|%d|" % (r["doc_idx"], r["win_idx"])], [b"%d|0|11" % i])[:, 0, 0]))
        assert r["positions"] == sorted(order[:8]) + [0] * 11 and r["input_ids"].count(1) == 8
