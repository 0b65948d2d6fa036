"""The pipeline against plain versions of its stages."""

from collections import Counter, defaultdict

import corpus_pipeline
from test_dedup_shard_pack import ASCII
from test_neardup import brute as near_classes

from tessera.llm import packing, pii, toxicity


def plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scanner = toxicity.Scanner(model.lexicon())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if model.score(scanner.features(t or "")) < 0.5]
    last = {}
    for i, t in rows:
        last[(t or "").translate(ASCII)] = max(i, last.get((t or "").translate(ASCII), i))
    rows = [(i, t) for i, t in rows if last[(t or "").translate(ASCII)] == i]
    stay = {c for _, c, _ in near_classes(rows)[0]}
    maker = pii.Surrogates(pii.EXAMPLE_KEY)
    return {i: pii.redact(t or "", maker)[0] for i, t in rows if i in stay}


def test_run_is_the_plain_version(spark, sf):
    want = plain(spark, sf)
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r.doc_id][r.piece] = bytes(r.content)
        if r.length:
            bins[r.bin_id].append((r.bin_offset, r.length, r.capacity))
    got = {i: b"".join(p[k] for k in sorted(p)).decode() for i, p in pieces.items()}
    assert got == want
    for items in bins.values():
        at = 0
        for offset, length, capacity in sorted(items):
            assert offset == at
            at += length
        assert capacity == min(s for s in packing.SIZES if s >= at)


def test_stages_keep_columns_and_take_empty_tables(spark, sf, empty, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).columns == empty.columns
        assert stage(spark, empty, sf).count() == 0
        assert stage(spark, odd, sf).columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


def test_packing_stage_takes_odd_rows(spark, odd, sf):
    """Nulls, empty and very long texts, repeated rows and clashing columns: every row's bytes come back."""
    rows = corpus_pipeline.STAGES[-1][1](spark, odd, sf).collect()
    whole = Counter()
    for r in rows:
        assert r.length == len(r.content or b"") <= max(packing.SIZES) and (r.bin_id is None) == (r.length == 0)
        whole[r.doc_id] += r.length
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        want[r.doc_id] += len((r.text or "").encode())
    assert whole == want and sum(r.piece == 0 for r in rows) == odd.count()


def test_tables_of_finished_stages_are_gone(spark, sf, monkeypatch, tmp_path):
    """Only the last stage's own tables and the stage before it are left once the run is planned."""
    from tessera.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, sf)
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left == {"stage-pii", "pieces"} and out.count() > 0


