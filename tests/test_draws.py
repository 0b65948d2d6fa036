"""Draws hashed in numpy against hashlib, and the operators that use them at sizes they could not reach before."""

import hashlib
import math
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import arrays, draws
from tessera.operators import batches, statistics, tokens
from tessera.plans import evaluation, streams
from tessera.sources import files, matrix, readers
from tessera.sources.work import scratch_path, work_table


def test_digests_are_sha1(monkeypatch):
    monkeypatch.setattr(draws, "SLAB", 7)
    heads = [b"", b"7|", b"123|", "ß|".encode(), b"x" * 40]
    tails = [b"%d|0|11" % i for i in (0, 9, 10, 99, 100, 4_000_000_000)]
    found = draws.digests(heads, tails)
    for i, head in enumerate(heads):
        for j, tail in enumerate(tails):
            assert found[:, i, j].astype(">u4").tobytes() == hashlib.sha1(head + tail).digest()
    assert (draws.digests(heads, tails, 1)[0] == found[0]).all() and draws.digests([], tails).shape == (5, 0, 6)
    with pytest.raises(ValueError):
        draws.digests([b"x" * 50], [b"y" * 6])


def test_masks_are_drawn_by_tasks_in_numpy(spark, monkeypatch):
    monkeypatch.setattr(tokens, "STEP_MASKED", 3)
    rows = [(5, 0, [3, *range(10, 40), 4, 0, 0]), (None, 1, [3, 9, 4]), (6, 2, [3, 4, 0]), (7, 1, []), (2**40, 3, list(range(5, 105)))]
    made = tokens.masked_examples(spark.createDataFrame(rows, "doc_idx long, win_idx int, ids array<int>"), 34, 0.15, 11)
    for (doc, win, ids), r in zip(rows, sorted(made.collect(), key=lambda r: [x[1] for x in rows].index(r.win_idx) if r.win_idx != 1 else (1 if r.doc_idx is None else 3)), strict=True):
        key = lambda i: hashlib.sha1("|".join(str(x) for x in (doc, win, i, 0, 11) if x is not None).encode()).hexdigest()  # noqa: B023, E731
        may = sorted((i for i, x in enumerate(ids) if x >= 5), key=key)
        chosen = sorted(may[: min(max(round(len(may) * 0.15), 1), len(may), 5)])
        assert list(r.positions) == chosen + [0] * (5 - len(chosen)) and list(r.targets) == [ids[i] for i in chosen] + [0] * (5 - len(chosen))
        assert list(r.input_ids) == [arrays.MASK if i in chosen else x for i, x in enumerate(ids)] and list(r.attention_mask) == [int(x != 0) for x in ids]
        assert list(r.weights) == [1.0] * len(chosen) + [0.0] * (5 - len(chosen))
    # before, each place of a window was hashed, sorted and looked up by expressions of the JVM
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString() and "sha1" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.where(F.col("doc_idx").isNull()).count() == 1


def test_pairs_of_least_hash_are_not_all_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(batches, "work_table", lambda df, tag: written.append(work_table(df, tag)) or written[-1])
    n, k = 300, 500
    got = {(r.i, r.j) for r in batches.pair_sample(spark, n, k, 4).collect()}
    key = lambda p: hashlib.sha1(f"{p[1] * (p[1] - 1) // 2 + p[0]}|4".encode()).hexdigest()
    assert got == set(sorted(((i, j) for j in range(n) for i in range(j)), key=key)[:k])
    # before, a row of each of the 44,850 pairs was
    assert k <= written[0].count() < 1000
    # a bound that lets too few through is doubled
    monkeypatch.setattr(batches.math, "ceil", lambda x, calls=[]: calls.append(x) or (1 << 20 if len(calls) == 1 else math.floor(x)))
    assert {(r.i, r.j) for r in batches.pair_sample(spark, n, k, 4).collect()} == got and len(written) == 3


def test_bootstrap_draws_slots_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    x = [rng.choice([0.0, 1.0, -1.0, None]) for _ in range(500)]
    scores = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "ord long, x double")
    monkeypatch.setattr(statistics, "SLOTS", 64)
    monkeypatch.setattr(statistics, "TASK_DRAWS", 1000)
    means = []
    for b in range(30):
        drawn = [x[int(hashlib.sha1(f"{b}|{i}|5".encode()).hexdigest()[:8], 16) % 500] for i in range(500)]
        drawn = [v for v in drawn if v is not None]
        means.append(sum(drawn) / len(drawn))
    row = statistics.bootstrap(scores, 30, 5).first()
    assert (row.lo, row.hi) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-12)
    # before, a replicate was one row and one array of all its draws, of one task
    assert statistics._drawn_sums(scores, 500, 30, 5).count() == 30 * 8
    assert tuple(statistics.bootstrap(scores.limit(0), 5).first()) == (None, None, None)


def test_a_matrix_is_dealt_to_ranges_once(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("i"), F.array(F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    tables = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(matrix, "work_table", lambda df, tag: tables.append(tag) or work_table(df, tag))
        matrix.write(rows, str(tmp_path / "m.npy"), "v", "i", dtype="<i8")
    assert np.load(tmp_path / "m.npy").ravel().tolist() == list(range(1000))
    assert tables == ["matrix-list"]  # before, all rows were written twice and dealt twice
    with pytest.raises(ValueError, match="null ones"):
        matrix.write(spark.createDataFrame([(1, [1.0]), (2, None)], "i int, v array<double>"), str(tmp_path / "n.npy"), "v", "i")


def test_encoding_holds_a_step_at_a_time(spark, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        raw = file.read()
    one = Tokenizer.from_str(raw)
    texts = [None, "", "word " * 50, "ß" * 9, "x" * 700, None, "", "end"] * 20
    rows = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1)
    monkeypatch.setattr(readers, "STEP_BYTES", 300)
    made = readers.encode_with(rows, raw)
    assert {r.item_id: list(r.ids) for r in made.collect()} == {i: one.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    # before, the texts of a whole Arrow batch were encoded, and their encodings held, at once
    import pyarrow as pa

    function = {}
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: function.setdefault("run", run), raising=False)
    readers.encode_with(rows, raw)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["item_id", "_text"])
    out = list(function["run"](iter([batch])))
    assert len(out) > 20 and sum(b.num_rows for b in out) == len(texts)


def test_a_part_of_a_stream_is_several_files(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(streams, "scratch_path", lambda spark, tag: made.append(scratch_path(spark, tag)) or made[-1])
    big = spark.range(12_000).select(F.col("id").alias("event_id"), (F.col("id") * 7919 % 12_000).alias("ts"))
    monkeypatch.setattr(streams, "table", lambda *a: big)
    monkeypatch.setattr(streams, "FILE_ROWS", 2000)
    stream = streams._in_files(spark, sf, "any", "ts", 3)
    written = [p.name for p in pathlib.Path(made[0].removeprefix("file://")).glob("*.parquet")]
    assert len(written) == 6  # two a part; before, one task wrote and read a third of the table
    batches_seen = []
    stream.writeStream.foreachBatch(lambda batch, k: batches_seen.append(batch.agg(F.min("ts"), F.max("ts"), F.count("ts")).first())).trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "seen")).start().awaitTermination()
    assert len(batches_seen) == 3 and sum(b[2] for b in batches_seen) == 12_000
    assert all(a[1] < b[0] for a, b in zip(batches_seen, batches_seen[1:], strict=False))


def test_a_digest_in_order_passes_no_text_to_the_driver(spark, monkeypatch):
    rows = spark.range(300).select((F.col("id") * 7919 % 300).alias("at"), F.concat(F.lit("ß"), (F.col("id") * 7919 % 300).cast("string")).alias("t")).repartition(5)
    monkeypatch.setattr(type(rows), "toLocalIterator", None)  # before, the driver took every row
    assert tuple(files.digest_in_order(rows, "t", "at").first()) == (hashlib.sha1("\0".join(f"ß{i}" for i in range(300)).encode()).hexdigest(), 300)
    assert tuple(files.digest_in_order(rows.limit(0), "t", "at").first()) == (None, 0)


def test_parts_of_a_draw_cover_all_places_and_fill_their_arrays(monkeypatch):
    for slab, rows, columns in ((7, 3, 20), (7, 20, 3), (100, 8, 1000), (100, 64, 10), (5, 1, 1), (5, 0, 4), (5, 4, 0)):
        monkeypatch.setattr(draws, "SLAB", slab)
        seen = np.zeros((rows, columns), int)
        parts = list(draws._slabs(rows, columns))
        for r, c, m, n in parts:
            assert m * n <= slab
            seen[r : r + m, c : c + n] += 1
        assert (seen == 1).all()
    # before, tails of each length were hashed on their own, in arrays that were not filled
    made = []
    monkeypatch.setattr(draws, "SLAB", 1 << 16)
    monkeypatch.setattr(draws, "_compressed", lambda left, right, words, f=draws._compressed: made.append(right.shape[1] * left.shape[1]) or f(left, right, words))
    draws.digests([b"%d|" % b for b in range(8)], [b"%d|0" % i for i in range(1 << 14)], 1)
    assert made == [1 << 16, 1 << 16]


def test_a_worker_loads_one_tokenizer_and_a_task_passes_an_id_on_once(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        raw = file.read()
    # before, each task loaded its own, whose memory stayed between that of the next
    assert readers._loaded(raw) is readers._loaded(raw)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["one two one", None, "", "two two ßé"] * 50)], "item_id long, text string").repartition(2)
    want = {x for r in readers.encode_with(rows, raw).collect() for x in r.ids}
    found = [r.id for r in readers.used_ids(rows, raw).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    # before, every token of the table was a row
    assert "explode" not in plans.QUERIES["vocabulary_script"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert readers.used_ids(rows.where("item_id < 0"), raw).count() == 0


def test_a_bootstraps_tasks_are_short_however_many_scores_there_are(spark):
    scores = spark.range(1000).select(F.col("id").alias("ord"), (F.col("id") % 3).cast("double").alias("x"))
    least = spark.sparkContext.defaultParallelism
    for replicates in (10, 20_000, 80_000, 1_600_000):
        tasks = statistics._drawn_sums(scores, 1000, replicates, 0).rdd.getNumPartitions()
        # before, tasks grew with the draws up to 3.4e7 of them, about 10 s
        assert tasks >= least
        assert 1000 * replicates / tasks <= 5_000_000


def test_paired_delta_deals_its_draws_to_short_tasks(spark, sf, monkeypatch):
    scores = spark.range(150_000).select(F.col("id").alias("ord"), (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("double").alias("z"))
    dealt = []
    monkeypatch.setattr(evaluation, "_scores", lambda *a: scores)
    monkeypatch.setattr(statistics, "_drawn_sums", lambda *a, f=statistics._drawn_sums: dealt.append(f(*a)) or dealt[-1])
    plans.QUERIES["paired_delta"](spark, sf)
    # before, as many tasks as there are cores, until each had 3.4e7 draws
    assert 150_000 * 200 / dealt[0].rdd.getNumPartitions() <= 5_000_000
    assert dealt[0].count() == 200 * 3


def test_more_scores_than_a_task_holds_are_drawn_in_short_tasks(spark, sf, monkeypatch):
    rng = random.Random(9)
    x = [(i, rng.choice([0.0, 1.0, None]), rng.choice([0.0, 1.0])) for i in range(700)]
    scores = spark.createDataFrame(x, "ord long, x double, z double").coalesce(1)
    dealt = []
    monkeypatch.setattr(evaluation, "_scores", lambda *a: scores)
    held = plans.QUERIES["paired_delta"](spark, sf).first()
    monkeypatch.setattr(statistics, "HELD_SCORES", 300)
    monkeypatch.setattr(statistics, "SLOTS", 64)
    monkeypatch.setattr(statistics, "TASK_DRAWS", 10_000)
    monkeypatch.setattr(statistics, "_drawn_sums", lambda *a, f=statistics._drawn_sums: dealt.append(f(*a)) or dealt[-1])
    found = plans.QUERIES["paired_delta"](spark, sf)
    assert found.first() == held
    # before, the tasks that read the scores (here one) made all the draws, by expressions of the JVM
    assert "sha1" not in found._jdf.queryExecution().optimizedPlan().toString()
    made = dealt[0].withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum("k").alias("k"), F.count("b").alias("rows")).collect()
    assert len(made) == 15 and sum(r.rows for r in made) == 3 * 200 * 11  # 3 ranges, 5 tasks each
    assert max(r.k for r in made) <= 15_000
    # each replicate's draws are those of its slots, none lost
    known = {i for i, v, _ in x if v is not None}
    want = sum(int(hashlib.sha1(f"7|{i}|0".encode()).hexdigest()[:8], 16) % 700 in known for i in range(700))
    assert dealt[0].where("b = 7").agg(F.sum("k")).first()[0] == want


def test_pairs_are_told_by_one_word_of_many_rows_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    rows, function, asked = spark.range(1), {}, []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: function.setdefault("run", run))
    monkeypatch.setattr(batches, "DIGITS", 2)
    batches._numbers_under(spark, 25_050, 1 << 26, 7)
    monkeypatch.setattr(draws, "digests", lambda heads, tails, words=5, f=draws.digests: asked.append((len(heads), words)) or f(heads, tails, words))
    made = pa.Table.from_batches(function["run"](iter([pa.RecordBatch.from_arrays([pa.array(range(251))], names=["id"])])))
    want = {i: hashlib.sha1(b"%d|7" % i).digest() for i in range(25_050)}
    assert dict(zip(made["id"].to_pylist(), made["key"].to_pylist(), strict=True)) == {i: k for i, k in want.items() if k[:4] < (1 << 26).to_bytes(4, "big")}
    # before, five words of each digest were kept, and the tails expanded again for every eight rows
    assert [w for _, w in asked] == [1] * len(asked) and len(asked) == 1 + -(-250 // batches.HASHED_ROWS)
