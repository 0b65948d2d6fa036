"""Matrices, files, commits, ranges, prefixes, encoders and calls against plain restatements."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import calls, corpus, encoding, prefix, ranges
from tessera.sources import commits, files, matrix, store
from tessera.sources.work import scratch_path


@pytest.mark.parametrize("dtype", ["<f4", "<i4", "<f8"])
def test_matrix_comes_back_by_ranges_and_by_number(spark, dtype, tmp_path):
    rng = np.random.default_rng(1)
    rows = (rng.random((237, 5)) * 1000).astype(dtype)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "i int, v array<double>").repartition(7)
    path = f"file://{tmp_path}/m.npy"
    matrix.write(df, path, "v", "i", dtype=dtype)
    assert (np.load(f"{tmp_path}/m.npy") == rows).all()
    scanned = matrix.scan(spark, path, 1000)
    assert scanned.rdd.getNumPartitions() > 4
    assert [(r.pos, list(r.v)) for r in scanned.orderBy("pos").collect()] == [(i, r.tolist()) for i, r in enumerate(rows)]
    wanted = [5, 236, 5, None, 0, 237, -1, 100]
    got = matrix.take_rows(spark.createDataFrame([(k, n) for k, n in enumerate(wanted)], "k int, pos long"), path).orderBy("k").collect()
    assert [None if r.v is None else list(r.v) for r in got] == [rows[n].tolist() if n is not None and 0 <= n < 237 else None for n in wanted]


def test_matrix_header_and_odd_matrices(spark, tmp_path):
    for shape in ((0, 3), (4, 0), (1, 70_000)):
        np.save(tmp_path / "x.npy", np.zeros(shape, np.float32))
        head = matrix.read_header(str(tmp_path / "x.npy"))
        assert (head.rows, head.width) == shape and head.start % 64 == 0
        assert matrix.scan(spark, str(tmp_path / "x.npy")).count() == shape[0]
    (tmp_path / "y.npy").write_bytes(b"no matrix at all")
    with pytest.raises(ValueError, match="no matrix"):
        matrix.read_header(str(tmp_path / "y.npy"))
    np.save(tmp_path / "z.npy", np.zeros(3))
    with pytest.raises(ValueError, match="row-major"):
        matrix.read_header(str(tmp_path / "z.npy"))
    with pytest.raises(ValueError, match="different lengths"):
        matrix.write(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "i int, v array<double>"), str(tmp_path / "w.npy"), "v", "i")


def test_rows_beyond_two_gigabytes_are_sought(spark, tmp_path):
    """A sparse file of 3 GB: its far rows are read without the rest."""
    rows, width = 12_000, 65_536
    path = tmp_path / "large.npy"
    head = matrix.header_bytes("<f4", rows, width)
    with open(path, "wb") as file:
        file.write(head)
        file.seek(len(head) + (rows - 1) * width * 4)
        file.write(np.arange(width, dtype="<f4").tobytes())
    assert path.stat().st_size > 2 << 30
    got = matrix.take_rows(spark.createDataFrame([(rows - 1,), (7,)], "pos long"), str(path)).orderBy("pos").collect()
    assert sum(got[0].v) == 0 and list(got[1].v[:3]) == [0.0, 1.0, 2.0]
    reader = matrix.MatrixReader(str(path), matrix.RANGE)
    parts = reader.partitions()
    assert len(parts) == 47 and parts[-1].stop == rows and sum(p.stop - p.start for p in parts) == rows
    assert sum(b.num_rows for b in reader.read(matrix.Rows(rows - 3, rows))) == 3


def test_files_are_digested_block_by_block(spark, tmp_path):
    texts = [None, "", "a", "é" * 5000, "x" * 100_001]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    made = files.write_each(df, f"file://{tmp_path}/f", F.col("i"), F.col("t")).collect()
    for block in (7, 4096):
        got = {r.path: (r.digest, r["size"]) for r in files.digests(spark.createDataFrame(made).select("path"), block=block).collect()}
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            assert got[f"file://{tmp_path}/f/{i}"] == (hashlib.sha256(raw).hexdigest(), len(raw))


def test_a_file_is_there_whole_or_not(tmp_path):
    with pytest.raises(RuntimeError), store.Output(str(tmp_path / "a" / "x")) as out:
        out.write(b"half")
        raise RuntimeError
    assert list((tmp_path / "a").iterdir()) == []


def test_commits_are_all_or_nothing(spark, tmp_path):
    log = commits.CommitLog(spark, f"file://{tmp_path}/t")
    schema = "id long"
    assert log.live() == (0, []) and log.read(schema).count() == 0
    assert log.publish(spark.range(5), "a") == 1
    added = log.add(spark.range(100), "b")  # not committed: nobody sees it
    assert log.read(schema).count() == 5
    with pytest.raises(ValueError, match="check"):
        log.publish(spark.range(3), "c", lambda made: made.count() > 3)
    assert log.commit(lambda live: live + added) == 2
    assert log.read(schema).count() == 105 and log.read(schema, 1).count() == 5
    for step in (10, 20, 30):
        log.publish_step(spark.range(step), step)
    assert log.live()[0] == 5 and log.read(schema).count() == 5 + 100 + 30
    log.squash()
    assert log.versions() == [5] and log.read(schema).count() == 135
    data = {p.parent.parent.name for p in (tmp_path / "t").rglob("*.parquet") if "_log" not in str(p)}
    assert "10" not in data and "20" not in data and {"a", "b", "30"} <= data


def test_writers_that_meet_both_get_in(spark, tmp_path):
    """Another writer commits between this one's look and its try: the change is worked out again."""
    one, two = (commits.CommitLog(spark, str(tmp_path / "t")) for _ in range(2))
    a, b = one.add(spark.range(3), "a"), two.add(spark.range(4), "b")
    met = []

    def change(live):
        if not met:
            met.append(two.commit(lambda other: other + b))
        return live + a

    assert one.commit(change) == 2 and met == [1]
    assert one.read("id long").count() == 7
    assert one._put_if_absent(2, []) is False
    with pytest.raises(commits.Conflict):
        one.commit(lambda live: [one._put_if_absent(one.live()[0] + 1, live), "x"][1:], tries=3)


def test_points_in_ranges_of_any_length(spark):
    rng = random.Random(4)
    made = [(i, a := rng.randrange(0, 3000), a + rng.choice([-3, 0, 1, 2, 5, 17, 64, 1000, 1 << 40])) for i in range(80)] + [(100, None, 5), (101, 5, None), (102, 0, 1), (103, 0, 1)]
    points = [(p,) for p in list(range(0, 3000, 7)) + [0, 0, 63, 64, 2**35, -1]] + [(None,)]
    got = ranges.points_in_ranges(spark.createDataFrame(points, "pos long"), spark.createDataFrame(made, "r int, start long, end long"))
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    want = sorted((p, r) for (p,) in points for r, a, b in made if None not in (p, a, b) and p >= 0 and a <= p < b)
    assert sorted((x.pos, x.r) for x in got.collect()) == want
    assert ranges.points_in_ranges(spark.createDataFrame(points, "pos long"), spark.createDataFrame([], "r int, start long, end long")).count() == 0


def scanned_rows(df):
    """Rows that the file scans of a plan have put out."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif hasattr(node, "plan") and name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_prefix_is_read_in_proportion(spark, tmp_path):
    """20,000 documents in 100 row groups: the first 50 kept ones need a few groups; rows are the same."""
    docs = spark.range(20_000, numPartitions=10).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("short")).otherwise(F.concat(F.repeat(F.lit("word. Another one here. "), 12), F.lit("Sentence number "), "id", F.lit("."))).alias("text"))
    docs.repartitionByRange(100, "doc_id").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    part = prefix.prefix(docs, "doc_id", lambda p: corpus.long_documents(p).limit(50).count() == 50, 100)
    assert scanned_rows(part) < 2_000
    want = corpus.kept_documents(docs, carry=()).where("doc_idx < 50").collect()
    assert sorted(map(tuple, prefix.first_kept(docs, 50).select("doc_id", "doc_idx").collect())) == sorted((r.doc_id, r.doc_idx) for r in want)
    want = corpus.first_distinct(corpus.sentences(docs), 40)
    assert sorted(map(tuple, prefix.first_sentences(docs, 40).collect())) == sorted(map(tuple, want.collect()))
    assert prefix.first_kept(docs, 10**6).count() == corpus.long_documents(docs).count()
    mixed = docs.orderBy(F.xxhash64("doc_id"))
    mixed.write.parquet(str(tmp_path / "m"))
    assert prefix.first_kept(spark.read.parquet(str(tmp_path / "m")), 50).count() == 50


def test_encoder_keeps_order_and_halves(spark, sf):
    texts = [None, "", "same", "same", "x" * 900, "y" * 300] + [f"t {i}" * (i % 40) for i in range(200)]
    sizes, limit = [], [16]
    inner = encoding.hash_encoder(8, too_many=2000)()

    def watched(batch):
        sizes.append((len(batch), max(map(len, batch))))
        return inner(batch)

    plain = [t or "" for t in texts]
    made = encoding.encoded(plain, watched, limit, 4000)
    assert np.allclose(made, np.concatenate([encoding.hash_encoder(8)()([t]) for t in plain]))
    assert all(n == 1 or n * -(-m // 8) * 8 <= 4000 for n, m in sizes) and limit[0] < 16
    for owns in (False, True):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
        got = encoding.encode(df, encoding.hash_encoder(8), owns_batching=owns, most=7).orderBy("i").collect()
        assert np.allclose([r.e for r in got], made, atol=1e-7) and [r.text for r in got] == texts
    with pytest.raises(encoding.OutOfMemory):
        encoding.encoded(["a"], lambda batch: (_ for _ in ()).throw(encoding.OutOfMemory()), [4], 100)


def plain_calls(items, size, retries, limit_share=2, fail_share=23):
    """The loop of a caller, item after item."""
    out, i, now, waited, row, asked = [], 0, size, 0, 0, {}
    while i < len(items):
        batch = items[i : i + now]
        key = hashlib.sha1(json.dumps([x for x, _ in batch]).encode()).hexdigest()
        asked[key] = asked.get(key, 0) + 1
        if asked[key] <= int(key, 16) % limit_share:
            row += 1
            if row > retries:
                return out + [(x, None, "stopped", 0, waited) for x, _ in items[i:]]
            waited += min(60, 2**row)
        elif any(int(hashlib.sha1(str(x).encode()).hexdigest(), 16) % fail_share == 0 for x, _ in batch):
            if len(batch) > 1:
                now = max(1, len(batch) // 2)
                continue
            out.append((batch[0][0], None, "skipped", 1, waited))
            i, now = i + 1, size
        else:
            row = 0
            out += [(x, float(len(t)), "done", len(batch), waited) for x, t in batch]
            i, now = i + len(batch), size
    return out


@pytest.mark.parametrize("retries", [1, 7])
def test_calls_are_the_plain_loop(spark, retries):
    rows = [(s, i, "x" * (i % 50)) for s in range(3) for i in range(s * 1000, s * 1000 + 150)]
    df = spark.createDataFrame(rows, "shard long, item long, text string").repartition(4)
    got = sorted(map(tuple, calls.called(df, calls.hash_client(), scratch_path(spark, "calls"), retries=retries).collect()))
    want = sorted((s, *r) for s in range(3) for r in plain_calls([(i, t) for q, i, t in rows if q == s], 16, retries))
    assert got == want
    assert {r[3] for r in got} >= ({"done", "skipped"} if retries == 7 else {"done", "stopped"})


def test_a_killed_task_goes_on_from_its_journal(spark, tmp_path):
    items = [(i, "y" * i) for i in range(100)]
    made, journal = [], calls.Journal(str(tmp_path))

    def dies(batch, call):
        if len(made) == 3:
            raise KeyboardInterrupt
        made.append(batch)
        return [float(len(t)) for _, t in batch]

    with pytest.raises(KeyboardInterrupt):
        calls.call_all(items, dies, 16, 7, journal.done, journal.commit)
    again = []

    def lives(batch, call):
        again.append(batch)
        return [float(len(t)) for _, t in batch]

    out, n = calls.call_all(items, lives, 16, 7, journal.done, journal.commit)
    assert [r[1] for r in out] == [float(i) for i in range(100)] and n == len(again) == 4
    assert not {i for b in made for i, _ in b} & {i for b in again for i, _ in b}


def test_called_service_query(spark, sf):
    got = plans.QUERIES["called_service"](spark, sf).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = []
    for shard in sorted({d // 256 for d in docs}):
        want += [(shard, *r) for r in plain_calls([(d, docs[d]) for d in sorted(docs) if d // 256 == shard], 16, 7)]
    assert sorted(map(tuple, got)) == sorted(want)
