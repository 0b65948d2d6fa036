"""op1, op2 and op6 against plain restatements."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import exact_dedup, packing, sharding

ASCII = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(ASCII)].append(i)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is not None, x), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def test_op6(docs, odd, empty):
    for df in (docs, odd):
        got = sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=repr)
        assert got == brute_dedup(df.select("doc_id", "text").collect())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_drop_copies_keeps_whole_rows(docs, odd, empty):
    for df in (docs, odd):
        kept = exact_dedup.drop_copies(df)
        assert kept.columns == df.columns
        want = Counter((i, k) for i, _, _, stays, k in brute_dedup(df.select("doc_id", "text").collect()) if stays)
        assert Counter((r.doc_id, hashlib.sha256((r.text or "").translate(ASCII).encode()).hexdigest()) for r in kept.collect()) == want
    assert exact_dedup.drop_copies(empty).count() == 0


def test_equal_digests_of_unequal_texts_stay_apart(spark, docs, monkeypatch):
    """With a digest of two bits nearly all hits are false; byte verification must undo them."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.hex(F.crc32(F.encode(c, "UTF-8")) % 4))
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == sorted(x[:4] for x in brute_dedup(docs.select("doc_id", "text").collect()))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_index_settles_and_merges_runs(spark, keep):
    """Runs of several memtables: unique digests are settled by the filters, the others merged in levels."""
    rng = random.Random(3)
    rows = [(bytearray(f"{rng.randrange(3000)}".encode()), i) for i in range(2500)]
    index = exact_dedup.MergeIndex(len(rows), keep)
    index.flush(spark.createDataFrame(rows, "digest binary, id long").repartition(12), "digest", "id")
    assert index.level.select("run").distinct().count() == index.runs == exact_dedup.LEAST_RUNS
    assert exact_dedup.MergeIndex(1 << 22, keep).runs == 16
    settled, entries = index.settle()
    assert settled.count() > 1000 and entries.count() > 500
    groups = defaultdict(list)
    for d, i in rows:
        groups[bytes(d)].append(i)
    got = settled.select("digest", "keep", "rows").unionByName(index.compact(entries)).collect()
    pick = min if keep == "smallest" else max
    assert sorted((bytes(r.digest), r.keep, r.rows) for r in got) == sorted((d, pick(g), len(g)) for d, g in groups.items())


def test_many_copies_meet_their_sample_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COPIES", 7)
    monkeypatch.setattr(exact_dedup, "HOT", 5)
    rows = [(i, "Many Copies" if i % 3 else f"text {i}") for i in range(120)] + [(None, "many copies"), (119, "many copies")]
    got = sorted(map(tuple, exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_dedup(rows)


@pytest.mark.parametrize("counts", [[5, 0, 7, 12], [1], [100] * 9])
def test_matrix_margins(counts):
    m = sharding.communication_matrix(counts, 4, 7)
    assert m.sum(axis=1).tolist() == counts
    assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def test_matrix_law_and_large_populations():
    rng = np.random.default_rng(1)
    large = [sharding._hypergeometric(rng, 3 * 10**9, 9 * 10**9, 10_000) for _ in range(400)]
    assert abs(np.mean(large) - 2500) < 15 and abs(np.std(large) - 43.3) < 6
    draws = Counter(int(sharding.communication_matrix([3, 3], 2, s)[0, 0]) for s in range(4000))
    assert [round(draws[k] / 4000, 1) for k in range(4)] == [0.1, 0.4, 0.5, 0.1] or abs(draws[1] / 4000 - 0.45) < 0.03


def test_op1(docs, odd, empty):
    for df in (docs, odd):
        rows = sharding.shard_documents(df).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_documents(empty).count() == 0


def test_a_hundred_thousand_copies_are_spread(spark):
    """A third of all rows are one text: they meet its entry and its sample in many tasks."""
    from pyspark.sql import functions as F

    df = spark.range(300_000, numPartitions=6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one hot text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_dedup.exact_dedup(df)
    assert got.groupBy("group_size", "kept").count().collect() is not None
    hot = got.where("group_size = 100000").agg(F.count("*"), F.sum(F.col("kept").cast("int")), F.min("keep_id"), F.max("keep_id")).first()
    assert tuple(hot) == (100_000, 1, 299_997, 299_997) and got.where("group_size = 1 and kept").count() == 200_000


def test_shuffle_is_uniform(spark):
    """Each row is in each shard, and before or after each other row, about equally often."""
    df = spark.range(40).repartition(3).cache()
    places = np.zeros((40, 4))
    for seed in range(6):
        for r in sharding.shuffle_to_shards(df, 4, seed=seed, range_rows=4).collect():
            places[r.id, r.shard] += 1
    assert places.sum() == 240 and (places.sum(axis=0) == 60).all() and (places < 6).all()


@pytest.mark.parametrize("most", [0, 1 << 26])
def test_joined_and_sent_cuts_give_the_same(spark, monkeypatch, most):
    df = spark.range(500).repartition(7).sortWithinPartitions("id")
    want = sorted(map(tuple, sharding.shuffle_to_shards(df, 3).collect()))
    monkeypatch.setattr(sharding, "CUTS_BYTES", most)
    assert sorted(map(tuple, sharding.shuffle_to_shards(df, 3).collect())) == want


def test_written_shards_are_whole_rows_in_slot_order(spark, odd, tmp_path):
    sharding.write_shards(odd, f"{tmp_path}/shards", 3)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(c for c in back.columns) == sorted(odd.columns) and back.count() == odd.count()
    rows = defaultdict(list)
    for r in back.select("shard", "slot", "doc_id").collect():
        rows[r.shard].append(r.slot)
    assert {k: sorted(v) for k, v in rows.items()} == {k: list(range(len(v))) for k, v in rows.items()} and len(rows) == 3
    ids = sorted((r.doc_id for r in odd.collect()), key=repr)
    assert sorted((r.doc_id for r in back.collect()), key=repr) == ids


def cheapest_to_open(length, left, rest, sizes, expect, attention):
    """The size whose cost is least for each token it is to hold: its own copies of this length, and the
    expected share of the room they leave, as far as shorter items go round."""
    best = None
    for size in sorted(sizes):
        if size < length:
            continue
        mine = 0
        while mine + length <= size and mine < left * length:
            mine += length
        tokens = mine + min(expect * (size - mine), rest)
        each = (size + size**2 / attention) / tokens
        if best is None or each < best[0]:
            best = (each, size)
    return best[1]


def brute_best_fit(lengths, sizes, expect, attention):
    """Item by item; the length to open is chosen once for each item length, as the plan does."""
    bins, left, chosen = [], Counter(lengths), {}
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= x]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            smaller = sum(k * n for k, n in left.items() if k < x)
            if x not in chosen:
                chosen[x] = cheapest_to_open(x, left[x], smaller, sizes, expect, attention)
            b = [chosen[x], 0]
            bins.append(b)
        left[x] -= 1
        b[0] -= x
        b[1] += x
    return Counter(b[0] for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = (8, 16, 32)
    lengths = [rng.randint(1, 32) for _ in range(300)] + [7] * 50
    for expect in (0.0, 1.0):
        plan = packing.Plan(dict(Counter(lengths)), sizes, expect)
        assert plan.rooms == brute_best_fit(lengths, sizes, expect, packing.ATTENTION)
        assert sum(u * (end - first) for first, end, _, u in plan.bins) == sum(lengths)


def test_op2(docs, odd, empty):
    for df in (docs, odd):
        rows = packing.best_fit_pack(df, (64, 256, 1024), content=True).collect()
        bins, texts = defaultdict(list), defaultdict(list)
        for r in rows:
            assert len(r.content) == r.length
            if r.length:
                bins[r.bin_id].append((r.bin_offset, r.length, r.capacity, r.bin_used))
            else:
                assert r.bin_id is None
        for items in bins.values():
            at = 0
            for offset, length, capacity, used in sorted(items):
                assert offset == at
                at += length
            assert {(c, u) for _, _, c, u in items} == {(min(c for c in (64, 256, 1024) if c >= at), at)}
        assert sorted(bins) == list(range(len(bins)))
        assert sum(r.length for r in rows) == sum(len((r.text or "").encode()) for r in df.collect())
    whole = defaultdict(dict)
    for r in packing.best_fit_pack(docs, (64, 256, 1024), content=True).collect():
        whole[r.doc_id][r.piece] = bytes(r.content)
    assert {i: b"".join(p[k] for k in sorted(p)).decode() for i, p in whole.items()} == {r.doc_id: r.text or "" for r in docs.collect()}
    assert packing.best_fit_pack(empty).count() == 0


def test_pieces_are_cut_between_characters(spark):
    rng = random.Random(6)
    texts = [None, "", "a" * 64, "a" * 65, "é" * 32, "x" + "é" * 40, "€" * 50, "xy" + "𝄞" * 33] + ["".join(rng.choices("aé€𝄞", k=rng.randint(0, 300))) for _ in range(60)]
    pieces = defaultdict(dict)
    for r in packing.pieces_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 64, content=True).collect():
        pieces[r.doc_id][r.piece] = bytes(r.content)
        assert r.length == len(r.content) <= 64 and (r.length or not texts[r.doc_id])
    for i, text in enumerate(texts):
        assert "".join(pieces[i][k].decode() for k in range(len(pieces[i]))) == (text or "")


def test_ids_are_packed_whole(spark):
    rows = [(i, None if i == 3 else list(range(n))) for i, n in enumerate([0, 1, 31, 5, 32, 33, 100, 17])]
    got = defaultdict(dict)
    for r in packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, ids array<int>"), (8, 16, 32), ids_col="ids", content=True).collect():
        got[r.doc_id][r.piece] = list(r.content or [])
        assert (r.bin_id is None) == (r.length == 0) and r.length == len(r.content or [])
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in got.items()} == {i: ids or [] for i, ids in rows}


def test_the_set_of_lengths_is_the_best_of_all(spark, docs):
    """The chosen plan is the cheapest over every set of lengths and every expectation, in tasks too."""
    counts = dict(Counter(min(len((r.text or "").encode()), 1024) for r in docs.collect()))
    counts.pop(0, None)
    sizes = (128, 256, 512, 1024)
    sets = [tuple(s for k, s in enumerate(sizes) if bits >> k & 1) for bits in range(8, 16)]
    least = min(packing.Plan(counts, sizes, e, opened=o).cost for o in sets for e in packing.EXPECTATIONS)
    assert packing.best_plan(counts, sizes).cost == packing.best_plan(counts, sizes, spark=spark).cost == least
    assert packing.best_plan({}, sizes, spark=spark).cost == 0


def test_several_lengths_cost_less_than_one(docs):
    counts = Counter(min(len((r.text or "").encode()), 8192) for r in docs.collect())
    counts.pop(0, None)
    joint = packing.best_plan(dict(counts)).cost
    assert joint <= min(packing.Plan(dict(counts), (8192,), e).cost for e in (0.0, 1.0))
