"""op3 against brute force over all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import graph, neardup
from tessera.llm.words import Words


def sets(text):
    words = (text or "").encode().lower().split()
    if 0 < len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def jaccard(a, b):
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def brute(rows, threshold=0.8):
    """Classes by all pairs that share a shingle."""
    units = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        units[b" ".join((t or "").encode().lower().split())].append((i is None, i or 0, n))
    texts = list(units)
    bags = [sets(t.decode()) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(set)
    for u, bag in enumerate(bags):
        for s in bag:
            where[s].add(u)
    pairs = {(u, v) for us in where.values() for u in us for v in us if u < v}
    for u, v in pairs:
        if jaccard(bags[u], bags[v]) >= threshold:
            parent[root(u)] = root(v)
    classes = defaultdict(list)
    for u, t in enumerate(texts):
        classes[root(u)] += units[t]
    out = []
    for members in classes.values():
        best = min(members)
        out += [(rows[n][0], rows[best[2]][0], len(members)) for _, _, n in members]
    return sorted(out, key=repr), len(classes)


def result(df, **options):
    rows = neardup.near_duplicates(df, **options).collect()
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in rows), key=repr), sum(r.kept for r in rows)


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    for a, b in ((np.array([3, 1, 0, 2.5, 7]), np.array([2, 1, 4, 2.5, 7])), (np.ones(400), np.r_[np.ones(300), np.zeros(100)])):
        n = len(a)
        element = rng.integers(0, 2**63, n, dtype=np.uint64)
        agree = []
        for seed in range(30):
            entries = [(element[i], w[i], r) for r, w in enumerate((a, b)) for i in range(n) if w[i]]
            e, w, r = (np.array(x) for x in zip(*entries, strict=True))
            s = neardup.dart_minhash(e.astype(np.uint64), w, r, 2, k=150, seed=seed)
            agree.append((s[0] == s[1]).mean())
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(np.mean(agree) - want) < 0.02


def entries(texts):
    return neardup.shingles(Words(pa.array([t.encode() for t in texts], pa.large_binary()).cast(pa.large_string())))


def test_blocks_find_the_pairs_of_brute_force():
    rng = random.Random(8)
    texts = [" ".join(rng.choices("ab", k=rng.randint(1, 14))) for _ in range(90)] + ["", "a b", "a b c d e a b c d e a b c d e"]
    bags = [sets(t) for t in texts]
    group = np.sort(np.array([rng.randrange(4) for _ in texts]))
    want = {(i, j) for j in range(len(texts)) for i in range(j) if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.5}
    i, j = neardup.near_within(*entries(texts), group, 0.5)
    assert {(int(a), int(b)) for a, b in zip(i, j, strict=True)} == {(a, b) for a, b in want if group[a] == group[b]}
    i, j = neardup.Shown(*entries(texts[40:]), len(texts) - 40).near(*entries(texts[:40]), 40, 0.5)
    assert {(int(a), int(b) + 40) for a, b in zip(i, j, strict=True)} == {(a, b) for a, b in want if a < 40 <= b}


def test_groups_are_cut_whole():
    rows = [(b, b % 3, "x" * (b % 7 + 1) * 20) for b in sorted(random.Random(1).choices(range(60), k=400))]
    rows += [(99, 0, "y" * 30)] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["bucket", "block", "packed"])
    parts = [batch.slice(i, 37) for i in range(0, batch.num_rows, 37)]
    seen, out = set(), []
    for table, group in neardup._whole_groups(iter(parts), 2, "packed", 500):
        keys = list(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
        assert len(set(group)) == len(set(keys)) and not seen & set(keys)
        seen |= set(keys)
        out += keys
    assert out == [r[:2] for r in rows]


def test_op3_over_documents(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got, kept = result(df)
        want, classes = brute(rows)
        assert got == want and kept == classes
    assert result(empty) == ([], 0)


def test_chains_and_large_groups(spark):
    """A drifting chain and a group around one text: classes are whole, with no link lost."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows, chain = [], list(base)
    for i in range(25):
        rows.append((i, " ".join(chain)))
        chain = list(chain)
        chain[(i * 5) % 120] = word()
    other = [word() for _ in range(100)]
    for i in range(60):
        copy = list(other)
        copy[rng.randrange(100)] = word()
        rows.append((100 + i, " ".join(copy)))
    rows += [(300 + i, " ".join(word() for _ in range(80))) for i in range(20)]
    got, kept = result(spark.createDataFrame(rows, "doc_id long, text string"))
    want, classes = brute(rows)
    assert got == want and kept == classes


@pytest.mark.parametrize("block", [4, 256])
def test_a_large_loose_group_and_repeated_rows(spark, monkeypatch, block):
    """Copies of one text with 0 to 12 words changed, many of them like many others and linked to few,
    in buckets of one block and of many; and rows repeated with their ids."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for i in range(160):
        copy = list(base)
        for k in rng.sample(range(150), rng.choice([0, 1, 2, 4, 6, 8, 12])):
            copy[k] = word()
        rows.append((i, " ".join(copy)))
    rows += [rows[7]] * 30 + [(500, None), (501, ""), (500, None)]
    got, kept = result(spark.createDataFrame(rows, "doc_id long, text string"))
    want, classes = brute(rows)
    assert got == want and kept == classes


def test_drop_keeps_whole_rows(odd):
    kept = neardup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert kept.count() == brute(rows)[1]


@pytest.mark.parametrize("edges", [[(1, 2)], [(i, i + 1) for i in range(40)], [(5, i) for i in range(20) if i != 5] + [(100, 101), (101, 19)]])
def test_components(spark, edges):
    got = {r.unit: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        parent.setdefault(a, {a}), parent.setdefault(b, {b})
        whole = parent[a] | parent[b]
        for x in whole:
            parent[x] = whole
    assert got == {x: min(s) for x, s in parent.items()}
