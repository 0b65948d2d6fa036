"""op11 against a trie of whole prefixes, with collisions, long conversations and many ranges."""

import hashlib
import zlib

import duckdb
import pytest

from tessera.llm import prefix_trie, queries

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.md5(f"{role}\0{text}".encode()).hexdigest(), role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    saved, leaves = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = sum(1 for w in path[-1][1].encode().split()) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in children.get(path, []))
        leaves[path] = sum(leaves[k] for k in children.get(path, [])) or 1
    out = []
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(path))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=repr)


def odd_rows():
    rows = [(c, t, "user", f"turn {t} of {c // 40}") for c in range(0, 130) for t in range(c % 7)]
    rows += [(c, None, None, None) for c in range(0, 60, 3)]  # null number, role and text
    rows += [(c, 1, "user", "again") for c in (5, 5, 5, 20, 20)]  # ties and repeated rows
    rows += [(None, 1, "user", "nobody's"), (-7, 0, "user", "a b"), (-20, 0, "x", "y"), (7, 9, "user", "long " * 5000), (8, 9, "", "")]
    rows += [(200, t, "user", f"w{t % 3} w") for t in range(900)] + [(201, t, "user", f"w{t % 3} w") for t in range(900)]  # two long ones that share most
    rows += [(400 + k, t, "user", "same all over") for k in range(0, 40, 2) for t in range(3)]
    return rows


@pytest.mark.parametrize("bits", [63, 3])
def test_is_the_plain_trie(spark, bits):
    """Also where nearly all turns have the same hash, so that most candidates are collisions."""
    rows = odd_rows() if bits == 63 else odd_rows()[:600]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as rep", "2 as n", "3 as fp", "4 as len").repartition(5)
    assert got(prefix_trie.prefix_trie(df, bits=bits)) == brute(rows)


def test_hot_rows_are_dealt_and_pieces_join(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT", 5)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = odd_rows()
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_many_ranges(spark):
    """More ranges than conversations: every long one is carried over several."""
    rows = [(c, t, "user", f"t{t // 2}") for c in (20, 21, 22) for t in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_given_table_empty_and_single(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(prefix_trie.prefix_trie(df)) == brute(rows)
    one = [(3, 0, "user", "alone here")]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(one, SCHEMA))) == brute(one)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    want = con.sql(queries.ORACLE_SQL["op11_prefix_trie"]).to_arrow_table()
    have = queries.QUERIES["op11_prefix_trie"](spark, sf).toArrow()
    assert sorted(map(repr, zip(*[want[c].to_pylist() for c in COLUMNS]))) == sorted(map(repr, zip(*[have[c].to_pylist() for c in COLUMNS])))
