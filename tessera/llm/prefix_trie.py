"""A trie of conversation prefixes by rolling fingerprints, verified turn by turn.

Every conversation is rebuilt (`rebuild`): the first h turns of its base, c - c % 20, then its own
turns after its first h, h = crc32(decimal c) % 4. The distinct sequences of first d turns (role, text)
are the nodes of depth d.

1. Turns are dealt to ranges of (conv_id, turn) and sorted; a numpy scan over Arrow batches adds up
   each conversation's polynomial fingerprints modulo two primes. A conversation longer than a range
   is carried over: a range leaves one row of sums, and what the ranges before it add to its first
   conversation is an affine map, applied as two constants a range.
2. Rows of equal (fingerprint, depth) are candidates for one node; the smallest conv_id represents them.
3. Every candidate's turn and parent are compared with its representative's, level by level, so whole
   prefixes are. Candidates that differ get a mark of their own from that depth on and step 2 is
   repeated, until nothing differs.
4. What a node's subtree holds is rolled up to it in one sum over its members: a leaf counts at
   the conversation that represents it, and a member saves the words of its turns from here
   to where it represents a node itself (from there on it always does).

Nodes of one conversation, nearly all in long tables, never leave the range they were sorted in.
Rows of hot nodes and hot conversations are dealt to several tasks (`dealt_join`).

Turns stand in the order of their number, null first; of equal numbers, in the order of the MD5 of
role, a null byte and text (repeated rows are repeated turns). Null role or text is empty. Rows without
a conv_id take no part. c % 20 has the sign of c. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import dealt_join, filter_bits, key_filter, materialise, may_be_in, release

#: Moduli and bases of the two polynomials.
PRIMES = (2147483647, 2147483629)
BASES = (1_234_567_891, 987_654_323)
#: Members of a node, or shared turns of a conversation, from which its rows are dealt to several tasks.
HOT = 5_000
WORD = r"[^\x20\x09-\x0D]+"
EVERY, HEADS = 20, 4
#: Identifiers of one piece of a node's list of ends.
PIECE = 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

ROWS = "conv_id long, part int, unseen boolean, depth long, f1 long, f2 long, g1 long, g2 long, wpre long, w long, len long, role string, text string, edge array<long>"
INFO = ("n_own", "h", "nh", "h1", "h2", "hw", "s1", "s2", "sw")


def powers(base: int, prime: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo prime, by squaring."""
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = out[odd] * square % prime
        square, left = square * square % prime, left >> 1
    return out


class Scan:
    """Prefix sums of one range's turns, sorted by conversation, its info row first."""

    def __init__(self):
        self.first = self.conv = None
        self.seen, self.k, self.sums, self.words, self.info = False, 0, [0, 0], 0, np.zeros(len(INFO), np.int64)

    def feed(self, conv: np.ndarray, own: np.ndarray, t: list[np.ndarray], w: np.ndarray, info: np.ndarray) -> dict[str, np.ndarray]:
        n = len(conv)
        if self.first is None:
            self.first = int(conv[0])
        starts = np.concatenate([[True], conv[1:] != conv[:-1]])
        goes_on = conv[0] == self.conv
        at = np.flatnonzero(starts)
        seg = np.cumsum(starts) - 1
        held = info[:, at].copy()
        seen = ~own[at]
        if goes_on:
            held[:, 0], seen[0] = self.info, self.seen
        carry = np.zeros(len(at), np.int64)

        def running(values: np.ndarray, before: int) -> np.ndarray:
            total = np.cumsum(values)
            add = carry.copy()
            add[0] = before if goes_on else 0
            return total - (total[at] - values[at])[seg] + add[seg]

        k = running(own.astype(np.int64), self.k) - 1
        words = running(np.where(own, w, 0), self.words)
        row = dict(zip(INFO, held[:, seg], strict=True))
        known = seen[seg]
        out = {"unseen": ~known}
        self.sums = list(self.sums)
        for i, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            part = np.where(own, t[i] * powers(base, prime, np.maximum(k, 0)) % prime, 0)
            total = running(part, self.sums[i]) % prime
            back = np.array([pow(base, -j, prime) for j in range(HEADS)], np.int64)
            for name, value in (("f", total), ("g", (total - part) % prime)):
                final = (row[f"h{i + 1}"] + back[np.clip(row["h"] - row["nh"], 0, HEADS - 1)] * ((value - row[f"s{i + 1}"]) % prime)) % prime
                out[f"{name}{i + 1}"] = np.where(~own, 0, np.where(known, final, value))
            self.sums[i] = int(total[-1])
        depth = row["nh"] + k - row["h"] + 1
        out["depth"] = np.where(~own, 0, np.where(known, depth, k))
        out["len"] = row["nh"] + np.maximum(row["n_own"] - row["h"], 0)
        out["wpre"] = np.where(~own, 0, words - w + np.where(known, row["hw"] - row["sw"], 0))
        out["keep"] = ~own | ~known | (k >= row["h"])
        self.conv, self.k, self.words = int(conv[-1]), int(k[-1]) + 1, int(words[-1])
        self.seen, self.info = bool(seen[-1]), held[:, -1]
        return out

    def edge(self) -> list[int]:
        return [self.first, self.conv, int(self.seen), self.k, *self.sums, self.words, *map(int, self.info)]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan, part = Scan(), 0
    fields = [f.split() for f in ROWS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        conv, w = col["conv_id"].to_numpy(), col["w"].to_numpy()
        part = int(col["part"][0].as_py())
        found = scan.feed(conv, col["own"].to_numpy(zero_copy_only=False), [col["t1"].to_numpy(), col["t2"].to_numpy()], w, np.stack([col[x].to_numpy() for x in INFO]))
        keep = pa.array(found["keep"])
        found.update(conv_id=conv, part=np.full(len(conv), part, np.int32), w=w)
        arrays = [pa.array(found[n], schema.field(n).type) if n in found else col[n] if n in col else pa.nulls(len(conv), schema.field(n).type) for n, _ in fields]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema).filter(keep)
    if scan.first is not None:
        last = {"conv_id": [scan.conv], "part": [part], "edge": [scan.edge()]}
        yield pa.RecordBatch.from_arrays([pa.array(last.get(n, [None]), schema.field(n).type) for n, _ in fields], schema=schema)


def carried(edges: list[tuple[int, list[int]]]) -> list[tuple[int, ...]]:
    """For each range whose first conversation began before it: (part, a1, b1, a2, b2, words, shift, nh,
    len), so that a true fingerprint is a + b * its own sum, a depth shift + its own place."""
    out, held = [], None
    for part, edge in sorted(edges):
        first, last, seen, k, s1, s2, words = edge[:7]
        sums, info = [s1, s2], dict(zip(INFO, edge[7:], strict=True))
        if held and held["conv"] == first:
            maps = []
            for i, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
                back = pow(base, held["nh"] - held["h"], prime)
                maps += [(held[f"h{i + 1}"] + back * (held["sums"][i] - held[f"s{i + 1}"])) % prime, back * pow(base, held["k"], prime) % prime]
            length = held["nh"] + max(held["n_own"] - held["h"], 0)
            out.append((part, *maps, held["hw"] - held["sw"] + held["words"], held["nh"] - held["h"] + 1 + held["k"], held["nh"], length))
        if seen:
            held = {"conv": last, "k": k, "sums": sums, "words": words, **info}
        elif held and held["conv"] == last:
            held["sums"] = [(a + pow(b, held["k"], p) * s) % p for a, s, p, b in zip(held["sums"], sums, PRIMES, BASES, strict=True)]
            held["k"], held["words"] = held["k"] + k, held["words"] + words
    return out


def _weighted(t: str, place: Column, i: int) -> Column:
    """The part of a fingerprint that a turn at one of the first places has."""
    factor = F.element_at(F.array(*[F.lit(pow(BASES[i], j, PRIMES[i])).cast("long") for j in range(HEADS)]), (place + 1).cast("int"))
    return F.pmod(F.col(t) * factor, F.lit(PRIMES[i]))


def _turns(df: DataFrame, bits: int) -> DataFrame:
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    tie = F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")))
    mask = F.lit((1 << bits) - 1).cast("long")
    hashes = [F.pmod(h.bitwiseAND(mask), F.lit(p - 1)) + 1 for h, p in zip((F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "role", "text")), PRIMES, strict=True)]
    return rows.select("*", tie.alias("tie"), hashes[0].alias("t1"), hashes[1].alias("t2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("w"))


def _heads_of(conv: str) -> Column:
    return F.pmod(F.crc32(F.col(conv).cast("string")), F.lit(HEADS))


def rebuild(df: DataFrame, bits: int = 63) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, depth, fp, pfp, wpre, w, len, role, text) of each rebuilt turn and of each conversation's
    depth 0, and the work tables that hold them. `bits`: of the turns' hashes (few only to test collisions)."""
    spark = df.sparkSession
    turns = _turns(df, bits)
    # a limit of three rows a conversation is applied in each task before anything is dealt out
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "tie"))
    base_only = F.col("conv_id") % EVERY == 0
    slim = turns.select("conv_id", "turn", "tie", "t1", "t2", "w", F.when(base_only, F.col("role")).alias("role"), F.when(base_only, F.col("text")).alias("text"))
    firsts = materialise(slim.withColumn("p", place).where(f"p < {HEADS}").select("conv_id", (F.col("p") - 1).alias("p"), "t1", "t2", "w", "role", "text"), "firsts")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")).select("*", _heads_of("conv_id").cast("long").alias("h"))
    convs = materialise(convs, "convs")

    lent = firsts.where(base_only).withColumnRenamed("conv_id", "base")
    heads = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY).join(lent, "base").where("p < h")
    upto = Window.partitionBy("conv_id").orderBy("p")  # three rows at most
    sums = [F.pmod(F.sum(_weighted(f"t{i + 1}", F.col("p"), i)).over(upto), F.lit(PRIMES[i])).alias(f"f{i + 1}") for i in (0, 1)]
    heads = heads.select("conv_id", "p", "h", "n_own", "w", "role", "text", *sums, (F.sum("w").over(upto) - F.col("w")).alias("wpre"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("nh"), F.lag("p").over(upto).alias("_l"))
    back = [F.coalesce(F.lag(f"f{i}").over(upto), F.lit(0).cast("long")).alias(f"g{i}") for i in (1, 2)]
    heads = materialise(heads.select("*", *back), "heads")

    pick = lambda name: F.max(F.when(F.col("p") + 1 == F.col("nh"), F.col(name)))
    lead = heads.groupBy("conv_id").agg(F.max("nh").alias("nh"), pick("f1").alias("h1"), pick("f2").alias("h2"), F.sum("w").alias("hw"))
    gone = firsts.where(F.col("p") < _heads_of("conv_id")).groupBy("conv_id").agg(*[F.pmod(F.sum(_weighted(f"t{i + 1}", F.col("p"), i)), F.lit(PRIMES[i])).alias(f"s{i + 1}") for i in (0, 1)], F.sum("w").alias("sw"))
    info = convs.join(lead, "conv_id", "left").join(gone, "conv_id", "left")
    info = materialise(info.select("conv_id", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in INFO]), "info")

    kind = turns.schema["turn"].dataType.simpleString()
    marks = info.select("conv_id", F.lit(False).alias("own"), F.lit(None).cast(kind).alias("turn"), F.lit(None).cast("string").alias("tie"), *[F.lit(0).cast("long").alias(x) for x in ("t1", "t2", "w")], F.lit("").alias("role"), F.lit("").alias("text"), *INFO)
    own = turns.select("conv_id", F.lit(True).alias("own"), "turn", "tie", "t1", "t2", "w", "role", "text", *[F.lit(0).cast("long").alias(x) for x in INFO])
    order = [F.col("conv_id"), F.col("own"), F.col("turn").asc_nulls_first(), F.col("tie")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row's number last: even a long run of one repeated turn can be split
    dealt = marks.unionByName(own).withColumn("n", F.monotonically_increasing_id()).repartitionByRange(parts, *order, F.col("n")).sortWithinPartitions(*order)
    scanned = materialise(dealt.drop("turn", "tie", "n").withColumn("part", F.spark_partition_id()).mapInArrow(_scanned, ROWS), "scanned")
    release(firsts, convs, info)

    edges = [(r.part, list(r.edge)) for r in scanned.where("edge is not null").select("part", "edge").collect()]  # a row a range
    moves = spark.createDataFrame(carried(edges), "part int, a1 long, b1 long, a2 long, b2 long, words long, shift long, mnh long, mlen long")
    rows = scanned.where("edge is null").join(F.broadcast(moves), "part", "left")
    fix = lambda name, i: F.when(F.col("unseen"), F.pmod(F.col(f"a{i}") + F.col(f"b{i}") * F.col(f"{name}{i}"), F.lit(PRIMES[i - 1]))).otherwise(F.col(f"{name}{i}"))
    both = lambda name: F.shiftleft(fix(name, 1), 31).bitwiseOR(fix(name, 2))
    depth = F.when(F.col("unseen"), F.col("depth") + F.col("shift")).otherwise(F.col("depth"))
    rows = rows.where(~F.col("unseen") | (F.col("depth") + F.col("shift") > F.col("mnh"))).select(
        "conv_id", depth.alias("depth"), both("f").alias("fp"), both("g").alias("pfp"), F.when(F.col("unseen"), F.col("wpre") + F.col("words")).otherwise(F.col("wpre")).alias("wpre"), "w", F.when(F.col("unseen"), F.col("mlen")).otherwise(F.col("len")).alias("len"), "role", "text"
    )
    length = F.col("nh") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0).cast("long"))
    packed = lambda x: F.shiftleft(F.col(f"{x}1"), 31).bitwiseOR(F.col(f"{x}2"))
    front = heads.select("conv_id", (F.col("p") + 1).cast("long").alias("depth"), packed("f").alias("fp"), packed("g").alias("pfp"), "wpre", "w", length.alias("len"), "role", "text")
    return rows.unionByName(front), [scanned, heads]


def _told_apart(rows: DataFrame, marks: DataFrame | None) -> DataFrame:
    """rows with split and psplit: hashes of the marks that a conversation has up to a depth, and to its parent's."""
    if marks is None:
        return rows.withColumn("split", F.lit(0).cast("long")).withColumn("psplit", F.lit(0).cast("long"))
    by_conv = materialise(marks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "v"))).alias("marks")), "marks")
    bits = filter_bits(by_conv)
    some = may_be_in(F.col("conv_id"), key_filter(by_conv.select("conv_id"), bits), bits)
    upto = lambda depth, old: F.when(F.exists("marks", lambda m: m.depth <= depth), F.xxhash64(old, F.filter("marks", lambda m: m.depth <= depth))).otherwise(old)
    joined = rows.where(some).join(by_conv, "conv_id", "left").select(*[c for c in rows.columns if c not in ("split", "psplit")], upto(F.col("depth"), F.col("split")).alias("split"), upto(F.col("depth") - 1, F.col("psplit")).alias("psplit"))
    return rows.where(~some).unionByName(joined)


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with split and psplit, nodes of several conversations, their members): candidates are split
    until every member's turns are its representative's."""
    rows = _told_apart(rows, None)
    key = ["fp", "depth", "split"]
    while True:
        shared = rows.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("depth") < F.col("len"), 1).otherwise(0)).alias("going")).where("n > 1")
        shared = materialise(shared, "shared")
        hot = shared.where(F.col("n") >= HOT).select("fp")
        bits = filter_bits(shared)
        maybe = rows.where(may_be_in(F.col("fp"), key_filter(shared.select("fp"), bits), bits))
        members = materialise(dealt_join(maybe, shared, key, hot, "conv_id"), "members")
        first = members.where("conv_id = rep and depth > 0").select(*key, F.col("role").alias("_role"), F.col("text").alias("_text"), F.col("pfp").alias("_pfp"), F.col("psplit").alias("_psplit"))
        others = members.where("conv_id <> rep and depth > 0").select(*key, "conv_id", "role", "text", "pfp", "psplit")
        same = (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text")) & (F.col("pfp") == F.col("_pfp")) & (F.col("psplit") == F.col("_psplit"))
        bad = materialise(dealt_join(others, first, key, hot, "conv_id").where(~same).select(*others.columns), "collisions")
        if not bad.limit(1).count():
            release(bad)
            return rows, shared, members
        turn = [*key, "pfp", "psplit", "role", "text"]
        marks = bad.join(bad.groupBy(*turn).agg(F.min("conv_id").alias("v")), turn).select("conv_id", "depth", "v")
        rows = _told_apart(rows, marks)
        release(shared, members)


def _pieces(size: int):
    """The identifiers of each node's ends, sorted by (rep, depth, conv_id), as text in pieces of `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, number, cut = None, [], 0, False

        def piece(whole: bool):
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, ids[0], ",".join(map(str, ids)), whole)], names=["rep", "depth", "start", "ids", "whole"])

        for batch in batches:
            for rep, depth, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (rep, depth) != held:
                    if held is not None:
                        yield piece(number > 0 and not cut)  # a range's first node may have begun in another range
                        number += 1
                    held, ids, cut = (rep, depth), [], False
                elif len(ids) >= size:
                    yield piece(False)
                    ids, cut = [], True
                ids.append(conv)
        if held is not None:
            yield piece(False)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node of its pieces in order; a piece at a time."""
    held, state = None, None
    for batch in batches:
        reps, depths, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for rep, depth, ids in zip(reps, depths, texts, strict=True):
            if (rep, depth) != held:
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, state.hexdigest())], names=["rep", "depth", "ends"])
                held, state = (rep, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, state.hexdigest())], names=["rep", "depth", "ends"])


def _ends(members: DataFrame) -> DataFrame:
    """(rep, depth, ends): the digest of the conversations that end at each node of several."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["rep", "depth", "conv_id"]
    ending = members.where("depth = len").select(*order)
    pieces = ending.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pieces(PIECE), "rep long, depth long, start long, ids string, whole boolean")
    pieces = materialise(pieces, "ends")
    loose = pieces.where("not whole").repartition("rep", "depth").sortWithinPartitions("rep", "depth", "start").select("rep", "depth", "ids")
    return pieces.where("whole").select("rep", "depth", F.sha2("ids", 256).alias("ends")).unionByName(loose.mapInArrow(_digests, "rep long, depth long, ends string"))


def prefix_trie(df: DataFrame, *, bits: int = 63) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. df: conv_id, turn, role, text."""
    rows, tables = rebuild(df, bits)
    rows, shared, members = verified(rows)
    key = ["fp", "depth", "split"]
    slim = members.drop("role", "text")

    # of each conversation: words of the turns in which another represents it, whether it ends in a
    # leaf that it represents, and its last depth in company
    blocked = (F.col("depth") == F.col("len")) & ((F.col("conv_id") != F.col("rep")) | (F.col("going") > 0))
    alone = materialise(slim.groupBy("conv_id").agg(F.sum(F.when(F.col("conv_id") != F.col("rep"), F.col("w")).otherwise(0)).alias("led"), (~F.max(blocked)).cast("long").alias("leaf"), F.max("depth").alias("deepest"), F.count(F.lit(1)).alias("turns")), "company")
    hot = alone.where(F.col("turns") >= HOT).select("conv_id")
    both = dealt_join(slim, alone.drop("turns"), ["conv_id"], hot, "depth")
    leaves_here = (F.col("depth") == F.col("deepest")) & (F.col("depth") < F.col("len"))
    saved = F.when(F.col("conv_id") != F.col("rep"), F.col("led") - F.col("wpre")).otherwise(0)
    nodes = both.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved"), F.sum(leaves_here.cast("long")).alias("single"), F.min("pfp").alias("pfp"), F.min("psplit").alias("psplit"))
    nodes = materialise(nodes, "nodes")

    above = [F.col("pfp").alias("fp"), (F.col("depth") - 1).alias("depth"), F.col("psplit").alias("split")]
    branches = materialise(nodes.where("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("several")), "branches")
    wide = branches.where(F.col("several") >= HOT).select("fp")
    parents = shared.select(*key, F.col("rep").alias("parent"))
    up = nodes.select(*above, F.col("fp").alias("_fp"), F.col("depth").alias("_depth"), F.col("split").alias("_split"), "rep", "n", "n_leaves", "saved", "single")
    up = dealt_join(up, parents, key, wide, "_fp", how="left").select(F.col("_fp").alias("fp"), F.col("_depth").alias("depth"), F.col("_split").alias("split"), "parent", "rep", "n", "n_leaves", "saved", "single")
    whole = up.join(branches, key, "left").join(_ends(members), ["rep", "depth"], "left")
    out = whole.select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("single") + F.coalesce("several", F.lit(0))).cast("long").alias("n_children"), "n_leaves", F.col("saved").cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))

    # nodes of one conversation: only those that a filter of the shared ones lets through are joined
    bits_ = filter_bits(shared)
    filter_ = key_filter(shared.select("fp"), bits_)
    hot = shared.where(F.col("n") >= HOT).select("fp")
    thin = rows.drop("role", "text", "wpre", "w")
    passes = may_be_in(F.col("fp"), filter_, bits_)
    unsure = dealt_join(thin.where(passes), parents, key, hot, "conv_id", how="left").where("parent is null").drop("parent")
    single = thin.where(~passes).unionByName(unsure)
    below = may_be_in(F.col("pfp"), filter_, bits_) & (F.col("depth") > 0)
    child = single.where(below).select("conv_id", F.col("depth").alias("_depth"), "len", *above)
    child = dealt_join(child, parents, key, hot, "conv_id", how="left").select("conv_id", F.col("_depth").alias("depth"), "len", F.coalesce("parent", "conv_id").alias("parent"))
    rest = single.where(~below).select("conv_id", "depth", "len", F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS))
    return out.unionByName(child.unionByName(rest).select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("depth") < F.col("len"), one).otherwise(none).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256")))
