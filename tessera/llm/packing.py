"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are integers of at most the largest permitted sequence, so best-fit decreasing is worked
out exactly on their histogram: all bins with the same room take the same run of lengths at once,
and the plan has a size bounded by the permitted lengths, whatever the number of documents. Where
no open bin has room, the length of the least cost for each token it is expected to hold is opened,
among a set of the permitted ones. The lengths are optimised jointly: every set that holds the longest
piece is planned, with each of several expectations of what still fills a bin, by tasks of the cluster,
and the plan of the least total cost is taken. (Sets double with each permitted length, so these should
be few.) At the end each bin is cut down to the smallest permitted length that holds its contents.

The documents then only need their rank among the pieces of equal length: pieces are counted in
cells of bounded size, so one common length does not meet in one task.

A token is a UTF-8 byte of the text, or with `ids_col` an id of an array column, such as
byte-level BPE encoding gives; arrays are cut at the largest sequence. Texts longer than the largest sequence are cut into pieces, each at the
last start of a character that leaves no piece longer than it. Null and empty texts and arrays have length 0 and take no bin (bin_id null, one row each).
Repeated rows are packed each for itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

SIZES = (512, 1024, 2048, 4096, 8192)
#: A sequence of S tokens costs S + S*S/ATTENTION.
ATTENTION = 65_536
#: Shares of a new bin's room that shorter pieces are expected to fill.
EXPECTATIONS = (0.0, 0.5, 0.9, 1.0)
#: Pieces of one cell, at least; of large inputs the square root of all pieces.
CELL_ROWS = 250


class Plan:
    """What best-fit decreasing does to a histogram of lengths.

    runs: (length, first rank, end rank, first bin, items a bin, offset in the bin)
    bins: (first bin, end bin, capacity, used)
    rooms: room left in the opened lengths, before bins are cut down: number of bins
    """

    def __init__(self, counts: dict[int, int], sizes: tuple[int, ...], expect: float, attention: float = ATTENTION, opened: tuple[int, ...] = ()):
        self.sizes, self.opened, self.attention = tuple(sorted(sizes)), tuple(sorted(opened or sizes)), attention
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.bins: list[tuple[int, int, int, int]] = []
        self.n_bins = 0
        open_at: dict[int, list[tuple[int, int, int]]] = {}  # room: (first bin, end bin, used)
        rooms: list[int] = []
        rest = sum(length * n for length, n in counts.items())

        def put(first: int, end: int, used: int, room: int) -> None:
            if first < end:
                if room not in open_at:
                    open_at[room] = []
                    insort(rooms, room)
                open_at[room].append((first, end, used))

        for length in sorted((x for x, n in counts.items() if x > 0 and n > 0), reverse=True):
            left, rank = counts[length], 0
            rest -= length * left
            while left:
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, end, used = open_at[room].pop()
                    if not open_at[room]:
                        del open_at[room]
                        rooms.pop(at)
                else:
                    room = self._open(length, left, rest, expect)
                    first, used = self.n_bins, 0
                    end = first - (-left // (room // length))
                    self.n_bins = end
                each = room // length
                full = min(end - first, left // each)
                if full:
                    self.runs.append((length, rank, rank + full * each, first, each, used))
                    put(first, first + full, used + each * length, room - each * length)
                    rank, left = rank + full * each, left - full * each
                if full < end - first and left and left < each:
                    self.runs.append((length, rank, rank + left, first + full, left, used))
                    put(first + full, first + full + 1, used + left * length, room - left * length)
                    rank, left, full = rank + left, 0, full + 1
                put(first + full, end, used, room)
        self.rooms = {room: sum(end - first for first, end, _ in groups) for room, groups in open_at.items()}
        for groups in open_at.values():
            for first, end, used in groups:
                self.bins.append((first, end, self.sizes[bisect_left(self.sizes, used)], used))
        self.bins.sort()

    def _open(self, length: int, left: int, rest: int, expect: float) -> int:
        def price(size: int) -> float:
            own = min(size // length, left) * length
            filled = own + min(expect * (size - own), rest)
            return self.price(size) / filled

        return min((s for s in self.opened if s >= length), key=lambda s: (price(s), s))

    def price(self, size: int) -> float:
        return size + size * size / self.attention

    @property
    def cost(self) -> float:
        return sum((end - first) * self.price(capacity) for first, end, capacity, _ in self.bins)


def choices(counts: dict[int, int], sizes: tuple[int, ...]) -> list[tuple[tuple[int, ...], float]]:
    """Every set of lengths to open that holds the longest piece, with every expectation."""
    longest, sizes = max((x for x, n in counts.items() if n), default=0), tuple(sorted(sizes))
    if longest > sizes[-1]:
        raise ValueError(f"length {longest} is over the largest permitted length {sizes[-1]}")
    sets = chain.from_iterable(combinations(sizes, n) for n in range(1, len(sizes) + 1))
    return [(opened, expect) for opened in sets if opened[-1] >= longest for expect in EXPECTATIONS]


def best_plan(counts: dict[int, int], sizes: tuple[int, ...] = SIZES, attention: float = ATTENTION, spark: SparkSession | None = None) -> Plan:
    """The cheapest plan over all choices (of equally cheap ones the first), judged by tasks of spark, if given."""
    options = choices(counts, sizes)
    make = lambda k: Plan(counts, sizes, options[k][1], attention, options[k][0])
    if spark is None:
        return min(map(make, range(len(options))), key=lambda p: p.cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [make(k).cost for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.float64())], names=["id", "cost"])

    costs = spark.range(0, len(options), 1, len(options)).mapInArrow(run, "id long, cost double").collect()  # a row a choice
    return make(min(costs, key=lambda r: (r.cost, r.id)).id)


def pieces_of(df: DataFrame, longest: int, *, id_col: str = "doc_id", text_col: str = "text", content: bool = False) -> DataFrame:
    """Rows of (id_col, piece, length[, content]): every document in pieces of `longest` bytes at most.

    Piece k starts at the first byte of the character that byte k * (longest - 3) is in; a character
    has four bytes at most, so no piece is longer than `longest`.
    """
    if longest < 7:
        raise ValueError("a piece has room for two characters at least")
    raw = df.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))
    raw = raw.withColumn("n", F.octet_length("raw"))
    step = longest - 3
    last = F.when(F.col("n") > longest, F.ceil(F.col("n") / step) - 1).otherwise(0).cast("int")
    cut = raw.select("id", "n", "raw", F.explode(F.sequence(F.lit(0), last)).alias("piece"))

    def start(k: Column) -> Column:
        at = k * step
        inside = lambda back: F.hex(F.substring("raw", at - back + 1, 1)).rlike("^[89AB]")  # noqa: E731  not a character's first byte
        back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
        return F.when((k == 0) | (at >= F.col("n")), F.least(at, F.col("n"))).otherwise(at - back)

    end = F.when(F.col("n") > longest, start(F.col("piece") + 1)).otherwise(F.col("n"))
    cut = cut.select("id", "raw", "piece", start(F.col("piece")).alias("a"), end.alias("b"))
    columns = [F.col("id").alias(id_col), "piece", (F.col("b") - F.col("a")).cast("int").alias("length")]
    if content:
        columns.append(F.substring("raw", F.col("a") + 1, F.col("b") - F.col("a")).alias("content"))
    return cut.select(*columns)


def pieces_of_ids(df: DataFrame, longest: int, *, id_col: str = "doc_id", ids_col: str = "ids", content: bool = False) -> DataFrame:
    """Rows of (id_col, piece, length[, content]): every array in pieces of `longest` ids at most."""
    ids = F.col(ids_col)
    raw = df.select(F.col(id_col).alias("id"), ids.alias("ids"), F.coalesce(F.when(ids.isNotNull(), F.size(ids)), F.lit(0)).alias("n"))
    last = F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("int")
    cut = raw.select("id", "ids", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    length = F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int")
    columns = [F.col("id").alias(id_col), "piece", length.alias("length")]
    if content:
        columns.append(F.slice("ids", F.col("piece") * longest + 1, longest).alias("content"))
    return cut.select(*columns)


def best_fit_pack(df: DataFrame, sizes: tuple[int, ...] = SIZES, *, id_col: str = "doc_id", text_col: str = "text", ids_col: str | None = None, content: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows of (id_col, piece, length, bin_id, bin_offset, capacity, bin_used[, content])."""
    spark = df.sparkSession
    longest = max(sizes)
    if ids_col is None:
        own = pieces_of(df, longest, id_col=id_col, text_col=text_col, content=content)
    else:
        own = pieces_of_ids(df, longest, id_col=id_col, ids_col=ids_col, content=content)
    own = materialise(own.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r["count"] for r in own.groupBy("length").count().collect()}  # one row a length
    plan = best_plan({x: n for x, n in counts.items() if x}, sizes, spark=spark)

    cell_rows = max(cell_rows, math.isqrt(sum(counts.values())))
    cells = spark.createDataFrame([(x, -(-n // cell_rows)) for x, n in counts.items()], "length int, _cells int")
    celled = own.join(F.broadcast(cells), "length")  # a row for each length up to `longest`
    celled = celled.withColumn("_cell", F.pmod(F.xxhash64("_row"), F.col("_cells")).cast("int")).drop("_cells")
    sums = celled.groupBy("length", "_cell").count()
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("length", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("_row"))
    ranked = celled.withColumn("_in", inside).join(offsets, ["length", "_cell"])
    tail = ["content"] if content else []
    ranked = ranked.select(id_col, "piece", "length", (F.col("_before") + F.col("_in") - 1).alias("_rank"), *tail)

    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 6)
    bins = np.array(plan.bins, dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((runs, bins))  # bounded by the permitted lengths
    kind = ranked.schema[0].dataType.simpleString()
    fields = f"`{id_col}` {kind}, piece int, length int, bin_id long, bin_offset int, capacity int, bin_used int"
    if content:
        fields += f", content {ranked.schema['content'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, bins = shared.value
        key = (runs[:, 0] << 45) + runs[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(2).to_numpy().astype(np.int64)
            rank = batch.column(3).to_numpy()
            none = length == 0
            if len(runs):
                r = runs[np.maximum(np.searchsorted(key, (length << 45) + rank, "right") - 1, 0)]
                within = rank - r[:, 1]
                number = r[:, 3] + within // r[:, 4]
                offset = r[:, 5] + within % r[:, 4] * length
                b = bins[np.maximum(np.searchsorted(bins[:, 0], number, "right") - 1, 0)]
            else:
                number, offset, b = length, length, np.zeros((len(length), 4), dtype=np.int64)
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(number, pa.int64(), mask=none)]
            arrays += [pa.array(x.astype(np.int32), pa.int32(), mask=none) for x in (offset, b[:, 2], b[:, 3])]
            names = [id_col, "piece", "length", "bin_id", "bin_offset", "capacity", "bin_used"]
            if content:
                arrays.append(batch.column(4))
                names.append("content")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return ranked.mapInArrow(run, fields)
