"""Operator 10, packing: cutting stock by column generation.

Each text is tokenized, ended by one closing id and cut at multiples of the sequence length, so
only its last piece is shorter.  Piece lengths make a histogram of at most ``capacity`` classes,
whatever the corpus.  On that histogram the driver solves the cutting-stock linear program by
column generation, from patterns of one class each: a knapsack dynamic program over the classes
prices new patterns, and simplex steps take the best ones in.  A second kind of column cuts a piece
into powers of two, priced with the others.  Pattern counts are rounded down; what is left over (a
few pieces for each class) is filled largest first.  Spark then ranks the pieces of each class, and
a small table of rank ranges gives every piece its sequence.

A rank within a class is the rank within one of many hash buckets plus the sizes of the buckets
before, so a class with a third of all pieces is still ranked by many tasks.

Rules for odd input: a null text counts as empty and has the closing id alone; repeated rows are
packed as often as they occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm.common import cut_lineage, ship_by_value
from vicinity.llm.pretoken import PreTokens

CAPACITY = 2048
CLOSING_ID = 1
#: Worth of a column, in sequences, below which it is not taken in, and share by which the program's
#: value may miss the bound total length / capacity.
GAP = 1e-3
#: Patterns, and cuts, that one pricing offers to the program.
COLUMNS_A_STEP = 64
#: Steps of the simplex method between fresh inversions.
REFRESH = 250
#: Pre-tokens whose ids a task remembers.
REMEMBERED = 300_000
#: Pieces of one class that one ranking task should see.
BUCKET_ROWS = 20_000


class _Ids(dict):
    """Ids of pre-tokens as little-endian bytes, found once while remembered."""

    def __init__(self, pre: PreTokens) -> None:
        super().__init__()
        self._pre = pre

    def __missing__(self, key: str | int) -> bytes:
        value = np.asarray([key] if isinstance(key, int) else self._pre.ids(key), "<u4").tobytes()
        self[key] = value
        return value


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str | None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, part_crcs)``: texts cut at multiples of the
    capacity, with the checksums of the binary parts that a last piece can be cut into."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(
        T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")),
        T.StructField("part_crcs", T.ArrayType(T.LongType()))])
    closing = np.asarray([CLOSING_ID], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches):
        pre = PreTokens(path)
        known = _Ids(pre)
        for batch in batches:
            row, start, length, crc, total, parts = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = b"".join(map(known.__getitem__, pre.ordered(value.as_py() or ""))) + closing
                for at in range(0, len(ids), step):
                    piece = ids[at:at + step]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
                    parts.append([])
                    if len(piece) < step:
                        begin = 0
                        for size in binary_parts(len(piece) // 4):
                            parts[-1].append(zlib.crc32(piece[begin:begin + 4 * size]))
                            begin += 4 * size
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(
                pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(parts, pa.list_(pa.int64()))], names=schema.names)

    ship_by_value()
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def _knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack for every room up to the capacity: largest total price, and the class
    taken last for it (-1: a place left empty)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room], fit = best[room - 1], fits[room]
        if fit:
            values = best[room - sizes[:fit]] + price[:fit]
            j = int(values.argmax())
            if values[j] > best[room] + 1e-12:
                best[room], last[room] = values[j], j
    return best, last


def _pattern(sizes: np.ndarray, last: np.ndarray, capacity: int, first: int) -> np.ndarray:
    """The best pattern among those that have the class ``first``."""
    pattern, room = np.zeros(len(sizes)), capacity - int(sizes[first])
    pattern[first] = 1
    while room > 0:
        j = last[room]
        if j < 0:
            room -= 1
        else:
            pattern[j] += 1
            room -= int(sizes[j])
    return pattern


def binary_parts(size: int) -> list[int]:
    """Powers of two, largest first, that a length is cut into where cutting pays."""
    return [1 << k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]


class Master:
    """The restricted program ``min cost @ x`` with ``columns @ x = demand`` and ``x >= 0``.

    Its first columns hold one class each, as often as it fits.  Demands are raised by less than a
    thousandth of a piece, each by its own fraction, so that no step of the simplex method has length
    zero and the method cannot cycle; rounding the counts removes it again.
    """

    def __init__(self, sizes: np.ndarray, demand: np.ndarray, capacity: int) -> None:
        m = len(sizes)
        fit = capacity // sizes
        self.demand = demand + 1e-3 * np.random.default_rng(m).random(m)
        self.columns, self.inverse = np.diag(fit.astype(float)), np.diag(1 / fit)
        self.cost, self.x, self.price = np.ones(m), self.demand / fit, 1 / fit
        self.pivots = 0

    @property
    def value(self) -> float:
        return float(self.cost @ self.x)

    def enter(self, column: np.ndarray, cost: float, least: float) -> bool:
        """Takes a column in if it is worth more than ``least`` at the prices of this moment."""
        worth = float(self.price @ column) - cost
        if worth <= least:
            return False
        used = np.flatnonzero(column)
        direction = self.inverse[:, used] @ column[used]
        usable = np.flatnonzero(direction > 1e-7)
        if not len(usable):
            return False
        ratio = self.x[usable] / direction[usable]
        out = int(usable[ratio.argmin()])
        step = self.x[out] / direction[out]
        self.x = np.maximum(self.x - step * direction, 0)
        row = self.inverse[out] / direction[out]
        rows, cols = np.flatnonzero(np.abs(direction) > 1e-13), np.flatnonzero(row)
        self.inverse[np.ix_(rows, cols)] -= np.outer(direction[rows], row[cols])
        self.inverse[out] = row
        self.price = self.price - worth * row
        self.x[out], self.cost[out], self.columns[:, out] = step, cost, column
        self.pivots += 1
        if self.pivots % REFRESH == 0:  # rounding errors do not pile up
            self.inverse = np.linalg.inv(self.columns)
            self.x = np.maximum(self.inverse @ self.demand, 0)
            self.price = self.cost @ self.inverse
        return True


@dataclass
class Solution:
    columns: np.ndarray
    x: np.ndarray
    cost: np.ndarray
    #: Columns that pricing made, and those of them that entered the program.
    priced: int
    entered: int


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> Solution:
    """Column generation over the whole histogram.

    A column of cost 1 is a pattern; one of cost 0 cuts a piece into its binary parts (+1 for the
    piece, -1 for each part, all of which are among the classes).  One knapsack prices the best
    pattern for every class; the most valuable ``COLUMNS_A_STEP`` of them and as many cuts are
    offered to the program, each at the prices the one before has left.  Prices are first drawn half
    way to ``size / capacity``, prices under which no column pays, which steadies them; where that
    finds nothing, the program's own prices are used.  Ends when at those no column is worth more
    than ``gap``, or when the value is within ``gap`` of total length / capacity, below which no
    plan can be.  There is no other limit.
    """
    m = len(sizes)
    least = float(sizes @ demand) / capacity
    at = {int(s): i for i, s in enumerate(sizes)}
    cuts = np.zeros((m, m))  # row i: the column that cuts class i
    for s, i in at.items():
        if s & (s - 1):
            cuts[i, i] = 1
            cuts[i, [at[p] for p in binary_parts(s)]] = -1
    program = Master(sizes, demand, capacity)
    steady, priced, entered = sizes / capacity, 0, 0
    share = 0.5
    while True:
        price = (1 - share) * program.price + share * steady
        positive = np.maximum(price, 0)
        best, last = _knapsack(sizes, positive, capacity)
        worth, saved = positive + best[capacity - sizes] - 1, cuts @ price
        if not share and max(worth.max(), saved.max()) <= gap:
            break
        floor = 0 if share else gap
        offers = [(worth[i], 1.0, _pattern(sizes, last, capacity, i)) for i in np.argsort(-worth, kind="stable")[:COLUMNS_A_STEP] if worth[i] > floor]
        offers += [(saved[i], 0.0, cuts[i]) for i in np.argsort(-saved, kind="stable")[:COLUMNS_A_STEP] if saved[i] > floor]
        priced += len(offers)
        taken = sum(program.enter(column, cost, gap / 2) for _, cost, column in sorted(offers, key=lambda o: -o[0]))
        entered += taken
        if program.value <= least * (1 + gap):
            break
        if not taken and not share:
            break
        share = 0.5 if taken else 0.0
    return Solution(program.columns, program.x, program.cost, priced, entered)


def plan_sequences(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns ``{size: copies}`` with the number of sequences of each, and ``{size: pieces to cut
    into binary parts}``; together they cover the histogram exactly."""
    plan: list[tuple[dict[int, int], int]] = []
    cut: dict[int, int] = {}
    if not histogram:
        return plan, cut
    powers = [1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity]
    sizes = np.array(sorted({*histogram, *powers}), np.int64)
    at = {int(s): i for i, s in enumerate(sizes)}
    left = np.array([histogram.get(int(s), 0) for s in sizes], np.int64)
    solution = solve_patterns(sizes, left, capacity)
    columns, x, cost = solution.columns, solution.x, solution.cost
    for j in np.flatnonzero((cost == 0) & (x > 1e-6)):
        i = int(columns[:, j].argmax())
        times = int(min(np.ceil(x[j] - 1e-6), left[i]))
        if times:
            cut[int(sizes[i])] = cut.get(int(sizes[i]), 0) + times
            left[i] -= times
            left[[at[p] for p in binary_parts(int(sizes[i]))]] += times
    for j in np.argsort(-x, kind="stable"):
        copies = np.rint(columns[:, j]).astype(np.int64)
        used = copies > 0
        if cost[j] and x[j] >= 1 - 1e-6:
            times = int(min(np.floor(x[j] + 1e-6), (left[used] // copies[used]).min()))
            if times > 0:
                left = left - times * copies
                plan.append(({int(sizes[i]): int(copies[i]) for i in np.flatnonzero(used)}, times))
    # The remainder, at most some pieces for each class: largest first, then whatever still fits.
    while left.any():
        room, pattern = capacity, {}
        for i in np.flatnonzero(left)[::-1]:
            k = int(min(left[i], room // sizes[i]))
            if k:
                pattern[int(sizes[i])] = k
                room -= k * int(sizes[i])
        times = min(int(left[at[s]]) // k for s, k in pattern.items())
        for s, k in pattern.items():
            left[at[s]] -= k * times
        plan.append((pattern, times))
    return plan, cut


def _rank_ranges(plan: list[tuple[dict[int, int], int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, int, int, int]]]:
    """``(length, width)`` and ``(length, cell, from_rank, to_rank, first_sequence, copies, first_slot)``.

    The ranks of a length are divided into as many cells of one width as it has ranges, and a range
    is listed in every cell that it reaches into.  The cells of a length thus list less than twice its
    ranges, and a rank that looks in its cell meets fewer than two ranges on average.
    """
    at: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in plan:
        slot = 0
        for size, copies in sorted(pattern.items(), reverse=True):
            begin = at.get(size, 0)
            at[size] = begin + copies * times
            found.setdefault(size, []).append((begin, at[size], sequence, copies, slot))
            slot += copies
        sequence += times
    widths = [(size, max(1, -(-at[size] // len(rows)))) for size, rows in found.items()]
    return widths, [(size, cell, *row) for size, width in widths for row in found[size]
                    for cell in range(row[0] // width, (row[1] - 1) // width + 1)]


def _ranked(pieces: DataFrame, n_rows: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length."""
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(16, -(-n_rows // BUCKET_ROWS)))).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(sizes, ["length", "bucket"])
    return ranked.withColumn("rank", F.col("rank") + F.col("ahead")).drop("bucket", "ahead")


def _small_table(spark, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A table of the plan.  It has at most some dozens of rows for each of the ``capacity`` lengths."""
    return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns)))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece, with its sequence and its offset there."""
    spark = docs.sparkSession
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = cut_lineage(token_pieces(docs, id_col, text_col, capacity, tokenizer_path), "pieces")
    # At most ``capacity`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, cut = plan_sequences(histogram, capacity)
    n_pieces = sum(histogram.values())
    ranked = _ranked(pieces, n_pieces)
    if cut:
        ranked = ranked.join(_small_table(spark, list(cut.items()), ["length", "n_cut"]), "length", "left")
        ranked = ranked.withColumn("rank", F.col("rank") - F.coalesce("n_cut", F.lit(0)))
        parts = ranked.where("rank < 0").withColumn("sizes", F.expr(
            f"filter(transform(sequence({capacity.bit_length() - 1}, 0), k -> shiftleft(1L, k)), p -> (length & p) != 0)"))
        parts = parts.select("doc_id", "start", "doc_tokens", "sizes", F.posexplode("part_crcs").alias("k", "crc")).select(
            "doc_id",
            F.expr("start + aggregate(slice(sizes, 1, k), 0L, (a, p) -> a + p)").alias("start"),
            F.expr("sizes[k]").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens")
        whole = _small_table(spark, [(s, n - cut.get(s, 0)) for s, n in histogram.items()], ["length", "n_whole"])
        parts = _ranked(parts, n_pieces).join(whole, "length", "left")
        parts = parts.withColumn("rank", F.col("rank") + F.coalesce("n_whole", F.lit(0)))
        ranked = ranked.where("rank >= 0").select(*keep, "rank").unionByName(parts.select(*keep, "rank"))
    widths, rows = _rank_ranges(plan)
    ranges = _small_table(spark, rows, ["length", "cell", "from_rank", "to_rank", "first_sequence", "copies", "first_slot"])
    ranked = ranked.join(_small_table(spark, widths, ["length", "width"]), "length").withColumn("cell", F.expr("rank div width"))
    placed = ranked.join(ranges, ["length", "cell"]).where("rank >= from_rank AND rank < to_rank").select(
        *keep,
        F.expr("first_sequence + (rank - from_rank) div copies").alias("sequence_id"),
        F.expr("first_slot + (rank - from_rank) % copies").alias("slot"),
    )
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*keep, "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))
