"""Operator 3, exact top-k search over binary codes: incremental multi-index hashing.

A code is cut into m segments, each with an index of its own.  If two codes differ in at most
``m * a + j`` bits, then one of the first j + 1 segments differs in at most a bits, or one of the
others in at most a - 1.  A step of radius R therefore probes every segment with all keys within
its share of R, verifies the codes found there, and so knows every row within R bits.  Queries with
k rows within R are answered; the others go on with a larger radius.

Rows of equal codes are the same distance from every query, so only the k smallest ids of a code
can matter: the index holds distinct codes with those ids, and a code that a third of all rows
share is one entry.  A pair found in several segments counts in the first of them only, and the
verified distance is a condition of the join, so pairs beyond the radius are never rows.

Rules for odd input: rows with a null vector have no code and are neither found nor queries; null
or missing numbers of a vector are bits 0, those beyond the code are ignored; ties are ordered by
id; rows that repeat an id are one row; with fewer than k codes all are returned; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.common import cut_lineage

BITS = 64
#: Bits by which the covered radius grows from one step to the next.
STEP = 4
#: Codes that one key of a segment holds on average: a probe reads about so many.
CODES_PER_KEY = 64


def sign_code(vector: str, bits: int = BITS) -> Column:
    """The signs of a vector's first numbers, as one long: bit i is set where number i is not negative."""
    if not 1 <= bits <= 64:
        raise ValueError("codes have 1 to 64 bits")
    signs = f"transform(sequence(0, {bits - 1}), i -> if(coalesce(get({vector}, i) >= 0, false), shiftleft(1L, i), 0L))"
    return F.expr(f"if({vector} is null, null, aggregate({signs}, 0L, (a, b) -> a | b))")


def segments_of(bits: int, n_segments: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of segments of nearly equal width."""
    edges = [round(i * bits / n_segments) for i in range(n_segments + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def segment_key(code: str, shift: int, width: int) -> str:
    return f"(shiftrightunsigned({code}, {shift}) & {(1 << width) - 1}L)"


def masks_within(width: int, radius: int) -> list[int]:
    """All keys of at most ``radius`` set bits."""
    return [sum(1 << i for i in at) for r in range(min(radius, width) + 1) for at in combinations(range(width), r)]


def radii(covered: int, n_segments: int) -> list[int]:
    """Radius of each segment's search that covers all codes within ``covered`` bits."""
    a, j = divmod(covered, n_segments)
    return [a if s <= j else a - 1 for s in range(n_segments)]


def _within(entries: DataFrame, active: DataFrame, covered: int, parts: list[tuple[int, int]]) -> DataFrame:
    """``(query_id, code, distance)`` of all pairs within ``covered`` bits, each once.

    ``entries`` is the index: ``(segment, key, code, n_ids)``, one row for each segment of a code."""
    per = radii(covered, len(parts))
    # At most 2**width masks for each segment, whatever the data; kept as one expression.
    masks = [(s, mask) for s, ((_, width), r) in enumerate(zip(parts, per, strict=True)) if r >= 0 for mask in masks_within(width, r)]
    listed = ", ".join(f"{s}:{mask}" for s, mask in masks).replace(" ", "")
    keys = " ".join(f"when {s} then {segment_key('q_code', *part)}" for s, part in enumerate(parts))
    probes = active.select("query_id", "q_code", F.explode(F.split(F.lit(listed), ",")).alias("p")).select(
        "query_id", "q_code", F.expr("cast(split_part(p, ':', 1) as int)").alias("segment"),
        F.expr("cast(split_part(p, ':', 2) as long)").alias("mask"))
    probes = probes.select("query_id", "q_code", "segment", F.expr(f"(case segment {keys} end) ^ mask").alias("key"))
    # The segment in which a pair counts: the first that lies within its radius.
    first = " ".join(f"when bit_count({segment_key('(code ^ q_code)', *part)}) <= {r} then {s}"
                     for s, (part, r) in enumerate(zip(parts, per, strict=True)) if r >= 0)
    near = entries.join(probes, ["segment", "key"]).where(
        f"bit_count(code ^ q_code) <= {covered} and (case {first} end) = segment")
    return near.select("query_id", "code", "n_ids", F.expr("bit_count(code ^ q_code)").alias("distance"))


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str, code_col: str, query_id_col: str, query_code_col: str,
          bits: int = BITS, n_segments: int | None = None, step: int = STEP) -> DataFrame:
    """The k rows nearest to each query: ``query_id, rank, neighbour_id, distance``.

    ``n_segments`` is, by default, chosen so that a key holds about ``CODES_PER_KEY`` codes; a
    segment has four bits at least.
    """
    plain = rows.select(F.col(code_col).alias("code"), F.col(id_col).alias("id")).where("code is not null").distinct()
    # The k smallest ids of each code; the limit on ranks is applied before the shuffle too.
    smallest = Window.partitionBy("code").orderBy("id")
    members = cut_lineage(plain.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k), "hamming-codes")
    index = cut_lineage(members.groupBy("code").agg(F.max("place").alias("n_ids")), "hamming-index")
    active = cut_lineage(queries.select(F.col(query_id_col).alias("query_id"), F.col(query_code_col).alias("q_code"))
                         .where("q_code is not null").distinct(), "hamming-queries")
    n_codes = index.count()
    m = n_segments or max(1, math.ceil(bits / max(4.0, math.log2(max(n_codes / CODES_PER_KEY, 2)))))
    parts = segments_of(bits, m)
    own = ", ".join(f"named_struct('segment', {s}, 'key', {segment_key('code', *part)})" for s, part in enumerate(parts))
    entries = cut_lineage(index.select("code", "n_ids", F.explode(F.expr(f"array({own})")).alias("e")).select(
        "e.segment", "e.key", "code", "n_ids"), "hamming-entries")
    answers = []
    covered = min(bits, m - 1)
    while True:
        near = cut_lineage(_within(entries, active, covered, parts), "hamming-near")
        enough = near.groupBy("query_id").agg(F.sum("n_ids").alias("n")).where(F.col("n") >= k)
        done = near if covered >= bits else near.join(enough.select("query_id"), "query_id", "left_semi")
        answers.append(done if covered >= bits else cut_lineage(done, "hamming-done"))
        if covered >= bits:
            break
        active = cut_lineage(active.join(enough.select("query_id"), "query_id", "left_anti"), "hamming-left")
        if active.isEmpty():
            break
        covered = min(bits, covered + step)
    pairs = answers[0]
    for more in answers[1:]:
        pairs = pairs.unionByName(more)
    nearest = Window.partitionBy("query_id").orderBy("distance", "id")
    rows_found = pairs.select("query_id", "code", "distance").join(members, "code")
    ranked = rows_found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("neighbour_id"), "distance")
