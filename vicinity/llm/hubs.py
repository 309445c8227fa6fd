"""Links among the members of many buckets, enough for their components, without comparing all pairs.

Members of a bucket are likely to be similar.  Each bucket has a hub, the member that meets most
others in all its buckets, and

1. every member is compared with its hubs, so the number of comparisons is that of the members;
2. where members differ from the hub in the same way, the one that is nearest to most takes its place
   and they are compared with that one;
3. members that are in one component with their hub need no more.  The others, the outsiders of the
   hub, are sought in the space of differences: with D(x) the symmetric difference of x and the hub,
   ``x ^ y = D(x) ^ D(y)`` as sets.  Where two sets may differ in at most d elements and x is not
   similar to the hub, D(x) and D(y) must share ``(|D(x)| + |D(y)| - d) / 2 > 0`` elements or more.
   So a prefix filter over the differences finds all pairs that can be similar.  What a member has of
   its own comes first in the order, so members that were edited apart hardly meet; and where they do,
   the join's condition asks for the parities of their sets in 256 cells, of which no more can differ
   than elements do.

No pair that shares a bucket is lost: it is compared, refuted by its sizes and differences, or
already in one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import cut_lineage, ship_by_value, text_blocks
from vicinity.llm.wordscan import U, Block, Powers, mix, windows
from vicinity.operators.broadcast import broadcast_checked

#: Members that one task compares with a hub in one go; a larger hub is dealt over several tasks.
PIECE = 64
#: Least number of longs of cell parities: what a row of the prefix filter carries.
PARITY = 4
#: Times the length of a prefix that is kept of a large difference.
ROOM = 4


def hashed_sets(column: pa.Array, n_words: int, powers: Powers):
    """``(lo, hi, sets)``: for runs of rows, the sorted hashes of each text's distinct shingles; None without words."""
    for lo, hi, data, offsets in text_blocks(column):
        words = Block(data, offsets, powers, lower=True).words()
        rolling = None
        for size in range(1, n_words + 1):
            rolling, _ = windows(words, size, rolling)
        edges = np.searchsorted(words.doc, np.arange(hi - lo + 1))
        sets: list[np.ndarray | None] = []
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if first == last:
                sets.append(None)
            elif last - first < n_words:  # the whole sequence as one shingle
                whole = np.array([last - first], np.uint64)
                for h in words.hash[first:last]:
                    whole = mix(whole ^ h)
                sets.append(whole)
            else:
                sets.append(np.unique(mix(rolling[first:last - n_words + 1])))
        yield lo, hi, sets


def shingle_set(text: str, n_words: int) -> frozenset:
    """The shingles themselves: tuples of words, or the whole sequence of a shorter text."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if len(words) < n_words:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(n_words)), strict=False))


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each of 64, 128, ... cells, some one to two times as many as tokens, whether the set has an odd number of
    hashes there.  Two sets differ in at least as many elements as their parities do in cells."""
    longs = max(PARITY, 1 << (max(0, len(tokens) - 1) // 64).bit_length())
    cells = np.bincount((tokens & U(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(cells, bitorder="little").view(np.int64)


def folded(cells: np.ndarray) -> np.ndarray:
    """The same over the least number of cells."""
    return np.bitwise_xor.reduce(cells.reshape(-1, PARITY), axis=0)


def may_differ(sizes: str, similarity_pct: int) -> str:
    """SQL: the most elements in which two similar sets with sizes of this sum can differ."""
    return f"({sizes}) - 2 * (({similarity_pct} * ({sizes}) + {99 + similarity_pct}) div {100 + similarity_pct})"


def elect(members: DataFrame, rounds: int = 3) -> DataFrame:
    """``(node, hub)``, each pair once, of ``members(key, node)``: buckets of two and more with their hubs.

    The hub of a bucket may itself be a member where a greater hub is: then that one takes the bucket over,
    ``rounds`` times, so that a group which is spread over many buckets has one centre.  The new hub need not
    be in the bucket: differences may be taken from any set, as long as all members take them from the same."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Both sides grow with the data, so they are merged at any size.
    members = cut_lineage(members.join(cut_lineage(sizes, "bucket-sizes").hint("merge"), "key"), "bucket-members")
    met = cut_lineage(members.groupBy("node").agg(F.sum("n").alias("met")), "met")
    met, _ = broadcast_checked(met, 2)
    hubs = cut_lineage(members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("hub")), "hubs")
    placed = cut_lineage(members.join(broadcast_checked(hubs, 3)[0], "key").select("key", "node", "hub"), "placed")
    above = cut_lineage(placed.groupBy("node").agg(F.max("hub").alias("above")), "superiors")
    above, _ = broadcast_checked(above.select(F.col("node").alias("at"), "above"), 3)
    for _ in range(rounds):
        hubs = hubs.join(above, hubs["hub.node"] == F.col("at")).select("key", F.col("above").alias("hub"))
    hubs, _ = broadcast_checked(cut_lineage(hubs.select("key", F.col("hub.node").alias("hub")), "last-hubs"), 2)
    return cut_lineage(members.join(hubs, "key").where("node <> hub").select("node", "hub").distinct(), "star-pairs")


def prefix_size(n: str, similarity_pct: int) -> str:
    """SQL: the most elements that a prefix filter asks of a difference, for a set of ``n``."""
    return f"({100 - similarity_pct} * ({n} + 100 * {n} div {similarity_pct}) div {100 + similarity_pct} + 1)"


def longest_prefix(n: int, similarity_pct: int) -> int:
    """The same of a number."""
    return (100 - similarity_pct) * (n + 100 * n // similarity_pct) // (100 + similarity_pct) + 1


def _gathered(pairs: DataFrame, texts: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """``(u, piece, role, node, text)``, by u and piece and sorted by role: u's text (0), then those of its v (1), some
    ``PIECE`` of them to a piece.  Of ``notes(u, note)`` comes a row for each piece before them (-1), with the column ``note``."""
    pieces = F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")
    counts, _ = broadcast_checked(cut_lineage(pairs.groupBy("u").agg(pieces), "pieces"), 2)
    asked = pairs.join(counts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("pieces")).cast("int").alias("piece"), F.lit(1).alias("role"),
                                           F.col("v").alias("node"))
    each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
    heads = counts.select("u", each, F.lit(0).alias("role"), F.col("u").alias("node"))
    asked, _ = broadcast_checked(cut_lineage(asked.unionByName(heads), "asked"), 3)
    rows = texts.select("node", "text").join(asked, "node").select("u", "piece", "role", "node", "text")
    if notes is not None:
        notes = notes.join(counts, "u").select("u", each, F.lit(-1).alias("role"), F.col("u").alias("node"), "note")
        rows = rows.unionByName(notes, allowMissingColumns=True)
    return rows.repartition("u", "piece").sortWithinPartitions("u", "piece", "role")


def compare(pairs: DataFrame, texts: DataFrame, similarity_pct: int, n_words: int, differences: bool = False) -> DataFrame:
    """``(u, v, linked)`` of ``pairs(u, v)``, each given once, by the full sets of ``texts(node, text)``.

    With ``differences`` also ``n`` (size of v's set) and the symmetric difference: v's ``own`` shingles and
    the ``missing`` ones, which only u has, the size ``d_size`` of both together, whether v is a ``voter``, one of u's first piece, and its ``parities``
    over many and few cells (``sketch``, ``cells``).  Where v has many shingles of its own, only the first
    of them and no missing ones are kept.  Texts of v go to u's
    tasks, some ``PIECE`` of them to a task, and u's text to each.
    """
    rows = _gathered(pairs, texts)
    none = np.empty(0, np.uint64)

    def examine(batches):
        powers, hub, hub_text, hub_set, exact = Powers(), None, None, none, None
        for batch in batches:
            us, pieces, roles, nodes = (batch.column(c).to_pylist() for c in range(4))
            texts_ = batch.column(4)
            for lo, hi, sets in hashed_sets(texts_, n_words, powers):
                out = []
                for i, x in zip(range(lo, hi), sets, strict=True):
                    x = none if x is None else x
                    if roles[i] == 0:
                        hub, hub_text, hub_set, exact = us[i], texts_[i], x, None
                        continue
                    if us[i] != hub:
                        raise ValueError(f"text of {us[i]} is missing")
                    at = np.searchsorted(hub_set, x)
                    inside = hub_set[np.minimum(at, len(hub_set) - 1)] == x if len(hub_set) else np.zeros(len(x), bool)
                    common, nx, nh = int(inside.sum()), len(x), len(hub_set)
                    linked = 100 * common >= similarity_pct * (nx + nh - common) and common > 0
                    if linked:  # confirmed on the words themselves
                        exact = shingle_set(hub_text.as_py(), n_words) if exact is None else exact
                        other = shingle_set(texts_[i].as_py(), n_words)
                        both = len(exact & other)
                        linked = 100 * both >= similarity_pct * (len(exact) + len(other) - both)
                    own = missing = sketch = cells = d_size = None
                    if differences:
                        d_size, enough = nx + nh - 2 * common, ROOM * longest_prefix(nx, similarity_pct)
                        own = x[~inside].view(np.int64)
                        if len(own) >= enough:
                            own = own[:enough]
                        else:
                            lacks = np.ones(nh, bool)
                            lacks[at[inside]] = False
                            missing = hub_set[lacks].view(np.int64)
                        sketch = parities(x)
                        cells = folded(sketch)
                    out.append((hub, nodes[i], linked, nx, d_size, pieces[i] == 0, own, missing, sketch, cells))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)

    ship_by_value()
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 4)
    names = ["u", "v", "linked", "n", "d_size", "voter", "own", "missing", "sketch", "cells"]
    out = rows.mapInArrow(examine, "u long, v long, linked boolean, n long, d_size long, voter boolean, own array<long>, missing array<long>, "
                                "sketch array<long>, cells array<long>")
    return cut_lineage(out if differences else out.select("u", "v", "linked"), "compared")


def whole_prefixes(pairs: DataFrame, common: DataFrame, texts: DataFrame, similarity_pct: int, n_words: int) -> DataFrame:
    """``(u, v, prefix)`` of ``pairs(u, v)``, each given once: the prefix that ``candidates`` takes of v's difference from u, from
    the whole of it, which is far longer and so does not leave the task.  ``common(u, common)`` is the list of ``candidates``."""
    rows = _gathered(pairs, texts, common.withColumnRenamed("common", "note"))
    none = np.empty(0, np.uint64)

    def examine(batches):
        powers, hub, hub_set, noted, note = Powers(), None, none, None, none
        for batch in batches:
            us, _, roles, nodes = (batch.column(c).to_pylist() for c in range(4))
            notes = batch.column(5)
            for lo, hi, sets in hashed_sets(batch.column(4), n_words, powers):
                out = []
                for i, x in zip(range(lo, hi), sets, strict=True):
                    x = none if x is None else x
                    if roles[i] == -1:
                        noted, note = us[i], notes[i].values.to_numpy().view(np.uint64)
                        continue
                    if roles[i] == 0:
                        hub, hub_set, note = us[i], x, note if noted == us[i] else none
                        continue
                    if us[i] != hub:
                        raise ValueError(f"text of {us[i]} is missing")
                    own, missing = np.setdiff1d(x, hub_set, assume_unique=True), np.setdiff1d(hub_set, x, assume_unique=True)
                    by_own, by_missing = np.isin(own, note), np.isin(missing, note)
                    last = np.sort(np.concatenate([own[by_own], missing[by_missing]]).view(np.int64))
                    order = np.concatenate([own[~by_own].view(np.int64), missing[~by_missing].view(np.int64), last])
                    out.append((hub, nodes[i], order[:longest_prefix(len(x), similarity_pct)]))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["u", "v", "prefix"])

    ship_by_value()
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return cut_lineage(rows.mapInArrow(examine, "u long, v long, prefix array<long>"), "whole-prefixes")


def outsiders(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """``pairs(u, v, linked, ...)`` (u a hub) with the ``component`` of v and whether v is ``outside`` the hub's,
    for hubs of two members and more that have an outsider.  ``label`` is ``(node, component)``; a node without
    one is alone."""
    label, _ = broadcast_checked(label, 2)
    rows = pairs.join(label.select(F.col("node").alias("v"), F.col("component").alias("v_component")), "v", "left").join(
        label.select(F.col("node").alias("u"), F.col("component").alias("u_component")), "u", "left")
    rows = rows.withColumn("component", F.coalesce("v_component", "v"))
    rows = rows.withColumn("outside", ~F.col("linked") & (F.col("component") != F.coalesce("u_component", "u"))).drop("u_component", "v_component")
    rows = cut_lineage(rows, "placed-members")
    open_ = rows.groupBy("u").agg(F.count("*").alias("members"), F.max("outside").alias("any")).where("members > 1 and any").select("u")
    open_, _ = broadcast_checked(cut_lineage(open_, "open-hubs"), 1)
    return rows.join(open_, "u", "left_semi")


def recentre(placed: DataFrame, texts: DataFrame, similarity_pct: int, n_words: int) -> DataFrame:
    """Rows of ``compare`` of the members of open hubs with the centre of each.

    ``placed`` comes from ``outsiders``.  The first piece of a hub's members votes: what most of them differ
    in from the hub is the hub's own doing.  The member that differs least from what most agree on takes the
    hub's place, and the hub becomes a member; where that is the hub itself, its comparisons are kept."""
    near = placed.where("missing is not null")
    both = F.concat("own", "missing")
    votes = near.where("voter").select("u", F.explode(both).alias("token")).groupBy("u", "token").agg(F.count("*").alias("n"))
    voters = near.where("voter").groupBy("u").agg(F.count("*").alias("voters"))
    major = votes.join(voters, "u").where("2 * n > voters").groupBy("u").agg(F.collect_list("token").alias("major"))
    major = cut_lineage(major, "major-differences")
    apart = F.col("d_size") + F.size("major") - 2 * F.size(F.array_intersect(both, "major"))
    best = near.join(major, "u").groupBy("u").agg(F.min(F.struct(apart.alias("apart"), "v")).alias("best"), F.first(F.size("major")).alias("hub_apart"))
    moved = cut_lineage(best.where("best.apart < hub_apart").select("u", F.col("best.v").alias("centre")), "centres")
    moved, _ = broadcast_checked(moved, 2)
    columns = [c for c in placed.columns if c not in ("component", "outside")]
    stay = cut_lineage(placed.where("own is not null").join(moved, "u", "left_anti").select(columns), "kept-centres")
    pairs = placed.join(moved, "u").select(F.col("centre").alias("u"), "v").unionByName(
        moved.select(F.col("centre").alias("u"), F.col("u").alias("v"))).where("u <> v").unionByName(
        placed.where("own is null").join(moved, "u", "left_anti").select("u", "v")).distinct()
    pairs = cut_lineage(pairs.join(stay.select("u", "v"), ["u", "v"], "left_anti"), "centre-pairs")
    return stay.unionByName(compare(pairs, texts, similarity_pct, n_words, differences=True).select(columns))


def candidates(rows: DataFrame, texts: DataFrame, similarity_pct: int, n_words: int) -> DataFrame:
    """``(u, v)``, each once: pairs of two members of one hub, one an outsider, that their differences from the
    hub do not refute.  ``rows`` is the result of ``outsiders`` over rows of ``compare``.

    In the order of the prefix filter come a member's own shingles first, then missing ones, and last those
    that two of the hub's first piece of members have in common, which would bring all together."""
    both = F.concat("own", F.coalesce("missing", F.array().cast("array<long>")))
    votes = rows.where("voter").select("u", F.explode(both).alias("token")).groupBy("u", "token").agg(F.count("*").alias("n"))
    common = cut_lineage(votes.where("n > 1").groupBy("u").agg(F.collect_list("token").alias("common")), "common-differences")
    most = prefix_size("n", similarity_pct)

    def with_prefix(rows: DataFrame) -> DataFrame:
        rows = rows.join(common, "u", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
        alone = F.array_except("own", "common")
        order = F.concat(alone, F.array_except("missing", "common"), F.array_sort(F.array_intersect(both, "common")))
        order = F.when(F.col("missing").isNotNull(), order).when(F.size(alone) >= F.expr(most), alone)
        return rows.select("u", "v", "n", "d_size", "component", "outside", "cells", "sketch", F.slice(order, 1, F.expr(f"cast({most} as int)")).alias("prefix"))

    rows = cut_lineage(with_prefix(rows), "prefixes")
    # Where too few of the kept shingles are v's alone, the prefix is taken of the whole difference.
    short = rows.where("prefix is null").drop("prefix")
    whole = whole_prefixes(short.select("u", "v"), common, texts, similarity_pct, n_words)
    rows = rows.where("prefix is not null").unionByName(whole.join(short, ["u", "v"]))
    tokens = rows.select("u", "v", "n", "d_size", "component", "outside", "cells", F.posexplode("prefix").alias("pos", "token"))
    tokens = cut_lineage(tokens, "difference-tokens")
    a, b = (tokens.select(F.col("u").alias("hub"), "token", *(F.col(c).alias(f"{c}_{side}") for c in ("v", "n", "d_size", "component", "outside", "cells", "pos")))
            for side in "ab")
    differ = may_differ("n_a + n_b", similarity_pct)
    share = f"greatest(1, (d_size_a + d_size_b - ({differ}) + 1) div 2)"
    cells = " + ".join(f"bit_count(cells_a[{i}] ^ cells_b[{i}])" for i in range(PARITY))
    met = a.where("outside_a").join(b, ["hub", "token"]).where(
        f"component_a <> component_b and (not outside_b or v_a < v_b) and abs(d_size_a - d_size_b) <= {differ} "
        f"and 100 * least(n_a, n_b) >= {similarity_pct} * greatest(n_a, n_b) and pos_a <= d_size_a - {share} and pos_b <= d_size_b - {share} and {cells} <= {differ}")
    pairs = cut_lineage(met.select(F.least("v_a", "v_b").alias("u"), F.greatest("v_a", "v_b").alias("v")).distinct(), "met-pairs")
    # Few cells say nothing of large sets: pairs are asked again for parities over as many cells as tokens.
    sketches = cut_lineage(rows.groupBy("v").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "parities")
    pairs = pairs.join(sketches.select(F.col("v").alias("u"), F.col("n").alias("n_a"), F.col("sketch").alias("a")), "u").join(
        sketches.select("v", F.col("n").alias("n_b"), F.col("sketch").alias("b")), "v")
    half = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, 1 + size({0}) div 2, size({0}) div 2), (x, y) -> x ^ y)"
    fold = "if(size({0}) > size({1}), " + half + ", {0})"  # similar sets are of the same power of two, or of the next
    odd = f"aggregate(zip_with({fold.format('a', 'b')}, {fold.format('b', 'a')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return cut_lineage(pairs.where(f"{odd} <= {differ}").select("u", "v"), "difference-pairs")
