"""Sharded hierarchical k-means index ("forest"): build, store, search.

Every row goes to a shard by a hash of its id; each shard holds one tree.
The tree is built level by level for all nodes of all shards at once:

* a node is split when it has at least ``min_leaf`` rows, at least 2 rows,
  ``k >= 2`` and its depth is below ``max_depth``; otherwise it is a leaf;
* splitting runs Lloyd's k-means (always squared Euclidean) with
  ``min(k, n)`` seeds = the node's rows with the smallest md5(id || seed)
  (``seeding="spread"``: rows drawn by distance, see ``_spread_seeds``),
  at most ``iterations`` iterations (stopping early once two written
  centroid checkpoints agree), ties to the lowest child number; a child that
  loses all rows keeps its node (a leaf with 0 members, no representative)
  and gets no centroid in later iterations;
* ``batch_size > 0`` splits by mini-batch k-means instead (``_minibatch``): ``batch_steps`` batches
  of about that many rows a node, running means as centroids, the best of ``starts`` starts;
* ``engine="arrow"`` takes the sums of an iteration or batch in Python tasks (``arrow_kmeans``), where
  the centroid table is within the broadcast limit; beyond it native expressions are used;
* each child's representative is the member most similar, by the search
  metric, to the child's final centroid (ties to the lowest id).

Plan shape: rows are stored by shard once (the only shuffle of vectors before
the leaves are written).  From then on they never move to their node: the
per-node centroid arrays (one row per node) go to the tasks, where each row
picks its nearest centroid in a projection (Arrow batches and NumPy; beyond the
broadcast limit native expressions, in batches of shards); new centroids are partial aggregates (one buffer per
(node, child) per input partition).  Seeds and representatives are chosen on
ids, hashes and scores alone, and only the chosen vectors are fetched.  Level
tables and centroid tables are written, so lineage stays flat and a lost
executor costs at most a re-read.

A build writes into a folder of its own (``build=<id>``: members, tree and,
per metric, reps) and, as its last act, the pointer ``meta`` that names the
folder.  A reader sees either the previous build or the new one, never a
mixture, and representatives always belong to the build they lie in.

Search: a greedy descent per (query, shard) over the small ``nodes`` table
(strict best child by metric score vs. the representative, lowest child
number on ties, children without representative skipped; no qualifying
child -> no result from that shard), then only the chosen leaves' members
(plus the shard's ``invalid`` leaf of rows with null/NaN features) are read
and scored; the per-query top-k merges all shards.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.functions import metrics as M
from vicinity.functions.vectors import VEC, is_valid_vector
from vicinity.operators.broadcast import MAX_BROADCAST_BYTES, estimate_bytes
from vicinity.operators.centers import CENTER, mean_vector
from vicinity.operators.topk import SCORE, rank_key, top_k, validate_k
from vicinity.plans.arrow_kmeans import nearest_child, nearest_sums, placed, smallest_draws
from vicinity.plans.exact import (Q_NORM, QueryInfo, only_query, query_info, search_score, with_query_norm,
                                  with_row_norm)
from vicinity.session import cut_lineage, scratch_path
from vicinity.sources.queries import Q, QID
from vicinity.sources.store import read_parquet, try_read, write_parquet

SHARD = "shard"
NODE = "node_id"
PARENT = "parent_id"
CHILD = "child_no"
DEPTH = "depth"
IS_LEAF = "is_leaf"
COUNT = "member_count"
REP_ID = "rep_id"
REP_VEC = "rep_vec"
LEAF = "leaf_id"
ROOT = "root"
INVALID = "invalid"
CENTS = "_cents"
PLACE = "_place"
CENTROID = "centroid"
LOSS = "loss"
# Stands between a node and the number of a start in ``_minibatch``.
START_MARK = "#"
FORMAT = 5
# Iterations between written centroid tables: bounds the plan (and recovery)
# depth of the Lloyd loop, like Spark ML's checkpointInterval.
CHECKPOINT_INTERVAL = 4
# Relative centroid movement below which two checkpoints count as converged.
CONVERGENCE_TOL = 1e-12
# (query, shard, leaf) keys that one block of queries brings to the driver;
# larger query sets are searched in several such blocks.
LEAF_KEYS_PER_BLOCK = 20000


@dataclass(frozen=True)
class ForestParams:
    shards: int = 4
    k: int = 5
    max_depth: int = 3
    min_leaf: int = 100
    iterations: int = 100
    seed: int = 42
    seeding: str = "hash"
    batch_size: int = 0
    batch_steps: int = 20
    starts: int = 3
    engine: str = "native"


@dataclass
class Forest:
    nodes: DataFrame
    members: DataFrame
    meta: dict


def shard_of(id_col: str, shards: int) -> Column:
    """Stable shard: first 32 bits of md5(id) modulo the shard count."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(shards)).cast("int")


def fingerprint(table: DataFrame, id_col: str, vec_col: str = VEC) -> dict:
    """Content fingerprint of a vector table: rows, dimension, and an order-free
    hash sum over ids with their vectors."""
    r = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d"),
                  F.sum(F.xxhash64(F.col(id_col), F.col(vec_col)).cast("decimal(38,0)")).cast("string").alias("h")).first()
    return {"rows": int(r["n"]), "dim": max(0, int(r["d"] or 0)), "content_hash": r["h"]}


def _join_nodes(big: DataFrame, small: DataFrame, keys: list[str], rows: int, dim: int,
                how: str = "inner", limit_bytes: int | None = None) -> DataFrame:
    """Rows with what a small table holds for their node.

    ``small`` (``rows`` rows) is broadcast; beyond the limit, in batches of
    shards, each of which meets only the rows of its shards (pruned files,
    where the rows are stored by shard).  ``big`` is never shuffled."""
    limit = MAX_BROADCAST_BYTES if limit_bytes is None else limit_bytes
    n = max(1, -(-estimate_bytes(rows, dim) // limit))
    if n == 1:
        return big.join(F.broadcast(small), keys, how)
    out = None
    for i in range(n):
        mine = F.pmod(F.col(SHARD), F.lit(n)) == i
        part = big.filter(mine).join(F.broadcast(small.filter(mine)), keys, how)
        out = part if out is None else out.unionByName(part)
    return out


def _pack(cents: DataFrame) -> DataFrame:
    """(shard, node, child, center) -> one row per node with its centroid array."""
    return cents.groupBy(SHARD, NODE).agg(
        F.array_sort(F.collect_list(F.struct(F.col(CHILD), F.col(CENTER).alias("c")))).alias(CENTS))


def _in_tasks(n_nodes: int, width: int) -> bool:
    """Whether centroids of ``width`` numbers a node are few enough to be sent along with every task."""
    return estimate_bytes(n_nodes, width) <= MAX_BROADCAST_BYTES


def _assign(work: DataFrame, packed: DataFrame, id_col: str, n_nodes: int, k: int, dim: int) -> DataFrame:
    """Nearest centroid of the row's own node (squared Euclidean, then child).

    Within the broadcast limit the centroids go to the tasks, which compare Arrow batches with them;
    ``packed`` is read at once, so what it comes from should be written."""
    if _in_tasks(n_nodes, k * dim):
        nodes, places = placed(packed, [SHARD, NODE], CHILD, CENTS, PLACE)
        j = work.join(F.broadcast(places), [SHARD, NODE])
        return j.select(SHARD, NODE, id_col, VEC, nearest_child(nodes, PLACE, VEC).alias(CHILD))
    j = _join_nodes(work, packed, [SHARD, NODE], n_nodes, k * dim)
    best = F.expr(f"array_min(transform({CENTS}, cc -> named_struct('d', {M.sq_distance_sql(VEC, 'cc.c')}, "
                  f"'ch', cc.{CHILD}))).ch")
    return j.select(SHARD, NODE, id_col, VEC, best.alias(CHILD))


def _seed_text(seed: int | Column) -> Column:
    return F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")


def _seeds(work: DataFrame, id_col: str, k: int, seed: int | Column, n_nodes: int) -> DataFrame:
    """First min(k, n) rows of each node by md5(id || seed).  Only (hash, id)
    is ranked (a per-partition group limit first); the chosen vectors are then
    fetched by their ids."""
    from pyspark.sql import Window
    w = Window.partitionBy(SHARD, NODE).orderBy("_h", id_col)
    ids = work.select(SHARD, NODE, id_col, F.md5(F.concat(F.col(id_col).cast("string"), _seed_text(seed))).alias("_h"))
    ids = ids.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    ids = ids.select(SHARD, NODE, id_col, (F.col("_rn") - 1).alias(CHILD))
    found = _join_nodes(work, ids, [SHARD, NODE, id_col], n_nodes * k, 4)
    return found.select(SHARD, NODE, CHILD, F.col(VEC).alias(CENTER))


def _spread_seeds(work: DataFrame, id_col: str, k: int, seed: int | Column, n_nodes: int, dim: int) -> DataFrame:
    """Seeds spread by distance, for all nodes at once.

    The first is the row with the smallest md5(id || seed).  Each round then draws one row of every
    node with odds in proportion to its squared distance from the node's nearest seed so far: of
    -ln(u) / distance, u being a fraction hashed from id, seed and round, the smallest wins, ties to
    the lowest id.  Rows that coincide with a seed are never drawn, so a node with fewer distinct
    vectors than ``k`` has fewer seeds.  A round takes the distances once, in Arrow tasks that keep
    the smallest draws (beyond the broadcast limit by native expressions), and aggregates numbers
    only; only the chosen vectors are fetched.
    """
    cents = cut_lineage(_seeds(work, id_col, 1, seed, n_nodes), "seeds")
    nearest = F.expr(f"array_min(transform({CENTS}, cc -> {M.sq_distance_sql(VEC, 'cc.c')}))")
    for t in range(1, k):
        digits = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), _seed_text(seed), F.lit(f"/{t}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
        weight = -F.log(u)
        if _in_tasks(n_nodes, t * dim):
            nodes, places = placed(_pack(cents), [SHARD, NODE], CHILD, CENTS, PLACE)
            near = work.join(F.broadcast(places), [SHARD, NODE])
            draws = smallest_draws(near.select(SHARD, NODE, id_col, PLACE, weight.alias("_weight"), VEC),
                                   nodes, PLACE, "_weight", VEC, "_key")
        else:
            near = _join_nodes(work, _pack(cents), [SHARD, NODE], n_nodes, t * dim)
            draws = near.select(SHARD, NODE, id_col, (weight / F.nullif(nearest, F.lit(0.0))).alias("_key")).dropna(subset=["_key"])
        best = draws.groupBy(SHARD, NODE).agg(F.min(F.struct("_key", id_col)).alias("_best"))
        chosen = cut_lineage(best.select(SHARD, NODE, F.col("_best").getField(id_col).alias(id_col)), "seed-ids")
        found = _join_nodes(work, chosen, [SHARD, NODE, id_col], n_nodes, 4).groupBy(SHARD, NODE).agg(
            F.min(VEC).alias(CENTER))
        cents = cut_lineage(cents.unionByName(found.select(SHARD, NODE, F.lit(t).alias(CHILD), CENTER)), "seeds")
    return cents


def _sums_by_arrow(p: ForestParams, n_nodes: int, dim: int) -> bool:
    return p.engine == "arrow" and _in_tasks(n_nodes, p.k * dim)


def _arrow_sums(work: DataFrame, cents: DataFrame) -> DataFrame:
    return nearest_sums(work, cents, [SHARD, NODE], CHILD, VEC, CENTER, "_mean", "_new", "_loss")


def _minibatch(work: DataFrame, active: DataFrame, id_col: str, p: ForestParams, n_nodes: int, dim: int) -> DataFrame:
    """Centroids of every node by mini-batch k-means, for all nodes and starts at once.

    A hash of id, seed and start deals the rows of a node with ``n`` rows into ``ceil(n / batch_size)``
    batches; step ``t`` takes batch ``t`` modulo that number, so a small node repeats its few batches
    and a large one never uses most of its rows.  Rows of used batches are written once, whatever
    the number of starts: the table is read in full to draw them and to judge the starts, and a step
    reads the drawn rows only.  A centroid is the running mean of all batch rows that were nearest to
    it (a learning rate of its own, falling with the rows it has seen); one that is nearest to no row
    of a batch stays where it is.  Every start has seeds of its own (``seed + start``) among its drawn
    rows.  One pass over the node's rows sums the squared distances of all starts, and the smallest
    sum wins; sums equal in single precision are ties, which go to the first start.
    """
    def start_of(node: str) -> Column:
        return F.substring_index(node, START_MARK, -1).cast("int")

    def batch(start: int) -> Column:
        digits = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"{p.seed}/batch{start}"))), 1, 13)
        u = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))
        return F.floor(u * F.col("_batches")).cast("long")

    sizes = active.select(SHARD, NODE, F.ceil(F.col("n") / F.lit(float(p.batch_size))).cast("long").alias("_batches"))
    drawn = _join_nodes(work, sizes, [SHARD, NODE], n_nodes, 1).select(
        SHARD, NODE, id_col, VEC, "_batches", F.array(*(batch(s) for s in range(p.starts))).alias("_b"))
    pool = cut_lineage(drawn.filter(F.exists("_b", lambda b: b < p.batch_steps)), "batches")
    tries = pool.select(SHARD, NODE, id_col, VEC, "_batches", F.posexplode("_b").alias("_start", "_batch")).filter(
        F.col("_batch") < p.batch_steps).withColumn(NODE, F.concat(F.col(NODE), F.lit(START_MARK), F.col("_start").cast("string")))

    seed = F.lit(p.seed) + start_of(NODE)
    if p.seeding == "spread":
        cents = _spread_seeds(tries, id_col, p.k, seed, n_nodes * p.starts, dim)
    else:
        cents = cut_lineage(_seeds(tries, id_col, p.k, seed, n_nodes * p.starts), "seeds")
    cents = cents.withColumn("_seen", F.lit(0).cast("long"))
    arrow = _sums_by_arrow(p, n_nodes * p.starts, dim)
    for t in range(p.batch_steps):
        now = tries.filter(F.pmod(F.lit(t), F.col("_batches")) == F.col("_batch"))
        if arrow:
            got = _arrow_sums(now, cents)
        else:
            assigned = _assign(now, _pack(cents), id_col, n_nodes * p.starts, p.k, dim)
            got = mean_vector(assigned, VEC, [SHARD, NODE, CHILD], out="_mean", count="_new")
        moved = F.expr(f"CASE WHEN _new IS NULL THEN {CENTER} ELSE "
                       f"zip_with({CENTER}, _mean, (a, b) -> (a * _seen + b * _new) / (_seen + _new)) END")
        cents = cut_lineage(cents.join(got, [SHARD, NODE, CHILD], "left").select(
            SHARD, NODE, CHILD, moved.alias(CENTER),
            (F.col("_seen") + F.coalesce("_new", F.lit(0))).alias("_seen")), "cents")

    if arrow:
        of_start = F.array(*(F.concat(F.col(NODE), F.lit(f"{START_MARK}{i}")) for i in range(p.starts)))
        every = work.select(SHARD, F.explode(of_start).alias(NODE), VEC)
        sums = _arrow_sums(every, cents).groupBy(
            SHARD, F.substring_index(NODE, START_MARK, 1).alias(NODE), start_of(NODE).alias("start")).agg(F.sum("_loss").alias("d"))
    else:
        # One row a node with the centroid arrays of all its starts, in the order of the starts.
        all_starts = _pack(cents).groupBy(SHARD, F.substring_index(NODE, START_MARK, 1).alias(NODE)).agg(
            F.array_sort(F.collect_list(F.struct(start_of(NODE).alias("start"), F.col(CENTS).alias("cents")))).alias("_starts"))
        losses = F.expr(f"transform(_starts, s -> named_struct('start', s.start, 'd', "
                          f"array_min(transform(s.cents, cc -> {M.sq_distance_sql(VEC, 'cc.c')}))))")
        away = _join_nodes(work, all_starts, [SHARD, NODE], n_nodes, p.starts * p.k * dim).select(
            SHARD, NODE, F.explode(losses).alias("s"))
        sums = away.groupBy(SHARD, NODE, "s.start").agg(F.sum("s.d").alias("d"))
    inertia = sums.withColumn("d", F.col("d").cast("float"))
    best = inertia.groupBy(SHARD, NODE).agg(F.min(F.struct("d", "start")).alias("b")).select(
        SHARD, F.concat(F.col(NODE), F.lit(START_MARK), F.col("b.start").cast("string")).alias(NODE))
    chosen = cents.join(best, [SHARD, NODE], "left_semi")
    return cut_lineage(chosen.select(SHARD, F.substring_index(NODE, START_MARK, 1).alias(NODE), CHILD, CENTER), "cents")


def _converged(before: DataFrame, after: DataFrame, tol: float = CONVERGENCE_TOL) -> bool:
    """True when both written centroid tables have the same (node, child) keys
    and no element moved by more than ``tol`` (relative): assignments are then
    stable, so further Lloyd iterations would reproduce the same clusters."""
    a = before.select(SHARD, NODE, CHILD, F.col(CENTER).alias("_a"))
    b = after.select(SHARD, NODE, CHILD, F.col(CENTER).alias("_b"))
    moved = F.expr(f"_a IS NULL OR _b IS NULL OR aggregate(zip_with(_a, _b, (x, y) -> abs(x - y) / "
                   f"greatest(1D, abs(x))), 0D, (m, v) -> greatest(m, v)) > {tol!r}")
    return a.join(b, [SHARD, NODE, CHILD], "full").filter(moved).limit(1).count() == 0


def _lloyd(work: DataFrame, id_col: str, p: ForestParams, n_nodes: int, dim: int) -> tuple[DataFrame, int]:
    """Centroids of every node by Lloyd's iterations, and how many were used."""
    in_tasks = _in_tasks(n_nodes, p.k * dim)
    if p.seeding == "spread":
        cents = _spread_seeds(work, id_col, p.k, p.seed, n_nodes, dim)
    else:
        cents = cut_lineage(_seeds(work, id_col, p.k, p.seed, n_nodes), "seeds")
    previous, done, arrow = cents, 0, _sums_by_arrow(p, n_nodes, dim)
    for it in range(1, p.iterations + 1):
        if arrow:
            # The table of the step before goes to the tasks, so each step is written.
            cents = cut_lineage(_arrow_sums(work, cents).select(SHARD, NODE, CHILD, F.col("_mean").alias(CENTER)), "cents")
        else:
            cents = mean_vector(_assign(work, _pack(cents), id_col, n_nodes, p.k, dim), VEC, [SHARD, NODE, CHILD])
            if in_tasks:
                cents = cut_lineage(cents, "cents")
        done = it
        if it % CHECKPOINT_INTERVAL == 0 or it == p.iterations:
            cents = cents if in_tasks else cut_lineage(cents, "cents")
            if it < p.iterations and _converged(previous, cents):
                break
            previous = cents
    return cents, done


def _children(active: DataFrame, assigned: DataFrame, cents: DataFrame, depth: int) -> DataFrame:
    """Child node rows of the split nodes: count and final centroid (null for
    a child that lost its centroid)."""
    kids = active.select(SHARD, NODE, F.explode(F.sequence(F.lit(0), F.col("kk") - 1)).alias(CHILD))
    counts = assigned.groupBy(SHARD, NODE, CHILD).agg(F.count(F.lit(1)).alias(COUNT))
    out = (kids.join(counts, [SHARD, NODE, CHILD], "left")
           .join(cents.select(SHARD, NODE, CHILD, F.col(CENTER).alias(CENTROID)), [SHARD, NODE, CHILD], "left"))
    return out.select(
        SHARD, F.concat(F.col(NODE), F.lit("_"), F.col(CHILD).cast("string")).alias(NODE),
        F.col(NODE).alias(PARENT), F.col(CHILD).cast("int").alias(CHILD), F.lit(depth + 1).alias(DEPTH),
        F.coalesce(F.col(COUNT), F.lit(0)).cast("long").alias(COUNT), CENTROID)


def _members(df: DataFrame, id_col: str, leaf: Column) -> DataFrame:
    return df.select(SHARD, leaf.alias(LEAF), id_col, VEC)


def _check_params(p: ForestParams) -> None:
    if p.shards < 1 or p.k < 0 or p.max_depth < 0 or p.iterations < 0 or p.seeding not in ("hash", "spread"):
        raise ValueError(f"invalid forest parameters {p}")
    if p.batch_size < 0 or p.batch_steps < 1 or p.starts < 1 or p.engine not in ("native", "arrow"):
        raise ValueError(f"invalid forest parameters {p}")


def _write_by_shard(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Written and read back, one folder per shard."""
    df.write.mode(mode).partitionBy(SHARD).parquet(path)
    return read_parquet(df.sparkSession, path, df.schema)


def build_clustering(table: DataFrame, id_col: str, params: ForestParams, path: str, vec_col: str = VEC) -> dict:
    """The metric-independent part of the index in a new build folder: k-means
    tree per shard (``tree``: node rows with counts and centroids) and
    ``members`` (a folder per shard, files sorted by leaf).  Writes no pointer
    (see ``publish``); returns the meta."""
    p = params
    _check_params(p)
    spark = table.sparkSession
    build = uuid.uuid4().hex
    root = _build_path(path, build)
    work_path = scratch_path(spark, f"forest-levels-{build}")
    rows = table.select(F.col(id_col), F.col(vec_col).alias(VEC)).withColumn(SHARD, shard_of(id_col, p.shards))

    def write_members(df: DataFrame) -> None:
        # ``rebalance`` lets AQE split a leaf holding a large share of the rows over several tasks
        # (and merge small ones); files sorted by leaf are pruned by their row-group statistics.
        df.hint("rebalance", SHARD, LEAF).sortWithinPartitions(SHARD, LEAF).write.mode("append").partitionBy(
            SHARD).parquet(f"{root}/members")

    # The source is read once: rows go to their shard's folder, and fingerprint,
    # ``invalid`` leaf and first level come from there.
    tagged = rows.withColumn("_ok", F.coalesce(is_valid_vector(VEC), F.lit(False)))
    tagged = _write_by_shard(tagged.hint("rebalance", SHARD), f"{work_path}/rows")
    fp = fingerprint(tagged, id_col)
    dim = fp["dim"]
    invalid = _members(tagged.filter(~F.col("_ok")), id_col, F.lit(INVALID))
    write_members(invalid)
    level = tagged.filter(F.col("_ok")).drop("_ok").withColumn(NODE, F.lit(ROOT))
    roots = level.groupBy(SHARD).agg(F.count(F.lit(1)).cast("long").alias(COUNT)).select(
        SHARD, F.lit(ROOT).alias(NODE), F.lit(None).cast("string").alias(PARENT),
        F.lit(None).cast("int").alias(CHILD), F.lit(0).alias(DEPTH), COUNT,
        F.lit(None).cast("array<double>").alias(CENTROID))
    node_parts = [cut_lineage(roots, "roots")]
    used: list[int] = []
    can_split = p.k >= 2 and dim > 0
    for d in range(p.max_depth if can_split else 0):
        stats = level.groupBy(SHARD, NODE).agg(F.count(F.lit(1)).alias("n"))
        active = cut_lineage(stats.filter((F.col("n") >= p.min_leaf) & (F.col("n") >= 2)).select(
            SHARD, NODE, "n", F.least(F.lit(p.k), F.col("n")).alias("kk")), "active")
        n_active = active.count()
        if n_active == 0:
            break
        keys = active.select(SHARD, NODE)
        write_members(_members(_join_nodes(level, keys, [SHARD, NODE], n_active, 0, "left_anti"), id_col, F.col(NODE)))
        work = _join_nodes(level, keys, [SHARD, NODE], n_active, 0, "left_semi")

        if p.batch_size:
            cents, done = _minibatch(work, active, id_col, p, n_active, dim), p.batch_steps
        else:
            cents, done = _lloyd(work, id_col, p, n_active, dim)
        used.append(done)
        assigned = _write_by_shard(_assign(work, _pack(cents), id_col, n_active, p.k, dim), f"{work_path}/level{d + 1}")
        node_parts.append(cut_lineage(_children(active, assigned, cents, d), "children"))
        level = assigned.select(SHARD, F.concat(F.col(NODE), F.lit("_"), F.col(CHILD).cast("string")).alias(NODE),
                                id_col, VEC)
    write_members(_members(level, id_col, F.col(NODE)))

    nodes = node_parts[0]
    for part in node_parts[1:]:
        nodes = nodes.unionByName(part)
    parents = nodes.filter(F.col(PARENT).isNotNull()).select(F.col(SHARD), F.col(PARENT).alias(NODE)).distinct()
    nodes = nodes.join(parents.withColumn("_has_kids", F.lit(True)), [SHARD, NODE], "left").withColumn(
        IS_LEAF, F.col("_has_kids").isNull()).drop("_has_kids")
    tree = nodes.select(SHARD, NODE, PARENT, CHILD, DEPTH, IS_LEAF, COUNT, CENTROID)
    write_parquet(tree, f"{root}/tree")
    n_nodes = read_parquet(spark, f"{root}/tree", tree.schema).count()
    return {"format": FORMAT, "build": build, "id_col": id_col, "nodes": n_nodes, "iterations_used": used,
            **asdict(p), **fp, "tree_schema": tree.schema.json(), "members_schema": invalid.schema.json()}


def _build_path(path: str, build: str) -> str:
    return f"{path}/build={build}"


def publish(spark: SparkSession, path: str, meta: dict) -> None:
    """Point readers at a finished build.  The last act of a build: until then
    they keep reading the one before."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode(
        "overwrite").json(f"{path}/meta")


def representatives(members: DataFrame, tree: DataFrame, metric: str, id_col: str, dim: int) -> DataFrame:
    """``(shard, node_id, rep_id, rep_vec)``: for every non-root node, the
    member of its subtree most similar (by ``metric``) to its centroid, ties
    to the lowest id.

    Each member row is expanded to its ancestors (node ids are
    ``root_<i>_<j>...``, so ancestors are prefixes of the leaf id) and meets
    their centroids by broadcast.  The best score of a node, with the lowest id
    at that score, is one aggregate over scores and ids, so each pair is scored
    once (norms, where the metric has them, once a row and once a centroid);
    only the chosen rows' vectors are fetched.
    """
    metric = M.resolve_metric(metric)
    parts = F.split(F.col(LEAF), "_")
    anc = F.explode(F.sequence(F.lit(2), F.size(parts))).alias("_n")
    cents = tree.filter(F.col(CENTROID).isNotNull()).select(SHARD, NODE, CENTROID)
    rows = members.filter((F.col(LEAF) != INVALID) & F.col(LEAF).contains("_"))
    norms = {}
    if metric == "cosine":
        rows, cents = rows.withColumn("_row_norm", M.norm(VEC)), cents.withColumn("_cent_norm", M.norm(CENTROID))
        norms = {"a_norm": "_row_norm", "b_norm": "_cent_norm"}
    kept = [SHARD, id_col, VEC, *(["_row_norm"] if norms else [])]
    expanded = rows.select(*kept, parts.alias("_p"), anc).select(
        *kept, F.array_join(F.slice("_p", 1, F.col("_n")), "_").alias(NODE))
    n_nodes = tree.count()   # small table (node rows)
    scored = _join_nodes(expanded, cents, [SHARD, NODE], n_nodes, dim).select(
        SHARD, NODE, id_col, rank_key(M.score(metric, VEC, CENTROID, **norms)).alias("_s"))
    # No filter on the score: it would be pushed below and score each pair twice.
    order = F.struct((-F.col("_s")).alias("_neg"), F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("_id"))
    best = scored.groupBy(SHARD, NODE).agg(F.min(F.when(F.col("_s").isNotNull(), order)).alias("_best"))
    chosen = cut_lineage(best.filter(F.col("_best").isNotNull()).select(SHARD, NODE, F.col("_best._id").alias(id_col)), "rep-ids")
    found = _join_nodes(members.filter(F.col(LEAF) != INVALID).select(SHARD, id_col, VEC), chosen, [SHARD, id_col], n_nodes, 4)
    return found.select(SHARD, NODE, F.col(id_col).alias(REP_ID), F.col(VEC).alias(REP_VEC))


def _reps_path(path: str, meta: dict, metric: str) -> str:
    return f"{_build_path(path, meta['build'])}/reps/{M.resolve_metric(metric)}"


def build_representatives(spark: SparkSession, path: str, meta: dict, metric: str) -> None:
    root = _build_path(path, meta["build"])
    tree = read_parquet(spark, f"{root}/tree", _schema(meta, "tree_schema"))
    members = read_parquet(spark, f"{root}/members", _schema(meta, "members_schema"))
    write_parquet(representatives(members, tree, metric, meta["id_col"], int(meta["dim"])),
                  _reps_path(path, meta, metric))


def build_forest(table: DataFrame, id_col: str, metric: str, params: ForestParams, path: str,
                 vec_col: str = VEC) -> Forest:
    """A new build of the whole index under ``path``: the clustering, the
    representatives for ``metric``, and last the pointer to both."""
    metric = M.resolve_metric(metric)
    spark = table.sparkSession
    meta = build_clustering(table, id_col, params, path, vec_col)
    build_representatives(spark, path, meta, metric)
    publish(spark, path, meta)
    return load_forest(spark, path, metric)


def _schema(meta: dict, key: str) -> T.StructType | None:
    return T.StructType.fromJson(json.loads(meta[key])) if meta and meta.get(key) else None


def _reps_schema(meta: dict) -> T.StructType | None:
    members = _schema(meta, "members_schema")
    if members is None:
        return None
    id_type = members[meta["id_col"]].dataType
    return T.StructType([T.StructField(SHARD, T.IntegerType()), T.StructField(NODE, T.StringType()),
                         T.StructField(REP_ID, id_type), T.StructField(REP_VEC, T.ArrayType(T.DoubleType()))])


def _reps_written(spark: SparkSession, path: str, meta: dict, metric: str) -> bool:
    """True once the representatives of ``metric`` were written (the write's
    ``_SUCCESS`` marker is present, even for an empty table)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(f"{_reps_path(path, meta, metric)}/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def read_meta(spark: SparkSession, path: str) -> dict | None:
    meta_df = try_read_json(spark, f"{path}/meta")
    row = None if meta_df is None else meta_df.first()
    return None if row is None else json.loads(row["meta"])


def load_forest(spark: SparkSession, path: str, metric: str) -> Forest | None:
    """The published index with the representatives of ``metric`` (added to it
    if missing), or None.  The indexed table itself is not looked at."""
    metric = M.resolve_metric(metric)
    meta = read_meta(spark, path)
    if meta is None or meta.get("format") != FORMAT:
        return None
    if not _reps_written(spark, path, meta, metric):
        build_representatives(spark, path, meta, metric)
    root = _build_path(path, meta["build"])
    tree = try_read(spark, f"{root}/tree", _schema(meta, "tree_schema"))
    members = try_read(spark, f"{root}/members", _schema(meta, "members_schema"))
    reps = try_read(spark, _reps_path(path, meta, metric), _reps_schema(meta))
    if tree is None or members is None or reps is None:
        return None
    nodes = tree.join(reps, [SHARD, NODE], "left").select(
        SHARD, NODE, PARENT, CHILD, DEPTH, IS_LEAF, COUNT, REP_ID, REP_VEC)
    return Forest(nodes, members, {**meta, "metric": metric})


def try_read_json(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema("meta string").json(path)
    except AnalysisException:
        return None


def load_or_build_forest(table: DataFrame, id_col: str, metric: str, params: ForestParams, path: str,
                         force: bool = False) -> Forest:
    """Reuse the published build when it belongs to this table and these
    parameters (format, id column, parameters, and a fingerprint of ids and
    vectors); otherwise, or with ``force``, make a new one.  The clustering is
    shared by all metrics."""
    spark = table.sparkSession
    if not force:
        m = read_meta(spark, path)
        want = {"format": FORMAT, "id_col": id_col, **asdict(params)}
        if m is not None and all(m.get(key) == val for key, val in want.items()):
            if all(m.get(key) == val for key, val in fingerprint(table, id_col).items()):
                forest = load_forest(spark, path, metric)
                if forest is not None:
                    return forest
    return build_forest(table, id_col, metric, params, path)


def descend(forest: Forest, queries: DataFrame, metric: str) -> DataFrame:
    """Greedy descent: ``(query_id, q, shard, leaf_id)``, one leaf per
    (query, shard) at most.

    Each step is one left join of the frontier with the children of its node
    (leaf nodes match nothing and stay), a score, and a per-(query, shard)
    ``row_number``; no union, so the plan grows linearly with the depth.
    """
    from pyspark.sql import Window
    metric = M.resolve_metric(metric)
    meta = forest.meta
    dim = int(meta["dim"])
    nodes = forest.nodes
    n_nodes = int(meta.get("nodes") or nodes.count())
    kids = nodes.filter(F.col(PARENT).isNotNull() & F.col(REP_VEC).isNotNull()).select(
        SHARD, F.col(PARENT).alias(NODE), F.col(NODE).alias("_child"), CHILD, REP_VEC)
    if estimate_bytes(n_nodes, dim) <= MAX_BROADCAST_BYTES:
        kids = F.broadcast(kids)
    shards = nodes.filter(F.col(DEPTH) == 0).select(SHARD)
    # at most ``shards`` rows (one root per shard)
    frontier = queries.select(QID, Q).crossJoin(F.broadcast(shards)).withColumn(NODE, F.lit(ROOT))
    w = Window.partitionBy(QID, SHARD).orderBy(F.col("_s").desc_nulls_last(), F.col(CHILD).asc_nulls_last())
    for _ in range(int(meta["max_depth"])):
        x = frontier.join(kids, [SHARD, NODE], "left").withColumn("_s", rank_key(M.score(metric, Q, REP_VEC)))
        x = x.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
        nxt = F.when(F.col("_child").isNull(), F.col(NODE)).when(F.col("_s").isNotNull(), F.col("_child"))
        frontier = x.select(QID, Q, SHARD, nxt.alias(NODE)).filter(F.col(NODE).isNotNull())
    return frontier.select(QID, Q, SHARD, F.col(NODE).alias(LEAF))


def descend_best_first(forest: Forest, queries: DataFrame, metric: str, n_leaves: int) -> DataFrame:
    """Best-first descent: ``(query_id, shard, leaf_id, loss)``, the ``n_leaves`` leaves per query, over all
    shards, whose branches lost most narrowly.

    A branch loses by the gap between the best score among its siblings and its own; the loss of a node is
    the sum of the gaps on the way to it, so the leaf of the greedy descent has loss 0 in each shard.  The
    frontier goes down one level at a time and keeps the ``n_leaves`` nodes of least loss (ties by shard and
    node).  Nothing is lost by that: losses never fall on the way down and each kept node has a leaf of its
    own loss below it, so these are the leaves that a queue ordered by loss would give first.  Rows carry
    ids and losses only; the frontier has at most ``n_leaves`` rows per query.
    """
    from pyspark.sql import Window
    metric = M.resolve_metric(metric)
    meta = forest.meta
    nodes = forest.nodes
    n_nodes = int(meta.get("nodes") or nodes.count())
    kids = nodes.filter(F.col(PARENT).isNotNull() & F.col(REP_VEC).isNotNull()).select(
        SHARD, F.col(PARENT).alias(NODE), F.col(NODE).alias("_child"), REP_VEC)
    if estimate_bytes(n_nodes, int(meta["dim"])) <= MAX_BROADCAST_BYTES:
        kids = F.broadcast(kids)
    shards = nodes.filter(F.col(DEPTH) == 0).select(SHARD)
    queries = queries.select(QID, Q)
    # one root per shard; the queries are those of one block, whose size is checked
    frontier = queries.select(QID).crossJoin(F.broadcast(shards)).select(QID, SHARD, F.lit(ROOT).alias(NODE), F.lit(0.0).alias(LOSS))
    siblings = Window.partitionBy(QID, SHARD, NODE)
    w = Window.partitionBy(QID).orderBy(LOSS, SHARD, "_next")
    for _ in range(int(meta["max_depth"])):
        x = frontier.join(kids, [SHARD, NODE], "left").join(F.broadcast(queries), QID)
        x = x.select(QID, SHARD, NODE, LOSS, "_child", rank_key(M.score(metric, Q, REP_VEC)).alias("_s"))
        gap = F.max("_s").over(siblings) - F.col("_s")
        nxt = F.when(F.col("_child").isNull(), F.col(NODE)).when(F.col("_s").isNotNull(), F.col("_child"))
        x = x.select(QID, SHARD, nxt.alias("_next"), (F.col(LOSS) + F.coalesce(F.nanvl(gap, F.lit(0.0)), F.lit(0.0))).alias(LOSS))
        x = x.filter(F.col("_next").isNotNull()).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n_leaves)
        frontier = x.select(QID, SHARD, F.col("_next").alias(NODE), LOSS)
    return frontier.select(QID, SHARD, F.col(NODE).alias(LEAF), LOSS)


def leaf_hits(forest: Forest, queries: DataFrame, metric: str, n_leaves: int | None = None) -> DataFrame:
    """``(query_id, shard, leaf_id)``: chosen leaves plus the ``invalid`` leaf of each shard that has one, per
    query.  Leaves come from the greedy descent, or with ``n_leaves`` from the best-first one."""
    if n_leaves is None:
        leaves = descend(forest, queries, metric)
        return leaves.select(QID, SHARD, F.explode(F.array(F.col(LEAF), F.lit(INVALID))).alias(LEAF))
    leaves = descend_best_first(forest, queries, metric, n_leaves).select(QID, SHARD, LEAF)
    return leaves.unionByName(leaves.select(QID, SHARD).distinct().withColumn(LEAF, F.lit(INVALID)))


def rows_read(forest: Forest, queries: DataFrame, metric: str, n_leaves: int | None = None) -> DataFrame:
    """``(query_id, leaves, rows, share)``: leaves that a search reads, their rows, and the share of all rows."""
    valid = forest.nodes.filter(F.col(IS_LEAF)).select(SHARD, F.col(NODE).alias(LEAF), COUNT)
    hits = leaf_hits(forest, queries, metric, n_leaves).filter(F.col(LEAF) != INVALID).join(valid, [SHARD, LEAF])
    return hits.groupBy(QID).agg(F.count(F.lit(1)).alias("leaves"), F.sum(COUNT).alias("rows")).withColumn(
        "share", F.col("rows") / F.lit(max(1, int(forest.meta["rows"]))))


def _block_scores(forest: Forest, queries: DataFrame, metric: str, n_leaves: int | None = None) -> DataFrame:
    """Scores of one block of queries.

    The descent runs once: its leaf keys (ids only, a bounded number) are
    collected and become (a) a filter on ``members`` by shard folder and leaf,
    and (b) a small local table joined back to the query vectors.
    """
    id_col = forest.meta["id_col"]
    spark = queries.sparkSession
    keys = leaf_hits(forest, queries, metric, n_leaves).collect()
    key_df = spark.createDataFrame([tuple(r) for r in keys], T.StructType([
        T.StructField(QID, queries.schema[QID].dataType), T.StructField(SHARD, T.IntegerType()),
        T.StructField(LEAF, T.StringType())]))
    hits = with_query_norm(queries.select(QID, Q).join(F.broadcast(key_df), QID))
    members = forest.members.filter(
        F.col(SHARD).isin(sorted({r[SHARD] for r in keys})) & F.col(LEAF).isin(sorted({r[LEAF] for r in keys}))
        & (F.size(VEC) > 0))  # rows without features have no place in a tree: no result
    rows, v_norm = with_row_norm(members, metric, VEC)
    j = rows.join(F.broadcast(hits), [SHARD, LEAF])  # at most LEAF_KEYS_PER_BLOCK rows
    return j.select(QID, SHARD, LEAF, id_col, search_score(metric, VEC, Q, Q_NORM, v_norm).alias(SCORE))


def _query_blocks(forest: Forest, queries: DataFrame, info: QueryInfo | None,
                  n_leaves: int | None = None) -> tuple[list[DataFrame], bool]:
    """Blocks of queries of a bounded number of leaf keys and of bounded size;
    whether there is one query only (checked in the plan where declared)."""
    if info is not None and info.rows == 1:
        return [only_query(queries)], True
    info = query_info(queries)
    shards = int(forest.meta["shards"])
    per_query = 2 * shards if n_leaves is None else shards + n_leaves
    n = max(1, -(-info.rows * per_query // LEAF_KEYS_PER_BLOCK),
            -(-estimate_bytes(info.rows * per_query, info.dim) // MAX_BROADCAST_BYTES))
    if n == 1:
        return [queries], info.rows <= 1
    block = F.pmod(F.xxhash64(QID), F.lit(n))
    return [queries.filter(block == i) for i in range(n)], False


def leaf_scores(forest: Forest, queries: DataFrame, metric: str, info: QueryInfo | None = None) -> DataFrame:
    """``(query_id, shard, leaf_id, id, similarity_score)`` for every member of
    the chosen leaves, only whose files are read."""
    out = None
    for block in _query_blocks(forest, queries, info)[0]:
        part = _block_scores(forest, block, metric)
        out = part if out is None else out.unionByName(part)
    return out


def forest_top_k(forest: Forest, queries: DataFrame, metric: str, k: int,
                 info: QueryInfo | None = None, n_leaves: int | None = None) -> DataFrame:
    """Approximate top-k per query through the index: one leaf per shard by the greedy descent, or, with
    ``n_leaves``, that many leaves per query by the best-first one.  With all leaves the result is exact."""
    metric = M.resolve_metric(metric)
    validate_k(k)
    if n_leaves is not None and n_leaves < 1:
        raise ValueError(f"n_leaves must be positive, got {n_leaves}")
    id_col = forest.meta["id_col"]
    blocks, single = _query_blocks(forest, queries, info, n_leaves)
    out = None
    for block in blocks:  # a query lies in one block whole
        part = top_k(_block_scores(forest, block, metric, n_leaves), k, id_col, single_group=single)
        out = part if out is None else out.unionByName(part)
    return out.select(QID, "rank", id_col, SCORE)
