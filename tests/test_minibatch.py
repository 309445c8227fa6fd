"""Mini-batch k-means: batches against plain Python, loss against full iterations, odd nodes and parameters."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from vicinity.functions import metrics as M
from vicinity.plans import forest as FO

SCHEMA = "id long, features array<double>"


def work_of(spark, rows, nodes=1):
    table = spark.createDataFrame(list(enumerate(rows)), SCHEMA)
    return table.select(F.lit(0).alias(FO.SHARD), F.concat(F.lit("root_"), (F.col("id") % nodes).cast("string")).alias(FO.NODE),
                        "id", F.col("features").alias(FO.VEC))


def active_of(work):
    return work.groupBy(FO.SHARD, FO.NODE).agg(F.count(F.lit(1)).alias("n"))


def params(**kw):
    return FO.ForestParams(**{"k": 4, "seed": 3, "batch_size": 40, "batch_steps": 8, "starts": 3, **kw})


def loss(work, cents):
    nearest = F.expr(f"array_min(transform({FO.CENTS}, cc -> {M.sq_distance_sql(FO.VEC, 'cc.c')}))")
    got = work.join(F.broadcast(FO._pack(cents)), [FO.SHARD, FO.NODE]).groupBy(FO.NODE).agg(F.sum(nearest).alias("loss")).collect()
    return {r[FO.NODE]: r.loss for r in got}


def clouds(n, seed):
    draw = random.Random(seed)
    return [[draw.gauss(6.0 * (i % 4), 1.0), draw.gauss(-5.0 * (i % 3), 1.0), draw.random()] for i in range(n)]


def plain(rows, p):
    """One node in plain Python: the centroids of the best start."""
    def digits(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / (1 << 52)

    def near(x, cents):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))

    n_batches, tries = math.ceil(len(rows) / p.batch_size), []
    for s in range(p.starts):
        batches = [math.floor(digits(f"{i}{p.seed}/batch{s}") * n_batches) for i in range(len(rows))]
        drawn = sorted((hashlib.md5(f"{i}{p.seed + s}".encode()).hexdigest(), i) for i, b in enumerate(batches) if b < p.batch_steps)
        cents = [list(rows[i]) for _, i in drawn[:p.k]]
        seen = [0] * len(cents)
        for t in range(p.batch_steps):
            mine = [x for x, b in zip(rows, batches, strict=True) if b == t % n_batches]
            own = [near(x, cents)[1] for x in mine]
            for j in range(len(cents)):
                got = [x for x, o in zip(mine, own, strict=True) if o == j]
                if got:
                    cents[j] = [(c * seen[j] + sum(xs)) / (seen[j] + len(got)) for c, xs in zip(cents[j], zip(*got, strict=True), strict=True)]
                    seen[j] += len(got)
        tries.append((sum(near(x, cents)[0] for x in rows), s, cents))
    return min(tries)[2]


@pytest.mark.parametrize("n", [900, 30])  # far more batches than steps; a single batch
def test_centroids_are_those_of_plain_python(spark, n):
    rows, p = clouds(n, n), params()
    work = work_of(spark, rows)
    got = FO._minibatch(work, active_of(work), "id", p, 1, 3).orderBy(FO.CHILD).collect()
    want = plain(rows, p)
    assert [r[FO.CHILD] for r in got] == list(range(len(want)))
    for r, c in zip(got, want, strict=True):
        assert r.center == pytest.approx(c, rel=1e-9)


def test_loss_is_near_that_of_full_iterations_in_every_node(spark):
    work = work_of(spark, clouds(3000, 1), nodes=3)
    p = params(k=6, batch_size=100, batch_steps=12, seeding="spread")
    mini = loss(work, FO._minibatch(work, active_of(work), "id", p, 3, 3))
    full = loss(work, FO._lloyd(work, "id", FO.ForestParams(k=6, seed=3, seeding="spread", iterations=20), 3, 3)[0])
    assert set(mini) == set(full) == {"root_0", "root_1", "root_2"}
    assert all(mini[node] <= 1.05 * full[node] for node in full)


def test_more_starts_never_lose(spark):
    work = work_of(spark, clouds(600, 7))
    losses = [sum(loss(work, FO._minibatch(work, active_of(work), "id", params(starts=s), 1, 3)).values()) for s in (1, 3)]
    assert losses[1] <= losses[0] * (1 + 1e-6)


def test_build_with_repeated_invalid_and_few_rows(spark, tmp_path):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(60 + i, [9.0, float(i % 2)]) for i in range(20)]
    rows += [(90, None), (91, [float("nan"), 1.0]), (92, [1.0, None])]
    table = spark.createDataFrame(rows, SCHEMA)
    p = FO.ForestParams(shards=1, k=3, max_depth=2, min_leaf=10, batch_size=16, batch_steps=4, starts=2)
    forest = FO.build_forest(table.withColumnRenamed("features", FO.VEC), "id", "euclidean_sim", p, str(tmp_path / "f"))
    members = forest.members.select("id", FO.LEAF).collect()
    assert sorted(r.id for r in members) == sorted(i for i, _ in rows)
    assert {r.id for r in members if r[FO.LEAF] == FO.INVALID} == {90, 91, 92}
    same = {r[FO.LEAF] for r in members if r.id < 60}
    assert len(same) == 1
    counts = {r[FO.NODE]: r[FO.COUNT] for r in forest.nodes.collect()}
    assert counts[FO.ROOT] == 80


def test_a_batch_step_reads_drawn_rows_only(spark):
    rows = clouds(2000, 2)
    work, p = work_of(spark, rows), params(batch_size=20, batch_steps=3, starts=2)
    n_batches = math.ceil(len(rows) / p.batch_size)
    drawn = sum(any(math.floor(int(hashlib.md5(f"{i}{p.seed}/batch{s}".encode()).hexdigest()[:13], 16) / (1 << 52) * n_batches)
                    < p.batch_steps for s in range(p.starts)) for i in range(len(rows)))
    # Two starts of three batches of some twenty rows each, out of two thousand.
    assert 60 <= drawn <= 180
    before = {}
    original = FO.cut_lineage

    def counted(df, tag="t"):
        out = original(df, tag)
        before.setdefault(tag, out.count())
        return out

    FO.cut_lineage = counted
    try:
        FO._minibatch(work, active_of(work), "id", p, 1, 3)
    finally:
        FO.cut_lineage = original
    assert before["batches"] == drawn


@pytest.mark.parametrize("wrong", [{"batch_size": -1}, {"batch_steps": 0}, {"starts": 0}])
def test_wrong_parameters(wrong):
    with pytest.raises(ValueError):
        FO._check_params(params(**wrong))
