"""Steps of a default build: each distance is taken once, in Arrow tasks, and equals the native expression."""

import math

import pytest

from test_minibatch import clouds, work_of
from vicinity.functions import metrics as M
from vicinity.plans import arrow_kmeans as AK
from vicinity.plans import forest as FO


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def children(df):
    return sorted((r[FO.NODE], r["id"], r[FO.CHILD]) for r in df.collect())


def test_children_are_those_of_the_native_step(spark, monkeypatch):
    work = work_of(spark, clouds(600, 3), nodes=3)
    packed = FO._pack(FO.cut_lineage(FO._seeds(work, "id", 5, 1, 3)))
    monkeypatch.setattr(AK, "BLOCK_ROWS", 37)
    got = FO._assign(work.repartition(5), packed, "id", 3, 5, 3)
    assert "ArrowEvalPython" in plan(got) and "lambdafunction" not in plan(got)
    monkeypatch.setattr(FO, "MAX_BROADCAST_BYTES", 100)
    native = FO._assign(work, packed, "id", 3, 5, 3)
    assert "lambdafunction" in plan(native)
    assert children(got) == children(native)


def test_odd_rows_go_where_the_native_step_puts_them(spark, monkeypatch):
    inf = math.inf
    work = work_of(spark, [[], [1.0], [0.0, 0.0], [inf, 0.0], [-inf, inf], [1.0, 1.0], [3.0, 3.0]])
    schema = f"{FO.SHARD} int, {FO.NODE} string, {FO.CHILD} int, {FO.CENTER} array<double>"
    for centers in ([[3.0, 3.0], [-1.0, -1.0], [inf, 0.0]], [[inf, 0.0], [1.0, 1.0], [1.0, 1.0]], [[2.0, 2.0], [], [1.0]]):
        packed = FO._pack(spark.createDataFrame([(0, "root_0", i, c) for i, c in enumerate(centers)], schema))
        got = children(FO._assign(work, packed, "id", 1, 3, 2))
        with monkeypatch.context() as m:
            m.setattr(FO, "MAX_BROADCAST_BYTES", 1)
            assert got == children(FO._assign(work, packed, "id", 1, 3, 2))
        assert len(got) == 7


def test_spread_seeds_are_those_of_the_native_step(spark, monkeypatch):
    work = work_of(spark, clouds(300, 4) + [[], [math.inf, 0.0, 0.0]], nodes=3).repartition(6)

    def seeds():
        rows = FO._spread_seeds(work, "id", 4, 9, 3, 3).collect()
        return {(r[FO.NODE], r[FO.CHILD]): tuple(r[FO.CENTER]) for r in rows}

    got = seeds()
    monkeypatch.setattr(FO, "MAX_BROADCAST_BYTES", 1)
    assert got == seeds() and len(got) == 12


def test_a_round_of_seeds_takes_distances_once(spark, monkeypatch):
    """Written tables a round: the drawn ids and the seeds.  Draws are not read a second time to find them."""
    written = []
    original = FO.cut_lineage
    monkeypatch.setattr(FO, "cut_lineage", lambda df, tag="t": (written.append(plan(df)), original(df, tag))[1])
    FO._spread_seeds(work_of(spark, clouds(60, 3), nodes=2), "id", 3, 1, 2, 3)
    assert len(written) == 1 + 2 * 2
    assert [p.count("MapInArrow") for p in written] == [0, 1, 0, 1, 0]


@pytest.mark.parametrize("metric", M.METRIC_NAMES)
def test_representatives_score_each_pair_once(spark, monkeypatch, metric):
    rows = [(0, f"root_{i % 3}", i, v) for i, v in enumerate([*clouds(60, 3), [0.0] * 3, [0.0] * 3, [0.0] * 3])]
    rows += [(0, "root_1", None, [9.0] * 3), (0, FO.INVALID, 99, None)]
    members = spark.createDataFrame(rows, f"{FO.SHARD} int, {FO.LEAF} string, id long, {FO.VEC} array<double>")
    tree = spark.createDataFrame([(0, "root", None), (0, "root_0", [1.0, 2.0, 3.0]), (0, "root_1", [0.0] * 3), (0, "root_2", [9.0] * 3)],
                                 f"{FO.SHARD} int, {FO.NODE} string, {FO.CENTROID} array<double>")
    written = []
    original = FO.cut_lineage
    monkeypatch.setattr(FO, "cut_lineage", lambda df, tag="t": (written.append(plan(df)), original(df, tag))[1])
    got = {r[FO.NODE]: r[FO.REP_ID] for r in FO.representatives(members, tree, metric, "id", 3).collect()}
    assert len(written) == 1 and written[0].split("== Initial Plan ==")[-1].count("Generate explode") == 1
    scored = members.filter("leaf_id <> 'invalid'").join(tree.withColumnRenamed(FO.NODE, FO.LEAF), [FO.SHARD, FO.LEAF]).select(
        FO.LEAF, "id", M.score(metric, FO.VEC, FO.CENTROID).alias("s")).collect()
    for node in ("root_0", "root_1", "root_2"):
        mine = [(-r.s, r.id is None, r.id) for r in scored if r[FO.LEAF] == node]
        assert got.get(node) == min(mine)[2]
