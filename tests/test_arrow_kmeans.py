"""Sums of nearest rows taken in Arrow tasks: equal to the native step, ties, empty input, fallback."""

import pytest

from test_minibatch import active_of, clouds, params, work_of
from vicinity.plans import arrow_kmeans as AK
from vicinity.plans import forest as FO
from vicinity.operators.centers import mean_vector


def by_child(df, center="center"):
    return {(r[FO.NODE], r[FO.CHILD]): r[center] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for key, vector in a.items():
        assert vector == pytest.approx(b[key], rel=1e-9)


def test_one_step_is_the_native_step(spark):
    work = work_of(spark, clouds(400, 3), nodes=3)
    cents = FO._seeds(work, "id", 5, 1, 3)
    got = FO._arrow_sums(work.repartition(7), cents)
    assigned = FO._assign(work, FO._pack(cents), "id", 3, 5, 3)
    same(by_child(got, "_mean"), by_child(mean_vector(assigned, FO.VEC, [FO.SHARD, FO.NODE, FO.CHILD])))
    counts = {(r[FO.NODE], r[FO.CHILD]): r["count"] for r in assigned.groupBy(FO.NODE, FO.CHILD).count().collect()}
    assert {(r[FO.NODE], r[FO.CHILD]): r._new for r in got.collect()} == counts


@pytest.mark.parametrize("seeding", ["hash", "spread"])
def test_minibatch_engines_agree(spark, seeding):
    work = work_of(spark, clouds(500, 5), nodes=2)
    both = [FO._minibatch(work, active_of(work), "id", params(engine=e, seeding=seeding, batch_steps=4), 2, 3)
            for e in ("native", "arrow")]
    same(*(by_child(c) for c in both))


def test_ties_go_to_the_lowest_child_and_empty_input(spark):
    work = work_of(spark, [[0.0], [2.0], [1.0], [1.0]])
    cents = spark.createDataFrame([(0, "root_0", 1, [0.0]), (0, "root_0", 0, [2.0]), (0, "root_0", 2, [2.0])],
                                  f"{FO.SHARD} int, {FO.NODE} string, {FO.CHILD} int, {FO.CENTER} array<double>")
    got = {r[FO.CHILD]: (r._new, r._loss) for r in FO._arrow_sums(work, cents).collect()}
    assert got == {0: (3, 2.0), 1: (1, 0.0)}
    assert FO._arrow_sums(work.limit(0), cents).collect() == []
    assert FO._arrow_sums(work, cents.limit(0)).collect() == []


def test_blocks_and_large_offsets(monkeypatch):
    import numpy as np
    rows = np.random.default_rng(1).random((50, 3)) + 1e8
    monkeypatch.setattr(AK, "BLOCK_ROWS", 7)
    place, away = AK.nearest(rows, rows[:4])
    want = np.square(rows[:, None] - rows[None, :4]).sum(axis=2)
    assert (place == want.argmin(axis=1)).all() and away == pytest.approx(want.min(axis=1))


def test_beyond_the_broadcast_limit_the_native_step_is_used(monkeypatch):
    assert FO._sums_by_arrow(params(engine="arrow"), 10, 3)
    assert not FO._sums_by_arrow(params(engine="native"), 10, 3)
    monkeypatch.setattr(FO, "MAX_BROADCAST_BYTES", 100)
    assert not FO._sums_by_arrow(params(engine="arrow"), 10, 3)


def test_wrong_engine():
    with pytest.raises(ValueError):
        FO._check_params(params(engine="other"))
