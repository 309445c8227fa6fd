"""Hand-computed metric values and edge cases (FIXTURES F7)."""

import math

import pytest
from pyspark.sql import functions as F

from vicinity.functions import metrics as M
from vicinity.plans.exact import QueryInfo, exact_top_k, score_all
from vicinity.sources.queries import literal_query

METRICS = list(M.METRIC_NAMES)


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, vec array<double>")


def scores(spark, rows, q, metric):
    t = table(spark, rows)
    s = score_all(t, literal_query(spark, q), metric, "id", info=QueryInfo(1, len(q)))
    return {r["id"]: r["similarity_score"] for r in s.collect()}


def ranked(spark, rows, q, metric, k=10):
    t = table(spark, rows)
    r = exact_top_k(t, literal_query(spark, q), metric, k, "id", info=QueryInfo(1, len(q)))
    return [(x["id"], x["similarity_score"]) for x in r.orderBy("rank").collect()]


@pytest.mark.parametrize("metric,expected", [
    ("cosine", 0.0), ("euclidean_sim", 1 / (1 + math.sqrt(5))), ("manhattan_sim", 0.25), ("dot_product", 0.0)])
def test_zero_row(spark, metric, expected):
    assert scores(spark, [(1, [0.0, 0.0])], [1.0, 2.0], metric)[1] == pytest.approx(expected)


def test_zero_query_cosine_is_zero(spark):
    s = scores(spark, [(1, [1.0, 2.0]), (2, [0.0, 0.0])], [0.0, 0.0], "cosine")
    assert s == {1: 0.0, 2: 0.0}


@pytest.mark.parametrize("metric,expected", [
    ("cosine", 1.0), ("euclidean_sim", 1.0), ("manhattan_sim", 1.0), ("dot_product", 25.0)])
def test_identical(spark, metric, expected):
    assert scores(spark, [(1, [3.0, 4.0])], [3.0, 4.0], metric)[1] == pytest.approx(expected)


@pytest.mark.parametrize("metric,expected", [
    ("cosine", -1.0), ("euclidean_sim", 1 / 3), ("manhattan_sim", 1 / 3), ("dot_product", -1.0)])
def test_opposite(spark, metric, expected):
    assert scores(spark, [(1, [1.0, 0.0])], [-1.0, 0.0], metric)[1] == pytest.approx(expected)


@pytest.mark.parametrize("metric", METRICS)
def test_nan_and_null_elements(spark, metric):
    rows = [(1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [1.0, 1.0])]
    got = dict(ranked(spark, rows, [1.0, 1.0], metric))
    if metric == "cosine":
        assert got[1] == 0.0 and got[2] == 0.0 and got[3] == pytest.approx(1.0)
    else:
        assert set(got) == {3}


def test_tiny_row_norm_clamped(spark):
    assert scores(spark, [(1, [1e-12, 0.0])], [1.0, 0.0], "cosine")[1] == pytest.approx(0.001)


@pytest.mark.parametrize("metric", METRICS)
def test_no_features(spark, metric):
    assert scores(spark, [(1, []), (2, [])], [], metric) == {1: 0.0, 2: 0.0}


def test_empty_query_against_features_gives_nothing(spark):
    assert ranked(spark, [(1, [1.0, 2.0])], [], "euclidean_sim") == []


def test_ties_break_on_lowest_id(spark):
    rows = [(7, [1.0, 2.0]), (3, [1.0, 2.0]), (5, [1.0, 2.0])]
    assert [i for i, _ in ranked(spark, rows, [1.0, 2.0], "cosine", k=2)] == [3, 5]


def test_k_larger_than_table(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    assert len(ranked(spark, rows, [1.0, 0.0], "dot_product", k=10)) == 3


def test_unknown_metric_k_zero_and_bad_dimension(spark):
    with pytest.raises(ValueError):
        M.resolve_metric("hamming")
    with pytest.raises(ValueError):
        ranked(spark, [(1, [1.0])], [1.0], "cosine", k=0)
    with pytest.raises(Exception, match="dimension mismatch"):
        ranked(spark, [(1, [1.0, 2.0, 3.0])], [1.0, 2.0], "cosine")


def test_metric_names_case_insensitive():
    assert M.resolve_metric("Cosine") == "cosine"
    assert M.resolve_metric("EUCLIDEAN") == "euclidean_sim"
    assert M.resolve_metric("dot") == "dot_product"


def test_score_never_raises_on_ansi_division(spark):
    # zero norms on both sides: ANSI mode would raise on a raw division
    s = scores(spark, [(1, [0.0, 0.0])], [0.0, 0.0], "cosine")
    assert s[1] == 0.0


def test_vector_norm(spark):
    t = table(spark, [(1, [3.0, 4.0])])
    assert t.select(M.norm("vec").alias("n")).first()["n"] == pytest.approx(5.0)
    assert t.select(F.expr(M.sq_norm_sql("vec")).alias("n")).first()["n"] == pytest.approx(25.0)


def test_query_sources(spark):
    from vicinity.sources.queries import constant_query, seeded_query
    import numpy as np
    c = constant_query(spark, 4).first()
    assert c["q"] == [0.5] * 4 and c["query_id"] == 0
    s = seeded_query(spark, 5, 42).first()["q"]
    assert s == pytest.approx(np.random.RandomState(42).rand(5).tolist())
    assert constant_query(spark, 0).first()["q"] == []


def test_wide_and_back(spark):
    from vicinity.functions.vectors import vector_to_wide, wide_to_vector
    wide = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "row_id long, col_0 double, col_1 double, col_2 double")
    v = wide_to_vector(wide, "row_id", ["col_0", "col_1", "col_2"])
    assert v.first()["vec"] == [1.0, 2.0, 3.0]
    back = vector_to_wide(v, "row_id", "vec", 3, "col_").first()
    assert (back["col_0"], back["col_2"]) == (1.0, 3.0)
    assert wide_to_vector(wide, "row_id", []).first()["vec"] == []


def test_user_metric_in_all_native_modes(spark):
    import tempfile
    from vicinity.plans import forest as FO
    from vicinity.plans.transform import TransformParams, transform_top_k
    from vicinity.sources import tables as T
    from vicinity.sources.queries import queries_by_id
    name = M.register_metric("neg_sq_l2", lambda a, b: f"(0D - {M.sq_distance_sql(a, b)})")
    t = T.embeddings(spark, "/root/testdata/sf0.01")
    q = queries_by_id(t, "vec_id", 5)
    mine = [r.vec_id for r in exact_top_k(t, q, name, 8, "vec_id", info=QueryInfo(1, 64)).orderBy("rank").collect()]
    ref = [r.vec_id for r in exact_top_k(t, q, "euclidean_sim", 8, "vec_id", info=QueryInfo(1, 64))
           .orderBy("rank").collect()]
    assert mine == ref                      # same order as 1/(1+L2)
    p = TransformParams(n_refs=3, sample_size=50, seed=1)
    assert transform_top_k(t, q, name, 3, "vec_id", p, one_query=True).count() == 3
    f = FO.build_forest(t, "vec_id", name, FO.ForestParams(shards=2, k=2, max_depth=1, min_leaf=10,
                                                           iterations=1), tempfile.mkdtemp())
    assert FO.forest_top_k(f, q, name, 3, QueryInfo(1, 64)).count() == 3
    with pytest.raises(ValueError):
        M.register_metric("cosine", lambda a, b: "0D")
    from vicinity.plans.arrow_scan import arrow_top_k
    with pytest.raises(ValueError):
        arrow_top_k(t, q, name, 3, "vec_id")


def test_large_k_for_one_and_for_many_queries(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 1501)]
    got = ranked(spark, rows, [1.0, 1.0], "manhattan_sim", k=1200)
    assert len(got) == 1200 and got[0][0] == 1
    two = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 1.0])], "query_id long, q array<double>")
    both = exact_top_k(table(spark, rows), two, "manhattan_sim", 1200, "id").collect()
    assert [r.id for r in sorted(both, key=lambda r: r.rank) if r.query_id == 0] == [i for i, _ in got]
    assert len(both) == 2400


def test_two_queries_declared_as_one_fail(spark):
    t = table(spark, [(i, [float(i), 1.0]) for i in range(1, 20)])
    two = spark.createDataFrame([(5, [1.0, 1.0]), (5, [2.0, 1.0])], "query_id long, q array<double>")
    with pytest.raises(Exception, match="more than the one query"):
        exact_top_k(t, two, "cosine", 5, "id", info=QueryInfo(1, 2)).collect()
    # any other number is counted, whatever was said
    three = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "query_id long, q array<double>")
    assert exact_top_k(t, three, "cosine", 5, "id", info=QueryInfo(2, 2)).count() == 15
    assert exact_top_k(t, three.limit(0), "cosine", 5, "id", info=QueryInfo(1, 2)).count() == 0


def test_queries_in_blocks_give_the_same(spark, monkeypatch):
    from vicinity.operators import broadcast
    t = table(spark, [(i, [float(i % 7), float(i % 5)]) for i in range(60)])
    qs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "query_id long, q array<double>")
    whole = exact_top_k(t, qs, "euclidean_sim", 4, "id")
    monkeypatch.setattr(broadcast, "MAX_BROADCAST_BYTES", 1024)
    blocks = exact_top_k(t, qs, "euclidean_sim", 4, "id")
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") > 2
    assert sorted(blocks.collect()) == sorted(whole.collect())


def test_mixed_requests_answer_what_they_can(spark):
    from vicinity.plans.exact import exact_top_k_mixed
    t = table(spark, [(i, [float(i), 1.0]) for i in range(1, 6)])
    reqs = spark.createDataFrame(
        [(1, [1.0, 1.0], "Dot"), (2, [1.0, 1.0], "nonsense"), (3, [1.0], "cosine"), (4, None, "cosine"), (5, [2.0, 1.0], " EUCLIDEAN "),
         (6, [1.0, 1.0], None)], "query_id long, q array<double>, metric string")
    got = exact_top_k_mixed(t, reqs, 2, "id").collect()
    assert sorted((r.query_id, r.metric, r.rank, r.id) for r in got if r.error is None) == [
        (1, "dot_product", 1, 5), (1, "dot_product", 2, 4), (5, "euclidean_sim", 1, 2), (5, "euclidean_sim", 2, 1)]
    assert {r.query_id: r.error for r in got if r.error} == {
        2: "unknown metric: nonsense", 3: "dimension 1 instead of 2", 4: "no query vector", 6: "unknown metric: null"}
