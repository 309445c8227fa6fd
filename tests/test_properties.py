"""Properties of the three search modes on the driver's embeddings table."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from vicinity.functions import metrics as M
from vicinity.operators.sampling import hash_sample
from vicinity.plans import forest as FO
from vicinity.plans.exact import QueryInfo, exact_top_k, score_all
from vicinity.plans.transform import TransformParams, transform_top_k
from vicinity.sources import tables as T
from vicinity.sources.queries import queries_by_id

METRICS = list(M.METRIC_NAMES)


@pytest.fixture(scope="module")
def emb(spark):
    return T.embeddings(spark, SF001).cache()


def ids(df):
    return [r["vec_id"] for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("metric", METRICS)
def test_symmetry(spark, emb, metric):
    a = score_all(emb, queries_by_id(emb, "vec_id", 3), metric, "vec_id", info=QueryInfo(1, 64))
    b = score_all(emb, queries_by_id(emb, "vec_id", 11), metric, "vec_id", info=QueryInfo(1, 64))
    s_ab = a.filter(F.col("vec_id") == 11).first()["similarity_score"]
    s_ba = b.filter(F.col("vec_id") == 3).first()["similarity_score"]
    assert s_ab == pytest.approx(s_ba, rel=1e-12)


def test_cosine_bounds(spark):
    t = T.scaled_embeddings(spark, SF001)
    s = score_all(t, queries_by_id(t, "vec_id", 0), "cosine", "vec_id", info=QueryInfo(1, 64))
    r = s.agg(F.min("similarity_score").alias("lo"), F.max("similarity_score").alias("hi")).first()
    assert -1.0 - 1e-12 <= r["lo"] and r["hi"] <= 1.0 + 1e-12


@pytest.mark.parametrize("metric", ["cosine", "euclidean_sim", "manhattan_sim"])
def test_self_is_top1(spark, metric):
    t = T.scaled_embeddings(spark, SF001)
    r = exact_top_k(t, queries_by_id(t, "vec_id", 42), metric, 1, "vec_id", info=QueryInfo(1, 64))
    assert ids(r) == [42]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_repartition_invariance(spark, emb, parts):
    base = ids(exact_top_k(emb, queries_by_id(emb, "vec_id", 5), "manhattan_sim", 10, "vec_id",
                           info=QueryInfo(1, 64)))
    re = emb.repartition(parts)
    assert ids(exact_top_k(re, queries_by_id(re, "vec_id", 5), "manhattan_sim", 10, "vec_id",
                           info=QueryInfo(1, 64))) == base


def test_multi_query_equals_single_queries(spark, emb):
    multi = exact_top_k(emb, queries_by_id(emb, "vec_id", [1, 2, 3]), "cosine", 5, "vec_id")
    got = {}
    for r in multi.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for qid in (1, 2, 3):
        single = ids(exact_top_k(emb, queries_by_id(emb, "vec_id", qid), "cosine", 5, "vec_id",
                                 info=QueryInfo(1, 64)))
        assert [v for _, v in sorted(got[qid])] == single


def test_hash_sample_is_deterministic_and_exact(spark, emb):
    a = sorted(r["vec_id"] for r in hash_sample(emb, "vec_id", 50, 7).collect())
    b = sorted(r["vec_id"] for r in hash_sample(emb.repartition(5), "vec_id", 50, 7).collect())
    assert a == b and len(a) == 50


def test_transform_with_k_equal_table_returns_all(spark, emb):
    p = TransformParams(n_refs=4, sample_size=100, seed=1)
    r = transform_top_k(emb, queries_by_id(emb, "vec_id", 9), "euclidean_sim", 500, "vec_id", p,
                        one_query=True)
    assert r.count() == 500


@pytest.fixture(scope="module")
def forest(spark, emb):
    path = tempfile.mkdtemp(prefix="vicinity-forest-")
    p = FO.ForestParams(shards=3, k=3, max_depth=2, min_leaf=15, iterations=2, seed=3)
    return FO.build_forest(emb, "vec_id", "cosine", p, path)


def test_every_row_in_exactly_one_leaf(forest):
    m = forest.members
    assert m.count() == 500 and m.select("vec_id").distinct().count() == 500
    leaves = {(r[0], r[1]) for r in forest.nodes.filter("is_leaf").select("shard", "node_id").collect()}
    used = {(r[0], r[1]) for r in m.select("shard", "leaf_id").distinct().collect()}
    assert used <= leaves


def test_child_counts_sum_to_parent(forest):
    n = forest.nodes
    kids = n.filter(F.col("parent_id").isNotNull()).groupBy("shard", F.col("parent_id").alias("node_id")).agg(
        F.sum("member_count").alias("kids"))
    bad = n.join(kids, ["shard", "node_id"]).filter(F.col("kids") != F.col("member_count"))
    assert bad.count() == 0


def test_forest_depth_zero_equals_exact(spark, emb):
    path = tempfile.mkdtemp(prefix="vicinity-forest0-")
    p = FO.ForestParams(shards=2, k=3, max_depth=0, min_leaf=10, iterations=1, seed=1)
    f = FO.build_forest(emb, "vec_id", "dot_product", p, path)
    q = queries_by_id(emb, "vec_id", 17)
    a = ids(FO.forest_top_k(f, q, "dot_product", 10, QueryInfo(1, 64)))
    b = ids(exact_top_k(emb, q, "dot_product", 10, "vec_id", info=QueryInfo(1, 64)))
    assert a == b


def test_forest_reads_only_chosen_leaves(spark, emb, forest):
    q = queries_by_id(emb, "vec_id", 17)
    scored = FO.leaf_scores(forest, q, "cosine")
    leaves = {r["leaf_id"] for r in scored.select("leaf_id").distinct().collect()}
    assert len(leaves) <= 3  # one leaf per shard at most
    assert scored.count() < 500


def test_forest_index_reused_when_fresh(spark, emb, forest):
    p = FO.ForestParams(**{k: forest.meta[k] for k in ("shards", "k", "max_depth", "min_leaf", "iterations",
                                                       "seed")})
    path = tempfile.mkdtemp(prefix="vicinity-forest-reuse-")
    FO.build_forest(emb, "vec_id", "cosine", p, path)
    again = FO.load_or_build_forest(emb, "vec_id", "cosine", p, path)
    assert again.meta["rows"] == 500
    other = FO.load_or_build_forest(emb.limit(100), "vec_id", "cosine", p, path)
    assert other.meta["rows"] == 100  # stale fingerprint -> rebuilt


@pytest.mark.parametrize("metric", METRICS)
def test_arrow_scan_equals_native(spark, metric):
    from vicinity.plans.arrow_scan import arrow_top_k
    t = T.scaled_embeddings(spark, SF001)
    q = queries_by_id(t, "vec_id", [4, 40])
    a = arrow_top_k(t, q, metric, 7, "vec_id").orderBy("query_id", "rank").collect()
    b = exact_top_k(t, q, metric, 7, "vec_id").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in a] == [(r.query_id, r.vec_id) for r in b]
    assert [r.similarity_score for r in a] == pytest.approx([r.similarity_score for r in b], rel=1e-9)


def test_arrow_scan_edge_rows(spark):
    from vicinity.plans.arrow_scan import arrow_top_k
    from vicinity.sources.queries import literal_query
    rows = [(1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (7, [1.0, 1.0])]
    t = spark.createDataFrame(rows, "id long, vec array<double>")
    cos = arrow_top_k(t, literal_query(spark, [1.0, 1.0]), "cosine", 10, "id").collect()
    assert {r.id: r.similarity_score for r in cos} == pytest.approx({1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0, 7: 1.0})
    assert [r.id for r in sorted(cos, key=lambda r: r.rank)][:2] == [3, 7]
    euc = arrow_top_k(t, literal_query(spark, [1.0, 1.0]), "euclidean_sim", 10, "id")
    assert sorted(r.id for r in euc.collect()) == [3, 4, 7]


def test_hot_cluster_stays_whole(spark, emb):
    """A third of the rows carry one identical vector: one node/leaf is hot and
    k-means sees duplicate seeds.  Every row must still land in exactly one
    leaf, counts must add up, and search must return the hot rows in full
    order (ties broken by id)."""
    hot = emb.withColumn("vec", F.when(F.col("vec_id") % 3 == 0, F.array([F.lit(0.5)] * 64))
                         .otherwise(F.col("vec")))
    p = FO.ForestParams(shards=2, k=3, max_depth=2, min_leaf=10, iterations=2, seed=5)
    f = FO.build_forest(hot, "vec_id", "euclidean_sim", p, tempfile.mkdtemp(prefix="vicinity-hot-"))
    m = f.members
    assert m.count() == 500 and m.select("vec_id").distinct().count() == 500
    n = f.nodes
    kids = n.filter(F.col("parent_id").isNotNull()).groupBy("shard", F.col("parent_id").alias("node_id")).agg(
        F.sum("member_count").alias("kids"))
    assert n.join(kids, ["shard", "node_id"]).filter(F.col("kids") != F.col("member_count")).count() == 0
    from vicinity.sources.queries import literal_query
    r = exact_top_k(hot, literal_query(spark, [0.5] * 64), "euclidean_sim", 20, "vec_id", info=QueryInfo(1, 64))
    got = [x.vec_id for x in r.orderBy("rank").collect()]
    assert got == sorted(i for i in range(0, 500, 3))[:20]


def test_arrow_scan_tells_close_vectors_apart(spark):
    from vicinity.plans.arrow_scan import arrow_top_k
    t = spark.createDataFrame([(i, [1e6 + i * 1e-3, 1e6]) for i in range(1, 6)], "id long, vec array<double>")
    q = spark.createDataFrame([("a", [1e6, 1e6]), ("b", [1e6 + 5e-3, 1e6])], "query_id string, q array<double>")
    a = arrow_top_k(t, q, "euclidean_sim", 3, "id").orderBy("query_id", "rank").collect()
    b = exact_top_k(t, q, "euclidean_sim", 3, "id").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in a] == [(r.query_id, r.id) for r in b] == [
        ("a", 1), ("a", 2), ("a", 3), ("b", 5), ("b", 4), ("b", 3)]
    assert [r.similarity_score for r in a] == pytest.approx([r.similarity_score for r in b], rel=1e-12)


P_SMALL = FO.ForestParams(shards=2, k=3, max_depth=2, min_leaf=20, iterations=2, seed=1)


def small_forest(spark, table, metric, path, seed=1, force=False):
    p = FO.ForestParams(P_SMALL.shards, P_SMALL.k, P_SMALL.max_depth, P_SMALL.min_leaf, P_SMALL.iterations, seed)
    return FO.load_or_build_forest(table, "vec_id", metric, p, path, force)


def test_representatives_belong_to_their_build(spark, emb):
    path = tempfile.mkdtemp(prefix="vicinity-stale-")
    for metric in ("cosine", "manhattan_sim"):
        small_forest(spark, emb, metric, path, 1)
    small_forest(spark, emb, "cosine", path, 99)
    f = small_forest(spark, emb, "manhattan_sim", path, 99)
    reps = f.nodes.filter("rep_id IS NOT NULL").select("shard", "node_id", "rep_id")
    inside = reps.join(f.members, (reps.rep_id == f.members.vec_id) & (reps.shard == f.members.shard)
                       & (F.concat("leaf_id", F.lit("_")).startswith(F.concat("node_id", F.lit("_")))))
    assert reps.count() == inside.count() > 0


def test_an_interrupted_build_leaves_the_old_one(spark, emb, monkeypatch):
    path = tempfile.mkdtemp(prefix="vicinity-crash-")
    q = queries_by_id(emb, "vec_id", 7)
    before = ids(FO.forest_top_k(small_forest(spark, emb, "cosine", path), q, "cosine", 5))
    monkeypatch.setattr(FO, "_seeds", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        small_forest(spark, emb, "cosine", path, force=True)
    monkeypatch.undo()
    f = FO.load_forest(spark, path, "cosine")
    assert f.members.count() == 500 and ids(FO.forest_top_k(f, q, "cosine", 5)) == before


def test_other_vectors_under_the_same_ids_make_a_new_index(spark, emb):
    path = tempfile.mkdtemp(prefix="vicinity-content-")
    first = small_forest(spark, emb, "cosine", path)
    turned = emb.withColumn("vec", F.transform("vec", lambda x: -x))
    second = small_forest(spark, turned, "cosine", path)
    assert first.meta["build"] != second.meta["build"]
    assert small_forest(spark, turned, "cosine", path).meta["build"] == second.meta["build"]
    q = queries_by_id(turned, "vec_id", 7)
    assert {r.vec_id: r.similarity_score for r in FO.forest_top_k(second, q, "cosine", 1).collect()} == pytest.approx({7: 1.0})


def test_forest_queries_in_blocks_give_the_same(spark, emb, forest, monkeypatch):
    q = queries_by_id(emb, "vec_id", list(range(12)))
    whole = FO.forest_top_k(forest, q, "cosine", 4).collect()
    monkeypatch.setattr(FO, "LEAF_KEYS_PER_BLOCK", 20)
    assert sorted(FO.forest_top_k(forest, q, "cosine", 4).collect()) == sorted(whole)


def test_profiles_in_blocks_of_references_give_the_same(spark, emb):
    from vicinity.plans.transform import select_references, to_similarity_space
    refs = select_references(emb, "vec_id", "cosine", TransformParams(n_refs=5, sample_size=60, seed=1))
    whole = to_similarity_space(emb, refs, "cosine", "vec_id").collect()
    assert sorted(to_similarity_space(emb, refs, "cosine", "vec_id", limit_bytes=1200).collect()) == sorted(whole)


def test_a_stored_table_of_another_type_is_not_reused(spark, tmp_path):
    from vicinity.sources.store import load_or_materialise
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "not a vector")], "id long, vec string").write.parquet(path)
    built = spark.createDataFrame([(1, [1.0])], "id long, vec array<double>")
    assert load_or_materialise(spark, path, lambda: built, ["id", "vec"]).first()["vec"] == [1.0]
