"""Best-first descent of the forest: all leaves give the exact answer, more leaves never lose hits."""

import uuid

import pytest
from pyspark.sql import functions as F

from vicinity.plans import forest as FO
from vicinity.plans.exact import exact_top_k
from vicinity.session import scratch_path
from vicinity.sources.queries import queries_by_id
from vicinity.sources.tables import embeddings

SF = "/root/testdata/sf0.01"
PARAMS = FO.ForestParams(shards=2, k=4, max_depth=2, min_leaf=30, iterations=2, seed=3)


@pytest.fixture(scope="module")
def built(spark):
    table = embeddings(spark, SF)
    forest = FO.build_forest(table, "vec_id", "euclidean_sim", PARAMS, scratch_path(spark, f"best-{uuid.uuid4().hex}"))
    return table, forest, queries_by_id(table, "vec_id", [1, 5, 9])


def hits(df):
    return {(r[0], r[2]) for r in df.collect()}


def test_all_leaves_are_exact(built):
    table, forest, q = built
    n = forest.nodes.filter(FO.IS_LEAF).count()
    assert hits(FO.forest_top_k(forest, q, "euclidean_sim", 7, n_leaves=n)) == hits(exact_top_k(table, q, "euclidean_sim", 7, "vec_id"))
    read = FO.rows_read(forest, q, "euclidean_sim", n).collect()
    assert len(read) == 3 and all(abs(r.share - 1) < 1e-9 for r in read)


def test_greedy_leaves_lose_nothing(built):
    _, forest, q = built
    greedy = {(r.query_id, r.shard, r.leaf_id) for r in FO.descend(forest, q, "euclidean_sim").collect()}
    best = FO.descend_best_first(forest, q, "euclidean_sim", 5)
    assert greedy == {(r.query_id, r.shard, r.leaf_id) for r in best.filter(F.col("loss") == 0).collect()}
    few = {(r.query_id, r.shard, r.leaf_id) for r in FO.descend_best_first(forest, q, "euclidean_sim", 3).collect()}
    assert few <= {(r.query_id, r.shard, r.leaf_id) for r in best.collect()} and len(few) == 9


def test_number_of_leaves_is_checked(built):
    with pytest.raises(ValueError):
        FO.forest_top_k(built[1], built[2], "cosine", 3, n_leaves=0)
