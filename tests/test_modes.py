"""Mode dispatcher and the command-line job."""

import tempfile

import pytest

from conftest import SF001
from vicinity.__main__ import parse_args, run
from vicinity.plans import forest as FO
from vicinity.plans.exact import QueryInfo, exact_top_k
from vicinity.plans.modes import SearchOptions, search
from vicinity.plans.transform import TransformParams
from vicinity.sources import tables as T
from vicinity.sources.queries import queries_by_id


def test_dispatch_matches_direct_calls(spark):
    t = T.embeddings(spark, SF001)
    q = queries_by_id(t, "vec_id", 11)
    direct = exact_top_k(t, q, "dot", 5, "vec_id", info=QueryInfo(1, 64)).collect()
    assert search(t, q, "absolute", "dot", 5, "vec_id", one_query=True).collect() == direct
    opts = SearchOptions(transform=TransformParams(4, 100, 3),
                         forest=FO.ForestParams(shards=2, k=3, max_depth=1, min_leaf=20, iterations=2),
                         index_path=tempfile.mkdtemp(prefix="vicinity-modes-"))
    assert search(t, q, "optimized_transform", "dot", 5, "vec_id", opts, one_query=True).count() == 5
    assert search(t, q, "hierarchical_kmeans", "dot", 5, "vec_id", opts, one_query=True).count() > 0
    with pytest.raises(ValueError):
        search(t, q, "brute", "dot", 5, "vec_id", one_query=True)


@pytest.mark.parametrize("mode", ["absolute", "optimized_transform", "hierarchical_kmeans"])
def test_cli_generates_and_searches(spark, mode, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("cli"))
    args = ["--data-path", f"{base}/vectors", "--num-data-rows", "300", "--num-data-cols", "8",
            "--num-partitions", "3", "--search-mode", mode, "--top-x-results", "4",
            "--similarity-metric", "euclidean_sim", "--query-vector-seed", "42",
            "--num-references-N", "3", "--ref-selection-sample-size", "50",
            "--num-shards", "2", "--k-per-level", "2", "--max-depth", "1", "--min-leaf-size", "10",
            "--kmeans-iterations", "2"]
    out = run(spark, parse_args(args)).collect()
    assert 0 < len(out) <= 4 and [r["rank"] for r in out] == list(range(1, len(out) + 1))
    assert all(r["score_text"] != "N/A" for r in out)
    # the stored table is reused on the second run (same ids)
    again = run(spark, parse_args(args + ["--query-id", str(out[0]["row_id"])])).collect()
    assert again[0]["row_id"] == out[0]["row_id"] or mode != "absolute"


def test_empty_inputs_give_empty_results(spark):
    empty = spark.createDataFrame([], "vec_id long, vec array<double>")
    t = T.embeddings(spark, SF001)
    q = queries_by_id(t, "vec_id", 3)
    opts = SearchOptions(transform=TransformParams(3, 50, 1),
                         forest=FO.ForestParams(shards=2, k=2, max_depth=1, min_leaf=5, iterations=1),
                         index_path=tempfile.mkdtemp(prefix="vicinity-empty-"))
    for mode in ("absolute", "optimized_transform", "hierarchical_kmeans"):
        assert search(empty, q, mode, "cosine", 3, "vec_id", opts, one_query=True).count() == 0
    no_queries = queries_by_id(t, "vec_id", -1)
    assert search(t, no_queries, "absolute", "cosine", 3, "vec_id").count() == 0


def test_engines_agree(spark):
    t = T.embeddings(spark, SF001)
    q = queries_by_id(t, "vec_id", 21)
    native, arrow = ([r.vec_id for r in search(t, q, "absolute", "manhattan", 6, "vec_id", SearchOptions(engine=e), one_query=True)
                      .orderBy("rank").collect()] for e in ("native", "arrow"))
    assert native == arrow
    with pytest.raises(ValueError):
        search(t, q, "absolute", "manhattan", 6, "vec_id", SearchOptions(engine="gpu"))


def test_stored_index_can_be_searched_without_reading_the_table(spark):
    t = T.embeddings(spark, SF001)
    q = queries_by_id(t, "vec_id", 11)
    opts = SearchOptions(forest=FO.ForestParams(shards=2, k=3, max_depth=1, min_leaf=20, iterations=2),
                         index_path=tempfile.mkdtemp(prefix="vicinity-modes-"))
    first = search(t, q, "hierarchical_kmeans", "cosine", 5, "vec_id", opts).collect()
    opts.verify_index = False
    other = t.limit(3)  # would be refused as stale if it were looked at
    assert sorted(search(other, queries_by_id(t, "vec_id", 11), "hierarchical_kmeans", "cosine", 5, "vec_id", opts).collect()) == sorted(first)


def test_a_bad_request_does_not_stop_the_stream(spark, tmp_path):
    from vicinity.streaming.query_stream import REQUEST_SCHEMA, start_search_stream
    t = T.embeddings(spark, SF001)
    good = t.filter("vec_id IN (1, 2)").selectExpr("vec_id AS query_id", "vec AS q", "'cosine' AS metric")
    bad = spark.createDataFrame([(50, [1.0, 2.0], "cosine"), (51, [1.0] * 64, "nope")], REQUEST_SCHEMA)
    good.unionByName(bad).repartition(4, "query_id").write.parquet(f"{tmp_path}/requests")
    reqs = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/requests")
    s = start_search_stream(reqs, t, 3, "vec_id", f"{tmp_path}/out", f"{tmp_path}/ckpt", available_now=True)
    s.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.query_id for r in got if r.error is None) == [1, 1, 1, 2, 2, 2]
    assert sorted(r.query_id for r in got if r.error) == [50, 51]


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace
    from vicinity.session import checkpoint_dir, is_local_master
    assert is_local_master("local[8]") and is_local_master("local") and not is_local_master("local-cluster[3,2,1000]")
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: {})
    with pytest.raises(ValueError, match="shared folder"):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf={}))
