"""Physical-plan shape checks: the properties the scale design relies on."""

from pyspark.sql import functions as F

from conftest import SF001
from vicinity.plans import forest as FO
from vicinity.plans.exact import QueryInfo, exact_top_k
from vicinity.plans.transform import to_similarity_space
from vicinity.sources import tables as T
from vicinity.sources.queries import queries_by_id


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_single_query_plan(spark):
    t = T.embeddings(spark, SF001)
    p = plan(exact_top_k(t, queries_by_id(t, "vec_id", 3), "cosine", 5, "vec_id", info=QueryInfo(1, 64)))
    assert "BroadcastNestedLoopJoin" in p and "TakeOrderedAndProject" in p
    assert "EqualTo(vec_id,3)" in p                       # query-by-id filter reaches the scan
    assert "Exchange hashpartitioning" not in p           # no shuffle of scored rows
    # the score is computed once in a projection, not (again) as a join condition
    join_lines = [ln.strip() for ln in p.splitlines() if "BroadcastNestedLoopJoin" in ln]
    assert join_lines and all(ln.endswith("Cross") for ln in join_lines)


def test_exact_multi_query_plan_limits_before_shuffle(spark):
    t = T.embeddings(spark, SF001)
    p = plan(exact_top_k(t, queries_by_id(t, "vec_id", [1, 2]), "euclidean_sim", 5, "vec_id"))
    assert "WindowGroupLimit" in p and "Partial" in p
    part = p.index("Partial")
    assert p.index("Exchange") < part                     # partial limit sits below the exchange


def test_similarity_space_has_no_shuffle(spark):
    t = T.embeddings(spark, SF001)
    refs = t.limit(3).select(F.monotonically_increasing_id().cast("int").alias("ref_no"), "vec_id", "vec")
    sp = to_similarity_space(t, refs, "manhattan_sim", "vec_id")
    p = plan(sp)
    scan_side = p.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in scan_side


def test_lloyd_step_aggregates_partially(spark):
    t = T.embeddings(spark, SF001)
    rows = t.withColumn(FO.SHARD, FO.shard_of("vec_id", 2)).withColumn(FO.NODE, F.lit(FO.ROOT))
    from vicinity.operators.centers import mean_vector
    step = mean_vector(FO._assign(rows, FO._pack(FO._seeds(rows, "vec_id", 3, 42, 2)), "vec_id", 2, 3, 64),
                       "vec", [FO.SHARD, FO.NODE, FO.CHILD])
    p = plan(step)
    assert "BroadcastHashJoin" in p and "partial_aggregate_metrics" in p


def sorted_columns(p: str) -> list[str]:
    """Output columns of what each Sort reads."""
    lines = p.splitlines()
    return [lines[i + 1] for i, ln in enumerate(lines[:-1]) if " Sort " in ln or ln.strip().startswith("Sort ")]


def test_index_steps_neither_shuffle_nor_sort_vectors(spark, monkeypatch):
    """With the broadcast limit at 1 KiB the node tables go in batches of shards."""
    monkeypatch.setattr(FO, "MAX_BROADCAST_BYTES", 1024)
    t = T.embeddings(spark, SF001)
    rows = t.withColumn(FO.SHARD, FO.shard_of("vec_id", 4)).withColumn(FO.NODE, F.lit(FO.ROOT))
    seeds = FO._seeds(rows, "vec_id", 3, 42, 4)
    assigned = FO._assign(rows, FO._pack(seeds), "vec_id", 4, 3, 64)
    for df in (seeds, assigned):
        p = plan(df)
        assert "CartesianProduct" not in p and "SortMergeJoin" not in p
        assert not any("vec#" in line for line in sorted_columns(p))
    assert plan(assigned).count("BroadcastHashJoin") > 4
    assert assigned.count() == 500


def test_exact_search_takes_the_row_norm_below_the_join(spark):
    t = T.embeddings(spark, SF001)
    p = plan(exact_top_k(t, queries_by_id(t, "vec_id", [1, 2]), "cosine", 5, "vec_id"))
    assert "_v_norm" in p.split("BroadcastNestedLoopJoin")[1]
