"""Benchmark: the three search modes over the driver tables and at the
reference's default sizes.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8) and prints ONE JSON line:
``{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.

Each timing is the wall time of materialising the result (``collect`` of the
top-k rows) after one untimed warm-up query.  Index builds are timed apart
from searches.  Three tables are searched in all modes: the driver's
embeddings, and uniform tables of 10,000 x 100 and 100,000 x 100 (generated,
untimed).  Approximate modes report recall@5 against the exact answer over
100 queries (``recall_at_5``, not part of the total).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from vicinity import registry as R  # noqa: E402
from vicinity.functions.metrics import METRIC_NAMES  # noqa: E402
from vicinity.functions.vectors import VEC  # noqa: E402
from vicinity.operators.sampling import sample_hash  # noqa: E402
from vicinity.plans import forest as FO  # noqa: E402
from vicinity.plans.arrow_scan import arrow_top_k  # noqa: E402
from vicinity.plans.exact import QueryInfo, exact_top_k  # noqa: E402
from vicinity.plans.transform import TransformParams, build_similarity_space, transform_top_k  # noqa: E402
from vicinity.session import local_session, scratch_path  # noqa: E402
from vicinity.sources import tables as T  # noqa: E402
from vicinity.sources.generate import uniform_vectors  # noqa: E402
from vicinity.sources.queries import Q, QID, queries_by_id  # noqa: E402

SHORT = R.SHORT
K = 5
ONE = QueryInfo(1, 0)
RECALL_QUERIES = 100
# Reference defaults (k=5, N=20, sample 5000, 5 children per level, depth 3,
# min leaf 50); one tree per shard, 4 shards as for its 4 default partitions.
# Ten Lloyd iterations a level, as in earlier rounds, so that builds compare.
TP = TransformParams(n_refs=20, sample_size=5000, seed=42)
FP = FO.ForestParams(shards=4, k=5, max_depth=3, min_leaf=50, iterations=10, seed=42)


def timed(fn):
    t0 = time.perf_counter()
    rows = fn()
    return time.perf_counter() - t0, rows


def recall(found, exact) -> float:
    """Share of the exact results found, over all queries."""
    got = {(r[QID], r[2]) for r in found}
    want = {(r[QID], r[2]) for r in exact}
    return round(len(got & want) / max(1, len(want)), 4)


def modes_on(spark, name, table, id_col, metrics, out, recalls) -> None:
    """All modes on one table; builds apart from searches."""
    one = queries_by_id(table, id_col, 7)
    many = table.orderBy(sample_hash(id_col, 1)).limit(RECALL_QUERIES).select(F.col(id_col).alias(QID), F.col(VEC).alias(Q))
    path = scratch_path(spark, f"bench-{name}-{time.time_ns()}")
    out[f"forest_build_{name}"], meta = timed(lambda: FO.build_clustering(table, id_col, FP, f"{path}/forest"))
    FO.publish(spark, f"{path}/forest", meta)
    for metric in metrics:
        tag = f"{name}_{SHORT[metric]}"
        out[f"exact_{tag}"], _ = timed(lambda: exact_top_k(table, one, metric, K, id_col, info=ONE).collect())
        out[f"exact_100_{tag}"], exact = timed(lambda: exact_top_k(table, many, metric, K, id_col).collect())
        dt, (space, refs) = timed(lambda: build_similarity_space(table, id_col, metric, TP, f"{path}/space-{metric}"))
        out[f"transform_build_{tag}"] = dt
        out[f"transform_{tag}"], _ = timed(
            lambda: transform_top_k(table, one, metric, K, id_col, TP, one_query=True, space=space, refs=refs).collect())
        recalls[f"transform_{tag}"] = recall(
            transform_top_k(table, many, metric, K, id_col, TP, space=space, refs=refs).collect(), exact)
        out[f"forest_reps_{tag}"], _ = timed(lambda: FO.build_representatives(spark, f"{path}/forest", meta, metric))
        forest = FO.load_forest(spark, f"{path}/forest", metric)
        out[f"forest_{tag}"], _ = timed(lambda: FO.forest_top_k(forest, one, metric, K, ONE).collect())
        recalls[f"forest_{tag}"] = recall(FO.forest_top_k(forest, many, metric, K).collect(), exact)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cpus, shuffle_partitions=parts, app="vicinity-bench")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    out: dict[str, float] = {}
    recalls: dict[str, float] = {}

    emb = T.embeddings(spark, sf_dir)
    exact_top_k(emb, queries_by_id(emb, "vec_id", 7), "cosine", K, "vec_id", info=ONE).collect()  # warm-up (JVM, codegen)
    modes_on(spark, "emb", emb, "vec_id", METRIC_NAMES, out, recalls)
    orders = T.order_vectors(spark, sf_dir)
    out["exact_orders_euclidean"], _ = timed(lambda: exact_top_k(
        orders, R.min_id_query(orders, "l_orderkey"), "euclidean_sim", K, "l_orderkey", info=ONE).collect())

    for rows, name in ((10_000, "1e4x100"), (100_000, "1e5x100")):
        path = scratch_path(spark, f"bench-uniform-{name}-{time.time_ns()}")
        uniform_vectors(spark, rows, 100, "row_id", partitions=parts).write.parquet(path)
        uni = spark.read.parquet(path)
        modes_on(spark, name, uni, "row_id", ["euclidean_sim"], out, recalls)
    wide = scratch_path(spark, f"bench-uniform-wide-{time.time_ns()}")
    uniform_vectors(spark, 100_000, 250, "row_id", partitions=parts).write.parquet(wide)
    wide = spark.read.parquet(wide)
    one = queries_by_id(wide, "row_id", 7)
    out["exact_1e5x250_cosine"], _ = timed(lambda: exact_top_k(wide, one, "cosine", K, "row_id", info=ONE).collect())
    arrow_top_k(wide, one, "cosine", K, "row_id").collect()  # Python worker start
    out["arrow_1e5x250_cosine"], _ = timed(lambda: arrow_top_k(wide, one, "cosine", K, "row_id").collect())

    print(json.dumps({"metric": "total_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in out.items()}, "recall_at_5": recalls, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
