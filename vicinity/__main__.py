"""Command-line search job: ``python -m vicinity --search-mode absolute ...``.

Loads (or generates and stores) a vector table, builds the query, runs one
of the three modes and prints the ranked report.  All work is the DataFrame
plans of ``vicinity.plans``; the session comes from ``spark-submit`` or,
when run directly, a local one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vicinity.functions.vectors import VEC, feature_columns, to_vector_table
from vicinity.operators.topk import ranked_report
from vicinity.plans import forest as FO
from vicinity.plans.modes import MODES, SearchOptions, search
from vicinity.plans.transform import TransformParams
from vicinity.sources.generate import uniform_vectors
from vicinity.sources.queries import constant_query, queries_by_id, seeded_query
from vicinity.sources.store import load_or_materialise


# Option names and defaults are fixed values: they must be those of the jobs that this command replaces.
def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="vicinity", description="Vector similarity search on Spark")
    p.add_argument("--data-path", required=True, help="Parquet vector table (read, or written if generated)")
    p.add_argument("--id-column-name", default="row_id")
    p.add_argument("--vector-column", default=None,
                   help="array column holding the vector; default: wide columns col_0..col_{K-1}")
    p.add_argument("--num-data-rows", type=int, default=10000, help="rows to generate when the table is absent")
    p.add_argument("--num-data-cols", type=int, default=100, help="dimensions to generate")
    p.add_argument("--num-partitions", type=int, default=None)
    p.add_argument("--regenerate-data", action="store_true")
    p.add_argument("--search-mode", choices=MODES, default="absolute")
    p.add_argument("--engine", choices=["native", "arrow"], default="native",
                   help="scorer for the absolute mode")
    p.add_argument("--top-x-results", type=int, default=5)
    p.add_argument("--similarity-metric", default="cosine")
    p.add_argument("--query-vector-seed", type=int, default=None, help="seeded uniform query; default 0.5s")
    p.add_argument("--query-id", default=None, help="use this row of the table as the query")
    p.add_argument("--num-references-N", type=int, default=20)
    p.add_argument("--ref-selection-sample-size", type=int, default=10000)
    p.add_argument("--use-median-for-center", action="store_true")
    p.add_argument("--save-transformed-data-path", default=None)
    p.add_argument("--index-path", default=None, help="forest tables (default: <data-path>_forest)")
    p.add_argument("--force-rebuild-tree", action="store_true")
    p.add_argument("--num-shards", type=int, default=4)
    p.add_argument("--k-per-level", type=int, default=5)
    p.add_argument("--max-depth", type=int, default=3)
    p.add_argument("--min-leaf-size", type=int, default=100)
    p.add_argument("--kmeans-iterations", type=int, default=100)
    p.add_argument("--kmeans-seed", type=int, default=42)
    p.add_argument("--kmeans-seeding", choices=("hash", "spread"), default="hash")
    p.add_argument("--kmeans-batch-size", type=int, default=0, help="rows of a mini-batch; 0: all rows in every iteration")
    p.add_argument("--kmeans-batch-steps", type=int, default=20)
    p.add_argument("--kmeans-starts", type=int, default=3, help="starts of the mini-batch clusterer")
    p.add_argument("--kmeans-engine", choices=("native", "arrow"), default="native")
    return p.parse_args(argv)


def run(spark: SparkSession, a: argparse.Namespace):
    gen = lambda: uniform_vectors(spark, a.num_data_rows, a.num_data_cols, a.id_column_name,
                                  a.num_partitions, wide=a.vector_column is None)
    required = [a.id_column_name] + ([a.vector_column] if a.vector_column else
                                     ([f"col_{a.num_data_cols - 1}"] if a.num_data_cols > 0 else []))
    raw = load_or_materialise(spark, a.data_path, gen, required, force=a.regenerate_data)
    if a.vector_column:
        table = to_vector_table(raw, a.id_column_name, vec_col=a.vector_column)
    else:
        table = to_vector_table(raw, a.id_column_name, feature_cols=feature_columns(raw))
    dim = len(feature_columns(raw)) if not a.vector_column else None

    if a.query_id is not None:
        qid = int(a.query_id) if str(a.query_id).lstrip("-").isdigit() else a.query_id
        queries = queries_by_id(table, a.id_column_name, qid)
    else:
        if dim is None:
            dim = table.select(F.size(VEC).alias("k")).first()["k"]
        queries = (seeded_query(spark, dim, a.query_vector_seed) if a.query_vector_seed is not None
                   else constant_query(spark, dim))
    opts = SearchOptions(
        transform=TransformParams(a.num_references_N, a.ref_selection_sample_size, 42, a.use_median_for_center),
        forest=FO.ForestParams(a.num_shards, a.k_per_level, a.max_depth, a.min_leaf_size, a.kmeans_iterations,
                               a.kmeans_seed, a.kmeans_seeding, a.kmeans_batch_size, a.kmeans_batch_steps, a.kmeans_starts, a.kmeans_engine),
        index_path=a.index_path or a.data_path.rstrip("/") + "_forest",
        force_rebuild=a.force_rebuild_tree,
        space_path=a.save_transformed_data_path,
        engine=a.engine)
    result = search(table, queries, a.search_mode, a.similarity_metric, a.top_x_results, a.id_column_name,
                    opts, one_query=True)
    return ranked_report(result).orderBy("query_id", "rank")


def main(argv=None) -> None:
    a = parse_args(argv)
    spark = SparkSession.getActiveSession()
    if spark is None:
        from vicinity.session import local_session
        spark = local_session()
    run(spark, a).show(a.top_x_results * 10, truncate=False)


if __name__ == "__main__":
    main()
