"""Parquet vector scans and the vector views derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions.vectors import VEC, as_double_array, to_vector_table


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_vectors(spark: SparkSession, path: str, id_col: str, vec_col: str | None = None,
                 feature_cols: list[str] | None = None) -> DataFrame:
    """Parquet vector scan adapted to ``(id, vec array<double>)``.  Only the id
    and the feature columns reach the scan's ReadSchema."""
    return to_vector_table(spark.read.parquet(path), id_col, vec_col, feature_cols)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, vec)`` from the ``embeddings`` table (float -> double)."""
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", as_double_array("embedding").alias(VEC))


def part_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(p_partkey, vec=[p_size, p_retailprice])``: 2-dim, unnormalised."""
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias(VEC))


def order_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_orderkey, vec=[sum qty, sum price, avg discount, avg tax])`` per order.

    One hash aggregate with map-side partial aggregation; the shuffle carries
    one partial row per order per input partition.
    """
    li = read_table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.array(F.sum("l_quantity"), F.sum("l_extendedprice"),
                F.avg("l_discount"), F.avg("l_tax")).alias(VEC))


def scaled_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with every element scaled by ``1 + label`` (unnormalised)."""
    e = read_table(spark, sf_dir, "embeddings")
    scale = (F.col("label") + 1).cast("double")
    return e.select("vec_id", F.transform(as_double_array("embedding"), lambda x: x * scale).alias(VEC))
