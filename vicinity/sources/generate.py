"""Uniform random vector tables (load-test source).

Feature ``i`` is ``rand(seed=i)``; values depend on the partitioning, as with
any seeded ``rand`` in Spark, so these tables are for volume, not oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions.vectors import VEC


def uniform_vectors(spark: SparkSession, rows: int, cols: int, id_col: str = "row_id",
                    partitions: int | None = None, wide: bool = False) -> DataFrame:
    """``rows`` x ``cols`` uniform [0,1) table; ``cols == 0`` gives ids only."""
    base = spark.range(0, rows, 1, partitions).withColumnRenamed("id", id_col)
    return _with_uniform(base, id_col, cols, wide)


def uniform_like(df: DataFrame, id_col: str, cols: int, wide: bool = False) -> DataFrame:
    """A uniform random vector for every id of an existing table."""
    return _with_uniform(df.select(id_col), id_col, cols, wide)


def _with_uniform(base: DataFrame, id_col: str, cols: int, wide: bool) -> DataFrame:
    feats = [F.rand(seed=i) for i in range(cols)]
    if cols == 0:
        return base.select(id_col) if wide else base.select(id_col, F.array().cast("array<double>").alias(VEC))
    if wide:
        return base.select(id_col, *[f.alias(f"col_{i}") for i, f in enumerate(feats)])
    return base.select(id_col, F.array(*feats).alias(VEC))
