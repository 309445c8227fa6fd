"""Parquet sink and load-or-materialise with a schema check.

Existence is decided by trying to read through Spark (any Hadoop-compatible
file system), never by a local ``os.path`` test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a table this engine wrote; with its schema, an empty table (no
    data files, e.g. a partitioned write of no rows) reads back as empty."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def try_read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    try:
        return read_parquet(spark, path, schema)
    except AnalysisException:
        return None


def load_or_materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                        required_cols: list[str], force: bool = False) -> DataFrame:
    """Reuse the table at ``path`` if it exists and its ``required_cols`` have
    the types that ``build`` would give them; otherwise (or when ``force``)
    build it, write it and read it back."""
    built = build()
    if not force:
        df = try_read(spark, path)
        if df is not None and all(c in df.columns and df.schema[c].dataType == built.schema[c].dataType
                                  for c in required_cols):
            return df
    write_parquet(built, path)
    return read_parquet(spark, path, built.schema)
