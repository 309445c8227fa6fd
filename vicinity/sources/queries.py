"""Query-vector sources.  A query table is ``DataFrame[query_id, q array<double>]``.

Literal queries are one-row tables built on the driver from at most K numbers;
queries by id are filters on the vector table (pushed into the scan).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.functions.vectors import VEC

QID = "query_id"
Q = "q"

_QSCHEMA = T.StructType([
    T.StructField(QID, T.LongType(), False),
    T.StructField(Q, T.ArrayType(T.DoubleType()), True),
])


def literal_query(spark: SparkSession, values, query_id: int = 0) -> DataFrame:
    vals = [float(v) for v in values]
    return spark.createDataFrame([(int(query_id), vals)], _QSCHEMA)


def constant_query(spark: SparkSession, dim: int, value: float = 0.5, query_id: int = 0) -> DataFrame:
    """``dim`` x 0.5 (the reference's default query); dim <= 0 gives an empty vector."""
    return literal_query(spark, [value] * max(dim, 0), query_id)


def seeded_query(spark: SparkSession, dim: int, seed: int, query_id: int = 0) -> DataFrame:
    """Uniform [0,1) query from NumPy's legacy ``RandomState(seed).rand(dim)``."""
    if dim <= 0:
        return literal_query(spark, [], query_id)
    return literal_query(spark, np.random.RandomState(seed).rand(dim).tolist(), query_id)


def queries_by_id(table: DataFrame, id_col: str, ids, vec_col: str = VEC) -> DataFrame:
    """Rows of the vector table used as queries; ``query_id`` is the row id."""
    ids = list(ids) if isinstance(ids, (list, tuple, set)) else [ids]
    return table.filter(F.col(id_col).isin(ids)).select(F.col(id_col).alias(QID), F.col(vec_col).alias(Q))


def queries_from_table(df: DataFrame, qid_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(qid_col).alias(QID), F.col(vec_col).cast("array<double>").alias(Q))
