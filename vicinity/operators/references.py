"""Diverse reference selection.

First reference: the sample row most similar to the sample's center.  Each
next reference: among rows not yet chosen, the one *least* similar to the
previously chosen reference only.  NaN/null scores are ignored; ties go to
the lowest id.  Each step is one small job over the (checkpointed, bounded)
sample; only the chosen ids (at most n) pass through the driver.
"""

from __future__ import annotations

import json

from pyspark import StorageLevel

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.functions import metrics as M
from vicinity.functions.vectors import VEC
from vicinity.operators.centers import CENTER, center_vector
from vicinity.operators.topk import rank_key

REF_NO = "ref_no"
_S = "_score"


def vector_literal(values) -> str:
    """SQL text of a constant ``array<double>`` (one JSON literal, folded by
    the optimizer) -- used for single vectors of K numbers, never for tables."""
    return f"from_json('{json.dumps([float(v) for v in values])}', 'array<double>')"


def _pick(df: DataFrame, target: str, metric: str, id_col: str, vec_col: str, best: bool):
    """``(id, vec)`` of the row with the best (or worst) valid score against
    ``target``; ties -> lowest id; None if no score is valid.  NaN becomes
    null and sorts last, so no filter is needed.  One job."""
    key = rank_key(M.score(metric, vec_col, target))
    order = key.desc_nulls_last() if best else key.asc_nulls_last()
    rows = df.select(id_col, vec_col, key.alias("_k")).orderBy(order, F.col(id_col).asc()).take(1)
    if not rows or rows[0]["_k"] is None:
        return None
    return rows[0][id_col], rows[0][vec_col]


def nearest_to(df: DataFrame, target: DataFrame, target_col: str, metric: str, id_col: str,
               vec_col: str = VEC) -> DataFrame:
    """Rows of ``df`` scored against the single vector in ``target`` (1 row)."""
    t = F.broadcast(target.select(F.col(target_col).alias("_t")))
    return df.crossJoin(t).select(*df.columns, M.score(metric, vec_col, "_t").alias(_S))


def diverse_references(sample: DataFrame, id_col: str, n: int, metric: str,
                       use_median: bool = False, vec_col: str = VEC) -> DataFrame:
    """``(ref_no, id, vec)`` for up to n references chosen from ``sample``.

    Each step is one job over the bounded sample; the previous reference's
    vector (K numbers) is carried as a constant, so the plan stays small.
    """
    metric = M.resolve_metric(metric)
    spark = sample.sparkSession
    id_type = sample.schema[id_col].dataType
    chosen: list = []
    # The sample is bounded; it is held in memory only while the loop runs
    # (lost blocks are recomputed from the sample's lineage).
    work = sample.select(id_col, vec_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if n > 0:
            c = center_vector(work, vec_col, use_median).first()
            if c is not None and c[CENTER] is not None:
                hit = _pick(work, vector_literal(c[CENTER]), metric, id_col, vec_col, best=True)
                if hit is not None:
                    chosen.append(hit)
        while 0 < len(chosen) < n:
            cand = work.filter(~F.col(id_col).isin([i for i, _ in chosen]))
            hit = _pick(cand, vector_literal(chosen[-1][1]), metric, id_col, vec_col, best=False)
            if hit is None:
                break
            chosen.append(hit)
    finally:
        work.unpersist()
    order = spark.createDataFrame([(i, rid) for i, (rid, _) in enumerate(chosen)],
                                  T.StructType([T.StructField(REF_NO, T.IntegerType(), False),
                                                T.StructField(id_col, id_type, False)]))
    return F.broadcast(order).join(sample.select(id_col, vec_col), id_col).select(REF_NO, id_col, vec_col)
