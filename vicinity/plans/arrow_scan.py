"""Opt-in vectorised exact top-k for wide vectors (``mapInArrow`` + NumPy).

The native plan (``plans.exact``) evaluates the metric with interpreted
higher-order functions, element by element.  For vectors in the hundreds or
thousands of dimensions a batch matrix product is faster, so this variant
scores each Arrow batch (rows x K) against the query matrix (queries x K)
with NumPy inside the task.  Spark still partitions the table and merges
the results: each task emits only its per-query candidates (the k best plus
any rows tied with the k-th score, so the id tie-break stays exact), and the
same NaN-safe window top-k as the native plan picks the final k.

Rules are the native ones: cosine clamps row norms to 1e-9, a near-zero
query scores 0 and NaN/null becomes 0; the other metrics drop rows with
null/NaN elements; an empty query against features gives nothing; a row of
another length fails the task.  Sums may round differently from the native
left-to-right order (last-ulp differences).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.functions import metrics as M
from vicinity.functions.vectors import VEC
from vicinity.operators.broadcast import broadcast_blocks
from vicinity.operators.topk import SCORE, top_k, validate_k
from vicinity.plans.exact import query_info
from vicinity.sources.queries import Q, QID


# Task-side helpers below use only NumPy / PyArrow and this module's own
# globals; the module is pickled by value, so executors need no copy of the
# package installed.
_EPS = M.EPS


def _batch_matrix(vecs: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x dim float64 matrix with NaN for null elements, row-valid mask)."""
    n = len(vecs)
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    present = np.asarray(vecs.is_valid())
    lengths = np.asarray(vecs.value_lengths().fill_null(dim))
    bad = present & (lengths != dim)
    if bad.any():
        raise ValueError(f"vector dimension mismatch: expected {dim}, got {int(lengths[bad][0])}")
    mat = np.full((n, dim), np.nan)
    if dim and present.any():
        idx = np.nonzero(present)[0]
        values = vecs.take(pa.array(idx)).flatten()
        mat[idx] = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(idx), dim)
    return mat, present


def _scores(metric: str, X: np.ndarray, Qm: np.ndarray, present: np.ndarray) -> np.ndarray:
    """rows x queries score matrix under the engine's rules (NaN = no result)."""
    eps = _EPS
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        if metric == "cosine":
            qn = np.linalg.norm(Qm, axis=1)
            rn = np.maximum(np.sqrt(np.einsum("ij,ij->i", X, X)), eps)
            s = (X @ Qm.T) / (rn[:, None] * np.maximum(qn, eps)[None, :])
            s = np.nan_to_num(s, nan=0.0, posinf=np.inf, neginf=-np.inf)
            s[:, qn < eps] = 0.0
            s[~present, :] = 0.0
            return s
        if metric == "dot_product":
            return X @ Qm.T
        # Distances are taken of the differences themselves, one query at a time: the expanded
        # square would cancel for close vectors, and memory stays at rows x K.
        out = np.empty((X.shape[0], Qm.shape[0]))
        for j in range(Qm.shape[0]):
            diff = X - Qm[j]
            length = np.sqrt(np.einsum("ij,ij->i", diff, diff)) if metric == "euclidean_sim" else np.abs(diff).sum(axis=1)
            out[:, j] = 1.0 / (1.0 + length)
        return out


def _candidates(col: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best finite scores plus every row tied with the k-th."""
    ok = np.nonzero(~np.isnan(col))[0]
    if len(ok) <= k:
        return ok
    vals = col[ok]
    kth = np.partition(vals, len(vals) - k)[len(vals) - k]
    return ok[vals >= kth]


def _block_top_k(table: DataFrame, block: DataFrame, metric: str, k: int, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """Candidates of one block of queries, with ``_qn`` (the query's place in the block) and its id."""
    spark = table.sparkSession
    # A block is bounded by the broadcast limit; it is shipped once per executor,
    # as the build side of a broadcast join would be.
    qrows = block.select(QID, Q).collect()
    Qm = np.array([r[Q] if r[Q] is not None else [np.nan] * dim for r in qrows], dtype=np.float64).reshape(len(qrows), dim)
    bc = spark.sparkContext.broadcast(Qm)
    qid_type = block.schema[QID].dataType
    names = spark.createDataFrame([(i, r[QID]) for i, r in enumerate(qrows)], T.StructType([
        T.StructField("_qn", T.IntegerType()), T.StructField(QID, qid_type)]))
    out_schema = T.StructType([T.StructField("_qn", T.IntegerType()), T.StructField(id_col, table.schema[id_col].dataType),
                               T.StructField(SCORE, T.DoubleType())])

    def score_partition(batches):
        q_mat = bc.value
        for batch in batches:
            if batch.num_rows == 0 or len(q_mat) == 0:
                continue
            ids = batch.column(id_col)
            if dim == 0:
                lens = np.asarray(batch.column(vec_col).value_lengths().fill_null(0))
                keep = np.nonzero(lens == 0)[0]
                s = np.zeros((len(keep), len(q_mat)))
                ids = ids.take(pa.array(keep))
            else:
                X, present = _batch_matrix(batch.column(vec_col), dim)
                s = _scores(metric, X, q_mat, present)
            out_q, out_i, out_s = [], [], []
            for j in range(len(q_mat)):
                sel = _candidates(s[:, j], k)
                out_q.append(np.full(len(sel), j, dtype=np.int32))
                out_i.append(ids.take(pa.array(sel)))
                out_s.append(s[sel, j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_q)), pa.concat_arrays(out_i), pa.array(np.concatenate(out_s))],
                names=["_qn", id_col, SCORE])

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    scored = table.select(id_col, vec_col).mapInArrow(score_partition, out_schema)
    best = top_k(scored, k, id_col, by="_qn")
    return best.join(F.broadcast(names), "_qn").select(QID, "rank", id_col, SCORE)  # names: one block's ids


def arrow_top_k(table: DataFrame, queries: DataFrame, metric: str, k: int, id_col: str, vec_col: str = VEC) -> DataFrame:
    """Exact top-k per query, scored with NumPy per Arrow batch.  Queries beyond
    the broadcast limit are scored in blocks; ids of queries may have any type."""
    metric = M.resolve_metric(metric)
    if metric not in M.METRIC_NAMES:
        raise ValueError(f"the Arrow scorer supports the built-in metrics only, not {metric!r}")
    validate_k(k)
    info = query_info(queries)
    parts = [_block_top_k(table, b, metric, k, id_col, vec_col, info.dim)
             for b in broadcast_blocks(queries, QID, info.dim, info.rows)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
