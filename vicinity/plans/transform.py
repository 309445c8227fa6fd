"""Similarity-space search.

Pick n diverse references from a deterministic sample, re-describe every row
(and every query) by its n similarities to them, and run the exact top-k in
that n-dimensional space with the same metric.  Scores are similarities of
similarity profiles, not comparable with the other modes.

Plan: the references are packed into one row (n x K doubles; in blocks beyond
the broadcast limit) and broadcast; each row's profile is a ``transform`` over
that array, so the table is scanned once with no shuffle.  The profile table can be
written to Parquet once and searched many times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions import metrics as M
from vicinity.functions.vectors import VEC
from vicinity.operators.broadcast import MAX_BROADCAST_BYTES, estimate_bytes
from vicinity.operators.references import REF_NO, diverse_references
from vicinity.operators.sampling import hash_sample
from vicinity.plans.exact import QueryInfo, exact_top_k, only_query
from vicinity.sources.queries import Q, QID

SIMS = "sims"
_REFS = "_refs"
_RNORMS = "_rnorms"
_N = "_n"


@dataclass(frozen=True)
class TransformParams:
    n_refs: int = 20
    sample_size: int = 10000
    seed: int = 42
    use_median: bool = False


def pack_references(refs: DataFrame, vec_col: str = VEC) -> DataFrame:
    """One row: ``_refs`` (vectors in ref_no order) and their norms."""
    s = refs.agg(F.array_sort(F.collect_list(F.struct(F.col(REF_NO), F.col(vec_col)))).alias("_s"))
    return s.select(F.expr(f"transform(_s, r -> r.{vec_col})").alias(_REFS)).select(
        _REFS, F.expr(f"transform({_REFS}, rv -> {M.norm_sql('rv')})").alias(_RNORMS))


def profile(vec: str, metric: str) -> F.Column:
    """Array of similarities of ``vec`` to each packed reference."""
    metric = M.resolve_metric(metric)
    if metric == "cosine":
        body = M.cosine_clamped_sql(vec, "rv", a_norm=_N, b_norm=f"{_RNORMS}[ri]")
        return F.expr(f"transform({_REFS}, (rv, ri) -> {body})")
    body = M.score_sql(metric, vec, "rv", shape="matrix")
    return F.expr(f"transform({_REFS}, rv -> {body})")


def _attach(df: DataFrame, packed: DataFrame) -> DataFrame:
    """Every row with the one row of packed references.

    References are a parameter's number of rows of a bounded sample; Spark holds
    them once per executor, like any broadcast."""
    return df.crossJoin(F.broadcast(packed))


def _profiles(df: DataFrame, refs: DataFrame, metric: str, vec_col: str, keep: list[str], out: str,
              limit_bytes: int | None = None) -> DataFrame:
    """``keep`` and the array of similarities to ``refs``, in the order of ``ref_no``.

    The size of the references is taken from themselves.  Where they do not fit
    one broadcast, blocks of consecutive references are attached one after the
    other and the partial profiles are concatenated: still one scan, no shuffle."""
    size = refs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(VEC)).alias("d")).first()
    n, dim = int(size["n"]), int(size["d"] or 0)
    limit = MAX_BROADCAST_BYTES if limit_bytes is None else limit_bytes
    per_block = max(1, limit // estimate_bytes(1, dim))
    out_df = df.withColumn(_N, M.norm(vec_col)).withColumn(out + "_", F.array().cast("array<double>"))
    for lo in range(0, max(n, 1), per_block):
        block = refs.filter(F.col(REF_NO).between(lo, lo + per_block - 1))
        part = _attach(out_df, pack_references(block))
        out_df = part.withColumn(out + "_", F.concat(F.col(out + "_"), profile(vec_col, metric))).drop(_REFS, _RNORMS)
    return out_df.select(*keep, F.col(out + "_").alias(out))


def to_similarity_space(table: DataFrame, refs: DataFrame, metric: str, id_col: str, vec_col: str = VEC,
                        limit_bytes: int | None = None) -> DataFrame:
    """``(id, sims array<double>)`` of the rows with features; no references -> ``sims`` is empty."""
    rows = table.select(id_col, vec_col).filter(F.size(vec_col) > 0)  # without features a row is in no space
    return _profiles(rows, refs, metric, vec_col, [id_col], SIMS, limit_bytes)


def query_to_similarity_space(queries: DataFrame, refs: DataFrame, metric: str, limit_bytes: int | None = None) -> DataFrame:
    return _profiles(queries.select(QID, Q).filter(F.size(Q) > 0), refs, metric, Q, [QID], Q, limit_bytes)


def select_references(table: DataFrame, id_col: str, metric: str, params: TransformParams,
                      vec_col: str = VEC) -> DataFrame:
    sample = hash_sample(table.select(id_col, vec_col), id_col, params.sample_size, params.seed)
    return diverse_references(sample, id_col, params.n_refs, metric, params.use_median, vec_col)


def transform_top_k(table: DataFrame, queries: DataFrame, metric: str, k: int, id_col: str,
                    params: TransformParams = TransformParams(), vec_col: str = VEC, one_query: bool = False,
                    space: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Top-k per query in the similarity space.  ``space`` may be a stored
    profile table built with the same ``refs``.  ``one_query`` declares a single
    query (checked in the plan).  Rows without features are in no space: no result."""
    # references come from a written sample (or a stored table): cheap to re-read,
    # so nothing is cached and nothing leaks past the returned plan
    refs = refs if refs is not None else select_references(table, id_col, metric, params, vec_col)
    info = QueryInfo(1, 0) if one_query else None
    if refs.isEmpty():
        return exact_top_k(table.limit(0), queries, metric, k, id_col, vec_col, info=info)
    space = space if space is not None else to_similarity_space(table, refs, metric, id_col, vec_col)
    qspace = query_to_similarity_space(only_query(queries) if one_query else queries, refs, metric)
    return exact_top_k(space, qspace, metric, k, id_col, SIMS, info=info)


def build_similarity_space(table: DataFrame, id_col: str, metric: str, params: TransformParams, path: str,
                           vec_col: str = VEC) -> tuple[DataFrame, DataFrame]:
    """Choose the references and write ``refs`` and the profile table
    ``space`` (id, sims) under ``path``; returns both, read back.  Searches
    then scan the N-dim ``space`` table instead of the K-dim vectors."""
    spark = table.sparkSession
    refs = select_references(table, id_col, metric, params, vec_col)
    refs.write.mode("overwrite").parquet(f"{path}/refs")
    refs = spark.read.schema(refs.schema).parquet(f"{path}/refs")
    space = to_similarity_space(table, refs, metric, id_col, vec_col)
    space.write.mode("overwrite").parquet(f"{path}/space")
    return spark.read.schema(space.schema).parquet(f"{path}/space"), refs
