"""Exact (exhaustive) top-k search.

Plan: vector scan (row norm once per row, where the metric needs it) ->
broadcast nested-loop join with the query table -> one projected score
expression -> per-query top-k (partial WindowGroupLimit before the only
shuffle).  No Python worker, no driver-side rows.  A query table beyond the
broadcast limit is searched in blocks, each query whole in one block.

How many queries there are is never taken on trust.  ``QueryInfo(1, ...)``
promises one query and buys the cheaper single-group plan; the plan then
checks the promise and fails where a second query appears.  Any other number
is counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions import metrics as M
from vicinity.functions.vectors import VEC
from vicinity.operators.broadcast import broadcast_blocks
from vicinity.operators.topk import SCORE, top_k, validate_k
from vicinity.sources.queries import Q, QID

Q_NORM = "q_norm"
V_NORM = "_v_norm"


@dataclass(frozen=True)
class QueryInfo:
    rows: int
    dim: int


def query_info(queries: DataFrame) -> QueryInfo:
    """Row count and dimension of a query table in one small job (a null vector has none)."""
    size = F.when(F.col(Q).isNotNull(), F.size(Q))
    r = queries.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise ValueError(f"query vectors have different dimensions ({r['lo']}..{r['hi']})")
    return QueryInfo(int(r["n"]), int(r["lo"] or 0))


def search_score_sql(metric: str, vec: str, q: str, q_norm: str | None = None, v_norm: str | None = None) -> str:
    """Score of a table row against a query with the search-level rules:
    empty query against features -> null (no result); no features on either
    side -> 0.0; length mismatch -> the job fails."""
    cosine = M.resolve_metric(metric) == "cosine"
    s = M.score_sql(metric, vec, q, a_norm=v_norm if cosine else None, b_norm=q_norm if cosine else None)
    bad = (f"CAST(raise_error(concat('vector dimension mismatch: row has ', CAST(size({vec}) AS STRING), "
           f"', query has ', CAST(size({q}) AS STRING))) AS DOUBLE)")
    return (f"CASE WHEN size({q}) = 0 AND size({vec}) > 0 THEN CAST(NULL AS DOUBLE) "
            f"WHEN {vec} IS NOT NULL AND size({vec}) != size({q}) THEN {bad} ELSE {s} END")


def search_score(metric: str, vec: str, q: str, q_norm: str | None = None, v_norm: str | None = None) -> F.Column:
    return F.expr(search_score_sql(metric, vec, q, q_norm, v_norm))


def with_query_norm(queries: DataFrame) -> DataFrame:
    """Query norm computed once per query (on the broadcast side)."""
    return queries.withColumn(Q_NORM, M.norm(Q))


def with_row_norm(table: DataFrame, metric: str, vec_col: str) -> tuple[DataFrame, str | None]:
    """Row norm computed once per row, below the join, for the metric that uses it."""
    if M.resolve_metric(metric) != "cosine":
        return table, None
    return table.withColumn(V_NORM, M.norm(vec_col)), V_NORM


def only_query(queries: DataFrame) -> DataFrame:
    """The one query of a table that should hold one; a second one fails the job."""
    one = queries.agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in queries.columns))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("more than the one query that was declared"))
                     .cast("boolean")).otherwise(F.col("_n") == 1)
    return one.filter(checked).drop("_n")


def _query_blocks(queries: DataFrame, info: QueryInfo | None) -> tuple[list[DataFrame], bool]:
    """Broadcast blocks of the queries, and whether there is one query only."""
    if info is not None and info.rows == 1:
        return [F.broadcast(only_query(queries))], True  # one row, checked in the plan
    info = query_info(queries)
    return broadcast_blocks(queries, QID, info.dim, info.rows), info.rows <= 1


def _score_block(table: DataFrame, block: DataFrame, metric: str, id_col: str, vec_col: str) -> DataFrame:
    rows, v_norm = with_row_norm(table.select(id_col, vec_col), metric, vec_col)
    return rows.crossJoin(block).select(
        F.col(QID), F.col(id_col), search_score(metric, vec_col, Q, Q_NORM, v_norm).alias(SCORE))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_all(table: DataFrame, queries: DataFrame, metric: str, id_col: str,
              vec_col: str = VEC, info: QueryInfo | None = None) -> DataFrame:
    """``(query_id, id, similarity_score)`` for every (query, row) pair."""
    blocks, _ = _query_blocks(with_query_norm(queries), info)
    return _union([_score_block(table, b, metric, id_col, vec_col) for b in blocks])


def exact_top_k(table: DataFrame, queries: DataFrame, metric: str, k: int, id_col: str,
                vec_col: str = VEC, info: QueryInfo | None = None) -> DataFrame:
    """Exact top-k per query: ``(query_id, rank, <id_col>, similarity_score)``."""
    validate_k(k)
    blocks, single = _query_blocks(with_query_norm(queries), info)
    parts = [top_k(_score_block(table, b, metric, id_col, vec_col), k, id_col, single_group=single) for b in blocks]
    return _union(parts).select(QID, "rank", id_col, SCORE)


METRIC = "metric"
ERROR = "error"


def mixed_score_sql(vec: str, q: str, metric_col: str = METRIC, q_norm: str | None = None, v_norm: str | None = None) -> str:
    """One expression for queries that name their own metric: each (query,
    row) pair evaluates only its query's branch."""
    branches = " ".join(f"WHEN {metric_col} = '{m}' THEN {search_score_sql(m, vec, q, q_norm, v_norm)}"
                        for m in M.known_metrics())
    return f"CASE {branches} END"


def checked_requests(table: DataFrame, requests: DataFrame, vec_col: str = VEC) -> DataFrame:
    """``(query_id, q, metric, error)``: metric names resolved (aliases and user
    metrics too); ``error`` says why a request cannot be answered, else null."""
    names = F.create_map(*(F.lit(x) for pair in sorted(M.metric_aliases().items()) for x in pair))
    first = table.select(F.size(vec_col).alias("d")).filter("d >= 0").limit(1).collect()
    dim = first[0]["d"] if first else None
    canonical = names[F.lower(F.trim(F.col(METRIC)))]
    error = F.when(canonical.isNull(), F.concat(F.lit("unknown metric: "), F.coalesce(F.col(METRIC), F.lit("null"))))
    error = error.when(F.col(Q).isNull(), F.lit("no query vector"))
    if dim is not None:
        error = error.when((F.size(Q) != dim) & (F.size(Q) > 0), F.concat(
            F.lit("dimension "), F.size(Q).cast("string"), F.lit(f" instead of {dim}")))
    return requests.select(QID, Q, F.coalesce(canonical, F.col(METRIC)).alias(METRIC), error.alias(ERROR))


def exact_top_k_mixed(table: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str = VEC) -> DataFrame:
    """Exact top-k for a query table ``(query_id, q, metric)`` with a metric per
    query, in one scan of ``table``: ``(query_id, metric, rank, id, score, error)``.

    A request that cannot be answered (unknown metric, no vector, other
    dimension) gives one row with ``error`` set and no rank, and does not keep
    the others from their answers."""
    validate_k(k)
    checked = checked_requests(table, queries, vec_col)
    good = with_query_norm(checked.filter(F.col(ERROR).isNull()).drop(ERROR))
    info = query_info(good)
    rows = table.select(id_col, vec_col).withColumn(V_NORM, M.norm(vec_col))
    score = F.expr(mixed_score_sql(vec_col, Q, METRIC, Q_NORM, V_NORM)).alias(SCORE)
    parts = [top_k(rows.crossJoin(b).select(QID, METRIC, id_col, score), k, id_col, by=[QID, METRIC])
             for b in broadcast_blocks(good, QID, info.dim, info.rows)]
    answers = _union(parts).select(QID, METRIC, "rank", id_col, SCORE, F.lit(None).cast("string").alias(ERROR))
    refused = checked.filter(F.col(ERROR).isNotNull()).select(
        QID, METRIC, F.lit(None).cast("int").alias("rank"), F.lit(None).cast(table.schema[id_col].dataType).alias(id_col),
        F.lit(None).cast("double").alias(SCORE), ERROR)
    return answers.unionByName(refused)
