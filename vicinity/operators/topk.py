"""Ranking operators: NaN filter, null-last, per-query top-k, ranked report.

Top-k is a ``row_number`` window filtered to ``rank <= k``.  Catalyst turns it
into a partial ``WindowGroupLimit`` before the shuffle, so each input
partition ships at most k rows per query: the shuffle is k x partitions x
queries rows, whatever the table size.  The order is total: score
descending, then id ascending, so ties are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.functions.metrics import is_valid_score

SCORE = "similarity_score"
RANK = "rank"


def validate_k(k: int) -> int:
    """Any positive k.  Up to 1000 rows per group Spark limits each group before
    the shuffle; a larger k of many groups is ranked after it.  One group keeps a
    per-partition top-k at any size (TakeOrderedAndProject)."""
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError(f"k must be a positive integer, got {k!r}")
    return k


def drop_invalid_scores(df: DataFrame, score_col: str = SCORE) -> DataFrame:
    """Remove null and NaN scores before any ranking."""
    return df.filter(is_valid_score(score_col))


def null_score_last(score_col: str = SCORE) -> Column:
    """A null score ranks below every real score."""
    return F.coalesce(F.col(score_col), F.lit(float("-inf")))


def rank_key(score) -> Column:
    """The score with NaN turned into null, so invalid scores sort last."""
    score = F.col(score) if isinstance(score, str) else score
    return F.nanvl(score, F.lit(None).cast("double"))


def top_k(scored: DataFrame, k: int, id_col: str, score_col: str = SCORE,
          by: list[str] | str | None = "query_id", single_group: bool = False) -> DataFrame:
    """Best k rows per group (per query by default), with ``rank`` 1..k.

    With ``single_group`` (the caller proves there is one group) the plan is a
    TakeOrderedAndProject instead (one stage fewer).

    Invalid (null/NaN) scores are ranked last and removed *after* the window:
    a filter before it would be pushed into the join below and make Catalyst
    evaluate the score expression once more per conjunct.
    """
    validate_k(k)
    keys = [by] if isinstance(by, str) else list(by or [])
    order = [F.col(score_col).desc_nulls_last(), F.col(id_col).asc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    keyed = scored.withColumn(score_col, rank_key(score_col))
    if single_group:
        # One group (e.g. one query, proven by the caller): TakeOrderedAndProject
        # keeps k rows per partition and merges them; ranks are then numbered
        # over those k rows only.
        keyed = keyed.orderBy(*order).limit(k)
    ranked = keyed.withColumn(RANK, F.row_number().over(w))
    return ranked.filter((F.col(RANK) <= k) & F.col(score_col).isNotNull())


def ranked_report(result: DataFrame, score_col: str = SCORE) -> DataFrame:
    """Adds ``score_text``: score to 4 decimals, ``N/A`` when missing/NaN."""
    s = F.col(score_col)
    txt = F.when(s.isNull() | F.isnan(s), F.lit("N/A")).otherwise(F.format_string("%.4f", s))
    return result.withColumn("score_text", txt)
