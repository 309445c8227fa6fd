"""Center vectors: element-wise mean (any size, partial aggregation in the
JVM) and element-wise median (exact; meant for bounded inputs such as a
sample, since an exact percentile keeps every value of its group)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions.vectors import VEC, is_valid_vector

CENTER = "center"


def mean_vector(df: DataFrame, vec_col: str = VEC, group_cols: list[str] | None = None,
                out: str = CENTER, count: str | None = None) -> DataFrame:
    """Element-wise mean of the valid vectors, per group (one row if no group);
    ``count`` names a column for their number.

    ``Summarizer.mean`` is a typed JVM aggregate with a map-side partial
    buffer of K doubles per group, so the shuffle carries one row per group
    per input partition, whatever the group sizes (skew-safe).
    """
    g = list(group_cols or [])
    # vectors without features have no mean: no row, rather than a failing summarizer
    valid = df.filter(is_valid_vector(vec_col) & (F.size(vec_col) > 0))
    # A global mean groups by a constant key: empty input then yields no row
    # (a missing center) instead of a summarizer that has seen nothing.
    keys = g or [F.lit(0).alias("_all")]
    counts = [F.count(F.lit(1)).alias(count)] if count else []
    agg = valid.groupBy(*keys).agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_m"), *counts)
    return agg.select(*g, vector_to_array(F.col("_m")).alias(out), *([count] if count else []))


def median_vector(df: DataFrame, vec_col: str = VEC, out: str = CENTER) -> DataFrame:
    """Element-wise exact median (even counts average the middle two)."""
    valid = df.filter(is_valid_vector(vec_col))
    per_pos = (valid.select(F.posexplode(vec_col).alias("_pos", "_x"))
               .groupBy("_pos").agg(F.percentile(F.col("_x"), F.lit(0.5)).alias("_m")))
    return per_pos.agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_s")).select(
        F.transform("_s", lambda s: s["_m"]).alias(out))


def center_vector(df: DataFrame, vec_col: str = VEC, use_median: bool = False) -> DataFrame:
    return median_vector(df, vec_col) if use_median else mean_vector(df, vec_col)
