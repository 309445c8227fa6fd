"""Vector-table adapters: wide <-> array, dtype normalisation, validation.

The engine's vector table is ``DataFrame[<id>, vec: array<double>]``.  These
helpers adapt other layouts to it with projections only (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VEC = "vec"


def as_double_array(c) -> Column:
    """Cast any numeric array column to ``array<double>``."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(T.ArrayType(T.DoubleType()))


def wide_to_vector(df: DataFrame, id_col: str | list[str], feature_cols: list[str],
                   out: str = VEC) -> DataFrame:
    """Wide table (one double column per feature) -> ``(id, vec)``.  Zero
    feature columns give an empty array for every row.  ``id_col`` may be a
    list of key columns."""
    if feature_cols:
        vec = F.array(*[F.col(c).cast("double") for c in feature_cols])
    else:
        vec = F.array().cast(T.ArrayType(T.DoubleType()))
    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    return df.select(*keys, vec.alias(out))


def feature_columns(df: DataFrame, prefix: str = "col_") -> list[str]:
    """Feature columns ``col_0 .. col_{K-1}`` in numeric order."""
    cols = [c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    return sorted(cols, key=lambda c: int(c[len(prefix):]))


def vector_to_wide(df: DataFrame, id_col: str, vec_col: str, dim: int, prefix: str) -> DataFrame:
    """``(id, vec)`` -> id plus ``prefix0 .. prefix{dim-1}`` double columns."""
    return df.select(F.col(id_col), *[F.get(F.col(vec_col), i).alias(f"{prefix}{i}") for i in range(dim)])


def to_vector_table(df: DataFrame, id_col: str, vec_col: str | None = None,
                    feature_cols: list[str] | None = None, out: str = VEC) -> DataFrame:
    """Adapt array input (``vec_col``) or wide input (``feature_cols``) to the
    engine's ``(id, vec array<double>)`` layout."""
    if vec_col is not None:
        return df.select(F.col(id_col), as_double_array(vec_col).alias(out))
    return wide_to_vector(df, id_col, feature_cols if feature_cols is not None else feature_columns(df), out)


def check_dim(df: DataFrame, dim: int, vec_col: str = VEC) -> DataFrame:
    """Fail the job on the first row whose vector length differs from ``dim``.

    Lazy: the check is an expression evaluated during the scan that already
    runs, not an extra pass.  Null vectors pass through (they score as
    invalid rows).
    """
    v = F.col(vec_col)
    checked = F.when(v.isNull() | (F.size(v) == dim), v).otherwise(
        F.raise_error(F.concat(F.lit(f"vector dimension mismatch: expected {dim}, got "),
                               F.size(v).cast("string"))))
    return df.withColumn(vec_col, checked)


def is_valid_vector(vec_col: str = VEC) -> Column:
    """True when the vector is non-null and has no null or NaN element."""
    return F.expr(f"{vec_col} IS NOT NULL AND NOT exists({vec_col}, x -> x IS NULL OR isnan(x))")
