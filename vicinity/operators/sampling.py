"""Row sampling.

``hash_sample`` is the deterministic sample: the n rows with the smallest
``md5(id || seed)``.  ``orderBy(hash, id).limit(n)`` is a bounded top-n in
every partition, so the table is neither sorted nor counted.  The sample is
written to the shared folder (reused by every step of the reference search).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.session import cut_lineage

HASH = "_h"


def sample_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def bernoulli_sample(df: DataFrame, target_rows: int, total_rows: int, seed: int = 42) -> DataFrame:
    """Bernoulli sample without replacement, fraction min(1, 1.2 * target / total)."""
    frac = 1.0 if total_rows <= 0 else min(1.0, 1.2 * target_rows / total_rows)
    return df.sample(withReplacement=False, fraction=frac, seed=seed)


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest md5(id || seed) (id breaks ties)."""
    if n <= 0:
        return df.limit(0)
    ordered = df.withColumn(HASH, sample_hash(id_col, seed)).orderBy(HASH, id_col)
    return cut_lineage(ordered.limit(n).drop(HASH), "sample")
