"""Size-checked broadcast.

A side is broadcast only when its size is proven small: either the caller
knows the row count (a literal built on the driver) or it is counted here.
Beyond the limit an equi-join is left to the planner, and a table that must
meet every row is cut into blocks that each fit (``broadcast_blocks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 64 MiB: well under the 8 GiB hard limit of a broadcast relation and small
# enough to ship to a thousand executors.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def estimate_bytes(rows: int, dim: int, extra_bytes: int = 64) -> int:
    return rows * (8 * max(dim, 0) + extra_bytes)


def broadcast_blocks(df: DataFrame, key: str, dim: int, rows: int,
                     limit_bytes: int | None = None) -> list[DataFrame]:
    """``df`` (``rows`` counted rows) as broadcast blocks of about the limit at
    most.  A key lies in one block whole, so what is computed per key needs no
    merging across blocks."""
    limit_bytes = MAX_BROADCAST_BYTES if limit_bytes is None else limit_bytes
    n = max(1, -(-estimate_bytes(rows, dim) // limit_bytes))
    if n == 1:
        return [F.broadcast(df)]
    block = F.pmod(F.xxhash64(key), F.lit(n))
    return [F.broadcast(df.filter(block == i)) for i in range(n)]


def broadcast_checked(df: DataFrame, dim: int, known_rows: int | None = None,
                      limit_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Return ``(df_or_broadcast_hint, broadcasted)``."""
    rows = known_rows if known_rows is not None else df.count()
    if estimate_bytes(rows, dim) <= (MAX_BROADCAST_BYTES if limit_bytes is None else limit_bytes):
        return F.broadcast(df), True
    return df, False
