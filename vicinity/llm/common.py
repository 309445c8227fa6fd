"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.operators.broadcast import broadcast_checked
from vicinity.session import cut_lineage, scratch_path  # noqa: F401  (re-exported to the operators)


def ship_by_value() -> None:
    """Task functions of this subpackage are pickled by value: executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules["vicinity.llm"])


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of few rows for the jobs that run inside: a batch of long texts is held by the JVM and by
    the Python worker, several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Row numbers to a bitmap: as many bits as ``bitmap_construct_agg`` makes.
_BITMAP = 1 << 15


def rows_among(rows: DataFrame, numbers: DataFrame, column: str, limit_bytes: int | None = None) -> DataFrame:
    """``rows`` whose ``column`` is in ``numbers(column)``: row numbers, not negative, that are dense in stretches
    (``monotonically_increasing_id``).  They are sent along as bitmaps, a bit for each row, so the rows stay
    where they are up to some hundred times as many numbers as a broadcast list could hold; beyond it is a join."""
    chunk = F.expr(f"`{column}` div {_BITMAP}")
    bits = numbers.select(chunk.alias("chunk"), F.expr(f"`{column}` % {_BITMAP}").alias("at")).repartition("chunk")
    bits = cut_lineage(bits.groupBy("chunk").agg(F.bitmap_construct_agg("at").alias("bits")), "row-bits")
    bits, sent = broadcast_checked(bits, _BITMAP // 64, limit_bytes=limit_bytes)
    if not sent:
        return rows.join(numbers, column, "left_semi")
    byte = f"cast(conv(hex(substring(bits, cast(`{column}` % {_BITMAP} div 8 as int) + 1, 1)), 16, 10) as int)"
    met = rows.join(bits, chunk == F.col("chunk")).where(f"getbit({byte}, cast(`{column}` % 8 as int)) = 1")
    return met.select(*rows.columns)


def text_blocks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about ``limit`` UTF-8 bytes.

    Yields ``(lo, hi, data, offsets)``: rows ``lo:hi``, their bytes, and ``hi - lo + 1`` offsets
    into them.  A text longer than the limit makes a run of its own.  A null text has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    _, off_buf, data_buf = column.buffers()
    offsets = np.frombuffer(off_buf, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi
