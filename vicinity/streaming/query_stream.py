"""Search requests arriving as a stream.

Each request is a row ``(query_id, q array<double>, metric)``.  Every
micro-batch is answered with the exact top-k over the (static) vector table
in a single scan via ``foreachBatch`` -- ``row_number`` windows are not
allowed on streams directly, and a batch of requests is a small bounded
table.  A request that cannot be answered gets a row with ``error`` set and
does not hold up the stream.  Results go to ``<out>/epoch=<n>``, overwritten per epoch, so a replayed
batch after a failure rewrites the same files (idempotent sink); progress is
kept in the checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinity.functions.vectors import VEC
from vicinity.plans.exact import exact_top_k_mixed

REQUEST_SCHEMA = "query_id long, q array<double>, metric string"


def answer_batch(table: DataFrame, requests: DataFrame, k: int, id_col: str, vec_col: str = VEC) -> DataFrame:
    """Top-k for one batch of requests (a static DataFrame)."""
    return exact_top_k_mixed(table, requests, k, id_col, vec_col)


def start_search_stream(requests: DataFrame, table: DataFrame, k: int, id_col: str, out_path: str,
                        checkpoint_location: str, vec_col: str = VEC, available_now: bool = False,
                        processing_time: str | None = None) -> StreamingQuery:
    """Start answering a streaming request DataFrame; returns the running query."""
    if not requests.isStreaming:
        raise ValueError("requests must be a streaming DataFrame (spark.readStream...)")

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()  # read once: it is checked, counted and searched
        try:
            if not batch.isEmpty():
                res = answer_batch(table, batch, k, id_col, vec_col).withColumn("epoch", F.lit(epoch_id))
                res.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")
        finally:
            batch.unpersist()

    w = requests.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
