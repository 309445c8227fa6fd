"""Session helpers: a local session for tests and the bench, and the shared
checkpoint folder used to cut lineage in iterative plans."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vicinity") -> SparkSession:
    """Local session for tests and benchmarks (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VICINITY_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local_master(master: str) -> bool:
    """True for ``local`` and ``local[...]``: driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (or one
    already set on the context).  Only a ``local`` master, as in tests, may go
    without: it gets a folder under the system temp directory.  On a cluster a
    machine-local folder would lose what other executors write, so an unset
    folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get(_CKPT_KEY, None) or sc.getConf().get(_CKPT_KEY, None)
    if not conf_dir:
        if not is_local_master(sc.master):
            raise ValueError(f"set {_CKPT_KEY} to a shared folder (master {sc.master!r})")
        conf_dir = tempfile.mkdtemp(prefix="vicinity-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back: lineage is cut, the data survives executor loss, and it costs
    one job (a reliable RDD checkpoint costs two)."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables next to the checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"
