"""Session helpers: one place for the few settings the operators rely on."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings with an effect on results (time zone) or on how skew is handled at
#: run time.  Nothing here fixes a cluster size.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str | int = "*", app: str = "citeloom", shuffle: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CITELOOM_DRIVER_MEMORY", "8g"))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Pin the result-relevant settings on a session somebody else created."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for cut lineage and written tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and the master is local does a temporary folder stand in.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="citeloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the session's folder in the shared folder.

    Results are read after the call that wrote their inputs, so the folder is
    removed when the driver's process ends.
    """
    run = f"{checkpoint_dir(spark).rstrip('/')}/citeloom-{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        _RUNS.add(run)
        atexit.register(_clear, spark, run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


_RUNS: set[str] = set()


def _clear(spark: SparkSession, run: str) -> None:
    """At the end of the process, if the session is still there."""
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            _remove(spark, run)


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small, reused result (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a reused intermediate to the shared folder once and read it back."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote; nothing may read ``df`` afterwards."""
    path = getattr(df, "written_to", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
