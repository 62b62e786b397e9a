"""Spark session settings and the shared scratch folder.

On a cluster the session is built by whoever submits the job; this module
only fills in settings that are still unset, so a cluster's own choices
(shuffle partitions, checkpoint folder, AQE knobs) always win.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every query in the package assumes. Each is applied only when the
# running session has not set it already.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Static settings, only for sessions this package builds itself: checkpoint
# files of DataFrames that are gone get removed in long-lived sessions.
BUILDER_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "gridmeter", **conf) -> SparkSession:
    """Build (or join) a session. ``master`` is only used for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**BUILDER_DEFAULTS, **DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set package defaults on an existing session, leaving set keys alone."""
    for k, v in DEFAULTS.items():
        if k == "spark.sql.session.timeZone":
            continue  # never change the caller's time zone behind its back
        try:
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
        except Exception:  # static or protected conf in a managed session
            pass
    return spark


def bound_arrow_batches(spark: SparkSession, most: str = "4m") -> None:
    """Limit batches that Spark sends to Python workers by their bytes, unless the
    session does: 10,000 rows with whole texts are held by the JVM, beside its heap,
    and by the worker, once as they come and once as they are used."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediates.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (or the one
    already set on the context). Only a local-mode session with nothing set
    (tests, single-machine runs) gets a fresh temporary folder; a cluster
    session without one is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context here; the server's setting applies
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for checkpointed steps")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        # a folder on this machine is not visible to executors elsewhere
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (e.g. on HDFS or object storage)")
    local = tempfile.mkdtemp(prefix="gridmeter-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def shuffle_partitions(spark: SparkSession) -> int:
    """Task count for an explicitly sized shuffle (AQE does not coalesce those):
    the larger of the shuffle partitions and AQE's initial partition number,
    so a cluster that sizes shuffles through AQE gets the same spread here."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    if initial and spark.conf.get("spark.sql.adaptive.enabled", "true") == "true":
        return max(base, int(initial))
    return base
