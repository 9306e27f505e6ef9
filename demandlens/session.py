"""Session helpers: a configured SparkSession and the shared folder for written layers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of the library relies on. AQE re-plans joins and coalesces
# partitions at run time; skew-join splitting guards the hot keys the fact table may have.
# The broadcast thresholds are the size check behind every dimension join of the library:
# the planner broadcasts a side only when its statistics (file sizes, or an aggregate/filter
# over them, which can only shrink) stay under the threshold, and AQE re-checks with the
# real shuffle sizes at run time; anything larger stays a shuffle (sort-merge) join.
BROADCAST_THRESHOLD = "10MB"
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": BROADCAST_THRESHOLD,
    "spark.sql.adaptive.autoBroadcastJoinThreshold": BROADCAST_THRESHOLD,
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(total_cores: int) -> dict:
    """Sizing for a cluster run over a large fact table: enough initial shuffle partitions
    that each holds ~100-200 MB at terabyte scale (AQE coalesces the small ones and splits
    skewed ones at run time), 256 MB input splits for the Parquet scans, and 128 MB target
    partitions after coalescing, so tasks stay well inside executor memory and spill little."""
    return {
        "spark.sql.shuffle.partitions": str(max(400, 4 * total_cores)),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
    }


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "demandlens", extra: dict | None = None,
                cluster_cores: int | None = None) -> SparkSession:
    """Build (or reuse) a session. On a cluster pass no master (spark-submit decides) and
    the total executor cores, which sizes partitions with ``cluster_conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # Local mode runs every task in the driver JVM: a throughput collector leaves the
        # cores to the task threads (G1's concurrent threads compete with them). On a
        # cluster the deployment's JVM settings are left alone.
        conf["spark.driver.extraJavaOptions"] = "-XX:+UseParallelGC"
    if cluster_cores:
        conf.update(cluster_conf(cluster_cores))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:          # Spark Connect sessions have no SparkContext
        pass
    return spark


def app_id(spark: SparkSession) -> str:
    """The application id (works for classic and Spark Connect sessions)."""
    return spark.conf.get("spark.app.id", None) or spark.sparkContext.applicationId


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session. With a local master (tests) and nothing configured, a private
    scratch folder is created and registered; on a cluster its executors would each write
    their own disk, so there a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="demandlens-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder under the checkpoint root for one written table."""
    return f"{checkpoint_root(spark)}/demandlens/{app_id(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for local existence checks (tests only)."""
    return path[len("file:"):] if path.startswith("file:") else path


def exists(path: str) -> bool:
    return os.path.exists(local_path(path))
