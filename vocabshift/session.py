"""Spark session settings and the shared checkpoint folder.

Cluster settings are left to the caller's ``spark-submit``/cluster
configuration; ``build_session`` only fills in what the analysis relies on
(AQE with partition coalescing and skew-join splitting, UTC) and, for local
runs and tests, a small shuffle-partition count and the UI switched off.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

ANALYSIS_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Python call sites in error messages cost a stack walk and calls into the JVM for every expression of a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# Suggested settings for a large cluster reading ~100 TB of events (pass as **conf or put in the
# cluster configuration).  Input splits and post-shuffle partitions of ~256 MB keep every task's
# hash tables and sort buffers within executor memory; a high initial shuffle-partition count is
# coalesced by AQE to the advisory size; skewed join partitions above 512 MB (and 5x the median)
# are split.  The vocabulary-side broadcasts are size-checked in code (plans/broadcast.py), the
# automatic threshold only covers sides that Spark measures itself.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Get or create a session with the analysis settings applied."""
    builder = SparkSession.builder.appName("vocabshift")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for k, v in {**ANALYSIS_CONF, **conf}.items():
        builder = builder.config(k.replace("__", "."), v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is used as is; a
    cluster without it is an error (a machine-local folder would not be seen
    by the other executors).  Only local-mode sessions (tests) with the
    setting unset get a fresh local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is unset: name a shared folder (reachable from every executor) "
                "in the cluster configuration"
            )
        configured = tempfile.mkdtemp(prefix="vocabshift-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
