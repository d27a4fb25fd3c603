"""Session construction and the shared scratch location.

Cluster jobs must never use a machine-local temporary folder: intermediate
tables and checkpoints go under the folder the cluster names in
``spark.checkpoint.dir``. Where that setting is absent (local tests) they go to
a folder beside the session's warehouse, which every executor can read too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "crowdlake", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE, UTC session clock and no UI."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Session settings sized for an input of ``input_bytes`` on ``total_cores`` cores.

    Shuffle partitions are sized so a post-shuffle partition holds about
    ``target_partition_bytes`` before AQE coalesces them (never fewer than
    two waves of tasks, never more than 100k, where driver-side scheduling and
    map-status overhead take over); scan splits grow with the input so task counts stay
    manageable; skewed partitions are split by AQE above 4x the median or
    1 GiB. The broadcast threshold stays small: only sides whose estimated
    size is below it are broadcast, everything else shuffles. Streaming state
    goes to the RocksDB state store so millions of keys do not live on the heap.
    """
    shuffle = min(100_000, max(2 * total_cores, -(-input_bytes // target_partition_bytes)))
    split = 512 << 20 if input_bytes > (1 << 40) else 128 << 20
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        # streaming state (ring buffers, dedup keys, windows) off-heap and spillable
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one the session names, else one in the warehouse."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for an intermediate table."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"
