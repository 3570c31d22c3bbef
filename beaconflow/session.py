"""Spark session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


TARGET_PARTITION_BYTES = 128 << 20


def partitions_for(input_bytes: int, target_bytes: int = TARGET_PARTITION_BYTES, minimum: int = 8) -> int:
    """Shuffle partitions so that each holds about ``target_bytes`` of the input
    (AQE then coalesces small ones); e.g. 100 TB -> ~800k partitions of 128 MB."""
    return max(minimum, -(-int(input_bytes) // int(target_bytes)))


def get_session(app: str = "beaconflow", cores: int | str | None = None,
                shuffle_partitions: int | None = None, extra: dict | None = None,
                input_bytes: int | None = None) -> SparkSession:
    """The running session, or a new one.

    What the launcher has set (master, memory, ``spark.checkpoint.dir``, any SQL setting) stays; only what is
    unset is filled in.  ``input_bytes`` sizes the shuffle partitions (~128 MB each,
    ``partitions_for``); file splits and AQE's advisory partition size use the same target.
    AQE (coalescing, skew-join splitting, runtime broadcast by measured size) is on because several
    operators rely on it for skewed senders.  ``extra`` is set in any case.
    """
    running = SparkSession.getActiveSession()
    if running is None:
        cores = cores or os.environ.get("BENCH_CPUS") or "*"
        if shuffle_partitions is None and input_bytes:
            shuffle_partitions = partitions_for(input_bytes)
        parts = shuffle_partitions or (int(cores) * 2 if str(cores).isdigit() else 16)
        wanted = {
            "spark.master": os.environ.get("SPARK_MASTER", f"local[{cores}]"),
            "spark.app.name": app,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
            "spark.sql.shuffle.partitions": str(parts),
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
            "spark.sql.files.maxPartitionBytes": str(TARGET_PARTITION_BYTES),
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "16g"),
        }
        launched: set[str] = set()
        if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit: its settings are in the JVM already
            SparkContext._ensure_initialized()
            launched = {k for k, _ in SparkConf().getAll()}
        b = SparkSession.builder
        for k, v in wanted.items():
            if k not in launched:
                b = b.config(k, v)
    else:
        b = SparkSession.builder
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, reading the session's setting first.

    A cluster must name a shared folder in ``spark.checkpoint.dir``.  Only a local
    master (tests, single-node benches) gets a fresh scratch folder when none is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a shared checkpoint folder")
    path = tempfile.mkdtemp(prefix="beaconflow-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediates."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"
