"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC timestamps, AQE (coalescing, skew splits),
# Arrow batches small enough for rows that carry whole HTML pages.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # config rules read many fields of one parsed document; without this every
    # field access becomes its own pruned from_json (one re-parse per rule)
    "spark.sql.optimizer.enableJsonExpressionOptimization": "false",
}


def ship_code(spark: SparkSession) -> None:
    """Make the package importable in executor Python workers (``addPyFile``),
    once per SparkContext; cloudpickled functions refer to its modules."""
    sc = spark.sparkContext
    if getattr(sc, "_snapfeed_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zip_path = os.path.join(tempfile.mkdtemp(prefix="snapfeed-code-"), "snapfeed.zip")
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg_dir):
            if "__pycache__" in folder:
                continue
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zip_path)
    sc._snapfeed_shipped = True


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "snapfeed", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_code(spark)
    return spark


def shared_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``; only in local mode, when it is unset, a
    local folder is used. On a cluster without that setting this raises.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not fallback and not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = fallback or os.environ.get("SNAPFEED_SCRATCH") or "/tmp/snapfeed-checkpoints"
        try:
            spark.conf.set("spark.checkpoint.dir", conf_dir)
        except Exception:  # some sessions refuse runtime changes to core settings
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder (never reused, never deleted here)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def size_shuffles(spark: SparkSession, input_bytes: int, target_bytes: int = 256 << 20,
                  max_partitions: int = 200_000) -> int:
    """Shuffle sizing for large inputs: enough partitions that each holds about
    ``target_bytes`` (AQE coalesces the small ones back), and the same target
    as AQE's advisory size and skew threshold base. Returns the partition count."""
    cores = spark.sparkContext.defaultParallelism
    n = max(cores, min(max_partitions, -(-int(input_bytes) // target_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", str(4 * target_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes // 2))
    return n
