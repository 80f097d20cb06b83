"""Session construction and the shared storage root.

All written intermediates (the warehouse, checkpoints, staged ingest files) live under the
folder the cluster names in ``spark.checkpoint.dir``. A private folder is created only when
that setting is unset and the master is local (tests, bench).
"""

from __future__ import annotations

import gc
import os
import tempfile
import threading

from pyspark.sql import SparkSession

_LOCK = threading.Lock()


def build_session(master: str | None = None, app: str = "clickstack", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32m")
        .config("spark.sql.files.maxPartitionBytes", "32m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates; set a private one only in local mode."""
    with _LOCK:
        sc = spark.sparkContext
        cur = sc.getCheckpointDir()
        if cur:
            return cur.rstrip("/")
        conf = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if conf:
            sc.setCheckpointDir(conf)
            return (sc.getCheckpointDir() or conf).rstrip("/")
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="clickstack-ckpt-")
        sc.setCheckpointDir(path)
        return (sc.getCheckpointDir() or path).rstrip("/")


def storage_root(spark: SparkSession) -> str:
    """A stable folder next to the checkpoints for named tables (the checkpoint folder itself
    gets a random per-application subfolder)."""
    root = checkpoint_root(spark)
    parent = root.rsplit("/", 1)[0] if "/" in root else root
    return parent + "/clickstack-tables"


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of finished plans deleted: Spark does so when the driver collects its garbage, which one with
    little to do may put off until long after the next step has written its own. Plans that something still holds keep theirs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder, computing ``df`` once: it is
    persisted first so the checkpoint write reads the cached blocks instead of re-running the plan."""
    from pyspark import StorageLevel

    checkpoint_root(df.sparkSession)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out
