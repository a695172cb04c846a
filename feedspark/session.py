"""Session helpers: a local session for tests/bench and the shared scratch root."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: State store that streams with map, list or timer state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "feedspark") -> SparkSession:
    """Local session with the settings the tests and bench rely on.

    On a cluster use the cluster's own session; nothing in the library needs
    more than ``spark.sql.session.timeZone=UTC`` (audit times and feed dates
    are rendered in UTC).
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # no UI: keep the driver's status store small so long sessions do not slow down
        .config("spark.ui.retainedJobs", "100")
        .config("spark.ui.retainedStages", "100")
        .config("spark.ui.retainedTasks", "10000")
        .config("spark.sql.ui.retainedExecutions", "50")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, sink tables and stream checkpoints.

    Uses ``spark.checkpoint.dir`` when the cluster names one.  Only when it is
    unset and the master is local (tests) a fresh temporary folder is created
    and registered; on a cluster an unset folder is an error, since every
    executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="feedspark-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(os.path.join(root, "rdd"))
    else:
        try:
            spark.sparkContext.setCheckpointDir(root.rstrip("/") + "/rdd")
        except Exception:  # Spark Connect has no SparkContext
            pass
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the scratch root (never reused between runs)."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str, spark: SparkSession | None = None):
    """Cut lineage: write ``df`` as a parquet table in the shared scratch folder and read it back.

    Stage outputs that several later steps read (packets, missing numbers,
    batch assignments) are written once instead of being recomputed by every
    branch; the read-back table has real statistics for AQE and survives the
    loss of executors.
    """
    spark = spark or df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class conf_override:
    """Set SQL confs for the duration of a block (e.g. while a stream starts) and restore them."""

    def __init__(self, spark: SparkSession, **confs):
        self.spark = spark
        self.confs = {k.replace("__", "."): str(v) for k, v in confs.items()}
        self.saved: dict[str, str | None] = {}

    def __enter__(self):
        for k, v in self.confs.items():
            self.saved[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, v)
        return self

    def __exit__(self, *exc):
        for k, v in self.saved.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        return False


def state_partitions(spark: SparkSession, n: int | None = None) -> int:
    """Partitions of a stream's state store: fixed at its first start, so chosen explicitly.

    Defaults to the cluster's parallelism (one state task per core) rather
    than whatever ``spark.sql.shuffle.partitions`` happens to be.
    """
    if n:
        return int(n)
    try:
        return max(int(spark.sparkContext.defaultParallelism), 1)
    except Exception:  # Spark Connect
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
