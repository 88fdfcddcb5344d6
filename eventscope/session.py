"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


CLUSTER_CONF = {
    # streaming state (per-user journey flags, window counts) off-heap in RocksDB,
    # committed as changelogs instead of full snapshots
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # ~128 MB input splits; AQE targets ~128 MB shuffle partitions and splits skewed
    # join partitions above 5x the median
    "spark.sql.files.maxPartitionBytes": "134217728",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "134217728",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
}


def build_session(master: str | None = None, app_name: str = "eventscope",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE on).

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` to the data
    (roughly input bytes / 128 MB); locally it defaults to the core count.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if not (master or "").startswith("local"):
        conf.update(CLUSTER_CONF)
    if shuffle_partitions is None and master and master.startswith("local"):
        n = master[master.find("[") + 1:-1] if "[" in master else "1"
        shuffle_partitions = os.cpu_count() if n == "*" else int(n)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext (Spark Connect)
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent in local mode (tests) a private folder is created; a
    cluster without it is an error, as its executors would each write to their own disk.
    """
    sc = _context(spark)
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and sc is not None:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master if sc is not None else ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="eventscope-ckpt-")
    if sc is None:
        return d
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def work_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder (never reused)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "eventscope", *parts, uuid.uuid4().hex])
