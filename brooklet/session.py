"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings the operators rely on; everything else is left to the cluster.
REQUIRED_CONF = {
    "spark.sql.ansi.enabled": "true",           # bad casts and overflows fail instead of turning into null
    "spark.sql.adaptive.enabled": "true",       # runtime broadcast choice, skew split, partition coalescing
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Keyed state outgrows the heap; this provider keeps it on local disk and writes only changes to the checkpoint.
    STATE_STORE: ROCKS_DB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoint files go when their DataFrame does
}


def build_session(app: str = "brooklet", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` overrides (underscores stand for dots)."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a fresh temporary folder
    (one process, one machine); a cluster session must name the folder itself.
    The folder is also the session's checkpoint folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        one_process = context.master == "local" or context.master.startswith("local[")
        if not configured and not one_process:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="brooklet-"))
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for results of one run; it is removed when the session's JVM ends."""
    path = work_path(spark, label)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def require_ansi(spark: SparkSession) -> None:
    """Refuse to go on where bad values would silently turn into null."""
    if spark.conf.get("spark.sql.ansi.enabled") != "true":
        raise ValueError("set spark.sql.ansi.enabled to true: without it bad values become null")


def use_rocksdb(spark: SparkSession) -> None:
    """State of several kinds per key needs RocksDB, which is not Spark's default.

    Where the session still has the default, queries started from now on get
    RocksDB; those that have a checkpoint keep the provider named in it.
    """
    if spark.conf.get(STATE_STORE).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, ROCKS_DB)


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
