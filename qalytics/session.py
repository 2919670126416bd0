"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every qalytics job relies on. Cluster deployments pass their own
# executor sizing; these only pin semantics (UTC, ANSI) and adaptive planning.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast is decided by Spark from the optimizer's size estimate; this
    # is the size bound. Anything larger is shuffled.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "qalytics") -> SparkSession:
    """A local session for tests and benchmarks (a private checkpoint folder
    is set only because none is configured locally)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = (builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("QALYTICS_DRIVER_MEMORY", "8g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


_PRIVATE_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only when it is unset (tests, local runs) a
    private folder is created once per application and registered with
    ``setCheckpointDir`` so ``DataFrame.checkpoint()`` works."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _PRIVATE_ROOTS:
        _PRIVATE_ROOTS[app] = tempfile.mkdtemp(prefix="qalytics-ckpt-")
        sc.setCheckpointDir(_PRIVATE_ROOTS[app])
    return _PRIVATE_ROOTS[app]


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder, for stream checkpoints,
    state snapshots and lineage-cutting tables."""
    return os.path.join(checkpoint_root(spark), *parts)


def fresh_shared_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its file system (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to a name that must not exist yet: False if it does.
    One atomic step on HDFS, so of several writers one gets the name."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    src, fs = _fs(spark, source)
    dst, _ = _fs(spark, target)
    fs.mkdirs(dst.getParent())
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        src.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)  # noqa: SLF001
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(fs.makeQualified(src), fs.makeQualified(dst), none)
    except Exception as ex:  # py4j wraps the Java exception
        if path_exists(spark, target):
            return False
        raise RuntimeError(f"could not rename {source}") from ex
    return True


def remove_path(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` (none if it does not exist)."""
    p, fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []
