"""Session helpers: a local session for tests/bench and checkpoint-dir handling."""

from __future__ import annotations

import os
import shutil
import tempfile
import weakref

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "postlytics", driver_memory: str = "16g") -> SparkSession:
    """A local session with the settings the tests and the bench use.

    On a cluster, build the session yourself; nothing here is required by
    the library functions, which only take DataFrames and Columns.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is. Only a local-mode session without that setting (tests,
    the bench) gets a fresh temporary folder. A cluster session without
    the setting is an error: a machine-local folder would not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="postlytics-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    raise RuntimeError(
        "set spark.checkpoint.dir to a shared folder (HDFS/S3/DBFS) for the "
        "iterative operators")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint folder (eager)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_MATERIALIZED: "weakref.WeakSet[DataFrame]" = weakref.WeakSet()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and read it back.

    For frames that are used many times (an edge table in both directions,
    with degrees and wedges; word counts); without this every use would
    re-run the plan that built them (e.g. tokenizing all posts again). A
    frame that is already the result of this function is returned as is.
    """
    if df in _MATERIALIZED:
        return df
    out = cut_lineage(df)
    _MATERIALIZED.add(out)
    return out


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session.

    Python functions of the operators are pickled by reference, so every
    worker must be able to import the package; on a cluster it is not
    installed there.
    """
    sc = spark.sparkContext
    if getattr(sc, "_postlytics_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="postlytics-ship-")
    archive = shutil.make_archive(os.path.join(folder, "postlytics"), "zip",
                                  os.path.dirname(root), os.path.basename(root))
    sc.addPyFile(archive)
    sc._postlytics_shipped = True
