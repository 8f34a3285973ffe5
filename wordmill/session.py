"""Session helpers: a local session for tests/bench, and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkAttributeError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, app: str = "wordmill") -> SparkSession:
    """A local session configured like the cluster one (AQE on, UI off)."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("WORDMILL_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a folder every executor can reach). Only a
    local-mode session without it gets a private temporary folder, for tests.
    """
    try:
        sc = spark.sparkContext
    except PySparkAttributeError:  # a remote session: the server's own setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
        configured = tempfile.mkdtemp(prefix="wordmill-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Cuts the lineage, survives lost executors, and gives the planner the real
    size: a side that is small is broadcast, a skewed join side can be split.
    """
    return _written(df, _own_path(df.sparkSession, name))


ROW_GROUP_BYTES = 32 << 20  # what a task that writes a large frame holds of it


@contextmanager
def stored_meanwhile(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as ``stored`` gives it, deleted in the end: for a frame that grows with the corpus.

    Such a frame is not persisted: with a memory level it fills the executors' storage memory,
    the heap holds twice what Spark counts of it, and ends before Spark evicts enough.
    """
    path = _own_path(df.sparkSession, name)
    try:
        yield _written(df, path, **{"parquet.block.size": ROW_GROUP_BYTES, "compression": "zstd"})
    finally:
        _delete(df.sparkSession, path)


def _own_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/wordmill-{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str, **options) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
    except PySparkAttributeError:  # a remote session has no file system of its own
        return
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
