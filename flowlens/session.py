"""Session settings, and the shared folder that written intermediate tables go to."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


# Rows that are joined or sorted at once where a large table is written in rounds, so that its shuffles do not lie on disk together.
ROUND_ROWS = 32_000_000

# Settings to use with these queries; all can be set on a running session.
RUNTIME_CONF = {
    # Methods above 8000 bytes of bytecode are never compiled by HotSpot, so the projection of a
    # wide parser is better split into small methods than fused into one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Sketches and nested lists aggregate by hash up to this many groups per task, before all input
    # is sorted. A group holds a sketch of 4 KiB or a list of 256 rows at most.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="flowlens-"))
        # call sites of every Column call cost half of the time to build a wide parser
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in spark.checkpoint.dir.

    A session without that setting must have a checkpoint directory; only one that runs on a single
    machine gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowlens-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def folders(spark: SparkSession, pattern: str) -> list[dict[str, int]]:
    """The numbers in `name=number` parts of all paths of that pattern."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    paths = [status.getPath().toString() for status in found or ()]
    return [{k: int(v) for k, v in re.findall(r"/(\w+)=(\d+)(?=/|$)", path)} for path in paths]


def file_sizes(spark: SparkSession, pattern: str) -> list[int]:
    """Bytes of each file of that pattern."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return [status.getLen() for status in found or ()]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table and all below it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def tasks_for(spark: SparkSession, rows: int, each: int = 500_000) -> Iterator[None]:
    """Shuffles of queries run within have so many tasks that each gets about `each` of the rows, and no fewer than the session
    sets; adaptive execution joins those that come out small."""
    key = "spark.sql.shuffle.partitions"
    with _setting(spark, key, str(max(int(spark.conf.get(key)), -(-rows // each)))):
        yield


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query made within, such as a write, go as soon as it has ended; else they lie on the executors' disks
    until the driver happens to collect its garbage. For frames that run once."""
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """DataFrame.checkpoint() needs the folder set on the context, too."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
