"""Session settings and the shared folders that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Settings every job relies on: adaptive execution splits skewed join partitions and merges small
# ones, all times are UTC, the files of a query's shuffles go when it has ended, and what Python gets
# at once stays small, however long the texts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_stand_ins: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only when the session names none, as in local tests, a temporary folder stands in; it is
    remembered so that one run uses one folder.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _stand_ins:
        _stand_ins[application] = tempfile.mkdtemp(prefix="stowage-")
    return _stand_ins[application]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """The mounted path behind a ``file:`` URI, for readers that open files themselves."""
    for scheme in ("file://", "file:"):
        if path.startswith(scheme):
            return path[len(scheme):]
    return path


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file that is not there yet; False if somebody else was first. Of several writers exactly one succeeds.

    The file system decides: it creates a file exclusively, as HDFS does. For local files the operating system does the same.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    if system.getScheme() == "file":
        try:
            with open(target.toUri().getPath(), "x", encoding="utf-8") as file:
                file.write(text)
            return True
        except FileExistsError:
            return False
    try:
        stream = system.create(target, False)
    except Py4JJavaError as fault:
        if system.exists(target):
            return False
        raise fault
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
