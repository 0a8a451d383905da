"""Tables kept in the shared folder under a version key: what is built once is read by later calls."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of our own only in a local session that names none."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints/passagemill"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def fresh(spark: SparkSession, label: str) -> str:
    """A folder in the shared one that nobody has yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stamp(spark: SparkSession, path: str) -> str:
    """What an input's version key is made of: its path, size, number of files and time of change."""
    fs, at = _fs(spark, path)
    total = fs.getContentSummary(at)
    return f"{path}:{total.getLength()}:{total.getFileCount()}:{fs.getFileStatus(at).getModificationTime()}"


def kept(spark: SparkSession, name: str, key: str, build: Callable[[str], object]) -> str:
    """The folder of what `build(folder)` writes for this key; it is built once, and a failed build leaves nothing behind."""
    root = f"{shared_dir(spark)}/kept/{name}-{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    if not exists(spark, root):
        own = f"{root}-{uuid.uuid4().hex}"
        build(own)
        fs, at = _fs(spark, own)
        to = _fs(spark, root)[1]
        if exists(spark, root) or not fs.rename(at, to):  # another session was first
            delete(spark, own)
    return root
