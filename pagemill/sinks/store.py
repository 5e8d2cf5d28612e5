"""Small files, copies and removal on any file system that Spark's own readers reach."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write under another name, then rename, so that no reader sees a part of it."""
    fs, where = _fs(spark, path)
    temporary = where.suffix(".new")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(where, False)
    if not fs.rename(temporary, where):
        raise OSError(f"cannot rename {temporary} to {path}")


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or folder, replacing the target."""
    (fs, a), (other, b) = _fs(spark, source), _fs(spark, target)
    other.delete(b, True)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, True, spark._jsc.hadoopConfiguration()):
        raise OSError(f"cannot copy {source} to {target}")


def backup(spark: SparkSession, path: str) -> str:
    """Copy what lies at a path to a path beside it, and return that."""
    target = f"{path.rstrip('/')}.backup"
    copy(spark, path, target)
    return target


def restore(spark: SparkSession, path: str) -> None:
    """Put the backup of a path in its place."""
    target = f"{path.rstrip('/')}.backup"
    if not exists(spark, target):
        raise FileNotFoundError(f"{path} has no backup")
    copy(spark, target, path)


def write_checkpoint(spark: SparkSession, path: str, state: dict[str, Any]) -> None:
    write_text(spark, path, json.dumps(state))


def read_checkpoint(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The state that was written last, or None."""
    return json.loads(read_text(spark, path)) if exists(spark, path) else None


_local: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, spark.checkpoint.dir, or in a folder of this machine where that is unset and Spark is local. It goes when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="pagemill-")
        _local[spark.sparkContext.applicationId] = found
    path = f"{found.rstrip('/')}/pagemill-{name}-{uuid.uuid4().hex}"
    fs, where = _fs(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path
