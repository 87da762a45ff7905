"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it isn't set, a folder of this machine serves if all of
    Spark runs on it; on a cluster that is an error, as executors would write each to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return f"file://{tempfile.gettempdir()}/glossmill-checkpoints"


def fresh(spark: SparkSession, name: str) -> str:
    """A folder of this name that nobody else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def built(spark: SparkSession, name: str, table: str, build: Callable[[str], None]) -> str:
    """The folder of something derived from a table's files: made by ``build`` where these files, by their names, sizes
    and times, haven't been met before, and used again by whoever asks next. It is made aside and then moved, so
    nobody sees half of it."""
    store, p = _place(spark, table)
    found = store.listStatus(p)
    state = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)
    folder = f"{shared_dir(spark)}/{name}-{hashlib.md5(f'{p.toUri().getPath()} {state}'.encode()).hexdigest()}"
    if not exists(spark, folder):
        aside = fresh(spark, name)
        build(aside)
        if not rename(spark, aside, folder):
            delete(spark, aside)  # another one was faster
    return folder


def partitions_for(spark: SparkSession, table: str, each: int) -> int:
    """As many partitions as the table's files have times ``each`` bytes, so a task's share doesn't grow with the table;
    the session's number at least."""
    store, p = _place(spark, table)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-store.getContentSummary(p).getLength() // each))


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file to any store that Spark reaches."""
    store, p = _place(spark, path)
    out = store.create(p)
    out.write(bytearray(content))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _place(spark, path)
    return store.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    store, p = _place(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(p)) if store.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    store, p = _place(spark, path)
    store.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Moves a folder; false if another one has its place already."""
    store, p = _place(spark, old)
    if exists(spark, new):
        return False
    return store.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new))
