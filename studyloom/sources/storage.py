"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may go without, and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="studyloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/studyloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *more: DataFrame) -> DataFrame:
    """``df``, and ``more`` of its kind behind it, as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    for part in more:
        part.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if (made := _MADE.get()) is not None:
        made.append(path)
    return out


@contextlib.contextmanager
def made_tables() -> Iterator[list[str]]:
    """The paths of all tables that are written within, also for such a block around this one."""
    paths: list[str] = []
    outer, token = _MADE.get(), _MADE.set(paths)
    try:
        yield paths
    finally:
        _MADE.reset(token)
        if outer is not None:
            outer.extend(paths)


def alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a written table; other tables that it wrote on its way are deleted."""
    with made_tables() as paths:
        out = written(make(), name)
    removed(spark, [p for p in paths if p != out.written_to])
    return out


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables by path; those that are gone already don't matter."""
    context = spark.sparkContext
    for p in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing will read any more."""
    for t in tables:
        removed(t.sparkSession, [t.written_to])


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it has fewer partitions than cores, as a small file has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
