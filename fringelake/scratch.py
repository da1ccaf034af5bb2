"""Tables in the folder that all executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


class _Made(threading.local):
    """The tables that one thread has made, so that queries in several threads leave each other's alone."""

    def __init__(self):
        self.tables: list[DataFrame] = []


_made = _Made()


def root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary folder in local mode; on a cluster, whose
    machines share no such folder, a RuntimeError."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    own = context._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fringelake-"))
        own = context._jsc.sc().getCheckpointDir()
    return own.get()


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: computed once, without its lineage. The files go when
    the driver's JVM ends, or with discard()."""
    spark = df.sparkSession
    path = f"{root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    _made.tables.append(out)
    return out


def made() -> int:
    """How many tables scratch() has made in this thread: a mark for discard_since()."""
    return len(_made.tables)


def discard_since(mark: int, *kept: DataFrame) -> None:
    """Delete the tables that this thread has made since the mark, but those kept."""
    since = _made.tables[mark:]
    discard(*[t for t in since if all(t is not k for k in kept)])
    _made.tables[mark:] = [t for t in since if any(t is k for k in kept)]


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of scratch() that no later result reads; None is passed over."""
    for df in tables:
        if df is not None:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
