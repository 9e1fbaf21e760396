"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths written by this process, with the Hadoop settings to reach them.
_WRITTEN: list[tuple[str, object]] = []


def forget() -> None:
    """Deletes the tables this process has written; runs at exit, when no result can be read any more."""
    from pyspark import SparkContext

    while _WRITTEN:
        path, settings = _WRITTEN.pop()
        with contextlib.suppress(Exception):  # the JVM may have gone first
            at = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(settings).delete(at, True)


atexit.register(forget)


#: The folder of a local session without ``spark.checkpoint.dir``, made when it is first needed.
_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A local session may leave it unset, and has a temporary folder then; a cluster may not,
    since its executors would not see the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share; the master is {master}")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="vicinal-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = f"{folder(spark)}/vicinal/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((path, spark._jsc.hadoopConfiguration()))
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back, so later stages neither recompute it nor lose it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vicinal_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table of a ``settled`` frame that nothing reads any more."""
    path = getattr(df, "_vicinal_path", None)
    for entry in [w for w in _WRITTEN if w[0] == path]:
        _WRITTEN.remove(entry)
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(entry[1]).delete(at, True)


def spread(df: DataFrame, least: int = 4 << 20) -> DataFrame:
    """A scan of less than ``least`` bytes a core is dealt to all cores, as its few row groups would keep most idle.
    Larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < least * cores else df
