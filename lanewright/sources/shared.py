"""The folder that driver and executors share, and tables written there to cut lineage.

What must be read twice, or must outlive an executor, is written with :func:`materialize` into the folder named by
``spark.checkpoint.dir``, so a lost executor loses nothing and plans stay small.
"""

from __future__ import annotations

import math
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"{tempfile.gettempdir()}/checkpoints"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def tasks_for(source: DataFrame, times: float = 1.0) -> int:
    """How many tasks write a table of ``times`` the bytes of ``source``: 16 MB each, and two a core at least.

    The planner's estimate is exact for files and too large behind joins, which only means more tasks.
    """
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 20, max(8, 2 * source.sparkSession.sparkContext.defaultParallelism, math.ceil(size * times / (16 << 20))))


def materialize(df: DataFrame, label: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there.

    ``tasks``: for what comes out of a shuffle, how many tasks write it at most (:func:`tasks_for`), each some partitions
    one after the other, so that many small partitions do not leave as many small files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lanewright/{uuid.uuid4().hex}/{label}"
    ready = df.coalesce(tasks) if tasks else df
    ready.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(found)] = (weakref.ref(found), path)
    return found


_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`materialize` returned and that nothing reads any more."""
    for df in tables:
        ref, path = _WRITTEN.pop(id(df), (lambda: None, ""))
        if ref() is df:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
