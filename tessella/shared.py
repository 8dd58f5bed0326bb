"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is named, a temporary one, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths of what a folder holds, in order."""
    place, system = _place(spark, path)
    return sorted(s.getPath().toString() for s in system.listStatus(place))


def remove(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one; it is removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    place, system = _place(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and a lost executor costs no earlier step."""
    path = f"{scratch(df.sparkSession, tag)}/data"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt to a few tasks for each core, for work whose time the engine can't tell from bytes, such as Python's."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def drop(*frames: DataFrame) -> None:
    """Remove tables of :func:`written` that no later step reads."""
    for df in frames:
        remove(df.sparkSession, df.written_at)
