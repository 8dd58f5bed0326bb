"""Helpers shared by the corpus operators: shared-folder tables, batch slicing, row keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.shared import shared_dir


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialised_at = path
    return out


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there is removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    place, system = _place(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return f"{path}/data"


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*frames: DataFrame) -> None:
    """Remove tables of :func:`materialise` that no later step reads; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "materialised_at", None):
            place, system = _place(df.sparkSession, path)
            system.delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(n), F.lit(-1))


def pieces(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds at most ``max_bytes`` (one row at least), so memory doesn't follow the batch."""
    for rb in batches:
        sizes = pc.fill_null(pc.binary_length(rb.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > max_bytes or i - start >= max_rows):
                yield rb.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if rb.num_rows > start:
            yield rb.slice(start)


def texts_of(rb: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings; null is the empty string."""
    return [x if x is not None else "" for x in rb.column(column).to_pylist()]
