"""Stacks of grids (time, row, column) stored in blocks, as a data source of the engine.

A store is a folder with ``meta.json`` and one file a block. Reading gives one partition a block; filters on time, row and column
leave out whole blocks before any is opened, and what they leave undecided is cut inside a block's reader. Writing takes
rows t, row_, col, z dealt by block; ``meta.json`` comes last, so a store that isn't whole can't be opened. Files are reached by
pyarrow's file systems, from a URI or a path that all executors see.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tessella import fixtures as fx
from tessella.functions import crs
from tessella.operators import raster
from tessella.shared import scratch

NAME = "tessella_array"
SCHEMA = "t int, row_ int, col int, z double"
AXES = ("t", "row_", "col")


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def _block_name(path: str, t: int, by: int, bx: int) -> str:
    return f"{path}/t={t}/{by}-{bx}.npy"


def meta(path: str) -> dict:
    """Shape (t, rows, columns), block (rows, columns) and the blocks that exist."""
    system, where = _place(path)
    with system.open_input_stream(f"{where}/meta.json") as f:
        return json.loads(f.read())


@dataclass
class Block(InputPartition):
    t: int
    by: int
    bx: int


@dataclass
class Written(WriterCommitMessage):
    blocks: list[tuple[int, int, int]]


class ArrayReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.lo = {a: -(1 << 31) for a in AXES}
        self.hi = {a: (1 << 31) - 1 for a in AXES}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the axes are taken over whole; all other filters stay with the engine."""
        for f in filters:
            axis = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if axis not in AXES or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.lo[axis] = max(self.lo[axis], f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.hi[axis] = min(self.hi[axis], f.value - isinstance(f, LessThan))

    def partitions(self) -> list[Block]:
        m = meta(self.path)
        rows, cols = m["block"]
        inside = lambda a, lo, hi: lo <= self.hi[a] and hi >= self.lo[a]
        met = [Block(t, by, bx) for t, by, bx in m["blocks"] if inside("t", t, t) and inside("row_", by * rows, by * rows + rows - 1) and inside("col", bx * cols, bx * cols + cols - 1)]
        return met or [Block(-1, -1, -1)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if block.t < 0:
            return
        rows, cols = meta(self.path)["block"]
        system, where = _place(self.path)
        with system.open_input_stream(_block_name(where, block.t, block.by, block.bx)) as f:
            z = np.load(io.BytesIO(f.read()))
        r, c = np.nonzero(~np.isnan(z))
        row, col = r + block.by * rows, c + block.bx * cols
        keep = (row >= self.lo["row_"]) & (row <= self.hi["row_"]) & (col >= self.lo["col"]) & (col <= self.hi["col"])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), block.t, np.int32)), pa.array(row[keep].astype(np.int32)), pa.array(col[keep].astype(np.int32)), pa.array(z[r[keep], c[keep]])], ["t", "row_", "col", "z"])


class ArrayWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.shape = [int(x) for x in options["shape"].split(",")]
        self.block = [int(x) for x in options["block"].split(",")]

    def write(self, rows: Iterator) -> Written:
        """Rows of a block must follow each other; a block is in memory at a time."""
        system, where = _place(self.path)
        own, z, done = None, None, []

        def close() -> None:
            if own is not None:
                data = io.BytesIO()
                np.save(data, z)
                name = _block_name(where, *own)
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name) as f:
                    f.write(data.getvalue())
                done.append(own)

        for r in rows:
            at = (r.t, r.row_ // self.block[0], r.col // self.block[1])
            if at != own:
                close()
                own, z = at, np.full(self.block, np.nan)
            z[r.row_ % self.block[0], r.col % self.block[1]] = np.nan if r.z is None else r.z
        close()
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        system, where = _place(self.path)
        system.create_dir(where, recursive=True)
        blocks = sorted(b for m in messages if m for b in m.blocks)
        with system.open_output_stream(f"{where}/meta.json") as f:
            f.write(json.dumps({"shape": self.shape, "block": self.block, "blocks": blocks}).encode())


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options)


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArraySource)


def write(cells: DataFrame, path: str, shape: tuple[int, int, int], block: tuple[int, int]) -> None:
    """Write cells t, row_, col, z of a stack; cells that are missing or null hold no value."""
    _register(cells.sparkSession)
    by = [F.floor(F.col("row_") / block[0]), F.floor(F.col("col") / block[1])]
    dealt = cells.select(*(F.col(a).cast("int") for a in AXES), F.col("z").cast("double")).repartition("t", *by).sortWithinPartitions("t", *by)
    dealt.write.format(NAME).option("shape", ",".join(map(str, shape))).option("block", ",".join(map(str, block))).mode("append").save(path)


def open_array(spark: SparkSession, path: str) -> DataFrame:
    """Cells t, row_, col, z of a store."""
    _register(spark)
    return spark.read.format(NAME).load(path)


def time_slice(stack: DataFrame, t: int) -> DataFrame:
    """One grid of a stack; a negative time is the first."""
    return stack.where(F.col("t") == max(0, t)).select("col", "row_", "z")


def window(stack: DataFrame, col0: int, row0: int, cols: int, rows: int) -> DataFrame:
    return stack.where((F.col("col") >= col0) & (F.col("col") < col0 + cols) & (F.col("row_") >= row0) & (F.col("row_") < row0 + rows))


def yearly(spark: SparkSession, d: str) -> DataFrame:
    """The terrain's grid by year of shipping: t, row_, col, z."""
    t = fx.table(spark, d, "lineitem").selectExpr("cast(year(l_shipdate)-1992 as int) t", "cast(l_orderkey%48 as int) row_", "cast(l_partkey%64 as int) col", "l_quantity q")
    return t.groupBy("t", "row_", "col").agg(F.round(F.sum("q") / F.count("*"), 6).alias("z"))


def array_slice(spark: SparkSession, d: str) -> DataFrame:
    """A window of one year, read from a stack of blocks written from the given table."""
    path = f"{scratch(spark, 'array')}/stack"
    write(yearly(spark, d), path, (7, 48, 64), (16, 16))
    return window(time_slice(open_array(spark, path), 3), 18, 8, 20, 10)


def block_rectangles(spark: SparkSession, d: str) -> DataFrame:
    """The world rectangle of each block of 20 x 20 cells of the terrain, on a turned grid, in degrees and in metres."""
    turned = (-120.0, 1.5, 0.25, 60.0, 0.125, -2.0)
    blocks = fx.dem(spark, d).select(F.floor(F.col("col") / 20).cast("int").alias("bx"), F.floor(F.col("row_") / 20).cast("int").alias("by")).distinct()
    rect = raster.block_rectangle(F.col("bx") * 20, F.col("by") * 20, F.lit(20), F.lit(20), raster.W, raster.H, turned)
    named = blocks.select("bx", "by", *(c.alias(n) for c, n in zip(rect, ("minx", "miny", "maxx", "maxy"), strict=True)))
    metres = crs.reproject_bbox(tuple(F.col(c) for c in ("minx", "miny", "maxx", "maxy")), 4326, 3857)
    return named.select("bx", "by", *(F.round(c, 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")), F.round(metres[2] - metres[0], 3).alias("width_m"))


QUERIES = {f.__name__: f for f in (array_slice, block_rectangles)}
ORACLE_SQL = {
    "array_slice": """select cast(l_partkey%64 as int) col, cast(l_orderkey%48 as int) row_, round(sum(l_quantity)/count(*),6) z from lineitem
     where year(l_shipdate)=1995 and l_partkey%64 between 18 and 37 and l_orderkey%48 between 8 and 17 group by 1,2""",
    "block_rectangles": f"""with {fx.DEM_SQL}, b as (select distinct col//20 bx, row_//20 by_ from dem),
     k as (select *, unnest([0,1,0,1]) i, unnest([0,0,1,1]) j from b), c as (select bx, by_, least(64, bx*20+i*20) c, least(48, by_*20+j*20) r from k),
     p as (select bx, by_, -120e0+c*1.5e0+r*0.25e0 x, 60e0+c*0.125e0-r*2e0 y from c)
     select cast(bx as int) bx, cast(by_ as int) as by, round(min(x),6) minx, round(min(y),6) miny, round(max(x),6) maxx, round(max(y),6) maxy, round((max(x)-min(x))*20037508.342789244e0/180e0,3) width_m from p group by 1,2""",
}
