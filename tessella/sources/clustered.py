"""A clustered layout as a spatial index: boxes ordered along a Z curve, so that files and their row groups have narrow bounds.

Boxes are ordered by size first (by the grid level whose tiles are as wide) and along the curve within a size, so a few
very large boxes share files of their own and don't widen the bounds of others. A read with a window pushes plain comparisons on
the box columns to the scan, which skips every row group whose footer tells that none of its boxes can meet the window.

An index is a folder with ``data`` and, written last, a ``header`` of one row; without a header that fits there is no index.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import fixtures as fx
from tessella.functions import grid
from tessella.shared import exists, remove, scratch

VERSION = 1
BITS = 16  # of each axis on the curve
BOX = ("minx", "miny", "maxx", "maxy")
Window = tuple[float, float, float, float]


def z_order(tx: Column, ty: Column, bits: int = BITS) -> Column:
    """The place on a Z curve: bits of both indices in turn, as one sum of shifted bits."""
    spread = lambda c, k, at: F.shiftleft(F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), at)
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(spread(tx, k, 2 * k)).bitwiseOR(spread(ty, k, 2 * k + 1))
    return out


def size_level(minx: Column, miny: Column, maxx: Column, maxy: Column, square: grid.Square, deepest: int = BITS) -> Column:
    """The deepest level whose tiles are wider and higher than a box."""
    side = F.greatest(maxx - minx, maxy - miny) * 1.000001
    fits = F.floor(F.log2(F.lit(square.side) / side))
    return F.when(side > 0, F.greatest(F.lit(0), F.least(F.lit(deepest), fits))).otherwise(F.lit(deepest)).cast("int")


def write(layer: DataFrame, path: str, square: grid.Square, rows_per_file: int = 1 << 20) -> None:
    """Write a layer with box columns as an index; one that is there is replaced."""
    spark = layer.sparkSession
    remove(spark, path)
    box = [F.col(c) for c in BOX]
    n, side = 1 << BITS, square.side / (1 << BITS)
    middle = lambda a, b, o: grid.tile_index((a + b) / 2, o, side, n)
    curve = layer.withColumn("_size", size_level(*box, square)).withColumn("_z", z_order(middle(box[0], box[2], square.x), middle(box[1], box[3], square.y)))
    rows = layer.count()
    files = max(1, math.ceil(rows / rows_per_file))
    curve.repartitionByRange(files, "_size", "_z").sortWithinPartitions("_size", "_z").drop("_size", "_z").write.parquet(f"{path}/data")
    spark.createDataFrame([(VERSION, rows, layer.schema.json())], "version int, n_rows long, fields string").coalesce(1).write.parquet(f"{path}/header")


def find(spark: SparkSession, path: str) -> DataFrame | None:
    """The index at a path, or None where there is none: no header, another version, no box columns, or rows missing."""
    if not exists(spark, f"{path}/header"):
        return None
    header = spark.read.parquet(f"{path}/header").first()
    if header is None or header.version != VERSION or not exists(spark, f"{path}/data"):
        return None
    index = spark.read.schema(T.StructType.fromJson(json.loads(header.fields))).parquet(f"{path}/data")
    return index if set(BOX) <= set(index.columns) and index.count() == header.n_rows else None


def ensure(layer: DataFrame, path: str, square: grid.Square, rows_per_file: int = 1 << 20) -> DataFrame:
    """The index at a path, built if it isn't there; that it can be opened tells whether building succeeded."""
    found = find(layer.sparkSession, path)
    if found is None:
        write(layer, path, square, rows_per_file)
        found = find(layer.sparkSession, path)
        if found is None:
            raise ValueError(f"no index could be built at {path}")
    return found


def region(index: DataFrame, window: Window) -> DataFrame:
    """Rows whose boxes meet a window; the comparisons reach the scan."""
    x0, y0, x1, y1 = window
    return index.where((F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0))


def file_bounds(index: DataFrame) -> DataFrame:
    """What each file holds: its name, number of rows and bounds."""
    return index.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n_rows"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


WINDOWS: tuple[Window, ...] = ((-30.0, -15.0, 20.0, 25.0), (100.0, 40.0, 110.0, 50.0), (-179.0, -84.0, -160.0, -70.0), (0.0, 0.0, 0.5, 0.5))
_SQUARE = grid.Square(-180.0, -180.0, 360.0)


def _index(spark: SparkSession, layer: DataFrame, files: int) -> DataFrame:
    return ensure(layer, f"{scratch(spark, 'index')}/index", _SQUARE, max(1, layer.count() // files))


def index_region(spark: SparkSession, d: str) -> DataFrame:
    """Parcels and a box around the world that meet each of four windows, read through the index."""
    boxes = fx.parcels(spark, d).selectExpr("fid", "x0 minx", "y0 miny", "x0+w maxx", "y0+h maxy")
    world = spark.createDataFrame([(0, -180.0, -90.0, 180.0, 90.0)], boxes.schema)
    index = _index(spark, boxes.union(world), 16)
    met = None
    for k, w in enumerate(WINDOWS):
        own = region(index, w).select(F.lit(k).alias("q"), "fid")
        met = own if met is None else met.union(own)
    return met.groupBy("q").agg(F.count("*").alias("n"), F.min("fid").alias("first_fid"), F.max("fid").alias("last_fid"))


def index_files(spark: SparkSession, d: str) -> DataFrame:
    """For each of four windows whether at most a quarter of the files of an index over the sites can hold a hit, and the sites in it."""
    sites = fx.sites(spark, d).selectExpr("fid", "x minx", "y miny", "x maxx", "y maxy")
    index = _index(spark, sites, 48)
    files = file_bounds(index)
    total = files.agg(F.count("*").alias("n_files"))
    out = None
    for k, w in enumerate(WINDOWS):
        met = region(files, w).agg(F.count("*").alias("n_met"))
        hits = region(index, w).agg(F.count("*").alias("n_sites"))
        own = met.join(total).join(hits).select(F.lit(k).alias("q"), "n_sites", (F.col("n_met") * 4 <= F.col("n_files")).alias("few"))
        out = own if out is None else out.union(own)
    return out


QUERIES = {f.__name__: f for f in (index_region, index_files)}
_W = "w(q,ax,ay,bx,b_y) as (values " + ",".join(f"({k},{a}e0,{b}e0,{c}e0,{e}e0)" for k, (a, b, c, e) in enumerate(WINDOWS)) + ")"
ORACLE_SQL = {
    "index_region": f"""with {fx.PARCELS_SQL}, {_W}, b as (select fid, x0 minx, y0 miny, x0+w maxx, y0+h maxy from parcels union all select 0, -180e0, -90e0, 180e0, 90e0)
     select q, count(*) n, min(fid) first_fid, max(fid) last_fid from b, w where minx<=bx and maxx>=ax and miny<=b_y and maxy>=ay group by 1""",
    "index_files": f"with {fx.SITES_SQL}, {_W} select q, count(fid) n_sites, true few from w left join sites on x between ax and bx and y between ay and b_y group by 1",
}
