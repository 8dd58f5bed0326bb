"""Boxes stored once in a quadtree, asked by points and views.

A box is stored once: at the deepest level whose tiles are larger than it, under the tile of its lower-left corner. So it can
reach into the next tile to the right and above only, and a point finds every box around it under its own tile and the three
to the left and below, at each level that holds boxes (17 at most). No box is repeated over tiles, however large it is. Both
sides of the join are dealt by plain keys, so the engine can split a tile that many points ask for, such as the whole grid's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom, grid
from tessella.operators.spatial import SQUARE, box_join
from tessella.sources.clustered import BITS, BOX, size_level

_TILE = ["_level", "_tx", "_ty"]


def _tile(v: Column, origin: float, side: float, level: Column) -> Column:
    """Index of the tile of a level that holds a coordinate, clamped to the grid."""
    at = F.floor((v - F.lit(origin)) / (F.lit(side) * F.pow(F.lit(2.0), -level.cast("double")))).cast("long")
    return F.greatest(F.lit(0), F.least(F.pow(F.lit(2.0), level.cast("double")).cast("long") - 1, at))


def stored(boxes: DataFrame, square: grid.Square = SQUARE, deepest: int = BITS, prefix: str = "") -> DataFrame:
    """Boxes (in columns minx and so on, with a prefix) with the one tile that each is kept under."""
    box = [F.col(prefix + c) for c in BOX]
    b = boxes.withColumn("_level", size_level(*box, square, deepest))
    return b.withColumn("_tx", _tile(box[0], square.x, square.side, F.col("_level"))).withColumn("_ty", _tile(box[1], square.y, square.side, F.col("_level")))


def around_points(points: DataFrame, boxes: DataFrame, reach: float = 0.0, square: grid.Square = SQUARE, deepest: int = BITS, by: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of points (x, y) and boxes that hold them, up to ``reach``, within equal ``by`` (columns of points and boxes).

    Other columns of boxes and points must differ.
    """
    wide = boxes.withColumns({"_minx": F.col("minx") - reach, "_miny": F.col("miny") - reach, "_maxx": F.col("maxx") + reach, "_maxy": F.col("maxy") + reach})
    kept = stored(wide, square, deepest, "_")
    levels = sorted(r[0] for r in kept.select("_level").distinct().collect())  # deepest + 1 at most
    asks = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))) if levels else points.withColumn("_level", F.lit(0)).limit(0)
    for axis, origin, name in (("x", square.x, "_tx"), ("y", square.y, "_ty")):
        own = _tile(F.col(axis), origin, square.side, F.col("_level"))
        asks = asks.withColumn(name, own).withColumn(name, F.explode(F.when(F.col(name) > 0, F.array(F.col(name), F.col(name) - 1)).otherwise(F.array(F.col(name)))))
    inside = (F.col("x") >= F.col("_minx")) & (F.col("x") <= F.col("_maxx")) & (F.col("y") >= F.col("_miny")) & (F.col("y") <= F.col("_maxy"))
    for point, box in by or []:
        kept = kept.withColumnRenamed(box, point)
    return asks.join(geom.dealt(kept), [*_TILE, *(p for p, _ in by or [])]).where(inside).drop(*_TILE, *(f"_{c}" for c in BOX))


def rings_at_points(spark: SparkSession, d: str) -> DataFrame:
    """For each ring of the parcels, and a ring around the world: how many sites its box holds, and the share of the box that is filled."""
    v = fx.parcel_vertices(spark, d)
    box = v.groupBy("fid", "part", "ring").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    area = geom.double_area(geom.segments(v, ["fid", "part", "ring"]), ["fid", "part", "ring"]).select("fid", "part", "ring", (F.abs("area2") / 2).alias("area"))
    # A hole's box is empty; a shell's is filled but for its holes.
    holes = area.where("ring > 0").groupBy("fid", "part").agg(F.sum("area").alias("gone"))
    filled = area.join(geom.dealt(holes), ["fid", "part"], "left").select("fid", "part", "ring", F.when(F.col("ring") > 0, 0.0).otherwise(F.col("area") - F.coalesce("gone", F.lit(0.0))).alias("filled"))
    rings = box.join(geom.dealt(filled), ["fid", "part", "ring"]).select("fid", "ring", *BOX, F.round(F.col("filled") / ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))), 6).alias("share"))
    world = spark.createDataFrame([(0, 0, -180.0, -90.0, 180.0, 90.0, 1.0)], rings.schema)
    sites = fx.sites(spark, d).select(F.col("fid").alias("site"), "x", "y")
    return around_points(sites, rings.union(world), 1e-9).groupBy("fid", "ring", "share").agg(F.count("*").alias("n_sites"), F.min("site").alias("first_site"))


def culled(views: DataFrame, buckets: DataFrame, margin_x: float, margin_y: float, level: int, bytes_per_frame: int) -> DataFrame:
    """Buckets that each view wants, its rectangle widened by a margin, and the frame in which each is sent: frames take up to a number of bytes."""
    wide = views.withColumns({"minx": F.col("minx") - margin_x, "maxx": F.col("maxx") + margin_x, "miny": F.col("miny") - margin_y, "maxy": F.col("maxy") + margin_y})
    wanted = box_join(wide, buckets, level)
    before = F.coalesce(F.sum("r_bytes").over(Window.partitionBy("view").orderBy("r_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return wanted.select("view", F.col("r_bucket").alias("bucket"), F.col("r_bytes").alias("bytes"), F.floor(before / bytes_per_frame).alias("frame"))


def culled_buckets(spark: SparkSession, d: str) -> DataFrame:
    """One view for each supplier over a grid of 24 x 12 buckets of the sites: buckets wanted, their sites and the frames they take."""
    s = fx.sites(spark, d)
    cell = lambda c, o, n: F.least(F.lit(n - 1), F.floor((F.col(c) + o) / 15.0)).cast("long")
    b = s.groupBy((cell("y", 90.0, 12) * 24 + cell("x", 180.0, 24)).alias("bucket")).agg(F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"), (F.count("*") * 8).alias("bytes"))
    v = fx.table(spark, d, "supplier").selectExpr("s_suppkey view", "cast((s_suppkey*7919)%3000 as double)/1e1-150e0 cx", "cast((s_suppkey*104729)%1400 as double)/1e1-70e0 cy", "cast(1+s_suppkey%8 as double)*5e0 half")
    views = v.selectExpr("view", "cx-half minx", "cy-half/2 miny", "cx+half maxx", "cy+half/2 maxy")
    return culled(views, b, 7.5, 7.5, 4, 1024).groupBy("view").agg(F.count("*").alias("n_buckets"), (F.sum("bytes") / 8).cast("long").alias("n_sites"), (F.max("frame") + 1).alias("n_frames"))


QUERIES = {f.__name__: f for f in (rings_at_points, culled_buckets)}
ORACLE_SQL = {
    "rings_at_points": f"""with {fx.PARCELS_SQL}, {fx.SITES_SQL}, r as (select fid, 0 as ring, x0 minx, y0 miny, x0+w maxx, y0+h maxy, case when has_hole=1 then 0.75e0 else 1e0 end as share from parcels
      union all select fid, 1, x0+w*0.25e0, y0+h*0.25e0, x0+w*0.75e0, y0+h*0.75e0, 0e0 from parcels where has_hole=1 union all select 0, 0, -180e0, -90e0, 180e0, 90e0, 1e0)
     select r.fid, ring, share, count(*) n_sites, min(s.fid) first_site from sites s join r on x between minx-1e-9 and maxx+1e-9 and y between miny-1e-9 and maxy+1e-9 group by 1,2,3""",
    "culled_buckets": f"""with {fx.SITES_SQL}, c as (select *, cast(least(11, floor((y+90e0)/15e0)) as bigint)*24+cast(least(23, floor((x+180e0)/15e0)) as bigint) bucket from sites),
     b as (select bucket, min(x) minx, max(x) maxx, min(y) miny, max(y) maxy, count(*)*8 bytes from c group by 1),
     v as (select s_suppkey as "view", cast((s_suppkey*7919)%3000 as double)/1e1-150e0 cx, cast((s_suppkey*104729)%1400 as double)/1e1-70e0 cy, cast(1+s_suppkey%8 as double)*5e0 half from supplier),
     w as (select "view", bucket, bytes from v join b on minx<=cx+half+7.5e0 and maxx>=cx-half-7.5e0 and miny<=cy+half/2+7.5e0 and maxy>=cy-half/2-7.5e0),
     f as (select *, floor(coalesce(sum(bytes) over (partition by "view" order by bucket rows between unbounded preceding and 1 preceding),0)/1024) frame from w)
     select "view", count(*) n_buckets, cast(sum(bytes)/8 as bigint) n_sites, cast(max(frame) as bigint)+1 n_frames from f group by 1""",
}
