"""What views ask for: levels among those that are built, blocks of a raster, and the scale of the map. Views are rows, one for each supplier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import grid
from tessella.operators.spatial import SQUARE, with_tile


def built_mask(tiles: DataFrame) -> DataFrame:
    """One row: a bit for each level that has tiles."""
    return tiles.select("level").distinct().agg(F.coalesce(F.sum(F.pow(F.lit(2.0), F.col("level").cast("double"))), F.lit(0.0)).cast("long").alias("mask"))


def chosen_level(units_per_pixel: Column, mask: Column, deepest: int = 24, square: grid.Square = SQUARE) -> tuple[Column, Column]:
    """(the level whose cells match the pixels, the deepest built one not beyond it or -1)."""
    wanted = F.when(units_per_pixel > 0, F.greatest(F.lit(0), F.round(F.log2(F.lit(square.side) / (F.lit(float(grid.NET_CELLS)) * units_per_pixel))).cast("int"))).otherwise(F.lit(0))
    built = F.filter(F.sequence(F.lit(0), F.lit(deepest)), lambda k: (k <= wanted) & (F.floor(mask / F.pow(F.lit(2.0), k.cast("double"))) % 2 == 1))
    return wanted, F.coalesce(F.array_max(built), F.lit(-1))


def views(spark: SparkSession, d: str) -> DataFrame:
    """view, cx, cy and scale in degrees a pixel, of windows of 1600 x 900 pixels."""
    return fx.table(spark, d, "supplier").selectExpr(
        "s_suppkey view", "cast((s_suppkey*7919)%3000 as double)/1e1-150e0 cx", "cast((s_suppkey*104729)%1400 as double)/1e1-70e0 cy", "1e0/pow(2e0, cast(s_suppkey%11 as double))+cast(s_suppkey%7 as double)/1e3 scale"
    )


def level_choice(spark: SparkSession, d: str) -> DataFrame:
    """The level that each view wants and gets, of a pyramid of the sites that has every second level up to 5 and the deepest."""
    levels = grid.kept_levels(5, 2)
    s = fx.sites(spark, d).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    tiles = None
    for level in levels:
        own = with_tile(s.where(F.col("level") == level), level).select("level", "tx", "ty").distinct()
        tiles = own if tiles is None else tiles.union(own)
    v = views(spark, d).join(F.broadcast(built_mask(tiles)))  # one row
    wanted, got = chosen_level(F.col("scale"), F.col("mask"), 5)
    return v.select("view", "mask", wanted.alias("wanted"), got.alias("chosen"))


def map_scales(spark: SparkSession, d: str) -> DataFrame:
    """1:N of each view, N rounded to 1, 2 or 5 times a power of ten."""
    return views(spark, d).select("view", grid.map_scale(F.col("scale"), F.col("cy")).alias("n"))


def view_blocks(views: DataFrame, cell: float, x0: float, y1: float, width: int, height: int, screen: tuple[int, int] = (1600, 900)) -> DataFrame:
    """view, span, bx, by: blocks of about 256 pixels a side of a raster (cells of ``cell`` units from its upper left corner) that each view meets.

    Rasters that fit the base image, and views in which a texel of that takes 1.5 pixels at most, need none.
    """
    pixels = F.lit(cell) / F.col("scale")
    longest = max(width, height)
    v = views.withColumn("px", pixels).where((F.lit(longest) > 2048) & (F.col("px") * longest / 1024 > 1.5))
    v = v.withColumn("span", F.greatest(F.lit(1), F.ceil(256 / F.col("px"))).cast("int"))
    at = lambda value, most: F.greatest(F.lit(0), F.least(F.lit(most), F.floor(value / F.col("span")))).cast("int")
    half_w, half_h = F.col("scale") * (screen[0] / 2), F.col("scale") * (screen[1] / 2)
    left, right = (F.col("cx") - half_w - x0) / cell, (F.col("cx") + half_w - x0) / cell
    top, bottom = (F.lit(y1) - F.col("cy") - half_h) / cell, (F.lit(y1) - F.col("cy") + half_h) / cell
    met = v.where((right >= 0) & (left < width) & (bottom >= 0) & (top < height))
    last = lambda n: F.floor(F.lit(n - 1) / F.col("span")).cast("int")
    across = met.withColumn("bx", F.explode(F.sequence(at(left, width - 1), F.least(last(width), at(right, width - 1)))))
    return across.withColumn("by", F.explode(F.sequence(at(top, height - 1), F.least(last(height), at(bottom, height - 1))))).select("view", "span", "bx", "by")


def visible_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that each view asks of a raster of 4096 x 3072 cells over the world's middle: side, how many, first and last."""
    b = view_blocks(views(spark, d), 360 / 4096, -180.0, 135.0, 4096, 3072)
    return b.groupBy("view", "span").agg(F.count("*").alias("n"), F.min("bx").alias("bx0"), F.max("bx").alias("bx1"), F.min("by").alias("by0"), F.max("by").alias("by1"))


QUERIES = {f.__name__: f for f in (level_choice, map_scales, visible_blocks)}
_VIEWS = """v as (select s_suppkey as "view", cast((s_suppkey*7919)%3000 as double)/1e1-150e0 cx, cast((s_suppkey*104729)%1400 as double)/1e1-70e0 cy, 1e0/pow(2e0, s_suppkey%11)+cast(s_suppkey%7 as double)/1e3 scale from supplier)"""
_C = repr(360 / 4096)
ORACLE_SQL = {
    "level_choice": f"""with {_VIEWS}, b as (select unnest([0,2,4,5]) l), w as (select "view", cast(greatest(0, round(log2(360e0/(512e0*scale)))) as int) wanted from v)
     select "view", cast(53 as bigint) mask, wanted, (select max(l) from b where l<=wanted) chosen from w""",
    "map_scales": f"""with {_VIEWS}, n as (select "view", scale*111319.49e0*cos(radians(cy))/0.000264583e0 n from v), p as (select *, pow(10e0, floor(log10(n))) p from n)
     select "view", cast((case when n/p<1.5 then 1e0 when n/p<3.5 then 2e0 when n/p<7.5 then 5e0 else 10e0 end)*p as bigint) n from p""",
    "visible_blocks": f"""with {_VIEWS}, p as (select *, cast(greatest(1, ceil(256/({_C}e0/scale))) as int) span from v where ({_C}e0/scale)*4096/1024>1.5),
     c as (select *, (cx-scale*800+180)/{_C}e0 l, (cx+scale*800+180)/{_C}e0 r, (135-cy-scale*450)/{_C}e0 t, (135-cy+scale*450)/{_C}e0 b from p),
     k as (select "view", span, cast(greatest(0, floor(l/span)) as int) bx0, cast(least(floor(4095/span), floor(r/span)) as int) bx1, cast(greatest(0, floor(t/span)) as int) by0, cast(least(floor(3071/span), floor(b/span)) as int) by1 from c where r>=0 and l<4096 and b>=0 and t<3072)
     select "view", span, cast((bx1-bx0+1)*(by1-by0+1) as bigint) n, bx0, bx1, by0, by1 from k""",
}
