"""Drawable geometry: outlines as segments and fills as trapezoids, which split into triangles.

A polygon is cut into bands at the heights of its vertices. In a band its edges don't cross, so sorted from left to right they
enclose the fill two by two, holes included (even-odd). Edges are dealt to their bands by the numbers of the heights, so both
joins are equi-joins; the work follows the edges times the bands that they cross, which the grid of a tile bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom, grid
from tessella.operators.spatial import SQUARE, with_tiles
from tessella.sources.clustered import BOX


def trapezoids(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, y0, y1, and the left and right ends of the fill at both: l0, r0, l1, r1. Edges are x1, y1, x2, y2 of closed rings."""
    e = edges.where("y1 <> y2")
    heights = e.select(*by, F.col("y1").alias("y")).union(e.select(*by, F.col("y2"))).distinct()
    order = Window.partitionBy(*by).orderBy("y")
    bands = heights.select(*by, "y", (F.row_number().over(order) - 1).alias("k"), F.lead("y").over(order).alias("y1"))
    ends = bands.select(*by, "y", "k")
    up = e.select(*by, *(F.when(F.col("y1") < F.col("y2"), F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("x1", "x2", "ax"), ("y1", "y2", "ay"), ("x2", "x1", "bx"), ("y2", "y1", "by_"))))
    up = up.join(geom.dealt(ends.select(*by, F.col("y").alias("ay"), F.col("k").alias("from"))), [*by, "ay"]).join(geom.dealt(ends.select(*by, F.col("y").alias("by_"), F.col("k").alias("to"))), [*by, "by_"])
    crossed = up.withColumn("k", F.explode(F.sequence("from", F.col("to") - 1))).join(geom.dealt(bands.select(*by, "k", F.col("y").alias("y0"), "y1")), [*by, "k"])
    at = lambda y: F.col("ax") + (F.col("bx") - F.col("ax")) * ((F.col(y) - F.col("ay")) / (F.col("by_") - F.col("ay")))
    side = crossed.select(*by, "k", "y0", "y1", at("y0").alias("l0"), at("y1").alias("l1"))
    along = Window.partitionBy(*by, "k").orderBy(F.col("l0") + F.col("l1"), "l0")
    paired = side.withColumns({"n": F.row_number().over(along), "r0": F.lead("l0").over(along), "r1": F.lead("l1").over(along)})
    return paired.where("n % 2 = 1 and (r0 > l0 or r1 > l1)").select(*by, "y0", "y1", "l0", "r0", "l1", "r1")


def triangles(fills: DataFrame, by: list[str]) -> DataFrame:
    """One or two triangles for each trapezoid: by, x1, y1, x2, y2, x3, y3."""
    corner = lambda *p: F.struct(*(F.col(c).cast("double").alias(n) for c, n in zip(p, ("x1", "y1", "x2", "y2", "x3", "y3"), strict=True)))
    both = F.array(F.when(F.col("r0") > F.col("l0"), corner("l0", "y0", "r0", "y0", "r1", "y1")), F.when(F.col("r1") > F.col("l1"), corner("l0", "y0", "r1", "y1", "l1", "y1")))
    return fills.select(*by, F.explode(both).alias("t")).where("t is not null").select(*by, "t.*")


def filled_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Segments and fill triangles of each parcel: how many, and the triangles' area, which is that of the rings."""
    edges = geom.segments(fx.parcel_vertices(spark, d), ["fid", "part", "ring"])
    t = triangles(trapezoids(edges, ["fid", "part"]), ["fid", "part"])
    area2 = F.abs((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return edges.groupBy("fid").agg(F.count("*").alias("n_segments")).join(geom.dealt(t.groupBy("fid").agg(F.count("*").alias("n_triangles"), F.round(F.sum(area2) / 2, 5).alias("area"))), "fid")


def drawable_tiles(rings: DataFrame, level: int, deepest: int, min_fill_cells: float) -> tuple[DataFrame, DataFrame]:
    """(segments, fills) of the tiles of a level, in cells of the tile: rings (fid, part, ring, ``p``) cut to the tile and rounded to its grid.

    Rings of faces are closed. A shell of fewer cells than ``min_fill_cells`` gets an outline but no fill, except at the deepest level.
    """
    side, cell = SQUARE.tile_side(level), SQUARE.cell(level, deepest)
    lo = lambda c: F.array_min(F.transform("p", lambda v: v[c]))
    hi = lambda c: F.array_max(F.transform("p", lambda v: v[c]))
    boxed = rings.withColumns({"minx": lo("x"), "miny": lo("y"), "maxx": hi("x"), "maxy": hi("y")})
    tiles = with_tiles(boxed, level, *(F.col(c) for c in BOX))
    left, low = F.lit(SQUARE.x) + F.col("tx") * side, F.lit(SQUARE.y) + F.col("ty") * side
    cut = geom.clip_ring(geom.open_points(F.col("p")), left, low, left + side, low + side)
    snapped = F.transform(cut, lambda v: F.struct(F.round((v["x"] - left) / cell).cast("long").alias("x"), F.round((v["y"] - low) / cell).cast("long").alias("y")))
    key = ["tx", "ty", "fid", "part", "ring"]
    held = tiles.select(*key, geom.only(geom.apart(snapped), lambda p: F.size(p) > 2).alias("p"))
    n = F.size("p")
    pair = F.transform("p", lambda v, i: F.struct(v["x"].alias("x1"), v["y"].alias("y1"), F.col("p")[(i + 1) % n]["x"].alias("x2"), F.col("p")[(i + 1) % n]["y"].alias("y2")))
    segments = held.select(*key, F.abs(geom.ring_area2(F.col("p"))).alias("area2"), F.explode(pair).alias("s")).select(*key, "area2", "s.*")
    face = ["tx", "ty", "fid", "part"]
    drawn = segments
    if level < deepest:
        small = segments.where("ring = 0").where(F.col("area2") < 2 * min_fill_cells).select(*face).distinct()
        drawn = segments.join(geom.dealt(small), face, "left_anti")
    return segments.drop("area2"), trapezoids(drawn.drop("area2"), face)


def drawn_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of level 4 of 6 with the parcels' outlines and fills; shells under 200 cells are not filled."""
    rings = geom.ring_points(fx.parcel_vertices(spark, d), ["fid", "part", "ring"])
    segments, fills = drawable_tiles(rings, 4, 6, 200.0)
    area = F.sum((F.col("r0") - F.col("l0") + F.col("r1") - F.col("l1")) / 2 * (F.col("y1") - F.col("y0")))
    lines = segments.groupBy("tx", "ty").agg(F.count("*").alias("n_segments"))
    return lines.join(fills.groupBy("tx", "ty").agg(F.countDistinct("fid").alias("n_filled"), F.round(area, 3).alias("fill_cells")), ["tx", "ty"], "left").select("tx", "ty", "n_segments", F.coalesce("n_filled", F.lit(0)).alias("n_filled"), F.coalesce("fill_cells", F.lit(0.0)).alias("fill_cells"))


QUERIES = {f.__name__: f for f in (filled_geometry, drawn_tiles)}
_TILE, _CELL = SQUARE.tile_side(4), SQUARE.cell(4, 6)
_AT = "cast(round(({0}-({1}))/" + repr(_CELL) + "e0) as bigint)"
ORACLE_SQL = {
    "filled_geometry": f"with {fx.PARCELS_SQL} select fid, cast(4+4*has_hole as bigint) n_segments, cast(case when has_hole=1 then 8 else 2 end as bigint) n_triangles, round(w*h*(case when has_hole=1 then 0.75e0 else 1e0 end),5) area from parcels",
    "drawn_tiles": f"""with {fx.PARCELS_SQL}, r as (select fid, 0 as ring, x0 a, y0 b, x0+w c, y0+h e from parcels union all select fid, 1, x0+w*0.25e0, y0+h*0.25e0, x0+w*0.75e0, y0+h*0.75e0 from parcels where has_hole=1),
     k as (select unnest(range(16)) k), g as (select r.*, x.k tx, y.k ty, -180e0+x.k*{_TILE}e0 lx, -180e0+y.k*{_TILE}e0 ly from r, k x, k y
      where x.k between floor((a+180e0)/{_TILE}e0) and floor((c+180e0)/{_TILE}e0) and y.k between floor((b+180e0)/{_TILE}e0) and floor((e+180e0)/{_TILE}e0)),
     q as (select fid, ring, tx, ty, {_AT.format('greatest(a,lx)', 'lx')} a, {_AT.format('greatest(b,ly)', 'ly')} b, {_AT.format(f'least(c,lx+{_TILE}e0)', 'lx')} c, {_AT.format(f'least(e,ly+{_TILE}e0)', 'ly')} e from g
      where a<lx+{_TILE}e0 and c>lx and b<ly+{_TILE}e0 and e>ly),
     s as (select *, (c-a)*(e-b) cells from q where c>a and e>b),
     f as (select tx, ty, fid, sum(case when ring=0 then cells else -cells end) cells from s where (tx,ty,fid) in (select (tx,ty,fid) from s where ring=0 and cells>=200) group by 1,2,3),
     n as (select tx, ty, count(*)*4 n_segments from s group by 1,2), t as (select tx, ty, count(*) n_filled, cast(sum(cells) as double) fill_cells from f group by 1,2)
     select cast(tx as int) tx, cast(ty as int) ty, n_segments, coalesce(n_filled,0) n_filled, coalesce(fill_cells,0e0) fill_cells from n left join t using (tx,ty)""",
}
