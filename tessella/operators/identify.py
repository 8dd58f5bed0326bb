"""Features of several parts, and what lies under a click: all attributes, of points, lines and polygons.

A click reaches so many pixels. Where the map's system differs from the layer's, its reach there is the distance between two
reprojected points, the click and the place a reach to its right. Candidates come from an equi-join of the tiles that a click's box and
the features' boxes meet; only the vertices of candidates are then read and measured.

Where features lie many deep, most candidates can't win. So clicks are first held against the polygons of the smallest fids, then against eight
times as many, and so on: a click inside one of them is settled, as no other is nearer and none with a smaller fid is left. All others
look for features within a small part of their reach, then further: what is found there is nearer than all that wasn't looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import crs, geom
from tessella.operators.spatial import SQUARE, box_join
from tessella.shared import written

PIXELS = 10
FIRST = 3  # the first polygons looked at are 8 ** FIRST or more
FINEST = 14
SHARES = (1 / 16, 1 / 4, 1)  # of the reach, one after another


@dataclass(frozen=True)
class Layer:
    """``vertices`` in vertex form (points: fid, x, y), ``attributes`` with fid and any columns."""

    name: str
    kind: int
    vertices: DataFrame
    attributes: DataFrame


def clicks_in(clicks: DataFrame, units_per_pixel: float, src: int, dst: int) -> DataFrame:
    """Clicks (q, x, y) of a map in ``src`` as q, qx, qy, tol and box columns in ``dst``."""
    reach = PIXELS * abs(units_per_pixel)
    at, beside = (crs.reproject(F.col("x") + dx, F.col("y"), src, dst) for dx in (0.0, reach))
    c = clicks.select("q", at[0].alias("qx"), at[1].alias("qy"), F.hypot(beside[0] - at[0], beside[1] - at[1]).alias("tol"))
    return c.withColumns({"minx": F.expr("qx - tol"), "miny": F.expr("qy - tol"), "maxx": F.expr("qx + tol"), "maxy": F.expr("qy + tol")})


def _described(attributes: DataFrame) -> DataFrame:
    """fid and all attributes, in the order of their columns, as name=value lines; nulls are spelled NULL."""
    names = [c for c in attributes.columns if c != "fid"]
    return attributes.select("fid", F.concat_ws("\n", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in names)).alias("attributes"))


def _hits(clicks: DataFrame, layer: Layer, boxes: DataFrame, vertices: DataFrame, level: int, at_only: bool = False) -> DataFrame:
    """The nearest feature within ``tol`` of each click, ties to the smallest fid: q, b (d, fid)."""
    key = [c for c in ("fid", "part", "ring") if c in vertices.columns]
    part = [c for c in key if c != "ring"]
    near = box_join(clicks, boxes, level).select("q", "qx", "qy", "tol", *(F.col(f"r_{c}").alias(c) for c in [*part, *(c for c in ("x", "y") if c in boxes.columns)]))
    if layer.kind == geom.POINT:
        hit = near.select("q", "tol", "fid", F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy")).alias("d"))
    else:
        own = vertices.join(near.select(*part).distinct(), part, "left_semi")
        ends = [F.col(c) for c in ("qx", "qy", "x1", "y1", "x2", "y2")]
        odd = F.sum(geom.crosses_ray(*ends).cast("int")) % 2 == 1
        inside = odd if layer.kind == geom.FACE else F.lit(False)
        hit = near.join(geom.dealt(geom.segments(own, key)), part).groupBy("q", "tol", *part).agg(F.min(geom.segment_distance(*ends)).alias("d"), inside.alias("inside"))
        hit = hit.withColumn("d", F.when(F.col("inside"), 0.0).otherwise(F.col("d")))
        hit = hit.where("d = 0") if at_only else hit
    return hit.where("d <= tol").groupBy("q").agg(F.min(F.struct("d", "fid")).alias("b"))


def identify(clicks: DataFrame, layer: Layer, level: int) -> DataFrame:
    """The nearest feature within reach of each click, ties to the smallest fid: q, layer, fid, distance, attributes."""
    part = [c for c in ("fid", "part") if c in layer.vertices.columns]  # parts of a feature may lie far apart, so each has a box of its own
    if layer.kind == geom.POINT:  # points that fall together count once, with the smallest fid
        boxes = layer.vertices.groupBy("x", "y").agg(F.min("fid").alias("fid")).withColumns({c: F.col(c[3:]) for c in ("minx", "miny", "maxx", "maxy")})
    else:
        boxes = layer.vertices.groupBy(*part).agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    boxes, left, found = written(boxes, "boxes"), written(clicks, "clicks"), []

    reach, extent = clicks.agg(F.max("tol")).first()[0] or 0.0, boxes.agg(F.avg(F.greatest(F.expr("maxx - minx"), F.expr("maxy - miny")))).first()[0] or 0.0

    def settle(asked: DataFrame, of: DataFrame, vertices: DataFrame, share: float = 0.0, **how: bool) -> DataFrame:
        # tiles as small as what is looked for, so that few pairs meet in one that are far apart
        at = max(level, min(FINEST, int(math.log2(SQUARE.side / max(4 * reach * share, extent, SQUARE.side / 2**FINEST)))))
        found.append(written(_hits(asked, layer, of, vertices, at, **how), "found"))
        return written(left.join(geom.dealt(found[-1].select("q")), "q", "left_anti"), "clicks")

    if layer.kind == geom.FACE:
        n = boxes.select("fid").distinct().count()
        shares = [1 / 8**k for k in range(max(0, int(math.log(max(1, n), 8)) - FIRST), 0, -1)]
        for upto in boxes.select(F.percentile_approx("fid", shares or [1.0])).first()[0] or [] if shares else []:
            at = left.withColumns({"minx": F.col("qx"), "miny": F.col("qy"), "maxx": F.col("qx"), "maxy": F.col("qy")})
            left = settle(at, boxes.where(F.col("fid") <= upto), layer.vertices.where(F.col("fid") <= upto), at_only=True)
    for share in SHARES:
        asked = left.withColumn("tol", F.col("tol") * share)
        asked = asked.withColumns({f"{e}{a}": F.expr(f"q{a} {o} tol") for e, o in (("min", "-"), ("max", "+")) for a in ("x", "y")})
        left = settle(asked if share < 1 else left, boxes, layer.vertices, share)
    best = reduce(DataFrame.union, found).select("q", F.lit(layer.name).alias("layer"), F.col("b.fid").alias("fid"), F.col("b.d").alias("distance"))
    return best.join(_described(layer.attributes), "fid").select("q", "layer", "fid", "distance", "attributes")


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    """Parcels as polygons of several parts: ten neighbours by number are one feature."""
    v = fx.parcel_vertices(spark, d)
    return v.select(F.floor(F.col("fid") / 10).alias("fid"), (F.col("fid") % 10).cast("int").alias("part"), "ring", "seq", "x", "y")


def multi_wkt(spark: SparkSession, d: str) -> DataFrame:
    """Text of polygons, lines and points of several parts, in eightieths of a degree."""
    whole = lambda v: v.withColumns({c: F.round(F.col(c) * 80).cast("long") for c in ("x", "y")})
    faces = geom.wkt(whole(_grouped(spark, d)), geom.FACE)
    t = fx.tracks(spark, d).where("seq < 12")
    lines = geom.wkt(whole(t.select("fid", F.floor(F.col("seq") / 4).cast("int").alias("part"), "seq", "x", "y")), geom.LINE)
    s = fx.sites(spark, d)
    points = geom.wkt(whole(s.select(F.floor(F.col("fid") / 16).alias("fid"), F.col("fid").alias("part"), "x", "y")), geom.POINT)
    return faces.withColumn("layer", F.lit("parcels")).union(lines.withColumn("layer", F.lit("tracks"))).union(points.withColumn("layer", F.lit("sites")))


def identify_all(spark: SparkSession, d: str) -> DataFrame:
    """What lies under clicks at every customer's place on a map in metres, in three layers in degrees."""
    clicks = fx.table(spark, d, "customer").selectExpr("c_custkey q", "cast((c_custkey*7919)%30000000 as double)-15000000e0 x", "cast((c_custkey*104729)%16000000 as double)-8000000e0 y")
    here = clicks_in(clicks, 4000.0, 3857, 4326)
    attributes = fx.parcels(spark, d).groupBy(F.floor(F.col("fid") / 10).alias("fid")).agg(F.count("*").alias("n_parts"), F.min("brand").alias("brand"), F.sum("has_hole").alias("n_holes"))
    people = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("fid")).agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))
    layers = (
        Layer("sites", geom.POINT, fx.sites(spark, d).select("fid", "x", "y"), fx.sites(spark, d).select("fid", "status", F.round("amount", 0).cast("long").alias("amount"))),
        Layer("tracks", geom.LINE, fx.tracks(spark, d), people), Layer("parcels", geom.FACE, _grouped(spark, d), attributes),
    )
    out = None
    for layer in layers:
        hit = identify(here, layer, 6)
        out = hit if out is None else out.union(hit)
    return out.withColumn("distance", F.round("distance", 6))


QUERIES = {f.__name__: f for f in (multi_wkt, identify_all)}
_LON, _LAT = "({0})/20037508.342789244e0*180e0", "degrees(2*atan(exp(({0})/6378137e0))-pi()/2)"
_TEXT = "cast(cast(round(x*80) as bigint) as varchar)||' '||cast(cast(round(y*80) as bigint) as varchar)"
ORACLE_SQL = {
    "multi_wkt": f"""with {fx.VERTICES_SQL}, {fx.TRACKS_SQL}, {fx.SITES_SQL}, r as (select fid//10 fid, fid%10 part, ring, '('||string_agg({_TEXT}, ', ' order by seq)||')' t from parcel_vertices group by 1,2,3),
     p as (select fid, part, '('||string_agg(t, ', ' order by ring)||')' t from r group by 1,2), l as (select fid, seq//4 part, '('||string_agg({_TEXT}, ', ' order by seq)||')' t from tracks where seq<12 group by 1,2),
     s as (select fid//16 fid, fid part, '('||{_TEXT}||')' t from sites),
     a as (select 'parcels' layer, 'POLYGON' k, * from p union all select 'tracks', 'LINESTRING', * from l union all select 'sites', 'POINT', * from s)
     select fid, case when count(*)>1 then 'MULTI'||k||' ('||string_agg(t, ', ' order by part)||')' else k||' '||min(t) end wkt, layer from a group by layer, k, fid""",
    "identify_all": f"""with {fx.VERTICES_SQL}, {fx.TRACKS_SQL}, {fx.SITES_SQL}, m as (select c_custkey q, cast((c_custkey*7919)%30000000 as double)-15000000e0 x, cast((c_custkey*104729)%16000000 as double)-8000000e0 y from customer),
     c as (select q, {_LON.format('x')} qx, {_LAT.format('y')} qy, abs({_LON.format('x+40000e0')}-{_LON.format('x')}) tol from m),
     v as (select 'tracks' layer, fid, fid k, 0 as part, 0 as ring, seq, x, y from tracks union all select 'parcels', fid//10, fid, 0, ring, seq, x, y from parcel_vertices),
     e as (select layer, fid, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from v window w as (partition by layer, k, ring order by seq)),
     n as (select q, tol, layer, fid, qx, qy, x1, y1, x2, y2, greatest(0e0, least(1e0, case when x1=x2 and y1=y2 then 0e0 else ((qx-x1)*(x2-x1)+(qy-y1)*(y2-y1))/(pow(x2-x1,2)+pow(y2-y1,2)) end)) t from e, c
      where x2 is not null and (layer='parcels' and qx between -160 and 170 or abs(qx-x1)<1 and abs(qy-y1)<1)),
     g as (select q, tol, layer, fid, min(sqrt(pow(qx-x1-t*(x2-x1),2)+pow(qy-y1-t*(y2-y1),2))) d, sum(case when (y1>qy)<>(y2>qy) and qx<(x2-x1)*(qy-y1)/(y2-y1)+x1 then 1 else 0 end)%2 odd from n group by 1,2,3,4),
     h as (select q, tol, layer, fid, case when layer='parcels' and odd=1 then 0e0 else d end d from g union all select q, tol, 'sites', fid, sqrt(pow(x-qx,2)+pow(y-qy,2)) from sites, c where abs(x-qx)<1 and abs(y-qy)<1),
     b as (select *, row_number() over (partition by q, layer order by d, fid) r from h where d<=tol),
     t as (select 'sites' layer, fid, 'status='||status||chr(10)||'amount='||cast(cast(round(amount) as bigint) as varchar) a from sites
      union all select 'tracks', user_id, 'n_events='||cast(count(*) as varchar)||chr(10)||'first_event='||cast(min(event_id) as varchar) from events group by 2
      union all select 'parcels', fid//10, 'n_parts='||cast(count(*) as varchar)||chr(10)||'brand='||min(brand)||chr(10)||'n_holes='||cast(sum(has_hole) as varchar) from parcels group by 2)
     select q, b.layer, b.fid, round(d,6) distance, a attributes from b join t on b.layer=t.layer and b.fid=t.fid where r=1""",
}
