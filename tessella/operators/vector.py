"""Queries over vertices, segments and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import crs, geom, grid

RING = ["fid", "part", "ring"]
SQUARE = grid.Square(-180.0, -180.0, 360.0)
_EDGES_SQL = "edges as (select * from (select fid, part, ring, seq, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from parcel_vertices window w as (partition by fid, part, ring order by seq)) where x2 is not null)"
_TRACK_EDGES_SQL = "edges as (select * from (select fid, seq, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from tracks window w as (partition by fid order by seq)) where x2 is not null)"


def layer_extent(spark: SparkSession, d: str) -> DataFrame:
    return fx.sites(spark, d).groupBy("status").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"), F.count("*").alias("n"))


def reproject_mercator(spark: SparkSession, d: str) -> DataFrame:
    x, y = crs.reproject(F.col("x"), F.col("y"), 4326, 3857)
    return fx.sites(spark, d).select("fid", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


def reproject_extent(spark: SparkSession, d: str) -> DataFrame:
    box = fx.sites(spark, d).groupBy("status").agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("e"))
    out = crs.reproject_bbox((F.col("a"), F.col("b"), F.col("c"), F.col("e")), 4326, 3857, 0.02)
    return box.select("status", *(F.round(v, 2).alias(n) for v, n in zip(out, ("minx", "miny", "maxx", "maxy"), strict=True)))


def track_segments(spark: SparkSession, d: str) -> DataFrame:
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return geom.segments(fx.tracks(spark, d), ["fid"]).groupBy("fid").agg(F.count("*").alias("n_segments"), F.round(F.sum(length), 6).alias("length"))


def vertex_count(spark: SparkSession, d: str) -> DataFrame:
    return fx.parcel_vertices(spark, d).groupBy("fid").agg(F.count("*").alias("n_vertices"), F.countDistinct("ring").alias("n_rings"))


def envelope(spark: SparkSession, d: str) -> DataFrame:
    return fx.parcel_vertices(spark, d).groupBy("fid").agg(*(f(c).alias(n) for f, c, n in ((F.min, "x", "minx"), (F.min, "y", "miny"), (F.max, "x", "maxx"), (F.max, "y", "maxy"))))


def ring_area(spark: SparkSession, d: str) -> DataFrame:
    area = geom.double_area(geom.segments(fx.parcel_vertices(spark, d), RING), RING)
    return area.select("fid", "ring", F.round(F.abs("area2") / 2, 6).alias("area"))


def vertex_mean(spark: SparkSession, d: str) -> DataFrame:
    return fx.parcel_vertices(spark, d).where("seq < 4").groupBy("fid", "ring").agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))


def quantize_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Tracks on the grid of level 6 of the world square."""
    return geom.quantize(fx.tracks(spark, d), ["fid"], SQUARE.x, SQUARE.y, SQUARE.cell(6, 10) * 64)


def _parcel_grid(spark: SparkSession, d: str, cell: float) -> DataFrame:
    return geom.open_ring(geom.quantize(fx.parcel_vertices(spark, d), RING, -180.0, -180.0, cell), RING)


def collinear_prune(spark: SparkSession, d: str) -> DataFrame:
    """Tracks snapped to whole degrees: vertices on their neighbours' line go."""
    q = geom.quantize(fx.tracks(spark, d), ["fid"], -180.0, -180.0, 1.0)
    return geom.prune_collinear(q, ["fid"], face=False).groupBy("fid").agg(F.count("*").alias("n"), F.sum("qx").alias("sx"), F.sum("qy").alias("sy"))


def degenerate_faces(spark: SparkSession, d: str) -> DataFrame:
    """For cells of several sizes: how many rings stay faces, and how many become stubs for want of vertices or area."""
    v = fx.parcel_vertices(spark, d).withColumn("level", F.explode(F.array(*map(F.lit, range(4, 11)))))
    cell = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level").cast("double")) / 16
    by = ["level", *RING]
    q = v.select(*by, "seq", F.round((F.col("x") + 180) / cell).cast("int").alias("qx"), F.round((F.col("y") + 180) / cell).cast("int").alias("qy"))
    w = Window.partitionBy(*by).orderBy("seq")
    nxt = q.withColumn("nx", F.lead("qx").over(w)).withColumn("ny", F.lead("qy").over(w))
    moved = ((F.col("nx") != F.col("qx")) | (F.col("ny") != F.col("qy"))).cast("int")
    per = nxt.where("nx is not null").groupBy(*by).agg(F.sum(moved).alias("n"), F.abs(F.sum(F.col("qx") * F.col("ny") - F.col("nx") * F.col("qy"))).alias("area2"))
    reason = F.when(F.col("n") < 3, "few_vertices").when(F.col("area2") < 1, "no_area").otherwise("face")
    return per.groupBy("level", reason.alias("outcome")).agg(F.count("*").alias("n"))


def feature_wkt(spark: SparkSession, d: str) -> DataFrame:
    """Text of parcels with their holes, in eightieths of a degree, so that coordinates are whole numbers."""
    v = fx.parcel_vertices(spark, d).select("fid", "ring", "seq", *(F.round(F.col(c) * 80).cast("long").alias(c) for c in ("x", "y")))
    return geom.polygon_wkt(v)


_WINDOW = (-100.0, -40.0, 60.0, 35.0)


def segment_clip(spark: SparkSession, d: str) -> DataFrame:
    c = geom.clip_segments(geom.segments(fx.tracks(spark, d), ["fid"]), *_WINDOW)
    return c.groupBy("fid").agg(F.count("*").alias("n"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 6).alias("length"))


def line_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each track inside a band that it leaves and enters again: the lower half of a tenth of a degree, taken as one unit."""
    t = fx.tracks(spark, d).withColumn("y", F.col("y") * 10 - F.floor(F.col("y") * 10))
    c = geom.clip_segments(geom.segments(t, ["fid"]), -400.0, -1.0, 400.0, 0.5)
    return geom.line_runs(c, ["fid"]).groupBy("fid", "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def gap_median(spark: SparkSession, d: str) -> DataFrame:
    """The middle gap between consecutive vertices of tracks."""
    gaps = geom.segments(fx.tracks(spark, d), ["fid"]).select(F.round(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 6).alias("gap"))
    return geom.nth_value(gaps, "gap", 0.5).select(F.col("v").alias("p50"))


def robust_span(spark: SparkSession, d: str) -> DataFrame:
    """2 and 98 percent quantiles of the parcels' edges; with fewer than eight parcels the whole span."""
    p = fx.parcels(spark, d).select(F.col("x0").alias("lo"), (F.col("x0") + F.col("w")).alias("hi"))
    lo, hi = geom.nth_value(p, "lo", 0.02).select(F.col("v").alias("lo")), geom.nth_value(p, "hi", 0.98).select(F.col("v").alias("hi"))
    whole = p.agg(F.count("*").alias("n"), F.min("lo").alias("a"), F.max("hi").alias("b"))
    # three tables of one row each
    return whole.join(F.broadcast(lo)).join(F.broadcast(hi)).select(F.when(F.col("n") < 8, F.col("a")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("n") < 8, F.col("b")).otherwise(F.col("hi")).alias("hi"))


def short_lines(spark: SparkSession, d: str) -> DataFrame:
    """Tracks whose bbox diagonal reaches a cell, by level."""
    box = fx.tracks(spark, d).groupBy("fid").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    levels = box.withColumn("level", F.explode(F.array(*map(F.lit, range(0, 9)))))
    return levels.where(F.hypot("w", "h") >= F.lit(360.0) / F.pow(F.lit(2.0), F.col("level").cast("double")) / 512).groupBy("level").agg(F.count("*").alias("n"))


def min_vertices(spark: SparkSession, d: str) -> DataFrame:
    q = _parcel_grid(spark, d, 1.0).groupBy(*RING).agg(F.count("*").alias("n"))
    return q.groupBy((F.col("n") >= 3).alias("is_face")).agg(F.count("*").alias("n_rings"))


def point_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance from (10, 10) to each track."""
    e = geom.segments(fx.tracks(spark, d), ["fid"])
    dist = geom.segment_distance(F.lit(10.0), F.lit(10.0), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return e.groupBy("fid").agg(F.round(F.min(dist), 6).alias("distance"))


def zigzag_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Zigzag code and varint length of the steps between quantised track vertices."""
    q = geom.quantize(fx.tracks(spark, d), ["fid"], -180.0, -180.0, 0.1)
    w = Window.partitionBy("fid").orderBy("seq")
    delta = (F.col("qx") - F.coalesce(F.lag("qx").over(w), F.lit(0))).cast("long")
    zz = F.shiftleft(delta, 1).bitwiseXOR(F.shiftright(delta, 63))
    n = F.when(zz < 128, 1).when(zz < 16384, 2).when(zz < 2097152, 3).otherwise(4)
    return q.withColumn("zz", zz).withColumn("bytes", n).groupBy("fid").agg(F.sum("zz").alias("sum_zz"), F.sum("bytes").alias("n_bytes"))


def edge_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """Edges that occur once: the boundary of the union of parcels on a coarse grid, by fid."""
    q = fx.parcel_vertices(spark, d).where("ring = 0").select(*RING, "seq", *(F.round(F.col(c)).cast("long").alias(c) for c in ("x", "y")))
    e = geom.segments(q, RING).where("x1 <> x2 or y1 <> y2")
    a, b = (F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y2")))
    once = e.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count("*").alias("k"), F.min("fid").alias("fid")).where("k = 1")
    return once.groupBy("fid").agg(F.count("*").alias("n_boundary"))


QUERIES = {f.__name__: f for f in (
    layer_extent, reproject_mercator, reproject_extent, track_segments, vertex_count, envelope, ring_area, vertex_mean, quantize_vertices, collinear_prune,
    degenerate_faces, feature_wkt, segment_clip, line_runs, gap_median, robust_span, short_lines, min_vertices, point_distance, zigzag_deltas, edge_multiplicity,
)}

_CLIP_SQL = """cl as (select *, greatest(0e0, case when x2-x1>0 then (a-x1)/(x2-x1) when x2-x1<0 then (c-x1)/(x2-x1) else 0e0 end,
   case when y2-y1>0 then (b-y1)/(y2-y1) when y2-y1<0 then (e-y1)/(y2-y1) else 0e0 end) t0,
  least(1e0, case when x2-x1>0 then (c-x1)/(x2-x1) when x2-x1<0 then (a-x1)/(x2-x1) else 1e0 end,
   case when y2-y1>0 then (e-y1)/(y2-y1) when y2-y1<0 then (b-y1)/(y2-y1) else 1e0 end) t1,
  not ((x1=x2 and (x1<a or x1>c)) or (y1=y2 and (y1<b or y1>e))) ok from edges, win)"""
_QT = "q as (select * from (select fid, seq, qx, qy, lag(qx) over w px, lag(qy) over w py from (select fid, seq, cast(round((x+180e0)/{c}) as int) qx, cast(round((y+180e0)/{c}) as int) qy from tracks) window w as (partition by fid order by seq)) where px is null or px<>qx or py<>qy)"
_MERC = "radians({x})*6378137e0, ln(tan(pi()/4+radians({y})/2))*6378137e0"
ORACLE_SQL = {
    "layer_extent": f"with {fx.SITES_SQL} select status, min(x) minx, min(y) miny, max(x) maxx, max(y) maxy, count(*) n from sites group by 1",
    "reproject_mercator": f"with {fx.SITES_SQL} select fid, round(radians(x)*6378137e0,3) mx, round(ln(tan(pi()/4+radians(y)/2))*6378137e0,3) my from sites",
    "reproject_extent": f"""with {fx.SITES_SQL}, b as (select status, radians(min(x))*6378137e0 a, ln(tan(pi()/4+radians(min(y))/2))*6378137e0 b, radians(max(x))*6378137e0 c, ln(tan(pi()/4+radians(max(y))/2))*6378137e0 e from sites group by 1)
     select status, round(a-(c-a)*0.02e0,2) minx, round(b-(e-b)*0.02e0,2) miny, round(c+(c-a)*0.02e0,2) maxx, round(e+(e-b)*0.02e0,2) maxy from b""",
    "track_segments": f"with {fx.TRACKS_SQL}, {_TRACK_EDGES_SQL} select fid, count(*) n_segments, round(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))),6) length from edges group by 1",
    "vertex_count": f"with {fx.VERTICES_SQL} select fid, count(*) n_vertices, count(distinct ring) n_rings from parcel_vertices group by 1",
    "envelope": f"with {fx.VERTICES_SQL} select fid, min(x) minx, min(y) miny, max(x) maxx, max(y) maxy from parcel_vertices group by 1",
    "ring_area": f"with {fx.VERTICES_SQL}, {_EDGES_SQL} select fid, ring, round(abs(sum(x1*y2-x2*y1))/2,6) area from edges group by 1,2",
    "vertex_mean": f"with {fx.VERTICES_SQL} select fid, ring, round(avg(x),6) cx, round(avg(y),6) cy from parcel_vertices where seq<4 group by 1,2",
    "quantize_vertices": f"with {fx.TRACKS_SQL}, {_QT.format(c='0.703125e0')} select fid, seq, qx, qy from q",
    "collinear_prune": f"""with {fx.TRACKS_SQL}, {_QT.format(c='1e0')},
     n as (select fid, seq, qx, qy, lag(qx) over w a, lag(qy) over w b, lead(qx) over w c, lead(qy) over w e from q window w as (partition by fid order by seq)),
     m as (select *, coalesce((qx-a)*(e-qy)-(qy-b)*(c-qx),1) cr from n), k as (select *, sum(case when cr<>0 then 1 else 0 end) over (partition by fid) lft from m)
     select fid, count(*) n, cast(sum(qx) as bigint) sx, cast(sum(qy) as bigint) sy from k where cr<>0 or lft<2 group by 1""",
    "degenerate_faces": f"""with {fx.VERTICES_SQL}, l as (select cast(unnest(range(4,11)) as int) as level),
     q as (select level, fid, part, ring, seq, cast(round((x+180e0)/(360e0/pow(2e0,level)/16e0)) as bigint) qx, cast(round((y+180e0)/(360e0/pow(2e0,level)/16e0)) as bigint) qy from parcel_vertices, l),
     n as (select *, lead(qx) over w nx, lead(qy) over w ny from q window w as (partition by level, fid, part, ring order by seq)),
     p as (select level, fid, part, ring, sum(case when nx<>qx or ny<>qy then 1 else 0 end) n, abs(sum(qx*ny-nx*qy)) area2 from n where nx is not null group by 1,2,3,4)
     select level, case when n<3 then 'few_vertices' when area2<1 then 'no_area' else 'face' end outcome, count(*) n from p group by 1,2""",
    "feature_wkt": f"""with {fx.VERTICES_SQL}, v as (select fid, ring, seq, cast(round(x*80) as bigint)||' '||cast(round(y*80) as bigint) t from parcel_vertices),
     r as (select fid, ring, '('||string_agg(t, ', ' order by seq)||')' t from v group by fid, ring)
     select fid, 'POLYGON ('||string_agg(t, ', ' order by ring)||')' wkt from r group by fid""",
    "segment_clip": f"""with {fx.TRACKS_SQL}, {_TRACK_EDGES_SQL}, win as (select -100e0 a, -40e0 b, 60e0 c, 35e0 e), {_CLIP_SQL}
     select fid, count(*) n, round(sum(sqrt(((t1-t0)*(x2-x1))*((t1-t0)*(x2-x1))+((t1-t0)*(y2-y1))*((t1-t0)*(y2-y1)))),6) length from cl where ok and t0<=t1 group by 1""",
    "line_runs": f"""with {fx.TRACKS_SQL.replace("tracks as", "whole as")}, tracks as (select fid, seq, x, y*10-floor(y*10) y from whole),
     {_TRACK_EDGES_SQL}, win as (select -400e0 a, -1e0 b, 400e0 c, 0.5e0 e), {_CLIP_SQL},
     k as (select fid, seq, t0<=0 w0, t1>=1 w1 from cl where ok and t0<=t1),
     j as (select *, case when lag(seq) over w = seq-1 and lag(w1) over w and w0 then 0 else 1 end s from k window w as (partition by fid order by seq)),
     r as (select *, sum(s) over (partition by fid order by seq) run from j)
     select fid, cast(run as bigint) run, min(seq) first_seq, max(seq) last_seq from r group by 1,2""",
    "gap_median": f"""with {fx.TRACKS_SQL}, {_TRACK_EDGES_SQL}, g as (select round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)),6) gap from edges),
     r as (select gap, row_number() over (order by gap)-1 k, count(*) over () n from g) select gap p50 from r where k = cast(floor(0.5e0*(n-1)) as bigint)""",
    "robust_span": f"""with {fx.PARCELS_SQL}, r as (select x0, x0+w x1, row_number() over (order by x0)-1 a, row_number() over (order by x0+w)-1 b, count(*) over () n from parcels)
     select case when max(n)<8 then min(x0) else max(case when a=cast(floor(0.02e0*(n-1)) as bigint) then x0 end) end lo,
      case when max(n)<8 then max(x1) else max(case when b=cast(floor(0.98e0*(n-1)) as bigint) then x1 end) end hi from r""",
    "short_lines": f"""with {fx.TRACKS_SQL}, b as (select fid, max(x)-min(x) w, max(y)-min(y) h from tracks group by 1), l as (select cast(unnest(range(9)) as int) as level)
     select level, count(*) n from b, l where sqrt(w*w+h*h)>=360e0/pow(2e0,level)/512e0 group by 1""",
    "min_vertices": f"""with {fx.VERTICES_SQL}, q as (select fid, ring, seq, cast(round(x+180e0) as int) qx, cast(round(y+180e0) as int) qy from parcel_vertices),
     k as (select *, lag(qx) over w px, lag(qy) over w py from q window w as (partition by fid, ring order by seq)), u as (select * from k where px is null or px<>qx or py<>qy),
     f as (select *, first_value(qx) over w fx, first_value(qy) over w fy, max(seq) over (partition by fid, ring) ls, count(*) over (partition by fid, ring) c from u window w as (partition by fid, ring order by seq)),
     r as (select fid, ring, sum(case when seq=ls and qx=fx and qy=fy and c>1 then 0 else 1 end) n from f group by 1,2) select n>=3 is_face, count(*) n_rings from r group by 1""",
    "point_distance": f"""with {fx.TRACKS_SQL}, {_TRACK_EDGES_SQL}, t as (select *, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) nn from edges),
     u as (select *, case when nn>0 then greatest(0e0, least(1e0, ((10e0-x1)*(x2-x1)+(10e0-y1)*(y2-y1))/nn)) else 0e0 end k from t)
     select fid, round(min(sqrt(pow(10e0-x1-k*(x2-x1),2)+pow(10e0-y1-k*(y2-y1),2))),6) distance from u group by 1""",
    "zigzag_deltas": f"""with {fx.TRACKS_SQL}, {_QT.format(c='0.1e0')}, z as (select fid, cast(qx-coalesce(lag(qx) over (partition by fid order by seq),0) as bigint) dl from q),
     k as (select fid, case when dl<0 then -2*dl-1 else 2*dl end zz from z)
     select fid, cast(sum(zz) as bigint) sum_zz, cast(sum(case when zz<128 then 1 when zz<16384 then 2 when zz<2097152 then 3 else 4 end) as bigint) n_bytes from k group by 1""",
    "edge_multiplicity": f"""with {fx.VERTICES_SQL}, v as (select fid, part, ring, seq, cast(round(x) as bigint) x, cast(round(y) as bigint) y from parcel_vertices where ring=0),
     e as (select fid, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from v window w as (partition by fid order by seq)),
     k as (select fid, case when (x1,y1)<=(x2,y2) then x1 else x2 end a, case when (x1,y1)<=(x2,y2) then y1 else y2 end b, case when (x1,y1)<=(x2,y2) then x2 else x1 end c, case when (x1,y1)<=(x2,y2) then y2 else y1 end e
      from e where x2 is not null and (x1<>x2 or y1<>y2)), o as (select a,b,c,e, count(*) k, min(fid) fid from k group by 1,2,3,4 having count(*)=1) select fid, count(*) n_boundary from o group by 1""",
}
