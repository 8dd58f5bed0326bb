"""Grid buckets of segments, by their middles, and of triangles, by their centroids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom
from tessella.operators import fill, raster
from tessella.operators.spatial import grid_side


def partition(shapes: DataFrame, xs: list[str], ys: list[str], bucket: int = 262144) -> DataFrame:
    """Counts and bounds by grid cell: gy, gx, n, minx, miny, maxx, maxy.

    The grid covers all coordinates; its side follows from the number of floats, two a vertex. A shape belongs to the cell of
    the mean of its vertices, so every shape is in one cell and bounds may reach over the cell's.
    """
    least = lambda cs: F.least(*map(F.col, cs))
    most = lambda cs: F.greatest(*map(F.col, cs))
    n, x0, y0, x1, y1 = shapes.agg(F.count("*"), F.min(least(xs)), F.min(least(ys)), F.max(most(xs)), F.max(most(ys))).first()
    side = grid_side(2 * len(xs) * n, bucket)

    def cell(cs: list[str], lo: float, hi: float) -> Column:
        middle = sum((F.col(c) for c in cs[1:]), F.col(cs[0])) / len(cs)
        step = (hi - lo) / side if n and hi > lo else 1.0
        return F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor((middle - F.lit(lo or 0.0)) / F.lit(step)))).cast("int")

    held = shapes.groupBy(cell(ys, y0, y1).alias("gy"), cell(xs, x0, x1).alias("gx"))
    return held.agg(F.count("*").alias("n"), F.min(least(xs)).alias("minx"), F.min(least(ys)).alias("miny"), F.max(most(xs)).alias("maxx"), F.max(most(ys)).alias("maxy"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("gy", "gx", "n", *(F.round(c, 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")))


def segment_partition(spark: SparkSession, d: str) -> DataFrame:
    """The tracks' segments in buckets of about 512 floats."""
    return _rounded(partition(geom.segments(fx.tracks(spark, d), ["fid"]), ["x1", "x2"], ["y1", "y2"], 512))


def triangle_partition(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of the parcels' fills, without their holes, in buckets of about 512 floats."""
    edges = geom.segments(fx.parcel_vertices(spark, d), ["fid", "part", "ring"])
    t = fill.triangles(fill.trapezoids(edges, ["fid", "part"]), ["fid"])
    return _rounded(partition(t, ["x1", "x2", "x3"], ["y1", "y2", "y3"], 512))


def base_image(spark: SparkSession, d: str) -> DataFrame:
    """The terrain's first picture: its longest side 40 cells at most, by nearest cells, and the mode that its bands ask for."""
    cells = fx.dem(spark, d)
    width, height, bands = cells.agg(F.max("col") + 1, F.max("row_") + 1, F.lit(1)).first()
    w, h = base_size(width, height, 40)
    small = raster.resample(cells, width, height, w, h, "nearest")
    return small.select("col", "row_", "z", F.lit(default_mode(bands)).alias("mode"))


def base_size(width: int, height: int, longest: int = 1024) -> tuple[int, int]:
    """The size of a raster's first picture: as it is, or shrunk to a longest side."""
    scale = max(1.0, max(width, height) / longest)
    return max(1, math.floor(width / scale + 0.5)), max(1, math.floor(height / scale + 0.5))


def default_mode(bands: int) -> str:
    """How a raster is drawn at first."""
    return "rgb" if bands >= 3 else "gray"


QUERIES = {f.__name__: f for f in (segment_partition, triangle_partition, base_image)}
ORACLE_SQL = {
    "segment_partition": f"""with {fx.TRACKS_SQL}, e as (select fid, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from tracks window w as (partition by fid order by seq)), s as (select * from e where x2 is not null),
     g as (select least(252, greatest(1, ceil(sqrt(4*count(*)/512e0)))) g, min(least(x1,x2)) ax, max(greatest(x1,x2)) bx, min(least(y1,y2)) ay, max(greatest(y1,y2)) b_y from s),
     c as (select cast(least(g-1, floor(((y1+y2)/2-ay)/((b_y-ay)/g))) as int) gy, cast(least(g-1, floor(((x1+x2)/2-ax)/((bx-ax)/g))) as int) gx, s.* from s, g)
     select gy, gx, count(*) n, round(min(least(x1,x2)),6) minx, round(min(least(y1,y2)),6) miny, round(max(greatest(x1,x2)),6) maxx, round(max(greatest(y1,y2)),6) maxy from c group by 1,2""",
    # A hole takes the middle half of both sides, so it leaves a box below, one on each side and one above.
    "triangle_partition": f"""with {fx.PARCELS_SQL}, k as (select unnest(range(5)) k), f as (select x0+w*(case when k=3 then 0.75e0 else 0e0 end) l, x0+w*(case when k=2 then 0.25e0 else 1e0 end) r,
      y0+h*(case when k in (2,3) then 0.25e0 when k=4 then 0.75e0 else 0e0 end) b, y0+h*(case k when 1 then 0.25e0 when 2 then 0.75e0 when 3 then 0.75e0 else 1e0 end) t from parcels, k where (k=0)=(has_hole=0)),
     t as (select l x1, b y1, r x2, b y2, r x3, t y3 from f union all select l, b, r, t, l, t from f),
     s as (select *, least(x1,x2,x3) lx, greatest(x1,x2,x3) hx, least(y1,y2,y3) ly, greatest(y1,y2,y3) hy from t), g as (select least(252, greatest(1, ceil(sqrt(6*count(*)/512e0)))) g, min(lx) ax, max(hx) bx, min(ly) ay, max(hy) b_y from s),
     c as (select cast(least(g-1, floor(((y1+y2+y3)/3-ay)/((b_y-ay)/g))) as int) gy, cast(least(g-1, floor(((x1+x2+x3)/3-ax)/((bx-ax)/g))) as int) gx, s.* from s, g)
     select gy, gx, count(*) n, round(min(lx),6) minx, round(min(ly),6) miny, round(max(hx),6) maxx, round(max(hy),6) maxy from c group by 1,2""",
    "base_image": f"""with {fx.DEM_SQL}, t as (select unnest(range(40)) col), r as (select unnest(range(30)) row_),
     s as (select max(col)+1 w, max(row_)+1 h from dem) select cast(t.col as int) col, cast(r.row_ as int) row_, z, 'gray' mode from t, r, s join dem on true
     where dem.col=floor((t.col+0.5e0)*w/40) and dem.row_=floor((r.row_+0.5e0)*h/30)""",
}
