"""Rasters as cells (col, row_, z): windows, resampling, stretching, colours, terrain, scatter, rasterising."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom

W, H = 64, 48
# Colour stops of the ramps, from 0 to 1.
RAMPS = {
    "gray": [(0, 0, 0), (1, 1, 1)],
    "viridis": [
        (0.267, 0.005, 0.329), (0.282, 0.211, 0.522), (0.279, 0.347, 0.606), (0.219, 0.464, 0.556), (0.129, 0.562, 0.439), (0.153, 0.697, 0.375),
        (0.420, 0.812, 0.242), (0.903, 0.951, 0.349), (0.997, 0.901, 0.685), (0.941, 0.733, 0.952), (0.969, 0.432, 0.882), (0.922, 0.381, 0.106),
    ],
    "jet": [(0, 0, 0.515), (0, 0, 1), (0, 0.5, 1), (0, 1, 1), (0.5, 1, 0.5), (1, 1, 0), (1, 0.5, 0), (1, 0, 0), (0.5, 0, 0)],
    "turbo": [
        (0.190, 0.050, 0.231), (0.314, 0.041, 0.466), (0.388, 0.256, 0.465), (0.428, 0.466, 0.374), (0.404, 0.680, 0.067), (0.000, 0.781, 0.208), (0.000, 0.848, 0.505),
        (0.000, 0.877, 0.746), (0.000, 0.784, 0.935), (0.248, 0.649, 0.969), (0.471, 0.436, 0.067), (0.666, 0.820, 0.712), (0.906, 0.780, 0.188), (0.997, 0.728, 0.078),
        (0.988, 0.636, 0.086), (0.797, 0.296, 0.106), (0.775, 0.096, 0.057), (0.969, 0.275, 0.043), (0.971, 0.561, 0.165), (0.998, 0.760, 0.248), (0.989, 0.895, 0.300),
    ],
}


def band_stats(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    return cells.groupBy(*(by or [])).agg(F.count("z").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.round(F.avg("z"), 6).alias("mean"), F.round(F.stddev_pop("z"), 6).alias("sd"))


def window(cells: DataFrame, x0: int, y0: int, w: int, h: int, width: int, height: int) -> DataFrame:
    """Cells of a window, cut to the raster, with window coordinates."""
    a, b, c, e = max(0, x0), max(0, y0), min(width, x0 + w), min(height, y0 + h)
    return cells.where((F.col("col") >= a) & (F.col("col") < c) & (F.col("row_") >= b) & (F.col("row_") < e)).withColumns({"col": F.col("col") - a, "row_": F.col("row_") - b})


def resample(cells: DataFrame, width: int, height: int, to_w: int, to_h: int, how: str = "mean") -> DataFrame:
    """Cells of a coarser or finer grid: the mean of what falls into a cell, or the nearest source cell."""
    if how == "mean":
        at = lambda c, n, m: F.floor(F.col(c) * m / n).cast("int")
        return cells.groupBy(at("col", width, to_w).alias("col"), at("row_", height, to_h).alias("row_")).agg(F.avg("z").alias("z"))
    # each source cell is the nearest of the target cells from its first to its last
    first = lambda c, n, m: F.ceil(F.col(c) * m / n - 0.5)
    last = lambda c, n, m: F.ceil((F.col(c) + 1) * m / n - 0.5) - 1
    grown = cells.withColumn("c2", F.explode(_range(first("col", width, to_w), last("col", width, to_w)))).withColumn("r2", F.explode(_range(first("row_", height, to_h), last("row_", height, to_h))))
    return grown.select(F.col("c2").cast("int").alias("col"), F.col("r2").cast("int").alias("row_"), "z")


def _range(lo: Column, hi: Column) -> Column:
    return F.when(hi >= lo, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))


def stretch(z: Column, lo: float | Column, hi: float | Column) -> Column:
    """Linear stretch to 0-255; 0 if the range is empty."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(hi <= lo, 0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (z - lo) / (hi - lo))) * 255 + 0.5)).cast("int")


def ramp_color(t: Column, name: str) -> Column:
    """struct(r, g, b) of a place between 0 and 1, by linear interpolation between the stops."""
    stops = RAMPS[name]
    n = len(stops) - 1
    table = F.array(*(F.array(*(F.lit(v * 255.0) for v in s)) for s in stops))
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * n
    k = F.least(F.floor(x), F.lit(n - 1)).cast("int")
    f = x - k
    pick = lambda i: F.floor(F.element_at(F.element_at(table, k + 1), i) * (1 - f) + F.element_at(F.element_at(table, k + 2), i) * f + 0.5).cast("int")
    return F.struct(pick(1).alias("r"), pick(2).alias("g"), pick(3).alias("b"))


def world_of(col: Column, row: Column, affine: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    a = affine
    return col * a[1] + row * a[2] + a[0], col * a[4] + row * a[5] + a[3]


def pixel_of(x: Column, y: Column, affine: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Column and row of a world point, rounded; rotation is ignored."""
    a = affine
    return F.floor((x - a[0]) / a[1] + 0.5).cast("int"), F.floor((y - a[3]) / a[5] + 0.5).cast("int")


def neighbours(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cells with z11..z33 of their 3 by 3 neighbourhood, as one grouped pass; only those with all nine."""
    by = by or []
    spread = cells.withColumn("dc", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dr", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    at = spread.groupBy(*by, (F.col("col") - F.col("dc")).alias("col"), (F.col("row_") - F.col("dr")).alias("row_"))
    z = {f"z{r + 2}{c + 2}": F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("z"))) for r in (-1, 0, 1) for c in (-1, 0, 1)}
    return at.agg(F.count("z").alias("n"), *(v.alias(k) for k, v in z.items())).where("n = 9").drop("n")


def gradient(size: float = 1.0) -> tuple[Column, Column]:
    """Horn's differences of a neighbourhood."""
    c = F.col
    return ((c("z13") + 2 * c("z23") + c("z33")) - (c("z11") + 2 * c("z21") + c("z31"))) / (8 * size), ((c("z31") + 2 * c("z32") + c("z33")) - (c("z11") + 2 * c("z12") + c("z13"))) / (8 * size)


def slope(cells: DataFrame, size: float = 1.0, unit: str = "degrees") -> DataFrame:
    dx, dy = gradient(size)
    rise = F.sqrt(dx * dx + dy * dy)
    return neighbours(cells).select("col", "row_", (F.degrees(F.atan(rise)) if unit == "degrees" else rise * 100).alias("slope"))


def hillshade(cells: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0, size: float = 1.0) -> DataFrame:
    dx, dy = (g * z_factor for g in gradient(size))
    az, alt = math.radians(azimuth), math.radians(altitude)
    # light from the azimuth, rows downwards
    lit = (math.sin(alt) - (dx * math.sin(az) - dy * math.cos(az)) * math.cos(alt)) / F.sqrt(1 + dx * dx + dy * dy)
    return neighbours(cells).select("col", "row_", F.when(lit <= 0, 1.0).otherwise(1.0 + 254.0 * lit).alias("shade"))


def rasterize(vertices: DataFrame, cell: float, value: Column | float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Cells whose centres lie in the polygons of a layer in vertex form (holes excluded); the largest fid burns last.

    Each edge meets only the rows of centres between its ends; crossings are sorted and paired, so a polygon costs its
    boundary and its covered cells, not its box.
    """
    e = geom.segments(vertices, ["fid", "part", "ring"]).where("y1 <> y2")
    lo, hi = F.ceil(F.least("y1", "y2") / cell - 0.5), F.ceil(F.greatest("y1", "y2") / cell - 0.5) - 1
    rows = e.withColumn("row_", F.explode(_range(lo, hi)))
    yc = (F.col("row_") + 0.5) * cell
    cross = rows.select("fid", "part", "row_", (F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    xs = cross.groupBy("fid", "part", "row_").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.element_at("xs", k * 2 + 1).alias("a"), F.element_at("xs", k * 2 + 2).alias("b")))
    spans = xs.where("size(xs) >= 2").select("fid", "row_", F.explode(pairs).alias("s"))
    cells = spans.withColumn("col", F.explode(_range(F.ceil(F.col("s.a") / cell - 0.5), F.ceil(F.col("s.b") / cell - 0.5) - 1)))
    value = value if isinstance(value, Column) else F.lit(value)
    return cells.groupBy("col", "row_").agg(F.max("fid").alias("fid"), F.count("*").alias("n")).withColumn("value", value)


def block_rectangle(col0: Column, row0: Column, cols: Column, rows: Column, width: int, height: int, affine: tuple[float, ...]) -> tuple[Column, Column, Column, Column]:
    """The world rectangle of a block of cells, cut to the raster, from its four corners by all six terms: minx, miny, maxx, maxy."""
    a, b, c, d, e, f = affine
    inside = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most), v)).cast("double")
    corners = [(inside(p, width), inside(q, height)) for p in (col0, col0 + cols) for q in (row0, row0 + rows)]
    xs, ys = [F.lit(a) + p * b + q * c for p, q in corners], [F.lit(d) + p * e + q * f for p, q in corners]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def scatter(points: DataFrame, cols: int, rows: int) -> DataFrame:
    """Points (lon, lat, value, id) put forward onto a regular grid over their bounds; the closest to a cell's centre wins."""
    b = points.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    p = points.join(F.broadcast(b))
    fx_, fy_ = (F.col("lon") - F.col("x0")) / (F.col("x1") - F.col("x0")) * (cols - 1), (F.col("y1") - F.col("lat")) / (F.col("y1") - F.col("y0")) * (rows - 1)
    placed = p.select("id", "value", fx_.alias("fx"), fy_.alias("fy")).withColumn("col", F.floor(F.col("fx") + 0.5).cast("int")).withColumn("row_", F.floor(F.col("fy") + 0.5).cast("int"))
    d = F.round((F.col("fx") - F.col("col")) ** 2 + (F.col("fy") - F.col("row_")) ** 2, 12)
    return placed.withColumn("d", d).groupBy("col", "row_").agg(F.min(F.struct("d", "id", "value")).alias("b")).select("col", "row_", F.col("b.id").alias("id"), F.col("b.value").alias("value"))


def fill_nodata(cells: DataFrame, width: int, height: int) -> DataFrame:
    """All cells of the grid; missing ones get the smallest value and are tagged."""
    spark = cells.sparkSession
    whole = spark.range(width * height).select((F.col("id") % width).cast("int").alias("col"), F.floor(F.col("id") / width).cast("int").alias("row_"))
    least = cells.agg(F.min("z").alias("least"))
    return whole.join(cells, ["col", "row_"], "left").join(F.broadcast(least)).select("col", "row_", F.coalesce("z", "least").alias("z"), F.col("z").isNull().alias("is_nodata"))


def raster_stats(spark: SparkSession, d: str) -> DataFrame:
    return band_stats(fx.dem(spark, d))


def raster_sample(spark: SparkSession, d: str) -> DataFrame:
    """The cell under each site, over an affine grid of the world."""
    col, row = pixel_of(F.col("x"), F.col("y"), (-180.0, 360.0 / W, 0.0, 85.0, 0.0, -170.0 / H))
    s = fx.sites(spark, d).select("fid", col.alias("col"), row.alias("row_")).where((F.col("col") >= 0) & (F.col("col") < W) & (F.col("row_") >= 0) & (F.col("row_") < H))
    return s.join(fx.dem(spark, d), ["col", "row_"], "left").select("fid", "col", "row_", "z")


def raster_window(spark: SparkSession, d: str) -> DataFrame:
    return window(fx.dem(spark, d), -5, 10, 25, 20, W, H)


def raster_resample(spark: SparkSession, d: str) -> DataFrame:
    return resample(fx.dem(spark, d), W, H, 16, 12).select("col", "row_", F.round("z", 4).alias("z"))


def raster_nearest(spark: SparkSession, d: str) -> DataFrame:
    return resample(fx.dem(spark, d), W, H, 40, 30, "nearest")


def raster_stretch(spark: SparkSession, d: str) -> DataFrame:
    return fx.dem(spark, d).select("col", "row_", stretch(F.col("z"), 20.0, 30.0).alias("v"))


def pseudocolor(spark: SparkSession, d: str) -> DataFrame:
    c = fx.dem(spark, d).select("col", "row_", ramp_color((F.col("z") - 20) / 10, "jet").alias("c"))
    return c.select("col", "row_", "c.r", "c.g", "c.b")


def rgb_compose(spark: SparkSession, d: str) -> DataFrame:
    """Three bands (shifted copies of the grid) joined cell by cell; a missing band leaves the cell transparent."""
    z = fx.dem(spark, d)
    bands = z.select("col", "row_", F.lit(1).alias("band"), "z").union(z.select(((F.col("col") + 1) % W).cast("int"), "row_", F.lit(2), "z")).union(z.select("col", ((F.col("row_") + 1) % H).cast("int"), F.lit(3), "z"))
    v = lambda k: F.max(F.when(F.col("band") == k, stretch(F.col("z"), 20.0, 30.0)))
    out = bands.groupBy("col", "row_").agg(v(1).alias("r"), v(2).alias("g"), v(3).alias("b"), F.count("*").alias("n"))
    return out.select("col", "row_", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"), F.when(F.col("n") == 3, 255).otherwise(0).alias("a"))


def raster_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_nodata(fx.dem(spark, d), W, H)


def dem_slope(spark: SparkSession, d: str) -> DataFrame:
    return slope(fx.dem(spark, d)).select("col", "row_", F.round("slope", 6).alias("slope"))


def dem_hillshade(spark: SparkSession, d: str) -> DataFrame:
    return hillshade(fx.dem(spark, d)).select("col", "row_", F.round("shade", 6).alias("shade"))


def geoloc_scatter(spark: SparkSession, d: str) -> DataFrame:
    p = fx.sites(spark, d).select(F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("amount").alias("value"), F.col("fid").alias("id"))
    return scatter(p, 90, 45)


def rasterize_parcels(spark: SparkSession, d: str) -> DataFrame:
    return rasterize(fx.parcel_vertices(spark, d), 0.7071).select("col", "row_", "fid", "n")


QUERIES = {f.__name__: f for f in (
    raster_stats, raster_sample, raster_window, raster_resample, raster_nearest, raster_stretch, pseudocolor, rgb_compose, raster_fill, dem_slope, dem_hillshade, geoloc_scatter, rasterize_parcels,
)}

_STRETCH = "cast(floor(greatest(0e0,least(1e0,(z-20e0)/10e0))*255+0.5e0) as int)"
_N9 = (
    "n as (select col-dc col, row_-dr row_, " + ", ".join(f"max(case when dr={r - 2} and dc={c - 2} then z end) z{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3))
    + " from dem, (values (-1),(0),(1)) a(dc), (values (-1),(0),(1)) b(dr) group by 1,2 having count(*)=9), g as (select col, row_, ((z13+2*z23+z33)-(z11+2*z21+z31))/8e0 dx, ((z31+2*z32+z33)-(z11+2*z12+z13))/8e0 dy from n)"
)
ORACLE_SQL = {
    "raster_stats": f"with {fx.DEM_SQL} select count(z) n, min(z) lo, max(z) hi, round(avg(z),6) mean, round(stddev_pop(z),6) sd from dem",
    "raster_sample": f"""with {fx.SITES_SQL}, {fx.DEM_SQL}, s as (select fid, cast(floor((x+180e0)/5.625e0+0.5e0) as int) col, cast(floor((y-85e0)/(-170e0/48e0)+0.5e0) as int) row_ from sites)
     select fid, s.col, s.row_, z from s left join dem using (col,row_) where s.col>=0 and s.col<64 and s.row_>=0 and s.row_<48""",
    "raster_window": f"with {fx.DEM_SQL} select col, cast(row_-10 as int) row_, z from dem where col<20 and row_>=10 and row_<30",
    "raster_resample": f"with {fx.DEM_SQL} select cast(col//4 as int) col, cast(row_//4 as int) row_, round(avg(z),4) z from dem group by 1,2",
    "raster_nearest": f"""with {fx.DEM_SQL}, c as (select cast(unnest(range(40)) as int) c2), r as (select cast(unnest(range(30)) as int) r2)
     select c2 col, r2 row_, z from c, r, dem where col=cast(floor((c2+0.5e0)*64/40e0) as int) and row_=cast(floor((r2+0.5e0)*48/30e0) as int)""",
    "raster_stretch": f"with {fx.DEM_SQL} select col, row_, {_STRETCH} v from dem",
    # The stops of "jet" in 255ths of a channel, written out.
    "pseudocolor": f"""with {fx.DEM_SQL}, s(k,r,g,b) as (values (0,0e0,0e0,131.325e0),(1,0e0,0e0,255e0),(2,0e0,127.5e0,255e0),(3,0e0,255e0,255e0),(4,127.5e0,255e0,127.5e0),
      (5,255e0,255e0,0e0),(6,255e0,127.5e0,0e0),(7,255e0,0e0,0e0),(8,127.5e0,0e0,0e0)),
     t as (select col, row_, greatest(0e0,least(1e0,(z-20e0)/10e0))*8 x from dem), u as (select *, cast(least(floor(x),7) as int) k, x-least(floor(x),7) f from t)
     select col, row_, cast(floor(a.r*(1-f)+c.r*f+0.5e0) as int) r, cast(floor(a.g*(1-f)+c.g*f+0.5e0) as int) g, cast(floor(a.b*(1-f)+c.b*f+0.5e0) as int) b from u join s a on a.k=u.k join s c on c.k=u.k+1""",
    "rgb_compose": f"""with {fx.DEM_SQL}, m as (select col, row_, 1 band, z from dem union all select cast((col+1)%64 as int), row_, 2, z from dem union all select col, cast((row_+1)%48 as int), 3, z from dem)
     select col, row_, coalesce(max(case when band=1 then {_STRETCH} end),0) r, coalesce(max(case when band=2 then {_STRETCH} end),0) g, coalesce(max(case when band=3 then {_STRETCH} end),0) b,
      case when count(*)=3 then 255 else 0 end a from m group by 1,2""",
    "raster_fill": f"""with {fx.DEM_SQL}, w as (select cast(k%64 as int) col, cast(k//64 as int) row_ from (select unnest(range(3072)) k))
     select w.col, w.row_, coalesce(z, (select min(z) from dem)) z, z is null is_nodata from w left join dem using (col,row_)""",
    "dem_slope": f"with {fx.DEM_SQL}, {_N9} select col, row_, round(degrees(atan(sqrt(dx*dx+dy*dy))),6) slope from g",
    "dem_hillshade": f"""with {fx.DEM_SQL}, {_N9}, l as (select col, row_, (sin(radians(45e0))-(dx*sin(radians(315e0))-dy*cos(radians(315e0)))*cos(radians(45e0)))/sqrt(1+dx*dx+dy*dy) v from g)
     select col, row_, round(case when v<=0 then 1e0 else 1e0+254e0*v end,6) shade from l""",
    "geoloc_scatter": f"""with {fx.SITES_SQL}, b as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from sites), p as (select fid, amount, (x-x0)/(x1-x0)*89 fx, (y1-y)/(y1-y0)*44 fy from sites, b),
     q as (select *, cast(floor(fx+0.5e0) as int) col, cast(floor(fy+0.5e0) as int) row_ from p), r as (select *, row_number() over (partition by col,row_ order by round(pow(fx-col,2)+pow(fy-row_,2),12), fid) k from q)
     select col, row_, fid id, amount as value from r where k=1""",
    "rasterize_parcels": f"""with {fx.PARCELS_SQL}, c as (select fid, x0, y0, w, h, has_hole, unnest(range(cast(floor(x0/0.7071e0) as bigint)-1, cast(ceil((x0+w)/0.7071e0) as bigint)+1)) col from parcels),
     r as (select *, unnest(range(cast(floor(y0/0.7071e0) as bigint)-1, cast(ceil((y0+h)/0.7071e0) as bigint)+1)) row_ from c), k as (select *, (col+0.5e0)*0.7071e0 x, (row_+0.5e0)*0.7071e0 y from r)
     select cast(col as int) col, cast(row_ as int) row_, max(fid) fid, count(*) n from k where x>=x0 and x<x0+w and y>=y0 and y<y0+h and not (has_hole=1 and x>=x0+0.25e0*w and x<x0+0.75e0*w and y>=y0+0.25e0*h and y<y0+0.75e0*h) group by 1,2""",
}
