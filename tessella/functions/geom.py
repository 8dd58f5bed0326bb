"""Geometry as columns: segments, clipping, quantisation, areas.

A layer in vertex form has one row per vertex: ``fid, part, ring, seq, x, y`` (lines may lack part and ring). Rings are closed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE, FACE, POINT = 0, 1, 2


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt by its key, never broadcast.

    The engine guesses a side's size from its files. Where each row of a file has become several rows or whole vertices, that guess is
    many times too small, and a broadcast by it would take a table that grows with the input through the driver.
    """
    return df.hint("merge")


def geometry_type() -> str:
    """The nested form of a geometry: parts of rings of vertices."""
    return "struct<type:tinyint,epsg:int,parts:array<array<array<struct<x:double,y:double>>>>>"


def explode_vertices(layer: DataFrame, geom: str = "geom") -> DataFrame:
    """The vertex form of a layer with nested geometries: fid, part, ring, seq, x, y."""
    parts = layer.select("fid", F.posexplode(f"{geom}.parts").alias("part", "rings"))
    rings = parts.select("fid", "part", F.posexplode("rings").alias("ring", "vertices"))
    return rings.select("fid", "part", "ring", F.posexplode("vertices").alias("seq", "v")).select("fid", "part", "ring", "seq", "v.x", "v.y")


def segments(vertices: DataFrame, by: list[str]) -> DataFrame:
    """One row per pair of consecutive vertices: by, seq, x1, y1, x2, y2."""
    w = Window.partitionBy(*by).orderBy("seq")
    nxt = vertices.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w))
    return nxt.where("x2 is not null").select(*by, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def double_area(edges: DataFrame, by: list[str]) -> DataFrame:
    """Twice the signed area of each ring of edges."""
    return edges.groupBy(*by).agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("area2"))


def crosses_ray(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether an edge crosses the ray to the right of a point; half-open in y."""
    return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / n))).otherwise(0.0)
    return F.sqrt((px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2)


def clip_range(x1: Column, y1: Column, x2: Column, y2: Column, minx: float | Column, miny: float | Column, maxx: float | Column, maxy: float | Column) -> tuple[Column, Column, Column]:
    """Liang-Barsky: (t0, t1, inside) of the part of a segment in a rectangle; ``inside`` tells whether there is one."""
    dx, dy = x2 - x1, y2 - y1
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    enter, leave, ok = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for p, q in ((-dx, x1 - lit(minx)), (dx, lit(maxx) - x1), (-dy, y1 - lit(miny)), (dy, lit(maxy) - y1)):
        enter.append(F.when(p < 0, q / p).otherwise(0.0))
        leave.append(F.when(p > 0, q / p).otherwise(1.0))
        ok = ok & ~((p == 0) & (q < 0))
    t0, t1 = F.greatest(*enter), F.least(*leave)
    return t0, t1, ok & (t0 <= t1)


def clip_segments(edges: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """The parts of segments in a rectangle, and whether each begins and ends at its own vertex (whole0, whole1)."""
    t0, t1, ok = clip_range(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), minx, miny, maxx, maxy)
    cut = edges.withColumn("t0", t0).withColumn("t1", t1).where(ok)
    at = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    own = [c for c in edges.columns if c not in ("x1", "y1", "x2", "y2")]
    return cut.select(*own, at("x1", "x2", "t0").alias("x1"), at("y1", "y2", "t0").alias("y1"), at("x1", "x2", "t1").alias("x2"), at("y1", "y2", "t1").alias("y2"), (F.col("t0") <= 0).alias("whole0"), (F.col("t1") >= 1).alias("whole1"))


def line_runs(clipped: DataFrame, by: list[str]) -> DataFrame:
    """Numbers the continuous runs of clipped segments of each line (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy("seq")
    joined = F.coalesce((F.lag("seq").over(w) == F.col("seq") - 1) & F.lag("whole1").over(w) & F.col("whole0"), F.lit(False))
    return clipped.withColumn("run", F.sum((~joined).cast("int")).over(w).cast("long"))


def quantize(vertices: DataFrame, by: list[str], ox: Column | float, oy: Column | float, cell: Column | float) -> DataFrame:
    """Vertices on an integer grid: rounded half away from zero, clamped to int16, consecutive repeats dropped."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    snap = lambda v, o: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round((F.col(v) - lit(o)) / lit(cell)).cast("long"))).cast("int")
    q = vertices.select(*by, "seq", snap("x", ox).alias("qx"), snap("y", oy).alias("qy"))
    w = Window.partitionBy(*by).orderBy("seq")
    same = F.coalesce((F.lag("qx").over(w) == F.col("qx")) & (F.lag("qy").over(w) == F.col("qy")), F.lit(False))
    return q.withColumn("same", same).where("not same").drop("same")


def open_ring(q: DataFrame, by: list[str]) -> DataFrame:
    """Drop the closing vertex of rings of quantised vertices."""
    w = Window.partitionBy(*by)
    first, last = F.min_by(F.struct("qx", "qy"), "seq").over(w), F.max("seq").over(w)
    closing = (F.col("seq") == last) & (F.struct("qx", "qy") == first) & (F.count("*").over(w) > 1)
    return q.withColumn("closing", closing).where("not closing").drop("closing")


def prune_collinear(q: DataFrame, by: list[str], face: bool = True) -> DataFrame:
    """Drop vertices on the line of their original neighbours (cyclic for faces); a ring that would fall below 3 (2) stays."""
    w = Window.partitionBy(*by).orderBy("seq")
    whole = Window.partitionBy(*by)
    edge = lambda f, c, wrap: F.coalesce(f(c).over(w), wrap if face else F.lit(None))
    px, py = (edge(F.lag, c, F.max_by(c, "seq").over(whole)) for c in ("qx", "qy"))
    nx, ny = (edge(F.lead, c, F.min_by(c, "seq").over(whole)) for c in ("qx", "qy"))
    at = lambda c: F.col(c).cast("long")
    cross = (at("qx") - px.cast("long")) * (ny.cast("long") - at("qy")) - (at("qy") - py.cast("long")) * (nx.cast("long") - at("qx"))
    marked = q.withColumn("cross", F.coalesce(cross, F.lit(1)))
    left = F.sum((F.col("cross") != 0).cast("int")).over(whole)
    return marked.withColumn("left", left).where(f"cross <> 0 or left < {3 if face else 2}").drop("cross", "left")


def web_text(x: Column, y: Column) -> Column:
    """A coordinate pair as WKT spells it."""
    return F.concat_ws(" ", x.cast("string"), y.cast("string"))


def wkt(vertices: DataFrame, kind: int = FACE) -> DataFrame:
    """fid and text of layers in vertex form: POLYGON, LINESTRING or POINT, and their MULTI forms for features of several parts."""
    for c in ("part", "ring", "seq"):
        vertices = vertices if c in vertices.columns else vertices.withColumn(c, F.lit(0))
    joined = lambda rows, by, text, order: rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda r: r["t"]), ", ").alias("t"), F.count("*").alias("n"))
    held = F.concat(F.lit("("), F.col("t"), F.lit(")"))
    t = joined(vertices, ["fid", "part", "ring"], web_text(F.col("x"), F.col("y")), "seq")
    if kind == FACE:
        t = joined(t, ["fid", "part"], held, "ring")
    t = joined(t.select("fid", "part", "t"), ["fid"], held, "part")
    name = {FACE: "POLYGON", LINE: "LINESTRING", POINT: "POINT"}[kind]
    return t.select("fid", F.when(F.col("n") > 1, F.concat(F.lit(f"MULTI{name} ("), "t", F.lit(")"))).otherwise(F.concat(F.lit(f"{name} "), "t")).alias("wkt"))


def polygon_wkt(vertices: DataFrame) -> DataFrame:
    """fid and POLYGON or MULTIPOLYGON text of layers in vertex form."""
    return wkt(vertices, FACE)


def ordered_index(df: DataFrame, key: str, bucket: Column) -> DataFrame:
    """``df`` with ``idx``, its 0-based place in the order of ``key``, without a window over all rows.

    ``bucket`` must not decrease with ``key``. Rows are ranked within buckets, and buckets by a prefix sum over their counts;
    only the counts, one row a bucket, meet in one task.
    """
    b = df.withColumn("_bucket", bucket)
    before = b.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = b.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(key)))
    return ranked.join(before, "_bucket").withColumn("idx", (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_before", "_rank")


def nth_value(df: DataFrame, column: str, p: float) -> DataFrame:
    """One row: the element at index floor(p * (n - 1)) of the sorted column, not interpolated.

    Values are counted first, so only different values are ranked; ranks come from :func:`ordered_index` over the counts.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    width = ((hi - lo) / 1024.0) if lo is not None and hi > lo else 1.0
    b = counts.withColumn("b", F.floor((F.col("v") - F.lit(lo if lo is not None else 0.0)) / F.lit(width)))
    sums = b.groupBy("b").agg(F.sum("k").alias("nb"))  # at most 1025 rows
    w = Window.orderBy("b")
    sums = sums.withColumn("end", F.sum("nb").over(w)).withColumn("n", F.sum("nb").over(Window.partitionBy()))
    target = sums.where((F.col("end") > F.floor(F.lit(p) * (F.col("n") - 1))) & (F.col("end") - F.col("nb") <= F.floor(F.lit(p) * (F.col("n") - 1))))
    inside = b.join(F.broadcast(target.select("b", (F.col("end") - F.col("nb")).alias("before"), F.floor(F.lit(p) * (F.col("n") - 1)).alias("at"))), "b")
    ranked = inside.withColumn("upto", F.col("before") + F.sum("k").over(Window.partitionBy("b").orderBy("v")))
    return ranked.where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("k") <= F.col("at"))).select("v")


RING = "array<struct<x:double,y:double>>"


def ring_points(vertices: DataFrame, by: list[str]) -> DataFrame:
    """One row a ring or line: by and ``p``, its vertices in order."""
    at = F.array_sort(F.collect_list(F.struct("seq", F.struct("x", "y").alias("v"))))
    return vertices.groupBy(*by).agg(F.transform(at, lambda s: s["v"]).alias("p"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def ring_area2(p: Column) -> Column:
    """Twice the signed area of a ring in array form, closed or open."""
    after = lambda r, i: r[(i + 1) % F.size(r)]
    return bound(p, lambda r: F.aggregate(F.transform(r, lambda v, i: v["x"] * after(r, i)["y"] - after(r, i)["x"] * v["y"]), F.lit(0.0), lambda a, b: a + b))


def whole(p: Column, least: float = 0.0) -> Column:
    """Whether an open ring in array form has three vertices and a doubled area over ``least``."""
    return bound(p, lambda r: (F.size(r) > 2) & (F.abs(ring_area2(r)) > least))


def only(value: Column, keep: Callable[[Column], Column]) -> Column:
    """To be selected: the value, in rows where ``keep`` holds. It is worked out once, which a filter after it wouldn't do."""
    return F.explode(F.filter(F.array(value), keep))


def apart(p: Column) -> Column:
    """A ring in array form without vertices equal to the one before."""
    return bound(p, lambda r: F.filter(r, lambda v, i: (v != r[(i + F.size(r) - 1) % F.size(r)]) | (F.size(r) == 1)))


def clip_ring(p: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """An open ring in array form cut to a rectangle, one side after the other; fewer than three vertices if nothing is left.

    Where a rectangle cuts a ring into several pieces they stay joined along its border, so areas are exact. A ring that lies in the rectangle
    isn't cut.
    """
    side = lambda on_x, bound, sign: F.struct(F.lit(on_x).alias("on_x"), bound.cast("double").alias("bound"), F.lit(sign).alias("sign"))
    sides = F.array(side(True, minx, 1.0), side(True, maxx, -1.0), side(False, miny, 1.0), side(False, maxy, -1.0))

    def cut(ring: Column, s: Column) -> Column:
        across = lambda v: F.when(s["on_x"], v["x"]).otherwise(v["y"])
        along = lambda v: F.when(s["on_x"], v["y"]).otherwise(v["x"])
        inside = lambda v: (across(v) - s["bound"]) * s["sign"] >= 0

        def step(v: Column, i: Column) -> Column:
            u = ring[(i + F.size(ring) - 1) % F.size(ring)]
            at = along(u) + (s["bound"] - across(u)) / (across(v) - across(u)) * (along(v) - along(u))
            cross = F.struct(F.when(s["on_x"], s["bound"]).otherwise(at).alias("x"), F.when(s["on_x"], at).otherwise(s["bound"]).alias("y"))
            return F.when(inside(v) & inside(u), F.array(v)).when(inside(v), F.array(cross, v)).when(inside(u), F.array(cross)).otherwise(F.array().cast(RING))

        return F.flatten(F.transform(ring, step))

    held = lambda r: F.forall(r, lambda v: (v["x"] >= minx) & (v["x"] <= maxx) & (v["y"] >= miny) & (v["y"] <= maxy))
    return apart(bound(p, lambda r: F.when(held(r), r).otherwise(F.reduce(sides, r, cut))))


def open_points(p: Column) -> Column:
    """A ring in array form without its closing vertex."""
    return F.when((F.size(p) > 1) & (p[0] == F.element_at(p, -1)), F.slice(p, 1, F.size(p) - 1)).otherwise(p)
