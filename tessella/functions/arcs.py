"""Circular arcs turned into vertices, as column expressions.

A curve is a list of points: an odd number for circular strings, where every second point is the middle of an arc. An arc from
a through b to c becomes vertices at equal angles of at most ``step`` radians; ends stay exact. Three points on a line give that line,
equal ends a full circle with b opposite.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom

STEP = math.radians(4)
CURVES = ("CIRCULARSTRING", "COMPOUNDCURVE", "CURVEPOLYGON", "MULTICURVE", "MULTISURFACE")


def _struct(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def arc_points(a: Column, b: Column, c: Column, step: float = STEP) -> Column:
    """Vertices of an arc, both ends included; points are structs of x and y."""
    circle = (a["x"] == c["x"]) & (a["y"] == c["y"])
    bx, by, cx, cy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - a["x"], c["y"] - a["y"]
    d = 2 * (bx * cy - by * cx)
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    mx = F.when(circle, bx / 2).otherwise((cy * b2 - by * c2) / d)
    my = F.when(circle, by / 2).otherwise((bx * c2 - cx * b2) / d)
    turn = 2 * math.pi
    to = lambda px, py, sx, sy: F.pmod(F.atan2(py - sy, px - sx) - F.atan2(-sy, -sx), F.lit(turn))

    def along(m: Column) -> Column:
        anticlockwise = to(bx, by, m["x"], m["y"]) <= to(cx, cy, m["x"], m["y"])
        sweep = F.when(circle, F.lit(turn)).when(anticlockwise, to(cx, cy, m["x"], m["y"])).otherwise(to(cx, cy, m["x"], m["y"]) - turn)
        return geom.bound(F.struct(sweep.alias("sweep"), F.greatest(F.lit(1), F.ceil(F.abs(sweep) / step - 1e-9)).cast("int").alias("n")), lambda s: F.transform(F.sequence(F.lit(0), s["n"]), lambda k: vertex(m, s, k)))

    def vertex(m: Column, s: Column, k: Column) -> Column:
        angle = F.atan2(-m["y"], -m["x"]) + s["sweep"] * k / s["n"]
        r = F.hypot(m["x"], m["y"])
        return F.when(k == 0, _struct(a["x"], a["y"])).when(k == s["n"], _struct(c["x"], c["y"])).otherwise(_struct(a["x"] + m["x"] + r * F.cos(angle), a["y"] + m["y"] + r * F.sin(angle)))

    straight = (d == 0) & ~circle | (circle & (b2 == 0))
    return F.when(straight, F.array(_struct(a["x"], a["y"]), _struct(b["x"], b["y"]), _struct(c["x"], c["y"]))).otherwise(geom.bound(_struct(mx, my), along))


def linearise(points: Column, step: float = STEP) -> Column:
    """Vertices of a circular string; fewer than three points are taken as they are."""

    def arcs(p: Column) -> Column:
        one = lambda i: geom.bound(arc_points(p[i], p[i + 1], p[i + 2], step), lambda v: F.when(i == 0, v).otherwise(F.slice(v, F.lit(2), F.size(v) - 1)))
        whole = F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - 3, F.lit(2)), one))
        return F.when(F.size(p) < 3, p).otherwise(whole)

    return geom.bound(points, arcs)


def linear_layer(layer: DataFrame, step: float = STEP) -> DataFrame:
    """A layer with ``kind`` and ``points`` whose curves are vertices; a kind that would still be a curve raises an error, so no second pass is needed."""
    kinds = {"CIRCULARSTRING": "LINESTRING"}
    out = layer.withColumns({"points": F.when(F.col("kind") == "CIRCULARSTRING", linearise(F.col("points"), step)).otherwise(F.col("points")), "kind": F.coalesce(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("kind")], F.col("kind"))})
    left = F.col("kind").isin(*CURVES)
    return out.withColumn("kind", F.when(left, F.raise_error(F.concat(F.lit("still a curve: "), "kind"))).otherwise(F.col("kind")))


def path_length(points: Column) -> Column:
    """Length of the line through points in array form, summed from its start."""
    step = lambda p, i: F.hypot(p[i + 1]["x"] - p[i]["x"], p[i + 1]["y"] - p[i]["y"])
    return geom.bound(points, lambda p: F.when(F.size(p) > 1, F.aggregate(F.sequence(F.lit(0), F.size(p) - 2), F.lit(0.0), lambda t, i: t + step(p, i))).otherwise(0.0))


def arc_lengths(spark: SparkSession, d: str) -> DataFrame:
    """An arc over each parcel, from corner to corner through the middle of its top: vertices and length in steps of four degrees."""
    at = lambda x, y: _struct(x.cast("double"), y.cast("double"))
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    # A parcel is few bytes and its arc much work: files alone would give few tasks.
    parcels = fx.parcels(spark, d).select("fid", "x0", "y0", "w", "h").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fid")
    layer = parcels.select("fid", F.lit("CIRCULARSTRING").alias("kind"), F.array(at(x, y), at(x + w / 2, y + h), at(x + w, y)).alias("points"))
    # An arc is whole in its row, so its length is summed there: no vertex is shuffled or sorted.
    return linear_layer(layer).select("fid", geom.bound(F.col("points"), lambda p: F.struct(F.size(p).cast("long").alias("n_vertices"), F.round(path_length(p), 6).alias("length"))).alias("a")).select("fid", "a.*")


QUERIES = {"arc_lengths": arc_lengths}
ORACLE_SQL = {
    # Half chord and rise give radius and angle; n equal chords of it are summed.
    "arc_lengths": f"""with {fx.PARCELS_SQL}, a as (select fid, (w*w/4+h*h)/(2*h) r, 4*atan(h/(w/2)) t from parcels), n as (select *, greatest(1, ceil(t/radians(4e0)-1e-9)) n from a)
     select fid, cast(n+1 as bigint) n_vertices, round(n*2*r*sin(t/(2*n)),6) length from n""",
}
