"""The union of polygons as outlines: planar overlay of their edges.

Coordinates go to a grid of integers first. Edges are cut where they cross or touch others of their group, found by an equi-join
on tile keys; of the pieces those stay that have nothing covered to their right, told by the winding number just beside the
middle of a piece, summed over the polygons whose boxes hold that point. What stays is linked into rings.

Where polygons lie many deep, most crossings are inside others. So cells that one polygon covers are found first, coarse ones, then finer
ones in what is left: no outline runs inside such a cell, so crossings are looked for in other cells only. Equal polygons count once. Crossings
then follow the outline, not the square of the depth.

Coordinates on the grid give exact results. Crossings are rounded to it, so a cut edge can move by half a unit, and parts
narrower than that may be lost or kept: the area is wrong by the outline's length times a unit at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom
from tessella.operators import outlines, quadtree
from tessella.shared import drop, spread, written

FINER = 8  # cells along a tile: 64 of them are the bits of a number
MOST = 4096
CROWD = 16
POLYGON = "array<array<struct<x:bigint,y:bigint>>>"


def polygons(vertices: DataFrame, by: list[str], unit: float) -> DataFrame:
    """by, piece, and ``rings``, the open rings of each polygon on the grid, shells (ring 0) anticlockwise and holes clockwise."""
    snap = lambda c: F.round(F.col(c) / unit).cast("long").alias(c)
    r = geom.ring_points(vertices.select(*by, "piece", "ring", "seq", snap("x"), snap("y")), [*by, "piece", "ring"])
    r = r.select(*by, "piece", "ring", geom.only(geom.apart(geom.open_points(F.col("p"))), lambda p: F.size(p) > 2).alias("p"))
    turned = F.when((geom.ring_area2(F.col("p")) > 0) == (F.col("ring") == 0), F.col("p")).otherwise(F.reverse("p"))
    return r.withColumn("p", turned).groupBy(*by, "piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "p"))), lambda s: s["p"]).alias("rings"))


def _edges(shapes: DataFrame, by: list[str]) -> DataFrame:
    ring = shapes.select(*by, "piece", F.explode("rings").alias("p"))
    pair = F.transform("p", lambda v, i: F.struct(v["x"].alias("x1"), v["y"].alias("y1"), F.col("p")[(i + 1) % F.size("p")]["x"].alias("x2"), F.col("p")[(i + 1) % F.size("p")]["y"].alias("y2")))
    return ring.select(*by, "piece", F.explode(pair).alias("e")).select(*by, "piece", "e.*")


def _met(edges: DataFrame, side: int, inside: bool = False) -> DataFrame:
    """An edge for each cell (tx, ty) that it meets, borders included; ``inside``: only for cells of the tile (_bx, _by) of its row."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    low, high = (lambda a: F.least(f"{a}1", f"{a}2")), (lambda a: F.greatest(f"{a}1", f"{a}2"))

    def cells(lo: Column, hi: Column, tile: str) -> Column:
        lo, hi = F.ceil(lo / side) - 1, F.floor(hi / side)
        if inside:
            lo, hi = F.greatest(lo, F.col(tile) * FINER), F.least(hi, F.col(tile) * FINER + FINER - 1)
        return F.explode(F.when(lo <= hi, F.sequence(lo, hi)))

    t = edges.withColumn("tx", cells(low("x"), high("x"), "_bx"))
    at = lambda x: F.col("y1") + (x - F.col("x1")) * dy / dx
    a, b = at(F.greatest(F.col("tx") * side, low("x"))), at(F.least((F.col("tx") + 1) * side, high("x")))
    slanted = (dx != 0) & (dy != 0)
    return t.withColumn("ty", cells(F.when(slanted, F.greatest(low("y"), F.least(a, b) - 1)).otherwise(low("y")), F.when(slanted, F.least(high("y"), F.greatest(a, b) + 1)).otherwise(high("y")), "_by"))


def _full(shapes: DataFrame, by: list[str], side: int, inside: bool = False) -> DataFrame:
    """by, _bx, _by, mask: tiles of FINER by FINER cells, with a bit for each cell that one polygon covers; ``inside``: only in the tile of a row.

    A polygon whose box has more than MOST cells marks none: that costs time, and changes no result.
    """
    edge = lambda r: F.transform(r, lambda v, i: F.struct(F.least(v["x"], r[(i + 1) % F.size(r)]["x"]).alias("a"), F.least(v["y"], r[(i + 1) % F.size(r)]["y"]).alias("b"), F.greatest(v["x"], r[(i + 1) % F.size(r)]["x"]).alias("c"), F.greatest(v["y"], r[(i + 1) % F.size(r)]["y"]).alias("e")))
    s = spread(shapes).withColumn("ends", F.flatten(F.transform("rings", edge)))

    def cells(lo: str, hi: str, tile: str) -> tuple[Column, Column]:
        a = F.ceil(F.array_min(F.transform("ends", lambda e: e[lo])) / side)
        b = F.floor(F.array_max(F.transform("ends", lambda e: e[hi])) / side) - 1
        return (F.greatest(a, F.col(tile) * FINER), F.least(b, F.col(tile) * FINER + FINER - 1)) if inside else (a, b)

    (ax, bx), (ay, by_) = cells("a", "c", "_bx"), cells("b", "e", "_by")
    s = s.withColumns({"_ax": ax, "_cx": bx, "_ay": ay, "_cy": by_}).where("_ax <= _cx and _ay <= _cy").where((F.col("_cx") - F.col("_ax") + 1) * (F.col("_cy") - F.col("_ay") + 1) <= MOST)
    grid = F.flatten(F.transform(F.sequence("_ax", "_cx"), lambda x: F.transform(F.sequence("_ay", "_cy"), lambda y: F.struct(x.alias("tx"), y.alias("ty")))))

    def covered(c: Column) -> Column:
        x, y = c["tx"] * side, c["ty"] * side
        return ~F.exists("ends", lambda e: (e["a"] < x + side) & (e["c"] > x) & (e["b"] < y + side) & (e["e"] > y)) & (_winding(F.col("rings"), x + side / 2, y + side / 2) > 0)

    found = s.select(*by, F.explode(F.filter(grid, covered)).alias("c"))
    tile = [F.floor(F.col(f"c.t{a}") / FINER).alias(f"_b{a}") for a in ("x", "y")]
    return found.groupBy(*by, *tile).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({_bit('c.tx', 'c.ty')} as int))")).alias("mask"))


def _bit(x: str, y: str) -> str:
    return f"(pmod({x}, {FINER}) * {FINER} + pmod({y}, {FINER}))"


def _uncovered(held: DataFrame, full: DataFrame, by: list[str], x: str = "tx", y: str = "ty") -> DataFrame:
    """Rows in tiles (_bx, _by) whose cell (x, y) no polygon covers."""
    open_ = f"mask is null or shiftright(mask, cast({_bit(x, y)} as int)) & 1 = 0"
    return held.join(full, [*by, "_bx", "_by"], "left").where(open_).drop("mask", "_bx", "_by")


def _open(shapes: DataFrame, edges: DataFrame, by: list[str], reach: float) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """Edges for each cell (tx, ty) that they meet and no polygon covers, and the covered cells by side.

    Cells are cut once more while the cells that are left hold many edges.
    """
    side = 1 << max(0, round(math.log2(max(1.0, reach / 4))))
    tiled = lambda t: t.withColumnsRenamed({"tx": "_bx", "ty": "_by"})
    held, asked, levels, inside = tiled(_met(edges, side * FINER)), shapes, [], False
    while True:
        full = written(_full(asked, by, side, inside), "full")
        levels.append((side, full))
        # cells of a tile are made after its mask has come, so tiles are shuffled, not cells
        masked = _met(held.join(full, [*by, "_bx", "_by"], "left"), side, inside=True)
        left = written(masked.where(f"mask is null or shiftright(mask, cast({_bit('tx', 'ty')} as int)) & 1 = 0").drop("mask", "_bx", "_by"), "open")
        if inside:
            drop(before)
        n = left.groupBy(*by, "tx", "ty").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if side < FINER or not n[0] or n[1] <= CROWD * n[0]:
            return left, levels
        before, held, side, inside = left, tiled(left), side // FINER, True
        # a polygon that covers a cell of a tile it has no edge in would cover the tile
        asked = held.select(*by, "piece", "_bx", "_by").distinct().join(geom.dealt(shapes), [*by, "piece"])


def _cut(held: DataFrame, by: list[str]) -> DataFrame:
    """Edges (once each) in pieces between the points where other edges of the group meet them in their cells."""
    t = held.select(*by, *outlines.ENDS, "tx", "ty").distinct()
    once = t.select(*by, *outlines.ENDS).distinct()
    other = t.select(*by, "tx", "ty", *(F.col(c).alias(c.replace("x", "u").replace("y", "v")) for c in outlines.ENDS))
    c = {k: F.col(k) for k in ("x1", "y1", "x2", "y2", "u1", "v1", "u2", "v2")}
    dx, dy, du, dv = c["x2"] - c["x1"], c["y2"] - c["y1"], c["u2"] - c["u1"], c["v2"] - c["v1"]
    apart = (F.least("x1", "x2") > F.greatest("u1", "u2")) | (F.least("u1", "u2") > F.greatest("x1", "x2")) | (F.least("y1", "y2") > F.greatest("v1", "v2")) | (F.least("v1", "v2") > F.greatest("y1", "y2"))
    met = t.join(geom.dealt(other), [*by, "tx", "ty"]).where(~apart & ~((c["x1"] == c["u1"]) & (c["y1"] == c["v1"]) & (c["x2"] == c["u2"]) & (c["y2"] == c["v2"])))
    # Both edges of a pair must find the same point, so it is worked out from the pair in one order.
    first = F.struct("x1", "y1", "x2", "y2") < F.struct(c["u1"].alias("x1"), c["v1"].alias("y1"), c["u2"].alias("x2"), c["v2"].alias("y2"))
    pick = lambda a, b: F.when(first, c[a]).otherwise(c[b])
    pairs = met.withColumns({k: pick(a, b) for k, a, b in (("a1", "x1", "u1"), ("b1", "y1", "v1"), ("a2", "x2", "u2"), ("b2", "y2", "v2"), ("g1", "u1", "x1"), ("h1", "v1", "y1"), ("g2", "u2", "x2"), ("h2", "v2", "y2"))})
    s = F.expr("(a2 - a1) * (h2 - h1) - (b2 - b1) * (g2 - g1)")
    along = F.expr("(g1 - a1) * (h2 - h1) - (h1 - b1) * (g2 - g1)") / s
    across = F.expr("(g1 - a1) * (b2 - b1) - (h1 - b1) * (a2 - a1)") / s
    crossing = F.when((s != 0) & along.between(0.0, 1.0) & across.between(0.0, 1.0), F.struct(F.round(F.col("a1") + along * F.expr("a2 - a1")).cast("long").alias("x"), F.round(F.col("b1") + along * F.expr("b2 - b1")).cast("long").alias("y")))
    on = lambda u, v: (dx * (v - c["y1"]) == dy * (u - c["x1"])) & u.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & v.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    end = lambda u, v: F.when(on(u, v), F.struct(u.alias("x"), v.alias("y")))
    points = pairs.select(*by, *outlines.ENDS, F.explode(F.array(crossing, end(c["u1"], c["v1"]), end(c["u2"], c["v2"]))).alias("q")).where("q is not null").groupBy(*by, *outlines.ENDS).agg(F.collect_set("q").alias("q"))
    whole = once.join(geom.dealt(points), [*by, *outlines.ENDS], "left")
    ends = F.array(F.struct(c["x1"].alias("x"), c["y1"].alias("y")), F.struct(c["x2"].alias("x"), c["y2"].alias("y")))
    place = lambda q: F.struct(((q["x"] - c["x1"]) * dx + (q["y"] - c["y1"]) * dy).alias("t"), q.alias("q"))
    stops = F.array_sort(F.transform(F.array_union(F.coalesce("q", F.array().cast("array<struct<x:bigint,y:bigint>>")), ends), place))
    cut = whole.select(*by, stops.alias("s"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda k: F.struct(F.col("s")[k - 1]["q"]["x"].alias("x1"), F.col("s")[k - 1]["q"]["y"].alias("y1"), F.col("s")[k]["q"]["x"].alias("x2"), F.col("s")[k]["q"]["y"].alias("y2")))
    return cut.select(*by, F.explode(pieces).alias("e")).select(*by, "e.*").distinct()


def _winding(rings: Column, px: Column, py: Column) -> Column:
    """How often the rings of a polygon go round a point."""

    def turns(ring: Column) -> Column:
        def step(v: Column, i: Column) -> Column:
            w = ring[(i + 1) % F.size(ring)]
            beyond = px < v["x"] + (w["x"] - v["x"]) * (py - v["y"]) / (w["y"] - v["y"])
            return F.when((v["y"] <= py) & (w["y"] > py) & beyond, 1).when((v["y"] > py) & (w["y"] <= py) & beyond, -1).otherwise(0)

        return F.aggregate(F.transform(ring, step), F.lit(0), lambda a, b: a + b)

    return F.aggregate(F.transform(rings, turns), F.lit(0), lambda a, b: a + b)


def union_edges(vertices: DataFrame, by: list[str], unit: float) -> DataFrame:
    """The outline of the union of each group's polygons (by, piece, ring, seq, x, y) as edges on the grid, the union on their left."""
    shapes = written(polygons(vertices, by, unit).groupBy(*by, "rings").agg(F.min("piece").alias("piece")), "shapes")
    edges = _edges(shapes, by)
    reach = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    held, levels = _open(shapes, edges, by, edges.agg(F.avg(reach)).first()[0] or 1)
    pieces = _cut(held, by)
    # A point a quarter of a unit to the right of the middle: no vertex and no other line of the grid's directions is as near.
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    far = F.sqrt((dx * dx + dy * dy).cast("double")) * 4
    asked = pieces.select(*by, *outlines.ENDS, ((F.col("x1") + F.col("x2")) / 2 + dy / far).alias("x"), ((F.col("y1") + F.col("y2")) / 2 - dx / far).alias("y"))
    for side, full in levels:
        cell = {f"t{a}": F.floor(F.col(a) / side) for a in ("x", "y")}
        asked = _uncovered(asked.withColumns(cell | {f"_b{a}": F.floor(cell[f"t{a}"] / FINER) for a in ("x", "y")}), full, by).drop("tx", "ty")
    asked = written(asked, "asked")
    drop(held)
    corner = lambda f, c: f(F.transform(F.flatten("rings"), lambda v: v[c])).cast("double")
    boxes = shapes.select(*(F.col(c).alias(f"of_{c}") for c in by), "rings", corner(F.array_min, "x").alias("minx"), corner(F.array_min, "y").alias("miny"), corner(F.array_max, "x").alias("maxx"), corner(F.array_max, "y").alias("maxy"))
    # A polygon of few tiles goes to each of them, so a point asks in its own tile only; large ones are kept once, and points ask at all sizes.
    tile = levels[0][0] * FINER
    spans = {f"_{e}{a}": F.floor(F.col(f"{e}{a}") / tile) for a in ("x", "y") for e in ("min", "max")}
    boxes = boxes.withColumns(spans).withColumn("_few", (F.col("_maxx") - F.col("_minx") + 1) * (F.col("_maxy") - F.col("_miny") + 1) <= FINER * FINER)
    few = boxes.where("_few").withColumn("_bx", F.explode(F.sequence("_minx", "_maxx"))).withColumn("_by", F.explode(F.sequence("_miny", "_maxy"))).withColumnsRenamed({f"of_{c}": c for c in by})
    asking = asked.withColumns({"_bx": F.floor(F.col("x") / tile), "_by": F.floor(F.col("y") / tile)})
    near = asking.join(geom.dealt(few), [*by, "_bx", "_by"]).where("x >= minx and x <= maxx and y >= miny and y <= maxy")
    large = boxes.where("not _few").drop("_few", *spans)
    far_off = quadtree.around_points(asked, large, square=_square(large), by=[(c, f"of_{c}") for c in by])
    cols = [*by, *outlines.ENDS, "x", "y", "rings"]
    around = near.select(cols).union(far_off.select(cols))
    wound = around.groupBy(*by, *outlines.ENDS).agg(F.sum(_winding(F.col("rings"), F.col("x"), F.col("y"))).alias("w")).where("w > 0")
    return asked.select(*by, *outlines.ENDS).join(geom.dealt(wound.drop("w")), [*by, *outlines.ENDS], "left_anti")


def _square(boxes: DataFrame) -> quadtree.grid.Square:
    lo_x, lo_y, hi_x, hi_y = boxes.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    return quadtree.grid.Square.around(lo_x, lo_y, hi_x, hi_y) if lo_x is not None and (hi_x > lo_x or hi_y > lo_y) else quadtree.grid.Square(0.0, 0.0, 1.0)


def rings(edges: DataFrame, by: list[str], unit: float) -> DataFrame:
    """The outline as rings in world coordinates: by, ring, seq, x, y."""
    v = outlines.ring_vertices(outlines.link(edges, by), by)
    return v.withColumns({"x": F.col("x") * unit, "y": F.col("y") * unit})


def dissolve_parcels(spark: SparkSession, d: str) -> DataFrame:
    """The union of all parcels of a brand: its area, the length of its outline, and whether the outline is closed rings."""
    unit = 0.05 / 2  # corners of shells and holes lie on this grid
    v = fx.parcel_vertices(spark, d).join(fx.parcels(spark, d).select("fid", "brand"), "fid")
    edges = written(union_edges(v.select("brand", F.col("fid").alias("piece"), "ring", "seq", "x", "y"), ["brand"], unit), "union")
    rings = outlines.ring_table(outlines.link(edges, ["brand"]), ["brand"])
    length = F.sum(F.hypot((F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double"))).alias("all")
    t = rings.groupBy("brand").agg(F.sum("area2").alias("a"), F.sum("length").alias("l")).join(edges.groupBy("brand").agg(length), "brand")
    return t.select("brand", F.round(F.col("a") / 2 * unit * unit, 4).alias("area"), F.round(F.col("l") * unit, 4).alias("length"), (F.abs(F.col("l") - F.col("all")) < 1e-6).alias("closed"))


QUERIES = {"dissolve_parcels": dissolve_parcels}
_U = "cast(round(({})/0.025e0) as bigint)"
ORACLE_SQL = {
    # Sides of all rectangles cut the plane into cells; a cell is covered if a parcel, less its hole, holds its middle.
    "dissolve_parcels": f"""with {fx.PARCELS_SQL}, r as (select brand, {_U.format('x0')} a, {_U.format('y0')} b, {_U.format('x0+w')} c, {_U.format('y0+h')} e,
      {_U.format('x0+w*0.25e0')} ha, {_U.format('y0+h*0.25e0')} hb, {_U.format('x0+w*0.75e0')} hc, {_U.format('y0+h*0.75e0')} he, has_hole from parcels),
     xs as (select brand, x, lead(x) over (partition by brand order by x) nx from (select brand, a x from r union select brand, c from r union select brand, ha from r where has_hole=1 union select brand, hc from r where has_hole=1)),
     ys as (select brand, y, lead(y) over (partition by brand order by y) ny from (select brand, b y from r union select brand, e from r union select brand, hb from r where has_hole=1 union select brand, he from r where has_hole=1)),
     g as (select distinct brand, x, nx, y, ny from r join xs using (brand) join ys using (brand) where x>=a and x<c and y>=b and y<e and not (has_hole=1 and x>=ha and x<hc and y>=hb and y<he)),
     n as (select g.*, l.x lx, o.x rx, u.y uy, w.y wy from g left join g l on l.brand=g.brand and l.y=g.y and l.nx=g.x left join g o on o.brand=g.brand and o.y=g.y and o.x=g.nx
      left join g u on u.brand=g.brand and u.x=g.x and u.ny=g.y left join g w on w.brand=g.brand and w.x=g.x and w.y=g.ny)
     select brand, round(sum((nx-x)*(ny-y))*0.025e0*0.025e0,4) area,
      round(sum(case when lx is null then ny-y else 0 end+case when rx is null then ny-y else 0 end+case when uy is null then nx-x else 0 end+case when wy is null then nx-x else 0 end)*0.025e0,4) length, true closed from n group by 1""",
}
