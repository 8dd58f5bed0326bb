"""Tile assignment, spatial joins, grid partitions, coverage and viewport queries.

Spatial joins are equi-joins on the keys of tiles that a feature's box meets, refined on the exact test. A pair that meets
in several tiles is kept in one only, the tile of the larger of the lower-left corners, so no distinct is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom, grid, kernels
from tessella.shared import spread, written

SQUARE = grid.Square(-180.0, -180.0, 360.0)
_KEY = "(cast({l} as bigint)<<48)|(tx<<24)|ty"


def with_tile(df: DataFrame, level: int, x: str = "x", y: str = "y", square: grid.Square = SQUARE) -> DataFrame:
    """Adds tx and ty, the tile that holds a point."""
    side, n = square.tile_side(level), 1 << level
    return df.withColumn("tx", grid.tile_index(F.col(x), square.x, side, n)).withColumn("ty", grid.tile_index(F.col(y), square.y, side, n))


def with_tiles(df: DataFrame, level: int, minx: Column, miny: Column, maxx: Column, maxy: Column, square: grid.Square = SQUARE) -> DataFrame:
    """One row for each tile that a box meets."""
    side, n = square.tile_side(level), 1 << level
    at = lambda v, o: grid.tile_index(v, o, side, n)
    rows = df.withColumn("tx", F.explode(F.sequence(at(minx, square.x), at(maxx, square.x))))
    return rows.withColumn("ty", F.explode(F.sequence(at(miny, square.y), at(maxy, square.y))))


def box_join(left: DataFrame, right: DataFrame, level: int, square: grid.Square = SQUARE) -> DataFrame:
    """Pairs of rows whose boxes (minx, miny, maxx, maxy) overlap or touch; columns of the right get the prefix ``r_``."""
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    rbox = [F.col(f"r_{c}") for c in ("minx", "miny", "maxx", "maxy")]
    met = with_tiles(left, level, *box, square).join(with_tiles(r, level, *rbox, square), ["tx", "ty"])
    side, n = square.tile_side(level), 1 << level
    own = (F.col("tx") == grid.tile_index(F.greatest("minx", "r_minx"), square.x, side, n)) & (F.col("ty") == grid.tile_index(F.greatest("miny", "r_miny"), square.y, side, n))
    return met.where((box[0] <= rbox[2]) & (rbox[0] <= box[2]) & (box[1] <= rbox[3]) & (rbox[1] <= box[3]) & own)


def overlap_counts(boxes: DataFrame, level: int, square: grid.Square = SQUARE) -> DataFrame:
    """How many rows of other fids each fid's boxes (fid, minx, miny, maxx, maxy) overlap or touch, where there are any: fid, n_overlaps.

    Pairs aren't made: equal boxes count once, with their number, and a tile's boxes are counted against each other by order, in n log n. A tile
    counts the pairs that :func:`box_join` would keep in it. A task holds the different boxes of one tile.
    """
    box = ["minx", "miny", "maxx", "maxy"]
    known = boxes.select("fid", *box).dropna(subset=box)
    turned = F.expr("minx > maxx or miny > maxy")  # inside out: such boxes are rare and go as pairs
    odd, even = known.where(turned), known.where(~turned)
    once = even.groupBy(*box).agg(F.count("*").alias("n"))
    side, n = square.tile_side(level), 1 << level
    tiles = with_tiles(once, level, *(F.col(c) for c in box), square)
    tiles = tiles.withColumns({"begins_x": F.col("tx") == grid.tile_index(F.col("minx"), square.x, side, n), "begins_y": F.col("ty") == grid.tile_index(F.col("miny"), square.y, side, n)})
    met = tiles.groupBy("tx", "ty").applyInArrow(_tile_counts, "minx double, miny double, maxx double, maxy double, n long").groupBy(*box).agg(F.sum("n").alias("n"))
    meet = lambda a, b: (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])
    own = even.groupBy("fid").agg(F.collect_list(F.struct(*box)).alias("own"))
    same = F.size(F.flatten(F.transform("own", lambda a: F.filter("own", lambda b: meet(a, b)))))
    rows = own.select("fid", same.alias("same"), F.explode("own").alias("b")).select("fid", "same", "b.*")
    out = rows.join(geom.dealt(met), box).groupBy("fid").agg((F.sum("n") - F.first("same")).alias("n_overlaps"))
    if not odd.isEmpty():
        pairs = box_join(odd, known, level, square).union(box_join(even, odd, level, square)).where("fid <> r_fid")
        out = out.union(pairs.groupBy("fid").agg(F.count("*"))).groupBy("fid").agg(F.sum("n_overlaps").alias("n_overlaps"))
    return out.where("n_overlaps > 0")


def _tile_counts(t: pa.Table) -> pa.Table:
    box = [t[c].to_numpy() for c in ("minx", "miny", "maxx", "maxy")]
    n, x, y = (t[c].to_numpy() for c in ("n", "begins_x", "begins_y"))
    met = np.zeros(len(n), np.int64)
    for ask_x, ask_y in ((True, True), (True, False), (False, True), (False, False)):
        # a pair is counted where one of its boxes begins, in each axis
        asks, of = (x == ask_x) & (y == ask_y), (x | ask_x) & (y | ask_y)
        if asks.any() and of.any():
            met[asks] = kernels.overlap_sums(tuple(c[of] for c in box), n[of], tuple(c[asks] for c in box))
    return pa.table({"minx": box[0], "miny": box[1], "maxx": box[2], "maxy": box[3], "n": met})


def tile_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Sites by tile of level 3."""
    t = with_tile(fx.sites(spark, d), 3).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.min("fid").alias("min_fid"), F.round(F.sum("amount"), 2).alias("amount"))
    return t.select(grid.tile_key(3, F.col("tx"), F.col("ty")).alias("tile"), "n", "min_fid", "amount")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return fx.parcels(spark, d).selectExpr("fid", "x0", "y0", "w", "h", "has_hole", "brand", "x0 minx", "y0 miny", "x0+w maxx", "y0+h maxy")


def ring_tiles(spark: SparkSession, d: str) -> DataFrame:
    """How many parcels each tile of level 5 gets."""
    t = with_tiles(_boxes(spark, d), 5, *(F.col(c) for c in ("minx", "miny", "maxx", "maxy")))
    return t.groupBy("tx", "ty").agg(F.count("*").alias("n"))


def held_points(points: DataFrame, vertices: DataFrame, level: int, square: grid.Square = SQUARE) -> DataFrame:
    """How many points (fid, x, y) each polygon in vertex form holds, even-odd, and the smallest fid of those; only polygons that hold any: parcel, n_sites, first_site.

    A tile's points and polygons are dealt to blocks, and a row of the join is two blocks, which are counted against each other by halves of the
    points (:func:`kernels.points_in_polygons`), so no pair of point and polygon is made. A block has at most 8,192 points, or polygons of about
    16,384 vertices together (one polygon at least).
    """
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    of = vertices.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("part", "ring", "seq", "x", "y"))).alias("p"))
    begins = lambda v, i: (i == 0) | (F.struct(v["part"], v["ring"]) != F.struct(F.col("p")[i - 1]["part"], F.col("p")[i - 1]["ring"]))
    corner = lambda f, c: f(F.transform("p", lambda v: v[c])).alias(f"{'min' if f is F.array_min else 'max'}{c}")
    rings = F.transform("p", lambda v, i: F.struct(v["x"].alias("x"), v["y"].alias("y"), begins(v, i).alias("starts"))).alias("v")
    boxed = of.select(F.col("fid").alias("parcel"), rings, *(corner(f, c) for f in (F.array_min, F.array_max) for c in ("x", "y")))
    tiles = with_tiles(boxed, level, *box, square).select("tx", "ty", "parcel", "v", F.size("v").cast("long").alias("n"))
    along = Window.partitionBy("tx", "ty")
    upto = F.sum("n").over(along.orderBy("parcel").rowsBetween(Window.unboundedPreceding, -1))
    polygons = tiles.withColumn("block", F.floor(F.coalesce(upto, F.lit(0)) / 16384)).groupBy("tx", "ty", "block").agg(F.collect_list(F.struct("parcel", "v")).alias("polygons"))
    known = points.select("fid", "x", "y").where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    s = with_tile(known, level, square=square).withColumn("block", F.floor((F.row_number().over(along.orderBy("x", "y")) - 1) / 8192))
    sites = s.groupBy("tx", "ty", "block").agg(F.collect_list(F.struct("fid", "x", "y")).alias("points"))
    both = sites.select("tx", "ty", "points").join(geom.dealt(polygons.select("tx", "ty", "polygons")), ["tx", "ty"]).select("points", "polygons")
    held = both.mapInArrow(_held_points, "parcel long, n_sites long, first_site long")  # no first_site where there is none
    return held.groupBy("parcel").agg(F.sum("n_sites").alias("n_sites"), F.min("first_site").alias("first_site"), F.count("first_site").alias("met")).where("met > 0").drop("met")


def _held_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            fid, x, y = (c.to_numpy(zero_copy_only=False) for c in batch["points"].slice(k, 1).flatten().flatten())
            parcel, v = batch["polygons"].slice(k, 1).flatten().flatten()
            vx, vy, starts = (c.to_numpy(zero_copy_only=False) for c in v.flatten().flatten())
            n, first = kernels.points_in_polygons(x, y, fid, vx, vy, starts, v.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([parcel, pa.array(n), pa.array(first, mask=n == 0)], ["parcel", "n_sites", "first_site"])


def point_in_polygon_join(spark: SparkSession, d: str) -> DataFrame:
    """Sites in parcels, holes excluded, by ray casting over ring edges."""
    return held_points(fx.sites(spark, d), fx.parcel_vertices(spark, d), 7)


def bbox_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """How many other parcels each parcel's box overlaps."""
    return overlap_counts(_boxes(spark, d), 7)


def tolerance(pixels: float, units_per_pixel: float) -> float:
    """A click's reach in units of the map, from the reach on the screen and the scale."""
    return max(0.0, pixels) * abs(units_per_pixel)


def identify_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Nearest feature of each layer within a click's reach of fixed query points, with an attribute; ties go to the smallest fid.

    The distance is that of the geometry: 0 inside a polygon, and in a hole that to its edge.
    """
    at = [(0, 0), (10, 10), (-100, 50), (33.3, -44.4), (150, -60), (43.5, 43.4), (-64.6, 16.55), (127.3, -10.3)]
    queries = F.broadcast(spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)], "q int, qx double, qy double"))
    tol = tolerance(10, 0.4)
    close = lambda minx, miny, maxx, maxy: (F.col(minx) <= F.col("qx") + tol) & (F.col(maxx) >= F.col("qx") - tol) & (F.col(miny) <= F.col("qy") + tol) & (F.col(maxy) >= F.col("qy") - tol)
    s = fx.sites(spark, d).join(queries, close("x", "y", "x", "y"))
    s = s.select("q", F.concat(F.lit("sites_"), "status").alias("layer"), "fid", F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy")).alias("d"), F.col("status").alias("attribute"))
    # Boxes first, then the edges of those parcels alone.
    boxes = _boxes(spark, d).join(queries, close("minx", "miny", "maxx", "maxy")).select("q", "qx", "qy", "fid")
    near = fx.parcel_vertices(spark, d).join(boxes.select("fid").distinct(), "fid", "left_semi")
    edges = geom.segments(near, ["fid", "part", "ring"]).join(boxes, "fid")
    ends = [F.col(c) for c in ("qx", "qy", "x1", "y1", "x2", "y2")]
    p = edges.groupBy("q", "fid").agg(F.min(geom.segment_distance(*ends)).alias("d"), (F.sum(geom.crosses_ray(*ends).cast("int")) % 2).alias("inside"))
    p = p.join(fx.parcels(spark, d).select("fid", "brand"), "fid")
    p = p.select("q", F.lit("parcels").alias("layer"), "fid", F.when(F.col("inside") == 1, 0.0).otherwise(F.col("d")).alias("d"), F.col("brand").alias("attribute"))
    best = s.union(p).where(F.col("d") <= tol).groupBy("q", "layer").agg(F.min(F.struct("d", "fid", "attribute")).alias("b"))
    return best.select("q", "layer", F.col("b.fid").alias("fid"), F.round("b.d", 6).alias("distance"), "b.attribute")


def region_read(spark: SparkSession, d: str) -> DataFrame:
    """Parcels whose boxes meet a rectangle, by the tile of level 4 that they go to."""
    r = _boxes(spark, d).where("minx <= 20 and maxx >= -30 and miny <= 25 and maxy >= -15")
    t = with_tiles(r, 4, *(F.col(c) for c in ("minx", "miny", "maxx", "maxy")))
    return t.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.min("fid").alias("first_fid"))


def grid_partition(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of about 1,000 floats: grid side from the number of floats, cell of each point, dense bucket numbers."""
    s = fx.sites(spark, d)
    n, minx, miny, maxx, maxy = s.agg(F.count("*"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    side = grid_side(2 * n, 1000)
    cell = lambda c, lo, hi: F.least(F.lit(side - 1), F.floor((F.col(c) - F.lit(lo)) / F.lit((hi - lo) / side))).cast("int")
    b = s.groupBy(cell("y", miny, maxy).alias("gy"), cell("x", minx, maxx).alias("gx")).agg(F.count("*").alias("n"), F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"))
    # at most 252 * 252 non-empty cells
    return b.withColumn("bucket", F.dense_rank().over(Window.orderBy("gy", "gx")).cast("long"))


def grid_side(n_floats: int, bucket: int = 262144, most: int = 252) -> int:
    import math

    return max(1, min(most, math.ceil(math.sqrt(n_floats / bucket))))


def visible_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of a view at the level that its scale asks for, with pixel rectangles."""
    view = grid.View(10.0, 20.0, 0.05, 1600, 900)
    level = grid.wanted_level(SQUARE.side, view.scale)
    x0, y0, x1, y1 = grid.visible_range(SQUARE, level, *view.extent())
    t = with_tile(fx.sites(spark, d), level).where((F.col("tx").between(x0, x1)) & (F.col("ty").between(y0, y1)))
    return t.groupBy("tx", "ty").agg(F.count("*").alias("n")).select("tx", "ty", "n", *(c.alias(k) for k, c in grid.screen_rect(view, SQUARE, level, F.col("tx"), F.col("ty")).items()))


def level_table(spark: SparkSession, d: str) -> DataFrame:
    """The level that each of several scales asks for and the one it gets when only even levels are built."""
    scales = spark.range(0, 12).select((F.lit(1.0) / F.pow(F.lit(2.0), F.col("id").cast("double"))).alias("scale"))
    wanted = F.greatest(F.lit(0), F.round(F.log2(F.lit(360.0) / (F.lit(512.0) * F.col("scale"))))).cast("int")
    return scales.withColumn("wanted", wanted).withColumn("chosen", (F.least(F.col("wanted"), F.lit(8)) - F.least(F.col("wanted"), F.lit(8)) % 2).cast("int"))


def row_directory(spark: SparkSession, d: str) -> DataFrame:
    """For each level and tile row the first column and how many columns up to the last."""
    t = with_tile(fx.sites(spark, d), 6).select(F.lit(6).alias("level"), "tx", "ty").distinct()
    return t.groupBy("level", "ty").agg(F.min("tx").alias("tx_lo"), (F.max("tx") - F.min("tx") + 1).alias("count"))


def tile_order(spark: SparkSession, d: str) -> DataFrame:
    t = with_tile(fx.sites(spark, d), 4).groupBy("tx", "ty").agg(F.count("*").alias("n"))
    return t.select(F.lit(4).alias("level"), "ty", "tx", "n").orderBy("level", "ty", "tx")


def coverage_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Small parcels counted by cell of a tile, saturating, then by blocks of cells with the width of their mark."""
    cell = 360.0 / 2048
    p = fx.parcels(spark, d).selectExpr("x0 + w/2 cx", "y0 + h/2 cy")
    cells = p.groupBy(F.floor((F.col("cx") + 180) / cell).cast("int").alias("lx"), F.floor((F.col("cy") + 180) / cell).cast("int").alias("ly")).agg(F.least(F.lit(255), F.count("*")).alias("cnt"))
    k = block_cells(0.125)
    b = cells.groupBy(F.floor(F.col("lx") / k).cast("int").alias("bx"), F.floor(F.col("ly") / k).cast("int").alias("by")).agg(F.least(F.lit(255), F.sum("cnt")).cast("long").alias("cnt"))
    return b.withColumn("size", mark_size(F.col("cnt")))


def block_cells(cell_px: float) -> int:
    return max(1, min(4096, int(1 / cell_px))) if cell_px > 0 else 1


def mark_size(cnt: Column) -> Column:
    """Pixels of a mark by count, between 0.8 and 6."""
    return F.greatest(F.lit(0.8), F.least(F.lit(6.0), F.when(cnt >= 8, 3.0).when(cnt >= 4, 2.2).when(cnt >= 2, 1.5).otherwise(1.0)))


def feature_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Parcels on a 64 by 64 grid by the upper-right corners of their boxes."""
    at = lambda c: grid.tile_index(F.col(c), -180.0, 360.0 / 64, 64)
    return _boxes(spark, d).groupBy(at("maxx").alias("tx"), at("maxy").alias("ty")).agg(F.count("*").alias("n"))


def tile_stats(spark: SparkSession, d: str) -> DataFrame:
    """For each level: non-empty tiles, all slots, points and points a tile."""
    t = None
    for level in range(0, 7):
        own = with_tile(fx.sites(spark, d), level).groupBy(F.lit(level).alias("level"), "tx", "ty").agg(F.count("*").alias("n"))
        t = own if t is None else t.union(own)
    return t.groupBy("level").agg(F.count("*").alias("n_tiles"), F.sum("n").alias("n_points"), F.round(F.avg("n"), 6).alias("per_tile")).withColumn("slots", F.pow(F.lit(4.0), F.col("level").cast("double")).cast("long"))


def parent_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Counts of level 6 rolled up into level 4."""
    t = with_tile(fx.sites(spark, d), 6).groupBy("tx", "ty").agg(F.count("*").alias("n"))
    return t.groupBy(F.shiftright("tx", 2).alias("tx"), F.shiftright("ty", 2).alias("ty")).agg(F.count("*").alias("n_children"), F.sum("n").alias("n"))


def hole_to_shell(spark: SparkSession, d: str) -> DataFrame:
    """The shell of each hole within its feature: the ring that holds the hole's first vertex."""
    v = fx.parcel_vertices(spark, d)
    hole = v.where("ring > 0 and seq = 0").select("fid", F.col("ring").alias("hole"), F.col("x").alias("px"), F.col("y").alias("py"))
    e = geom.segments(v.where("ring = 0"), ["fid", "ring"])
    inside = F.sum(geom.crosses_ray(*(F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2"))).cast("int")) % 2
    return hole.join(e, "fid").groupBy("fid", "hole", "ring").agg(inside.alias("inside")).where("inside = 1").select("fid", "hole", F.col("ring").alias("shell"))


def nesting_depth(spark: SparkSession, d: str) -> DataFrame:
    """How many other rings of its feature hold each ring; even depths are shells."""
    v = fx.parcel_vertices(spark, d)
    probe = v.where("seq = 0").select("fid", "ring", F.col("x").alias("px"), F.col("y").alias("py"))
    e = geom.segments(v, ["fid", "ring"]).withColumnRenamed("ring", "other")
    odd = F.sum(geom.crosses_ray(*(F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2"))).cast("int")) % 2
    by = probe.join(e, "fid").where("ring <> other").groupBy("fid", "ring", "other").agg(odd.alias("inside")).groupBy("fid", "ring").agg(F.sum("inside").alias("depth"))
    return probe.select("fid", "ring").join(by, ["fid", "ring"], "left").select("fid", "ring", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def edge_pairs(vertices: DataFrame) -> DataFrame:
    """Pairs of features with common undirected edges (fid, part, seq, x, y), and how many: fid, other, n_shared. Edges without length don't count.

    Features with the same edges form a class. Classes are written, met and counted, and their pairs taken apart into pairs of features last, in the task
    that yields them: those can grow with the square of the input, but are neither shuffled nor sorted. A class's fids are gathered in one row.
    """
    of = vertices.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "x", "y"))).alias("p"))
    point = lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))
    edge = lambda v, w: F.when((v["part"] == w["part"]) & ((v["x"] != w["x"]) | (v["y"] != w["y"])), F.struct(F.least(point(v), point(w)).alias("a"), F.greatest(point(v), point(w)).alias("b")))
    edges = F.filter(F.transform("p", lambda v, i: edge(v, F.get("p", i + 1))), lambda e: e.isNotNull())
    kinds = of.select("fid", F.array_sort(F.array_distinct(edges)).alias("edges")).where("size(edges) > 0").groupBy("edges").agg(F.min("fid").alias("kind"), F.collect_list("fid").alias("fids"))
    kinds = written(kinds, "edge-kinds")
    e = kinds.select("kind", F.explode("edges").alias("e")).select("kind", "e.a", "e.b")
    met = e.join(geom.dealt(e.withColumnRenamed("kind", "met")), ["a", "b"]).where("kind < met").groupBy("kind", "met").agg(F.count("*").alias("n_shared"))
    met = met.union(kinds.where("size(fids) > 1").select("kind", F.col("kind").alias("met"), F.size("edges").cast("long")))
    block = 1024
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("fids") - 1) / block).cast("int")), lambda k: F.slice("fids", k * block + 1, block))
    held = kinds.select("kind", F.explode(runs).alias("fids"))
    left = spread(met.join(geom.dealt(held), "kind"), "met")
    both = left.join(geom.dealt(held.select(F.col("kind").alias("met"), F.col("fids").alias("others"))), "met")
    pairs = both.select("kind", "met", "n_shared", "others", F.explode("fids").alias("one")).select("kind", "met", "n_shared", "one", F.explode("others").alias("two"))
    return pairs.where("kind <> met or one < two").select(F.least("one", "two").alias("fid"), F.greatest("one", "two").alias("other"), "n_shared")


def shared_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parcels with common undirected edges on a coarse grid, and how many."""
    return edge_pairs(fx.parcel_vertices(spark, d).where("ring = 0").select("fid", "part", "seq", *(F.round(F.col(c) / 2).cast("long").alias(c) for c in ("x", "y"))))


def nearest_vectors(asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """The nearest vector of the same label, another than itself, for each asked one: vec_id, b (d, other); ties go to the smallest id.

    Vectors are compared a block at a time (640 rows at most), and only the block's nearest goes on, so neither pairs nor vectors are sorted
    or shuffled by pairs. Work is the product of both sides by its nature; a label's queries are dealt to eight tasks, which each get its blocks.
    """
    deals = 8
    pick = lambda c, name: vectors.select(*c, F.transform("embedding", lambda v: v.cast("double")).alias(name))
    block = F.floor(F.monotonically_increasing_id() / 640).alias("block")
    blocks = pick(["label", block, F.col("vec_id").alias("other")], "w").groupBy("label", "block").agg(F.collect_list(F.struct("other", "w")).alias("of"))
    blocks = blocks.select("label", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "of")
    e = asked.select("vec_id", "label", F.pmod(F.hash("vec_id"), F.lit(deals)).alias("deal"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    dist = lambda w: F.aggregate(F.zip_with("v", w, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    near = F.array_min(F.transform(F.filter("of", lambda o: o["other"] != F.col("vec_id")), lambda o: F.struct(F.round(dist(o["w"]), 6).alias("d"), o["other"].alias("other"))))
    # worked out before rows are sorted for the aggregate, which would take the vectors along
    met = e.join(geom.dealt(blocks), ["label", "deal"]).select("vec_id", geom.only(near, lambda n: n.isNotNull()).alias("n"))
    return met.groupBy("vec_id").agg(F.min("n").alias("b"))


def knn_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vector of the same label for every vector whose id is divisible by 50, against all vectors."""
    e = fx.table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return nearest_vectors(e.where("vec_id % 50 = 0"), e).select("vec_id", F.col("b.other").alias("nearest"), F.round("b.d", 5).alias("d2"))


QUERIES = {f.__name__: f for f in (
    tile_coverage, ring_tiles, point_in_polygon_join, bbox_overlap_join, identify_nearest, region_read, grid_partition, visible_tiles, level_table, row_directory, tile_order,
    coverage_blocks, feature_histogram, tile_stats, parent_tiles, hole_to_shell, nesting_depth, shared_edges, knn_vectors,
)}


def _tile(level: int, x: str, o: str = "180e0") -> str:
    n = 1 << level
    return f"cast(least({n - 1}, greatest(0, floor(({x}+{o})/{360 / n!r}e0))) as bigint)"


_BOX = "b as (select fid, x0, y0, w, h, x0 minx, y0 miny, x0+w maxx, y0+h maxy from parcels)"
_CROSS = "case when (y1>{y})<>(y2>{y}) and {x}<(x2-x1)*({y}-y1)/(y2-y1)+x1 then 1 else 0 end"
_E = "edges as (select * from (select fid, ring, seq, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from parcel_vertices window w as (partition by fid, ring order by seq)) where x2 is not null)"
ORACLE_SQL = {
    "tile_coverage": f"with {fx.SITES_SQL}, t as (select {_tile(3, 'x')} tx, {_tile(3, 'y')} ty, fid, amount from sites) select (cast(3 as bigint)<<48)|(tx<<24)|ty tile, count(*) n, min(fid) min_fid, round(sum(amount),2) amount from t group by 1",
    "ring_tiles": f"""with {fx.PARCELS_SQL}, {_BOX}, r as (select fid, unnest(range({_tile(5, 'minx')}, {_tile(5, 'maxx')}+1)) tx, {_tile(5, 'miny')} a, {_tile(5, 'maxy')} z from b),
     s as (select fid, tx, unnest(range(a, z+1)) ty from r) select cast(tx as int) tx, cast(ty as int) ty, count(*) n from s group by 1,2""",
    "point_in_polygon_join": f"""with {fx.SITES_SQL}, {fx.PARCELS_SQL}, h as (select p.fid parcel, s.fid from sites s, parcels p where s.x>=x0 and s.x<x0+w and s.y>=y0 and s.y<y0+h
      and not (has_hole=1 and s.x>=x0+w*0.25e0 and s.x<x0+w*0.75e0 and s.y>=y0+h*0.25e0 and s.y<y0+h*0.75e0)) select parcel, count(*) n_sites, min(fid) first_site from h group by 1""",
    "bbox_overlap_join": f"with {fx.PARCELS_SQL}, {_BOX} select l.fid, count(*) n_overlaps from b l, b r where l.fid<>r.fid and l.minx<=r.maxx and r.minx<=l.maxx and l.miny<=r.maxy and r.miny<=l.maxy group by 1",
    # Rectangles are measured by their sides; their holes take the middle half of both.
    "identify_nearest": f"""with {fx.SITES_SQL}, {fx.PARCELS_SQL}, q(q,qx,qy) as (values (0,0e0,0e0),(1,10e0,10e0),(2,-100e0,50e0),(3,33.3e0,-44.4e0),(4,150e0,-60e0),(5,43.5e0,43.4e0),(6,-64.6e0,16.55e0),(7,127.3e0,-10.3e0)),
     h as (select *, has_hole=1 and qx>x0+w/4 and qx<x0+w*3/4 and qy>y0+h/4 and qy<y0+h*3/4 in_hole from parcels, q),
     n as (select q, 'sites_'||status layer, fid, sqrt(pow(x-qx,2)+pow(y-qy,2)) d, status attribute from sites, q union all
      select q, 'parcels', fid, case when in_hole then least(qx-x0-w/4, x0+w*3/4-qx, qy-y0-h/4, y0+h*3/4-qy) else sqrt(pow(greatest(0e0,x0-qx,qx-x0-w),2)+pow(greatest(0e0,y0-qy,qy-y0-h),2)) end, brand from h),
     r as (select *, row_number() over (partition by q, layer order by d, fid) k from n where d<=4) select q, layer, fid, round(d,6) distance, attribute from r where k=1""",
    "region_read": f"""with {fx.PARCELS_SQL}, {_BOX}, r as (select fid, unnest(range({_tile(4, 'minx')}, {_tile(4, 'maxx')}+1)) tx, {_tile(4, 'miny')} a, {_tile(4, 'maxy')} z from b where minx<=20 and maxx>=-30 and miny<=25 and maxy>=-15),
     s as (select fid, tx, unnest(range(a, z+1)) ty from r) select cast(tx as int) tx, cast(ty as int) ty, count(*) n, min(fid) first_fid from s group by 1,2""",
    "grid_partition": f"""with {fx.SITES_SQL}, e as (select least(252, greatest(1, ceil(sqrt(2*count(*)/1000e0)))) g, min(x) ax, max(x) bx, min(y) ay, max(y) b_y from sites),
     c as (select cast(least(g-1, floor((y-ay)/((b_y-ay)/g))) as int) gy, cast(least(g-1, floor((x-ax)/((bx-ax)/g))) as int) gx, x, y from sites, e)
     select gy, gx, count(*) n, min(x) minx, max(x) maxx, min(y) miny, max(y) maxy, row_number() over (order by gy, gx) bucket from c group by 1,2""",
    "visible_tiles": f"""with {fx.SITES_SQL}, t as (select cast({_tile(4, 'x')} as int) tx, cast({_tile(4, 'y')} as int) ty from sites), v as (select tx, ty, count(*) n from t where tx between 6 and 10 and ty between 7 and 9 group by 1,2),
     r as (select *, cast(round((-180e0+tx*22.5e0-10e0)/0.05e0+800e0) as int) a, cast(round((-180e0+(tx+1)*22.5e0-10e0)/0.05e0+800e0) as int) b,
      cast(round(450e0-(-180e0+(ty+1)*22.5e0-20e0)/0.05e0) as int) c, cast(round(450e0-(-180e0+ty*22.5e0-20e0)/0.05e0) as int) e from v)
     select tx, ty, n, a px, c py, greatest(1,b-a) pw, greatest(1,e-c) ph from r""",
    "level_table": """with s as (select 1e0/pow(2e0, unnest(range(12))) scale), w as (select scale, cast(greatest(0, round(log2(360e0/(512e0*scale)))) as int) wanted from s)
     select scale, wanted, cast(least(wanted,8)-least(wanted,8)%2 as int) chosen from w""",
    "row_directory": f"with {fx.SITES_SQL}, t as (select distinct cast({_tile(6, 'x')} as int) tx, cast({_tile(6, 'y')} as int) ty from sites) select 6 as level, ty, min(tx) tx_lo, max(tx)-min(tx)+1 as count from t group by 2",
    "tile_order": f"with {fx.SITES_SQL}, t as (select cast({_tile(4, 'x')} as int) tx, cast({_tile(4, 'y')} as int) ty from sites) select 4 as level, ty, tx, count(*) n from t group by ty, tx order by ty, tx",
    "coverage_blocks": f"""with {fx.PARCELS_SQL}, c as (select cast(floor((x0+w/2+180e0)/(360e0/2048e0)) as int) lx, cast(floor((y0+h/2+180e0)/(360e0/2048e0)) as int) ly, least(255,count(*)) cnt from parcels group by 1,2),
     b as (select cast(floor(lx/8e0) as int) bx, cast(floor(ly/8e0) as int) as by_, cast(least(255,sum(cnt)) as bigint) cnt from c group by 1,2)
     select bx, by_ as by, cnt, case when cnt>=8 then 3e0 when cnt>=4 then 2.2e0 when cnt>=2 then 1.5e0 else 1e0 end size from b""",
    "feature_histogram": f"with {fx.PARCELS_SQL}, {_BOX} select cast({_tile(6, 'maxx')} as int) tx, cast({_tile(6, 'maxy')} as int) ty, count(*) n from b group by 1,2",
    "tile_stats": f"with {fx.SITES_SQL}, t as (" + " union all ".join(f"select {k} as level, {_tile(k, 'x')} tx, {_tile(k, 'y')} ty, count(*) n from sites group by 2,3" for k in range(7)) + ") select level, count(*) n_tiles, cast(sum(n) as bigint) n_points, round(avg(n),6) per_tile, cast(pow(4,level) as bigint) slots from t group by 1",
    "parent_tiles": f"with {fx.SITES_SQL}, t as (select cast({_tile(6, 'x')} as int) tx, cast({_tile(6, 'y')} as int) ty, count(*) n from sites group by 1,2) select tx>>2 tx, ty>>2 ty, count(*) n_children, cast(sum(n) as bigint) n from t group by 1,2",
    "hole_to_shell": f"with {fx.PARCELS_SQL} select fid, 1 as hole, 0 as shell from parcels where has_hole=1",
    "nesting_depth": f"""with {fx.VERTICES_SQL}, {_E}, p as (select fid, ring, x px, y py from parcel_vertices where seq=0),
     k as (select p.fid, p.ring, e.ring other, sum({_CROSS.format(x='px', y='py')})%2 inside from p join edges e on p.fid=e.fid and p.ring<>e.ring group by 1,2,3),
     s as (select fid, ring, sum(inside) depth from k group by 1,2) select p.fid, p.ring, cast(coalesce(depth,0) as bigint) depth from p left join s using (fid, ring)""",
    "shared_edges": f"""with {fx.VERTICES_SQL}, v as (select fid, seq, cast(round(x/2) as bigint) x, cast(round(y/2) as bigint) y from parcel_vertices where ring=0),
     e as (select fid, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from v window w as (partition by fid order by seq)),
     k as (select distinct fid, case when (x1,y1)<=(x2,y2) then x1 else x2 end a, case when (x1,y1)<=(x2,y2) then y1 else y2 end b, case when (x1,y1)<=(x2,y2) then x2 else x1 end c, case when (x1,y1)<=(x2,y2) then y2 else y1 end e
      from e where x2 is not null and (x1<>x2 or y1<>y2)) select l.fid, r.fid other, count(*) n_shared from k l join k r using (a,b,c,e) where l.fid<r.fid group by 1,2""",
    "knn_vectors": """with p as (select l.vec_id, r.vec_id other, round(list_sum(list_transform(list_zip(l.embedding, r.embedding), lambda z: pow(cast(z[1] as double)-cast(z[2] as double),2))),6) d
      from embeddings l join embeddings r on l.label=r.label and l.vec_id<>r.vec_id where l.vec_id%50=0),
     k as (select *, row_number() over (partition by vec_id order by d, other) n from p) select vec_id, other nearest, round(d,5) d2 from k where n=1""",
}
