"""Directed edges linked into rings, and the outlines of raster regions.

Edges have their region on the left. At a vertex an edge goes on into the one that turns furthest to the left, so rings that touch
at a point stay apart. Places along rings come from pointer jumping: each edge knows the smallest edge among the next 2^k and
its distance, and the edge 2^k further on; k joins later it knows that of its whole ring. The number of joins is
logarithmic in the longest ring, and no ring is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.shared import drop, written

ENDS = ("x1", "y1", "x2", "y2")


def link(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges (by, x1, y1, x2, y2) with ``ring``, a number, ``seq``, the place along it, and ``bend``, whether the ring turns at (x2, y2).

    Edges of a group must form closed rings; edges that none follows are left out.
    """
    e = written(edges.select(*by, *ENDS).withColumn("id", F.monotonically_increasing_id()), "edges")
    f = e.select(*by, F.col("id").alias("next"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"))
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x3") - F.col("x2"), F.col("y3") - F.col("y2")
    turn = F.struct(F.atan2((dx * ey - dy * ex).cast("double"), (dx * ex + dy * ey).cast("double")).alias("turn"), F.col("next"))
    follows = e.join(f, [*by, "x2", "y2"]).groupBy("id").agg(F.max(turn).alias("t"))
    straight = F.abs("t.turn") < 1e-12
    state = written(follows.select("id", F.col("t.next").alias("hop"), (~straight).alias("bend"), F.col("id").alias("low"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("lower")), "links")
    span = 1
    while not state.where("lower").isEmpty():
        ahead = state.select(F.col("id").alias("hop"), F.col("hop").alias("far"), F.col("low").alias("ahead_low"), F.col("off").alias("ahead_off"))
        lower = F.col("ahead_low") < F.col("low")
        moved = state.join(ahead, "hop").select("id", F.col("far").alias("hop"), "bend", F.least("low", "ahead_low").alias("low"), F.when(lower, F.col("ahead_off") + span).otherwise(F.col("off")).alias("off"), lower.alias("lower"))
        before, state = state, written(moved, "links")
        drop(before)
        span *= 2
    size = state.groupBy("low").agg(F.count("*").alias("n"))
    placed = state.join(size, "low").select("id", "bend", F.col("low").alias("ring"), F.pmod(F.col("n") - F.col("off"), F.col("n")).alias("seq"))
    return e.join(placed, "id").drop("id")


def ring_table(linked: DataFrame, by: list[str]) -> DataFrame:
    """For each ring its doubled signed area, whether it is a hole, its corners and its length."""
    cross = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).cast("double")
    length = F.hypot((F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double"))
    t = linked.groupBy(*by, "ring").agg(F.sum(cross).alias("area2"), F.sum(F.col("bend").cast("long")).alias("n_corners"), F.sum(length).alias("length"))
    return t.withColumn("hole", F.col("area2") < 0)


def ring_vertices(linked: DataFrame, by: list[str]) -> DataFrame:
    """Corners of the rings in order, the first one again at the end."""
    corner = linked.where("bend").select(*by, "ring", F.row_number().over(Window.partitionBy(*by, "ring").orderBy("seq")).alias("seq"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    last = corner.groupBy(*by, "ring").agg((F.max("seq") + 1).alias("seq"), F.min_by(F.struct("x", "y"), "seq").alias("v"))
    return corner.unionByName(last.select(*by, "ring", "seq", "v.x", "v.y"))


def label_runs(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs (id, row_, a, b, z) of equal cells in rows with ``region``, the smallest run id among those joined over cell sides, and the
    pairs of runs that touch.

    Runs are found by gaps and islands first, so labels spread between runs, not cells; labels are written after each round
    and jump to their label's label, so long regions take few rounds.
    """
    w = Window.partitionBy("row_").orderBy("col")
    new = F.coalesce((F.lag("z").over(w) != F.col("z")) | (F.lag("col").over(w) != F.col("col") - 1), F.lit(True))
    runs = cells.withColumn("k", F.sum(new.cast("int")).over(w)).groupBy("row_", "k", "z").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    runs = written(runs.select(F.shiftleft(F.col("row_").cast("long"), 32).bitwiseOR(F.col("a").cast("long")).alias("id"), "row_", "a", "b", "z"), "runs")
    below = runs.select((F.col("row_") - 1).alias("row_"), F.col("id").alias("other"), F.col("a").alias("oa"), F.col("b").alias("ob"), "z")
    pairs = runs.join(below, ["row_", "z"]).where("a <= ob and oa <= b").select("id", "other")
    touching = written(pairs.union(pairs.select("other", "id")), "touching")
    labels = written(runs.select("id", F.col("id").alias("region"), F.lit(True).alias("changed")), "labels")
    while not labels.where("changed").isEmpty():
        near = touching.join(labels.select(F.col("id").alias("other"), "region"), "other").select("id", "region").union(labels.select("id", "region"))
        spread = written(near.groupBy("id").agg(F.min("region").alias("region")), "labels")
        jumped = spread.join(spread.select(F.col("id").alias("region"), F.col("region").alias("to")), "region").select("id", F.col("to").alias("region"))
        changed = F.col("region") != F.col("old")
        before, labels = labels, written(jumped.join(labels.select("id", F.col("region").alias("old")), "id").select("id", "region", changed.alias("changed")), "labels")
        drop(before, spread)
    return runs.join(labels.select("id", "region"), "id"), touching


def region_edges(runs: DataFrame) -> DataFrame:
    """The sides of cells between a region and what lies around it, region on the left: region, z, x1, y1, x2, y2.

    The ends of a run are sides of its region. Upper and lower sides are looked at cell by cell: one that a region has from both sides
    lies inside it.
    """
    long = lambda c: F.col(c).cast("long")
    a, b, r = long("a"), long("b"), long("row_")
    right = runs.select("region", "z", (b + 1).alias("x1"), r.alias("y1"), (b + 1).alias("x2"), (r + 1).alias("y2"))
    left = runs.select("region", "z", a.alias("x1"), (r + 1).alias("y1"), a.alias("x2"), r.alias("y2"))
    cells = runs.select("region", "z", F.explode(F.sequence(a, b)).alias("c"), r.alias("r"))
    level = cells.select("region", "z", "c", F.explode(F.array(F.struct(F.col("r").alias("y"), F.lit(True).alias("low")), F.struct((F.col("r") + 1).alias("y"), F.lit(False).alias("low")))).alias("s"))
    level = level.groupBy("region", "z", "c", F.col("s.y").alias("y")).agg(F.count("*").alias("n"), F.first("s.low").alias("low")).where("n = 1")
    flat = level.select("region", "z", F.when(F.col("low"), F.col("c")).otherwise(F.col("c") + 1).alias("x1"), F.col("y").alias("y1"), F.when(F.col("low"), F.col("c") + 1).otherwise(F.col("c")).alias("x2"), F.col("y").alias("y2"))
    return right.union(left).union(flat)


def outlines(cells: DataFrame) -> DataFrame:
    """Regions of equal value as rings of edges: region, z, ring, seq, x1, y1, x2, y2, bend; shells run anticlockwise, holes clockwise."""
    runs, _ = label_runs(cells)
    return link(region_edges(runs), ["region", "z"])


def outline_rings(spark: SparkSession, d: str) -> DataFrame:
    """The terrain in bands of two metres as polygons: for each band shells less holes, area in cells, and length of the outlines."""
    bands = fx.dem(spark, d).select("col", "row_", F.floor(F.col("z") / 2).cast("long").alias("z"))
    rings = ring_table(outlines(bands), ["region", "z"])
    return rings.groupBy("z").agg(F.sum(F.when(F.col("hole"), -1).otherwise(1)).alias("shells_less_holes"), (F.sum("area2") / 2).alias("area"), F.sum("length").alias("length"))


QUERIES = {"outline_rings": outline_rings}
ORACLE_SQL = {
    # Shells less holes is the Euler number of a band: cells less common sides plus full squares of four.
    "outline_rings": f"""with {fx.DEM_SQL}, c as (select col, row_, cast(floor(z/2) as bigint) z from dem),
     n as (select a.z, count(*) cells, count(r.z) rights, count(u.z) ups, count(case when r.z is not null and u.z is not null and o.z is not null then 1 end) squares from c a
      left join c r on r.col=a.col+1 and r.row_=a.row_ and r.z=a.z left join c u on u.col=a.col and u.row_=a.row_+1 and u.z=a.z left join c o on o.col=a.col+1 and o.row_=a.row_+1 and o.z=a.z group by 1)
     select z, cells-rights-ups+squares shells_less_holes, cast(cells as double) area, cast(4*cells-2*(rights+ups) as double) length from n""",
}
