"""The depth of a pyramid, planned from one pass over the vertices.

The number of vertices that a level keeps is the number of times that a ring steps into another cell of its grid. All levels are counted
in the same pass, one sum each; counts of rings that a level would leave with too few cells are taken back. The deepest level has
cells as fine as the median gap between vertices, then two valves lower it until tiles and the whole are small enough.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom, grid

CALIBRATION = 1.5  # vertices stored for each one counted
LEAST = {geom.FACE: 3, geom.LINE: 2, geom.POINT: 1}


@dataclass(frozen=True)
class Plan:
    """The chosen level and what it was chosen by; ``counts`` are kept vertices by level, rolled back."""

    level: int
    counts: list[int]
    n_vertices: int
    step: float | None  # median gap
    per_tile: float
    total: float
    lowered: bool = False
    span: float = field(default=0.0)

    @property
    def keep_ratio(self) -> float:
        return self.counts[self.level] / self.n_vertices if self.n_vertices else 0.0


def level_counts(vertices: DataFrame, by: list[str], kind: int, square: grid.Square, cap: int) -> DataFrame:
    """One row: n_vertices and c0 to c<cap>, the vertices kept at each level."""
    w = Window.partitionBy(*by).orderBy("seq")
    v = vertices.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    moved = []
    for level in range(cap + 1):
        cell = square.side / (grid.DEEP_CELLS * (1 << level))
        at = lambda c, o: F.round((F.col(c) - o) / cell)  # noqa: B023, E731
        same = (at("x", square.x) == at("px", square.x)) & (at("y", square.y) == at("py", square.y))
        moved.append(F.sum(F.when(same, 0).otherwise(1)).alias(f"c{level}"))
    rings = v.groupBy(*by).agg(F.count("*").alias("n"), *moved)
    kept = [F.sum(F.when(F.col(f"c{k}") >= LEAST[kind], F.col(f"c{k}")).otherwise(0)).alias(f"c{k}") for k in range(cap + 1)]
    return rings.agg(F.sum("n").alias("n_vertices"), *kept)


def gaps(vertices: DataFrame, by: list[str]) -> DataFrame:
    e = geom.segments(vertices, by)
    return e.select(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("gap"))


def plan(vertices: DataFrame, by: list[str], kind: int, square: grid.Square, factor: float = 1.0, cap: int = 12, most_per_tile: float = 0, most: float = 0, step: int = 1, target: float = 20000) -> Plan:
    """``factor`` asks for cells so many times finer than the median gap; ``most_per_tile`` and ``most`` are the valves, 0 for none.

    Without gaps the level is the one whose tiles come nearest to ``target`` vertices.
    """
    row = level_counts(vertices, by, kind, square, cap).first()
    counts, n = [int(row[f"c{k}"] or 0) for k in range(cap + 1)], int(row.n_vertices or 0)
    found = geom.nth_value(gaps(vertices, by), "gap", 0.5).first() if n else None
    gap = found.v if found else None

    def points(level: int, deepest: int) -> float:
        return counts[level] * (1.0 if grid.tile_cells(level, deepest) == grid.DEEP_CELLS else 0.5)

    def total(deepest: int) -> float:
        return sum(points(k, deepest) for k in grid.kept_levels(deepest, step))

    def per_tile(level: int) -> float:
        return points(level, level) / 4.0**level

    if not n:
        return Plan(0, counts, 0, None, 0.0, 0.0, span=square.side)
    if not gap or factor <= 0:
        level = min(range(cap + 1), key=lambda k: (abs(per_tile(k) - target), k))
        return Plan(level, counts, n, gap, per_tile(level), total(level), span=square.side)
    level = max(0, min(cap, math.ceil(math.log2(square.side / (grid.DEEP_CELLS * gap / factor)))))
    if not (most_per_tile or most):
        return Plan(level, counts, n, gap, per_tile(level), total(level), span=square.side)
    lowered = False
    over = lambda k: CALIBRATION * per_tile(k) > (most_per_tile or math.inf) or CALIBRATION * total(k) > (most or math.inf)
    while level and over(level):
        level, lowered = level - 1, True
    return Plan(level, counts, n, gap, CALIBRATION * per_tile(level), CALIBRATION * total(level), lowered, square.side)


def report(spark: SparkSession, p: Plan, square: grid.Square, bytes_per_vertex: float = 4.0) -> DataFrame:
    """A row a level up to the plan's: cell size, vertices, vertices a tile, bytes, and the share of vertices kept."""
    rows = [(k, square.cell(k, p.level), p.counts[k], p.counts[k] / 4.0**k, p.counts[k] * bytes_per_vertex, p.counts[k] / p.n_vertices if p.n_vertices else 0.0, k == p.level) for k in range(p.level + 1)]
    return spark.createDataFrame(rows, "level int, cell double, n_points long, per_tile double, bytes double, keep_ratio double, deepest boolean")


_SQUARE = grid.Square(-180.0, -180.0, 360.0)
_FACTOR = 200.0


def parcels_plan(spark: SparkSession, d: str) -> Plan:
    """Deep enough for cells of a 200th of the median gap, but not so deep that more than 60,000 vertices would be stored."""
    return plan(fx.parcel_vertices(spark, d), ["fid", "part", "ring"], geom.FACE, _SQUARE, _FACTOR, 10, most=60000)


def level_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan of the parcels' pyramid, a row a level."""
    return report(spark, parcels_plan(spark, d), _SQUARE).select("level", F.round("cell", 9).alias("cell"), "n_points", F.round("per_tile", 6).alias("per_tile"), "bytes", F.round("keep_ratio", 9).alias("keep_ratio"), "deepest")


def line_levels(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of the tracks kept at each of 13 levels, lines of fewer than two cells left out."""
    row = level_counts(fx.tracks(spark, d), ["fid"], geom.LINE, _SQUARE, 12)
    return row.select(F.posexplode(F.array(*(F.col(f"c{k}") for k in range(13)))).alias("level", "n_points"))


QUERIES = {f.__name__: f for f in (level_plan, line_levels)}


def _counted(vertices: str, by: str, least: int, cap: int) -> str:
    return f"""lv as (select unnest(range({cap + 1})) l), q as (select v.*, l, round((x+180e0)/(360e0/(1024*pow(2,l)))) gx, round((y+180e0)/(360e0/(1024*pow(2,l)))) gy from {vertices} v, lv),
     m as (select {by}, l, case when gx=lag(gx) over w and gy=lag(gy) over w then 0 else 1 end c from q window w as (partition by {by}, l order by seq)),
     k as (select {by}, l, sum(c) c from m group by {by}, l), counts as (select l, cast(sum(case when c>={least} then c else 0 end) as bigint) c from k group by 1)"""


ORACLE_SQL = {
    "line_levels": f"with {fx.TRACKS_SQL}, {_counted('tracks', 'fid', 2, 12)} select cast(l as int) as level, c n_points from counts",
    "level_plan": f"""with {fx.VERTICES_SQL}, {_counted('parcel_vertices', 'fid, ring', 3, 10)},
     e as (select sqrt(pow(lead(x) over w-x,2)+pow(lead(y) over w-y,2)) g from parcel_vertices window w as (partition by fid, ring order by seq)),
     o as (select g, row_number() over (order by g)-1 i, count(*) over () n from e where g is not null), p as (select g from o where i=floor(0.5*(n-1))),
     s as (select greatest(0, least(10, ceil(log2(360e0/(1024*g/{_FACTOR}e0))))) l from p),
     t as (select l, c*0.5e0+sum(c*0.5e0) over (order by l) total from counts),
     d as (select max(t.l) l from t, s where t.l<=s.l and (t.l=0 or 1.5e0*total<=60000)), n as (select count(*) n from parcel_vertices)
     select cast(counts.l as int) as level, round(360e0/pow(2,counts.l)/(case when counts.l=d.l then 1024 else 512 end),9) cell, c n_points, round(c/pow(4,counts.l),6) per_tile, c*4e0 bytes, round(c/n,9) keep_ratio, counts.l=d.l deepest
     from counts, d, n where counts.l<=d.l""",
}
