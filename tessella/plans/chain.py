"""Coarse levels of a pyramid made from the next finer one, bottom up.

Rings of a tile are cut to its net area, moved into the parent tile and rounded to its grid. Shells that fall together there become
counts of the parent's cell, and so do the counts of the child's cells, summed and saturated: nothing is lost, every face is
either a ring or counted. Groups (the polygon that a ring belongs to) are numbered anew by prefix sums over the numbers of
groups in the child tiles, so no tile's rings need to meet in one place. Each level is written before the next one is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom, grid
from tessella.operators.spatial import SQUARE, with_tiles
from tessella.shared import drop, written
from tessella.sources.clustered import BOX

RINGS = "level int, tx int, ty int, poly_group long, fid long, part int, ring int, p array<struct<x:bigint,y:bigint>>"
COVER = "level int, tx int, ty int, cell int, cnt int"
SATURATED = 65535  # of a cell while levels are made; 255 when it is stored
TILE = ["tx", "ty"]


@dataclass(frozen=True)
class Level:
    rings: DataFrame
    cover: DataFrame


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({f"up_{c}": c for c in TILE})


def _counted(points: DataFrame, level: int) -> DataFrame:
    """Counts by cell of rows tx, ty, cell, cnt."""
    c = points.groupBy(*TILE, "cell").agg(F.least(F.lit(SATURATED), F.sum("cnt")).cast("int").alias("cnt"))
    return c.select(F.lit(level).alias("level"), "tx", "ty", "cell", "cnt")


def _cell(x: Column, y: Column, side: int) -> Column:
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(v))).cast("int")
    return at(y) * side + at(x)


def _middle(p: Column, c: str) -> Column:
    """The middle of a ring's box."""
    at = F.transform(p, lambda v: v[c].cast("double"))
    return (F.array_min(at) + F.array_max(at)) / 2


def _whole(p: Column) -> Column:
    return geom.whole(p, 0.5)


def _doubles(p: Column) -> Column:
    return F.transform(p, lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y")))


def _net(cells: int) -> Column:
    """A stored ring inside its tile's net area."""
    return geom.clip_ring(_doubles(F.col("p")), *map(F.lit, (0.0, 0.0, float(cells), float(cells))))


def route(rings: DataFrame, level: int, deepest: int, square: grid.Square = SQUARE) -> Level:
    """A level made from the source: rings (fid, part, ring, ``p``) cut to the tiles' padded areas and rounded to their grids."""
    side, cells = square.tile_side(level), grid.tile_cells(level, deepest)
    cell = side / cells
    pad = grid.tile_pad(level, deepest) * cell
    end = lambda f, c: f(F.transform("p", lambda v: v[c]))
    boxed = rings.withColumns({"minx": end(F.array_min, "x") - pad, "miny": end(F.array_min, "y") - pad, "maxx": end(F.array_max, "x") + pad, "maxy": end(F.array_max, "y") + pad})
    t = with_tiles(boxed, level, *(F.col(c) for c in BOX), square)
    t = t.withColumns({"left": F.lit(square.x) + F.col("tx") * side, "low": F.lit(square.y) + F.col("ty") * side})
    snap = lambda p: geom.apart(F.transform(p, lambda v: F.struct(F.round((v["x"] - left) / cell).cast("long").alias("x"), F.round((v["y"] - low) / cell).cast("long").alias("y"))))
    ring = geom.open_points(F.col("p"))
    left, low = F.col("left"), F.col("low")
    padded = geom.clip_ring(ring, left - pad, low - pad, left + side + pad, low + side + pad)
    net = geom.clip_ring(ring, left, low, left + side, low + side)
    key = [*TILE, "fid", "part", "ring"]
    once = lambda df, **values: df.select(*key, "left", "low", F.explode(F.array(F.struct(*(v.alias(n) for n, v in values.items())))).alias("s")).select(*key, "left", "low", "s.*")
    cut = once(t, padded=padded, net=net)
    snapped = written(once(cut, p=snap(F.col("padded")), own=snap(F.col("net")), net=F.col("net")), "snapped")
    kept = snapped.where(_whole(F.col("p")))
    group = F.dense_rank().over(Window.partitionBy(*TILE).orderBy("fid", "part")) - 1
    kept = kept.select(F.lit(level).alias("level"), *TILE, group.cast("long").alias("poly_group"), "fid", "part", "ring", "p")
    # A piece narrower than the noise of coordinates isn't one.
    reach = lambda c: F.array_max(F.transform("net", lambda v: v[c])) - F.array_min(F.transform("net", lambda v: v[c]))
    gone = snapped.where((F.col("ring") == 0) & (F.size("net") > 2) & (F.least(reach("x"), reach("y")) > side * 1e-9) & ~_whole(F.col("own")))
    at = _cell((_middle(F.col("net"), "x") - F.col("left")) / cell, (_middle(F.col("net"), "y") - F.col("low")) / cell, cells)
    out = Level(written(kept, "rings"), written(_counted(gone.select(*TILE, at.alias("cell"), F.lit(1).alias("cnt")), level), "cover"))
    drop(snapped)
    return out


def merge(child: Level, source: int, level: int, deepest: int) -> Level:
    """A level made from a finer one."""
    k, net = source - level, grid.tile_cells(source, deepest)
    cells = grid.tile_cells(level, deepest)
    ratio = net * (1 << k) / cells
    offset = lambda c: F.pmod(F.col(c), F.lit(1 << k)) * net
    up = [F.shiftright(c, k).alias(f"up_{c}") for c in TILE]  # other names: in lambdas a name means the alias before it in the list
    own = written(child.rings.select(*TILE, "poly_group", "fid", "part", "ring", geom.only(_net(net), _whole).alias("net")), "own")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*(F.shiftright(c, k) for c in TILE)).orderBy("ty", "tx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = own.groupBy(*TILE).agg((F.max("poly_group") + 1).alias("n")).select(*TILE, before.alias("before"))  # at most 4 ** k rows a parent
    moved = F.transform("net", lambda v: F.struct(F.round((v["x"] + offset("tx")) / ratio).cast("long").alias("x"), F.round((v["y"] + offset("ty")) / ratio).cast("long").alias("y")))
    at = _cell((_middle(F.col("net"), "x") + offset("tx")) / ratio, (_middle(F.col("net"), "y") + offset("ty")) / ratio, cells)
    lifted = own.join(groups, TILE).select(F.lit(level).alias("level"), *up, (F.col("poly_group") + F.col("before")).alias("poly_group"), "fid", "part", "ring", geom.apart(moved).alias("p"), at.alias("cell"))
    lifted = written(_renamed(lifted), "lifted")
    drop(own)
    gone = lifted.where((F.col("ring") == 0) & ~_whole(F.col("p"))).select(*TILE, "cell", F.lit(1).alias("cnt"))
    cx, cy = F.pmod(F.col("cell"), F.lit(net)), F.floor(F.col("cell") / net)
    carried = child.cover.select(*up, _cell((cx + 0.5 + offset("tx")) / ratio, (cy + 0.5 + offset("ty")) / ratio, cells).alias("cell"), "cnt")
    return Level(lifted.where(_whole(F.col("p"))).drop("cell"), written(_counted(_renamed(carried).unionByName(gone), level), "cover"))


def build(rings: DataFrame, deepest: int, step: int = 1, merged: int = 1, square: grid.Square = SQUARE) -> dict[int, Level]:
    """All kept levels. The coarsest ``merged`` ones come from the next finer kept level, finest pair first, the others from the source."""
    levels = grid.kept_levels(deepest, step)
    out: dict[int, Level] = {}
    for at in range(len(levels) - 1, -1, -1):
        from_source = at >= min(merged, len(levels) - 1)
        out[levels[at]] = route(rings, levels[at], deepest, square) if from_source else merge(out[levels[at + 1]], levels[at + 1], levels[at], deepest)
    return out


def net_table(levels: dict[int, Level], deepest: int) -> DataFrame:
    """For each level its tiles, rings, groups, area in cells inside the tiles' net areas, and counted faces."""
    out = None
    for level, own in levels.items():
        inside = own.rings.select(*TILE, "poly_group", "ring", geom.only(_net(grid.tile_cells(level, deepest)), _whole).alias("p"))
        area = F.abs(geom.ring_area2(F.col("p"))) / 2 * F.when(F.col("ring") > 0, -1).otherwise(1)
        a = inside.withColumn("a", area).agg(F.countDistinct("tx", "ty").alias("n_tiles"), F.count("*").alias("n_rings"), F.countDistinct("tx", "ty", "poly_group").alias("n_groups"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("cells"))
        c = own.cover.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("n_counted"), F.count("*").alias("n_cells"))
        row = a.join(c).select(F.lit(level).alias("level"), "n_tiles", "n_rings", "n_groups", "cells", "n_counted", "n_cells")
        out = row if out is None else out.union(row)
    return out


def merge_chain(spark: SparkSession, d: str) -> DataFrame:
    """The parcels' levels 4 to 0, each made from the one below: rings, groups, area and counted faces."""
    rings = geom.ring_points(fx.parcel_vertices(spark, d), ["fid", "part", "ring"])
    return net_table(build(rings, 4, merged=4), 4)


QUERIES = {"merge_chain": merge_chain}


def _chain_sql() -> str:
    """The same for rectangles: corners are clipped, moved and rounded; one without width or height is counted."""
    deepest, side = 4, SQUARE.tile_side(4)
    at = f"cast(round(({{0}}-{{1}})/{SQUARE.cell(4, 4)!r}e0) as bigint)"
    middle = lambda lo, hi, o: f"cast(greatest(0,least(1023,floor(((greatest({lo},{o})+least({hi},{o}+{side}e0))/2e0-{o})/{SQUARE.cell(4, 4)!r}e0))) as bigint)"
    sql = f"""with {fx.PARCELS_SQL}, r as (select fid, 0 as ring, x0 a, y0 b, x0+w c, y0+h e from parcels union all select fid, 1, x0+w*0.25e0, y0+h*0.25e0, x0+w*0.75e0, y0+h*0.75e0 from parcels where has_hole=1),
     k as (select unnest(range(16)) k), g as (select r.*, x.k tx, y.k ty, -180e0+x.k*{side}e0 lx, -180e0+y.k*{side}e0 ly from r, k x, k y where x.k between floor((a+180e0)/{side}e0) and floor((c+180e0)/{side}e0) and y.k between floor((b+180e0)/{side}e0) and floor((e+180e0)/{side}e0)),
     q4 as (select fid, ring, tx, ty, cast(fid as varchar) g, {at.format('greatest(a,lx)', 'lx')} a, {at.format('greatest(b,ly)', 'ly')} b, {at.format(f'least(c,lx+{side}e0)', 'lx')} c, {at.format(f'least(e,ly+{side}e0)', 'ly')} e,
      least(least(c,lx+{side}e0)-greatest(a,lx), least(e,ly+{side}e0)-greatest(b,ly))>{side}e-9 wide, {middle('a', 'c', 'lx')} cx, {middle('b', 'e', 'ly')} cy from g where a<lx+{side}e0 and c>lx and b<ly+{side}e0 and e>ly),
     s4 as (select * from q4 where a<c and b<e), v4 as (select tx, ty, cx, cy, count(*) cnt from q4 where ring=0 and (a=c or b=e) and wide group by 1,2,3,4)"""
    for level in range(deepest - 1, -1, -1):
        net, cells = grid.tile_cells(level + 1, deepest), grid.tile_cells(level, deepest)
        ratio = net * 2 / cells
        move = lambda v, t: f"cast(round(({v}+({t}%2)*{net})/{ratio!r}e0) as bigint)"  # noqa: B023, E731
        into = lambda v, t: f"cast(greatest(0,least({cells - 1},floor(({v}+({t}%2)*{net})/{ratio!r}e0))) as bigint)"  # noqa: B023, E731
        sql += f""",
     q{level} as (select fid, ring, tx//2 tx, ty//2 ty, g||':'||tx||','||ty g, {move('a', 'tx')} a, {move('b', 'ty')} b, {move('c', 'tx')} c, {move('e', 'ty')} e, {into('(a+c)/2e0', 'tx')} cx, {into('(b+e)/2e0', 'ty')} cy from s{level + 1}),
     s{level} as (select * from q{level} where a<c and b<e),
     v{level} as (select tx, ty, cx, cy, sum(cnt) cnt from (select tx, ty, cx, cy, 1 cnt from q{level} where ring=0 and (a=c or b=e) union all select tx//2, ty//2, {into('(cx+0.5e0)', 'tx')}, {into('(cy+0.5e0)', 'ty')}, cnt from v{level + 1}) group by 1,2,3,4)"""
    rows = [
        f"""select {level} as level, count(distinct (tx,ty)) n_tiles, count(*) n_rings, count(distinct (tx,ty,g)) n_groups, cast(sum(case when ring=0 then 1 else -1 end*(c-a)*(e-b)) as double) cells,
     (select cast(coalesce(sum(least(cnt,65535)),0) as bigint) from v{level}) n_counted, (select count(*) from v{level}) n_cells from s{level}"""
        for level in range(deepest, -1, -1)
    ]
    return f"{sql}\n     {' union all '.join(rows)}"


ORACLE_SQL = {"merge_chain": _chain_sql()}
