"""The multi-resolution tile pyramid: rings routed to levels and tiles, clipped, quantised, tidied and stored.

Rings are clipped in one Arrow pass (``route``): each ring goes to the tiles that its box meets at every kept level, and only
rings that leave a tile's padded rectangle are clipped. Faces that fall below a cell become coverage counts. Everything
is quantised before rows are grouped by tile, so a coarse tile gathers small integers, not raw vertices; tiles are grouped
once, for the topology pass. Output is Parquet, partitioned by level and sorted by (ty, tx).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom, grid, kernels
from tessella.plans import topology
from tessella.shared import spread, written

RING_SCHEMA = "level int, tx int, ty int, type int, hole int, poly_group string, fid long, xs array<int>, ys array<int>, reason string, cell int"
COVER_SCHEMA = "level int, tx int, ty int, cell int, cnt int"
TILE = ["level", "tx", "ty"]
STORE_VERSION = 1
_SHORT = 32  # vertices
RUN = 20_000  # rings encoded at once
HEADER = 12  # bytes before a tile's vertices


@dataclass(frozen=True)
class PyramidConfig:
    """Levels are caps; a step keeps every step-th level and the deepest."""

    deepest: int = 6
    step: int = 1
    min_feature_cells: float = 1.0
    simplify_cells: float = 0.5  # lines lose vertices below this many cells
    topology_cells: float = 0.25
    merge_cells: float = 4.0

    @property
    def levels(self) -> list[int]:
        return grid.kept_levels(self.deepest, self.step)


def pick_level(n_features: int, side: float, p50: float, factor: float = 1.0, cap: int = 20) -> int:
    """The deepest level: its cells are as fine as the median gap between vertices."""
    if p50 <= 0 or side <= 0 or n_features <= 0:
        return 0
    return max(0, min(cap, math.ceil(math.log2(side / (grid.DEEP_CELLS * p50 / factor)))))


def rings_of(vertices: DataFrame, kind: int) -> DataFrame:
    """fid, type, hole, poly_group, xs, ys of layers in vertex form; rings of fewer than 3 (lines: 2) vertices go."""
    by = [c for c in ("fid", "part", "ring") if c in vertices.columns]
    pts = spread(vertices, *by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    part = F.col("part") if "part" in by else F.lit(0)
    hole = (F.col("ring") > 0).cast("int") if "ring" in by else F.lit(0)
    least = {geom.FACE: 3, geom.LINE: 2, geom.POINT: 1}[kind]
    return pts.where(F.size("p") >= least).select(
        "fid", F.lit(kind).alias("type"), hole.alias("hole"), F.concat_ws(":", "fid", part).alias("poly_group"), F.transform("p", lambda v: v["x"]).alias("xs"), F.transform("p", lambda v: v["y"]).alias("ys")
    )


def quantise(points: np.ndarray, ox: float, oy: float, cell: float) -> np.ndarray:
    """Integers away from zero at halves, int16, no consecutive repeats."""
    v = (points - (ox, oy)) / cell
    q = np.clip(np.sign(v) * np.floor(np.abs(v) + 0.5), grid.MIN_INT16, grid.MAX_INT16).astype(np.int64)
    keep = np.ones(len(q), bool)
    keep[1:] = (q[1:] != q[:-1]).any(1)
    return q[keep]


def drop_collinear(q: np.ndarray, closed: bool) -> np.ndarray:
    """Vertices off the line of their original neighbours; all, if too few would be left."""
    least = 3 if closed else 2
    if len(q) <= least:
        return q
    p, n = np.roll(q, 1, 0), np.roll(q, -1, 0)
    cross = (q[:, 0] - p[:, 0]) * (n[:, 1] - q[:, 1]) - (q[:, 1] - p[:, 1]) * (n[:, 0] - q[:, 0])
    keep = cross != 0
    if not closed:
        keep[[0, -1]] = True
    return q[keep] if keep.sum() >= least else q


def route_ring(kind: int, xs: np.ndarray, ys: np.ndarray, square: grid.Square, cfg: PyramidConfig) -> Iterator[tuple]:
    """(level, tx, ty, xs, ys, reason, cell) of a ring at every kept level; reason is what became of a degenerate one."""
    pts = np.column_stack([xs, ys])
    points = list(map(tuple, pts.tolist()))
    lo, hi = tuple(pts.min(0).tolist()), tuple(pts.max(0).tolist())
    weights = kernels.simplify_weights(pts) if kind == geom.LINE and len(pts) > 2 else None
    for level in cfg.levels:
        t, n, cell = square.tile_side(level), 1 << level, square.cell(level, cfg.deepest)
        pad = grid.tile_pad(level, cfg.deepest) * cell
        if kind == geom.LINE and math.hypot(hi[0] - lo[0], hi[1] - lo[1]) < cfg.min_feature_cells * cell:
            continue
        own = list(map(tuple, pts[weights >= cfg.simplify_cells * cell].tolist())) if weights is not None and level < cfg.deepest else points
        at = lambda v, o: min(n - 1, max(0, math.floor((v - o) / t)))
        small = kind == geom.FACE and max(hi[0] - lo[0], hi[1] - lo[1]) < cell
        if small or kind == geom.POINT:
            c = ((lo[0] + hi[0]) / 2, (lo[1] + hi[1]) / 2) if small else points[0]
            tx, ty = at(c[0], square.x), at(c[1], square.y)
            ox, oy = square.x + tx * t, square.y + ty * t
            if kind == geom.POINT:
                q = quantise(pts[:1], ox, oy, cell)
                yield level, tx, ty, q[:, 0], q[:, 1], "kept", -1
            else:
                side = grid.tile_cells(level, cfg.deepest)
                k = [min(side - 1, max(0, math.floor(d / cell))) for d in (c[0] - ox, c[1] - oy)]
                yield level, tx, ty, (), (), "coverage", k[1] * side + k[0]
            continue
        for tx in range(at(lo[0] - pad, square.x), at(hi[0] + pad, square.x) + 1):
            for ty in range(at(lo[1] - pad, square.y), at(hi[1] + pad, square.y) + 1):
                ox, oy = square.x + tx * t, square.y + ty * t
                box = (ox - pad, oy - pad, ox + t + pad, oy + t + pad)
                inside = lo[0] >= box[0] and lo[1] >= box[1] and hi[0] <= box[2] and hi[1] <= box[3]
                if kind == geom.FACE:
                    parts = [kernels.opened(own)] if inside else kernels.clip_polygon(own, *box)
                else:
                    parts = [own] if inside else clip_runs(own, *box)
                for part in parts:
                    yield (level, tx, ty, *_settle(kind, part, ox, oy, cell, grid.tile_cells(level, cfg.deepest)))


def _settle(kind: int, part: list | np.ndarray, ox: float, oy: float, cell: float, side: int) -> tuple:
    """Quantise and prune; a face without area becomes a square of one cell, a line of one point a step of one cell."""
    closed = kind == geom.FACE
    if len(part) <= _SHORT:
        return _settle_short(closed, part, ox, oy, cell)
    part = np.array(part, float)
    q = quantise(part, ox, oy, cell)
    if closed and len(q) > 1 and (q[0] == q[-1]).all():
        q = q[:-1]
    q = drop_collinear(q, closed)
    x, y = q[:, 0], q[:, 1]
    if closed and (len(q) < 3 or abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) < 1.0):
        cx, cy = quantise(part.mean(0)[None], ox, oy, cell)[0]
        return np.array([cx, cx + 1, cx + 1, cx]), np.array([cy, cy, cy + 1, cy + 1]), "stub", -1
    if not closed and len(q) < 2:
        return np.array([x[0], x[0] + 1]), np.array([y[0], y[0]]), "stub", -1
    return x, y, "kept", -1


def _settle_short(closed: bool, part: list | np.ndarray, ox: float, oy: float, cell: float) -> tuple:
    """What :func:`_settle` does, for rings so short that calls into numpy would take most of the time."""
    snap = lambda v: min(grid.MAX_INT16, max(grid.MIN_INT16, math.floor(v + 0.5) if v >= 0 else -math.floor(0.5 - v)))
    q: list[tuple[int, int]] = []
    for x, y in part:
        p = (snap((x - ox) / cell), snap((y - oy) / cell))
        if not q or p != q[-1]:
            q.append(p)
    if closed and len(q) > 1 and q[0] == q[-1]:
        q.pop()
    n, least = len(q), 3 if closed else 2
    if n > least:
        off = [
            (q[k][0] - q[k - 1][0]) * (q[(k + 1) % n][1] - q[k][1]) != (q[k][1] - q[k - 1][1]) * (q[(k + 1) % n][0] - q[k][0]) or (not closed and k in (0, n - 1))
            for k in range(n)
        ]
        if sum(off) >= least:
            q = [p for p, keep in zip(q, off, strict=True) if keep]
    xs, ys = [p[0] for p in q], [p[1] for p in q]
    if closed and (len(q) < 3 or not sum(xs[k - 1] * ys[k] - xs[k] * ys[k - 1] for k in range(len(q)))):
        mean = np.array(part, float).mean(0).tolist()
        cx, cy = snap((mean[0] - ox) / cell), snap((mean[1] - oy) / cell)
        return [cx, cx + 1, cx + 1, cx], [cy, cy, cy + 1, cy + 1], "stub", -1
    if not closed and len(q) < 2:
        return [xs[0], xs[0] + 1], [ys[0], ys[0]], "stub", -1
    return xs, ys, "kept", -1


def clip_runs(points: list, minx: float, miny: float, maxx: float, maxy: float) -> list[list]:
    """The continuous runs of a line inside a rectangle."""
    runs: list[list] = []
    for a, b in zip(points, points[1:], strict=False):
        cut = kernels._clip_edge(tuple(a), tuple(b), minx, miny, maxx, maxy)
        if cut is None:
            continue
        if runs and runs[-1][-1] == cut[0]:
            runs[-1].append(cut[1])
        else:
            runs.append([*cut])
    return runs


def route(rings: DataFrame, square: grid.Square, cfg: PyramidConfig) -> DataFrame:
    """Rings in tiles at all levels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RING_SCHEMA.split(", ")]
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                for level, tx, ty, xs, ys, reason, cell in route_ring(r.type, np.asarray(r.xs), np.asarray(r.ys), square, cfg):
                    out.append((level, tx, ty, r.type, r.hole, r.poly_group, r.fid, list(map(int, xs)), list(map(int, ys)), reason, cell))
                    if len(out) >= 4096:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return rings.mapInPandas(run, RING_SCHEMA)


def coverage(routed: DataFrame) -> DataFrame:
    """Counts of sub-cell faces by tile and cell, saturating at 255."""
    return routed.where("reason = 'coverage'").groupBy("level", "tx", "ty", "cell").agg(F.least(F.lit(255), F.count("*")).cast("int").alias("cnt"))


def tidy_tiles(routed: DataFrame, cfg: PyramidConfig) -> DataFrame:
    """The topology pass over the faces of each tile above the deepest level; all other rings stay.

    A tile's task gets each different ring once, with the number of its copies: as many as the tile's grid holds, however many rings
    fall together there. What became of a ring goes to its copies by a join.
    """
    faces = routed.where((F.col("type") == geom.FACE) & (F.col("level") < cfg.deepest) & (F.col("reason") == "kept"))
    rest = routed.where(~((F.col("type") == geom.FACE) & (F.col("level") < cfg.deepest) & (F.col("reason") == "kept")) & (F.col("reason") != "coverage"))
    shape = [*TILE, "xs", "ys"]

    def one(f: pd.DataFrame) -> pd.DataFrame:
        rings = [list(zip(x.tolist(), y.tolist(), strict=True)) for x, y in zip(f["xs"], f["ys"], strict=True)]
        done = topology.tidy_counted(rings, f["n"].tolist(), 3 * cfg.topology_cells, 0, grid.NET_CELLS, cfg.merge_cells)
        of = [d[0] for d in done]
        out = f.iloc[of][shape].copy()
        out["copy"], out["last"] = [d[1] for d in done], [d[2] for d in done]
        out["to_xs"], out["to_ys"] = [[p[0] for p in d[3]] for d in done], [[p[1] for p in d[3]] for d in done]
        return out

    # most rings of fine levels have no copies; a copy's number follows the id, so it is the same in every run
    counted = faces.groupBy(*shape).agg(F.count("*").alias("n"))
    became = spread(counted, *TILE).groupBy(*TILE).applyInPandas(one, "level int, tx int, ty int, xs array<int>, ys array<int>, copy long, last long, to_xs array<int>, to_ys array<int>")
    number = F.row_number().over(Window.partitionBy(*shape).orderBy("fid", "poly_group", "hole")) - 1
    met = faces.withColumn("_n", number.cast("long")).join(geom.dealt(became), shape).where("copy = least(_n, last)")
    tidied = met.select(*TILE, "type", "poly_group", "fid", F.col("to_xs").alias("xs"), F.col("to_ys").alias("ys"), "reason", "cell")
    return told_holes(tidied).select(*faces.columns).union(rest.select(*faces.columns))


def told_holes(rings: DataFrame) -> DataFrame:
    """``hole`` of the rings of each polygon in a tile, told anew from their places."""

    @F.pandas_udf("array<int>")
    def holes(xs: pd.Series, ys: pd.Series) -> pd.Series:
        whole = lambda x, y: [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in zip(x, y, strict=True)]
        return pd.Series([[0] if len(x) == 1 else [int(h) for h in topology.holes(whole(x, y))] for x, y in zip(xs, ys, strict=True)])

    own = [c for c in rings.columns if c not in (*TILE, "poly_group")]
    g = rings.groupBy(*TILE, "poly_group").agg(F.array_sort(F.collect_list(F.struct("xs", "ys", *(c for c in own if c not in ("xs", "ys"))))).alias("r"))
    g = g.withColumn("h", holes(F.transform("r", lambda v: v["xs"]), F.transform("r", lambda v: v["ys"])))
    return g.select(*TILE, "poly_group", F.explode(F.arrays_zip("r", "h")).alias("z")).select(*TILE, "poly_group", "z.r.*", F.col("z.h").alias("hole"))


def merge_coarse(routed: DataFrame, cfg: PyramidConfig) -> DataFrame:
    """The coarsest kept level made anew from the next finer one: rings moved into the parent tile and quantised again."""
    levels = cfg.levels
    if len(levels) < 2:
        return routed
    to, source = levels[0], levels[1]
    k = source - to
    ratio = (grid.tile_cells(source, cfg.deepest) / grid.tile_cells(to, cfg.deepest)) * (1 << k)
    child = routed.where((F.col("level") == source) & (F.col("reason") != "coverage"))
    net = grid.tile_cells(source, cfg.deepest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                pts = [(float(x), float(y)) for x, y in zip(r.xs, r.ys, strict=True)]
                parts = kernels.clip_polygon(pts, 0, 0, net, net) if r.type == geom.FACE else clip_runs(pts, 0, 0, net, net) if r.type == geom.LINE else [pts]
                dx, dy = (r.tx & ((1 << k) - 1)) * net, (r.ty & ((1 << k) - 1)) * net
                for p in parts:
                    xs, ys, reason, cell = _settle(r.type, [(x + dx, y + dy) for x, y in p], 0.0, 0.0, ratio, 0) if r.type != geom.POINT else ([round((p[0][0] + dx) / ratio)], [round((p[0][1] + dy) / ratio)], "kept", -1)
                    out.append((to, r.tx >> k, r.ty >> k, r.type, r.hole, r.poly_group, r.fid, list(map(int, xs)), list(map(int, ys)), reason, cell))
            yield pd.DataFrame(out, columns=f.columns)

    merged = written(child.mapInPandas(run, RING_SCHEMA), "merged")
    stubs = merged.where("reason = 'stub'").dropDuplicates(["level", "tx", "ty", "type", "xs", "ys"])
    return routed.where(F.col("level") != to).union(merged.where("reason <> 'stub'")).union(stubs).union(routed.where((F.col("level") == to) & (F.col("reason") == "coverage")))


def build(layer_rings: DataFrame, square: grid.Square, cfg: PyramidConfig, merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rings in tiles, coverage cells); the coarsest level is made from the next finer one unless ``merge`` is off."""
    routed = written(route(layer_rings, square, cfg), "routed")  # read several times below
    cover = coverage(routed)
    return tidy_tiles(merge_coarse(routed, cfg) if merge else routed, cfg), cover


def store(tiles: DataFrame, cover: DataFrame, path: str, square: grid.Square, cfg: PyramidConfig, epsg: int = 0) -> None:
    """Write a tile store: rings and coverage by level, sorted by (ty, tx) within files, and a header of one row."""
    spark = tiles.sparkSession
    for name, df in (("rings", tiles), ("coverage", cover)):
        df.repartitionByRange("level", "ty", "tx").sortWithinPartitions("level", "ty", "tx").write.mode("overwrite").option("compression", "zstd").partitionBy("level").parquet(f"{path}/{name}")
    head = [(STORE_VERSION, epsg, square.x, square.y, square.side, cfg.deepest, cfg.step)]
    spark.createDataFrame(head, "version int, epsg int, x double, y double, side double, deepest int, step int").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(rings, coverage, header) of a store; ValueError for another version."""
    head = spark.read.parquet(f"{path}/header").first().asDict()
    if head["version"] != STORE_VERSION:
        raise ValueError(f"tile store version {head['version']} isn't {STORE_VERSION}")
    # given schemas: a store without rings or without coverage has no files to infer them from
    rings = spark.read.schema(RING_SCHEMA).parquet(f"{path}/rings")
    return rings, spark.read.schema(COVER_SCHEMA).parquet(f"{path}/coverage"), head


def read_tile(rings: DataFrame, level: int, tx: int, ty: int) -> DataFrame:
    return rings.where((F.col("level") == level) & (F.col("ty") == ty) & (F.col("tx") == tx))


def _parcel_tiles(spark: SparkSession, d: str, deepest: int = 4) -> tuple[DataFrame, DataFrame]:
    cfg = PyramidConfig(deepest=deepest)
    return build(rings_of(fx.parcel_vertices(spark, d), geom.FACE), grid.Square(-180.0, -180.0, 360.0), cfg)


def tile_build(spark: SparkSession, d: str) -> DataFrame:
    """Per level: tiles, rings, vertices and covered cells of the parcels' pyramid."""
    tiles, cover = _parcel_tiles(spark, d)
    a = tiles.groupBy("level").agg(F.countDistinct("tx", "ty").alias("n_tiles"), F.count("*").alias("n_rings"), F.sum(F.size("xs")).alias("n_vertices"))
    return a.join(cover.groupBy("level").agg(F.sum("cnt").alias("n_covered")), "level", "left")


def pyramid_report(spark: SparkSession, d: str) -> DataFrame:
    """Per level: rings by what became of them."""
    routed = route(rings_of(fx.parcel_vertices(spark, d), geom.FACE), grid.Square(-180.0, -180.0, 360.0), PyramidConfig(deepest=4))
    return routed.groupBy("level", "reason").agg(F.count("*").alias("n"), F.sum(F.size("xs")).alias("vertices"))


def triangulated_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of the triangles of each parcel, holes cut out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                tri = kernels.triangulate([list(zip(ring["xs"], ring["ys"], strict=True)) for ring in r.rings])
                rows.append((r.fid, round(sum(abs(kernels.signed_area([t[:2], t[2:4], t[4:]])) for t in tri), 6)))
            yield pd.DataFrame(rows, columns=["fid", "area"])

    rings = rings_of(fx.parcel_vertices(spark, d), geom.FACE).groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("hole", "xs", "ys"))).alias("rings"))
    return rings.mapInPandas(run, "fid long, area double")


def line_simplify(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of each track that stay at a tolerance of 0.05."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = [int((kernels.simplify_weights(np.column_stack([x, y])) >= 0.05).sum()) for x, y in zip(f["xs"], f["ys"], strict=True)]
            yield pd.DataFrame({"fid": f.fid, "n_before": [len(x) for x in f["xs"]], "n_after": n})

    return rings_of(fx.tracks(spark, d), geom.LINE).mapInPandas(run, "fid long, n_before int, n_after int")


def clip_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of each parcel's shell inside a rectangle, by the exact clipper."""
    box = (-60.0, -30.0, 60.0, 30.0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            area = [sum(abs(kernels.signed_area(p)) for p in kernels.clip_polygon(list(zip(x, y, strict=True)), *box)) for x, y in zip(f["xs"], f["ys"], strict=True)]
            yield pd.DataFrame({"fid": f.fid, "area": np.round(area, 6)})

    return rings_of(fx.parcel_vertices(spark, d).where("ring = 0"), geom.FACE).mapInPandas(run, "fid long, area double").where("area > 0")


def coded(tiles: DataFrame, run: int = RUN) -> DataFrame:
    """Bytes of each tile's encoding, and whether it decodes to what went in.

    A tile's rings are encoded in runs of so many, each going on where the one before ended; put one after the other, vertices first,
    they are the whole tile's encoding. So a task holds a run, not a tile.
    """
    order = Window.partitionBy(*TILE).orderBy("fid", "hole", "poly_group", "xs", "ys")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    t = tiles.withColumns({
        "k": F.row_number().over(order) - 1, "first": F.coalesce(F.sum(F.size("xs")).over(ahead), F.lit(0)),
        "bx": F.coalesce(F.lag(F.element_at("xs", -1)).over(order), F.lit(0)), "by": F.coalesce(F.lag(F.element_at("ys", -1)).over(order), F.lit(0)),
        "group": F.dense_rank().over(Window.partitionBy(*TILE).orderBy("fid", "poly_group")) - 1,
    })
    t = t.select(*TILE, F.floor(F.col("k") / run).alias("run"), "k", "first", "bx", "by", "group", "type", "hole", "xs", "ys")

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        verts = np.column_stack([np.concatenate(f[c].to_list()) for c in ("xs", "ys")]).astype(np.int16)
        rings = [(int(t), int(h), int(a), len(x), int(g)) for t, h, a, x, g in zip(f["type"], f["hole"], f["first"], f["xs"], f["group"], strict=True)]
        before = int(f["bx"].iloc[0]), int(f["by"].iloc[0])
        data = kernels.encode_tile(verts, rings, [], before)
        back, rings2, _ = kernels.decode_tile(data, before)
        same = back.shape == verts.shape and bool((back == verts).all()) and rings2 == rings
        return pd.DataFrame([(*(f[c].iloc[0] for c in TILE), len(data) - HEADER, same)], columns=[*TILE, "bytes", "same"])

    done = t.groupBy(*TILE, "run").applyInPandas(one, "level int, tx int, ty int, bytes long, same boolean")
    return done.groupBy(*TILE).agg((F.sum("bytes") + HEADER).cast("int").alias("bytes"), F.min("same").alias("same"))


def tile_codec(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each encoded tile, and whether it decodes to what went in."""
    return coded(_parcel_tiles(spark, d, 3)[0])


def masks(tiles: DataFrame, size: int, deepest: int) -> DataFrame:
    """Per tile and row of ``size`` (64 at most) cells a side: the bits of the cells whose centres are filled. Rows without any are left out.

    Polygons of a tile are drawn a batch at a time, each different one once, and their bits are joined by rows: no task gets a whole tile.
    """
    ring = F.struct("hole", "xs", "ys")
    drawn = tiles.groupBy(*TILE, "poly_group").agg(F.array_sort(F.collect_list(ring)).alias("r"))
    drawn = drawn.select(*TILE, F.transform("r", lambda v: v["xs"]).alias("xs"), F.transform("r", lambda v: v["ys"]).alias("ys")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bit = np.left_shift(np.uint64(1), np.arange(size, dtype=np.uint64))
        for f in frames:
            out = []
            for (level, tx, ty), own in f.groupby(TILE):
                tri = [t for x, y in zip(own["xs"], own["ys"], strict=True) for t in kernels.triangulate([list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in zip(x, y, strict=True)])]
                if tri:
                    bits = (kernels.fill_mask(np.array(tri), size, grid.tile_cells(int(level), deepest) / size) * bit).sum(1, dtype=np.uint64).view(np.int64)
                    out += [(level, tx, ty, k, b) for k, b in enumerate(bits.tolist()) if b]
            yield pd.DataFrame(out, columns=[*TILE, "row_", "bits"])

    return spread(drawn).mapInPandas(run, "level int, tx int, ty int, row_ int, bits long").groupBy(*TILE, "row_").agg(F.bit_or("bits").alias("bits"))


def fill_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per level: tiles, how many are covered below half, mean covered share and most hole cells, over masks of 64 cells."""
    tiles = written(_parcel_tiles(spark, d, 3)[0], "tiles")
    rows = masks(tiles, 64, 3).groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct("row_", "bits"))).alias("m"))  # 64 at most

    @F.pandas_udf("int")
    def holes(row: pd.Series, bits: pd.Series) -> pd.Series:
        def one(at: np.ndarray, b: np.ndarray) -> int:
            mask = np.zeros((64, 64), bool)
            mask[at] = (b.astype(np.int64).view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            return kernels.hole_cells(mask)

        return pd.Series([one(r, b) for r, b in zip(row, bits, strict=True)], dtype="int32")

    covered = F.aggregate("m", F.lit(0), lambda n, v: n + F.bit_count(v["bits"])) / 4096
    drawn = rows.select(*TILE, covered.alias("covered"), holes(F.transform("m", lambda v: v["row_"]), F.transform("m", lambda v: v["bits"])).alias("holes"))
    each = tiles.select(*TILE).distinct().join(drawn, TILE, "left").select("level", F.coalesce("covered", F.lit(0.0)).alias("covered"), F.coalesce("holes", F.lit(0)).alias("holes"))
    return each.groupBy("level").agg(F.count("*").alias("n_tiles"), F.sum((F.col("covered") < 0.5).cast("int")).alias("below_half"), F.round(F.avg("covered"), 6).alias("mean"), F.max("holes").alias("most_holes"))


QUERIES = {f.__name__: f for f in (tile_build, pyramid_report, triangulated_area, line_simplify, clip_area, tile_codec, fill_coverage)}

ORACLE_SQL = {
    "triangulated_area": f"with {fx.PARCELS_SQL} select fid, round(w*h*(case when has_hole=1 then 0.75e0 else 1e0 end),6) area from parcels",
    "clip_area": f"""with {fx.PARCELS_SQL}, c as (select fid, greatest(0e0, least(60e0,x0+w)-greatest(-60e0,x0)) a, greatest(0e0, least(30e0,y0+h)-greatest(-30e0,y0)) b from parcels)
     select fid, round(a*b,6) area from c where a*b>=0.0000005e0""",
}
