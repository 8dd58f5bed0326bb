"""A registry of declared tools, its ten presets, and queries that run some of them.

Tools are Python functions over DataFrames with typed, defaulted arguments; a hook may rewrite them before a run.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import crs, geom, kernels
from tessella.operators import dissolve, outlines, raster

TRUE = ("1", "true", "TRUE", "yes", "on")


@dataclass(frozen=True)
class Arg:
    name: str
    kind: str = "string"  # string, real, integer, boolean, dataset, list
    default: Any = None
    required: bool = False
    choices: tuple = ()

    def value(self, given: Any) -> Any:
        if given is None or given == "":
            if self.required and self.default is None:
                raise ValueError(f"{self.name} is missing")
            return self.default
        if self.kind == "real":
            given = float(given)
        elif self.kind == "integer":
            given = int(given)
        elif self.kind == "boolean":
            given = given if isinstance(given, bool) else str(given) in TRUE
        elif self.kind == "list" and isinstance(given, str):
            given = [p.strip() for p in given.split(",") if p.strip()]
        if self.choices and given not in self.choices:
            raise ValueError(f"{self.name} has to be one of {', '.join(map(str, self.choices))}")
        return given


@dataclass
class Tool:
    path: str
    label: str
    run: Callable[..., DataFrame] | None
    args: tuple[Arg, ...] = ()
    on_run: Callable[[dict], dict | None] | None = None
    children: list[Tool] = field(default_factory=list)


class Registry:
    def __init__(self) -> None:
        self.tools: dict[str, Tool] = {}

    def tool(self, path: str, label: str, *args: Arg, on_run: Callable[[dict], dict | None] | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.tools[path] = Tool(path, label, f, args, on_run)
            return f

        return add

    def find(self, path: str) -> Tool | None:
        return self.tools.get(path)

    def search(self, text: str) -> list[Tool]:
        """Tools whose label or path has the text, in any case."""
        t = text.lower()
        return [x for k, x in sorted(self.tools.items()) if t in x.label.lower() or t in k.lower()]

    def run(self, path: str, data: DataFrame, **given: Any) -> DataFrame:
        """The hook's table, if it returns one, takes the place of the arguments."""
        tool = self.tools[path]
        if tool.on_run:
            given = tool.on_run(dict(given)) or given
        unknown = set(given) - {a.name for a in tool.args}
        if unknown:
            raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
        return tool.run(data, **{a.name: a.value(given.get(a.name)) for a in tool.args})

    def command(self, path: str, given: dict[str, Any]) -> list[str]:
        """Arguments as a command line: datasets by place, booleans as flags, lists repeated."""
        tool, out = self.tools[path], path.split(":")[-1:]
        for a in tool.args:
            v = a.value(given.get(a.name))
            if a.kind == "dataset":
                if v is None:
                    raise ValueError(f"{a.name} is missing")
                out.append(str(v))
            elif a.kind == "boolean":
                out += [f"--{a.name}"] if v else []
            elif a.kind == "list":
                out += [x for item in v or [] for x in (f"--{a.name}", str(item))]
            elif v is not None:
                out += [f"--{a.name}", str(v)]
        return out


def tree_from_json(text: str) -> Tool:
    """A tree of tools from its description: name, label, arguments (choices as text or {value}), children."""

    def node(d: dict, prefix: str) -> Tool:
        path = f"{prefix}:{d['name']}" if prefix else d["name"]
        args = tuple(Arg(a["name"], a.get("type", "string"), a.get("default"), bool(a.get("required")), tuple(c["value"] if isinstance(c, dict) else c for c in a.get("choices", []))) for a in d.get("arguments", []))
        return Tool(path, d.get("label", d["name"]), None, args, None, [node(c, path) for c in d.get("children", [])])

    return node(json.loads(text), "")


def leaves(tool: Tool) -> list[Tool]:
    return [x for c in tool.children for x in leaves(c)] if tool.children else [tool]


TOOLS = Registry()
_RINGS = "fid long, part int, piece int, ring int, seq int, x double, y double"
_ROWS = 20_000  # a frame that a task returns; a single ring's result may be longer


def _through(work: Callable[[list], list[list]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Frames of rings (fid, part, ring, xs, ys) through ``work``, one row a vertex.

    Results go out as they grow: a task holds a few thousand rows of them, however many rings come in a frame.
    """
    names = ["fid", "part", "piece", "ring", "seq", "x", "y"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                for k, ring in enumerate(work(list(zip(r.xs.tolist(), r.ys.tolist(), strict=True)))):
                    rows += [(r.fid, r.part, k, r.ring, s, float(x), float(y)) for s, (x, y) in enumerate(ring)]
                    if len(rows) >= _ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return run


def _map_rings(vertices: DataFrame, work: Callable[[list], list[list]]) -> DataFrame:
    """Each ring or line of a layer in vertex form through ``work``, which returns any number of rings."""
    v = vertices
    for c in ("part", "ring"):
        if c not in v.columns:
            v = v.withColumn(c, F.lit(0))
    rings = v.groupBy("fid", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    own = rings.select("fid", "part", "ring", *(F.col(f"p.{c}").cast("array<double>").alias(f"{c}s") for c in ("x", "y")))
    return own.mapInPandas(_through(work), _RINGS).transform(_numbered)


def _numbered(pieces: DataFrame) -> DataFrame:
    """Each piece of a part as a part of its own, numbered within the feature."""
    own = F.dense_rank().over(Window.partitionBy("fid").orderBy("part", "piece")) - 1
    return pieces.withColumn("part", own.cast("int")).drop("piece")


def _closed(ring: list) -> bool:
    return len(ring) > 2 and ring[0] == ring[-1]


@TOOLS.tool("vector:buffer", "Buffer", Arg("distance", "real", 100.0, True), Arg("endcap", default="round", choices=("round", "flat", "square")), Arg("join", default="round", choices=("round", "miter", "bevel")))
def buffer(layer: DataFrame, distance: float, endcap: str, join: str) -> DataFrame:
    """Convex pieces whose union is the buffer; a ring's own inside is the first piece."""

    def work(ring: list) -> list[list]:
        closed = _closed(ring)
        pieces = kernels.buffer_ring(ring, distance, closed, cap=endcap, join=join)
        return ([ring] if closed else []) + [[*p, p[0]] for p in pieces]

    return _map_rings(layer, work)


def buffer_outline(layer: DataFrame, distance: float, unit: float = 1e-6) -> DataFrame:
    """The buffer of each feature as the outline of the union of its pieces: fid, ring, seq, x, y."""
    pieces = TOOLS.run("vector:buffer", layer, distance=distance)
    # Every piece counts as a polygon of its own.
    own = pieces.select("fid", F.xxhash64("part", "ring").alias("piece"), F.lit(0).alias("ring"), "seq", "x", "y")
    return dissolve.rings(dissolve.union_edges(own, ["fid"], unit), ["fid"], unit)


@TOOLS.tool("vector:clip", "Clip", Arg("bbox", "list"), Arg("bbox_crs", "integer", 4326), Arg("layer_crs", "integer", 4326))
def clip(layer: DataFrame, bbox: list | None, bbox_crs: int, layer_crs: int) -> DataFrame:
    """Rings and lines inside a box, which is taken to the layer's system first; no box leaves the layer as it is."""
    if not bbox:
        return layer
    box = tuple(map(float, bbox))
    if bbox_crs != layer_crs:
        moved = crs.reproject_bbox(tuple(map(F.lit, box)), bbox_crs, layer_crs)
        box = tuple(layer.sparkSession.range(1).select(*(c.alias(n) for c, n in zip(moved, ("x0", "y0", "x1", "y1"), strict=True))).first())
    from tessella.plans.pyramid import clip_runs

    return _map_rings(layer, lambda r: [[*p, p[0]] for p in kernels.clip_polygon(r, *box)] if _closed(r) else clip_runs(r, *box))


@TOOLS.tool("vector:simplify", "Simplify", Arg("tolerance", "real", 0.0001, True))
def simplify(layer: DataFrame, tolerance: float) -> DataFrame:
    def work(ring: list) -> list[list]:
        out = [p for p, k in zip(ring, kernels.douglas_peucker(np.array(ring, float), tolerance), strict=True) if k]
        return [out if len(out) >= (4 if _closed(ring) else 2) else ring]

    return _map_rings(layer, work)


@TOOLS.tool("vector:reproject", "Reproject", Arg("dst_crs", "integer", 4326, True), Arg("src_crs", "integer", 4326))
def reproject(layer: DataFrame, dst_crs: int, src_crs: int) -> DataFrame:
    x, y = crs.reproject(F.col("x"), F.col("y"), src_crs, dst_crs)
    return layer.withColumns({"x": x, "y": y})


@TOOLS.tool("vector:rasterize", "Rasterize", Arg("attribute"), Arg("burn", "real", 1.0), Arg("resolution", "real", 100.0))
def rasterize(layer: DataFrame, attribute: str | None, burn: float, resolution: float) -> DataFrame:
    cells = raster.rasterize(layer, resolution, burn)
    if not attribute:
        return cells
    values = layer.groupBy("fid").agg(F.first(attribute).alias("value"))
    return cells.drop("value").join(values, "fid")


@TOOLS.tool("raster:reproject", "Reproject raster", Arg("dst_crs", "integer", 4326), Arg("src_crs", "integer", 4326), Arg("affine", "list"), Arg("resolution", "real", 1.0))
def reproject_raster(cells: DataFrame, dst_crs: int, src_crs: int, affine: list, resolution: float) -> DataFrame:
    """Target cells of a resolution over the reprojected bounds; each asks for the nearest source cell by an equi-join."""
    a = tuple(map(float, affine))
    b = cells.agg(F.min("col"), F.max("col"), F.min("row_"), F.max("row_")).first()
    spark = cells.sparkSession
    corner = [(a[0] + c * a[1], a[3] + r * a[5]) for c in (b[0], b[1] + 1) for r in (b[2], b[3] + 1)]
    px, py = crs.reproject(F.col("x"), F.col("y"), src_crs, dst_crs)
    e = spark.createDataFrame(corner, "x double, y double").agg(F.min(px), F.min(py), F.max(px), F.max(py)).first()
    w, h = max(1, math.ceil((e[2] - e[0]) / resolution)), max(1, math.ceil((e[3] - e[1]) / resolution))
    grid = spark.range(w * h).select((F.col("id") % w).cast("int").alias("c"), F.floor(F.col("id") / w).cast("int").alias("r"))
    sx, sy = crs.reproject(F.lit(e[0]) + (F.col("c") + 0.5) * resolution, F.lit(e[3]) - (F.col("r") + 0.5) * resolution, dst_crs, src_crs)
    asked = grid.withColumn("col", F.floor((sx - a[0]) / a[1]).cast("int")).withColumn("row_", F.floor((sy - a[3]) / a[5]).cast("int"))
    return asked.join(cells, ["col", "row_"]).select(F.col("c").alias("col"), F.col("r").alias("row_"), "z")


@TOOLS.tool("raster:convert", "Convert", Arg("output_format", default="parquet", choices=("parquet", "csv", "orc")), Arg("path", required=True))
def convert(cells: DataFrame, output_format: str, path: str) -> DataFrame:
    cells.write.mode("overwrite").format(output_format).save(path)
    return cells.sparkSession.read.format(output_format).schema(cells.schema).load(path)


@TOOLS.tool("raster:slope", "Slope", Arg("unit", default="degrees", choices=("degrees", "percent")), Arg("size", "real", 1.0))
def slope(cells: DataFrame, unit: str, size: float) -> DataFrame:
    return raster.slope(cells, size, unit)


@TOOLS.tool("raster:hillshade", "Hillshade", Arg("azimuth", "real", 315.0), Arg("altitude", "real", 45.0), Arg("zfactor", "real", 1.0))
def hillshade(cells: DataFrame, azimuth: float, altitude: float, zfactor: float) -> DataFrame:
    return raster.hillshade(cells, azimuth, altitude, zfactor)


@TOOLS.tool("raster:polygonize", "Polygonize", Arg("attribute_name", default="dn"))
def polygonize(cells: DataFrame, attribute_name: str) -> DataFrame:
    """Regions of equal value joined over cell sides: region, value, n_cells and n_edges of the outline; :func:`outlines.outlines` gives the rings."""
    runs, touching = outlines.label_runs(cells)
    touch = touching.join(runs.select("id", "a", "b"), "id").join(runs.select(F.col("id").alias("other"), F.col("a").alias("oa"), F.col("b").alias("ob")), "other")
    shared = touch.groupBy("id").agg(F.sum(F.least("b", "ob") - F.greatest("a", "oa") + 1).alias("shared"))
    outline = F.sum((F.col("b") - F.col("a") + 1) * 2 + 2 - F.coalesce("shared", F.lit(0)))
    return runs.join(shared, "id", "left").groupBy("region", F.col("z").alias(attribute_name)).agg(F.sum(F.col("b") - F.col("a") + 1).alias("n_cells"), outline.alias("n_edges"))


def polygonize_dem(spark: SparkSession, d: str) -> DataFrame:
    """Cells per value of the regions of the terrain in bands of two metres."""
    z = fx.dem(spark, d).select("col", "row_", F.floor(F.col("z") / 2).cast("long").alias("z"))
    return TOOLS.run("raster:polygonize", z).groupBy("dn").agg(F.count("*").alias("n_regions"), F.sum("n_cells").alias("n_cells"), F.sum("n_edges").alias("n_edges"))


def buffer_tracks(spark: SparkSession, d: str) -> DataFrame:
    return TOOLS.run("vector:buffer", fx.tracks(spark, d), distance=0.05).groupBy("fid").agg(F.countDistinct("part").alias("n_pieces"), F.round(F.min("y"), 6).alias("miny"), F.round(F.max("y"), 6).alias("maxy"))


def simplify_parcels(spark: SparkSession, d: str) -> DataFrame:
    return TOOLS.run("vector:simplify", fx.parcel_vertices(spark, d), tolerance=0.01).groupBy("fid", "ring").agg(F.count("*").alias("n"))


def clip_parcels(spark: SparkSession, d: str) -> DataFrame:
    return TOOLS.run("vector:clip", fx.parcel_vertices(spark, d).where("ring = 0"), bbox=[-60, -30, 60, 30]).groupBy("fid").agg(F.round(F.min("x"), 6).alias("minx"), F.round(F.max("x"), 6).alias("maxx"), F.round(F.min("y"), 6).alias("miny"), F.round(F.max("y"), 6).alias("maxy"))


QUERIES = {f.__name__: f for f in (polygonize_dem, buffer_tracks, simplify_parcels, clip_parcels)}
ORACLE_SQL = {
    "polygonize_dem": f"""with recursive {fx.DEM_SQL}, c as (select col, row_, row_*64+col id, cast(floor(z/2) as bigint) dn from dem),
     e as (select a.id, b.id other, a.dn from c a join c b on a.dn=b.dn and abs(a.col-b.col)+abs(a.row_-b.row_)=1),
     reach as (select id, id other from c union select r.id, e.other from reach r join e on e.id=r.other), g as (select id, min(other) region from reach group by 1),
     s as (select dn, count(*) n from e group by 1)
     select dn, count(distinct region) n_regions, cast(count(*) as bigint) n_cells, cast(4*count(*)-coalesce(max(n),0) as bigint) n_edges from c join g using (id) left join s using (dn) group by 1""",
    "buffer_tracks": f"with {fx.TRACKS_SQL} select fid, 2*count(*)-1 n_pieces, round(min(y)-0.05e0,6) miny, round(max(y)+0.05e0,6) maxy from tracks group by 1",
    "simplify_parcels": f"with {fx.VERTICES_SQL} select fid, ring, count(*) n from parcel_vertices group by 1,2",
    "clip_parcels": f"""with {fx.PARCELS_SQL}, c as (select fid, greatest(-60e0,x0) a, least(60e0,x0+w) b, greatest(-30e0,y0) c, least(30e0,y0+h) e from parcels)
     select fid, round(a,6) minx, round(b,6) maxx, round(c,6) miny, round(e,6) maxy from c where a<b and c<e""",
}
