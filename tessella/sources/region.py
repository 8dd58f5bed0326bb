"""Exact geometry of a region in chunks, for views closer than the pyramid's deepest level.

Features whose boxes meet the region are dealt to the tiles of the asked level, in the order of (tile, fid). A chunk is the next
so many places of that order behind a token, which is the last place of the chunk before; a reader that stops goes on
from its token, in another session too. Only the chunk's features are read, each ring is cut to its tile exactly, and
coordinates are world coordinates in single precision, consecutive repeats dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom, grid
from tessella.operators.spatial import SQUARE, with_tiles
from tessella.shared import scratch
from tessella.sources import clustered

Token = tuple[int, int]  # tile, fid


@dataclass(frozen=True)
class Region:
    """``boxes`` (fid, minx, miny, maxx, maxy) and ``rings`` (fid, part, ring and ``p``, vertices in order) of one layer."""

    boxes: DataFrame
    rings: DataFrame
    window: clustered.Window
    level: int
    deepest: int
    square: grid.Square = SQUARE

    def __post_init__(self) -> None:
        if self.level <= self.deepest:
            raise ValueError("a level of the pyramid is read from its tiles")

    def places(self) -> DataFrame:
        """(tile, fid) of all features in the region, with tx and ty."""
        met = clustered.region(self.boxes, self.window)
        x0, y0, x1, y1 = grid.visible_range(self.square, self.level, *self.window)
        tiles = with_tiles(met, self.level, *(F.col(c) for c in clustered.BOX), self.square).where(F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1))
        return tiles.select(grid.tile_key(self.level, F.col("tx"), F.col("ty")).alias("tile"), "fid", "tx", "ty")

    def feature_count(self) -> int:
        return clustered.region(self.boxes, self.window).count()

    def pieces(self, places: DataFrame) -> DataFrame:
        """Rings of the features at some places, cut to their tiles: tile, fid, part, ring and ``p`` in single precision."""
        side = self.square.tile_side(self.level)
        left, low = F.lit(self.square.x) + F.col("tx") * side, F.lit(self.square.y) + F.col("ty") * side
        cut = geom.clip_ring(geom.open_points(F.col("p")), left, low, left + side, low + side)
        single = F.transform(cut, lambda v: F.struct(v["x"].cast("float").alias("x"), v["y"].cast("float").alias("y")))
        return self.rings.join(places, "fid").select("tile", "fid", "part", "ring", geom.only(geom.apart(single), lambda p: F.size(p) > 2).alias("p"))

    def chunk(self, most: int, after: Token | None = None) -> tuple[DataFrame, Token | None]:
        """Pieces at the next ``most`` places behind a token, and the next token; None when nothing was left."""
        places = self.places()
        if after:
            places = places.where((F.col("tile") > after[0]) | (F.col("tile") == after[0]) & (F.col("fid") > after[1]))
        part = places.orderBy("tile", "fid").limit(most)
        last = part.agg(F.max(F.struct("tile", "fid")).alias("last")).first().last
        return self.pieces(part), (last.tile, last.fid) if last else None

    def chunks(self, most: int, after: Token | None = None) -> Iterator[tuple[DataFrame, Token]]:
        while True:
            part, after = self.chunk(most, after)
            if after is None:
                return
            yield part, after


def parcels_region(spark: SparkSession, d: str, window: clustered.Window, level: int, deepest: int) -> Region:
    boxes = fx.parcels(spark, d).selectExpr("fid", "x0 minx", "y0 miny", "x0+w maxx", "y0+h maxy")
    return Region(boxes, geom.ring_points(fx.parcel_vertices(spark, d), ["fid", "part", "ring"]), window, level, deepest)


def region_stream(spark: SparkSession, d: str) -> DataFrame:
    """Rings and areas by tile of a region, read in four chunks or so; the reader stops after the second one and goes on from its token."""
    window = clustered.WINDOWS[0]
    path, after = f"{scratch(spark, 'region')}/chunks", None
    most = -(-parcels_region(spark, d, window, 7, 6).places().count() // 4)
    for reader, stop in (("first", 2), ("second", None)):
        region = parcels_region(spark, d, window, 7, 6)  # each reader opens the region anew
        for k, (part, token) in enumerate(region.chunks(most, after)):
            part.write.mode("append").parquet(path)
            after = token
            if stop and k + 1 == stop:
                break
    pieces = spark.read.schema("tile long, fid long, part int, ring int, p array<struct<x:float,y:float>>").parquet(path)
    area = F.abs(geom.ring_area2(F.transform("p", lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y"))))) / 2
    return pieces.withColumn("area", area).groupBy("tile").agg(F.count("*").alias("n_rings"), F.countDistinct("fid").alias("n_features"), F.round(F.sum("area"), 4).alias("area"))


QUERIES = {"region_stream": region_stream}
_T = 360 / 128
ORACLE_SQL = {
    "region_stream": f"""with {fx.PARCELS_SQL}, r as (select fid, x0 a, y0 b, x0+w c, y0+h e, x0 minx, y0 miny, x0+w maxx, y0+h maxy from parcels union all
      select fid, x0+w*0.25e0, y0+h*0.25e0, x0+w*0.75e0, y0+h*0.75e0, x0, y0, x0+w, y0+h from parcels where has_hole=1),
     m as (select * from r where minx<=20 and maxx>=-30 and miny<=25 and maxy>=-15),
     t as (select unnest(range(128)) k), g as (select m.*, tx.k tx, ty.k ty, -180e0+tx.k*{_T}e0 lx, -180e0+ty.k*{_T}e0 ly from m, t tx, t ty
      where tx.k between floor((-30e0+180e0)/{_T}e0) and floor((20e0+180e0)/{_T}e0) and ty.k between floor((-15e0+180e0)/{_T}e0) and floor((25e0+180e0)/{_T}e0)
       and tx.k between floor((minx+180e0)/{_T}e0) and floor((maxx+180e0)/{_T}e0) and ty.k between floor((miny+180e0)/{_T}e0) and floor((maxy+180e0)/{_T}e0)),
     k as (select fid, tx, ty, cast(greatest(a,lx) as float) a, cast(greatest(b,ly) as float) b, cast(least(c,lx+{_T}e0) as float) c, cast(least(e,ly+{_T}e0) as float) e from g)
     select (cast(7 as bigint)<<48)|(tx<<24)|ty tile, count(*) n_rings, count(distinct fid) n_features, round(sum((cast(c as double)-cast(a as double))*(cast(e as double)-cast(b as double))),4) area
     from k where a<c and b<e group by 1""",
}
