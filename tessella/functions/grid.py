"""Tile-grid arithmetic: constants, keys, level choice, viewports and screen rectangles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tile format.
NET_CELLS, NET_PAD = 512, 10
DEEP_CELLS, DEEP_PAD = 1024, 20
MIN_INT16, MAX_INT16 = -32768, 32767


def tile_cells(level: int, deepest: int) -> int:
    return DEEP_CELLS if level == deepest else NET_CELLS


def tile_pad(level: int, deepest: int) -> int:
    return DEEP_PAD if level == deepest else NET_PAD


def level_kept(level: int, deepest: int, step: int) -> bool:
    return step <= 1 or level == deepest or level % step == 0


def kept_levels(deepest: int, step: int = 1) -> list[int]:
    return [level for level in range(deepest + 1) if level_kept(level, deepest, step)]


@dataclass(frozen=True)
class Square:
    """The square that a pyramid covers: lower-left corner and side."""

    x: float
    y: float
    side: float

    @staticmethod
    def around(minx: float, miny: float, maxx: float, maxy: float) -> Square:
        """The bbox centred in a square of its longer side."""
        side = max(maxx - minx, maxy - miny)
        return Square((minx + maxx - side) / 2, (miny + maxy - side) / 2, side)

    def tile_side(self, level: int) -> float:
        return self.side / (1 << level)

    def cell(self, level: int, deepest: int) -> float:
        return self.tile_side(level) / tile_cells(level, deepest)


def tile_key(level: Column | int, tx: Column, ty: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.shiftleft(level.cast("long"), 48).bitwiseOR(F.shiftleft(tx.cast("long"), 24)).bitwiseOR(ty.cast("long"))


def tile_index(v: Column, origin: float, side: float, n: int) -> Column:
    """Index of the tile that holds ``v``, clamped to the grid."""
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v - F.lit(origin)) / F.lit(side)))).cast("int")


def _round_half_up(x: float) -> int:
    """Half away from zero."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def wanted_level(side: float, units_per_pixel: float) -> int:
    """The level whose cells match the pixels, not capped; at least 0."""
    if side <= 0 or units_per_pixel <= 0:
        return 0
    return max(0, _round_half_up(math.log2(side / (NET_CELLS * units_per_pixel))))


def choose_level(side: float, units_per_pixel: float, built: set[int]) -> int:
    """The deepest built level not beyond the wanted one; -1 if none is."""
    return max((level for level in built if level <= wanted_level(side, units_per_pixel)), default=-1)


def visible_range(square: Square, level: int, minx: float, miny: float, maxx: float, maxy: float) -> tuple[int, int, int, int] | None:
    """Closed tile range (tx0, ty0, tx1, ty1) of a view, clamped; None if it misses the square."""
    if maxx < square.x or maxy < square.y or minx > square.x + square.side or miny > square.y + square.side:
        return None
    t, n = square.tile_side(level), 1 << level
    at = lambda v, o: min(n - 1, max(0, math.floor((v - o) / t)))
    return at(minx, square.x), at(miny, square.y), at(maxx, square.x), at(maxy, square.y)


@dataclass(frozen=True)
class View:
    """Centre, world units per pixel and size in pixels."""

    cx: float
    cy: float
    scale: float
    width: int
    height: int

    @staticmethod
    def fit(extent: tuple[float, float, float, float], width: int, height: int, pad: float = 1.1) -> View:
        minx, miny, maxx, maxy = extent
        scale = max((maxx - minx) / width, (maxy - miny) / height) * pad
        return View((minx + maxx) / 2, (miny + maxy) / 2, scale if scale > 0 else 1.0, width, height)

    def pan(self, dx: float, dy: float) -> View:
        """Move the content by pixels; y of the screen points down."""
        return View(self.cx - dx * self.scale, self.cy + dy * self.scale, self.scale, self.width, self.height)

    def to_world(self, px: float, py: float) -> tuple[float, float]:
        return self.cx + (px - self.width / 2) * self.scale, self.cy - (py - self.height / 2) * self.scale

    def zoom_at(self, px: float, py: float, factor: float) -> View:
        """Zoom so that the point under the pixel stays."""
        wx, wy = self.to_world(px, py)
        scale = self.scale / factor
        return View(wx - (px - self.width / 2) * scale, wy + (py - self.height / 2) * scale, scale, self.width, self.height)

    def extent(self) -> tuple[float, float, float, float]:
        w, h = self.width * self.scale / 2, self.height * self.scale / 2
        return self.cx - w, self.cy - h, self.cx + w, self.cy + h


def extent_union(*extents: tuple[float, float, float, float] | None) -> tuple[float, float, float, float] | None:
    own = [e for e in extents if e]
    return (min(e[0] for e in own), min(e[1] for e in own), max(e[2] for e in own), max(e[3] for e in own)) if own else None


def screen_rect(view: View, square: Square, level: int, tx: Column, ty: Column) -> dict[str, Column]:
    """Pixel rectangle of a tile; neighbours share rounded edges, and each has a pixel at least."""
    t = square.tile_side(level)
    px = lambda k: F.round((F.lit(square.x) + k * F.lit(t) - F.lit(view.cx)) / F.lit(view.scale) + F.lit(view.width / 2.0)).cast("int")
    py = lambda k: F.round(F.lit(view.height / 2.0) - (F.lit(square.y) + k * F.lit(t) - F.lit(view.cy)) / F.lit(view.scale)).cast("int")
    left, right, top, bottom = px(tx), px(tx + 1), py(ty + 1), py(ty)
    return {"px": left, "py": top, "pw": F.greatest(F.lit(1), right - left), "ph": F.greatest(F.lit(1), bottom - top)}


def map_scale(units_per_pixel: Column, latitude: Column, pixel_m: float = 0.000264583) -> Column:
    """1:N of a geographic view, N rounded to 1, 2 or 5 times a power of ten."""
    n = units_per_pixel * F.lit(111319.49) * F.cos(F.radians(latitude)) / F.lit(pixel_m)
    power = F.pow(F.lit(10.0), F.floor(F.log10(n)).cast("double"))
    lead = n / power
    return (F.when(lead < 1.5, 1.0).when(lead < 3.5, 2.0).when(lead < 7.5, 5.0).otherwise(10.0) * power).cast("long")


def raster_blocks(width: int, height: int, pixels_per_cell: float, window: tuple[int, int, int, int]) -> tuple[int, list[tuple[int, int]]]:
    """Side in cells of blocks that fill about 256 pixels, and the blocks a window (x0, y0, x1, y1) meets."""
    if max(width, height) <= 2048 or pixels_per_cell * max(width, height) / 1024 <= 1.5:
        return 0, []
    span = max(1, math.ceil(256 / pixels_per_cell))
    x0, y0, x1, y1 = window
    xs = range(max(0, x0 // span), min((width - 1) // span, x1 // span) + 1)
    ys = range(max(0, y0 // span), min((height - 1) // span, y1 // span) + 1)
    return span, [(bx, by) for by in ys for bx in xs]
