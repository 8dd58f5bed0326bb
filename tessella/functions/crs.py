"""Coordinate reference systems by EPSG number, 0 for unknown: inference, families and closed-form projection.

Supported: 4326 and 4490 (taken as the same datum), 3857, and UTM zones 32601-32660 and 32701-32760. Systems that need a
datum shift raise an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

R = 6378137.0
GEOGRAPHIC = (4326, 4490, 4610, 4214, 4269, 4258)
_E2 = 0.0066943799901413165
_K0 = 0.9996


class UnsupportedCrs(ValueError):
    pass


def epsg_text(epsg: int) -> str:
    return f"EPSG:{epsg}" if epsg else "unknown"


def infer_epsg(wkt: Column) -> Column:
    """EPSG of a geographic system from its WKT, in this order; 0 for projected or unknown ones."""
    has = lambda *words: F.lit(False) if not words else _any([wkt.contains(w) for w in words])
    return (
        F.when(wkt.isNull() | wkt.contains("PROJCS"), 0)
        .when(has("CGCS", "D_2000", "S_2000", "2000"), 4490)
        .when(has("Xian 1980", "Xian_1980", "Xian"), 4610)
        .when(has("Beijing 1954", "Beijing_1954", "Beijing"), 4214)
        .when(has("WGS 84", "WGS_1984", "WGS84"), 4326)
        .otherwise(0)
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def is_geographic(epsg: int) -> bool:
    return epsg in GEOGRAPHIC


def display_epsg(layers: list[int]) -> int:
    """The first layer's system, unless some layer is geographic: then the first that is."""
    return next((e for e in layers if is_geographic(e)), layers[0] if layers else 0)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * F.lit(R), F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * F.lit(R)


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / F.lit(R)), F.degrees(2 * F.atan(F.exp(y / F.lit(R))) - F.lit(math.pi / 2))


@dataclass(frozen=True)
class Utm:
    zone: int
    south: bool

    @staticmethod
    def of(epsg: int) -> Utm | None:
        if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
            return Utm(epsg % 100, epsg >= 32700)
        return None

    @property
    def meridian(self) -> float:
        return math.radians(self.zone * 6 - 183)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Series of the transverse Mercator projection, to the sixth order."""
        phi, lam = F.radians(lat), F.radians(lon) - F.lit(self.meridian)
        ep2 = _E2 / (1 - _E2)
        n = F.lit(R) / F.sqrt(1 - F.lit(_E2) * F.sin(phi) ** 2)
        t, c = F.tan(phi) ** 2, F.lit(ep2) * F.cos(phi) ** 2
        a = lam * F.cos(phi)
        e4, e6 = _E2**2, _E2**3
        m = F.lit(R) * (
            F.lit(1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - F.lit(3 * _E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
            + F.lit(15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - F.lit(35 * e6 / 3072) * F.sin(6 * phi)
        )
        x = F.lit(_K0) * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * a**5 / 120) + 500000.0
        y = F.lit(_K0) * (m + n * F.tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c**2) * a**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * a**6 / 720))
        return x, y + (10000000.0 if self.south else 0.0)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        ep2 = _E2 / (1 - _E2)
        m = (y - (10000000.0 if self.south else 0.0)) / _K0
        mu = m / (R * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
        e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
        p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu)
        c, t = ep2 * F.cos(p) ** 2, F.tan(p) ** 2
        s = 1 - _E2 * F.sin(p) ** 2
        n, r = R / F.sqrt(s), R * (1 - _E2) / s**1.5
        d = (x - 500000.0) / (n * _K0)
        lat = p - (n * F.tan(p) / r) * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep2 - 3 * c**2) * d**6 / 720)
        lon = self.meridian + (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep2 + 24 * t**2) * d**5 / 120) / F.cos(p)
        return F.degrees(lon), F.degrees(lat)


def reproject(x: Column, y: Column, src: int, dst: int) -> tuple[Column, Column]:
    """Columns in ``dst``; unchanged if either is unknown or both are the same."""
    same = {4490: 4326}
    src, dst = same.get(src, src), same.get(dst, dst)
    if not dst or not src or src == dst:
        return x, y
    for e in (src, dst):
        if e not in (4326, 3857) and Utm.of(e) is None:
            raise UnsupportedCrs(f"EPSG:{e} needs a datum shift or a projection that isn't supported")
    if src == 3857:
        x, y = from_mercator(x, y)
    elif utm := Utm.of(src):
        x, y = utm.inverse(x, y)
    if dst == 3857:
        return to_mercator(x, y)
    return utm.forward(x, y) if (utm := Utm.of(dst)) else (x, y)


def reproject_bbox(bounds: tuple[Column, Column, Column, Column], src: int, dst: int, margin: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """Bounds of the corners and the centre, widened by a share of the span on each side."""
    minx, miny, maxx, maxy = bounds
    points = [reproject(px, py, src, dst) for px, py in ((minx, miny), (minx, maxy), (maxx, miny), (maxx, maxy), ((minx + maxx) / 2, (miny + maxy) / 2))]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    x0, x1, y0, y1 = F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)
    dx, dy = (x1 - x0) * margin, (y1 - y0) * margin
    return x0 - dx, y0 - dy, x1 + dx, y1 + dy
