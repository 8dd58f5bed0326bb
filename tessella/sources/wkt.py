"""WKT in and out: points, lines, polygons, their multi forms and collections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessella.functions.geom import FACE, LINE, POINT

_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


class WktError(ValueError):
    pass


def parse(text: str) -> list[tuple[int, list[list[tuple[float, float]]]]]:
    """(type, rings) of each part; WktError for text that is invalid or has nothing to draw."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise WktError(f"unexpected text at {at}")
        tokens.append(m[1])
        at = m.end()
    pos = 0

    def take(want: str | None = None) -> str:
        nonlocal pos
        if pos >= len(tokens) or (want and tokens[pos].upper() != want):
            raise WktError(f"expected {want or 'more'}")
        pos += 1
        return tokens[pos - 1]

    def peek() -> str:
        return tokens[pos].upper() if pos < len(tokens) else ""

    def vertex() -> tuple[float, float]:
        numbers = []
        while peek() not in ("", ",", ")"):
            try:
                numbers.append(float(take()))
            except ValueError as e:
                raise WktError("a number was expected") from e
        if len(numbers) < 2:
            raise WktError("a vertex needs two numbers")
        return numbers[0], numbers[1]

    def several(one) -> list:
        take("(")
        out = [one()]
        while peek() == ",":
            take()
            out.append(one())
        take(")")
        return out

    def point() -> tuple[float, float]:
        if peek() == "(":
            take()
            v = vertex()
            take(")")
            return v
        return vertex()

    def shape() -> list:
        kind = take().upper()
        if peek() in ("Z", "M", "ZM"):
            take()
        if peek() == "EMPTY":
            take()
            return []
        if kind == "POINT":
            return [(POINT, [[point()]])]
        if kind == "MULTIPOINT":
            return [(POINT, [[p]]) for p in several(point)]
        if kind in ("LINESTRING", "LINEARRING"):
            return [(LINE, [several(vertex)])]
        if kind == "MULTILINESTRING":
            return [(LINE, [r]) for r in several(lambda: several(vertex))]
        if kind == "POLYGON":
            return [(FACE, several(lambda: several(vertex)))]
        if kind == "MULTIPOLYGON":
            return [(FACE, rings) for rings in several(lambda: several(lambda: several(vertex)))]
        if kind == "GEOMETRYCOLLECTION":
            return [p for part in several(shape) for p in part]
        raise WktError(f"unknown type {kind}")

    out = shape()
    if pos != len(tokens):
        raise WktError("text after the geometry")
    if not out:
        raise WktError("the geometry is empty")
    return out


def to_text(parts: list[tuple[int, list[list[tuple[float, float]]]]]) -> str:
    pair = lambda p: f"{p[0]:.15g} {p[1]:.15g}"
    ring = lambda r: "(" + ", ".join(map(pair, r)) + ")"
    one = {POINT: lambda rs: f"({pair(rs[0][0])})", LINE: lambda rs: ring(rs[0]), FACE: lambda rs: "(" + ", ".join(map(ring, rs)) + ")"}
    name = {POINT: "POINT", LINE: "LINESTRING", FACE: "POLYGON"}
    kinds = {k for k, _ in parts}
    if len(parts) == 1:
        return f"{name[parts[0][0]]} {one[parts[0][0]](parts[0][1])}"
    if len(kinds) == 1:
        k = kinds.pop()
        return f"MULTI{name[k]} (" + ", ".join(one[k](rs) for _, rs in parts) + ")"
    return "GEOMETRYCOLLECTION (" + ", ".join(f"{name[k]} {one[k](rs)}" for k, rs in parts) + ")"


def literal(spark: SparkSession, text: str, epsg: int = 0) -> DataFrame:
    """A layer in vertex form from one literal: fid, type, epsg, part, ring, seq, x, y."""
    rows = [(0, kind, epsg, p, r, s, x, y) for p, (kind, rings) in enumerate(parse(text)) for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "fid long, type int, epsg int, part int, ring int, seq int, x double, y double")


def vertices(df: DataFrame, wkt: str = "wkt", fid: str = "fid") -> DataFrame:
    """The vertex form of a column of WKT; rows that don't parse give nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["fid", "type", "part", "ring", "seq", "x", "y"]
        for f in frames:
            rows = []
            for key, text in zip(f["fid"], f["wkt"], strict=True):
                try:
                    parts = parse(text) if text else []
                except WktError:
                    continue
                rows += [(key, kind, p, r, s, x, y) for p, (kind, rings) in enumerate(parts) for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
            yield pd.DataFrame(rows, columns=names)

    return df.selectExpr(f"`{fid}` fid", f"`{wkt}` wkt").mapInPandas(run, "fid long, type int, part int, ring int, seq int, x double, y double")
