"""Geometry of several parts, clicks, partitions, and datasets of several layers."""

from __future__ import annotations

import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import geom, grid
from tessella.operators import identify, partition, tools
from tessella.plans import pyramid
from tessella.sources import arrays, clustered, dataset, wkt

D = "/root/testdata/sf0.001"
V = "fid long, part int, ring int, seq int, x double, y double"


def ring(fid, part, no, points):
    return [(fid, part, no, s, float(x), float(y)) for s, (x, y) in enumerate(points)]


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


TWO = ring(1, 0, 0, square(0, 0, 10)) + ring(1, 0, 1, square(2, 2, 3)) + ring(1, 1, 0, square(50, 0, 10)) + ring(2, 0, 0, square(100, 0, 5))


def test_parts_keep_their_rings(spark):
    v = spark.createDataFrame(TWO, V)
    got = {r.fid: r.wkt for r in geom.wkt(v).collect()}
    assert got[2] == "POLYGON ((100.0 0.0, 105.0 0.0, 105.0 5.0, 100.0 5.0, 100.0 0.0))"
    assert got[1].startswith("MULTIPOLYGON (((0.0 0.0, 10.0 0.0,") and got[1].count("((") == 2 and got[1].count("(") == 6
    texts = spark.createDataFrame([(k, t) for k, t in got.items()], "fid long, wkt string")
    back = {tuple(r) for r in wkt.vertices(texts, "wkt").select("fid", "part", "ring", "seq", "x", "y").collect()}
    assert back == set(TWO)
    lines = spark.createDataFrame([(1, 0, 0, 0.0, 1.0), (1, 0, 1, 2.0, 3.0), (1, 1, 0, 4.0, 5.0), (1, 1, 1, 6.0, 7.0), (2, 0, 0, 0.0, 0.0), (2, 0, 1, 1.0, 1.0)], "fid long, part int, seq int, x double, y double")
    assert {r.fid: r.wkt for r in geom.wkt(lines, geom.LINE).collect()} == {1: "MULTILINESTRING ((0.0 1.0, 2.0 3.0), (4.0 5.0, 6.0 7.0))", 2: "LINESTRING (0.0 0.0, 1.0 1.0)"}
    points = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 2.0, 3.0), (2, 0, 5.0, 5.0)], "fid long, part int, x double, y double")
    assert {r.fid: r.wkt for r in geom.wkt(points, geom.POINT).collect()} == {1: "MULTIPOINT ((0.0 1.0), (2.0 3.0))", 2: "POINT (5.0 5.0)"}


def test_groups_don_t_collide(spark):
    rows = ring(1, 1024, 0, square(0, 0, 1)) + ring(2, 0, 0, square(5, 5, 1))
    assert pyramid.rings_of(spark.createDataFrame(rows, V), geom.FACE).select("poly_group").distinct().count() == 2
    pieces = tools.TOOLS.run("vector:buffer", spark.createDataFrame(ring(1, 0, 0, [(0, 0), (5, 0), (5, 5)]) + ring(1, 1, 0, [(9, 9), (20, 9)]), V), distance=1.0)
    per = pieces.groupBy("fid", "part", "ring").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("k")).collect()
    assert all(r.n == r.k for r in per) and sorted({r.part for r in per}) == list(range(len(per)))


def test_ring_tools_return_small_frames():
    rings = pd.DataFrame({"fid": range(3000), "part": 0, "ring": 0, "xs": [np.array([0.0, 1.0, 2.0])] * 3000, "ys": [np.array([5.0, 6.0, 7.0])] * 3000})
    sizes, seen = [], set()
    for f in tools._through(lambda r: [r * 10, r])(iter([rings])):
        sizes.append(len(f))
        seen.update(zip(f.fid, f.piece, f.seq, strict=True))
    assert sum(sizes) == len(seen) == 3000 * 33 and max(sizes) < tools._ROWS + 30 and len(sizes) > 3
    assert list(tools._through(lambda r: [])(iter([rings]))) == []


def test_clicks(spark):
    click = spark.createDataFrame([(1, 3.0, 3.0), (2, 55.0, 5.0), (3, 30.0, 30.0), (4, 1.0, 9.5), (5, 102.0, 7.0)], "q int, x double, y double")
    here = identify.clicks_in(click, 0.25, 4326, 4326)
    assert {r.tol for r in here.collect()} == {2.5}
    attributes = spark.createDataFrame([(1, "a", None), (2, None, 3)], "fid long, name string, n int")
    layer = identify.Layer("faces", geom.FACE, spark.createDataFrame(TWO, V), attributes)
    got = {r.q: (r.fid, round(r.distance, 6), r.attributes) for r in identify.identify(here, layer, 5).collect()}
    # The first click is in the hole, one away from its edge.
    assert got == {1: (1, 1.0, "name=a\nn=NULL"), 2: (1, 0.0, "name=a\nn=NULL"), 4: (1, 0.0, "name=a\nn=NULL"), 5: (2, 2.0, "name=NULL\nn=3")}
    metres = identify.clicks_in(spark.createDataFrame([(1, 0.0, 8000000.0)], "q int, x double, y double"), 1000.0, 3857, 4326).first()
    assert abs(metres.tol - 10000 / 20037508.342789244 * 180) < 1e-9
    line = identify.Layer("lines", geom.LINE, spark.createDataFrame([(7, 0, 0.0, 0.0), (7, 1, 6.0, 0.0), (6, 0, 0.0, 6.0), (6, 1, 6.0, 6.0)], "fid long, seq int, x double, y double"), spark.createDataFrame([(6, 1), (7, 2)], "fid long, v int"))
    assert [(r.fid, r.distance) for r in identify.identify(identify.clicks_in(spark.createDataFrame([(1, 3.0, 3.0)], "q int, x double, y double"), 0.5, 4326, 4326), line, 5).collect()] == [(6, 3.0)]


def test_partition_of_corners(spark):
    rows = [(float(a + k % 10 / 100), float(b + k // 10 / 1000)) for a, b in ((1, 1), (9, 1), (1, 9), (9, 9)) for k in range(100)]
    seg = spark.createDataFrame([(x, y, x + 0.01, y) for x, y in rows], "x1 double, y1 double, x2 double, y2 double")
    got = partition.partition(seg, ["x1", "x2"], ["y1", "y2"], 400).collect()
    assert sorted((r.gy, r.gx, r.n) for r in got) == [(0, 0, 100), (0, 1, 100), (1, 0, 100), (1, 1, 100)]
    assert partition.partition(seg.limit(0), ["x1", "x2"], ["y1", "y2"]).collect() == []
    assert partition.base_size(4096, 1000) == (1024, 250) and partition.base_size(10, 2000) == (5, 1024) and partition.base_size(64, 48) == (64, 48)
    assert [partition.default_mode(n) for n in (1, 2, 3, 4)] == ["gray", "gray", "rgb", "rgb"]


def test_datasets(spark, tmp_path):
    assert {"orders", "part", "events"} <= set(dataset.layer_paths(spark, D))
    listed = {r.layer: r for r in dataset.layer_list(spark, D, ["part"]).collect()}
    assert listed["part"].selected and not listed["orders"].selected and listed["region"].n_features == 5
    assert list(dataset.open_selected(spark, D, ["part"])) == ["part"]
    with pytest.raises(ValueError, match="nothing"):
        dataset.open_selected(spark, D, ["nothing"])


def test_open_whatever_a_path_holds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("fid,wkt\n1,POINT (3 4)\n")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.write(tmp_path / "a.csv", "deep/a.csv")
    assert [(r.x, r.y) for r in dataset.open_any(spark, str(tmp_path / "a.zip")).collect()] == [(3.0, 4.0)]
    assert dataset.open_any(spark, str(tmp_path / "a.csv")).count() == 1
    arrays.write(spark.createDataFrame([(0, 1, 2, 5.0)], "t int, row_ int, col int, z double"), str(tmp_path / "stack"), (1, 4, 4), (2, 2))
    assert [tuple(r) for r in dataset.open_any(spark, str(tmp_path / "stack")).collect()] == [(0, 1, 2, 5.0)]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "fid long, minx double, miny double, maxx double, maxy double")
    clustered.write(boxes, str(tmp_path / "index"), grid.Square(0.0, 0.0, 8.0))
    assert dataset.open_any(spark, str(tmp_path / "index")).first().fid == 1
    with pytest.raises(ValueError, match="table"):
        dataset.open_any(spark, "postgresql://host/db")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("readme.txt", "x")
    with pytest.raises(ValueError, match="no layer"):
        dataset.open_any(spark, str(tmp_path / "b.zip"))


def test_clicks_in_deep_layers_meet_few_features(spark, monkeypatch):
    boxes = [(f, r, float(s % 7), float(s % 5)) for f in range(6000) for r, s in ((0, 3 * f),)]
    v = [(f, r, k, x + dx, y + dy) for f, r, x, y in boxes for k, (dx, dy) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)])]
    layer = identify.Layer("faces", geom.FACE, spark.createDataFrame(v, "fid long, ring int, seq int, x double, y double"), spark.createDataFrame([(f, f) for f in range(6000)], "fid long, v long"))
    clicks = identify.clicks_in(spark.createDataFrame([(k, 0.1 + 0.2 * (k % 40), 0.3 + 0.3 * (k % 20)) for k in range(60)] + [(99, 8.9, 7.2), (98, 3.0, 2.0)], "q int, x double, y double"), 0.05, 4326, 4326)
    met, join = [], identify.box_join

    def counted(*of):
        pairs = join(*of)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(identify, "box_join", counted)
    got = {r.q: (r.fid, round(r.distance, 6)) for r in identify.identify(clicks, layer, 5).collect()}
    away = lambda c, x, y: max(x - c.qx, c.qx - x - 2, 0) ** 2 + max(y - c.qy, c.qy - y - 2, 0) ** 2
    want = {}
    for c in clicks.collect():
        d, f = min((away(c, x, y) ** 0.5, f) for f, _, x, y in boxes)
        if d <= c.tol:
            want[c.q] = (f, round(d, 6))
    assert got == want
    assert sum(met) < 25_000
