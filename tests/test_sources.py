from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.functions import crs
from tessella.operators.tools import TOOLS, Arg, Registry, leaves, tree_from_json
from tessella.sources import layers, wkt


def test_wkt():
    assert wkt.parse("POINT (1 2)") == [(2, [[(1, 2)]])]
    assert len(wkt.parse("MULTIPOINT ((1 2), (3 4))")) == len(wkt.parse("MULTIPOINT (1 2, 3 4)")) == 2
    assert len(wkt.parse("POLYGON ((0 0,1 0,1 1,0 0),(.1 .1,.2 .1,.2 .2,.1 .1))")[0][1]) == 2
    assert len(wkt.parse("GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))")) == 2
    for bad in ("", "POINT EMPTY", "GEOMETRYCOLLECTION EMPTY", "POINT (1)", "CIRCLE (1 2)", "POINT (1 2) x", "POLYGON ((0 0, 1 1"):
        with pytest.raises(wkt.WktError):
            wkt.parse(bad)
    for text in ("POINT (1 2)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))"):
        assert wkt.to_text(wkt.parse(text)) == text


def test_literal_layer(spark):
    rows = wkt.literal(spark, "POLYGON ((0 0, 1 0, 1 1, 0 0))", 4326)
    assert rows.count() == 4 and rows.first().epsg == 4326


def test_geojson_and_csv(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[116,39]}},{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3]]]}}]}')
    got = layers.open_layer(spark, str(tmp_path / "a.geojson")).collect()
    assert sorted((r.fid, r.type, r.part, r.seq) for r in got) == [(0, 2, 0, 0), *((1, 1, 0, k) for k in range(4)), (2, 0, 0, 0), (2, 0, 0, 1), (2, 0, 1, 0), (2, 0, 1, 1)]
    (tmp_path / "b.csv").write_text('fid,wkt\n7,"LINESTRING (0 0, 1 1)"\n8,nothing\n')
    assert {r.fid for r in layers.open_layer(spark, str(tmp_path / "b.csv")).collect()} == {7}
    assert [layers.kind_of(p) for p in ("a.tiles", "a.TIF", "postgresql://h/d", "a.shp")] == ["tiles", "raster", "database", "vector"]


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for n in ("readme.txt", "a.gpkg", "b.shp", "c.shp", "c.shx"):
            z.writestr(n, "")
    assert layers.archive_member(str(tmp_path / "z.zip")) == "c.shp"


def test_database_uris():
    u = layers.PostgresUri("h", 5433, "my db", "u@x", "p/w:1", "require", {"application_name": "a b"})
    assert layers.PostgresUri.parse(u.text()) == u
    assert "p%2Fw" not in u.masked() and "***" in u.masked()
    with pytest.raises(ValueError):
        layers.PostgresUri.parse("mysql://x")


def test_geolocated_arrays():
    assert layers.parse_geoloc(layers.geoloc_spec("/a|b.nc", "t", -3)) == ("/a|b.nc", "t", 0)
    assert layers.parse_geoloc("other") is None
    arrays = [{"name": "lon", "shape": [4, 5]}, {"name": "lat", "shape": [4, 5]}, {"name": "sst", "shape": [7, 4, 5], "coordinates": "lon lat"}, {"name": "k", "shape": [7], "coordinates": "lon lat"}]
    assert [(v["name"], v["time_count"]) for v in layers.geoloc_variables(arrays)] == [("sst", 7)]
    assert layers.lonlat_pair([{"name": "a", "units": "degrees_east"}, {"name": "Latitude"}]) == ("a", "Latitude")
    assert layers.lonlat_pair([{"name": "q"}]) is None
    assert layers.subdatasets({"S1_NAME": "a", "S1_DESC": "b"}) == ["a"]


def test_layer_cache(spark, tmp_path):
    src = tmp_path / "s.txt"
    src.write_text("x")
    cache, reads = layers.LayerCache(spark, str(tmp_path / "cache")), []
    load = lambda: cache.load(str(src), "l/1", lambda: reads.append(1) or spark.range(3))
    assert load().count() == load().count() == 3 and len(reads) == 1
    assert [e[1] for e in cache.entries()] == ["l/1"]
    src.write_text("longer")
    load()
    assert len(reads) == 2
    cache.clear()
    assert cache.entries() == []
    assert layers.fnv1a64("") == 0xCBF29CE484222325 and layers.fnv1a64("a") == 0xAF63DC4C8601EC8C


def test_policies():
    assert [layers.route(5, False), layers.route(5, True), layers.route(10**7, False)] == ["direct", "tiles", "build"]
    assert layers.read_raw(8, 6, 100, 1.0) and not layers.read_raw(8, 6, 10**6, 1.0) and not layers.read_raw(8, 6, 30_000, 0.001, indexed=False)


def test_layer_info(spark):
    info = layers.LayerInfo()
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 3.0)], "x double, y double")
    assert info.of("p", df, with_count=False)["feature_count"] == -1
    assert info.of("p", df)["feature_count"] == 2
    assert info.of("p", df, with_count=False)["maxy"] == 3.0


def test_projections(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(116.39, 39.90), (-3.5, -20.0)], "x double, y double")
    for epsg in (3857, 32650, 32730):
        px, py = crs.reproject(F.col("x"), F.col("y"), 4326, epsg)
        there = df.select("x", "y", px.alias("px"), py.alias("py"))
        bx, by = crs.reproject(F.col("px"), F.col("py"), epsg, 4326)
        for r in there.select("x", "y", bx.alias("bx"), by.alias("by")).collect()[: 1 if epsg == 32650 else 2]:
            if epsg == 3857 or abs(r.x - (117 if epsg == 32650 else -3)) < 4:
                assert r.bx == pytest.approx(r.x, abs=1e-6) and r.by == pytest.approx(r.y, abs=1e-6)
    with pytest.raises(crs.UnsupportedCrs):
        crs.reproject(F.col("x"), F.col("y"), 4610, 4326)
    assert crs.display_epsg([3857, 4326]) == 4326 and crs.display_epsg([3857]) == 3857 and crs.epsg_text(0) == "unknown"


def test_tools(spark):
    assert len(TOOLS.tools) == 10 and TOOLS.search("SLOPE")[0].path == "raster:slope"
    with pytest.raises(ValueError):
        TOOLS.run("vector:buffer", None, endcap="pointed")
    with pytest.raises(ValueError):
        TOOLS.run("vector:buffer", None, other=1)
    r = Registry()
    r.tool("a:b", "B", Arg("input", "dataset", required=True), Arg("q", "boolean", False), Arg("k", "list"), on_run=lambda ctx: {**ctx, "q": "yes"})(lambda df, **kw: kw)
    assert r.run("a:b", None, input="x") == {"input": "x", "q": True, "k": None}
    assert r.command("a:b", {"input": "x", "q": "on", "k": "1, 2"}) == ["b", "x", "--q", "--k", "1", "--k", "2"]
    with pytest.raises(ValueError):
        r.command("a:b", {})
    t = tree_from_json('{"name":"r","children":[{"name":"v","children":[{"name":"x","arguments":[{"name":"m","choices":["a",{"value":"b"}]}]}]}]}')
    assert [(x.path, x.args[0].choices) for x in leaves(t)] == [("r:v:x", ("a", "b"))]


def test_tile_store(spark, tmp_path):
    from tessella import fixtures as fx
    from tessella.functions import geom, grid
    from tessella.plans import pyramid

    cfg, square = pyramid.PyramidConfig(deepest=2), grid.Square(-180.0, -180.0, 360.0)
    tiles, cover = pyramid.build(pyramid.rings_of(fx.parcel_vertices(spark, "/root/testdata/sf0.001"), geom.FACE), square, cfg, merge=True)
    pyramid.store(tiles, cover, str(tmp_path / "t"), square, cfg, 4326)
    rings, cells, head = pyramid.open_store(spark, str(tmp_path / "t"))
    assert head["epsg"] == 4326 and {r.level for r in rings.select("level").distinct().collect()} <= {0, 1, 2}
    r = rings.first()
    assert pyramid.read_tile(rings, r.level, r.tx, r.ty).count() >= 1


def test_clip_box_in_another_system(spark):
    square = wkt.literal(spark, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", 4326).selectExpr("fid", "part", "ring", "seq", "x", "y")
    x, y = crs.to_mercator(F.lit(5.0), F.lit(5.0))
    corner = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    got = TOOLS.run("vector:clip", square, bbox=[0, 0, corner.x, corner.y], bbox_crs=3857).collect()
    assert len(got) == 5 and max(r.x for r in got) == pytest.approx(5) and max(r.y for r in got) == pytest.approx(5)
