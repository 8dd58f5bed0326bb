"""Clustered index, quadtree, region chunks, outlines, union and fills against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import fixtures, registry
from tessella.functions import geom, grid, kernels
from tessella.operators import dissolve, fill, outlines, quadtree, spatial, tools
from tessella.shared import exists, remove
from tessella.sources import clustered, region

D = "/root/testdata/sf0.001"
SQUARE = grid.Square(0.0, 0.0, 128.0)
BOXES = "fid long, minx double, miny double, maxx double, maxy double"


def some_boxes(n, seed=1):
    rng = random.Random(seed)
    out = [(0, 0.0, 0.0, 128.0, 128.0), (1, 63.9, 63.9, 64.1, 64.1), (2, 64.0, 64.0, 64.0, 64.0), (3, -5.0, 3.0, 1.0, 4.0), (4, 127.0, 127.0, 140.0, 140.0)]
    for k in range(5, n):
        x, y, s = rng.uniform(0, 128), rng.uniform(0, 128), rng.choice([0, 0.01, 0.5, 3, 32])
        out.append((k, x, y, x + s * rng.random(), y + s))
    return out


def scanned(df):
    """(rows, rows that the scan gave): the scan leaves out row groups by their footers only."""
    plan = df._jdf.queryExecution().executedPlan()
    rows = plan.executeCollect()
    scan = plan.collectLeaves().head()
    return len(rows), scan.metrics().apply("numOutputRows").value()


def test_index_reads_few_row_groups(spark, tmp_path):
    rows = some_boxes(20_000)
    layer = spark.createDataFrame(rows, BOXES)
    index = clustered.ensure(layer, str(tmp_path / "i"), SQUARE, 500)
    for window in ((10.0, 10.0, 14.0, 13.0), (100.0, 5.0, 104.0, 9.0)):
        got, read = scanned(clustered.region(index, window))
        assert got == sum(a <= window[2] and c >= window[0] and b <= window[3] and e >= window[1] for _, a, b, c, e in rows)
        assert got <= read <= 20_000 / 4
    plain = str(tmp_path / "plain")
    layer.repartition(40, "fid").write.parquet(plain)
    assert scanned(clustered.region(spark.read.parquet(plain), (10.0, 10.0, 14.0, 13.0)))[1] == 20_000


def test_index_presence(spark, tmp_path):
    path = str(tmp_path / "i")
    layer = spark.createDataFrame(some_boxes(50), BOXES)
    assert clustered.find(spark, path) is None
    first = clustered.ensure(layer, path, SQUARE)
    assert first.count() == 50 and clustered.ensure(layer.limit(0), path, SQUARE).count() == 50
    remove(spark, f"{path}/header")  # as after a writer that was stopped
    assert exists(spark, f"{path}/data") and clustered.find(spark, path) is None
    assert clustered.ensure(layer.limit(7), path, SQUARE).count() == 7
    remove(spark, clustered.file_bounds(clustered.find(spark, path)).first().file)
    assert clustered.find(spark, path) is None


def test_z_order(spark):
    got = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y")).withColumn("z", clustered.z_order(F.col("x"), F.col("y"), 3)).collect()
    for r in got:
        assert r.z == sum((r.x >> k & 1) << 2 * k | (r.y >> k & 1) << 2 * k + 1 for k in range(3))


@pytest.mark.parametrize("reach", [0.0, 0.75])
def test_boxes_around_points(spark, reach):
    boxes = some_boxes(300)
    rng = random.Random(2)
    points = [(k, rng.uniform(-3, 135), rng.uniform(-3, 135)) for k in range(300)] + [(300, 64.0, 64.0), (301, 128.0, 128.0), (302, 0.0, 0.0)]
    got = quadtree.around_points(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(boxes, BOXES), reach, SQUARE)
    want = {(p, f) for p, x, y in points for f, a, b, c, e in boxes if a - reach <= x <= c + reach and b - reach <= y <= e + reach}
    pairs = [(r.p, r.fid) for r in got.select("p", "fid").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert quadtree.stored(spark.createDataFrame(boxes, BOXES), SQUARE).count() == 300


def test_region_chunks_and_tokens(spark):
    window = (-30.0, -15.0, 20.0, 25.0)
    r = region.parcels_region(spark, D, window, 7, 6)
    whole = {(x.tile, x.fid, x.ring, tuple(x.p)) for x in r.pieces(r.places()).collect()}
    seen, after, sizes = [], None, []
    while True:
        part, token = region.parcels_region(spark, D, window, 7, 6).chunk(9, after)  # a new reader for each chunk
        if token is None:
            break
        rows = [(x.tile, x.fid, x.ring, tuple(x.p)) for x in part.collect()]
        assert all((after or (0, 0)) < (t, f) <= token for t, f, _, _ in rows)
        seen += rows
        sizes.append(len({(t, f) for t, f, _, _ in rows}))
        after = token
    assert len(seen) == len(set(seen)) == len(whole) and set(seen) == whole and max(sizes) <= 9 and len(sizes) > 2
    assert all(float(v.x) == v.x for _, _, _, p in whole for v in p)
    with pytest.raises(ValueError):
        region.parcels_region(spark, D, window, 6, 6)


def test_features_outside_are_not_read(spark):
    boxes = spark.createDataFrame([(1, 50.0, 50.0, 51.0, 51.0), (2, 5000.0, 5000.0, 5001.0, 5001.0)], BOXES)
    rings = spark.createDataFrame([(1, 0, 0, 0, 50.0, 50.0)], "fid long, part int, ring int, seq int, x double, y double")
    r = region.Region(boxes, geom.ring_points(rings, ["fid", "part", "ring"]), (0.0, 0.0, 100.0, 100.0), 4, 2, SQUARE)
    assert r.feature_count() == 1 and {x.fid for x in r.places().collect()} == {1}


def plain_clip_area(ring, box):
    """Area by small steps of a concave ring in a box."""
    n, inside = 200, 0
    for i in range(n):
        for j in range(n):
            x, y = box[0] + (i + 0.5) * (box[2] - box[0]) / n, box[1] + (j + 0.5) * (box[3] - box[1]) / n
            hit = False
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    hit = not hit
            inside += hit
    return inside * (box[2] - box[0]) * (box[3] - box[1]) / n / n


def test_ring_inside_a_rectangle_is_not_cut(spark):
    rows = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)],), ([(0.0, 0.0), (9.0, 0.0), (9.0, 1.0), (0.0, 1.0)],)], f"p {geom.RING}")
    got = rows.select(geom.clip_ring(F.col("p"), *map(F.lit, (0.0, 0.0, 4.0, 4.0))).alias("q"))
    assert [[(v.x, v.y) for v in r.q] for r in got.collect()] == [[(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (0.0, 1.0)]]
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "case when forall" in plan


def test_clip_ring(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (7.0, 10.0), (7.0, 3.0), (3.0, 3.0), (3.0, 10.0), (0.0, 10.0)]
    df = spark.createDataFrame([([dict(x=x, y=y) for x, y in ring],)], f"p {geom.RING}")
    for box in ((-1.0, -1.0, 11.0, 11.0), (2.0, 2.0, 8.0, 8.0), (4.0, 4.0, 6.0, 6.0), (5.0, -5.0, 20.0, 5.0), (20.0, 20.0, 30.0, 30.0)):
        p = geom.clip_ring(F.col("p"), *map(F.lit, box))
        got = df.select(F.when(F.size(p) > 2, F.abs(geom.ring_area2(p)) / 2).otherwise(0.0).alias("a")).first().a
        assert abs(got - plain_clip_area(ring, box)) < 0.5


def test_rings_of_regions(spark):
    grid_rows = ["aaaaab", "abbbab", "abcbab", "abbbaa", "aaaaab", "babbba"]
    cells = [(c, r, ord(v)) for r, row in enumerate(grid_rows) for c, v in enumerate(row)]
    linked = outlines.outlines(spark.createDataFrame(cells, "col int, row_ int, z long")).cache()
    rings = outlines.ring_table(linked, ["region", "z"]).collect()
    regions = {}
    for r in rings:
        regions.setdefault((r.region, r.z), []).append(r.area2 / 2)
    runs, _ = outlines.label_runs(spark.createDataFrame(cells, "col int, row_ int, z long"))
    want = {(r.region, r.z): r.n for r in runs.groupBy("region", "z").agg(F.sum(F.expr("b - a + 1")).alias("n")).collect()}
    assert {k: sum(v) for k, v in regions.items()} == want
    assert all(sum(a > 0 for a in v) == 1 for v in regions.values())
    assert sorted(a for v in regions.values() for a in v if a < 0) == [-9.0, -1.0]
    v = outlines.ring_vertices(linked, ["region", "z"]).collect()
    by = {}
    for x in sorted(v, key=lambda x: (x.ring, x.seq)):
        by.setdefault(x.ring, []).append((x.x, x.y))
    assert all(p[0] == p[-1] and len(p) >= 5 and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(p, p[1:], strict=False)) for p in by.values())


def test_long_ring_takes_few_rounds(spark):
    snake = [(c, r, 1) for r in range(0, 41, 2) for c in range(40)] + [((39 if r % 4 == 1 else 0), r, 1) for r in range(1, 40, 2)]
    rings = outlines.ring_table(outlines.outlines(spark.createDataFrame(snake, "col int, row_ int, z long")), ["region"]).collect()
    assert len(rings) == 1 and rings[0].area2 / 2 == len(snake)


def polygon(piece, points, ring=0, g=1):
    return [(g, piece, ring, s, float(x), float(y)) for s, (x, y) in enumerate([*points, points[0]])]


PIECES = "g int, piece int, ring int, seq int, x double, y double"


def union_area(spark, rows, unit=0.5):
    edges = dissolve.union_edges(spark.createDataFrame(rows, PIECES), ["g"], unit)
    rings = outlines.ring_table(outlines.link(edges, ["g"]), ["g"]).collect()
    return sum(r.area2 for r in rings) / 2 * unit * unit, sorted(r.area2 / 2 * unit * unit for r in rings)


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


@pytest.mark.parametrize(
    ("shapes", "areas"),
    [
        ([box(0, 0, 4, 4), box(2, 2, 4, 4)], [28]),
        ([box(0, 0, 4, 4), box(4, 0, 4, 4)], [32]),  # a common side goes
        ([box(0, 0, 4, 4), box(0, 0, 4, 4)], [16]),  # copies
        ([box(0, 0, 4, 4), box(4, 4, 4, 4)], [16, 16]),  # a common corner
        ([box(0, 0, 9, 3), box(0, 6, 9, 3), box(0, 0, 3, 9), box(6, 0, 3, 9)], [-9, 81]),  # a hole
        ([box(0, 0, 10, 10), box(2, 2, 3, 3)], [100]),
        ([list(reversed(box(0, 0, 4, 4))), box(2, 0, 4, 4)], [24]),  # clockwise input
    ],
)
def test_union_of_boxes_is_exact(spark, shapes, areas):
    assert union_area(spark, [r for k, s in enumerate(shapes) for r in polygon(k, s)])[1] == areas


def test_union_of_a_deep_stack_keeps_few_pieces(spark, monkeypatch):
    rng = random.Random(5)
    shapes = [(rng.randrange(60), rng.randrange(60), rng.randrange(40, 90), rng.randrange(40, 90)) for _ in range(150)]
    rows, write = [], dissolve.written

    def counted(df, tag):
        out = write(df, tag)
        rows.append(out.count())
        return out

    monkeypatch.setattr(dissolve, "written", counted)
    got, _ = union_area(spark, [r for k, s in enumerate(shapes) for r in polygon(k, box(*s))], 1.0)
    assert got == len({(x, y) for a, b, w, h in shapes for x in range(a, a + w) for y in range(b, b + h)})
    assert max(rows) < 8_000  # 12,765 pieces when all crossings are cut


def test_union_with_holes_and_slopes(spark):
    donut = polygon(0, box(0, 0, 12, 12)) + polygon(0, box(3, 3, 6, 6), ring=1)
    assert union_area(spark, donut + polygon(1, box(5, 5, 2, 2)))[1] == [-36, 4, 144]
    rng = random.Random(4)
    shapes = []
    for _ in range(12):
        cx, cy, r, turn = rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(2, 5), rng.random()
        shapes.append([(cx + r * math.cos(2 * math.pi * (k + turn) / 7), cy + r * math.sin(2 * math.pi * (k + turn) / 7)) for k in range(7)])
    got, _ = union_area(spark, [r for k, s in enumerate(shapes) for r in polygon(k, s)], 1e-5)
    n, hit = 300, 0
    for i in range(n):
        for j in range(n):
            x, y = -6 + (i + 0.5) * 32 / n, -6 + (j + 0.5) * 32 / n
            hit += any(all((b[0] - a[0]) * (y - a[1]) >= (b[1] - a[1]) * (x - a[0]) for a, b in zip(s, s[1:] + s[:1], strict=True)) for s in shapes)
    assert abs(got - hit * (32 / n) ** 2) < 2.0


def test_buffer_outline(spark):
    line = spark.createDataFrame([(1, 0, 0, 0, 0.0, 0.0), (1, 0, 0, 1, 10.0, 0.0), (1, 0, 0, 2, 10.0, 10.0)], "fid long, part int, ring int, seq int, x double, y double")
    got = tools.buffer_outline(line, 1.0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.ring, r.seq)):
        by.setdefault(r.ring, []).append((r.x, r.y))
    assert len(by) == 1
    (p,) = by.values()
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:], strict=False)) / 2
    assert p[0] == p[-1] and abs(area - (40 - 1 + math.pi / 4 + math.pi)) < 0.1


def test_trapezoids_of_a_star(spark):
    star = [(math.cos(math.pi * k / 5) * (4 if k % 2 else 10), math.sin(math.pi * k / 5) * (4 if k % 2 else 10)) for k in range(10)]
    rows = [(1, 0, s, x, y) for s, (x, y) in enumerate([*star, star[0]])] + [(1, 1, s, x, y) for s, (x, y) in enumerate([*box(-1.0, -1.0, 2.0, 2.0), (-1.0, -1.0)])]
    edges = geom.segments(spark.createDataFrame(rows, "fid int, ring int, seq int, x double, y double"), ["fid", "ring"])
    want = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(star, star[1:] + star[:1], strict=True))) / 2 - 4
    t = fill.triangles(fill.trapezoids(edges, ["fid"]), ["fid"]).collect()
    assert abs(sum(abs((r.x2 - r.x1) * (r.y3 - r.y1) - (r.x3 - r.x1) * (r.y2 - r.y1)) / 2 for r in t) - want) < 1e-9


def test_triangles_leave_holes_out(spark):
    n, held = fixtures.parcels(spark, D).selectExpr("count(*)", "sum(has_hole)").first()
    assert held > 0 and registry.queries()["triangle_partition"](spark, D).selectExpr("sum(n)").first()[0] == 2 * (n - held) + 8 * held


def test_small_faces_are_outlined_only(spark):
    rows = [(k, 0, 0, s, float(x), float(y)) for k, b in enumerate((box(1, 1, 2, 2), box(10, 10, 30, 30))) for s, (x, y) in enumerate([*b, b[0]])]
    rings = geom.ring_points(spark.createDataFrame(rows, "fid long, part int, ring int, seq int, x double, y double"), ["fid", "part", "ring"])
    for deepest, filled in ((4, {1}), (2, {0, 1})):
        segments, fills = fill.drawable_tiles(rings, 2, deepest, 2000.0)
        assert {r.fid for r in segments.collect()} == {0, 1} and {r.fid for r in fills.collect()} == filled


@pytest.mark.parametrize(("name", "bounded"), [("rings_at_points", 0), ("shared_edges", 0), ("triangle_partition", 0), ("filled_geometry", 0), ("drawn_tiles", 1)])
def test_exploded_tables_are_not_broadcast(spark, name, bounded):
    # drawn_tiles joins two tables of a row a tile; all else grows with the input.
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= bounded


def test_pairs_of_sites_and_parcels_are_not_shuffled(spark):
    plan = registry.queries()["point_in_polygon_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "BroadcastExchange" not in plan
    assert "partial_count" in plan[: plan.index("Join")]  # counted by parcel before anything leaves the join's task


def test_points_in_polygons_are_counted_without_pairs(spark, monkeypatch):
    def no_pairs(*_):
        raise AssertionError("pairs of sites and parcels are tested")

    rng = random.Random(7)
    points = [(k, rng.randrange(-80, 80) / 4, rng.uniform(-20, 20)) for k in range(3000, 0, -1)] + [(9001, None, 0.0), (9002, 0.0, float("nan"))]
    vertices = []
    for k in range(60):
        x, y, s = rng.randrange(-20, 15), rng.randrange(-20, 15), rng.randrange(1, 12)
        shapes = [box(x, y, x + s, y + s), box(x + s / 4, y + s / 4, x + s * 3 / 4, y + s * 3 / 4)][: 1 + k % 2] if k % 3 else [[(x + rng.uniform(-s, s), y + rng.uniform(-s, s)) for _ in range(7)]]
        vertices += [(k, 0, r, i, float(a), float(b)) for r, shape in enumerate(shapes) for i, (a, b) in enumerate([*shape, shape[0]])]
    want = {}
    for k in range(60):
        rings = [[v[4:] for v in vertices if v[0] == k and v[2] == r] for r in (0, 1)]
        held = [f for f, x, y in points if x is not None and sum(kernels.point_in_ring(x, y, r[:-1]) for r in rings if r) % 2]
        if held:
            want[k] = (len(held), min(held))
    layer = spark.createDataFrame(vertices, "fid long, part int, ring int, seq int, x double, y double")
    monkeypatch.setattr(geom, "crosses_ray", no_pairs)
    got = spatial.held_points(spark.createDataFrame(points, "fid long, x double, y double"), layer, 5).collect()
    assert {r.parcel: (r.n_sites, r.first_site) for r in got} == want
    registry.queries()["point_in_polygon_join"](spark, D)


def test_points_far_from_outlines_are_not_tested(monkeypatch):
    tested, crosses = [], kernels.crosses_ray
    monkeypatch.setattr(kernels, "crosses_ray", lambda px, *edge: tested.append(len(px)) or crosses(px, *edge))
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 100, (2, 20_000))
    shell = np.array([(10.0, 10.0), (90.0, 12.0), (88.0, 90.0), (12.0, 88.0), (10.0, 10.0)])
    n, first = kernels.points_in_polygons(x, y, np.arange(20_000), shell[:, 0], shell[:, 1], np.arange(5) == 0, np.array([5]))
    inside = [k for k in range(20_000) if kernels.point_in_ring(x[k], y[k], [tuple(v) for v in shell[:-1]])]
    assert (n[0], first[0]) == (len(inside), inside[0]) and sum(tested) < 4 * 20_000 / 5


def test_pairs_of_features_with_common_edges_are_not_shuffled(spark):
    plan = registry.queries()["shared_edges"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")]


def test_edge_pairs(spark):
    rng = random.Random(8)
    shapes = {}
    for k in range(200):
        x, y = rng.randrange(4), rng.randrange(4)
        shapes[k] = [box(x, y, x + rng.randrange(3), y + rng.randrange(3)), box(x + 5, y, x + 6, y + 1)][: 1 + (k % 5 == 0)]
    shapes |= {k: shapes[7] for k in range(500, 1800)}  # a class of more than one block
    rows = [(k, part, i, a, b) for k, parts in shapes.items() for part, r in enumerate(parts) for i, (a, b) in enumerate([*r, r[0]])]
    edges = {k: {tuple(sorted(e)) for r in parts for e in zip(r, r[1:] + r[:1], strict=True) if e[0] != e[1]} for k, parts in shapes.items()}
    want = {(a, b): n for a in shapes for b in shapes if a < b and (n := len(edges[a] & edges[b]))}
    got = spatial.edge_pairs(spark.createDataFrame(rows, "fid long, part int, seq int, x long, y long")).collect()
    assert len(got) == len(want) and {(r.fid, r.other): r.n_shared for r in got} == want


def test_overlaps_are_counted_without_pairs(spark, monkeypatch):
    def no_pairs(*_):
        raise AssertionError("pairs of boxes are made")

    rng = random.Random(6)
    corners = [(float(rng.randrange(-20, 20)), float(rng.randrange(-20, 20))) for _ in range(300)]
    rows = [(k, x, y, x + rng.randrange(9), y + rng.randrange(9)) for k, (x, y) in enumerate(corners)]
    rows += [(1000 + k, *rows[k][1:]) for k in range(40)] + [(1, -5.0, -5.0, 5.0, 5.0), (900, None, 0.0, 1.0, 1.0)]
    meet = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    counted = lambda rows: {f: n for f in {r[0] for r in rows} if (n := sum(meet(a, b) for a in rows if a[0] == f and a[1] is not None for b in rows if b[0] != f and b[1] is not None))}
    ask = lambda rows: {r.fid: r.n_overlaps for r in spatial.overlap_counts(spark.createDataFrame(rows, "fid long, minx double, miny double, maxx double, maxy double"), 7).collect()}
    odd = [*rows, (2000, 4.0, -3.0, -4.0, 3.0), (2001, 0.0, 2.0, 1.0, -2.0)]  # inside out
    assert ask(odd) == counted(odd)
    monkeypatch.setattr(spatial, "box_join", no_pairs)
    assert ask(rows) == counted(rows)
