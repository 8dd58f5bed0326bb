from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tessella.functions import geom, grid, kernels
from tessella.plans import pyramid, topology

SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]
HOLE = [(40, 40), (60, 40), (60, 60), (40, 60), (40, 40)]


def area(triangles):
    return sum(abs(kernels.signed_area([t[:2], t[2:4], t[4:]])) for t in triangles)


def star(rng, n, cx=0.0, cy=0.0):
    return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n) for r in [rng.uniform(3, 10)]]


def test_triangles_keep_area():
    assert len(kernels.triangulate([SQUARE])) == 2
    assert area(kernels.triangulate([SQUARE, HOLE])) == pytest.approx(10000 - 400)
    assert kernels.triangulate([[(0, 0), (1, 1)]]) == []
    rng = random.Random(1)
    for n in range(3, 40):
        ring = star(rng, n)
        assert area(kernels.triangulate([ring])) == pytest.approx(abs(kernels.signed_area(ring)))


def test_several_holes():
    holes = [[(x, y), (x + 5, y), (x + 5, y + 5), (x, y + 5)] for x in (10, 30, 50) for y in (10, 40)]
    assert area(kernels.triangulate([SQUARE, *holes])) == pytest.approx(10000 - 6 * 25)


def test_exact_clip_agrees_with_triangles():
    rng = random.Random(2)
    for n in range(3, 30):
        ring = star(rng, n)
        box = (-4.1, -3.3, 5.2, 4.7)
        parts = kernels.clip_polygon(ring, *box)
        got = sum(abs(kernels.signed_area(p)) for p in parts)
        want = abs(kernels.signed_area(kernels.clip_ring(ring, *box)))
        assert got == pytest.approx(want)
        assert all(box[0] <= x <= box[2] and box[1] <= y <= box[3] for p in parts for x, y in p)


def test_clip_cases():
    assert kernels.clip_polygon(SQUARE, 10, 10, 20, 20) == [[(10, 10), (20, 10), (20, 20), (10, 20)]]
    assert kernels.clip_polygon(SQUARE, 200, 200, 300, 300) == []
    u = [(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)]
    assert len(kernels.clip_polygon(u, -1, 5, 11, 9)) == 2  # two legs, no bridge between them


def test_clip_keeps_what_barely_reaches_in():
    # Sides that should end at the border and end beside it by rounding, on either side.
    sides = [(k / 10 - 150, s / 10) for s in range(1, 51) for k in [900 - s]]
    assert {(x0 + w > -60) - (x0 + w < -60) for x0, w in sides} == {-1, 0, 1}
    for x0, w in sides:
        x1 = x0 + w
        got = kernels.clip_polygon([(x0, 14.4), (x1, 14.4), (x1, 15.4), (x0, 15.4)], -60, -30, 60, 30)
        assert bool(got) == (x1 > -60), (x0, w)
        turned = kernels.clip_polygon([(14.4, -x0), (15.4, -x0), (15.4, -x1), (14.4, -x1)], -30, -60, 30, 60)
        assert bool(turned) == (x1 > -60), (x0, w)
        for ring in got:
            assert {p[0] for p in ring} == {-60, x1} and {p[1] for p in ring} == {14.4, 15.4}


def test_simplify():
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], float)
    w = kernels.simplify_weights(line)
    assert np.isinf(w[[0, -1]]).all() and w[1] < w[3]
    assert kernels.douglas_peucker(line, 0.1).tolist() == [True, False, True, True, True]


def test_codec_round_trip():
    rng = np.random.default_rng(3)
    verts = rng.integers(-32768, 32768, (500, 2)).astype(np.int16)
    rings = [(1, 0, 0, 200, 7), (0, 1, 200, 300, -1)]
    cover = [(5, 255), (262143, 1)]
    data = kernels.encode_tile(verts, rings, cover)
    v, r, c = kernels.decode_tile(data)
    assert (v == verts).all() and r == rings and c == cover
    for bad in (data[:-1], data + b"x", b""):
        with pytest.raises(ValueError):
            kernels.decode_tile(bad)


def test_points_and_areas():
    assert kernels.point_in_ring(50, 50, SQUARE) and not kernels.point_in_ring(150, 50, SQUARE)
    x, y = kernels.interior_point(SQUARE)
    assert kernels.point_in_ring(x, y, SQUARE)
    mask = kernels.fill_mask(np.array(kernels.triangulate([SQUARE, HOLE])), 100)
    assert mask.sum() == 9600 and kernels.hole_cells(mask) == 400


def test_shared_edges_stay_shared():
    mid = [(50, 0), (51, 20), (49, 40), (52, 60), (50, 80), (50, 100)]
    left = [(0, 0), *mid, (0, 100)]
    right = [(100, 0), (100, 100), *mid[::-1]]
    out = topology.tidy({0: left, 1: right}, 5.0, 0, 100)
    edges = [{frozenset((f[k - 1], f[k])) for k in range(len(f))} for f in out.values()]
    a, b = ({p for e in x for p in e if 40 < p[0] < 60} for x in edges)
    assert a == b and len(a) < len(mid)


def test_small_face_joins_its_neighbour():
    big = [(0, 0), (10, 0), (10, 10), (0, 10)]
    small = [(10, 4), (11, 4), (11, 5), (10, 5)]
    big = [(0, 0), (10, 0), (10, 4), (10, 5), (10, 10), (0, 10)]
    out = topology.merge_small({0: big, 1: small})
    assert list(out) == [0] and abs(kernels.signed_area(out[0])) == 101


def test_holes_by_nesting():
    assert topology.holes([SQUARE[:-1], HOLE[:-1]]) == [False, True]
    assert topology.holes([HOLE[:-1]]) == [False]


def test_grid_rules():
    assert grid.kept_levels(5, 2) == [0, 2, 4, 5]
    s = grid.Square.around(0, 0, 100, 50)
    assert (s.x, s.y, s.side) == (0, -25, 100)
    assert grid.wanted_level(512, 1) == 0 and grid.wanted_level(512, 0.25) == 2
    assert grid.choose_level(512, 0.25, {0, 1}) == 1
    assert grid.visible_range(s, 2, -1000, -1000, -500, -500) is None
    assert grid.visible_range(s, 2, 0, 0, 1e9, 1e9) == (0, 1, 3, 3)
    assert grid.View.fit((0, 0, 100, 50), 200, 100).scale == pytest.approx(0.55)
    v = grid.View(0, 0, 1, 100, 100).zoom_at(75, 25, 2)
    assert v.to_world(75, 25) == (25, 25)


def test_area_is_kept_over_a_pyramid():
    cfg = pyramid.PyramidConfig(deepest=3)
    square = grid.Square(0.0, 0.0, 100.0)
    ring = np.array([(10, 10), (30, 10), (30, 90), (10, 90), (10, 10)], float)
    for level in cfg.levels:
        net = grid.tile_cells(level, 3)
        total = 0.0
        for lv, tx, ty, xs, ys, reason, _ in pyramid.route_ring(1, ring[:, 0], ring[:, 1], square, cfg):
            if lv == level and reason == "kept":
                p = kernels.clip_polygon(list(zip(map(float, xs), map(float, ys), strict=True)), 0, 0, net, net)
                total += sum(abs(kernels.signed_area(q)) for q in p) * square.cell(level, 3) ** 2
        assert total == pytest.approx(20 * 80, rel=0.05)


def test_short_rings_settle_as_long_ones_do(monkeypatch):
    rng, numpy_calls = random.Random(1), []
    at = lambda s: rng.choice([rng.uniform(-s, s), round(rng.uniform(-s, s) * 2) / 2])
    rings = [[(at(s), at(s)) for _ in range(rng.choice([1, 2, 3, 4, 4, 5, 9]))] for s in (0.2, 1, 5, 30, 1e5) for _ in range(400)]
    plain = lambda r: (list(map(int, r[0])), list(map(int, r[1])), *r[2:])
    run = lambda: [plain(pyramid._settle(kind, np.array(p, float), 0.25, -0.5, 1.0, 512)) for p in rings + [[*p, p[0]] for p in rings] for kind in (geom.FACE, geom.LINE)]
    real = pyramid.drop_collinear
    monkeypatch.setattr(pyramid, "drop_collinear", lambda *a: (numpy_calls.append(1), real(*a))[1])
    short = run()
    assert not numpy_calls
    monkeypatch.setattr(pyramid, "_SHORT", 0)
    assert run() == short and numpy_calls


def test_sub_cell_faces_are_counted_or_stubbed():
    cfg = pyramid.PyramidConfig(deepest=2)
    square = grid.Square(0.0, 0.0, 100.0)
    tiny = np.array([(50, 50), (50.001, 50), (50.001, 50.001), (50, 50.001), (50, 50)], float)
    out = list(pyramid.route_ring(1, tiny[:, 0], tiny[:, 1], square, cfg))
    assert len(out) == 3 and {r[5] for r in out} == {"coverage"}


def test_tidy_of_copies_is_that_of_single_faces():
    rng = np.random.default_rng(3)
    for _ in range(150):
        faces = []
        for x, y, w, h, n in rng.integers((0, 0, 1, 1, 1), (6, 6, 4, 4, 4), (30, 5)).tolist():
            faces += n * [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if n < 3 else [(x, y), (x + w, y), (x, y + h)]]
        faces.sort(key=lambda f: (abs(kernels.signed_area(f)), f))
        single = topology.tidy(dict(enumerate(faces)), 0.75, 0, 512)
        own = [f for k, f in enumerate(faces) if f not in faces[:k]]
        counts = [faces.count(f) for f in own]
        got = {}
        for c, copy, last, ring in topology.tidy_counted(own, counts, 0.75, 0, 512):
            for k in range(copy, counts[c]) if copy == last else [copy]:
                got[faces.index(own[c]) + k] = ring
        assert got == single


def test_a_thousand_copies_cost_one_look(monkeypatch):
    """Rings that fall together in a coarse tile were each compared with all others there."""
    looks = []
    monkeypatch.setattr(topology._Counted, "_attempt", lambda self, k, was=topology._Counted._attempt: looks.append(k) or was(self, k))
    unit = [(5, 5), (6, 5), (6, 6), (5, 6)]
    assert topology.tidy_counted([unit], [1_000_000], 0.1, 0, 512) == [(0, 0, 0, unit)]
    assert len(looks) == 1
