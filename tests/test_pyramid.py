"""Tiles drawn and encoded in parts, vectors compared in blocks."""

from __future__ import annotations

from tessella.functions import kernels
from tessella.operators import spatial
from tessella.plans import pyramid


def boxes(spark, rows):
    """Rings of one tile: fid, hole, x, y, side."""
    out = [(0, 0, 0, 1, hole, str(fid), fid, [x, x + s, x + s, x], [y, y, y + s, y + s], "kept", -1) for fid, hole, x, y, s in rows]
    return spark.createDataFrame(out, pyramid.RING_SCHEMA)


def test_masks_join_the_bits_of_polygons_drawn_apart(spark):
    rings = boxes(spark, [(1, 0, 0, 0, 64), (1, 1, 16, 16, 32), (2, 0, 448, 448, 64), (3, 0, 448, 448, 64)]).repartition(4)
    got = {r.row_: r.bits & (1 << 64) - 1 for r in pyramid.masks(rings, 64, 3).collect()}
    frame, ring = 0xFF, 0xC3
    assert got == {k: ring if 2 <= k < 6 else frame for k in range(8)} | {k: 0xFF << 56 for k in range(56, 64)}


def test_runs_of_rings_are_the_whole_tile(spark):
    rows = [(fid, hole, 7 * fid % 400, 11 * fid % 300 + hole, 20 - hole) for fid in range(1, 8) for hole in (0, 1)]
    tiles = boxes(spark, rows)
    verts = pyramid.np.array([p for _, _, x, y, s in rows for p in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))], pyramid.np.int16)
    whole = kernels.encode_tile(verts, [(1, hole, 4 * k, 4, fid - 1) for k, (fid, hole, *_) in enumerate(rows)], [])
    for run in (1, 3, 1000):
        assert pyramid.coded(tiles, run).collect() == [(0, 0, 0, len(whole), True)]


def test_nearest_vectors_go_on_a_block_at_a_time(spark):
    """Every pair was sorted with both vectors before."""
    rows = [(k, [float(k * k % 89), float(k * 7 % 31)], k % 2) for k in range(1500)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    near = spatial.nearest_vectors(v.where("vec_id % 50 = 0"), v)
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    want = {a: min((far(p, q), b) for b, q, m in rows if m == n and b != a) for a, p, n in rows if a % 50 == 0}
    assert {r.vec_id: tuple(r.b) for r in near.collect()} == want
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Generate") < plan.index("Join")  # the nearest of a block is found before rows are sorted
