"""The level planner and the chain of merged levels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions import geom, grid
from tessella.plans import chain, planner

D = "/root/testdata/sf0.001"
SQUARE = grid.Square(0.0, 0.0, 128.0)
V = "fid long, part int, ring int, seq int, x double, y double"


def square_ring(fid, x, y, s, ring=0):
    return [(fid, 0, ring, k, float(a), float(b)) for k, (a, b) in enumerate([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)])]


def rings(spark, rows):
    return geom.ring_points(spark.createDataFrame(rows, V), ["fid", "part", "ring"])


def plain_counts(ring, cap):
    out = []
    for level in range(cap + 1):
        cell, last, n = 128 / (1024 * 2**level), None, 0
        for _, _, _, _, x, y in ring:
            q = (math.floor(x / cell + 0.5), math.floor(y / cell + 0.5))
            n += q != last
            last = q
        out.append(n if n >= 3 else 0)
    return out


def test_counts_are_rolled_back(spark):
    rows = [square_ring(1, 1, 1, 50), square_ring(2, 3, 3, 0.01), square_ring(3, 7.3, 9.1, 0.2)]
    got = planner.level_counts(spark.createDataFrame(sum(rows, []), V), ["fid", "part", "ring"], geom.FACE, SQUARE, 8).first()
    want = [plain_counts(r, 8) for r in rows]
    assert [got[f"c{k}"] for k in range(9)] == [sum(x) for x in zip(*want, strict=True)] and got.n_vertices == 15
    assert want[1][0] == 0 and want[1][8] > 0


def test_plan_and_valves(spark):
    v = fx.parcel_vertices(spark, D)
    by, square = ["fid", "part", "ring"], grid.Square(-180.0, -180.0, 360.0)
    free = planner.plan(v, by, geom.FACE, square, 200.0, 10)
    e = sorted(r.gap for r in planner.gaps(v, by).collect())
    assert free.step == e[(len(e) - 1) // 2]
    assert free.level == max(0, min(10, math.ceil(math.log2(360 / (1024 * free.step / 200))))) and not free.lowered
    low = planner.plan(v, by, geom.FACE, square, 200.0, 10, most=6000)
    total = lambda k: 1.5 * (sum(low.counts[:k]) / 2 + low.counts[k])
    assert low.lowered and low.level < free.level and low.total == total(low.level) <= 6000 < total(low.level + 1)
    assert planner.plan(v, by, geom.FACE, square, 0.0, 6, target=10).level in range(7)
    nothing = planner.plan(v.limit(0), by, geom.FACE, square)
    assert nothing.level == 0 and nothing.n_vertices == 0 and nothing.keep_ratio == 0


def test_chain_loses_no_face(spark):
    rows = square_ring(1, 1, 1, 100) + square_ring(1, 30, 30, 40, ring=1) + sum((square_ring(10 + k, 3 + k * 1.7, 5 + k, 0.002 * (k + 1)) for k in range(60)), [])
    levels = chain.build(rings(spark, rows), 4, merged=4, square=SQUARE)
    assert sorted(levels) == [0, 1, 2, 3, 4]
    table = {r.level: r for r in chain.net_table(levels, 4).collect()}
    for level in range(4):
        shells = lambda k: levels[k].rings.where("ring = 0").count()
        net = levels[level + 1].rings.where("ring = 0")
        if level + 1 == 4:  # rings of the source reach into the padding
            p = geom.clip_ring(F.transform("p", lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y"))), *map(F.lit, (0.0, 0.0, 1024.0, 1024.0)))
            net = net.withColumn("p", p).where((F.size("p") > 2) & (F.abs(geom.ring_area2(F.col("p"))) >= 1))
        assert shells(level) + table[level].n_counted == net.count() + table[level + 1].n_counted
        cell = SQUARE.cell(level, 4)
        assert abs(table[level].cells * cell * cell - (100 * 100 - 40 * 40)) < 4 * 150 * cell + 1
    assert table[0].n_counted > 0


def test_default_merges_the_coarsest_level_only(spark):
    r = rings(spark, square_ring(1, 1, 1, 100))
    a, b = chain.build(r, 4, 2, square=SQUARE), chain.build(r, 4, 2, merged=2, square=SQUARE)
    assert sorted(a) == sorted(b) == [0, 2, 4]
    spread = lambda own: {(x.tx, x.ty) for x in own.rings.collect()}
    assert spread(a[2]) == spread(b[2])
    assert len(a[2].rings.collect()) < len(b[2].rings.collect())  # a merged level holds a piece for each child


def test_groups_and_saturation(spark):
    many = sum((square_ring(k, 64.01, 64.01, 0.001) for k in range(300)), [])
    levels = chain.build(rings(spark, many + square_ring(999, 10, 10, 60) + square_ring(998, 20, 20, 60)), 2, merged=2, square=SQUARE)
    assert [r.cnt for r in levels[0].cover.collect()] == [300]
    per_tile = levels[0].rings.groupBy("tx", "ty", "poly_group").agg(F.countDistinct("fid").alias("n")).collect()
    assert all(r.n == 1 for r in per_tile) and {r.poly_group for r in per_tile} == set(range(len(per_tile)))
    table = chain._counted(spark.createDataFrame([(0, 0, 5, 65000), (0, 0, 5, 65000)], "tx int, ty int, cell int, cnt int"), 1)
    assert table.first().cnt == chain.SATURATED
