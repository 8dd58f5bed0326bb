"""Arrays in blocks, loads that are stopped, second reads, arcs."""

from __future__ import annotations

import math
import threading
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual

from tessella.functions import arcs, geom
from tessella.operators import raster
from tessella.shared import exists
from tessella.sources import arrays
from tessella.streaming import loading


@pytest.fixture(scope="module")
def stack(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("array") / "stack")
    cells = [(t, r, c, None if (r, c) == (1, 1) else float(t * 10000 + r * 100 + c)) for t in range(3) for r in range(20) for c in range(30) if (r + c) % 7]
    arrays.write(spark.createDataFrame(cells, "t int, row_ int, col int, z double"), path, (3, 20, 30), (8, 8))
    return path, {(t, r, c): z for t, r, c, z in cells if z is not None}


def test_only_asked_blocks_are_read(spark, stack):
    path, cells = stack
    whole = arrays.open_array(spark, path)
    assert {(x.t, x.row_, x.col): x.z for x in whole.collect()} == cells
    assert whole.rdd.getNumPartitions() == 3 * 3 * 4 == len(arrays.meta(path)["blocks"])
    part = arrays.window(arrays.time_slice(whole, 1), 6, 9, 5, 3)
    assert part.rdd.getNumPartitions() == 2  # columns 6 to 10 meet two blocks, rows 9 to 11 one
    assert {(x.row_, x.col): x.z for x in part.collect()} == {(r, c): z for (t, r, c), z in cells.items() if t == 1 and 6 <= c < 11 and 9 <= r < 12}
    assert arrays.time_slice(whole, -4).count() == arrays.time_slice(whole, 0).count() > 0
    assert arrays.time_slice(whole, 9).collect() == [] and whole.where("z > 20000 and t < 2").collect() == []
    assert whole.where("z = 10203").collect()[0].row_ == 2


def test_filters_that_the_reader_takes(stack):
    reader = arrays.ArrayReader(stack[0])
    filters = [EqualTo(("t",), 1), GreaterThan(("row_",), 7), LessThanOrEqual(("col",), 7), IsNotNull(("t",)), EqualTo(("z",), 1.0)]
    assert list(reader.pushFilters(filters)) == filters[3:]
    assert [(b.t, b.by, b.bx) for b in reader.partitions()] == [(1, 1, 0), (1, 2, 0)]


def test_store_without_meta_is_no_store(spark, tmp_path):
    (tmp_path / "t=0").mkdir()
    with pytest.raises((PySparkException, FileNotFoundError)):
        arrays.open_array(spark, str(tmp_path)).collect()


def test_block_rectangle(spark):
    affine = (10.0, 2.0, 0.5, 50.0, -0.25, -1.0)
    got = spark.range(1).select(*(c.alias(n) for c, n in zip(raster.block_rectangle(F.lit(8), F.lit(4), F.lit(8), F.lit(8), 12, 9, affine), "abcd", strict=True))).first()
    corners = [(10 + c * 2 + r * 0.5, 50 - c * 0.25 - r) for c in (8, 12) for r in (4, 9)]
    assert tuple(got) == (min(x for x, _ in corners), min(y for _, y in corners), max(x for x, _ in corners), max(y for _, y in corners))


def slow(df, seconds):
    def wait(frames):
        for f in frames:
            time.sleep(seconds)
            yield f

    return df.mapInPandas(wait, df.schema)


def test_time_budget_in_the_middle_of_a_chunk(spark, tmp_path):
    path = str(tmp_path / "load")
    layer = spark.range(100).select(F.col("id").alias("fid"), (F.col("id") * 3).alias("v")).coalesce(1)
    chunks = loading.fid_chunks(layer, 25)
    assert len(chunks) == 4
    held = [chunks[0], lambda: slow(chunks[1](), 120), *chunks[2:]]
    chunks[0]().collect()
    began = time.monotonic()
    p = loading.run_chunks(spark, held, path, budget_s=12)
    assert time.monotonic() - began < 60 and 0 < p.done < 4 and not p.finished
    assert loading.loaded(spark, path, p).count() == 25 * p.done
    assert not exists(spark, f"{path}/chunk=1/_SUCCESS")
    rest = loading.run_chunks(spark, chunks, path)  # the next sitting goes on behind the whole chunks
    assert rest.finished and sorted(r.fid for r in loading.loaded(spark, path, rest).collect()) == list(range(100))
    assert spark.range(10).count() == 10  # later jobs aren't tagged


def test_cancel_and_errors(spark, tmp_path):
    path = str(tmp_path / "load")
    layer = spark.range(10).select(F.col("id").alias("fid"))
    chunks = loading.fid_chunks(layer, 5)
    stop = loading.Cancel()
    threading.Timer(5, stop, [spark]).start()
    assert loading.run_chunks(spark, [lambda: slow(chunks[0]().coalesce(1), 90), chunks[1]], path, cancel=stop).done == 0
    assert loading.loaded(spark, path, loading.Progress(0, 2)) is None
    broken = lambda: layer.select(F.raise_error(F.lit("broken")).alias("fid"))
    with pytest.raises(PySparkException):
        loading.run_chunks(spark, [broken], str(tmp_path / "other"))
    assert loading.fid_chunks(layer.limit(0)) == []


def test_many_chunks_take_few_writes(spark, tmp_path):
    layer = spark.range(7, 1007).where("id <> 500").select(F.col("id").alias("fid"))
    for features, most, writes in ((2, 16, 16), (400, 16, 3), (1000, 16, 1), (300, 2, 2)):
        chunks = loading.packed_chunks(layer, features, most)
        assert len(chunks) == writes
        rows = [[(r.fid, r.part) for r in c().collect()] for c in chunks]
        assert sorted(r for own in rows for r in own) == [(k, (k - 7) // features) for k in range(7, 1007) if k != 500]
        parts = [{part for _, part in own} for own in rows]
        assert sum(map(len, parts)) == len(set().union(*parts))  # no chunk is in two writes
    assert loading.packed_chunks(layer.limit(0), 10) == []


def test_layer_is_counted_once_and_read_again_only_if_empty(spark, tmp_path):
    again = []

    def other():
        again.append(1)
        return spark.createDataFrame([(1, 2.0)], "fid int, x double")

    for k, (rows, reread) in enumerate((([(1, 1.0), (2, None)], False), ([(1, None), (2, None)], True), ([], False))):
        got, did = loading.load_checked(spark.createDataFrame(rows, "fid int, x double"), F.col("x").isNotNull(), str(tmp_path / f"l{k}"), other)
        assert did == reread and len(again) == (1 if k else 0)
        assert got.count() == (1 if reread else len(rows))


def points(df, name="v"):
    return [(p.x, p.y) for p in df.select(name).first()[0]]


@pytest.mark.parametrize(
    ("curve", "length", "ends"),
    [
        ([(1, 0), (0, 1), (-1, 0)], math.pi, ((1, 0), (-1, 0))),
        ([(1, 0), (0, -1), (-1, 0)], math.pi, ((1, 0), (-1, 0))),
        ([(1, 0), (math.cos(0.1), math.sin(0.1)), (0, -1)], 1.5 * math.pi, ((1, 0), (0, -1))),
        ([(0, 0), (1, 1), (3, 3)], math.hypot(3, 3), ((0, 0), (3, 3))),
        ([(0, 0), (2, 0), (0, 0)], 2 * math.pi, ((0, 0), (0, 0))),
        ([(1, 0), (0, 1), (-1, 0), (-2, 1), (-3, 0)], 2 * math.pi, ((1, 0), (-3, 0))),
        ([(0, 0), (5, 0)], 5, ((0, 0), (5, 0))),
        ([(1, 1), (1, 1), (1, 1)], 0, ((1, 1), (1, 1))),
    ],
)
def test_arcs(spark, curve, length, ends):
    df = spark.createDataFrame([([dict(x=float(x), y=float(y)) for x, y in curve],)], f"p {geom.RING}")
    v = points(df.select(arcs.linearise(F.col("p"), math.radians(1)).alias("v")))
    got = sum(math.dist(a, b) for a, b in zip(v, v[1:], strict=False))
    assert (v[0], v[-1]) == ends and abs(got - length) <= length * 1e-3


def test_lengths_in_the_row(spark):
    lines = [[], [(1, 1)], [(0, 0), (3, 4)], [(0, 0), (3, 4), (3, 4), (3, 0)]]
    df = spark.createDataFrame([(k, [dict(x=float(x), y=float(y)) for x, y in p]) for k, p in enumerate(lines)], f"k int, p {geom.RING}")
    assert [r[0] for r in df.orderBy("k").select(arcs.path_length(F.col("p"))).collect()] == [0.0, 0.0, 5.0, 9.0]
    plan = arcs.arc_lengths(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1  # parcels are dealt, vertices are not


def test_no_curve_is_left(spark):
    layer = spark.createDataFrame([("COMPOUNDCURVE", [dict(x=0.0, y=0.0)])], f"kind string, points {geom.RING}")
    with pytest.raises(PySparkException, match="still a curve"):
        arcs.linear_layer(layer).collect()
    assert arcs.linear_layer(layer.withColumn("kind", F.lit("POINT"))).first().kind == "POINT"
