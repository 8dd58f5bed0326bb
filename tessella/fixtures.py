"""Deterministic geospatial views over the driver tables, which hold no geometry.

``*_SQL`` are the same views as DuckDB common table expressions for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITES_SQL = """sites as (select o_orderkey fid, cast((o_orderkey*7919)%360000 as double)/1e3-180e0 x,
 cast((o_orderkey*104729)%170000 as double)/1e3-85e0 y, o_orderstatus status, o_totalprice amount from orders)"""
PARCELS_SQL = """parcels as (select p_partkey fid, cast((p_partkey*7919)%3000 as double)/1e1-150e0 x0,
 cast((p_partkey*104729)%1400 as double)/1e1-70e0 y0, cast(p_size as double)/1e1 w, cast(1+p_partkey%9 as double)/2e0 h,
 case when p_size>=25 then 1 else 0 end has_hole, p_brand brand from part)"""
VERTICES_SQL = (
    PARCELS_SQL
    + """, q5 as (select unnest(range(5)) seq), parcel_vertices as (
 select fid, 0 part, 0 ring, cast(seq as int) seq, x0+w*(case when seq in (1,2) then 1e0 else 0e0 end) x, y0+h*(case when seq in (2,3) then 1e0 else 0e0 end) y from parcels, q5
 union all select fid, 0, 1, cast(seq as int), x0+w*(case when seq in (1,2) then 0.75e0 else 0.25e0 end), y0+h*(case when seq in (2,3) then 0.75e0 else 0.25e0 end)
 from parcels, q5 where has_hole=1)"""
)
TRACKS_SQL = """numbered as (select *, cast(row_number() over (partition by user_id order by ts,event_id)-1 as bigint) seq from events),
 tracks as (select user_id fid, seq, cast((user_id*7919)%3000 as double)/1e1-150e0+cast(seq as double)/1e2 x,
 cast((user_id*104729)%1400 as double)/1e1-70e0+value/1e3 y from numbered)"""
DEM_SQL = "dem as (select cast(l_partkey%64 as int) col, cast(l_orderkey%48 as int) row_, round(sum(l_quantity)/count(*),6) z from lineitem group by 1,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: fid, x, y, status, amount."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey fid", "cast((o_orderkey*7919)%360000 as double)/1e3-180e0 x", "cast((o_orderkey*104729)%170000 as double)/1e3-85e0 y", "o_orderstatus status", "o_totalprice amount"
    )


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles, some with a hole: fid, x0, y0, w, h, has_hole, brand."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey fid", "cast((p_partkey*7919)%3000 as double)/1e1-150e0 x0", "cast((p_partkey*104729)%1400 as double)/1e1-70e0 y0",
        "cast(p_size as double)/1e1 w", "cast(1+p_partkey%9 as double)/2e0 h", "case when p_size>=25 then 1 else 0 end has_hole", "p_brand brand",
    )


def parcel_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed rings in vertex form: fid, part, ring, seq, x, y; ring 1 is the hole."""
    p = parcels(spark, sf_dir).withColumn("ring", F.explode(F.when(F.col("has_hole") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    p = p.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(4))))
    near = F.when(F.col("ring") == 0, 0.0).otherwise(0.25)
    far = F.when(F.col("ring") == 0, 1.0).otherwise(0.75)
    return p.select(
        "fid", F.lit(0).alias("part"), "ring", "seq",
        (F.col("x0") + F.col("w") * F.when(F.col("seq").isin(1, 2), far).otherwise(near)).alias("x"),
        (F.col("y0") + F.col("h") * F.when(F.col("seq").isin(2, 3), far).otherwise(near)).alias("y"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per user in vertex form: fid, seq, x, y."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "value", "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) seq")
    return e.selectExpr("user_id fid", "seq", "cast((user_id*7919)%3000 as double)/1e1-150e0+cast(seq as double)/1e2 x", "cast((user_id*104729)%1400 as double)/1e1-70e0+value/1e3 y")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 by 48 grid, one band: col, row_, z; cells may be missing."""
    return table(spark, sf_dir, "lineitem").groupBy(F.expr("cast(l_partkey%64 as int)").alias("col"), F.expr("cast(l_orderkey%48 as int)").alias("row_")).agg(F.expr("round(sum(l_quantity)/count(*),6)").alias("z"))
