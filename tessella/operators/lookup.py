"""Attribute pages, fetches by id, samples, cache budgets, text decoding and other small queries."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import fixtures as fx
from tessella.functions import crs, geom

PAGE = 100


def page_by_fid(layer: DataFrame, page: int, rows: int) -> DataFrame:
    """Features whose fid lies in the page's range; gaps of fids give short pages. The filter reaches the scan."""
    return layer.where((F.col("fid") >= page * rows) & (F.col("fid") < (page + 1) * rows))


def page_by_row(layer: DataFrame, page: int, rows: int, bucket: int = 4096) -> DataFrame:
    """Features by their place in the order of fid."""
    return geom.ordered_index(layer, "fid", F.floor(F.col("fid") / bucket)).where(F.col("idx").between(page * rows, (page + 1) * rows - 1))


def page_count(total: int, rows: int) -> int:
    return max(1, math.ceil(total / rows))


def fetch(layer: DataFrame, fid: int) -> tuple[str, dict | None]:
    """("found", row) or ("not_found", None)."""
    row = layer.where(F.col("fid") == fid).take(1)
    return ("found", row[0].asDict()) if row else ("not_found", None)


def fields(layer: DataFrame) -> DataFrame:
    """One row per column: position, name, type, whether it is text."""
    spark = layer.sparkSession
    return spark.createDataFrame([(k, f.name, f.dataType.simpleString(), f.dataType.simpleString() == "string") for k, f in enumerate(layer.schema)], "position int, name string, type string, is_text boolean")


def attr_page_fid(spark: SparkSession, d: str) -> DataFrame:
    return page_by_fid(fx.sites(spark, d), 3, PAGE)


def attr_page_row(spark: SparkSession, d: str) -> DataFrame:
    return page_by_row(fx.sites(spark, d), 3, PAGE)


def feature_count(spark: SparkSession, d: str) -> DataFrame:
    return fx.sites(spark, d).agg(F.count("*").alias("n"), F.min("fid").alias("first_fid"), F.max("fid").alias("last_fid"))


def field_definitions(spark: SparkSession, d: str) -> DataFrame:
    return fields(fx.sites(spark, d))


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    n = fx.sites(spark, d).groupBy("status").agg(F.count("*").alias("n"))
    return n.select("status", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(PAGE))).cast("long").alias("pages"))


def fetch_fid(spark: SparkSession, d: str) -> DataFrame:
    """A set of fids, with what was found of each."""
    fids = [-1, 0, 1, 7, 32, 99, 1 << 40]
    asked = spark.createDataFrame([(k,) for k in fids], "fid long")
    found = fx.sites(spark, d).where(F.col("fid").isin(fids))  # the scan keeps a row for each fid asked for, so the join's other side is as small
    return asked.join(found, "fid", "left").select("fid", F.when(F.col("x").isNull(), "not_found").otherwise("found").alias("outcome"), "status", "amount")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every max(1, F / 500)-th fid, F the number of features."""
    s = fx.sites(spark, d)
    n = s.count()
    return s.where(F.col("fid") % max(1, n // 500) == 0) if n > 500 else s


def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every F / 200-th feature in the order of fid."""
    s = fx.sites(spark, d)
    n = s.count()
    return geom.ordered_index(s, "fid", F.floor(F.col("fid") / 4096)).where(F.col("idx") % max(1, n // 200) == 0).select("fid", "idx")


def vertex_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Mean vertices of the first 50 tracks times the number of tracks."""
    per = fx.tracks(spark, d).groupBy("fid").agg(F.count("*").alias("n"))
    first = per.orderBy("fid").limit(50).agg(F.avg("n").alias("mean"))
    return per.agg(F.count("*").alias("features")).join(F.broadcast(first)).select(F.floor(F.col("mean") * F.col("features")).cast("long").alias("estimate"))


def lru_keep(entries: DataFrame, budget: int, by: str = "layer", writing: str = "writing") -> DataFrame:
    """Cache entries (layer, name, bytes, last_access, writing) that stay within the budget of their layer, newest first.

    An entry that is being written stays; a budget of 0 keeps all. The running sum is within a layer.
    """
    if budget <= 0:
        return entries
    w = Window.partitionBy(by).orderBy(F.col(writing).desc(), F.col("last_access").desc(), "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("_sum", F.sum("bytes").over(w)).where(F.col(writing) | (F.col("_sum") <= budget)).drop("_sum")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").selectExpr("p_brand layer", "p_partkey name", "cast(p_size * 1000 as bigint) bytes", "(p_partkey * 7919) % 100003 last_access", "p_partkey % 97 = 0 writing")


def lru_budget(spark: SparkSession, d: str) -> DataFrame:
    return lru_keep(_entries(spark, d), 400000).select("layer", "name")


def cache_total(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).groupBy("layer").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("last_access").alias("last_access"))


def cache_touch(spark: SparkSession, d: str) -> DataFrame:
    """An old index met with a scan: the newer last access of each entry stays, entries gone from the scan go."""
    old = _entries(spark, d).where("name % 3 <> 0").selectExpr("name", "last_access + 500 old_access")
    return _entries(spark, d).join(old, "name", "left").select("name", F.greatest("last_access", F.coalesce("old_access", F.lit(0))).alias("last_access"))


def metadata_repair(spark: SparkSession, d: str) -> DataFrame:
    """Layer metadata with missing systems and invalid extents, filled in from the features."""
    s = fx.sites(spark, d)
    real = s.groupBy("status").agg(F.min("x").alias("ax"), F.max("x").alias("bx"), F.count("*").alias("n"))
    meta = s.select("status").distinct().withColumn("epsg", F.when(F.col("status") == "F", 0).otherwise(3857)).withColumn("minx", F.when(F.col("status") == "O", 1.0).otherwise(-1e3)).withColumn("maxx", F.when(F.col("status") == "O", 0.0).otherwise(1e3))
    bad = F.col("minx") > F.col("maxx")
    return meta.join(real, "status").select("status", F.when(F.col("epsg") == 0, 4326).otherwise(F.col("epsg")).alias("epsg"), F.when(bad, F.col("ax")).otherwise(F.col("minx")).alias("minx"), F.when(bad, F.col("bx")).otherwise(F.col("maxx")).alias("maxx"), "n")


def epsg_inference(spark: SparkSession, d: str) -> DataFrame:
    """Systems of made-up WKT, one per nation."""
    k = F.col("n_nationkey") % 6
    wkt = F.when(k == 0, 'GEOGCS["WGS 84"]').when(k == 1, 'PROJCS["WGS 84 / UTM"]').when(k == 2, 'GEOGCS["Xian 1980"]').when(k == 3, 'GEOGCS["Beijing 1954"]').when(k == 4, 'GEOGCS["CGCS2000"]').otherwise('GEOGCS["Other"]')
    return fx.table(spark, d, "nation").select("n_nationkey", crs.infer_epsg(wkt).alias("epsg"))


def _number(v: object, digits: int) -> str:
    return "NULL" if v is None or v != v else f"{float(v):.{digits}g}"


@F.pandas_udf(T.StringType())
def general_number(v: pd.Series) -> pd.Series:
    """Text of a number as ``%.10g`` spells it; null as NULL."""
    return v.map(lambda x: _number(x, 10))


@F.pandas_udf(T.StringType())
def sample_number(v: pd.Series) -> pd.Series:
    """Text of a raster value: whole numbers plain, others as ``%.8g`` spells them."""
    return v.map(lambda x: "NULL" if x is None or x != x else str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else f"{x:.8g}")


_CODECS = {"UTF-8": "utf-8", "GBK": "gbk", "BIG5": "big5", "CP1252": "cp1252", "UTF-16LE": "utf-16-le"}


def decode_text(raw: Column, encoding: str) -> Column:
    """Bytes as text; bytes that aren't valid give the empty string. UTF encodings stay in the engine."""
    name = encoding.upper()
    if name == "UTF-8":
        return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.when(raw.isNotNull(), ""))
    codec = _CODECS[name]

    @F.pandas_udf(T.StringType())
    def run(v: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            try:
                return b.decode(codec)
            except (UnicodeDecodeError, LookupError):
                return ""

        return v.map(one)

    return run(raw)


def decode_names(spark: SparkSession, d: str) -> DataFrame:
    """Customer names written as UTF-8, GBK and UTF-16LE bytes and read again."""
    c = fx.table(spark, d, "customer").select("c_custkey", "c_name", F.encode("c_name", "UTF-8").alias("u8"), F.encode("c_name", "UTF-16LE").alias("u16"))
    return c.select("c_custkey", decode_text(F.col("u8"), "UTF-8").alias("from_utf8"), decode_text(F.col("u8"), "GBK").alias("from_gbk"), decode_text(F.col("u16"), "UTF-16LE").alias("from_utf16"))


def date_text(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day")).agg(F.count("*").alias("n"))


def layer_concat(spark: SparkSession, d: str) -> DataFrame:
    """All layers of a dataset by name, missing columns as nulls."""
    s = fx.sites(spark, d).select("fid", "x", "status").withColumn("layer", F.lit("sites"))
    p = fx.parcels(spark, d).select("fid", F.col("x0").alias("x"), "brand").withColumn("layer", F.lit("parcels"))
    return s.unionByName(p, allowMissingColumns=True).groupBy("layer").agg(F.count("*").alias("n"), F.count("status").alias("n_status"), F.count("brand").alias("n_brand"))


def binned_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and tile of level 3: the batch form of the streaming extension."""
    e = fx.table(spark, d, "events").withColumn("tx", (F.col("user_id") * 7919 % 8).cast("int"))
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "tx").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


QUERIES = {f.__name__: f for f in (
    attr_page_fid, attr_page_row, feature_count, field_definitions, page_counts, fetch_fid, stratified_sample, systematic_sample, vertex_estimate, lru_budget, cache_total, cache_touch,
    metadata_repair, epsg_inference, decode_names, date_text, layer_concat, binned_events,
)}

_ENTRIES = "entries as (select p_brand layer, p_partkey name, cast(p_size*1000 as bigint) bytes, (p_partkey*7919)%100003 last_access, p_partkey%97=0 writing from part)"
ORACLE_SQL = {
    "attr_page_fid": f"with {fx.SITES_SQL} select * from sites where fid>=300 and fid<400",
    "attr_page_row": f"with {fx.SITES_SQL}, r as (select *, row_number() over (order by fid)-1 idx from sites) select * from r where idx between 300 and 399",
    "feature_count": f"with {fx.SITES_SQL} select count(*) n, min(fid) first_fid, max(fid) last_fid from sites",
    "field_definitions": "select * from (values (0,'fid','bigint',false),(1,'x','double',false),(2,'y','double',false),(3,'status','string',true),(4,'amount','double',false)) t(position,name,type,is_text)",
    "page_counts": f"with {fx.SITES_SQL} select status, cast(greatest(1, ceil(count(*)/100e0)) as bigint) pages from sites group by 1",
    "fetch_fid": f"with {fx.SITES_SQL}, a as (select unnest([-1,0,1,7,32,99,1099511627776]) fid) select cast(a.fid as bigint) fid, case when x is null then 'not_found' else 'found' end outcome, status, amount from a left join sites using (fid)",
    "stratified_sample": f"with {fx.SITES_SQL}, n as (select count(*) n from sites) select fid,x,y,status,amount from sites, n where n<=500 or fid % greatest(1, n//500)=0",
    "systematic_sample": f"with {fx.SITES_SQL}, r as (select fid, row_number() over (order by fid)-1 idx, count(*) over () n from sites) select fid, idx from r where idx % greatest(1, n//200)=0",
    "vertex_estimate": f"with {fx.TRACKS_SQL}, p as (select fid, count(*) n from tracks group by 1), f as (select avg(n) m from (select n from p order by fid limit 50)) select cast(floor((select m from f)*count(*)) as bigint) estimate from p",
    "lru_budget": f"with {_ENTRIES}, s as (select *, sum(bytes) over (partition by layer order by writing desc, last_access desc, name rows unbounded preceding) t from entries) select layer, name from s where writing or t<=400000",
    "cache_total": f"with {_ENTRIES} select layer, cast(sum(bytes) as bigint) bytes, count(*) n, max(last_access) last_access from entries group by 1",
    "cache_touch": f"with {_ENTRIES} select name, case when name%3<>0 then last_access+500 else last_access end last_access from entries",
    "metadata_repair": f"""with {fx.SITES_SQL} select status, case when status='F' then 4326 else 3857 end epsg, case when status='O' then min(x) else -1e3 end minx,
     case when status='O' then max(x) else 1e3 end maxx, count(*) n from sites group by 1""",
    "epsg_inference": "select n_nationkey, case n_nationkey%6 when 0 then 4326 when 2 then 4610 when 3 then 4214 when 4 then 4490 else 0 end epsg from nation",
    "decode_names": "select c_custkey, c_name from_utf8, c_name from_gbk, c_name from_utf16 from customer",
    "date_text": "select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as day, count(*) n from orders group by 1",
    "layer_concat": "select 'sites' layer, count(*) n, count(*) n_status, 0 n_brand from orders union all select 'parcels', count(*), 0, count(p_brand) from part",
    "binned_events": "select date_trunc('hour', ts) as hour, cast(user_id*7919%8 as int) tx, count(*) n, round(sum(value),4) as value from events group by 1,2",
}
