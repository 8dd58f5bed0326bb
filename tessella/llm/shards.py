"""Two-pass external shuffle of records into shards.

The first pass scatters records into buckets that fit a task's memory, by a seeded hash of id and text; the second shuffles
each bucket by Fisher-Yates and writes it. The buckets, one after another, are one random order of all records, which is
cut into shards whose counts are at most one apart. Counts of fine hash cells, taken in one scan before, give the number of
buckets and the place where each begins, so no bucket waits for another.

Defined results: the order depends on the seed and on ids and texts, not on files, partitions or machines; rows
equal in id and text are told apart by nothing else and may swap. Null texts have no bytes; null ids and texts of
any length are dealt like others. Where repeated rows make a bucket larger than a task should hold, its rows are dealt
once more by their place in the table. An empty table gives no shards; with fewer rows than shards the last
shards stay empty. Columns of the table named ``shard`` or ``slot`` are replaced, all others are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, scratch, table

_CELL_BITS = 24  # finest scatter that is counted
_FRAME = 16  # bytes of a record beside its text


@dataclass(frozen=True)
class Deal:
    """``bucket_bytes`` bounds what a task of the second pass holds at a time; single records may be larger."""

    shards: int = 40
    seed: int = 7
    bucket_bytes: int = 32 << 20
    buckets_per_task: int = 4  # at least, so that tasks even out


def record_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + _FRAME).cast("long")


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A random order of 0 to n-1: each place, from the last, swaps with one at or before it."""
    order = np.arange(n)
    if n > 1:
        draws = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 1, -1))
        places = order.tolist()
        for i, j in zip(range(n - 1, 0, -1), draws.tolist(), strict=True):
            places[i], places[j] = places[j], places[i]
        order = np.array(places)
    return order


def _starts(counts: DataFrame) -> DataFrame:
    """bucket, part and the number of rows in all buckets before. Sums go over 1,024 buckets, then over those sums."""
    c = counts.withColumn("_block", F.shiftright("_bucket", 10))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = c.groupBy("_block").agg(F.sum("_rows").alias("_sum"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(before.orderBy("_block")), F.lit(0)).alias("_blocks"))
    own = F.coalesce(F.sum("_rows").over(before.partitionBy("_block").orderBy("_bucket", "_part")), F.lit(0))
    return c.withColumn("_own", own).join(blocks, "_block").select("_bucket", "_part", (F.col("_blocks") + F.col("_own")).cast("long").alias("_start"))


def _dealt_again(rows: DataFrame, heavy: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``_part``: buckets in ``heavy`` are dealt over its ``_parts`` by place, and written so that all later reads agree."""
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    split = rows.join(heavy, "_bucket").withColumn("_part", F.pmod(place, F.col("_parts"))).drop("_parts")
    return rows.join(heavy, "_bucket", "left_anti").withColumn("_part", F.lit(0).cast("long")).unionByName(materialise(split.select(*rows.columns, "_part"), "shards-again"))


def shuffled(docs: DataFrame, deal: Deal = Deal(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, rows of a bucket in the order of their slots."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    out = T.StructType([*(docs.schema[c] for c in kept), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    hashed = docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn("_hash", F.xxhash64(F.lit(deal.seed), F.col(key).cast("string"), F.col(text)))
    hashed = hashed.withColumn("_cell", F.shiftrightunsigned("_hash", 64 - _CELL_BITS))

    cells = materialise(hashed.groupBy("_cell").agg(F.count("*").alias("_rows"), F.sum(record_size(text)).alias("_bytes")), "shards-cells")
    total, size = cells.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    least = deal.buckets_per_task * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(_CELL_BITS, max(0, math.ceil(math.log2(max(1, least, size / deal.bucket_bytes)))))
    bucket = F.shiftright("_cell", _CELL_BITS - bits).alias("_bucket")

    rows = hashed.select(*(F.col(f"`{c}`") for c in kept), "_hash", bucket)
    buckets = cells.groupBy(bucket).agg(F.sum("_rows").alias("_rows"), F.sum("_bytes").alias("_bytes"))
    heavy = buckets.where((F.col("_bytes") > 2 * deal.bucket_bytes) & (F.col("_rows") > 1)).select("_bucket", F.ceil(F.col("_bytes") / deal.bucket_bytes).alias("_parts"))
    if heavy.isEmpty():
        rows = rows.withColumn("_part", F.lit(0).cast("long"))
        counts = buckets.select("_bucket", F.lit(0).cast("long").alias("_part"), "_rows")
    else:
        rows = _dealt_again(rows, heavy, deal.seed)
        counts = rows.groupBy("_bucket", "_part").agg(F.count("*").alias("_rows"))
    whole, rest = divmod(total, deal.shards)

    def shuffle(group: tuple, t: pa.Table) -> pa.Table:
        bucket, part, start = (int(x.as_py()) for x in group)
        # First an order that doesn't depend on how rows came in.
        t = t.take(pa.array(np.argsort(t.column("_hash").to_numpy(), kind="stable")))
        t = t.take(pa.array(fisher_yates(t.num_rows, [deal.seed, bucket, part])))
        place = start + np.arange(t.num_rows, dtype=np.int64)
        long = rest * (whole + 1)  # the first shards have one row more
        shard = np.where(place < long, place // (whole + 1), rest + (place - long) // max(1, whole))
        slot = place - (shard * whole + np.minimum(shard, rest))
        return pa.Table.from_arrays([*(t.column(c) for c in kept), pa.array(shard.astype(np.int32)), pa.array(slot)], [*kept, "shard", "slot"])

    dealt = rows.join(_starts(counts), ["_bucket", "_part"])
    return dealt.groupBy("_bucket", "_part", "_start").applyInArrow(shuffle, out)


def write_shards(docs: DataFrame, path: str, deal: Deal = Deal(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards below ``path``, a folder each, rows of a file in the order of their slots; returns them as read back."""
    dealt = shuffled(docs, deal, key, text)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(dealt.schema).parquet(path)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "shards"))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return shards.select("doc_id", record_size().alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op11_shards": op11_shards}
ORACLE_SQL: dict[str, str] = {}
