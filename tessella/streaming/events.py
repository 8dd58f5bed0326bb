"""Structured Streaming: progressive loads in micro-batches, and an extension with event time over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.shared import shared_dir


def chunks(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A layer's files as a stream, so many files a batch; back-pressure is the engine's own."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def upsert_buckets(batch: DataFrame, batch_id: int, path: str) -> None:
    """Each batch writes its own bucket counts under its number, so a repeated batch replaces itself; readers add them up."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def load_progressively(spark: SparkSession, path: str, schema, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Counts by keys of all files of a source, merged batch by batch."""
    counted = lambda b, k: upsert_buckets(b.groupBy(*keys).agg(F.count("*").alias("n")), k, out)
    q = chunks(spark, path, schema).writeStream.foreachBatch(counted).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy(*keys).agg(F.sum("n").alias("n"))


def binned(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums by hour and tile column; events later than the watermark are dropped."""
    e = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late).withColumn("tx", (F.col("user_id") * 7919 % 8).cast("int"))
    return e.groupBy(F.window("time", "1 hour").alias("w"), "tx").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def stream_binned_events(spark: SparkSession, d: str) -> DataFrame:
    """The stream drained once in complete mode: the same rows as the batch query."""
    import os

    schema = fx.table(spark, d, "events").schema
    name = f"binned_{os.urandom(6).hex()}"
    source = spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/events.parque[t]")
    place = shared_dir(spark)
    q = binned(source).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{place}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "tx", "n", "value")


QUERIES = {"stream_binned_events": stream_binned_events}
ORACLE_SQL = {"stream_binned_events": "select date_trunc('hour', ts) as hour, cast(user_id*7919%8 as int) tx, count(*) n, round(sum(value),4) as value from events group by 1,2"}
