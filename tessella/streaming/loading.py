"""Loads in chunks that can be stopped: a time budget, cancelling, and a second read where the first one gave no geometry.

A chunk is a folder that its write commits as a whole. A run tags its jobs; when its time is up, or someone cancels it, the engine
ends the tagged jobs, the chunk under way leaves nothing that counts, and those before it stay. The next run goes on behind them.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.shared import exists, scratch

CHUNK_FEATURES = 20_000
MOST_WRITES = 16


@dataclass
class Cancel:
    """Ends a run from another thread, between chunks or in the middle of one."""

    tag: str = field(default_factory=lambda: f"tessella-{uuid.uuid4().hex}")
    asked: threading.Event = field(default_factory=threading.Event)

    def __call__(self, spark: SparkSession) -> None:
        self.asked.set()
        spark.sparkContext.cancelJobsWithTag(self.tag)


@dataclass(frozen=True)
class Progress:
    done: int
    total: int

    @property
    def finished(self) -> bool:
        return self.done == self.total


def _chunk(path: str, k: int) -> str:
    return f"{path}/chunk={k}"


def run_chunks(spark: SparkSession, chunks: Sequence[Callable[[], DataFrame]], path: str, budget_s: float | None = None, cancel: Cancel | None = None) -> Progress:
    """Write each chunk that isn't there yet, in order, until the time is up or the run is cancelled."""
    sc, cancel = spark.sparkContext, cancel or Cancel()
    timer = threading.Timer(budget_s, cancel, [spark]) if budget_s is not None else None
    done = 0
    sc.addJobTag(cancel.tag)
    if timer:
        timer.daemon = True
        timer.start()
    try:
        for k, chunk in enumerate(chunks):
            if not exists(spark, f"{_chunk(path, k)}/_SUCCESS"):
                if cancel.asked.is_set():
                    break
                try:
                    chunk().write.mode("overwrite").parquet(_chunk(path, k))
                except Exception:
                    if cancel.asked.is_set():  # the chunk was ended, not broken
                        break
                    raise
            done += 1
    finally:
        if timer:
            timer.cancel()
        sc.removeJobTag(cancel.tag)
    return Progress(done, len(chunks))


def loaded(spark: SparkSession, path: str, progress: Progress) -> DataFrame | None:
    """What is there so far: the complete chunks only."""
    return spark.read.option("basePath", path).parquet(*(_chunk(path, k) for k in range(progress.done))) if progress.done else None


def fid_chunks(layer: DataFrame, features: int = CHUNK_FEATURES) -> list[Callable[[], DataFrame]]:
    """A layer by ranges of its fids; each range is pushed to the scan."""
    low, high = layer.agg(F.min("fid"), F.max("fid")).first()
    if low is None:
        return []
    starts = range(low, high + 1, features)
    return [lambda a=a: layer.where((F.col("fid") >= a) & (F.col("fid") < a + features)) for a in starts]


def packed_chunks(layer: DataFrame, features: int, most: int = MOST_WRITES) -> list[Callable[[], DataFrame]]:
    """A layer by ranges of its fids, with ``part``, the number of each row's chunk of ``features`` fids.

    A range holds a whole number of chunks, so many that there are at most ``most`` ranges: a load of any size takes as many scans and writes at most.
    """
    low, high = layer.agg(F.min("fid"), F.max("fid")).first()
    if low is None:
        return []
    wide = features * max(1, -(-(high - low + 1) // (features * most)))
    rows = layer.withColumn("part", F.floor((F.col("fid") - low) / features).cast("int"))
    return [lambda a=a: rows.where((F.col("fid") >= a) & (F.col("fid") < a + wide)) for a in range(low, high + 1, wide)]


def budgeted_load(spark: SparkSession, d: str) -> DataFrame:
    """The sites loaded in chunks of 2,000 fids in two sittings, several chunks a write; the first sitting is cancelled when its second write begins."""
    path = f"{scratch(spark, 'load')}/sites"
    chunks = packed_chunks(fx.sites(spark, d), 2000)
    stop = Cancel()
    first = [chunks[0], lambda: (stop.asked.set(), chunks[1]())[1], *chunks[2:]] if len(chunks) > 1 else chunks
    run_chunks(spark, first, path, cancel=stop)
    rest = run_chunks(spark, chunks, path)
    return loaded(spark, path, rest).groupBy(F.col("part").alias("chunk")).agg(F.count("*").alias("n"), F.min("fid").alias("first_fid"), F.round(F.sum("amount"), 2).alias("amount"))


def load_checked(layer: DataFrame, drawn: Column, path: str, again: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """Write a layer, counting features and drawable ones on the way; where features were counted and none can be drawn, write ``again`` instead.

    The counts come with the write itself, so no pass is spent on them. Returns the layer as written, and whether it was read again.
    """
    seen = Observation()
    layer.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(drawn.cast("long")).alias("drawn")).write.mode("overwrite").parquet(path)
    reread = seen.get["n"] > 0 and not seen.get["drawn"]
    if reread:
        again().write.mode("overwrite").parquet(path)
    return layer.sparkSession.read.parquet(path), reread


def fallback_load(spark: SparkSession, d: str) -> DataFrame:
    """Three layers of sites as text, read as pairs of numbers first: one holds POINT texts and is read again as such."""
    out = None
    for status in ("F", "O", "P"):
        sites = fx.sites(spark, d).where(F.col("status") == status)
        pair = F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"))
        text = sites.select("fid", (F.concat(F.lit("POINT ("), pair, F.lit(")")) if status == "O" else pair).alias("text"))

        def parsed(pattern: str, text: DataFrame = text) -> DataFrame:
            number = lambda k: F.regexp_extract("text", pattern, k).try_cast("double")
            return text.select("fid", number(1).alias("x"), number(2).alias("y"))

        plain, point = r"^([-\d.E]+) ([-\d.E]+)$", r"^POINT \(([-\d.E]+) ([-\d.E]+)\)$"
        got, reread = load_checked(parsed(plain), F.col("x").isNotNull(), f"{scratch(spark, 'layer')}/data", lambda parsed=parsed: parsed(point))
        row = got.agg(F.count("*").alias("n"), F.count("x").alias("n_drawn"), F.round(F.sum("x"), 3).alias("sum_x")).select(F.lit(status).alias("layer"), "n", "n_drawn", "sum_x", F.lit(reread).alias("reread"))
        out = row if out is None else out.union(row)
    return out


QUERIES = {f.__name__: f for f in (budgeted_load, fallback_load)}
ORACLE_SQL = {
    "budgeted_load": f"with {fx.SITES_SQL}, m as (select min(fid) lo from sites) select cast((fid-lo)//2000 as int) chunk, count(*) n, min(fid) first_fid, round(sum(amount),2) amount from sites, m group by 1",
    "fallback_load": f"with {fx.SITES_SQL} select status as layer, count(*) n, count(x) n_drawn, round(sum(x),3) sum_x, status='O' reread from sites group by 1",
}
