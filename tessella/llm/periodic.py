"""Periodic runs of words, found by block matching.

A run is a stretch of words with smallest period q, at least four times q (and ``min_words``) long, that can't be extended
to either side. With B the largest power of two up to q, such a run holds a block of B words that begins at a multiple of B
and comes again q words later, B <= q < 2B. For each scale B an automaton over sequences of word numbers (pyahocorasick) holds
the aligned blocks and searches the document for them; an occurrence at a distance from B to 2B behind its block is a
seed, extended word by word to both sides. Blocks that no run can hold are left out before: in a run each word comes again
within 2B words, all along the block and the next one. Seeds inside a run of a smaller period that divides their distance
can only give that run again and are skipped. So the work in a text follows its repeated parts, times the number of scales.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Defined results: null and empty texts have no words and no runs; texts of any length are
searched whole; of runs with equal exponents the one with the smallest start, then period, counts as greatest; repeated
rows give repeated results; null ids are no number, so nothing is planted in their texts; an empty table gives an
empty result. :func:`detect` keeps all columns but those named like its results, which it replaces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, table, texts_of

EXPONENT = 4  # of runs, at least; the blocks' scales rest on it
FIELDS = ("start", "length", "period")
RUN = f"struct<{','.join(f'{c}:bigint' for c in FIELDS)}>"
RESULTS = ("n_words", "runs", "collapsed")
Replace = Callable[[object, np.ndarray], np.ndarray]


def _numbers(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))


def _until_again(w: np.ndarray) -> np.ndarray:
    """For each word the distance to the next equal one; the text's length where none follows."""
    out = np.full(len(w), len(w), np.int64)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _seeds(w: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(start, distance) of the aligned blocks that come again at a distance from size to 2 * size, by place of the occurrence."""
    numbers: dict[bytes, int] = {}
    own: dict[int, int] = {}
    find = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for s in starts.tolist():
        block = w[s : s + size]
        content = block.tobytes()
        if content not in numbers:
            numbers[content] = len(numbers)
            find.add_word(tuple(block.tolist()), numbers[content])
        own[s] = numbers[content]
    find.make_automaton()
    # Only what lies within reach of a block is searched: neighbouring reaches are one stretch.
    breaks = np.flatnonzero(np.diff(starts) > 2 * size) + 1
    for part in np.split(starts, breaks):
        lo, hi = int(part[0]) + size, min(len(w), int(part[-1]) + 3 * size)
        for end, number in find.iter(tuple(w[lo:hi].tolist())):
            at = lo + end - size + 1
            s = at // size * size - size
            if own.get(s) == number:
                yield s, at - s


def _extended(w: np.ndarray, s: int, d: int, size: int) -> tuple[int, int]:
    """The bounds of the stretch of places i around s with w[i] == w[i + d]."""
    a, b, n, step = s, s + size, len(w) - d, 16
    while b < n:
        m = min(step, n - b)
        differ = np.flatnonzero(w[b : b + m] != w[b + d : b + d + m])
        b += int(differ[0]) if len(differ) else m
        if len(differ):
            break
        step *= 2
    step = 16
    while a > 0:
        m = min(step, a)
        differ = np.flatnonzero(w[a - m : a] != w[a - m + d : a + d])
        a -= m - 1 - int(differ[-1]) if len(differ) else m
        if len(differ):
            break
        step *= 2
    return a, b


def _smallest(w: np.ndarray, a: int, d: int) -> bool:
    """Whether no proper divisor of d is a period of the stretch at a, which has period d."""
    k, f = d, 2
    while k > 1:
        f = f if f * f <= k else k
        if k % f == 0:
            p = d // f
            if np.array_equal(w[a : a + d], w[a + p : a + p + d]):
                return False
            while k % f == 0:
                k //= f
        f += 1
    return True


def runs_of(w: np.ndarray, min_words: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of numbers, by start, then period."""
    n, size, found = len(w), 1, []
    if n < max(min_words, EXPONENT):
        return found
    again = _until_again(w)  # at each scale the largest distance in each aligned block
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the run that goes furthest from each word
    while EXPONENT * size <= n:
        near = again < 2 * size
        starts = np.flatnonzero(near[:-1] & near[1:]) * size
        done: dict[int, int] = {}
        for s, d in _seeds(w, starts, size) if len(starts) else ():
            if s < done.get(d, 0) or reach[s] >= s + d + size and d % period[s] == 0:
                continue
            a, b = _extended(w, s, d, size)
            done[d] = b
            length = b - a + d
            if length >= max(min_words, EXPONENT * d) and _smallest(w, a, d):
                found.append((a, length, d))
                further = reach[a : a + length] < a + length
                reach[a : a + length][further] = a + length
                period[a : a + length][further] = d
        half = len(again) // 2 * 2
        again = np.maximum(again[0:half:2], again[1:half:2])
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is cut to its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def detect(docs: DataFrame, min_words: int = 6, key: str = "doc_id", text: str = "text", replace: Replace | None = None) -> DataFrame:
    """``docs`` with n_words, runs and ``collapsed``, the text with each run cut to its first period, words joined by a space.

    ``replace`` may give other places (into the words) to search, from a row's key and the number of words.
    """
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in FIELDS]))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("runs", run_type), T.StructField("collapsed", T.StringType())])
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in FIELDS]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            counts, runs, texts = [], [], []
            for k, t in zip(rb.column(key).to_pylist(), texts_of(rb, text), strict=True):
                words = t.encode().split()
                if replace and words:
                    words = [words[i] for i in replace(k, np.arange(len(words))).tolist()]
                got = runs_of(_numbers(words), min_words)
                counts.append(len(words))
                runs.append([dict(zip(FIELDS, r, strict=True)) for r in got])
                if got:
                    words = [words[i] for i in np.flatnonzero(_kept(len(words), got)).tolist()]
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(runs, arrow), pa.array(texts, pa.string())], [*kept, *RESULTS])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(lambda batches: search(pieces(batches, text)), schema)


def planted(key: object, places: np.ndarray) -> np.ndarray:
    """For keys whose crc32 is divisible by 10, the words from some place on are those of the first period there, again and again."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10:
        return places
    n, g = len(places), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([places[:a], a + np.arange(n - a) % p])


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), replace=planted)
    # Runs come by start and period, so of equal exponents the first stays.
    higher = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    top = F.reduce("runs", F.lit(None).cast(RUN), lambda best, r: F.when(higher(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    milli = F.expr("1000 * top.length div top.period").alias("exponent_milli")
    return best.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli, "runs_sha256", "collapsed_sha256")


QUERIES = {"op13_periodic": op13_periodic}
ORACLE_SQL: dict[str, str] = {}
