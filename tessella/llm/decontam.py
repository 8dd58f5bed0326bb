"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. Every window of ten
consecutive words of a benchmark item (the whole item, if it has fewer) is a pattern of one automaton over
words joined by single spaces, with a space at either end, so a match never begins or ends inside a word. A
document is normalised the same way and scanned once; matches are mapped back to its words and characters.

The automaton goes to every worker, so its size is checked: up to ``max_pattern_bytes`` of patterns form one
automaton; a larger benchmark is split into blocks of that size, each scanned over all documents in turn, and
what the blocks find is united per row.

Defined results: null or empty texts have no words and are clean; items without words never match; items that
share a window, or repeat each other, all count by their id; items without an id hit words like any other, but stand in no list of
items and aren't counted there; texts of any length are scanned whole; repeated documents give repeated rows; with an empty
benchmark nothing is hit, and an empty table of documents gives an empty result; extra columns are kept by :func:`scan`, but for
those named like its own, which are replaced, and all columns by :func:`decontaminate`.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pieces, table, texts_of

WINDOW = 10
MAX_PATTERN_BYTES = 4 << 20

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD_BYTE = np.array([_TABLE[b] != 0x20 for b in range(256)])


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


class Automaton:
    """All windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW) -> None:
        owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            for w in windows(words_of(text), size):
                own = owners[w]
                if item is not None:
                    own.add(item)
        self.machine = ahocorasick.Automaton()
        for w, own in owners.items():
            # latin-1 keeps one character a byte, so offsets in the scanned string are byte offsets
            self.machine.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, len(w) + 2, tuple(own)))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words; hit word ranges [first, end), merged and sorted; items found."""
        words = words_of(text)
        if not words or self.empty:
            return len(words), [], set()
        flat = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.machine.iter(flat))
        if not found:
            return len(words), [], set()
        spaces = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 0x20)
        ends = np.searchsorted(spaces, [e for e, _ in found])
        ranges = sorted((int(e) - n, int(e)) for e, (_, (n, _, _)) in zip(ends, found, strict=True))
        merged = [list(ranges[0])]
        for a, b in ranges[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return len(words), [(a, b) for a, b in merged], {i for _, (_, _, own) in found for i in own}

    def hits(self, text: str) -> bool:
        """Whether any window occurs."""
        words = [] if self.empty else words_of(text)
        return bool(words) and next(self.machine.iter(f" {b' '.join(words).decode('latin-1')} "), None) is not None


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The characters of the original text, end exclusive, that ranges of words take."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.r_[False, _WORD_BYTE[raw], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return [(int(chars[edges[2 * a]]), int(chars[edges[2 * b - 1]])) for a, b in ranges]


def _blocks(benchmark: DataFrame, max_pattern_bytes: int) -> list[list[tuple[str | None, str]]]:
    """The benchmark, a query set, in blocks whose patterns stay below the bound.

    Each item of n bytes makes at most about 11 n bytes of patterns. Items come one partition at a time.
    """
    blocks: list[list[tuple[str | None, str]]] = [[]]
    held = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t")).toLocalIterator():
        cost = (WINDOW + 1) * len(row.t.encode())
        if blocks[-1] and held + cost > max_pattern_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append((row.i, row.t))
        held += cost
    return blocks


_LISTS = [("ranges", "array<struct<first:int,end:int>>"), ("spans", "array<struct<start:int,end:int>>"), ("items", "array<string>")]
_RESULT = ", ".join(["n_words long", *(f"{n} {t}" for n, t in _LISTS)])


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """doc_id, text and what was found: n_words, merged word ranges, character spans in the original, items.

    ``ranges`` are half-open. Rows of ``docs`` map to rows of the result one to one.
    """
    names = ["n_words", "ranges", "spans", "items"]
    kept = [c for c in docs.columns if c not in names]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), _RESULT])
    out = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), *(F.lit(None).cast(t).alias(n) for n, t in _LISTS))
    blocks = _blocks(benchmark, max_pattern_bytes)
    for k, block in enumerate(blocks):
        if k:
            out = materialise(out, "decontam-block")
        out = out.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast(block), size, kept), schema)
    return out


@lru_cache(maxsize=1)
def _machine(key: str, shared: Broadcast, size: int) -> Automaton:
    """One automaton a Python worker, kept between its tasks."""
    return Automaton(shared.value, size)


def _scanner(shared: Broadcast, size: int, kept: list[str]):
    key = uuid.uuid4().hex
    found = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    places = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(key, shared, size)
        for rb in pieces(batches, "text"):
            columns: list[list] = [[], [], [], []]
            before = zip(rb.column("ranges").to_pylist(), rb.column("items").to_pylist(), strict=True)
            for text, (ranges, items) in zip(texts_of(rb, "text"), before, strict=True):
                n, hits, own = machine.scan(text)
                hits = _merge([*hits, *((r["first"], r["end"]) for r in ranges or [])])
                columns[0].append(n)
                columns[1].append([{"first": a, "end": b} for a, b in hits])
                columns[2].append([{"start": a, "end": b} for a, b in char_spans(text, hits)] if hits else [])
                columns[3].append(sorted(own.union(items or [])))
            new = [pa.array(x, t) for x, t in zip(columns, [pa.int64(), found, places, pa.list_(pa.string())], strict=True)]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in kept), *new], [*kept, "n_words", "ranges", "spans", "items"])

    return run


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["first"]).cast("long"))
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """The documents without any benchmark window, columns as they were; each block only sees what the blocks before it left."""
    for k, block in enumerate(_blocks(benchmark, max_pattern_bytes)):
        if k:
            docs = materialise(docs, "decontam-block")
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), size), docs.schema)
    return docs


def _clean(shared: Broadcast, size: int):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(key, shared, size)
        for rb in pieces(batches, "text"):
            yield rb.filter(pa.array([not machine.hits(t) for t in texts_of(rb, "text")], pa.bool_()))

    return run


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLE_SQL = {
    "op10_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
bw as (select distinct item, least(len(ws), 10) n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') win from (select item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) i from b where len(ws) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') win from (select doc_id, ws, n, unnest(range(1, greatest(0, len(ws) - n + 1) + 1)) i from d, sizes)),
hits as (select doc_id, dw.i, dw.n, item from dw join bw using (n, win)),
items as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) ids from hits group by 1),
spots as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by 1)
select d.doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join items using (doc_id) left join spots using (doc_id)
"""
}
