"""Places of pattern matches as arrays of spans, and texts rebuilt around spans; DataFrame functions only.

Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SPANS = "array<struct<start:int,kind:int,end:int>>"
NO_RAW = "array<struct<start:int,kind:int,end:int,raw:string>>"
CHUNK = 256  # items that are folded into one array
BLOCK = 1024  # code points that are cut from a text at a time


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once a row, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def scanned(items: Column, none: Column, step) -> Column:
    """What ``step(at, item)``, a pair of the next ``at`` (from 0) and an array, gives item by item, as one array.

    Chunks are folded each into an array of its own, so the cost of appending doesn't grow with the number of items.
    """

    def inner(acc: Column, z: Column) -> Column:
        at, out = step(acc["at"], z)
        return F.struct(at.alias("at"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), inner)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def whole(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK)))
        folded = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.slice(F.array(none), 1, 0).alias("out")), outer, lambda acc: acc["out"])
        return F.when(F.size(x) > 0, F.flatten(folded)).otherwise(none)

    return let(items, whole)


def places(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, raw: bool = False) -> Column:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters or more: structs of start, kind, end and, if ``raw``, the match.

    The text between matches and the matches themselves give the offsets. Only texts with a match are cut.
    """
    none = F.array().cast(NO_RAW if raw else NO_SPANS)
    steps = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part")
    )

    def step(at: Column, z: Column) -> tuple[Column, Column]:
        start = at + F.length(z["gap"])
        end = start + F.coalesce(F.length(z["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *([z["hit"].alias("raw")] if raw else []))
        return end, F.when(z["hit"].isNotNull() & (F.length(z["part"]) >= least), F.array(span)).otherwise(none)

    return F.when(text.rlike(pattern), scanned(steps, none, step)).otherwise(none)


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined; ``kinds`` names them by number."""
    names = F.array(*map(F.lit, kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def replaced(text: Column, spans: Column, by, kind: str = NO_SPANS) -> Column:
    """The text with each of the sorted spans, an array of type ``kind``, replaced by ``by(span)``; a span that overlaps an earlier one only extends the gap."""
    none = F.array().cast(f"array<struct<at:int,span:{kind[6:-1]}>>")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(F.struct(at.alias("at"), s.alias("span")))).otherwise(none)

    def rebuilt(blocks: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first = F.floor(a / BLOCK).cast("int")
            last = F.floor((b - 1) / BLOCK).cast("int")
            return F.when(b > a, F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), a % BLOCK + 1, b - a)).otherwise("")

        pieces = F.transform(scanned(spans, none, step), lambda g: F.concat(cut(g["at"], g["span"]["start"]), by(g["span"])))
        return F.concat(F.array_join(pieces, ""), cut(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), rebuilt)).otherwise(text)
