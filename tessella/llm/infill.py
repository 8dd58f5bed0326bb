"""Fill-in-middle transformation by lookaround splitting.

A unit grammar says which characters end a unit and which may begin the next; it is translated to a regular expression that
matches the empty place between the two, so a split there keeps every character. Two seeded cuts between units give prefix,
middle and suffix, which are written with markers, the suffix before (psm) or the prefix after it (spm).

Defined results: null texts count as empty; an empty text has no units and stays plain, as do texts that hold a marker and
those that the rate leaves out; null ids hash like an empty id; texts of any length are cut whole; repeated rows give repeated
results; an empty table gives an empty result. Columns of the table named like a result are replaced, all others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Units:
    """A unit ends behind ``end`` where ``begin`` follows; both are regular expressions of a fixed number of characters."""

    end: str
    begin: str = r"[\s\S]"

    def boundary(self) -> str:
        return f"(?<={self.end})(?={self.begin})"


LINES = Units(r"\n")
WORDS = Units(r"\s", r"\S")  # a word and the space behind it
SENTENCES = Units(r"[.!?]\s", r"\S")
PARAGRAPHS = Units(r"\n\n", r"[^\n]")


def split_units(text: Column, units: Units) -> Column:
    """The units of a text; joined they are the text again. The empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, units.boundary(), -1))


def _joined(units: str, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(units, start, count), "")


def transform(docs: DataFrame, units: Units = LINES, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n (units), form (plain, psm, spm), prefix_chars and middle_chars (null if plain), and output."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    held = F.coalesce(F.col(text), F.lit(""))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | held.contains(m)
    cut = docs.select(*kept, digest.alias("_digest"), (marked | (held == "")).alias("_as_is"), split_units(held, units).alias("_units"))
    h1, h2, h3, h4 = (F.conv(F.substring("_digest", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4))
    ways = F.size("_units") + F.lit(1)
    form = F.when(F.col("_as_is") | (h3 % 100 >= fim_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    dealt = cut.select(*kept, "_units", F.size("_units").cast("long").alias("n"), form.alias("form"), F.least(h1 % ways, h2 % ways).cast("int").alias("_a"), F.greatest(h1 % ways, h2 % ways).cast("int").alias("_b"))
    parts = dealt.select(
        *kept, "n", "form", _joined("_units", F.lit(1), F.col("_a")).alias("_prefix"), _joined("_units", F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("_middle"),
        _joined("_units", F.col("_b") + 1, F.size("_units") - F.col("_b")).alias("_suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "_prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "_middle")
    spm = F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "_prefix", F.lit(MIDDLE), "_middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.concat("_prefix", "_middle", "_suffix"))
    chars = lambda c: F.when(F.col("form") != "plain", F.char_length(c).cast("long"))
    return parts.select(*kept, "n", "form", chars("_prefix").alias("prefix_chars"), chars("_middle").alias("middle_chars"), output.alias("output"))


def restore(df: DataFrame, into: str = "restored") -> DataFrame:
    """``df`` with the text rebuilt from ``output`` and ``form`` alone."""
    pieces = F.when(F.col("form") != "plain", F.split("output", "|".join((PREFIX, SUFFIX, MIDDLE)), -1))
    split = df.withColumn("_pieces", pieces)
    at = lambda k: F.col("_pieces")[k]
    text = F.when(F.col("form") == "psm", F.concat(at(1), at(3), at(2))).when(F.col("form") == "spm", F.concat(at(2), at(3), at(1))).otherwise(F.col("output"))
    return split.withColumn(into, text).drop("_pieces")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


QUERIES = {"op12_infill": op12_infill}
ORACLE_SQL = {
    "op12_infill": r"""with d as (select doc_id, coalesce(text,'') t, sha256('7:'||coalesce(cast(doc_id as varchar),'')) s from documents),
     u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') u, cast('0x'||s[1:8] as bigint) h1, cast('0x'||s[9:16] as bigint) h2, cast('0x'||s[25:32] as bigint) h4 from d),
     c as (select *, len(u) n, least(h1%(len(u)+1), h2%(len(u)+1)) a, greatest(h1%(len(u)+1), h2%(len(u)+1)) b,
      case when t='' or contains(t,'<P>') or contains(t,'<S>') or contains(t,'<M>') then 'plain' when h4%100<50 then 'spm' else 'psm' end form from u),
     p as (select *, array_to_string(u[1:a],'') pre, array_to_string(u[a+1:b],'') mid, array_to_string(u[b+1:n],'') suf from c)
     select doc_id, cast(n as bigint) n, form, case when form<>'plain' then length(pre) end prefix_chars, case when form<>'plain' then length(mid) end middle_chars,
      sha256(case form when 'plain' then t when 'psm' then '<P>'||pre||'<S>'||suf||'<M>'||mid else '<S>'||suf||'<P>'||pre||'<M>'||mid end) output_sha256, sha256(t) restored_sha256 from p""",
}
