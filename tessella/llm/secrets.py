"""Secret scan with multipart credential linking; DataFrame functions only.

Three kinds of span are always reported: assignments of a secret (``assign``), access identifiers (``access``) and long
hexadecimal runs (``hex``). Three kinds are weak: account names (``account``), mixed tokens (``mixed``) and endpoints
(``endpoint``). A weak span is reported only if a complementary part, which doesn't overlap it, begins within ``reach`` code
points of it: a secret (assign, hex, mixed) for an account or an endpoint, an identifier or endpoint (access, account, endpoint)
for a token. What two weak spans report of each other is mutual, so neither needs a strong one.

One string is one part: a mixed token that overlaps another part is none. Nor is a token of low disorder: it needs ``MIXES``
places where letters and digits, or small and then two capital letters, meet. Words, user names, paths and titles in links
have few of them, drawn tokens many.

Parts are joined as intervals, row by row: of the complementary parts that end before a weak one the one of the latest start is
the nearest, and of those that begin after it the one of the earliest; both are running extremes over the row's parts in their
order, so cost follows the parts of a text and never its pairs. A gate pattern keeps texts without any part out of all of this.

Defined results: null counts as empty; empty texts have no spans; texts of any length are searched whole, by patterns whose
cost is linear in it; overlapping spans of different kinds are all reported, but for mixed tokens; equal distances both count;
repeated rows give repeated results, since rows are told apart by a number of their own; an empty table gives an empty
result; extra columns are kept by :func:`redact` and ignored by :func:`report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .spans import NO_SPANS, listed, places, replaced

# The contract's three patterns. Runs of 32 or more take the place of a length check where it is the same.
_SECRET_NAMES = "password|passwd|secret|token|api_?key"
_ACCOUNT_NAMES = "user|username|login|account|client_id|access_id"
_IS = r"""["']?\x20*[:=]"""
ASSIGN = rf"""((?i:{_SECRET_NAMES})){_IS}\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
ACCOUNT = rf"""(?i:\b(?:{_ACCOUNT_NAMES})){_IS}\x20*["']?[A-Za-z0-9@_.-]{{3,}}"""
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"(?:https?|ftp|jdbc|postgres|mysql|redis|amqp|s3)://[^\x00-\x20\"'<>]+"
# Wider than any part that can be reported; made of the same names, so that it can't be narrower. A mixed token alone never is.
GATE = rf"(?i:{_SECRET_NAMES}|{_ACCOUNT_NAMES}){_IS}|AKIA|(?<![0-9a-f])[0-9a-f]{{32}}|://"

KINDS = ["assign", "access", "hex", "account", "mixed", "endpoint"]
SECRETS, IDENTIFIERS = [0, 2, 4], [1, 3, 5]
REACH = 240
MIXES = 4
_MIX = r"[a-z](?=[A-Z](?![a-z]))|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"
MARK = "[SECRET]"


def _tokens(text: Column) -> Column:
    """Mixed tokens of some disorder."""

    mixed = F.filter(places(text, MIXED, 4, raw=True), lambda s: F.size(F.regexp_extract_all(s["raw"], F.lit(_MIX), F.lit(0))) >= MIXES)
    return F.transform(mixed, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _linked(hit: DataFrame, reach: int) -> DataFrame:
    """row and the weak spans to report, for rows with base and weak spans."""
    parts = hit.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("s"))
    # A token that overlaps an earlier part, or one that begins inside it, is no part: the latest end before and the next start tell.
    order = Window.partitionBy("row").orderBy("s.start", F.col("s.kind") == 4, "s.end")
    ends = F.max(F.when(F.col("s.kind") != 4, F.col("s.end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("row").orderBy(F.desc("s.start"), F.desc(F.col("s.kind") == 4), F.desc("s.end"))
    starts = F.min(F.when(F.col("s.kind") != 4, F.col("s.start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    alone = (F.coalesce(ends, F.lit(0)) <= F.col("s.start")) & (F.coalesce(starts, F.col("s.end")) >= F.col("s.end"))
    parts = parts.select("row", "s", alone.alias("alone")).where((F.col("s.kind") != 4) | F.col("alone")).select("row", "s", F.col("s.kind").isin(SECRETS).alias("secret"))
    asks = parts.where(F.col("s.kind") >= 3).select("row", (~F.col("secret")).alias("secret"), "s", F.lit(1).alias("asks"))
    events = parts.select("row", "secret", "s", F.lit(0).alias("asks")).union(asks)
    own = F.when(F.col("asks") == 0, F.col("s.start"))
    # Parts that end where the weak one begins, or before; those that begin where it ends, or after.
    before = Window.partitionBy("row", "secret").orderBy(F.when(F.col("asks") == 0, F.col("s.end")).otherwise(F.col("s.start")), "asks").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row", "secret").orderBy(F.desc(F.when(F.col("asks") == 0, F.col("s.start")).otherwise(F.col("s.end"))), "asks").rowsBetween(Window.unboundedPreceding, 0)
    near = events.select("row", "s", "asks", F.max(own).over(before).alias("last"), F.min(own).over(after).alias("next")).where("asks = 1")
    near = near.where((F.col("s.start") - F.col("last") <= reach) | (F.col("next") - F.col("s.start") <= reach))
    return near.groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("linked"))


def find(docs: DataFrame, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """The documents that may hold parts, with __base and __spans (all that is reported), and those that surely hold none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = docs.columns
    gated = materialise(docs.where(text.rlike(GATE)).withColumn("__row", F.monotonically_increasing_id()), "secrets-gated")
    # An assignment's keyword is group 1 and its value group 2.
    base = F.array_sort(F.concat(places(F.col("text"), ASSIGN, 0, 2, 8), places(F.col("text"), ACCESS, 1, 0, 16), places(F.col("text"), HEX, 2)))
    weak = F.array_sort(F.concat(places(F.col("text"), ACCOUNT, 3), _tokens(F.col("text")), places(F.col("text"), ENDPOINT, 5)))
    hit = materialise(gated.select(F.col("__row").alias("row"), base.alias("base"), weak.alias("weak")), "secrets-spans")
    linked = materialise(_linked(hit, reach), "secrets-linked")
    spans = F.array_sort(F.array_union("base", F.coalesce("linked", F.array().cast(NO_SPANS))))
    all_spans = hit.join(linked, "row", "left").select(F.col("row").alias("__row"), F.col("base").alias("__base"), spans.alias("__spans"))
    none = F.array().cast(NO_SPANS)
    return gated.join(all_spans, "__row").select(*names, "__base", "__spans"), docs.where(~text.rlike(GATE)).select(*names, none.alias("__base"), none.alias("__spans"))


def report(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak spans reported)."""
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    some, none = find(docs.select("doc_id", "text"), reach)
    out = [
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("__base"), KINDS).cast("binary"), 256).alias("base_sha256"), listed(F.col("__spans"), KINDS).alias("spans"),
        (F.size("__spans") - F.size("__base")).cast("long").alias("n_linked"),
    ]
    return some.select(*out).union(none.select(*out))


def redact(docs: DataFrame, reach: int = REACH, mark: str = MARK) -> DataFrame:
    """All documents, every reported span replaced by ``mark``; columns as they were, n_chars, if there, counted anew."""
    some, none = find(docs, reach)
    clean = some.withColumn("text", replaced(F.col("text"), F.col("__spans"), lambda _: F.lit(mark)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns).union(none.select(*docs.columns))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op1_secrets": op1_secrets}
ORACLE_SQL: dict[str, str] = {}
