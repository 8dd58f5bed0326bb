"""URL filter by hashed host-suffix and path-prefix expressions; DataFrame functions only.

Every URL is expanded into expressions: each suffix of its host that begins at a label and has as many labels as some rule's
host, with each prefix of its path that is as long as some rule's path (so any rule path is matched, not only those that end at
a slash). So the expressions of a URL follow the rules' label counts and lengths, however long its host and path are. Expressions and rules
meet by an equi-join on the first four bytes of their SHA-256 digests; the full digests then confirm. Of the confirmed
rules the longest (host and path together, then the longer host, then block before allow) decides.

Expansion is done once for each different host and start of path, not for each page, and results are joined back. Rules
are hashed once; the engine broadcasts them while they are below its own threshold and shuffles them beyond.

Defined results: a null url, or one without ``://``, has an empty host and path, and so no rule; URLs without a rule
get ``default``; repeated pages give repeated rows; of rules for one expression block wins; rules with a null host,
path or verdict don't count; with no rules every URL gets ``default``; an empty table of pages gives an empty result; extra columns are kept by
:func:`judge`, but for those named host, path, rule or verdict, which its own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

ALLOW, BLOCK = "allow", "block"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def _expressions(places: DataFrame, counts: list[int], lengths: list[int]) -> DataFrame:
    """places (host, start) with one row per expression: suffix, prefix."""
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    suffixes = F.array_compact(F.array(*(F.when(labels >= k, F.substring_index("host", ".", -k)) for k in counts)))
    prefixes = F.array_distinct(F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("start")), lambda n: F.substring("start", F.lit(1), n)))
    return places.select("host", "start", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "start", "suffix", F.explode("prefixes").alias("prefix"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    valid = rules.where("host is not null and path is not null and verdict is not null")
    # Few different lengths and label counts exist, however many rules there are.
    lengths = sorted(r.n for r in valid.select(F.length("path").alias("n")).distinct().collect())
    counts = sorted(r.n for r in valid.select(F.size(F.split("host", r"\.", -1)).alias("n")).distinct().collect())
    hashed = (
        valid.groupBy(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("full", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("full", 1, 8))
    )
    clash = [c for c in ("host", "path", "rule", "verdict") if c in pages.columns]
    seen = pages.drop(*clash).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    seen = seen.withColumn("__start", F.substring("path", 1, lengths[-1] if lengths else 0))
    if not lengths:
        return seen.drop("__start").withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    places = seen.select("host", F.col("__start").alias("start")).distinct()
    asked = _expressions(places, counts, lengths).withColumn("full_asked", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("full_asked", 1, 8))
    # A digest is of host and path run together, so the confirmed pair is compared too.
    met = asked.join(hashed, "short").where("full = full_asked and suffix = rule_host and prefix = rule_path")
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "rule_verdict")
    best = met.groupBy("host", "start").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), rank).alias("best"))
    # Written, so that both sides of the join are plain exchanges and a hot host can be split.
    best = materialise(best.select("host", F.col("start").alias("__start"), "best.rule", F.col("best.rule_verdict").alias("verdict")), "url-verdicts")
    return seen.join(best, ["host", "__start"], "left").select(*(c for c in seen.columns if c != "__start"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLE_SQL = {
    "op5_url_filter": """
with u as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(verdict, h, s) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
q as (select page_id, host, path,
  (select max(lpad(cast(length(h) + length(s) as varchar), 6, '0') || ' ' || verdict || ' ' || h || s) from r
   where (host = h or ends_with(host, '.' || h)) and starts_with(path, s)) as best from p)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, case when best is null then null else split_part(best, ' ', 3) end as rule,
  case when best is null then 'allow' else split_part(best, ' ', 2) end as verdict from q
"""
}
