"""Host and path rules over URLs, as an equi-join on digest prefixes (native).

Each URL is expanded into host-suffix x path-prefix expressions; only the label
counts and path lengths that some rule has are expanded.  An expression's digest is
joined with the rules' on its first ``PREFIX_HEX`` digits, then the whole digest is
compared, and among the rules that fit the longest wins (ties: the longer host, then
the smaller rule text).

Defined cases: a null URL, or one without ``://``, has an empty host and path and no
rule; repeated rows come out as often as they went in; other columns of the input are
left out, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

#: The rules of the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
PREFIX_HEX = 8
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Up to so many rules the rule side is broadcast (about 20 MB); beyond, both sides are shuffled.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(key, rule_digest, precedence, rule, rule_verdict) of each rule; of equal host and path, ``block`` is kept.

    The precedence is one number: the longer rule, then the longer host, then the smaller text.
    """
    said: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        k = (host.translate(_LOWER), path)
        said[k] = max(verdict, said.get(k, ""))
    order = sorted(sorted(said, key="".join, reverse=True), key=lambda k: (len(k[0]) + len(k[1]), len(k[0])))
    raw = spark.createDataFrame([(said[k], *k, i) for i, k in enumerate(order)], "rule_verdict string, h string, p string, precedence long")
    digest = F.sha2(_expression(F.col("h"), F.col("p")), 256)
    return raw.select(F.substring(digest, 1, PREFIX_HEX).alias("key"), digest.alias("rule_digest"), "precedence", F.concat("h", "p").alias("rule"), "rule_verdict")


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    spark, rules = pages.sparkSession, [*rules]
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # every row has a number of its own: rows that are equal, however many, meet nowhere
    rows = urls.withColumn("_row", F.monotonically_increasing_id())
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels]))
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths]))
    expanded = rows.withColumn("_s", F.explode(suffixes)).withColumn("_p", F.explode(prefixes))
    expanded = expanded.withColumn("digest", F.sha2(_expression(F.col("_s"), F.col("_p")), 256)).drop("_s", "_p")
    expanded = expanded.withColumn("key", F.substring("digest", 1, PREFIX_HEX))
    side = rules_frame(spark, rules)
    few = len(rules) <= BROADCAST_RULES
    near = side.select("key", "rule_digest", "precedence")
    fits = F.when(F.col("digest") == F.col("rule_digest"), F.col("precedence"))
    # all expressions of a row are made in its own task, so the partial aggregate meets them there
    best = expanded.join(F.broadcast(near) if few else near, "key", "left").groupBy("_row", "page_id", "host", "path").agg(F.max(fits).alias("precedence"))
    names = side.select("precedence", "rule", "rule_verdict")
    out = best.join(F.broadcast(names) if few else names, "precedence", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, h, p) AS (VALUES ('allow','org','/'),('block','example.org','/es/'),('block','example.org','/en/1'),('allow','com','/fr/'),('block','com','/de/')),
m AS (
  SELECT p.rid, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY p.rid)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN m ON p.rid = m.rid
"""
