"""Element subtrees that repeat within a domain, and their masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host
from ..sources.pages import node_table, parse_pages
from ..staging import join_salted

# Page scaffolding, and elements that count even when bare.
STRUCTURAL = "html head body main article section".split()
SEMANTIC = "nav header footer aside form button a ul ol menu".split()
MASK = "[FILTERED DUPLICATE]"


#: What a duplicate is told by; parsing for duplicates yields nothing else.
FIELDS = ("size", "tag", "classes", "id", "content", "sig")
#: Up to so many URLs that are stored more than once are broadcast to pick their rows.
BROADCAST_URLS = 100_000


def current(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with each URL once: the row with the largest page_id, as a store keeps what came last.

    Only rows of repeated URLs are shuffled with their html.  Of rows that also share
    their page_id, that with the largest html counts; a null page_id is smaller than any.
    Rows without a URL are left out.
    """
    p = pages.select("page_id", "url", "html").filter("url is not null")
    repeated = p.groupBy("url").count().filter("count > 1").select("url")
    few = repeated.limit(BROADCAST_URLS + 1).count() <= BROADCAST_URLS
    side = F.broadcast(repeated) if few else repeated
    last = p.join(side, "url", "left_semi").groupBy("url").agg(F.max(F.struct("page_id", "html")).alias("p"))
    return p.join(side, "url", "left_anti").unionByName(last.select("p.page_id", "url", "p.html"))


def eligible_domains(pages: DataFrame) -> DataFrame:
    """The domains (exact hosts) with at least two pages of different URLs."""
    p = pages.select(host(F.col("url")).alias("domain"), "url").filter("domain is not null")
    return p.groupBy("domain").agg(F.min("url").alias("a"), F.max("url").alias("b")).filter("a <> b").select("domain")


def eligible_pages(pages: DataFrame) -> DataFrame:
    """The pages of eligible domains, each URL once, so that only these are parsed."""
    one = current(pages).withColumn("domain", host(F.col("url")))
    return one.join(eligible_domains(pages), "domain", "left_semi").select("page_id", "url", "html")


def meaningful(n: Column | None = None) -> Column:
    """Whether a node counts; of parsed nodes all but a blank root do."""
    c = F.col if n is None else (lambda x: n[x])
    return (F.trim(c("content")) != "") | (c("size") > 1) | (F.size(c("classes")) > 0) | c("id").isNotNull() | c("tag").isin(SEMANTIC)


def signature_counts(nodes: DataFrame, least: int = 2) -> DataFrame:
    """domain, sig, tag, classes, id, content, occurrences of the signatures that occur ``least`` times."""
    own = nodes.filter(~F.col("tag").isin(STRUCTURAL) & meaningful())
    counted = own.groupBy("domain", "sig").agg(F.count("*").alias("occurrences"), F.first(F.struct("tag", "classes", "id", "content")).alias("n"))
    return counted.filter(F.col("occurrences") >= least).select("domain", "sig", "n.tag", "n.classes", "n.id", "n.content", "occurrences")


def domain_duplicates(pages: DataFrame) -> DataFrame:
    """The duplicate signatures of every domain with at least two pages.

    Occurrences are counted, not pages: two equal elements of one page are duplicates.
    """
    return signature_counts(node_table(parse_pages(eligible_pages(pages), links=False, fields=FIELDS)))


def merge_duplicates(known: DataFrame, new: DataFrame) -> DataFrame:
    """Duplicates found earlier stay when a domain is analysed again."""
    return known.unionByName(new).groupBy("domain", "sig").agg(*[F.max_by(c, "occurrences").alias(c) for c in ("tag", "classes", "id", "content")], F.max("occurrences").alias("occurrences"))


def domain_summary(pages: DataFrame, duplicates: DataFrame) -> DataFrame:
    """domain, n_pages, analyzed, n_duplicates: a domain with one page isn't analysed, which is not the same as 0."""
    all_ = pages.select(host(F.col("url")).alias("domain"), "url").filter("domain is not null")
    n = all_.groupBy("domain").agg(F.countDistinct("url").alias("n_pages"))
    d = duplicates.groupBy("domain").agg(F.count("*").alias("n"))
    found = F.when(F.col("n_pages") >= 2, F.coalesce("n", F.lit(0)))
    return n.join(d, "domain", "left").select("domain", "n_pages", (F.col("n_pages") >= 2).alias("analyzed"), found.cast("long").alias("n_duplicates"))


def mask_duplicates(nodes: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The nodes, all of them, with the content of duplicates replaced, containers included.

    A signature that a large site repeats on every page is met by several tasks.
    """
    hit = duplicates.groupBy("domain", "sig").agg(F.max("occurrences").alias("_n")).withColumn("_hit", F.lit(True))
    total = hit.agg(F.sum("_n")).first()[0] or 0
    by = [c for c in nodes.columns if c not in ("domain", "sig")]
    out = join_salted(nodes, hit, ["domain", "sig"], "_n", total, by, "left")
    return out.withColumn("content", F.when(F.col("_hit"), MASK).otherwise(F.col("content"))).select(nodes.columns)
