"""The whole run over stored pages: seed, discover, fetch, analyse, report; all domains at once or some."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host, input_domain, root_url
from ..operators import crawl, duplicates, report, template_paths
from ..sources.pages import node_table, parse_pages, titles
from ..staging import materialize


@dataclass
class Site:
    """urls: domain, url, rank, status; report: the listing; findings: duplicates, or template paths in a prep run."""

    urls: DataFrame
    report: DataFrame
    findings: DataFrame
    summary: DataFrame


def wanted(pages: DataFrame, said: list[str] | None) -> DataFrame:
    """The pages of the domains that a user names, as domains or URLs, subdomains included; all without names."""
    if said is None:
        return pages
    d = pages.sparkSession.createDataFrame([(s,) for s in said], "said string").select(input_domain(F.col("said")).alias("_d")).filter("_d is not null").distinct()
    own = host(F.col("url"))
    return pages.join(F.broadcast(d), (own == F.col("_d")) | F.endswith(own, F.concat(F.lit("."), F.col("_d"))), "left_semi")


def run(pages: DataFrame, domains: list[str] | None = None, prep: bool = False) -> Site:
    """Crawl from each domain's root page within the budget, then look for duplicates, or for templates with ``prep``.

    A page's links are followed one hop.  Pages that aren't stored fail; links to
    subdomains are fetched and listed, but their pages count for their own host.
    """
    p = wanted(pages, domains)
    roots = parse_pages(crawl.root_pages(p), fields=())
    return _site(crawl.fetch(crawl.frontier(roots, crawl.PREP_BUDGET if prep else crawl.BUDGET), p), prep)


def _site(urls: DataFrame, prep: bool) -> Site:
    """What was fetched is written once and parsed once, whatever is asked of it afterwards."""
    urls = materialize(urls, "fetched")
    done = crawl.completed(urls).select("page_id", "url", F.col("html_source").alias("html"))
    done = done.groupBy("url").agg(F.min("page_id").alias("page_id"), F.first("html").alias("html")).select("page_id", "url", "html")
    if prep:
        parsed = materialize(parse_pages(done, links=False, fields=("tag", "classes", "content", "path"), paths="digits"), "parsed")
        found = template_paths.template_paths(node_table(parsed))
        return Site(urls, report.prep_listing(titles(parsed)), found, template_paths.paths_json(found))
    parsed = materialize(parse_pages(done, links=False, fields=duplicates.FIELDS), "parsed")
    found = duplicates.signature_counts(node_table(parsed.join(duplicates.eligible_domains(done), "domain", "left_semi")))
    return Site(urls, report.listing(titles(parsed)), found, duplicates.domain_summary(done, found))


def run_from(pages: DataFrame, url: str) -> Site:
    """A crawl from one URL: that URL and its domain's root are visited, and links up to the budget.

    Links come from the URL's own page, or from the root's where the URL isn't stored.
    Only the URL's domain is analysed.
    """
    first = pages.sparkSession.createDataFrame([(url,)], "initial string").select("initial", host(F.col("initial")).alias("_d"), root_url(host(F.col("initial"))).alias("_root"))
    own = pages.withColumn("_h", host(F.col("url"))).join(F.broadcast(first), (F.col("_h") == F.col("_d")) | F.endswith("_h", F.concat(F.lit("."), F.col("_d"))))
    two = own.filter(((F.col("url") == F.col("initial")) | (F.col("url") == F.col("_root"))) & F.col("html").isNotNull())
    start = two.orderBy(F.col("url") != F.col("initial"), F.desc("page_id")).limit(1).select("page_id", "url", "html")
    links = crawl.seeded_frontier(parse_pages(start, fields=()), url)
    site = _site(crawl.fetch(links, own.select("page_id", "url", "html")), False)
    domain = first.select(F.col("_d").alias("domain"))
    return Site(site.urls, site.report, site.findings.join(F.broadcast(domain), "domain", "left_semi"), site.summary.join(F.broadcast(domain), "domain", "left_semi"))
