"""The URL store and a one-hop crawl over stored pages, all domains at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host, resolve, root_url, same_domain
from ..staging import materialize

#: Pages of a domain, its root included.
BUDGET, PREP_BUDGET = 3, 10
UNKNOWN = "unknown"
_STATUS = "struct<state:string,error:string>"


def status(state: str, error: Column | None = None) -> Column:
    return F.struct(F.lit(state).alias("state"), (F.lit(None).cast("string") if error is None else error).alias("error"))


def new_urls(urls: DataFrame) -> DataFrame:
    """A store of pending URLs (url): each (domain, url) once, ``unknown`` for URLs without a host."""
    own = urls.select(F.coalesce(host(F.col("url")), F.lit(UNKNOWN)).alias("domain"), "url").filter("url is not null").dropDuplicates(["domain", "url"])
    none, now = F.lit(None).cast("string"), F.current_timestamp()
    return own.select("domain", "url", status("Pending").cast(_STATUS).alias("status"), none.alias("html_source"), none.alias("title"), now.alias("created_at"), now.alias("updated_at"))


def add_urls(store: DataFrame, urls: DataFrame) -> DataFrame:
    """The rows that ``urls`` adds to the store: what is new, in either domain."""
    return new_urls(urls).join(store.select("domain", "url"), ["domain", "url"], "left_anti")


def update_status(store: DataFrame, where: Column, to: Column) -> DataFrame:
    return store.withColumn("updated_at", F.when(where, F.current_timestamp()).otherwise(F.col("updated_at"))).withColumn("status", F.when(where, to.cast(_STATUS)).otherwise(F.col("status")))


def set_html_data(store: DataFrame, fetched: DataFrame) -> DataFrame:
    """The store with html_source and title of the URLs in ``fetched`` (url, html_source, title), each at most once there; their status stays."""
    new = fetched.select(F.col("url").alias("_u"), F.col("html_source").alias("_h"), F.col("title").alias("_t"), F.lit(True).alias("_new"))
    got = store.join(new, F.col("url") == F.col("_u"), "left")
    pick = lambda new, old: F.when(F.col("_new"), F.col(new)).otherwise(F.col(old)).alias(old)
    now = F.when(F.col("_new"), F.current_timestamp()).otherwise(F.col("updated_at")).alias("updated_at")
    return got.select("domain", "url", "status", pick("_h", "html_source"), pick("_t", "title"), "created_at", now)


def lookup(store: DataFrame, url: str) -> DataFrame:
    """The URL's row; URLs without a host are never found."""
    return store.filter((F.col("url") == url) & (F.col("domain") == host(F.lit(url))))


def by_domain(store: DataFrame, domain: str) -> DataFrame:
    return store.filter(F.col("domain") == domain)


def completed(store: DataFrame) -> DataFrame:
    return store.filter(F.col("status.state") == "Success")


def page_links(parsed: DataFrame) -> DataFrame:
    """page_id, domain, url, pos: each page's links within its domain or a subdomain, each URL once."""
    h = parsed.select("page_id", "domain", F.posexplode("hrefs").alias("pos", "href"))
    r = h.select("page_id", "domain", resolve(F.col("href"), F.col("domain")).alias("url"), "pos").filter(same_domain(F.col("url"), F.col("domain")))
    return r.groupBy("page_id", "domain", "url").agg(F.min("pos").alias("pos"))


def _link_urls() -> Column:
    """The resolved links of a parsed page within its domain, in document order, each once; an array."""
    full = F.transform("hrefs", lambda h: resolve(h, F.col("domain")))
    return F.array_distinct(F.filter(full, lambda u: same_domain(u, F.col("domain"))))


def frontier(parsed_roots: DataFrame, budget: int = BUDGET) -> DataFrame:
    """domain, url, rank: the root first, then its page's links in document order, ``budget`` at most.

    A page's links are ranked within its row: nothing is shuffled, and a page is parsed once.
    """
    links = F.slice(F.array_except(_link_urls(), F.array("url")), 1, budget - 1)
    one = parsed_roots.select("domain", F.concat(F.array("url"), F.coalesce(links, F.array().cast("array<string>"))).alias("_all"))
    return one.select("domain", F.posexplode("_all").alias("rank", "url")).select("domain", "url", "rank")


def seeded_frontier(parsed: DataFrame, initial: str, budget: int = BUDGET) -> DataFrame:
    """domain, url, rank of a crawl from one URL: that URL, its domain's root, then other links, ``budget`` in all.

    ``parsed``: at most one row, the page that links are taken from; without it there are
    only the two seeds.  A link that is another spelling of the root (``is_root_url``) uses
    up budget but isn't visited.
    """
    from ..functions.urls import is_root_url

    seed = parsed.sparkSession.createDataFrame([(initial,)], "initial string")
    seed = seed.select("initial", host(F.col("initial")).alias("own")).filter("own is not null")
    first = seed.select("own", F.array_distinct(F.array("initial", root_url(F.col("own")))).alias("seeds"), "initial")
    more = parsed.select(F.col("domain").alias("own"), _link_urls().alias("links"))
    both = first.join(more, "own", "left")
    extra = F.slice(F.array_except(F.coalesce("links", F.array().cast("array<string>")), "seeds"), F.lit(1), F.greatest(F.lit(0), F.lit(budget) - F.size("seeds")))
    visited = F.concat("seeds", F.filter(extra, lambda u: ~is_root_url(u)))
    return both.select(F.col("own").alias("domain"), F.posexplode(visited).alias("rank", "url")).select("domain", "url", "rank")


#: Up to so many URLs (some 100 bytes each) are broadcast to pick their stored pages.
BROADCAST_URLS = 100_000


def fetch(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """``urls`` (domain, url, rank) with status and html_source from the stored pages.

    The URLs are written once; only stored pages that one of them names are aggregated.
    """
    urls = materialize(urls, "frontier")
    names = urls.select("url").distinct()
    named = pages.join(F.broadcast(names) if urls.count() <= BROADCAST_URLS else names, "url", "left_semi")
    stored = named.groupBy("url").agg(F.max_by(F.struct("page_id", "html"), F.struct(F.col("page_id"))).alias("p"))
    got = urls.join(stored, "url", "left")
    html = F.col("p.html")
    state = (
        F.when(F.col("p").isNull(), status("Failed", F.concat(F.lit("Failed to navigate: no stored page for "), F.col("url"))))
        .when(html.isNull(), status("Failed", F.lit("Failed to get HTML source: no html stored")))
        .otherwise(status("Success"))
    )
    return got.select("domain", "url", "rank", state.alias("status"), F.col("p.page_id").alias("page_id"), html.alias("html_source"))


def seeds(domains: DataFrame) -> DataFrame:
    """domain and the URL of its root, for each of ``domains`` (domain)."""
    return domains.select("domain", root_url(F.col("domain")).alias("url")).distinct()


def root_pages(pages: DataFrame) -> DataFrame:
    """The page that stands for each domain's root: its root URL's if stored, else that of the smallest id."""
    from ..functions.urls import is_root_url

    p = pages.select("page_id", "url", "html", host(F.col("url")).alias("domain")).filter("domain is not null")
    first = p.groupBy("domain").agg(F.min_by("page_id", F.struct((~is_root_url(F.col("url"))).alias("r"), "page_id")).alias("page_id"))
    return p.join(first, ["domain", "page_id"], "left_semi").select("page_id", "url", "html")
