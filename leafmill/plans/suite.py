"""The engine's queries over the driver's tables, with DuckDB SQL where SQL can say the same.

Inputs of template and path queries are rendered from rows, since the stored pages hold
hardly any template text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import templates as T
from ..functions import urls as U
from ..operators import crawl, duplicates, paths, report, template_paths
from ..sources import pages as P
from ..staging import materialize
from . import site

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL parts
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_plain = lambda x: f"replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_clean = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_AD = _clean(_plain("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)"))
_HREFS = "SELECT page_id, url, u.href, u.pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages), LATERAL (SELECT unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos) AS u"
#: Each URL once, as a store holds it.
_LAST = "(SELECT url, arg_max(html, page_id) AS html FROM pages GROUP BY url)"
_MANY = f"(SELECT {_HOST} AS domain FROM pages GROUP BY 1 HAVING count(DISTINCT url) > 1)"


# --- URLs and texts
@query(f"SELECT page_id, {_HOST} AS domain FROM pages")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("domain"))


@query(f"SELECT DISTINCT {_HOST} AS domain, 'https://' || {_HOST} || '/' AS root FROM pages")
def construct_root_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("domain")).distinct()
    return d.select("domain", U.root_url(F.col("domain")).alias("root"))


@query(f"SELECT page_id, false AS full_is_root, true AS root_is_root, false AS query_is_root FROM pages")
def is_root_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = U.root_url(U.host(F.col("url")))
    return _table(spark, sf_dir, "pages").select(
        "page_id", U.is_root_url(F.col("url")).alias("full_is_root"), U.is_root_url(root).alias("root_is_root"), U.is_root_url(F.concat(root, F.lit("?q=1"))).alias("query_is_root")
    )


@query(f"SELECT page_id, {_HOST} AS from_url, {_HOST} AS from_bare FROM pages")
def input_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.concat(F.lit("  "), F.regexp_replace("url", "^[a-z]+://", ""), F.lit(" "))
    return _table(spark, sf_dir, "pages").select("page_id", U.input_domain(F.col("url")).alias("from_url"), U.input_domain(bare).alias("from_bare"))


@query(f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", U.clean_text(F.col("text")).alias("cleaned"))


# --- links and the frontier
def _parsed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return P.parse_pages(_table(spark, sf_dir, "pages"), **options)


@query(f"SELECT page_id, href, 'https://' || {_HOST} || href AS resolved FROM ({_HREFS})")
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _parsed(spark, sf_dir, fields=()).select("page_id", "domain", F.explode("hrefs").alias("href"))
    return h.select("page_id", "href", U.resolve(F.col("href"), F.col("domain")).alias("resolved"))


@query(f"SELECT page_id, 'https://' || {_HOST} || href AS link, min(pos)::INT AS pos FROM ({_HREFS}) GROUP BY ALL")
def same_domain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.page_links(_parsed(spark, sf_dir, fields=())).select("page_id", F.col("url").alias("link"), "pos")


def _frontier(spark: SparkSession, sf_dir: str, budget: int) -> DataFrame:
    roots = crawl.root_pages(_table(spark, sf_dir, "pages"))
    return crawl.frontier(P.parse_pages(roots, fields=()), budget)


_FRONTIER = lambda budget: f"""
WITH first AS (SELECT {_HOST} AS domain, min(page_id) AS page_id FROM pages GROUP BY 1),
l AS (SELECT f.domain, 'https://' || f.domain || h.href AS url, min(h.pos) AS pos, any_value(h.url) AS root
      FROM ({_HREFS}) h JOIN first f USING (page_id) GROUP BY 1, 2),
r AS (SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY pos) AS rank FROM l WHERE url <> root)
SELECT domain, url, rank::INT AS rank FROM r WHERE rank < {budget}
UNION ALL SELECT f.domain, p.url, 0 FROM first f JOIN pages p USING (page_id)"""  # noqa: E731


@query(_FRONTIER(crawl.BUDGET))
def link_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frontier(spark, sf_dir, crawl.BUDGET)


@query(_FRONTIER(crawl.PREP_BUDGET))
def link_frontier_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frontier(spark, sf_dir, crawl.PREP_BUDGET)


@query(f"""WITH f AS ({_FRONTIER(crawl.BUDGET)}), p AS (SELECT DISTINCT url FROM pages)
SELECT f.domain, f.url, f.rank, CASE WHEN p.url IS NULL THEN 'Failed' ELSE 'Success' END AS state,
  CASE WHEN p.url IS NULL THEN 'Failed to navigate: no stored page for ' || f.url END AS error FROM f LEFT JOIN p ON f.url = p.url""")
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = crawl.fetch(_frontier(spark, sf_dir, crawl.BUDGET), _table(spark, sf_dir, "pages"))
    return got.select("domain", "url", "rank", F.col("status.state").alias("state"), F.col("status.error").alias("error"))


@query(f"SELECT {_HOST} AS domain, url, 'Pending' AS state FROM pages GROUP BY ALL")
def url_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").select("url")
    return crawl.new_urls(p.unionByName(p)).select("domain", "url", F.col("status.state").alias("state"))


@query(f"WITH f AS ({_FRONTIER(crawl.BUDGET)}) SELECT DISTINCT domain, url FROM f WHERE url NOT IN (SELECT url FROM pages)")
def url_store_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = crawl.new_urls(_table(spark, sf_dir, "pages").select("url"))
    return crawl.add_urls(store, _frontier(spark, sf_dir, crawl.BUDGET).select("url")).select("domain", "url")


@query(f"SELECT {_HOST} AS domain, url FROM pages WHERE {_HOST} = (SELECT min({_HOST}) FROM pages) GROUP BY ALL")
def urls_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = crawl.new_urls(_table(spark, sf_dir, "pages").select("url"))
    first = store.agg(F.min("domain").alias("domain"))
    return store.join(first, "domain", "left_semi").select("domain", "url")


@query(f"SELECT {_HOST} AS domain, url, 'Success' AS state FROM pages GROUP BY ALL")
def completed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = crawl.new_urls(_table(spark, sf_dir, "pages").select("url"))
    done = crawl.fetch(store.select("domain", "url", F.lit(0).alias("rank")), _table(spark, sf_dir, "pages"))
    return crawl.completed(done).select("domain", "url", F.col("status.state").alias("state"))


# --- trees
_TITLE = f"{_clean(_plain('regexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)'))}"


@query(f"SELECT page_id, nullif({_TITLE}, '') AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.titles(_parsed(spark, sf_dir, links=False, fields=("tag", "content"))).select("page_id", "title")


def _nodes(spark: SparkSession, sf_dir: str, *fields: str, paths: str = "all") -> DataFrame:
    return P.node_table(_parsed(spark, sf_dir, links=False, fields=fields, paths=paths))


@query(f"SELECT page_id, {_clean(_plain('unnest(regexp_extract_all(html, ' + chr(39) + '<li><a href=' + chr(34) + '[^' + chr(34) + ']*' + chr(34) + '>([^<]*)</a></li>' + chr(39) + ', 1))'))} AS content FROM pages")
def parse_nodes_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, "tag", "content").filter("tag = 'a'").select("page_id", "content")


@query(f"SELECT page_id, {_AD} AS content, 'ad' AS classes FROM pages WHERE {_AD} <> ''")
def parse_nodes_ad(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir, "classes", "content").filter(F.array_contains("classes", "ad"))
    return n.select("page_id", "content", F.array_join("classes", " ").alias("classes"))


@query(f"SELECT page_id, {_clean(_plain('regexp_extract(html, ' + chr(39) + '<h1>([^<]*)</h1>' + chr(39) + ', 1)'))} AS content FROM pages WHERE {_clean(_plain('regexp_extract(html, ' + chr(39) + '<h1>([^<]*)</h1>' + chr(39) + ', 1)'))} <> ''")
def parse_nodes_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, "tag", "content").filter("tag = 'h1'").select("page_id", "content")


@query()
def parse_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, "tag", "depth", "size").groupBy("tag").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.max("size").alias("largest"))


# --- duplicates
@query()
def domain_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = duplicates.domain_duplicates(_table(spark, sf_dir, "pages"))
    return d.select("domain", "sig", "tag", F.array_join("classes", " ").alias("classes"), "id", "content", "occurrences")


_LINKS = f"SELECT {_HOST} AS domain, {_clean(_plain('unnest(regexp_extract_all(html, ' + chr(39) + '<li><a href=' + chr(34) + '[^' + chr(34) + ']*' + chr(34) + '>([^<]*)</a></li>' + chr(39) + ', 1))'))} AS content FROM {_LAST}"


@query(f"SELECT domain, content, count(*) AS occurrences FROM ({_LINKS}) WHERE domain IN {_MANY} GROUP BY ALL HAVING count(*) > 1")
def domain_duplicates_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.domain_duplicates(_table(spark, sf_dir, "pages")).filter("tag = 'a'").select("domain", "content", "occurrences")


@query(f"SELECT domain, count(*) AS occurrences FROM ({_LINKS}) WHERE domain IN {_MANY} GROUP BY domain, content HAVING count(*) > 1")
def domain_duplicates_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.domain_duplicates(_table(spark, sf_dir, "pages")).filter("tag = 'li'").select("domain", "occurrences")


_ADS = f"SELECT page_id, {_HOST} AS domain, {_AD} AS content FROM pages"


_LAST_ADS = f"SELECT {_HOST} AS domain, {_AD} AS content FROM {_LAST}"


@query(f"SELECT domain, content, count(*) AS occurrences FROM ({_LAST_ADS}) WHERE domain IN {_MANY} AND content <> '' GROUP BY ALL HAVING count(*) > 1")
def domain_duplicates_ad(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = duplicates.domain_duplicates(_table(spark, sf_dir, "pages"))
    return d.filter(F.array_contains("classes", "ad")).select("domain", "content", "occurrences")


@query(f"""WITH n AS (SELECT {_HOST} AS domain, count(DISTINCT url) AS n_pages FROM pages GROUP BY 1),
r AS (SELECT domain, count(*) AS n FROM (SELECT domain, content FROM ({_LINKS}) GROUP BY ALL HAVING count(*) > 1) GROUP BY domain)
SELECT domain, n_pages, n_pages >= 2 AS analyzed, CASE WHEN n_pages >= 2 THEN coalesce(n, 0) END AS n_duplicates FROM n LEFT JOIN r USING (domain)""")
def domain_duplicate_summary_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return duplicates.domain_summary(p, duplicates.domain_duplicates(p).filter("tag = 'a'"))


@query()
def domain_duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return duplicates.domain_summary(p, duplicates.domain_duplicates(p))


@query(f"""WITH d AS (SELECT domain, content FROM ({_LAST_ADS}) WHERE domain IN {_MANY} GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, CASE WHEN d.content IS NULL THEN a.content ELSE '{duplicates.MASK}' END AS content
FROM ({_ADS}) a LEFT JOIN d ON a.domain = d.domain AND a.content = d.content WHERE a.content <> ''""")
def mask_duplicates_ad(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    parsed = materialize(P.parse_pages(p, links=False, fields=duplicates.FIELDS), "parsed")
    last = parsed.join(duplicates.current(p).select("page_id", "url"), ["page_id", "url"], "left_semi").join(duplicates.eligible_domains(p), "domain", "left_semi")
    masked = duplicates.mask_duplicates(P.node_table(parsed), duplicates.signature_counts(P.node_table(last)))
    return masked.filter(F.array_contains("classes", "ad")).select("page_id", "content")


# --- templates
def _templates(df: DataFrame, key: str, text: Column) -> DataFrame:
    t = T.with_templates(df.select(F.col(key), text.alias("content")))
    return t.select(key, "template_pattern", "template_variable", "template_type")


def _order(*text: str) -> Callable:
    """The template of a text with the order's key where ``#`` stands."""
    parts = [x for t in text for x in t.partition("#") if x]
    say = lambda: F.concat(*[F.col("o_orderkey").cast("string") if x == "#" else F.lit(x) for x in parts])
    return lambda spark, sf_dir: _templates(_table(spark, sf_dir, "orders"), "o_orderkey", say())


def _rendered(name: str, text: str, pattern: str, variable: str, kind: str = "Number") -> None:
    QUERIES[name] = _order(text)
    null = lambda x: "NULL::VARCHAR" if x is None else f"'{x}'"
    SQL[name] = f"SELECT o_orderkey, {null(pattern)} AS template_pattern, {null(variable)} AS template_variable, {null(kind)} AS template_type FROM orders"


_say = lambda *x: F.concat(*[F.lit(s) if isinstance(s, str) else s for s in x])
_rendered("template_count", "# comments", "{count} comments", "count")
_rendered("template_time", "Posted # hours ago by user123", "Posted {time} hours ago by user123", "time")
_rendered("template_float", "#.5 hours ago", "{value} hours ago", "value", "Float")
_rendered("template_page", "  Page # of 100 ", "Page {count} of 100", "count")
_rendered("template_spaces", "  #   comments", "{count}   comments", "count")
_rendered("template_far", "foo   # comments", "foo   {value} comments", "value")
_rendered("template_second", "of-5 and # apples", "of-5 and {value1} apples", "value1")
_rendered("template_comma", "# comments,", "{value} comments,", "value")
_rendered("template_none", "Random # text", None, None, None)
# words are looked up as if one byte apart, so a number of three digits is still met in its own place
SQL["template_far"] = """SELECT o_orderkey, CASE WHEN o_orderkey > 99 THEN 'foo   {count} comments' ELSE 'foo   {value} comments' END AS template_pattern,
CASE WHEN o_orderkey > 99 THEN 'count' ELSE 'value' END AS template_variable, 'Number' AS template_type FROM orders"""
QUERIES["template_decimal_views"] = _order("#.2k views")
SQL["template_decimal_views"] = "SELECT o_orderkey, '{count}.2k views' AS template_pattern, 'count' AS template_variable, 'Number' AS template_type FROM orders"



_SIGNS = ", ".join(f"'{w}'" for w in [*T.TIME, *T.COUNT, *T.INDICATORS])


@query(rf"""
WITH d AS (SELECT doc_id, regexp_split_to_array(trim(text, E' \t\n\r\f'), '\s+') AS ws FROM documents WHERE regexp_matches(text, '\d')),
w AS (SELECT doc_id, generate_subscripts(ws, 1) AS k, unnest(ws) AS w FROM d),
f AS (SELECT doc_id, k, regexp_replace(lower(w), '^[^\pL]+|[^\pL]+$', '', 'g') IN ({_SIGNS}) AS sign,
  regexp_matches(w, '(^|[^\pL\pN_])\d+\.\d+($|[^\pL\pN_])') AS fl, regexp_matches(w, '(^|[^\pL\pN_])\d+($|[^\pL\pN_])') AS nu FROM w),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (sign) AS signs, min(k) FILTER (sign) AS at FROM f GROUP BY doc_id)
SELECT f.doc_id, CASE WHEN bool_or(fl) THEN 'Float' ELSE 'Number' END AS template_type
FROM f JOIN s USING (doc_id) WHERE s.n > 1 AND s.signs > 0 AND (s.signs > 1 OR f.k <> s.at) AND (fl OR nu) GROUP BY f.doc_id""")
def template_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.with_templates(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return t.filter("template_type is not null").select("doc_id", "template_type")


@query()
def template_patterns_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.with_templates(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return t.filter("template_type is not null").select("doc_id", "template_pattern", "template_variable")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small page for every event, two sites."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id")
    n, m = F.col("event_id").cast("string"), (F.col("user_id") % 12).cast("string")
    html = _say('<html><body><div class="comments">', n, ' comments</div><ul><li class="when small">', m, " hours ago</li><li>Just text</li></ul></body></html>")
    site = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    return e.select(F.col("event_id").alias("page_id"), _say("https://", site, ".example.com/", n).alias("url"), html.alias("html"))


def _card_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_pages(_cards(spark, sf_dir), links=False, fields=("content", "path"), paths="digits")


_SITES = "(SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END || '.example.com' AS domain FROM events)"


@query(f"""SELECT domain, 'html > body > div.comments' AS path, '{{count}} comments' AS template_pattern FROM {_SITES}
UNION ALL SELECT domain, 'html > body > ul > li.when.small', '{{time}} hours ago' FROM {_SITES}""")
def template_element_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_paths.template_paths(P.node_table(_card_nodes(spark, sf_dir)))
    return found.select("domain", template_paths.path_text().alias("path"), "template_pattern")


@query()
def template_paths_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_paths.paths_json(template_paths.template_paths(P.node_table(_card_nodes(spark, sf_dir))))


@query()
def template_element_paths_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_paths.template_paths(_nodes(spark, sf_dir, "content", "path", paths="digits"))
    return found.select("domain", template_paths.path_text().alias("path"), "template_pattern")


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END || '.example.com' AS domain, t.tag, t.content, count(*) AS occurrences
FROM events, (VALUES ('div', '{count} comments'), ('li', '{time} hours ago'), ('li', 'Just text'), ('ul', '')) AS t(tag, content) GROUP BY ALL HAVING count(*) > 1""")
def template_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = P.parse_pages(_cards(spark, sf_dir), links=False, fields=("pre", *duplicates.FIELDS))
    return duplicates.signature_counts(template_paths.normalized(parsed)).select("domain", "tag", "content", "occurrences")


# --- path queries
@query(f"SELECT page_id, content, count(*) AS matches FROM (SELECT page_id, {_clean(_plain('unnest(regexp_extract_all(html, ' + chr(39) + '<li><a href=' + chr(34) + '[^' + chr(34) + ']*' + chr(34) + '>([^<]*)</a></li>' + chr(39) + ', 1))'))} AS content FROM pages) GROUP BY ALL")
def find_by_path_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.find_by_path(_nodes(spark, sf_dir, "tag", "classes", "content", "path"), "html body nav ul li a")
    return found.groupBy("page_id", "content").agg(F.sum("matches").alias("matches"))


@query(f"SELECT page_id, {_AD} AS content, 1::BIGINT AS matches FROM pages WHERE {_AD} <> ''")
def find_by_path_ad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.find_by_path(_nodes(spark, sf_dir, "tag", "classes", "content", "path"), "body div.ad").select("page_id", "content", "matches")


@query("SELECT o_orderkey AS page_id, (o_orderkey % 5) + 1 AS matches FROM orders, range((o_orderkey % 5) + 1)")
def find_by_path_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    deep = F.expr("repeat('<div class=\"x y\">', cast(o_orderkey % 5 + 1 as int))")
    page = o.select(F.col("o_orderkey").alias("page_id"), F.lit("https://a.example.com/").alias("url"), F.concat(deep, F.lit("<p>leaf")).alias("html"))
    return paths.find_by_path(P.node_table(P.parse_pages(page, links=False, fields=("tag", "classes", "path"))), "div.y p", repeat=True).select("page_id", "matches")


# --- reports
@query(f"SELECT url, coalesce(nullif({_TITLE}, ''), 'No title found') AS title, {_HOST} AS domain FROM pages")
def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.listing(P.titles(_parsed(spark, sf_dir, links=False, fields=("tag", "content"))))


@query(f"SELECT {_HOST} AS domain, '  - ' || url || ' (' || coalesce(nullif({_TITLE}, ''), 'No title') || ')' AS line FROM pages")
def prep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.prep_listing(P.titles(_parsed(spark, sf_dir, links=False, fields=("tag", "content"))))


# --- whole runs
@query(f"""WITH f AS ({_FRONTIER(crawl.BUDGET)}) SELECT p.url, coalesce(nullif({_TITLE}, ''), 'No title found') AS title, {_HOST.replace('url', 'p.url')} AS domain
FROM (SELECT DISTINCT url FROM f) u JOIN (SELECT url, arg_max(html, page_id) AS html FROM pages GROUP BY url) p USING (url)""")
def site_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.run(_table(spark, sf_dir, "pages")).report


@query(SQL["template_element_paths"])
def site_prep_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site.run(_cards(spark, sf_dir), prep=True).findings
    return found.select("domain", template_paths.path_text().alias("path"), "template_pattern")


@query(f"""WITH d AS (SELECT {_HOST} AS domain, url FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)),
l AS (SELECT d.domain, d.url AS initial, 'https://' || d.domain || h.href AS link, min(h.pos) AS pos FROM d JOIN ({_HREFS}) h ON h.page_id = (SELECT max(page_id) FROM pages p WHERE p.url = d.url) GROUP BY ALL),
r AS (SELECT domain, link AS url, row_number() OVER (ORDER BY pos) + 1 AS rank FROM l WHERE link <> initial AND link <> 'https://' || domain || '/'),
f AS (SELECT domain, url, 0 AS rank FROM d UNION ALL SELECT domain, 'https://' || domain || '/', 1 FROM d UNION ALL SELECT domain, url, rank FROM r WHERE rank < {crawl.BUDGET})
SELECT f.domain, f.url, f.rank::INT AS rank, CASE WHEN f.url IN (SELECT url FROM pages) THEN 'Success' ELSE 'Failed' END AS state FROM f""")
def site_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    first = p.orderBy("page_id").select("url").first()
    return site.run_from(p, first.url if first else "").urls.select("domain", "url", "rank", F.col("status.state").alias("state"))
