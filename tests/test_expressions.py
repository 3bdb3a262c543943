import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import templates as T
from leafmill.functions import urls as U
from leafmill.operators import crawl, duplicates, paths, template_paths
from leafmill.sources import pages as P


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_urls(spark):
    urls = ["https://example.com/path", "http://Sub.example.com", "invalid-url", "https://u:p@a.b:8080/x", "mailto:a@b", None, ""]
    assert column(spark, urls, U.host) == ["example.com", "sub.example.com", None, "a.b", None, None, None]
    said = ["https://example.com", "http://example.com/path", "example.com", "  example.com  ", "invalid..domain", "://invalid", None]
    assert column(spark, said, U.input_domain) == ["example.com"] * 4 + ["invalid..domain", None, None]
    with pytest.raises(Exception, match="Invalid domain or URL"):
        column(spark, ["://invalid"], U.checked_input_domain)
    assert column(spark, ["example.com", "EXAMPLE.com"], U.root_url) == ["https://example.com/"] * 2
    root = ["https://example.com", "https://example.com/", "http://example.com", "https://example.com/path", "https://example.com/?q=1", "https://example.com/#f", "invalid-url"]
    assert column(spark, root, U.is_root_url) == [True, True, True, False, False, False, False]
    same = ["https://example.com/p", "https://sub.example.com/p", "https://other.com/p", "https://notexample.com/p"]
    assert column(spark, same, lambda c: U.same_domain(c, F.lit("example.com"))) == [True, True, False, False]
    hrefs = {"/page1": "https://example.com/page1", "https://other.com/p": "https://other.com/p", "//example.com/p": "https://example.com//example.com/p", "p": "https://example.com/p", "#t": "https://example.com/#t", "mailto:a@b.c": "https://example.com/mailto:a@b.c", "HTTP://x": "https://example.com/HTTP://x"}
    assert column(spark, hrefs, lambda c: U.resolve(c, F.lit("example.com"))) == [*hrefs.values()]


def test_clean_text(spark):
    got = {"  hello   world  ": "hello world", "line1\n  line2  \n\nline3": "line1 line2 line3", "": "", "   \n  \n  ": "", "a  b": "a b"}
    assert column(spark, got, U.clean_text) == [*got.values()]


TEMPLATES = {
    "42 comments": "{count} comments", "16 hours ago": "{time} hours ago", "1 minute ago": "{time} minute ago", "4.5 hours ago": "{value} hours ago",
    "123 likes": "{count} likes", "7 replies": "{count} replies", "999 points": "{count} points", "Posted 2 hours ago by user123": "Posted {time} hours ago by user123",
    "Page 5 of 100": "Page {count} of 100", "42 COMMENTS": "{count} COMMENTS", "16 Hours Ago": "{time} Hours Ago", "  42   comments  ": "{count}   comments",
    "16\thours\tago": "{time}\thours\tago", "1.2k views": "{count}.2k views", "10 upvotes": "{count} upvotes", "Hello world": None, "Just text": None, "42": None,
    "Random 123 text": None, "": None, "just now": None, "4.5 stars": None, "42 comments,": "{value} comments,", "foo   42 comments": "foo   {value} comments",
    "of-5 and 6 apples": "of-5 and {value1} apples", "In 2024 one of us": "In {value} one of us", "3 foo ago": "{time} foo ago", "item 7 of 9": "item {count} of 9",
    "3.14.15 hours": "{value}.15 hours", "1 of 2.5 and 3.5": "1 of {value} and 3.5",
}


def test_templates(spark):
    df = spark.createDataFrame([(k,) for k in TEMPLATES] + [(None,)], "content string")
    got = {r.content: r for r in T.with_templates(df).collect()}
    assert {k: got[k].template_pattern for k in TEMPLATES} == TEMPLATES
    assert got[None].template_pattern is None
    assert got["4.5 hours ago"].template_type == "Float" and got["42 comments"].template_type == "Number"
    assert {r.content for r in T.apply_templates(df.filter("content in ('just now', '7 replies')")).collect()} == {"just now", "{count} replies"}


def slow_template(text):
    """The same rules, candidate by candidate."""
    text = text.strip()
    signs = {*T.TIME, *T.COUNT, *T.INDICATORS}
    clean = lambda w: re.sub(r"^[^a-z]+|[^a-z]+$", "", w.lower())
    for rx, is_float in ((r"\b\d+\.\d+\b", True), (r"\b\d+\b", False)):
        for i, m in enumerate(re.finditer(rx, text)):
            name, words, pos = f"value{i or ''}", text.split(), 0
            for k, w in enumerate(words if not is_float else ()):
                if pos <= m.start() < pos + len(w):
                    n1, n2 = (words[k + j].lower() if k + j < len(words) else "" for j in (1, 2))
                    before = words[k - 1].lower() if k else ""
                    name = "time" if n1 in T.TIME else "count" if n1 in T.COUNT else "time" if n2 == "ago" and n1 else "count" if before in ("page", "item") else name
                    break
                pos += len(w) + 1
            new = f"{text[: m.start()]}{{{name}}}{text[m.end() :]}"
            if len(new.split()) > 1 and any(clean(w) in signs for w in new.split()):
                return new
    return None


def test_templates_against_slow(spark):
    import random

    r = random.Random(4)
    parts = ["5", "12", "3.5", "of", "of-5", "ago", "page", "item", "hours", "comments", "x7", "(likes)", "1.2.3", "7-of", "foo", "9,", "per"]
    texts = sorted({r.choice(["", " "]) + r.choice([" ", "  "]).join(r.choices(parts, k=r.randint(1, 6))) for _ in range(1500)})
    got = {x.content: x.template_pattern for x in T.with_templates(spark.createDataFrame([(t,) for t in texts], "content string")).collect()}
    assert {t: got[t] for t in texts} == {t: slow_template(t) for t in texts}


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_duplicates_and_mask(spark):
    p = pages(spark, *[(f"https://example.com/{n}", f'<nav class="navbar">Navigation</nav><div class="content">Page {n} content</div>') for n in (1, 2)], ("https://one.org/", "<p>x</p><p>x</p>"), ("https://b.org/1", "<ul><li>x</li><li>x</li></ul>"), ("https://b.org/2", "<p>y</p>"), (None, "<p>y</p>"), ("https://b.org/3", None))
    d = duplicates.domain_duplicates(p)
    assert {(r.domain, r.tag, r.content, r.occurrences) for r in d.collect()} == {("example.com", "nav", "Navigation", 2), ("b.org", "li", "x", 2)}
    s = {r.domain: (r.analyzed, r.n_duplicates) for r in duplicates.domain_summary(p, d).collect()}
    assert s == {"example.com": (True, 1), "one.org": (False, None), "b.org": (True, 1)}
    nodes = P.node_table(P.parse_pages(p))
    masked = duplicates.mask_duplicates(nodes, d)
    assert masked.count() == nodes.count()
    assert {r.content for r in masked.filter("domain = 'example.com' and tag in ('nav', 'div')").collect()} == {duplicates.MASK, "Page 1 content", "Page 2 content"}
    assert duplicates.merge_duplicates(d, d).count() == d.count()


def test_template_duplicates(spark):
    page = '<div class="comments">{} comments</div><div class="timestamp">{} hours ago</div><div class="likes">{} likes</div>'
    p = pages(spark, ("https://e.com/1", page.format(42, 2, 123)), ("https://e.com/2", page.format(16, 5, 89)))
    nodes = P.node_table(P.parse_pages(p))
    assert duplicates.signature_counts(nodes).count() == 0
    assert {r.content for r in duplicates.signature_counts(template_paths.normalized(nodes)).collect()} == {"{count} comments", "{time} hours ago", "{count} likes"}
    found = template_paths.template_paths(nodes)
    assert found.count() == 3
    assert '"template_pattern"' in template_paths.paths_json(found).first().json


def test_paths(spark):
    p = pages(spark, ("https://e.com/1", "<div><div><p>x</p></div></div><table><tr class='athing submission'><td class=title>First<tr class=athing><td class=title>Second</table>"))
    n = P.node_table(P.parse_pages(p))
    find = lambda q, **k: paths.find_by_path(n, q, **k)
    assert find("div p", repeat=True).count() == 2 and find("div p").first().matches == 2
    assert [r.content for r in find("html body table tbody tr.athing.submission td.title").collect()] == ["First"]
    assert find("html body").count() == 1
    assert all(find(q).count() == 0 for q in ("", "div.none", "tr.", ".athing", "td.athing"))


def test_store_and_frontier(spark):
    u = spark.createDataFrame([("https://example.com",), ("https://example.com",), ("https://example.org",), ("mailto:a@b",), (None,)], "url string")
    store = crawl.new_urls(u)
    assert store.count() == 3 and crawl.by_domain(store, "unknown").count() == 1
    assert crawl.lookup(store, "mailto:a@b").count() == 0 and crawl.lookup(store, "https://example.org").count() == 1
    assert crawl.add_urls(store, u.union(spark.createDataFrame([("https://example.com/new",)], "url string"))).count() == 1
    done = crawl.update_status(store, F.col("url") == "https://example.org", crawl.status("Success"))
    assert [r.url for r in crawl.completed(done).collect()] == ["https://example.org"]
    p = pages(spark, ("https://e.com/", "".join(f"<a href='{h}'>l</a>" for h in ("/a", "/a", "https://x.org/", "https://s.e.com/q", "/", "b", "c"))), ("https://e.com/a", None))
    f = crawl.frontier(P.parse_pages(crawl.root_pages(p), with_path=False))
    assert [(r.url, r["rank"]) for r in f.orderBy("rank").collect()] == [("https://e.com/", 0), ("https://e.com/a", 1), ("https://s.e.com/q", 2)]
    assert {r.url: r.status.state for r in crawl.fetch(f, p).collect()} == {"https://e.com/": "Success", "https://e.com/a": "Failed", "https://s.e.com/q": "Failed"}


def test_stream(spark, tmp_path):
    from leafmill.streaming.duplicates import streaming_duplicates

    pages(spark, ("https://e.com/1", "<p>x</p>"), ("https://e.com/2", "<p>x</p>")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("page_id long, url string, html string").parquet(str(tmp_path / "in"))
    q = streaming_duplicates(s).writeStream.outputMode("complete").format("memory").queryName("dups").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.tag, r.occurrences) for r in spark.table("dups").collect()] == [("p", 2)]


def test_site(spark):
    from leafmill.plans import site

    root = "<title>Home</title><nav>Menu</nav><a href='/a'>a</a><a href='/b'>b</a><a href='/c'>c</a>"
    p = pages(spark, ("https://e.com/", root), ("https://e.com/a", "<nav>Menu</nav><p>3 comments</p>"), ("https://e.com/c", "<p>x</p>"), ("https://o.org/", "<p>5 likes</p>"))
    s = site.run(p, ["https://e.com/anything", "not a domain"])
    assert {(r.url, r.status.state) for r in s.urls.collect()} == {("https://e.com/", "Success"), ("https://e.com/a", "Success"), ("https://e.com/b", "Failed")}
    assert [(r.tag, r.content) for r in s.findings.collect()] == [("nav", "Menu")]
    assert {(r.url, r.title) for r in s.report.collect()} == {("https://e.com/", "Home"), ("https://e.com/a", "No title found")}
    prep = site.run(p, prep=True)
    assert {(r.domain, r.template_pattern) for r in prep.findings.collect()} == {("e.com", "{count} comments"), ("o.org", "{count} likes")}
    # the URL and its root are both visited, and compared
    one = site.run_from(p, "https://e.com/a")
    assert [(r.url, r["rank"], r.status.state) for r in one.urls.orderBy("rank").collect()] == [("https://e.com/a", 0, "Success"), ("https://e.com/", 1, "Success")]
    assert [(r.tag, r.content, r.occurrences) for r in one.findings.collect()] == [("nav", "Menu", 2)]
    far = site.run_from(p, "https://e.com/gone")
    assert [r.url for r in far.urls.orderBy("rank").collect()] == ["https://e.com/gone", "https://e.com/", "https://e.com/a"]
    assert site.run_from(p, "no url").urls.count() == 0


def test_a_url_counts_once(spark):
    p = spark.createDataFrame([(1, "https://e.com/1", "<nav>Old</nav>"), (2, "https://e.com/1", "<nav>Menu</nav>"), (3, "https://e.com/2", "<p>x</p>"), (3, "https://e.com/2", "<p>x</p>"), (None, "https://e.com/2", "<p>y</p>"), (4, None, "<p>x</p>")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.html) for r in duplicates.current(p).collect()) == [(2, "<nav>Menu</nav>"), (3, "<p>x</p>")]
    assert duplicates.domain_duplicates(p).count() == 0
    assert duplicates.domain_duplicates(p.limit(0)).count() == 0


def test_templates_of_pages_without_a_host(spark):
    p = spark.createDataFrame([(1, None, "<p>3 likes</p>"), (1, None, "<p>4 likes</p><p>5 views</p>"), (2, "x", "<p>6 likes</p>")], "page_id long, url string, html string")
    got = template_paths.normalized(P.parse_pages(p)).filter("tag = 'p'")
    assert sorted((r.page_id, r.content) for r in got.collect()) == [(1, "{count} likes"), (1, "{count} likes"), (1, "{count} views"), (2, "{count} likes")]
    assert got.filter("content = '{count} likes'").select("sig").distinct().count() == 1 and got.select("sig").distinct().count() == 2


def test_html_data(spark):
    store = crawl.new_urls(spark.createDataFrame([("https://e.com/1",), ("https://e.com/2",)], "url string"))
    got = crawl.set_html_data(store, spark.createDataFrame([("https://e.com/1", "<p>", "T")], "url string, html_source string, title string"))
    assert got.columns == store.columns
    assert {(r.url, r.html_source, r.title, r.status.state) for r in got.collect()} == {("https://e.com/1", "<p>", "T", "Pending"), ("https://e.com/2", None, None, "Pending")}


def test_asked_for_fields(spark):
    p = pages(spark, ("https://e.com/1", "<div class=a><p>x 1</p><p>y</p></div>"))
    all_, some = P.node_table(P.parse_pages(p)), P.node_table(P.parse_pages(p, fields=("content", "path"), paths="digits"))
    assert some.columns == ["page_id", "url", "domain", "content", "path"]
    want = {(r.content, str(r.path) if "1" in r.content else "None") for r in all_.collect()}
    assert {(r.content, str(r.path)) for r in some.collect()} == want
    assert P.parse_pages(p, fields=()).columns == ["page_id", "url", "domain", "hrefs"]
