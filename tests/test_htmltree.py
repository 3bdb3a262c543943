import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


from leafmill.sources.htmltree import parse
from leafmill.sources.pages import hrefs_of, nodes_of


def shown(text):
    return [(n["tag"], n["content"]) for n in nodes_of(parse(text)) if n["tag"] not in ("html", "body", "head")]


@pytest.mark.parametrize(
    ("text", "nodes"),
    [
        ("<h1>Title</h1><p>Content</p>", [("h1", "Title"), ("p", "Content")]),
        ("<script>alert('test');</script><p>Content</p>", [("p", "Content")]),
        ("<div></div><p>Content</p>", [("p", "Content")]),
        ('<div class="a" id="b"></div><p>x</p>', [("p", "x")]),
        ("<p>Hello <b>x</b></p>", [("p", ""), ("b", "x")]),
        ("<div><script>s()</script></div>", [("div", "s()")]),
        ("<p>a<br>b<!-- c -->d</p>", [("p", "a b d")]),
        ("<p><b>one<br><p>two</p>", [("p", ""), ("b", "one"), ("p", ""), ("b", "two")]),
        ("<ul><li>a<li>b</ul>", [("ul", ""), ("li", "a"), ("li", "b")]),
        ("<table>x<tr><td>y</table>", [("table", ""), ("tbody", ""), ("tr", ""), ("td", "y")]),
        ("<title>a &amp; b</title>", [("title", "a & b")]),
    ],
)
def test_trees(text, nodes):
    assert shown(text) == nodes


def test_attributes():
    (n,) = [n for n in nodes_of(parse('<div class=" container  main" class=x id=" content ">Text</div>')) if n["tag"] == "div"]
    assert n["classes"] == ["container", "main"] and n["id"] == "content" and n["content"] == "Text"
    assert hrefs_of(parse('<a href="/x?a=1&amp;b=2"><svg><a href=y>')) == ["/x?a=1&b=2", "y"]


def test_flat_signatures():
    sig = lambda t: next(n["sig"] for n in nodes_of(parse(t)) if n["tag"] == "div")
    assert sig('<div class=c><p>1</div>') != sig("<div class=c><p>2</div>")
    assert sig("<div><p>1</p></div>x") == sig("y<div><p>1</p></div>")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<a href=x>", "</a>", "<div>", "</div>", "t", " ", "<", "<!--", "-->", "&lt;", "<script>", "</script>"]), max_size=25))
def test_invariants(parts):
    nodes = nodes_of(parse("".join(parts)))
    assert nodes[0]["tag"] == "html" and nodes[0]["size"] == len(nodes)
    for n in nodes:
        below = nodes[n["pre"] + 1 : n["pre"] + n["size"]]
        assert bool(below) == (n["size"] > 1)
        assert not (below and n["content"])  # only leaves have content
        assert n["pre"] == 0 or below or n["content"]  # nothing blank but the root
        assert all(b["depth"] > n["depth"] for b in below)
        assert "  " not in n["content"] and n["content"] == n["content"].strip()
        assert len(n["path"]) == n["depth"] + 1


def test_deep_page():
    assert len(nodes_of(parse("<div>" * 3000 + "x"), with_path=False)) == 3002


def test_depth_costs_nothing_extra():
    began = time.time()
    root = parse("<div>" * 20_000 + "x")
    assert time.time() - began < 5  # minutes, if every element looked through the open ones
    assert len(nodes_of(root, with_path=False)) == 20_002
