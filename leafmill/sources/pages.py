"""Pages to nodes and links: the only step that leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host
from ..staging import spread
from .htmltree import Element, parse

# Elements without a tree of their own.
IGNORED = frozenset("script style noscript svg path img video audio canvas embed object iframe".split())
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_WHITE}]+")
_PRIME = (1 << 127) - 1
_BASE = 0x5A17C3E9_41B6D2F8_0F3C9A75_2E8B6D11 % _PRIME
_BASE_INV = pow(_BASE, -1, _PRIME)

PART = "struct<tag:string,classes:array<string>>"
_PART = pa.struct([("tag", pa.string()), ("classes", pa.list_(pa.string()))])
#: A node's fields, their SQL types and their Arrow types.
FIELDS = {
    **{k: ("int", pa.int32()) for k in ("pre", "parent", "depth", "ord", "size")},
    "tag": ("string", pa.string()), "classes": ("array<string>", pa.list_(pa.string())), "id": ("string", pa.string()), "content": ("string", pa.string()),
    "sig": ("string", pa.string()), "path": (f"array<{PART}>", pa.list_(_PART)),
}
#: Pages whose trees a worker holds at a time.
PAGES = 32


def clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def _texts(e: Element) -> str:
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x.kids))
    return " ".join(out)


def columns_of(root: Element) -> dict[str, list]:
    """The kept elements in pre-order, a list for each field, without signatures and paths.

    An element is kept if it is the root, or not ignored and not blank.  Only elements
    without kept children have content: all text below them, collapsed.
    """
    kept: dict[int, list[Element]] = {}
    content: dict[int, str] = {}
    todo: list[tuple[Element, bool]] = [(root, False)]
    alive: set[int] = set()
    while todo:  # children first, without recursion: pages may nest deeply
        e, seen = todo.pop()
        if not seen:
            todo.append((e, True))
            todo.extend((k, False) for k in e.kids if not isinstance(k, str) and k.tag not in IGNORED)
            continue
        kids = [k for k in e.kids if not isinstance(k, str) and id(k) in alive]
        kept[id(e)], content[id(e)] = kids, "" if kids else clean(_texts(e))
        if kids or content[id(e)] or e is root:
            alive.add(id(e))
    out: dict[str, list] = {k: [] for k in FIELDS if k not in ("sig", "path")}
    stack: list[tuple[Element, int | None, int, int]] = [(root, None, 0, 0)]
    while stack:
        e, parent, depth, order = stack.pop()
        pre, own = len(out["pre"]), e.attrs.get("class")
        classes = [c for c in _SPACE.split(own) if c] if own else []
        for k, v in zip(out, (pre, parent, depth, order, 1, e.tag, classes, clean_edges(e.attrs.get("id", "")) or None, content[id(e)]), strict=True):
            out[k].append(v)
        stack.extend((k, pre, depth + 1, i) for i, k in reversed([*enumerate(kept[id(e)])]))
    sizes = out["size"]
    for pre in range(len(sizes) - 1, 0, -1):
        sizes[out["parent"][pre]] += sizes[pre]
    return out


def chains(parents: list[int | None]) -> Iterator[list[int]]:
    """Each node's ancestors and itself, from the root."""
    above: list[int] = []
    depth: list[int] = []
    for pre, parent in enumerate(parents):
        depth.append(0 if parent is None else depth[parent] + 1)
        del above[depth[pre] :]
        above.append(pre)
        yield above


def nodes_of(root: Element, with_path: bool = True) -> list[dict]:
    """The kept elements in pre-order, as ``columns_of`` has them, with signatures and, if asked for, paths."""
    c = columns_of(root)
    c["sig"] = signatures(c)
    parts = [{"tag": t, "classes": k} for t, k in zip(c["tag"], c["classes"], strict=True)]
    c["path"] = [[parts[i] for i in chain] for chain in chains(c["parent"])] if with_path else [None] * len(parts)
    return [dict(zip(c, row, strict=True)) for row in zip(*c.values(), strict=True)]


def clean_edges(s: str) -> str:
    return s.strip(_WHITE)


def signatures(c: dict[str, list]) -> list[str]:
    """A signature of each node's flat pre-order list of (tag, classes, id, content), itself included.

    It is a polynomial hash over the list, taken from sums over prefixes, so that deep
    pages cost no more than flat ones.
    """
    sums, powers, inverse = [0], 1, [1]
    for own in zip(c["tag"], c["classes"], c["id"], c["content"], strict=True):
        digest = blake2b(repr(own).encode("utf-8", "surrogatepass"), digest_size=15).digest()
        sums.append((sums[-1] + (int.from_bytes(digest) + 1) * powers) % _PRIME)
        powers = powers * _BASE % _PRIME
        inverse.append(inverse[-1] * _BASE_INV % _PRIME)
    return [f"{(sums[a + n] - sums[a]) * inverse[a] % _PRIME:032x}" for a, n in enumerate(c["size"])]


def hrefs_of(root: Element) -> list[str]:
    """Every ``a[href]`` of the whole tree, in document order."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            continue
        if e.tag == "a" and "href" in e.attrs:
            out.append(e.attrs["href"])
        todo.extend(reversed(e.kids))
    return out


_DIGIT = re.compile(r"\d")


def _arrays(trees: list[dict[str, list]], fields: list[str], paths: str) -> pa.Array:
    """The pages' node lists as one Arrow array of the asked-for fields."""
    flat: dict[str, pa.Array] = {}
    for k in fields:
        if k not in ("sig", "path"):
            flat[k] = pa.array([x for c in trees for x in c[k]], FIELDS[k][1])
    if "sig" in fields:
        flat["sig"] = pa.array([x for c in trees for x in signatures(c)], pa.string())
    if "path" in fields:
        part = pa.StructArray.from_arrays([flat.get("tag", pa.array([x for c in trees for x in c["tag"]], pa.string())), flat.get("classes", pa.array([x for c in trees for x in c["classes"]], pa.list_(pa.string())))], fields=[*_PART])
        starts: list[int | None] = []
        chosen: list[int] = []
        first = 0
        for c in trees:
            for chain, content in zip(chains(c["parent"]), c["content"], strict=True):
                here = paths == "all" or _DIGIT.search(content) is not None
                starts.append(len(chosen) if here else None)
                if here:
                    chosen.extend(first + i for i in chain)
            first += len(c["pre"])
        flat["path"] = pa.ListArray.from_arrays(pa.array([*starts, len(chosen)], pa.int32()), part.take(pa.array(chosen, pa.int64())))
    offsets = [0]
    for c in trees:
        offsets.append(offsets[-1] + len(c["pre"]))
    nodes = pa.StructArray.from_arrays([flat[k] for k in fields], fields=[pa.field(k, FIELDS[k][1]) for k in fields])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)


def parse_pages(pages: DataFrame, with_path: bool = True, links: bool = True, keep: Column | None = None, fields: Iterable[str] | None = None, paths: str = "all") -> DataFrame:
    """page_id, url, domain, nodes (pre-order) and hrefs of each page; a null html is an empty page.

    ``fields``: what a node holds, so that nothing else is computed or leaves Python; all
    of ``FIELDS`` by default, or all but the path without ``with_path``; no nodes at all if
    it is empty.  ``paths="digits"``: only nodes whose content has a digit have a path.
    ``keep``: a condition on page_id, url and domain; pages that fail it aren't parsed.
    """
    p = pages.select("page_id", "url", host(F.col("url")).alias("domain"), "html")
    if keep is not None:
        p = p.filter(keep)
    p = spread(p)
    own = [k for k in FIELDS if (k in set(fields) if fields is not None else with_path or k != "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, PAGES):
                b = big.slice(at, PAGES)
                roots = [parse(t.as_py()) for t in b.column("html")]
                cols = [b.column(c) for c in ("page_id", "url", "domain")]
                if own:
                    cols.append(_arrays([columns_of(r) for r in roots], own, paths))
                cols.append(pa.array([hrefs_of(r) if links else [] for r in roots], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "domain", *(["nodes"] if own else []), "hrefs"])

    kind = pages.schema["page_id"].dataType.simpleString()
    nodes = f"nodes array<struct<{','.join(f'{k}:{FIELDS[k][0]}' for k in own)}>>, " if own else ""
    return p.mapInArrow(run, f"page_id {kind}, url string, domain string, {nodes}hrefs array<string>")


def node_table(parsed: DataFrame) -> DataFrame:
    """One row a node: page_id, url, domain and the node's fields."""
    return parsed.select("page_id", "url", "domain", F.inline("nodes"))


def titles(parsed: DataFrame) -> DataFrame:
    """page_id, url, domain, title: the content of the first ``title`` that has any, else null."""
    first = F.get(F.filter("nodes", lambda n: (n["tag"] == "title") & (n["content"] != "")), F.lit(0))
    return parsed.select("page_id", "url", "domain", first["content"].alias("title"))
