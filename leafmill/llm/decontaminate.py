"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are normalised to words (A-Z lower-cased, runs of digits, letters and
non-ASCII characters) and indexed by one automaton, whose states know which items they
occur in.  Every document's words stream through it once; at each word the automaton
gives the longest suffix read so far that some item holds.

A window is ``window`` consecutive words of an item, or the whole of a shorter one.  A
document's word is hit if it lies in an occurrence of a window.

Items are indexed in shards of at most ``SHARD_WORDS`` words, so that the driver never
holds the whole benchmark, and ``SHARDS`` of them at a time go to the workers, which
keep their automata, about 1 KB a word.  A larger benchmark takes several passes over the
documents; what the passes find is merged by document before anything is decided.

Defined cases: null or word-less texts have no words and no hits; null, empty or
repeated items are allowed (items without an item_id hit like others, count as one item
together and are left out of the digest); no items at all
leave every document clean; rows come out as they went in, ids null or repeated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, materialize, release, sliced, table

WINDOW = 13
#: Words of the items that the driver reads and sends at a time.
SHARD_WORDS = 200_000
#: Shards that go to the workers in one pass.
SHARDS = 2
#: A document with hits on at least one word in so many is contaminated.
COVERAGE = 20

_SPLIT = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_SPLIT).split() if text else []


class Automaton:
    """Generalised suffix automaton over words; ``items[s]`` are the items that hold state s's words."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set] = [set()]
        whole: list[int] = [0]  # the length of a short item that ends here, whole
        for key, words in items:
            if not words:
                continue
            last = 0
            for w in words:
                last = self._extend(last, w, ends, whole)
                ends[last].add(key)
            if len(words) < window:
                whole[last] = len(words)
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        for s in order:  # what ends in a state also ends in its suffixes
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.items = [frozenset(x) for x in ends]
        # the nearest suffix that is a whole short item, the state itself included
        self.whole = whole
        self.short = [0] * len(whole)
        for s in reversed(order):
            self.short[s] = s if whole[s] else self.short[self.link[s]]

    def _extend(self, last: int, w: bytes, ends: list[set], whole: list[int]) -> int:
        nxt, link, length = self.next, self.link, self.len

        def clone(of: int, size: int) -> int:
            nxt.append(dict(nxt[of])), link.append(link[of]), length.append(size), ends.append(set()), whole.append(0)
            return len(nxt) - 1

        def redirect(p: int, old: int, new: int) -> None:
            while p >= 0 and nxt[p].get(w) == old:
                nxt[p][w] = new
                p = link[p]

        if (q := nxt[last].get(w)) is not None:
            if length[q] == length[last] + 1:
                return q
            c = clone(q, length[last] + 1)
            link[q] = c
            redirect(last, q, c)
            return c
        nxt.append({}), link.append(0), length.append(length[last] + 1), ends.append(set()), whole.append(0)
        cur, p = len(nxt) - 1, last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                c = clone(q, length[p] + 1)
                link[q] = link[cur] = c
                redirect(p, q, c)
        return cur

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The hit words as (start, end) intervals, not merged, and the items whose windows occur."""
        nxt, link, length, window, short = self.next, self.link, self.len, self.window, self.short
        root, s, n = nxt[0], 0, 0
        found: list[tuple[int, int]] = []
        items: set = set()
        for i, w in enumerate(words):
            if s == 0:
                s = root.get(w, 0)
                if s == 0:
                    continue
                n = 1
            else:
                t = nxt[s].get(w)
                while t is None and s:
                    s = link[s]
                    n = length[s]
                    t = nxt[s].get(w)
                if t is None:
                    s = n = 0
                    continue
                s, n = t, n + 1
            if n >= window:
                v = s
                while length[link[v]] >= window:
                    v = link[v]
                items |= self.items[v]
                found.append((i + 1 - window, i + 1))
            v = short[s]
            while v and length[v] > n:  # the match stops within this state's words
                v = short[link[v]]
            best = 0
            while v:
                if self.whole[v] <= n:
                    items |= self.exact(v)
                    best = max(best, self.whole[v])
                v = short[link[v]]
            if best and n < window:
                found.append((i + 1 - best, i + 1))
        return found, items

    def exact(self, s: int) -> frozenset:
        """The short items that are, whole, the words of state s."""
        return self.owners.get(s, frozenset())

    owners: dict[int, frozenset]


def automaton(items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW) -> Automaton:
    items = [*items]
    a = Automaton(items, window)
    owners: dict[int, set] = {}
    for key, words in items:
        if 0 < len(words) < window:
            s = 0
            for w in words:
                s = a.next[s][w]
            owners.setdefault(s, set()).add(key)
    a.owners = {s: frozenset(x) for s, x in owners.items()}
    return a


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shards(benchmark: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in shards of bounded size, one shard on the driver at a time."""
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator()
    shard, size = [], 0
    for r in rows:
        words = words_of(bytes(r.text) if r.text is not None else None)
        if size and size + len(words) > SHARD_WORDS:
            yield shard
            shard, size = [], 0
        shard.append((None if r.item_id is None else str(r.item_id), words))
        size += len(words)
    if shard:
        yield shard


_BUILT: dict[tuple, list[Automaton]] = {}


def _automata(shards: list, window: int) -> list[Automaton]:
    """A worker's automata of all shards, built once; those of another benchmark go."""
    key = tuple(digest for digest, _ in shards)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [automaton(shard.value, window) for _, shard in shards]
    return _BUILT[key]


def _scanner(shards: list, window: int):
    """A function of a text that gives its words, merged hit intervals and items."""

    def scan(text: bytes | None, words: list[bytes] | None = None):
        words = words_of(text)
        spans, items = [], set()
        for a in _automata(shards, window):
            s, i = a.scan(words)
            spans += s
            items |= i
        return words, merged(spans), items

    return scan


def _passes(spark: SparkSession, benchmark: DataFrame, window: int) -> Iterator[list]:
    """The broadcast shards of each pass; at least one pass, and those of one are gone with the next."""
    shards, any_ = _shards(benchmark), False
    while group := [*islice(shards, SHARDS)]:
        sent = [(hashlib.sha256(repr((window, x)).encode()).hexdigest(), spark.sparkContext.broadcast(x)) for x in group]
        any_ = True
        yield sent
    if not any_:
        yield []


def _first_and_rest(passes: Iterator[list]) -> tuple[list, Iterator[list] | None]:
    first = next(passes)
    second = next(passes, None)
    return first, None if second is None else chain([first, second], passes)


def _report(words: int, spans: list[tuple[int, int]], items: Iterable[str | None], coverage: int) -> tuple:
    hit, keys = sum(b - a for a, b in spans), set(items)
    said = ",".join(sorted(x for x in keys if x is not None))
    return words, hit, len(keys), hashlib.sha256(said.encode()).hexdigest(), hit > 0 and coverage * hit >= words


_REPORT = (("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()))
_REPORT_SQL = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _reported(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    cols = [*zip(*rows, strict=True)] or [()] * len(_REPORT)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, (_, k) in zip(cols, _REPORT, strict=True))], names=["doc_id", *(n for n, _ in _REPORT)])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    first, more = _first_and_rest(_passes(docs.sparkSession, benchmark, window))
    if more is not None:
        rows = _numbered(docs.select("doc_id", "text"), "_row")
        both = rows.join(_found(rows, more, window), "_row", "left")

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for t, spans, items in zip(b.column("text"), b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
                    own = merged([(s["a"], s["b"]) for s in spans or ()])
                    out.append(_report(len(words_of(t.as_py())), own, items or (), coverage))
                yield _reported(b.column("doc_id"), out)

        return both.select("doc_id", F.col("text").cast("binary").alias("text"), "spans", "items").mapInArrow(sliced(told), f"doc_id {kind}, {_REPORT_SQL}")
    scan = _scanner(first, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                words, spans, items = scan(t.as_py())
                out.append(_report(len(words), spans, items, coverage))
            yield _reported(b.column("doc_id"), out)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(sliced(run), f"doc_id {kind}, {_REPORT_SQL}")


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` written with a number of each row in ``key``."""
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")


_SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _found(rows: DataFrame, passes: Iterable[list], window: int) -> DataFrame:
    """_row, spans and items of the rows in which any pass finds windows."""
    parts: list[DataFrame] = []
    for shards in passes:
        scan = _scanner(shards, window)

        def run(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(i, *scan(t.as_py())[1:]) for i, t in zip(b.column("_row").to_pylist(), b.column("text"), strict=True)]
                got = [x for x in got if x[1]]
                spans = pa.array([[{"a": p, "b": q} for p, q in x[1]] for x in got], _SPAN)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), spans, pa.array([[*x[2]] for x in got], pa.list_(pa.string()))], names=["_row", "spans", "items"])

        texts = rows.select("_row", F.col("text").cast("binary").alias("text"))
        parts.append(materialize(texts.mapInArrow(sliced(run), "_row bigint, spans array<struct<a:int,b:int>>, items array<string>"), "found"))
        for _, sent in shards:
            sent.destroy()
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    out = materialize(every.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")), "found")
    release(*parts)
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text with the words of the intervals cut out, a line break in their place."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return b"\n".join([*out, text[end:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """``docs`` with its own columns: rows over the coverage limit go, and hit spans are cut out of the others.

    A cut leaves a line break; cutting is repeated until no window occurs any more.
    """
    first, more = _first_and_rest(_passes(docs.sparkSession, benchmark, window))
    if more is not None:
        return _removed_in_passes(docs, benchmark, more, window, coverage)
    scan = _scanner(first, window)

    def cut(text: bytes) -> bytes | None:
        words, spans, _ = scan(text)
        if spans and coverage * sum(b - a for a, b in spans) >= len(words):
            return None
        while spans:
            text = _without(text, spans)
            _, spans, _ = scan(text)
        return text

    return docs.mapInArrow(sliced(_edited(lambda raw, _: cut(raw))), docs.schema)


def _edited(edit, given: str | None = None):
    """Batches with ``edit`` made to every text and ``given``'s value, a column that then goes; rows whose text becomes None go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            values = b.column(b.schema.get_field_index(given)).to_pylist() if given else [None] * b.num_rows
            keep, texts = [], []
            for i, (t, v) in enumerate(zip(b.column(at), values, strict=True)):
                raw = t.as_py()
                new = raw if raw is None else edit(raw.encode(), v)
                if raw is None or new is not None:
                    keep.append(i)
                    texts.append(raw if raw is None else new.decode())
            out = b.take(pa.array(keep, pa.int64()))
            out = out.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield out.select([c for c in b.schema.names if c != given])

    return run


def _removed_in_passes(docs: DataFrame, benchmark: DataFrame, passes: Iterable[list], window: int, coverage: int) -> DataFrame:
    key, cuts = free("_row", docs.columns), free("_cuts", docs.columns)
    rows, done, limit = _numbered(docs, key), None, coverage
    while True:
        found = _found(rows.select(F.col(key).alias("_row"), "text"), passes, window).select(F.col("_row").alias(key), F.col("spans").alias(cuts))
        clean = rows.join(found, key, "left_anti")
        done = clean if done is None else done.unionByName(clean)
        if found.isEmpty():
            return done.select(*docs.columns)
        own = limit

        def edit(text: bytes, said: list[dict], own=own) -> bytes | None:
            spans = merged([(s["a"], s["b"]) for s in said])
            over = own and own * sum(b - a for a, b in spans) >= len(words_of(text))
            return None if over else _without(text, spans)

        some = rows.join(found, key).select(*rows.columns, cuts)
        rows = materialize(some.mapInArrow(sliced(_edited(edit, cuts)), rows.schema), "numbered")
        passes, limit = _passes(docs.sparkSession, benchmark, window), 0  # coverage is judged on the whole text


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
