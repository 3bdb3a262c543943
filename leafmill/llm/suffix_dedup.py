"""Passages that repeat, by a sparse suffix array over minimiser positions.

A text's words are hashed.  Of every ``LEAST`` consecutive words (a window) the
smallest hash of ``GRAM`` words is the window's minimiser; only suffixes that start at a
minimiser are retained, about one in eighteen.  Equal windows have equal minimisers at
equal places, so every repeat of ``LEAST`` words shows up among the retained suffixes.

1. Suffixes are ordered by their first ``GRAM`` words; those without an equal neighbour
   go.
2. Each suffix is extended left and right to all windows that it is the minimiser of.
   Neighbours that are equal over this whole stretch repeat as a whole.
3. Where a match ends within the stretch, one suffix of each different stretch is
   extended window by window, and equal neighbours are sought among these.

The ordering is by hash, so equal neighbours meet as equal keys of an aggregate that
folds on the map side: a passage that a third of all documents hold costs a row a task.

Result: the words of each document that lie in a window that occurs twice or more,
anywhere, in the same document included.

Defined cases: null texts have no words; texts of fewer than ``LEAST`` words have no
window; rows with a null doc_id come out without spans and aren't searched; rows that
share a doc_id count as occurrences of their own and share their spans; other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, materialize, sliced, table
from .shingles import grams, mixed, word_hashes, words_of

LEAST = 50
GRAM = 16
#: Up to so many ids (8 bytes each) are broadcast to pick documents before their texts are shuffled.
BROADCAST_IDS = 500_000
_R = np.uint64(0x5851F42D4C957F2D)
_R_INV = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


class Stretches:
    """Hashes of any stretch of a text's words, from sums over its prefixes."""

    def __init__(self, h: np.ndarray) -> None:
        n = len(h)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _R)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _R_INV)]), dtype=np.uint64)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64)).view(np.int64)


def _running_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` neighbours, by doubling."""
    out, done = x, 1
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def minimisers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, last window, place) of each minimiser; windows by their first word."""
    g = grams(h, GRAM)
    # the leftmost place of the minimum: the first at or after the window's start that holds it
    order = np.argsort(g, kind="stable")
    value = np.empty(len(g), np.int64)
    value[order] = np.cumsum(np.concatenate([[0], g[order][1:] != g[order][:-1]]))  # ranks, equal ones equal
    size = np.int64(len(g) + 1)
    key = value[order] * size + order
    low = _running_min(value, LEAST - GRAM + 1)
    place = order[np.searchsorted(key, low * size + np.arange(len(low)))]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([starts[1:], [len(low)]]) - 1
    return g[place[starts]].view(np.int64), starts, last, place[starts]


def suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, gram, stretch, a, b of every retained suffix, and one row a document with a null gram and its words in a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]

            def put(doc: int | None, n: int, own: tuple | None, cols: list[list] = cols) -> None:
                m = 0 if own is None else len(own[0])
                ids = pa.array([doc], pa.int64())
                cols[0].append(pa.concat_arrays([ids] * (m + 1)) if m < 4 else pa.array([doc] * (m + 1), pa.int64()))
                none = pa.array([None], pa.int64())
                cols[1].append(none if own is None else pa.concat_arrays([none, pa.array(own[0])]))
                cols[2].append(none if own is None else pa.concat_arrays([none, pa.array(own[1])]))
                cols[3].append(pa.array([n], pa.int64()) if own is None else pa.array(np.concatenate([[n], own[2]]).astype(np.int64)))
                cols[4].append(none if own is None else pa.concat_arrays([none, pa.array(own[3].astype(np.int64))]))

            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                h = word_hashes(words_of(t.as_py()))
                if doc is None or len(h) < LEAST:
                    put(doc, len(h), None)
                else:
                    gram, a, b, _ = minimisers(h)
                    put(doc, len(h), (gram, Stretches(h).of(a, b + LEAST), a, b))
            arrays = [pa.concat_arrays(c) if c else pa.array([], pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "gram", "stretch", "a", "b"])

    return _texts(docs).mapInArrow(sliced(run), "doc_id bigint, gram bigint, stretch bigint, a bigint, b bigint")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, hash, doc_id, at, c of all windows of the wanted (doc_id, gram, stretch, a, b, c) stretches."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "stretch", "a", "b", "c")).alias("own"))
    ids = wanted.select("doc_id").distinct()
    texts = _texts(docs)
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
            for doc, t, own in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("own"), strict=True):
                h = word_hashes(words_of(t.as_py()))
                s = own.values
                gram, stretch, a, b, c = (s.field(x).to_numpy() for x in ("gram", "stretch", "a", "b", "c"))
                fits = b + LEAST <= len(h)
                sums = Stretches(h)
                # of rows that share an id, only that whose text it is
                fits[fits] = sums.of(a[fits], b[fits] + LEAST) == stretch[fits]
                gram, a, b, c = gram[fits], a[fits], b[fits], c[fits]
                n = b - a + 1
                at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
                for o, x in zip(out, (np.repeat(gram, n), sums.of(at, at + LEAST), np.full(len(at), doc), at, np.repeat(c, n)), strict=True):
                    o.append(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["gram", "hash", "doc_id", "at", "c"])

    return texts.join(by_doc, "doc_id").mapInArrow(sliced(run), "gram bigint, hash bigint, doc_id bigint, at bigint, c bigint")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeated, spans (start:end in words, by start) of each row of ``docs`` (doc_id, text)."""
    all_ = materialize(suffixes(docs), "suffixes")
    kept = all_.filter("gram is not null")
    met = kept.groupBy("gram").agg(F.count("*").alias("c"), (F.min("stretch") != F.max("stretch")).alias("differ")).filter("c > 1")
    met, n = materialize(met, "grams"), kept.count()
    near = materialize(join_skewed(kept, met, ["gram"], "c", n), "neighbours")
    parts = near.filter("differ").groupBy("gram", "stretch").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "a", "b")).alias("r"))
    parts = materialize(parts.select("gram", "stretch", "c", "r.doc_id", "r.a", "r.b"), "stretches")
    whole = near.filter("not differ").select("doc_id", "a", "b")
    common = parts.filter("c > 1").select("gram", "stretch", "c")
    again = join_skewed(near.filter("differ"), common, ["gram", "stretch"], "c", n, "left_semi").select("doc_id", "a", "b")
    windows = materialize(_windows(docs, parts), "windows")
    once = windows.filter("c = 1")
    twice = windows.groupBy("gram", "hash").agg(F.sum("c").alias("s"), F.count_if(F.col("c") == 1).alias("k")).filter("s > 1 and k > 0")
    twice = materialize(twice.select("gram", "hash", "k"), "repeats")
    edge = join_skewed(once, twice, ["gram", "hash"], "k", once.count(), "left_semi").select("doc_id", F.col("at").alias("a"), F.col("at").alias("b"))
    spans = whole.unionByName(again).unionByName(edge).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("s"))
    rows = all_.filter("gram is null").select("doc_id", F.col("a").alias("n_words"))
    joined = rows.join(spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, said = [], []
            for s in batch.column("s"):
                merged: list[list[int]] = []
                for x in s.as_py() or ():
                    if merged and x["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["b"] + LEAST)
                    else:
                        merged.append([x["a"], x["b"] + LEAST])
                counts.append(sum(b - a for a, b in merged))
                said.append(",".join(f"{a}:{b}" for a, b in merged))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(counts, pa.int64()), pa.array(said, pa.string())], names=["doc_id", "n_words", "n_repeated", "spans"])

    return joined.mapInArrow(sliced(run), "doc_id bigint, n_words bigint, n_repeated bigint, spans string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))
