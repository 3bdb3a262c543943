"""Nearest neighbours by inner product, with a robust-pruned graph a shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of their id; every vector
is indexed.  A shard's graph is built by inserting batches: a greedy beam search in the
graph so far proposes neighbours, and relaxed pruning keeps a candidate only if no kept
one is ``ALPHA`` times nearer to it than the inserted vector is, so that edges stay few
and diverse.  Edges are added in both directions and pruned alike.  Equal vectors of a shard
are one node, which carries their ids: as nodes of their own they would prune each other's
edges away and be out of reach.

Largest inner product becomes smallest distance by one further coordinate, which makes
all vectors of a shard equally long.

Queries go through every shard in blocks: a beam search proposes neighbours, their
scores are computed in double precision from the original vectors, nodes give their ids,
and the shards' best are merged.

How wide a shard's beam must be is measured when it is indexed: ``SAMPLE`` of its own
vectors are searched with wider and wider beams until the share of their true ``NEAREST``
found is ``RECALL``.  A shard for which no beam narrower than an eighth of it is enough
(much noise in many dimensions) is scored whole instead, as all are with ``exact``.

Defined cases: vectors that are null, zero, or hold a null or a non-finite component
take no part, as candidates or queries, nor do rows without an id or of another
dimension than ``dimension`` (the commonest one by default); of rows with equal ids and
vectors one counts; rows with equal ids and different vectors are candidates of their
own, but never of a query with that id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SHARD_ROWS = 8192
#: Edges from a vector, beam widths of building and searching, and the pruning's slack.
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
#: The beam is measured on so many of a shard's vectors, for this share of so many nearest ones.
SAMPLE = 48
NEAREST = 20
RECALL = 0.97
#: Queries in a block, and vectors that are inserted together at most.
BLOCK = 2048
BATCH = 512


def _sq(x: np.ndarray) -> np.ndarray:
    return np.einsum("...d,...d->...", x, x)


def lifted(x: np.ndarray) -> np.ndarray:
    """The vectors with a coordinate that makes them equally long."""
    n = _sq(x)
    return np.concatenate([x, np.sqrt(np.maximum(n.max(initial=0) - n, 0))[:, None]], 1).astype(np.float32)


class Graph:
    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, edges: np.ndarray | None = None, seed: int = 5) -> None:
        self.x, self.norm, self.degree, self.alpha = x, _sq(x), degree, alpha
        self.start = int(np.argmin(_sq(x - x.mean(0)))) if len(x) else 0
        if edges is not None:
            self.edges = edges
            return
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int64) if n else order
        first = order[: 2 * degree]
        if n > 1:
            self._insert(first, np.broadcast_to(first, (len(first), len(first))))
        at = len(first)
        while at < n:
            rows = order[at : at + min(BATCH, at)]
            ids, _ = self.search(x[rows], beam)
            self._insert(rows, ids)
            at += len(rows)

    def _insert(self, rows: np.ndarray, candidates: np.ndarray) -> None:
        self.edges[rows] = self._pruned(rows, candidates)
        to = self.edges[rows]
        source = np.repeat(rows, self.degree)[to.reshape(-1) >= 0]
        target = to.reshape(-1)[to.reshape(-1) >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, start, count = np.unique(target, return_index=True, return_counts=True)
        by_count = np.argsort(count, kind="stable")  # so that a much-wanted vector widens its own part only
        hit, start, count = hit[by_count], start[by_count], count[by_count]
        part = 0
        while part < len(hit):
            step = max(1, min(BATCH, 100_000 // int(count[min(part + BATCH, len(hit)) - 1])))
            h, s, c = (v[part : part + step] for v in (hit, start, count))
            part, width = part + step, int(c.max())
            grid = s[:, None] + np.arange(width)
            new = np.where(np.arange(width) < c[:, None], source[np.minimum(grid, len(source) - 1)], -1)
            self.edges[h] = self._pruned(h, np.concatenate([self.edges[h], new], 1))

    def _pruned(self, rows: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Up to ``degree`` diverse candidates of each row, the nearest first; -1 where there are fewer."""
        c = np.sort(candidates, 1)
        bad = (c < 0) | (c == rows[:, None])
        bad[:, 1:] |= c[:, 1:] == c[:, :-1]
        d = self._from(c, self.x[rows]) + self.norm[rows][:, None]
        d[bad] = np.inf
        most = min(c.shape[1], self.degree + BUILD_BEAM)
        near = np.argsort(d, 1)[:, :most]
        c, d = np.take_along_axis(c, near, 1), np.maximum(np.take_along_axis(d, near, 1), 0)
        v, n = self.x[c], self.norm[c]
        between = n[:, :, None] + n[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive, out = np.isfinite(d), np.full((len(rows), self.degree), -1, np.int32)
        i, slack = np.arange(len(rows)), self.alpha**2
        for k in range(self.degree):
            best = alive.argmax(1)  # by distance already
            ok = alive[i, best]
            if not ok.any():
                break
            out[ok, k] = c[i, best][ok]
            alive &= slack * between[i, best] > d
            alive[i, best] = False
        return out

    def _from(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Squared distances less the query's own square."""
        return self.norm[ids] - 2 * np.matmul(self.x[ids], q[:, :, None])[:, :, 0]

    def search(self, q: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beam's vectors and their distances for each query; -1 and infinity where it isn't full."""
        m, i = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((m, len(self.x)), bool)
        ids = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf, np.float32)
        done = np.ones((m, beam), bool)
        ids[:, 0], done[:, 0], seen[:, self.start] = self.start, False, True
        dist[:, 0] = self._from(ids[:, :1], q)[:, 0]
        while True:
            open_ = np.where(done, np.inf, dist)
            pick = np.argpartition(open_, wide - 1, 1)[:, :wide]
            live = np.isfinite(np.take_along_axis(open_, pick, 1))
            if not live.any():
                return ids, dist
            np.put_along_axis(done, pick, True, 1)
            nxt = self.edges[np.take_along_axis(ids, pick, 1)].astype(np.int64)
            nxt[~live] = -1
            nxt = np.sort(nxt.reshape(m, -1), 1)
            bad = (nxt < 0) | np.take_along_axis(seen, np.maximum(nxt, 0), 1)
            bad[:, 1:] |= nxt[:, 1:] == nxt[:, :-1]
            nxt[bad] = 0
            d = self._from(nxt, q).astype(np.float32)
            d[bad] = np.inf
            rows, cols = np.nonzero(~bad)
            seen[rows, nxt[rows, cols]] = True
            all_d = np.concatenate([dist, d], 1)
            keep = np.argpartition(all_d, beam - 1, 1)[:, :beam]
            dist = np.take_along_axis(all_d, keep, 1)
            ids = np.take_along_axis(np.concatenate([ids, nxt], 1), keep, 1)
            done = np.take_along_axis(np.concatenate([done, np.zeros(nxt.shape, bool)], 1), keep, 1) | ~np.isfinite(dist)


def usable(vectors: DataFrame, vector: str = "embedding", dimension: int | None = None) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sane = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = v.filter("vec_id is not null and v is not null").filter(F.forall("v", sane) & F.exists("v", lambda x: x != 0))
    if dimension is None:
        most = v.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").first()
        dimension = most.k if most else 0
    return v.filter(F.size("v") == dimension)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def beam_for(g: Graph, least: int = SEARCH_BEAM, seed: int = 11) -> int:
    """The narrowest beam, doubled from ``least`` on, that finds ``RECALL`` of the sample's nearest vectors; 0 if the shard should be scored whole."""
    n = len(g.x)
    rows = np.random.default_rng(seed).choice(n, min(SAMPLE, n), replace=False)
    q = g.x[rows].copy()
    q[:, -1] = 0  # as queries, they ask for the largest inner product
    true = np.argpartition(-(q @ g.x.T), min(NEAREST, n) - 1, 1)[:, :NEAREST]
    beam = least
    while beam * 8 <= max(n, 8 * least):
        ids, d = g.search(q, beam)
        top = np.take_along_axis(ids, np.argsort(d, 1)[:, :NEAREST], 1)
        if np.mean([np.isin(t, a).mean() for t, a in zip(true, top, strict=True)]) >= RECALL:
            return beam
        beam *= 2
    return 0


def index(v: DataFrame, shards: int) -> DataFrame:
    """shard, n, beam, and the vectors and edges of each shard's ``n`` nodes and, by node, their counts of ids and the ids, as bytes."""

    def build(t: pa.Table) -> pa.Table:
        shard, ids, x = t.column("shard")[0].as_py(), t.column("vec_id").to_numpy(), _matrix(t.column("v"))
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
        least = ids[new][np.cumsum(new) - 1]
        order = np.lexsort((ids, *x.T[::-1], least))  # nodes by their smallest ids
        ids, x = ids[order], x[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
        each = new | np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, x, counts = ids[each], x[new], np.bincount(np.cumsum(new)[each] - 1)
        g = Graph(lifted(x))
        return pa.table({"shard": [shard], "n": [len(x)], "beam": [beam_for(g)], "counts": [counts.astype("<i4").tobytes()], "ids": [ids.astype("<i8").tobytes()], "x": [x.astype("<f8").tobytes()], "edges": [g.edges.astype("<i4").tobytes()]})

    dealt = v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(build, "shard long, n long, beam long, counts binary, ids binary, x binary, edges binary")


def search(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", beam: int = SEARCH_BEAM, exact: bool = False, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of ``vectors`` to each of ``queries`` (vec_id and vector).

    ``beam``: at least so wide; ``exact``: every vector is scored.
    """
    v = materialize(usable(vectors, vector), "vectors")
    n = v.count()
    width = len(v.first().v) if n else 0
    q = usable(queries, vector, width).dropDuplicates(["vec_id"])
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q.count() // block))
    graphs = materialize(index(v, shards), "graphs")
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    right = q.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def find(g: pa.Table, t: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(g) or not len(t):
            return schema.empty_table()
        size = g.column("n")[0].as_py()
        ids = np.frombuffer(g.column("ids")[0].as_py(), "<i8")
        counts = np.frombuffer(g.column("counts")[0].as_py(), "<i4").astype(np.int64)
        first = np.cumsum(counts) - counts
        x = np.frombuffer(g.column("x")[0].as_py(), "<f8").reshape(size, -1)
        graph = Graph(lifted(x), edges=np.frombuffer(g.column("edges")[0].as_py(), "<i4").reshape(size, -1))
        own, qv = t.column("vec_id").to_numpy(), _matrix(t.column("v"))
        wide = g.column("beam")[0].as_py()
        out: list[tuple] = []
        for at in range(0, len(own), BATCH):
            a, b = own[at : at + BATCH], qv[at : at + BATCH]
            unit = b / np.abs(b).max(1, keepdims=True)
            if exact or not wide or max(beam, 2 * k) >= size:
                near = b @ x.T
                got = np.argpartition(-near, 2 * k - 1, 1)[:, : 2 * k] if 2 * k < size else np.broadcast_to(np.arange(size), near.shape)
                # what ties with the last one may come before it by its ids
                edge = np.take_along_axis(near, got, 1).min(1, keepdims=True)
                row, node = np.nonzero(near >= edge - 1e-9 * np.abs(edge))
                score = np.einsum("nd,nd->n", x[node], b[row])
            else:
                got, d = graph.search(np.concatenate([unit, np.zeros((len(b), 1))], 1).astype(np.float32), max(beam, wide, 2 * k))
                row, col = np.nonzero(np.isfinite(d))
                node = got[row, col]
                score = np.einsum("nd,nd->n", x[node], b[row])
            # of equal scores the smallest ids come first, and one may be the query's own
            some = np.minimum(counts[node], k + 1)
            row, by_id, value = np.repeat(row, some), ids[np.repeat(first[node] - np.cumsum(some) + some, some) + np.arange(some.sum())], np.repeat(score, some)
            other = by_id != a[row]
            row, by_id, value = row[other], by_id[other], value[other]
            order = np.lexsort((by_id, -value, row))
            row, by_id, value = row[order], by_id[order], value[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((a[row[best]], by_id[best], value[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search(e, e.filter("vec_id % 20 = 0"), 20)
