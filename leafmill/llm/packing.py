"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are whole numbers up to the largest permitted capacity, so the packing problem
is solved on the histogram of lengths (at most that many rows, whatever the corpus):

1. open bins for the longest length left: every permitted capacity is filled, best fit
   first, from what is left, and the capacity of least cost a packed token wins; as
   many equal bins are opened as the histogram allows, so each step uses up a length.
   Short sequences pay the overhead more often, long ones cost more a token, so the
   capacities compete;
2. every bin is downsized to the smallest capacity that holds its contents.

The pieces then take their places by their rank among pieces of equal length.  Ranks
come from counts by (length, bucket), with more buckets for more rows and a row's bucket
from its place, so that neither a length nor an id that a third of all rows share is
ranked in one task.

Documents over the largest capacity are split into full parts and a rest; no token is
dropped.

Defined cases: null and word-less texts have one row of length 0 with null bin columns;
null ids are packed like others; equal rows are packed as often as they occur; columns
other than doc_id and text are left out.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .token_counts import VOCABULARY, token_lengths

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its capacity, in tokens: short sequences pay it more often.
OVERHEAD = 16
#: A sequence costs its capacity and, for what grows with its square, capacity * capacity over this.
QUADRATIC = 65_536
#: Pieces in a ranking bucket, on average, before more buckets are used.
BUCKET_ROWS = 20_000
MIN_BUCKETS = 64


def n_words(text: Column) -> Column:
    """The default length: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def plan_bins(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, quadratic: float = QUADRATIC) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Groups of equal bins: (bins, capacity, [(length, pieces in each bin), ...])."""
    sizes = sorted(capacities)
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    out: list[tuple[int, int, list[tuple[int, int]]]] = []

    def fill(first: int, capacity: int) -> tuple[int, dict[int, int]]:
        taken, space, at = {first: 1}, capacity - first, len(lengths)
        while space > 0 and (at := bisect_right(lengths, space, 0, at)):
            n = lengths[at - 1]
            if k := min(left[n] - taken.get(n, 0), space // n):
                taken[n] = taken.get(n, 0) + k
                space -= n * k
            at -= 1
        return capacity - space, taken

    while lengths:
        first = lengths[-1]
        best = min((((c + overhead + c * c / quadratic) / used, -c, c, used, taken) for c in sizes if c >= first for used, taken in [fill(first, c)]), key=lambda x: x[:2])
        _, _, _, used, taken = best
        bins = min(left[n] // k for n, k in taken.items())
        out.append((bins, next(c for c in sizes if c >= used), sorted(taken.items(), reverse=True)))
        for n, k in taken.items():
            left[n] -= k * bins
            if not left[n]:
                del lengths[bisect_right(lengths, n) - 1]
    return out


def _segments(groups: list, first_bin: int) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length: (first rank, first bin, pieces in each bin, position in the bin, capacity), by rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    for bins, capacity, taken in groups:
        at = 0
        for n, k in taken:
            rank = ranks.get(n, 0)
            out.setdefault(n, []).append((rank, first_bin, k, at, capacity))
            ranks[n] = rank + bins * k
            at += n * k
        first_bin += bins
    return out


def pieces_of(docs: DataFrame, largest: int, length: Column) -> DataFrame:
    """doc_id, part, start, length: every document cut into full parts and a rest."""
    d = docs.select("doc_id", length.cast("long").alias("_n"))
    parts = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(largest)))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts)))
    start = F.col("part") * largest
    return d.select("doc_id", "part", start.alias("start"), F.least(F.lit(largest).cast("long"), F.col("_n") - start).alias("length"))


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, length: Column | None = None, vocabulary: str | None = None, quadratic: float = QUADRATIC) -> DataFrame:
    """doc_id, part, start, length, bin_id, pos, capacity of every piece of every row of ``docs``.

    Lengths are tokens of ``vocabulary``, or ``length``, an expression over ``docs``, or else words.
    """
    spark, largest = docs.sparkSession, max(capacities)
    if vocabulary is not None:
        docs, length = token_lengths(docs, vocabulary), F.col("n_tokens")
    pieces = pieces_of(docs, largest, n_words(F.col("text")) if length is None else length)
    pieces = materialize(pieces.withColumn("_h", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).filter("length > 0").collect()}
    groups = plan_bins(histogram, capacities, overhead, quadratic)
    plan = spark.sparkContext.broadcast({n: np.array(x, np.int64).reshape(-1, 5).T for n, x in _segments(groups, 0).items()})

    buckets = max(MIN_BUCKETS, sum(histogram.values()) // BUCKET_ROWS)
    some = pieces.filter("length > 0").withColumn("_b", F.pmod("_h", F.lit(buckets)))
    before = (
        some.groupBy("length", "_b").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("length").alias("_l"), F.col("_b").alias("_c"), F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "part", "_h")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("_l")) & (F.col("_b") == F.col("_c"))).select(
        "doc_id", "part", "start", "length", (F.col("_before") + F.col("_r")).alias("_rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = plan.value
        for b in batches:
            n, rank = (b.column(x).to_numpy(zero_copy_only=False) for x in ("length", "_rank"))
            got = np.zeros((3, len(n)), np.int64)
            order = np.argsort(n, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else ():
                size = int(n[rows[0]])
                first, bin_id, each, pos, capacity = segments[size]
                k = np.searchsorted(first, rank[rows], "right") - 1
                into = rank[rows] - first[k]
                got[:, rows] = bin_id[k] + into // each[k], pos[k] + into % each[k] * size, capacity[k]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "part", "start", "length")), *map(pa.array, got)], names=["doc_id", "part", "start", "length", "bin_id", "pos", "capacity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"doc_id {kind}, part bigint, start bigint, length bigint, bin_id bigint, pos bigint, capacity bigint")
    none = F.lit(None).cast("bigint")
    return placed.unionByName(pieces.filter("length = 0").select("doc_id", "part", "start", "length", none.alias("bin_id"), none.alias("pos"), none.alias("capacity")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary=VOCABULARY)
