"""Near-duplicate documents by bottom-k sketches of their word shingles.

Documents with equal shingle sets form a class, and the rest works on classes, named by
their smallest doc_id.

1. A class's sketch is the ``SKETCH`` smallest values of one hash over its shingles.
2. Inverted lists: sketch values are ordered by how many classes retain them, rarest
   first.  Two sketches that overlap in ``_overlap`` values share one of their
   ``SKETCH - _overlap + 1`` rarest, so only these are listed, and only if another class
   retains them.  A passage that many documents share is thus no reason to list them.
   At the linking similarity fewer shared values have a probability of at most ``MISS``;
   sets of up to ``_whole`` shingles are listed by an exact bound instead.
3. Short lists give all their pairs.  A long list gives a star: its members against its
   centre, the member whose values are most widely shared.
4. Of a short list's pairs those are candidates whose sketches share enough values; of a
   long list the whole star is.  The components of the candidates are families: no link
   leaves one.  The sets of a family's classes are brought together, each of them once,
   and ``family`` finds its links with their exact Jaccard similarity.  Families of more
   than ``FAMILY`` shingles are too large for a task; the rest of this list is for them.
5. In turns, the union sketch estimates the similarity of each pair of the short lists and
   stars and drops what can't be linked; the exact similarity of the full sets confirms
   the others.  The components of what is linked so far are found, and a list whose
   members are in one goes.  Of lists with the same members one is kept.
6. What is left of a long list.  A far member x, one that isn't linked with the centre,
   can link with y only if they share more than half of y's differences from the centre:
   else their differences would add up, and leave them as far from each other as x is
   from the centre.  So differences are listed, rarest first again and as many as such an
   overlap asks for.  In these lists, too, pairs are compared if they are short, and a
   star if they are long; so a family of copies that is far from the centre costs a
   star, not its pairs.
7. What a star leaves, in a list by differences all but its centre and in a list by values
   those hardly similar to their centre, goes to shorter lists, by one more value or
   difference that a link must share.  Turns end when no list is left in which
   components meet.

Defined cases: null, empty and word-less texts have an empty set (n_shingles 0) and
link with nothing; rows with a null doc_id link with nothing, have a null component
and are kept; rows that share a doc_id share its component; an empty table gives no
rows; other columns are left out of ``groups`` and kept by ``keep_one``, which decides by
row, whatever its doc_id: of rows with ids one of each component stays, and of rows
without one too.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, join_salted, materialize, release, sliced, table
from .family import CLOSE, joined, linked_sets
from .graph import components
from .shingles import shingle_set

WORDS = 5
#: Linked from this many hundredths of similarity on.
PERCENT = 85
#: Below, what links with a member of a star could be too far from the centre to be looked into.
LEAST_PERCENT = 75
SKETCH = 48
#: The probability at most that a pair at the linking similarity shares too few values to be listed.
MISS = 1e-7
#: Lists of up to so many members give all their pairs; of longer ones no more than a star comes at a time.
SHORT = 32
#: A star's pair is looked into if the estimate is at least this; below, the member stays in its list.
FAR = 0.06
#: Families of up to so many shingles (8 bytes each) are looked into by one task; larger ones in turns.
FAMILY = 4_000_000
#: Up to so many ids (8 bytes each) are broadcast to fetch texts; more are joined by shuffling.
BROADCAST_IDS = 500_000
#: Up to so many pairs of classes (17 bytes each) are broadcast to fetch what they are judged by.
BROADCAST_PAIRS = 100_000
#: Ids set a bit each, by their hash, among so many for each of them, and among 8 MB at most: a row whose bit isn't set has none of these ids.
BITS, MOST_BITS = 32, 1 << 26
#: Spark makes bitmaps of so many bits, a power of two.
_BITMAP = 1 << 15


@functools.cache
def _overlap(percent: int) -> int:
    """How many values two sketches at the linking similarity share, but for a probability of ``MISS``."""
    p, least, fewer = percent / 100, 0, 0.0
    while least < SKETCH:
        fewer += math.comb(SKETCH, least) * p**least * (1 - p) ** (SKETCH - least)
        if fewer > MISS:
            break
        least += 1
    return least


def _whole(percent: int) -> int:
    """Sets of so many shingles, and all sets that can link with them, are whole in their sketches."""
    return SKETCH * percent // 100


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, sig (a digest of the whole set, null if it is empty), n and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, n, sketch = [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), words)
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                n.append(len(s))
                sketch.append(s[:SKETCH])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sig, pa.binary()), pa.array(n, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "sig", "n", "sketch"])

    return _texts(docs).mapInArrow(sliced(run), "doc_id bigint, sig binary, n bigint, sketch array<bigint>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _asked(rows: DataFrame, on: str, ids: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``on`` may be among the ``n`` written ``ids``, as all of these and few others, and the rows whose isn't.

    Only bits are broadcast, so that long rows needn't be shuffled to learn that nothing
    asks for them; with more ids than ``MOST_BITS`` is made for, more rows may be asked for.
    """
    size = min(MOST_BITS, max(_BITMAP, BITS * n))
    at, bits, bit = (free(x, rows.columns) for x in ("_at", "_bits", "_bit"))
    h = F.pmod(F.xxhash64(on), F.lit(size))
    where, which = F.shiftright(h, _BITMAP.bit_length() - 1), h.bitwiseAND(F.lit(_BITMAP - 1))
    # dealt by bitmap first: made before a shuffle, each task's bitmaps would be shuffled whole
    marks = ids.select(where.alias(at), which.alias(bit)).repartition(at).groupBy(at).agg(F.bitmap_construct_agg(bit).alias(bits))
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(which, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, which.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    all_ = rows.withColumn(at, where).join(F.broadcast(marks), at, "left")
    return all_.filter(found).drop(at, bits), all_.filter(~found).drop(at, bits)


def _full_sets(docs: DataFrame, need: DataFrame, repeated: bool, words: int) -> DataFrame:
    """f, u and its sorted shingles, of the classes in ``need`` (f, u, sig)."""
    n = need.count()
    side = need.select("f", F.col("u").alias("doc_id"), "sig")
    texts = _texts(docs)
    texts = texts.join(F.broadcast(side), "doc_id") if n <= BROADCAST_IDS else _asked(texts, "doc_id", side, n)[0].join(side, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, ids, sets = [], [], []
            for f, u, t, sig in zip(*(b.column(x) for x in ("f", "doc_id", "text", "sig")), strict=True):
                s = shingle_set(t.as_py(), words)
                if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == sig.as_py():
                    of.append(f.as_py())
                    ids.append(u.as_py())
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["f", "u", "set"])

    out = texts.mapInArrow(sliced(run), "f bigint, u bigint, set array<bigint>")
    # rows that occur more than once would multiply pairs
    return out.dropDuplicates(["u", "set"]) if repeated else out


def _prefix(n: Column, percent: int) -> Column:
    """How many of a sketch's rarest values must be listed."""
    return F.when(n <= _whole(percent), n - F.ceil(n * percent / 100) + 1).otherwise(F.lit(SKETCH - _overlap(percent) + 1))


def _ranked(classes: DataFrame, percent: int) -> DataFrame:
    """space, u, lim, order, s: each class's retained values that another class retains too, rarest first, of which the first ``lim`` are listed."""
    each = classes.select("sig", "u", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("x"))
    common = materialize(each.groupBy("x").agg(F.count("*").alias("df")).filter("df > 1").withColumn("c", F.col("df")), "common")
    n = classes.agg(F.sum(F.size("sketch"))).first()[0] or 0
    # shuffled whatever their number, so that what a small table moves tells what a large one will
    met = join_salted(each, common, ["x"], "c", n, ["sig"]).groupBy("sig", "u", "n", "kept").agg(_rarest_first())
    # values that nobody else retains are rarer, and come first
    lim = _prefix(F.col("n"), percent) - (F.col("kept") - F.size("s"))
    # the centre's values are the most widely shared
    order = -F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["df"]) / F.col("kept")
    return _values(met, F.lit(0).cast("long"), lim, order)


def _rarest_first() -> Column:
    return F.sort_array(F.collect_list(F.struct("df", "x"))).alias("s")


def _values(met: DataFrame, space: Column, lim: Column, order: Column) -> DataFrame:
    s = F.transform("s", lambda x, i: F.struct(i.alias("p"), x["x"].alias("x")))
    return met.select(space.alias("space"), "u", lim.cast("int").alias("lim"), order.cast("double").alias("order"), s.alias("s"))


_TAIL = "array<struct<p:int,x:bigint>>"
_LIST = ("key", "space", "u", "order", "seq", "room", "cap", "tail")


def _listed(ranked: DataFrame) -> DataFrame:
    """key, space, u, order, seq, room, cap, tail: the inverted lists of ranked values.

    ``seq`` are the places of the shared values that a list stands for, the next one is
    among the first ``room`` of the values behind these, and ``cap`` can be shared at most;
    ``tail`` has the values behind once the list was split, and is null before.
    """
    first = F.slice("s", F.lit(1), F.greatest(F.lit(0), F.col("lim")))
    each = ranked.select("space", "u", "order", "lim", F.size("s").alias("k"), F.posexplode(first).alias("at", "v"))
    return each.select(
        F.xxhash64("space", "v.x").alias("key"), "space", "u", "order", F.array("at").alias("seq"), (F.col("lim") - F.col("at")).alias("room"), (F.col("k") - F.col("at")).alias("cap"), F.lit(None).cast(_TAIL).alias("tail")
    )


def _refined(lists: DataFrame, done: DataFrame, ranked: DataFrame) -> DataFrame:
    """The lists split by one more shared value, without the rows in ``done`` (key, u).

    Of two that need k values in common, k - 1 are behind the first one that they share;
    so the next is among as many as were listed for the first.  A value that all members
    of a list have, its centre too, is taken as shared and splits nothing.
    """
    lists = lists.select(*_LIST)
    own = ranked.select("space", "u", "s")
    new = lists.filter("tail is null").join(own, ["space", "u"]).withColumn("tail", F.slice("s", F.col("seq")[0] + 2, F.size("s"))).drop("s")
    rows = materialize(new.unionByName(lists.filter("tail is not null")), "tails")
    n, sizes = rows.count(), rows.groupBy("key").agg(F.count("*").alias("m"))
    counts = rows.select("key", F.explode("tail").alias("v")).groupBy("key", "v.x").agg(F.count("*").alias("df")).filter("df > 1")
    counts = materialize(counts.join(sizes, "key"), "counts")
    gone = counts.filter("df = m").groupBy("key", "m").agg(F.collect_set("x").alias("gone"))
    rest = F.filter("tail", lambda v: ~F.array_contains("gone", v["x"]))
    cut = join_salted(rows.join(done, ["key", "u"], "left_anti"), gone, ["key"], "m", n, ["u"], "left").withColumn("tail", F.when(F.col("gone").isNull(), F.col("tail")).otherwise(rest)).drop("gone")
    cut = materialize(cut, "tails")
    each = cut.select("key", "u", F.posexplode(F.slice("tail", F.lit(1), F.greatest(F.lit(0), F.col("room")))).alias("j", "v")).select("key", "u", "j", "v.p", "v.x")
    some = counts.filter("df < m").select(F.xxhash64("key", "x").alias("next"), F.col("df").alias("c"))
    total = some.agg(F.sum("c")).first()[0] or 0
    met = _meet(each.withColumn("next", F.xxhash64("key", "x")), some, ["next"], total, ["u"]).drop("x")
    out = met.join(cut, ["key", "u"]).select(
        F.col("next").alias("key"), "space", "u", "order", F.concat("seq", F.array("p")).alias("seq"), (F.col("room") - F.col("j")).alias("room"), (F.col("cap") - F.col("j")).alias("cap"),
        F.slice("tail", F.col("j") + 2, F.size("tail")).alias("tail"),
    )
    out = materialize(out, "split")
    release(rows, counts, cut)
    return out


def _met(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The lists in which two components meet, with their sizes and centres.

    Of lists with the same members one is enough: that of the rarest values.
    """
    if labels is None:
        own = lists.withColumn("root", F.col("u"))
    else:
        known = labels.select(F.col("node").alias("u"), F.col("root").alias("r"))
        known = F.broadcast(known) if labels.count() <= BROADCAST_IDS else known
        own = lists.join(known, "u", "left").withColumn("root", F.coalesce("r", "u")).drop("r")
        own = materialize(own, "lists")
    about = own.groupBy("key").agg(
        F.count("*").alias("size"), F.min_by("u", F.struct("order", "u")).alias("centre"), F.min("order").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.first("space").alias("space"),
        F.bit_xor(F.xxhash64("u")).alias("h1"), F.bit_xor(F.xxhash64("u", F.lit(1))).alias("h2"), F.min(F.struct("u", "seq")).alias("first"),
    ).filter("lo < hi")
    about = about.groupBy("space", "size", "h1", "h2", F.size("first.seq")).agg(F.min(F.struct("first.seq", "key", "centre", "least")).alias("best"))
    about = materialize(about.select("best.key", "size", "best.centre", "best.least", F.col("size").alias("c")), "about")
    out = _meet(own, about, ["key"], own.count(), ["u"])
    # by differences, 2 * shared >= order + order makes a link, so some can't have any
    out = materialize(out.filter((F.col("space") == 0) | (F.col("u") == F.col("centre")) | (F.col("order") + F.col("least") <= 2 * F.col("cap") + 1e-6)), "lists")
    release(own, about)
    return out


def groups(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text)."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100, not {percent}")
    rows = materialize(sketches(docs, words), "sketches")
    known = rows.filter("sig is not null and doc_id is not null")
    least = lambda c: F.min_by(c, "doc_id").alias(c)
    classes = materialize(known.groupBy("sig").agg(F.min("doc_id").alias("u"), least("n"), least("sketch"), F.count("*").alias("c")), "classes")
    repeated = not known.groupBy("doc_id").count().filter("count > 1").isEmpty()
    roots = _connected(docs, classes, repeated, percent, words)
    # what is alone in its class, and that in its component, is its own root
    roots = roots.select(F.col("node").alias("u"), "root")
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_IDS else roots
    side = classes.select("sig", "u", "c").join(roots, "u", "left").filter("c > 1 or root is not null").select("sig", F.coalesce("root", "u").alias("root"), "c")
    named = rows.filter("doc_id is not null").select("doc_id", F.col("n").alias("n_shingles"), "sig")
    named = _meet(named, materialize(side, "roots"), ["sig"], rows.count(), ["doc_id"], "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    if repeated:
        # two classes may share their smallest doc_id, where rows share it
        best = named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        named = named.drop("component_id").join(best, "doc_id").select("doc_id", "n_shingles", "component_id")
    nameless = rows.filter("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    out = named.unionByName(nameless)
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def _connected(docs: DataFrame, classes: DataFrame, repeated: bool, percent: int, words: int) -> DataFrame:
    """node, root: the components of the classes that link with others; the root is the smallest class."""
    ranked = materialize(_ranked(classes, percent), "ranked")
    lists = _met(_listed(ranked), None)
    listed = materialize(lists.select("u").distinct(), "listed")
    few = listed.count() <= BROADCAST_IDS
    small = classes.select("u", "sketch").join(F.broadcast(listed) if few else listed, "u", "left_semi")
    small = materialize(small.dropDuplicates(["u", "sketch"]) if repeated else small, "small")
    stars = lists.filter((F.col("size") > SHORT) & (F.col("u") != F.col("centre"))).select(F.col("u").alias("a"), F.col("centre").alias("b"))
    edges = materialize(_candidates(lists, small, percent).unionByName(stars).distinct(), "candidates")
    of = components(edges).select(F.col("node").alias("u"), F.col("root").alias("f"))
    members = classes.select("u", "sig", "n").join(F.broadcast(of) if of.count() <= BROADCAST_IDS else of, "u")
    members = materialize(members, "members")
    large = materialize(members.groupBy("f").agg(F.sum("n").alias("n")).filter(F.col("n") > FAMILY).select("f"), "large")
    sets = _full_sets(docs, members, repeated, words)
    if large.isEmpty():
        return materialize(_within(sets, percent), "families")
    sets = materialize(sets, "sets")
    labels = materialize(_within(sets.join(large, "f", "left_anti"), percent), "families")
    inside = members.select("u", "f").join(large, "f", "left_semi").select("u").distinct()
    rest = _in_turns(materialize(lists.join(inside, "u", "left_semi"), "lists"), ranked, small, sets.select("u", "set"), percent)
    return labels.unionByName(rest)


def _candidates(lists: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of classes in short lists that connect all whose sketches share enough values for a link."""
    least = _overlap(percent)
    rows = lists.filter(F.col("size") <= SHORT).select("key", "u").join(small, "u")
    whole = rows.groupBy("key").agg(F.collect_list("u").alias("u"), F.collect_list("sketch").alias("sketch")).select("u", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int]] = []
            for us, sketch in zip(b.column("u").to_pylist(), b.column("sketch").to_pylist(), strict=True):
                out += joined(us, [frozenset(s) for s in sketch], least, SKETCH)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return whole.mapInArrow(sliced(run), "a bigint, b bigint")


def _within(sets: DataFrame, percent: int) -> DataFrame:
    """node, root: the components of links within each family of ``sets`` (f, u, set)."""

    def run(family: pa.Table) -> pa.Table:
        family = family.combine_chunks()
        u, s = family.column("u").to_numpy(), family.column("set").combine_chunks()
        at, values = s.offsets.to_numpy(), s.values.to_numpy()
        root = linked_sets(u, [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], percent)
        return pa.table({"node": pa.array(u, pa.int64()), "root": pa.array(root, pa.int64())})

    return sets.groupBy("f").applyInArrow(run, "node bigint, root bigint").distinct()


def _in_turns(lists: DataFrame, ranked: DataFrame, small: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, root: the components of links within ``lists``, by tables alone."""
    labels: DataFrame | None = None
    turn = 0
    while not lists.isEmpty():
        many = lists.filter(F.col("size") > SHORT)
        few = lists.filter(F.col("size") <= SHORT).select("key", "u", "root")
        other = few.select("key", F.col("u").alias("w"), F.col("root").alias("w_root"))
        pairs = few.join(other, "key").filter("u < w and root <> w_root").select(F.col("u").alias("a"), F.col("w").alias("b"), F.lit(False).alias("star"))
        star = many.filter("u <> centre").select(F.col("u").alias("a"), F.col("centre").alias("b"), F.lit(True).alias("star"))
        judged = _judged(pairs.unionByName(star).distinct(), small, sets, percent)
        links = judged.filter("linked").select("a", "b")
        if labels is None:
            labels = components(links)
        elif not links.isEmpty():
            labels, old = components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))), labels
            release(old)
        # the long lists in which components still meet, with the centres that they had
        many = _met(many.select(*_LIST), labels)
        if many.isEmpty():
            break
        # what is left of them; in those by differences, nobody but the centre is done
        stars = judged.filter("star").drop("star")
        at = many.filter("u <> centre and space = 0").select(F.col("u").alias("a"), F.col("centre").alias("b")).distinct()
        at = at.join(stars, ["a", "b"])
        apart = None if at.filter("close and not linked").isEmpty() else materialize(_differences(at, labels, percent, turn), "ranked")
        close = stars.filter("close").select(F.col("a").alias("u"), F.col("b").alias("centre"), F.lit(0).cast("long").alias("space"))
        done = many.filter("u = centre").select("key", "u").unionByName(many.join(close, ["u", "centre", "space"], "left_semi").select("key", "u"))
        left = _refined(many, done, ranked)
        if apart is not None:
            left, ranked = left.unionByName(_listed(apart)), ranked.unionByName(apart)
        split, left = left, _met(left, labels)
        release(judged, lists, many, split)
        lists = left
        turn += 1
    return labels if labels is not None else components(lists.select(F.col("u").alias("a"), F.col("u").alias("b")))


def _with(pairs: DataFrame, n: int, of: DataFrame, column: str) -> DataFrame:
    """The ``n`` ``pairs`` (a, b, star) with a column of both classes.

    Some pairs are broadcast, so that nothing is shuffled but what they ask for; of more,
    a centre's row goes to the tasks that its members are dealt to.
    """
    one = lambda x: of.select(F.col("u").alias(x), F.col(column).alias(f"{column}_{x}"))
    if n <= BROADCAST_PAIRS:
        all_ = F.broadcast(pairs)
        return one("a").join(all_, "a").join(one("b").join(all_, "b"), ["a", "b", "star"])
    return join_salted(pairs.join(one("a"), "a"), one("b"), ["b"], None, n, ["a"])


def _meet(rows: DataFrame, side: DataFrame, on: list[str], n: int, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with a narrow, written ``side`` whose ``c`` counts each key's rows: broadcast if it is small, else as ``join_salted``."""
    if side.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(side.drop("c")), on, how)
    return join_salted(rows, side, on, "c", n, by, how)


def _judged(pairs: DataFrame, small: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, star, linked, close and, for stars, the sizes and differences of the pairs that the estimate lets through."""
    pairs = materialize(pairs, "pairs")
    near = _with(pairs, pairs.count(), small, "sketch")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    both = F.array_intersect("sketch_a", "sketch_b")
    shared, of = F.size(F.array_intersect(both, F.col("_union"))), F.size("_union")
    near = near.withColumn("_union", union).filter(
        F.when(F.col("star"), shared >= FAR * of).otherwise(shared * SKETCH >= _overlap(percent) * of)
    ).select("a", "b", "star")
    near = materialize(near.distinct(), "near")
    full = _with(near, near.count(), sets, "set")
    full = full.withColumn("_i", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
    full = full.withColumn("_u", F.size("set_a") + F.size("set_b") - F.col("_i"))
    linked = F.col("_i") * 100 >= F.col("_u") * percent
    mine = lambda c: F.when(F.col("star"), c)
    mid = F.col("_i") >= F.col("_u") * CLOSE
    out = full.select(
        "a", "b", "star", linked.alias("linked"), mid.alias("mid"), (F.col("_i") * 100 >= F.col("_u") * (100 * CLOSE + 100 - percent)).alias("close"), F.size("set_a").cast("long").alias("n"),
        mine(F.array_except("set_a", "set_b")).alias("more"), mine(F.array_except("set_b", "set_a")).alias("less"),
    )
    out = materialize(out, "judged")
    release(pairs, near)
    return out


def _differences(stars: DataFrame, labels: DataFrame, percent: int, turn: int) -> DataFrame:
    """The members of stars in which components still meet, ranked by what they differ in from their centre.

    At least one of two that link is close to the centre; of others, the next turns take care.
    For a far x and any y that link, with D the differences from the centre (A: more, B:
    less), n = |x| and v(x) = |Dx| - n d / (2 - d), x and y link if 2 |Dx & Dy| >= v(x) + v(y);
    so what isn't linked with a list's member of least v shares more with others than what
    all share, and the list may be split.  |x ^ y| = |Dx ^ Dy| also gives |Dx & Dy| > ((1 - d) |Ay| + |By|) / 2, where d is the
    largest distance of a link, and |Dx & Dy| >= |Dx| - d / (1 - d) |x|.  The first holds
    for both if both are far.
    """
    d = 1 - percent / 100
    root = lambda x, r: labels.select(F.col("node").alias(x), F.col("root").alias(r))
    heads = stars.select("b").distinct().join(root("b", "rb"), "b", "left").select("b", F.coalesce("rb", "b").alias("rb"))
    own = stars.join(root("a", "ra"), "a", "left").withColumn("ra", F.coalesce("ra", "a"))
    own = join_salted(own, heads, ["b"], None, stars.count(), ["a"])
    own = own.withColumn("out", F.col("ra") != F.col("rb")).withColumn("space", F.xxhash64(F.lit(turn), "b"))
    own = materialize(own.select("space", F.col("a").alias("u"), "n", "linked", "close", "mid", "out", "more", "less"), "stars")
    # a far member that has met its centre's component matters only to those hardly similar to the centre
    mids = own.filter("mid and not close and out").select("space").distinct().withColumn("some", F.lit(True))
    own = own.join(F.broadcast(mids) if mids.count() <= BROADCAST_IDS else mids, "space", "left")
    own = own.withColumn("act", ~F.col("linked") & F.col("close") & (F.col("out") | F.col("some").isNotNull()))
    far = own.filter("act").select("space").distinct()
    of = own.join(F.broadcast(far) if far.count() <= BROADCAST_IDS else far, "space", "left_semi")
    of = of.withColumn("diff", F.concat("more", "less"))
    half = F.size("diff") - F.floor((F.size("more") * (1 - d) + F.size("less")) / 2 - 1e-9)
    long = F.least(F.size("diff").cast("long"), F.floor(F.col("n") * (d / (1 - d)) + 1e-9) + 1)
    lim = F.when(F.col("act"), F.greatest(half, long)).otherwise(half)
    each = of.select("space", "u", "n", "act", F.size("diff").alias("k"), lim.alias("lim"), F.explode("diff").alias("x"))
    each = each.withColumn("at", F.xxhash64("space", "x"))
    # differences that no far member shares are passed over, as the rarest
    common = each.groupBy("at").agg(F.count("*").alias("df"), F.count_if("act").alias("f")).filter("df > 1 and f > 0").select("at", "df", F.col("df").alias("c"))
    common = materialize(common, "common")
    met = _meet(each, common, ["at"], common.agg(F.sum("c")).first()[0] or 0, ["u"]).groupBy("space", "u", "n", "k", "lim").agg(_rarest_first())
    return _values(met, F.col("space"), F.col("lim") - F.col("k") + F.size("s"), F.col("k") - F.col("n") * (d / (2 - d)))


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` with its own columns, one row of each component: that with the smallest doc_id, and one of those without a doc_id."""
    key = "_row"
    while key in map(str.lower, docs.columns):
        key = f"_{key}"
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    of = groups(rows.select(F.col(key).alias("doc_id"), "text"), percent, words)
    of = of.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, F.col("doc_id").cast("long").alias("id")), key)
    of = materialize(of, "components")
    best = of.groupBy("component_id", F.col("id").isNull()).agg(F.min(F.struct("id", key)).alias("best")).select(F.col(f"best.{key}").alias(key))
    gone = materialize(of.select(key).join(best, key, "left_anti"), "gone")
    asked, others = _asked(rows, key, gone, gone.count())
    # merged whatever their number, so that what a small table moves tells what a large one will
    return others.unionByName(asked.join(gone.hint("merge"), key, "left_anti")).select(*docs.columns)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
