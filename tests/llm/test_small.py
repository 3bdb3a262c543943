"""Small cases, brute force and edge rows for the operators that need few Spark jobs."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import ann, decontaminate, lang_id, packing, pii, suffix_dedup, token_counts
from leafmill.llm.common import join_skewed
from leafmill.llm.shingles import word_hashes


# --- PII
def base_by_regex(t):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, rx, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(rx, t):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123 .-+@ab()é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == base_by_regex(text)


def test_base_spans_of_long_runs():
    for t in ("1" * 200_000, "a" * 200_000, "a." * 100_000 + "@", "1." * 100_000, "+" * 100_000, "@" * 100_000):
        pii._all(t)


def test_em_and_classifier():
    counts = [(2, "yy--yy", 4, 1, 500), (2, "yy--yy", 4, 0, 5), (2, "yn--yn", 4, 0, 60), (2, "yy-nnn", 4, 0, 8), (3, "yy--yy", 4, 1, 100)]
    w = pii.fit(counts)
    assert pii.accepts(w, 2, "yy--yy", 4) and not pii.accepts(w, 2, "yn--yn", 4) and not pii.accepts(w, 2, "yy-nnn", 4)
    assert not pii.accepts(pii.fit([]), 2, "yy--yy", 4)


def test_run_together():
    text = "call +1 (578) 555-6437 4918187128635271 now"
    assert pii.base_spans(text) == []  # the base patterns run both numbers together
    assert [(text[s["start"] : s["end"]], s["kind"]) for s in pii._all(text)] == [("+1 (578) 555-6437", 3), ("4918187128635271", 2)]
    assert pii.mask(text, pii._all(text)) == "call [PHONE] [CARD] now"


# --- token counts
def test_edits_against_encoding_again():
    r, count = random.Random(5), token_counts.encoder(token_counts.VOCABULARY)
    for _ in range(1500):
        text = "".join(r.choices("ab 's\n.  1é", k=r.randint(0, 60)))
        tree = token_counts.CountTree(text, count, 4)
        for _ in range(4):
            a = r.randint(0, len(text))
            b, new = r.randint(a, len(text)), "".join(r.choices("ab 's\n", k=r.randint(0, 5)))
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.n_tokens == count(text)


# --- decontamination
def hits_by_force(words, items, window):
    hit, got = set(), set()
    for key, w in items:
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[j : j + n]:
                    hit |= set(range(i, i + n))
                    got.add(key)
    return hit, got


def test_automaton_against_force():
    r = random.Random(6)
    for _ in range(400):
        items = [(k, [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 9))]) for k in range(r.randint(0, 4))]
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 30))]
        spans, got = decontaminate.automaton(items, 4).scan(words)
        assert ({i for a, b in spans for i in range(a, b)}, got) == hits_by_force(words, items, 4)


# --- packing
@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan(histogram):
    groups = packing.plan_bins(histogram, (16, 32, 64), 2)
    seen = {}
    for bins, capacity, taken in groups:
        used = sum(n * k for n, k in taken)
        assert used <= capacity and not any(used <= c < capacity for c in (16, 32, 64))
        for n, k in taken:
            seen[n] = seen.get(n, 0) + bins * k
    assert seen == histogram


# --- passages
def test_minimisers():
    h = word_hashes([str(x).encode() for x in np.random.default_rng(1).integers(0, 40, 400)])
    _, a, b, place = suffix_dedup.minimisers(h)
    assert a[0] == 0 and b[-1] == len(h) - suffix_dedup.LEAST and (a[1:] == b[:-1] + 1).all()
    assert ((place >= b) & (place <= a + suffix_dedup.LEAST - suffix_dedup.GRAM)).all()


# --- language
def test_network_learns():
    r = random.Random(2)
    words = {"x": ["the", "and", "of", "ing"], "y": ["der", "und", "ung", "ß"]}
    text = lambda k: " ".join(r.choices(words[k], k=40)).encode()
    langs = [k for k in words for _ in range(60)]
    m = lang_id.fit([text(k) for k in langs], langs, epochs=4)
    best, score = lang_id.Predictor(m).languages([text(k) for k in langs] + [b"a" * 5000])
    assert [m.labels[i] for i in best[:-1]] == langs and (score <= 1).all() and (score >= 0).all()


# --- neighbours
def test_graph_recall():
    x = np.random.default_rng(3).normal(size=(1500, 24))
    g = ann.Graph(ann.lifted(x))
    q = np.concatenate([x[::10], np.zeros((150, 1))], 1).astype(np.float32)
    ids, _ = g.search(q, ann.SEARCH_BEAM)
    true = np.argsort(-(x[::10] @ x.T), 1)[:, :20]
    assert np.mean([len({*a} & {*b}) / 20 for a, b in zip(ids, true, strict=True)]) > 0.9


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_tiny_graphs(n):
    g = ann.Graph(ann.lifted(np.eye(5)[:n]))
    if n:
        ids, _ = g.search(np.ones((1, 6), np.float32), 8)
        assert {*ids[0][ids[0] >= 0]} == {*range(n)}


def test_sha_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


# --- joins with hot keys
def test_join_skewed(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k long, i long")
    side = rows.groupBy("k").count().filter("k % 2 = 1").withColumn("x", F.col("k") * 2)
    got = join_skewed(rows, side, ["k"], "count", rows.count())
    assert got.columns == ["k", "i", "x"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(side.drop("count"), "k").collect()))
    semi = join_skewed(rows, side, ["k"], "count", rows.count(), "left_semi")
    assert sorted(map(tuple, semi.collect())) == sorted(map(tuple, rows.join(side, "k", "left_semi").collect()))
    none = rows.limit(0)
    assert join_skewed(none, side.limit(0), ["k"], "count", 0).count() == 0


# --- long and odd texts
def test_many_spans_in_a_long_text():
    began = time.time()
    text = "mail a@b.org or +1 (578) 555-6437 4918187128635271 from 10.0.0.1\n" * 30_000
    got = pii._all(text)
    assert len(got) == 4 * 30_000 and time.time() - began < 30  # hours, if every candidate met every span


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="01 .-+@ab(at)\n", max_size=80))
def test_candidates_touch_no_base_span(text):
    base = pii.base_spans(text)
    found = pii.candidates(text, base)
    assert not any(a < y and x < b for a, b, _ in found for x, y, _ in base)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_leaves_of_unspaced_text():
    count = token_counts.encoder(token_counts.VOCABULARY)
    text = "".join(random.Random(8).choices(["\u6f22\u5b57", "\u4eee\u540d", "\u3002", "\u3001", "1", "ab", "'s"], weights=[9, 9, 2, 2, 1, 1, 1], k=4000))
    tree = token_counts.CountTree(text, count, 64)
    assert len(tree.leaves) > 50 and tree.n_tokens == count(text) == sum(map(count, tree.leaves))
    again = token_counts.CountTree(text, lambda t: 1 / 0, kept=tree.kept())
    assert again.n_tokens == tree.n_tokens and again.leaves == tree.leaves
    tree.replace(3000, 3002, "x")
    assert tree.encoded < 500 and tree.n_tokens == count(text[:3000] + "x" + text[3002:])


def test_capacities_compete():
    groups = packing.plan_bins({300: 40, 200: 40, 5000: 3, 90: 100})
    assert {c for _, c, _ in groups} >= {512, 8192} and sum(b * sum(n * k for n, k in t) for b, _, t in groups) == 300 * 40 + 200 * 40 + 15000 + 9000
    assert {c for _, c, _ in packing.plan_bins({300: 40, 200: 40}, quadratic=1e18)} - {512, 1024} != set()  # without the square, the largest sequences win


def test_beam_follows_the_shard():
    rng = np.random.default_rng(2)
    easy = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))
    hard = rng.normal(size=(3000, 64))
    for x in (easy, hard):
        g = ann.Graph(ann.lifted(x))
        beam = ann.beam_for(g)
        q = np.concatenate([x[::25], np.zeros((120, 1))], 1).astype(np.float32)
        ids, d = g.search(q, beam or len(x))
        true = np.argsort(-(x[::25] @ x.T), 1)[:, :20]
        assert np.mean([np.isin(t, a).mean() for t, a in zip(true, ids)]) >= 0.9
