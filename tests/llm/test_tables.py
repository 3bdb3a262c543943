"""Every operator over tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random

import pytest

from leafmill.llm import ann, decontaminate, graph, lang_id, near_dedup, packing, pii, suffix_dedup, token_counts, url_filter, warc
from leafmill.llm.common import shared_root

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, _letter int, component_id long, u long"


def texts():
    r = random.Random(11)
    base = r.choices(WORDS, k=120)
    out = [(1, " ".join(base)), (2, " ".join(base).upper())]
    for i in range(3, 15):  # near copies, one to a few words changed
        own = list(base)
        for _ in range(r.choice([1, 1, 2, 4, 8])):
            own[r.randrange(len(own))] = r.choice(WORDS)
        out.append((i, " ".join(own)))
    passage = r.choices(WORDS, k=70)
    for i in range(15, 20):
        out.append((i, " ".join(r.choices(WORDS, k=60) + passage + r.choices(WORDS, k=30))))
    out += [(20, None), (21, ""), (22, "   "), (23, "one two"), (24, "One  two"), (25, "???"), (None, " ".join(base)), (26, "x" * 300_000), (27, " ".join(r.choices(WORDS, k=9000)))]
    out += [(28, "mail a@b.org or 10.0.0.1"), (28, "mail a@b.org or 10.0.0.1")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i != 5 else None, "s", None, 7, "s", 1, 2, 3) for i, t in texts()]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_pii(docs, empty):
    got = pii.find(docs).collect()
    assert len(got) == docs.count() and pii.find(empty).count() == 0
    (a, b) = [r for r in got if r.doc_id == 28]
    assert a == b and (a.n_email, a.n_ip) == (1, 1) and a.spans == "email:5:12,ip:16:24"
    assert a.base_sha256 == hashlib.sha256(a.spans.encode()).hexdigest()
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.filter("doc_id = 28").first().text == "mail [EMAIL] or [IP]"


def test_token_counts(docs, empty):
    count = token_counts.encoder(token_counts.VOCABULARY)
    got = token_counts.count_tokens(docs).collect()
    assert len(got) == docs.count() and token_counts.count_tokens(empty).count() == 0
    own = dict(texts())
    for r in got:
        if r.doc_id not in (None, 26):
            text = own[r.doc_id] or ""
            assert r.n_tokens == count(text)
            for a, b, new in sorted(token_counts.cleaning_edits(text), reverse=True):
                text = text[:a] + new + text[b:]
            assert r.n_tokens_after == count(text)


def test_url_filter(spark):
    rows = [(1, "http://A.Example.org/es/x?q"), (1, "http://A.Example.org/es/x?q"), (2, "http://example.org/en/11"), (3, "x://org"), (4, "x://org/"), (5, "x://a.com/fr/"), (6, "x://a.com/de/#"), (7, "a.com/de/"), (8, None), (None, "x://notexample.org/es/"), (9, "")]
    p = spark.createDataFrame([(i, u, "h", "n") for i, u in rows], "page_id long, url string, host string, rule string")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(p).collect()), key=str)
    assert got == sorted([
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/11", "example.org/en/1", "block"),
        (3, "org", "", None, "allow"), (4, "org", "/", "org/", "allow"), (5, "a.com", "/fr/", "com/fr/", "allow"), (6, "a.com", "/de/", "com/de/", "block"),
        (7, "", "", None, "allow"), (8, "", "", None, "allow"), (0, "notexample.org", "/es/", "org/", "allow"), (9, "", "", None, "allow"),
    ], key=str)
    assert {r.verdict for r in url_filter.filter_urls(p, []).collect()} == {"allow"}


def test_language(spark, docs, empty):
    from pyspark.sql import functions as F

    rows = [(i, t, x) for i in range(80) for t, x in ((f"the and of {i} thing with", "en"), (f"der und ein {i} keit die", "de"))]
    m = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    got = lang_id.predict(docs, m).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got if r.doc_id in (20, 21, 22, 25)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    kept = lang_id.keep_known(docs, m)
    assert kept.columns == docs.columns and not {20, 21, 22, 25} & {r.doc_id for r in kept.collect()}
    assert lang_id.train(empty, F.lit(True)) is None and lang_id.predict(empty, None).count() == 0
    assert {r.lang_pred for r in lang_id.predict(docs, None).collect()} == {"und"}


def test_warc(spark):
    rows = [(1, "u", "<p>x"), (2, "v", "<p>x"), (3, None, None), (4, "w", ""), (5, "y\r\nz", "é"), (None, "n", "<p>x")]
    p = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    path = f"{shared_root(spark)}/warc-test"
    warc.write_archive(p, path)
    got = {r.page_id: r for r in warc.read_index(spark, path).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2)}
    assert got[5].payload_bytes == 2 and got[4].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    back = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert {k: bytes(r.payload).decode() for k, r in back.items()} == {i: h or "" for i, _, h in rows}
    assert bytes(back[5].record).endswith(b"\r\n\r\n\xc3\xa9\r\n\r\n") and bytes(back[1].record).startswith(b"WARC/1.1\r\n")
    assert spark.read.parquet(f"{path}/payloads").count() == 3


def test_decontaminate(spark, docs, empty):
    own = dict(texts())
    bench = spark.createDataFrame([(1, own[15], 0), (1, own[15], 0), (2, None, 0), (3, "one TWO", 0), (4, "--", 0), (None, "w1", 0)], "item_id long, text string, n_hit int")
    items = [(1, decontaminate.words_of(own[15].encode())), (3, [b"one", b"two"]), (None, [b"w1"])]
    from .test_small import hits_by_force

    got = decontaminate.hits(docs, bench).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id not in (None, 26, 27):
            w = decontaminate.words_of((own[r.doc_id] or "").encode())
            hit, keys = hits_by_force(w, items, 13)
            said = ",".join(sorted(str(k) for k in keys if k is not None))
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(keys)) and r.items_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert decontaminate.hits(empty, bench).count() == 0 and not any(r.contaminated for r in decontaminate.hits(docs, bench.limit(0)).collect())
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.columns == docs.columns and all(r.n_hit == 0 for r in decontaminate.hits(cut, bench).collect())
    assert {15, 16} & {r.doc_id for r in cut.collect()} == set() and 20 in {r.doc_id for r in cut.collect()}


def test_near_dedup(docs, empty):
    own, parent = dict(texts()), {}
    sets = {}
    for i, t in own.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
        parent[i] = i
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i in sets:
        for j in sets:
            if i is not None and j is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = near_dedup.groups(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else root(r.doc_id)) and r.kept == (r.component_id == r.doc_id)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert near_dedup.groups(empty).count() == 0


def test_pipeline_near_copies(spark):
    import corpus_pipeline

    rows = []
    for k, n in enumerate(range(20, 400, 10)):  # similar by 0.8 or a little more, and by less
        w = [f"x{k}_{i}" for i in range(n + 4)]
        rows += [(4 * k, " ".join(w)), (4 * k + 1, " ".join(w + [f"y{k}_{i}" for i in range(n // 4)]))]
        rows += [(4 * k + 2, " ".join([f"z{i}" for i in w])), (4 * k + 3, " ".join([f"z{i}" for i in w] + [f"v{k}_{i}" for i in range(n // 4 + 1)]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, d, "").collect()}
    assert kept == {i for i, _ in rows} - {4 * k + 1 for k in range(38)}
    assert {r.doc_id for r in near_dedup.keep_one(d).collect()} == {i for i, _ in rows}


def test_overlap():
    from math import comb

    for percent in range(75, 100):
        fewer = lambda o: sum(comb(48, i) * (percent / 100) ** i * (1 - percent / 100) ** (48 - i) for i in range(o))
        o = near_dedup._overlap(percent)
        assert fewer(o) <= 1e-7 < fewer(o + 1) and near_dedup._whole(percent) * 100 <= 48 * percent
    assert (near_dedup._overlap(85), near_dedup._whole(85)) == (26, 40)


def test_least_percent(empty):
    for percent in (60, 74, 101):
        with pytest.raises(ValueError):
            near_dedup.groups(empty, percent)
    assert near_dedup.groups(empty, 75).count() == 0


def test_keep_one_by_row(spark):
    r = random.Random(6)
    one, two, three = (" ".join(r.choices(WORDS, k=60)) for _ in range(3))
    rows = [(1, one), (5, one), (5, two), (9, two), (3, three), (3, three), (3, three.upper()), (4, one), (None, "a b c"), (None, "a b c"), (None, ""), (None, ""), (2, "")]
    got = near_dedup.keep_one(spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, _row int"))
    assert got.columns == ["doc_id", "text", "_row"]
    kept = [(x.doc_id, x.text.lower()) for x in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (5, two), (3, three), (None, "a b c"), (None, ""), (None, ""), (2, "")], key=str)


def test_keep_one_leaves_texts_where_they_are(spark, tmp_path):
    """Only the texts that may go are shuffled, not all, even where nothing is small enough for Spark to broadcast."""
    r, sc = random.Random(8), spark.sparkContext._jsc.sc()
    long = [" ".join(f"{r.getrandbits(64):x}" for _ in range(600)) for _ in range(200)]
    spark.createDataFrame(list(enumerate(long + long[:10])), "doc_id long, text string").write.parquet(f"{tmp_path}/d")

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        none, quantiles = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = sc.statusStore().stageList(none, False, False, quantiles, none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_dedup.keep_one(spark.read.parquet(f"{tmp_path}/d"))
        before = shuffled()
        assert sorted(x.doc_id for x in kept.select("doc_id", "text").collect()) == list(range(200))
        assert 0 < shuffled() - before < 0.25 * sum(map(len, long))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_asked(spark, monkeypatch):
    """No id that is asked for is missed, and few others are taken, also where there are too few bits for them."""
    rows = spark.createDataFrame([(i * 7919 - 10**6, i, i) for i in range(4000)] + [(None, 0, 0)], "id long, _at int, _bits int")
    ids = rows.filter("_at % 4 = 1").select("id")
    for bits, most in ((1 << 26, 150), (1 << 8, 3000)):  # 3000 others, a bit in 32 set: 94 expected
        monkeypatch.setattr(near_dedup, "MOST_BITS", bits)
        asked, others = near_dedup._asked(rows, "id", ids, 1000)
        assert asked.columns == others.columns == rows.columns
        a, o = {x["_bits"] for x in asked.collect() if x.id is not None}, {x["_bits"] for x in others.collect() if x.id is not None}
        assert {i for i in range(4000) if i % 4 == 1} <= a and a.isdisjoint(o) and a | o == set(range(4000)) and len(a) - 1000 <= most
        assert asked.count() + others.count() == 4001


def test_nearest(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], "x") for i in range(300)]
    rows += [(300, None, "x"), (320, [0.0] * 8, "x"), (340, [float("nan")] * 8, "x"), (360, [1.0, None] * 4, "x"), (380, [1.0] * 3, "x"), (None, [1.0] * 8, "x"), (7, rows[7][1], "x")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.search(v, v.filter("vec_id % 20 = 0"), 20).collect()
    assert len({(g.query_id, g.vec_id) for g in got}) == len(got) == 15 * 20
    hit = 0
    for q in range(0, 300, 20):
        dot = {i: sum(a * b for a, b in zip(x, rows[q][1])) for i, x, _ in rows[:300] if i != q}
        best = sorted(dot, key=lambda i: (-dot[i], i))[:20]
        own = [g for g in sorted(got, key=lambda g: g["rank"]) if g.query_id == q]
        assert all(abs(g.score - dot[g.vec_id]) < 1e-9 for g in own) and [g["rank"] for g in own] == [*range(1, 21)]
        hit += len({g.vec_id for g in own} & set(best))
    assert hit >= 0.95 * len(got)
    assert ann.search(v.limit(0), v.limit(0), 20).count() == 0
    assert ann.search(v.limit(3), v.limit(3), 20).count() == 6


def test_nearest_of_equal_vectors(spark):
    r = random.Random(4)
    same = [r.gauss(0, 1) for _ in range(8)]
    rows = [(i, same if i % 3 == 0 else [r.gauss(0, 1) for _ in range(8)]) for i in range(1500)]
    v = spark.createDataFrame(rows + rows[:9], "vec_id long, embedding array<double>")
    got = ann.search(v, v.filter("vec_id % 20 = 0"), 20).collect()
    hit = {True: 0, False: 0}
    for q in range(0, 1500, 20):
        dot = {i: sum(a * b for a, b in zip(x, rows[q][1])) for i, x in rows if i != q}
        best = sorted(dot, key=lambda i: (-dot[i], i))[:20]
        own = [g.vec_id for g in sorted(got, key=lambda g: g["rank"]) if g.query_id == q]
        assert len(own) == len(set(own)) == 20
        hit[q % 3 == 0] += len(set(own) & set(best))
    assert hit[True] >= 0.95 * 25 * 20 and hit[False] >= 0.95 * 50 * 20


def test_suffix(docs, empty):
    own, seen = [(i, (t or "").lower().split()) for i, t in texts() if i is not None], {}
    for i, w in own:
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), []).append(i)
    got = suffix_dedup.repeated(docs).collect()
    assert len(got) == docs.count() and suffix_dedup.repeated(empty).count() == 0
    for r in got:
        w = dict(own).get(r.doc_id, [])
        hit = {j for k in range(len(w) - 49) if len(seen[tuple(w[k : k + 50])]) > 1 for j in range(k, k + 50)}
        spans = [tuple(map(int, x.split(":"))) for x in r.spans.split(",") if x]
        assert r.n_repeated == len(hit) and {j for a, b in spans for j in range(a, b)} == hit


def test_packing(docs, empty):
    got = packing.pack(docs, (64, 256, 512)).collect()
    assert packing.pack(empty).count() == 0
    want = sum(len((t or "").split()) for _, t in texts())
    assert sum(r.length for r in got) == want and {r.doc_id for r in got if r.bin_id is None} == {20, 21, 22}
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.pos)
        assert b[0].pos == 0 and all(x.pos + x.length == y.pos for x, y in zip(b, b[1:]))
        used = b[-1].pos + b[-1].length
        assert {r.capacity for r in b} == {min(c for c in (64, 256, 512) if c >= used)}


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, dict(texts())[15])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, d)
        assert now.columns == docs.columns, name
        now.write.parquet(f"{d}/{k}")
        now = spark.read.parquet(f"{d}/{k}")
    ids = [r.doc_id for r in now.collect()]
    assert 15 not in ids and 20 not in ids and 1 in ids and 2 not in ids and 27 in ids
    assert "a@b.org" not in " ".join(r.text for r in now.collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == set(ids)


def test_pii_query_against_force(spark, docs, tmp_path):
    from .test_small import base_by_regex

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    own = {}
    for i, t in texts():
        own.setdefault(i, t or "")
    for r in pii.op1_pii(spark, str(tmp_path)).collect():
        base = base_by_regex(own[r.doc_id])
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for *_, k in base) for j in range(4)]


def test_redact_keeps_clashing_columns(spark):
    d = spark.createDataFrame([(1, "mail a@b.org", "x", 1), (None, None, None, None)], "doc_id long, text string, _spans string, votes int")
    got = pii.redact(d)
    assert got.columns == d.columns and {r.text for r in got.collect()} == {"mail [EMAIL]", None}
    assert pii.redact(d.limit(0)).count() == 0


def test_kept_trees(spark):
    r = random.Random(12)
    text = {i: " ".join(r.choices(WORDS, k=3000)) for i in range(6)} | {6: "", 7: "one leaf"}
    docs = spark.createDataFrame([*text.items(), (None, "a b"), (3, text[3]), (9, None)], "doc_id long, text string")
    trees = token_counts.build_trees(docs)
    edits = {0: [(10, 14, "new words"), (5000, 5000, " x")], 3: [(0, 3, "")], 6: [(0, 0, "more")], 7: [(0, 8, "")]}
    e = spark.createDataFrame([(i, a, b, n) for i, x in edits.items() for a, b, n in x] + [(77, 0, 0, "z"), (None, 0, 1, "z")], "doc_id long, start int, end int, new string")
    got = token_counts.apply_edits(trees, e).collect()
    count = token_counts.encoder(token_counts.VOCABULARY)
    assert len(got) == docs.count()
    for x in got:
        new = text.get(x.doc_id, "a b" if x.doc_id is None else None)
        for a, b, n in sorted(edits.get(x.doc_id, []), reverse=True):
            new = new[:a] + n + new[b:]
        assert (x.text, x.n_tokens, sum(x.chars)) == (new, count(new or ""), len(new or "")) and sum(x.tokens) == x.n_tokens
        assert x.chars_encoded <= 0.05 * len(new or "") + 600 and (x.chars_encoded == 0 or x.doc_id in edits)
    # edits of the edited trees give what a recount gives
    twice = token_counts.apply_edits(token_counts.apply_edits(trees, e), token_counts.cleaning_edits)
    again = token_counts.apply_edits(token_counts.build_trees(token_counts.apply_edits(trees, e)), token_counts.cleaning_edits)
    key = lambda x: (str(x.doc_id), x.text, x.n_tokens)
    assert sorted(map(key, twice.collect())) == sorted(map(key, again.collect()))
    assert token_counts.apply_edits(trees.limit(0), e).count() == 0
    lengths = {(x.doc_id, x.n_tokens) for x in token_counts.token_lengths(docs).collect()}
    assert lengths == {(i, count(t)) for i, t in text.items()} | {(None, count("a b")), (9, 0)}


def test_url_rows_stay_apart(spark):
    from pyspark.sql import functions as F

    p = spark.range(200_000).select(F.lit(None).cast("long").alias("page_id"), F.lit("http://a.org/x").alias("url"), F.lit(1).alias("_row"))
    got = url_filter.filter_urls(p)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 200_000 and max(sizes) <= 100_000
    assert url_filter.filter_urls(p.limit(0)).count() == 0
    two = url_filter.filter_urls(spark.createDataFrame([(1, "x://a.b.org/p/q")], "page_id long, url string"), [("allow", "org", "/p/q"), ("block", "b.org", "/p"), ("block", "ORG", "/p/q")])
    assert [(r.rule, r.verdict) for r in two.collect()] == [("b.org/p", "block")]  # as long as org/p/q, but of the longer host


def test_language_of_repeated_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the and of thing").alias("text"), F.lit("en").alias("lang"))
    assert lang_id.train(rows, F.lit(True), n=20) is not None


def test_language_held_out(spark):
    from pathlib import Path

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("needs the driver's tables")
    got = lang_id.op4_language_id(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count() > 0


def test_warc_with_hot_payload(spark, tmp_path):
    big = "<p>" + "x" * 300_000
    rows = [(i, f"u{i}", None if i % 3 else f"<p>{i}") for i in range(300)] + [(300, "l", big), (301, "l", big), (301, "l", big)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    p.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    assert got[1].refers_to == 299 and got[299].record_type == "response" and got[300].refers_to == 301 and got[300].payload_bytes == len(big)
    assert warc.op5_warc(spark, str(tmp_path)).count() == len(rows)
    p.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op5_warc(spark, f"{tmp_path}/none").count() == 0


def test_benchmark_in_passes(spark, docs, monkeypatch):
    own = dict(texts())
    bench = spark.createDataFrame([(1, own[15]), (2, own[3]), (3, "one TWO"), (4, own[16]), (5, "w1 w2 w3"), (None, own[1])], "item_id long, text string")
    key = lambda r: tuple(map(str, r))
    one, kept = sorted(map(key, decontaminate.hits(docs, bench).collect())), sorted(map(key, decontaminate.remove_spans(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 100)
    monkeypatch.setattr(decontaminate, "SHARDS", 1)
    assert sorted(map(key, decontaminate.hits(docs, bench).collect())) == one
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.columns == docs.columns and sorted(map(key, cut.collect())) == kept


def test_nearest_in_shards_and_blocks(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(1200)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 20 = 0")
    truth = {}
    for i, x, in rows[::20]:
        dot = {j: sum(a * b for a, b in zip(x, y)) for j, y in rows if j != i}
        truth[i] = sorted(dot, key=lambda j: (-dot[j], j))[:20]
    for exact, least in ((False, 0.9), (True, 1.0)):
        got = ann.search(v, q, 20, exact=exact, shard_rows=400, block=30).collect()
        assert len(got) == 60 * 20
        assert sum(g.vec_id in truth[g.query_id] for g in got) >= least * len(got)


def test_packing_of_hot_ids(spark):
    from pyspark.sql import functions as F

    d = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit(1).alias("_h"), F.lit(1).alias("length"))
    got = packing.pack(d, (8, 16), vocabulary=token_counts.VOCABULARY).groupBy("bin_id", "pos").count()
    assert got.filter("count > 1").count() == 0 and got.count() == 5000


@pytest.mark.parametrize("broadcast", [True, False])
def test_near_families(spark, monkeypatch, broadcast):
    """Families of copies far from each other's centre, as many links as pairs in each; links stay in proportion to rows."""
    if not broadcast:
        monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
        monkeypatch.setattr(near_dedup, "BROADCAST_PAIRS", 0)
        monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    r = random.Random(9)
    base = r.choices(WORDS, k=64)
    other = [*base[:30], "zz", *base[31:]]
    rows = [(i, " ".join([*base, f"q{i}"])) for i in range(150)] + [(150 + i, " ".join([*other, f"p{i}"])) for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    seen, real = [], near_dedup.components
    near_dedup.components = lambda e: (seen.append(e.count()), real(e))[1]
    try:
        got = near_dedup.groups(d).collect()
    finally:
        near_dedup.components = real
    assert {(r.doc_id < 150, r.component_id) for r in got} == {(True, 0), (False, 150)} and sum(seen) < 4 * len(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(205, 203), (203, 204), (204, 205), (300, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {203: 203, 204: 203, 205: 203}


def test_near_dedup_in_turns(spark):
    """Copies with few edits from few words: long lists in which most don't link, and shared passages."""
    r, words = random.Random(1), [f"v{i}" for i in range(3000)]
    base, third = r.choices(words, k=90), r.choices(words, k=70)
    passages = [r.choices(words, k=45) for _ in range(5)]

    def edited(b, k):
        b = list(b)
        for _ in range(k):
            b[r.randrange(len(b))] = r.choice(words[:12])
        return b

    own = [edited(base, r.choice([1, 2, 2, 3, 4])) for _ in range(110)]
    own += [sum(r.sample(passages, 2), []) + r.choices(words, k=r.choice([0, 2, 9, 40])) for _ in range(110)]
    own += [[*edited(third, 1), f"own{i}"] for i in range(80)]
    sets, parent, where = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in own], [*range(len(own))], {}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, s in enumerate(sets):
        for j in range(i):
            if 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(own)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.groups(d).collect()} == {i: root(i) for i in range(len(own))}


def test_pipeline_against_force(spark, tmp_path):
    """The filtering stages by plain loops, given the trained network."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from .test_small import hits_by_force

    rows = [(i, t, "en" if i % 2 else "de") for i, t in texts() if i not in (None, 26, 27, 28)]
    own = dict((i, t) for i, t, _ in rows)
    rows += [(40, own[15] + " mail a@b.org", "en"), (41, " ".join(own[16].split()[60:75] + WORDS * 2) + " call 10.0.0.1 or c@d.org", "de"), (42, own[1] + " w7", "en")]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    item = " ".join(own[16].split()[60:80])
    spark.createDataFrame([(1, own[15]), (2, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    m = lang_id.train(docs, F.lit(True))
    texts_in = {i: t for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    best, score = lang_id.Predictor(m).languages([t.encode() for t in texts_in.values()])
    left = {i: t for (i, t), s in zip(texts_in.items(), score) if s >= lang_id.LEAST_SCORE}
    sets, parent = {}, {i: i for i in left}
    for i, t in left.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in left:
        for j in left:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    left = {i: t for i, t in left.items() if root(i) == i}
    items = [(k, decontaminate.words_of(t.encode())) for k, t in ((1, own[15]), (2, item))]
    for i, t in [*left.items()]:
        w = decontaminate.words_of(t.encode())
        hit, _ = hits_by_force(w, items, 13)
        if hit and 20 * len(hit) >= len(w):
            del left[i]
            continue
        while hit:
            at = [x.span() for x in decontaminate._WORD.finditer(t.encode())]
            raw, out, end = t.encode(), [], 0
            for k in sorted(hit):
                if k - 1 not in hit:
                    out.append(raw[end : at[k][0]])
                end = at[k][1]
            t = b"\n".join([*out, raw[end:]]).decode()
            hit, _ = hits_by_force(decontaminate.words_of(t.encode()), items, 13)
        left[i] = t
    spots, counts = {i: pii._all(t) for i, t in left.items()}, {}
    for s in (x for v in spots.values() for x in v):
        k = (s["kind"], s["votes"], pii._length_class((s["start"], s["end"], s["kind"])), int(s["base"]))
        counts[k] = counts.get(k, 0) + 1
    w = pii.fit(sorted((*k, n) for k, n in counts.items()))
    want = {i: pii.mask(t, pii._decided(spots[i], w)) for i, t in left.items()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, d).write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
    assert {r.doc_id: r.text for r in now.collect()} == want and 41 in want and "[EMAIL]" in want[41]
    got = corpus_pipeline.run(spark, d).collect()
    count = token_counts.encoder(token_counts.VOCABULARY)
    length = {i: sum(r.length for r in got if r.doc_id == i) for i in want}
    assert length == {i: count(t) for i, t in want.items()} and {r.doc_id for r in got} == set(want)
    assert len({(r.bin_id, r.pos) for r in got if r.bin_id is not None}) == len([r for r in got if r.bin_id is not None])
