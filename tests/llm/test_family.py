"""Families of near copies, in a task and in turns."""

import random

import numpy as np
import pytest

from leafmill.llm import family, graph, near_dedup


def by_force(nodes, sets, percent):
    up = {u: u for u in nodes}

    def root(u):
        return u if up[u] == u else root(up[u])

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root(nodes[i]), root(nodes[j])))
                up[y] = x
    return [root(u) for u in nodes]


@pytest.mark.parametrize("centres", [0, 1, 8])
def test_family_against_force(monkeypatch, centres):
    monkeypatch.setattr(family, "CENTRES", centres)
    r = random.Random(5 + centres)
    for _ in range(25):
        percent, n = r.choice([75, 80, 85, 100]), r.choice([2, 9, 30, 90])
        bases = [r.sample(range(3000), r.choice([6, 30, 60])) for _ in range(r.choice([1, 2, 5, 40]))]
        sets = []
        for _ in range(n):
            own = list(r.choice(bases)) + list(range(5000, 5000 + r.choice([0, 0, 20])))
            for _ in range(r.choice([0, 1, 2, 4, 8, 12])):
                if r.random() < 0.5 and len(own) > 2:
                    own.pop(r.randrange(len(own)))
                else:
                    own.append(r.choice([r.randrange(3000), r.randrange(10**6)]))
            sets.append(set(own))
        nodes = r.sample(range(10**6), n)
        nodes[0] = nodes[-1] if r.random() < 0.2 else nodes[0]
        got = family.linked_sets(np.array(nodes), [np.array(sorted(s)) for s in sets], percent)
        assert got.tolist() == by_force(nodes, sets, percent)


def family_of(n):
    """Copies of one text, some linked with it and some not, and copies of these."""
    r, words = random.Random(2), [f"w{i}" for i in range(400)]
    base, out = r.choices(words, k=80), []
    for _ in range(n // 2):
        own = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5])):
            own[r.randrange(len(own))] = r.choice(words)
        out += [own, [*own, r.choice(words)]]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in out]
    return [" ".join(w) for w in out], by_force(list(range(len(out))), sets, 85)


def test_family_without_turns(spark, monkeypatch):
    """No list is split, and values meet their counts by the same join in small tables as in large ones."""

    def never(*_):
        raise AssertionError("a list was split")

    real, joins = near_dedup.join_salted, []
    monkeypatch.setattr(near_dedup, "_refined", never)
    monkeypatch.setattr(near_dedup, "join_salted", lambda *a, **k: (joins.append(a[2]), real(*a, **k))[1])
    texts, root = family_of(160)
    got = near_dedup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(root)) and ["x"] in joins


def test_family_too_large_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FAMILY", 1000)
    texts, root = family_of(120)
    small = ["a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y z 1"]
    got = near_dedup.groups(spark.createDataFrame(list(enumerate(texts + small)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate([*root, 120, 120]))


def test_components_by_tables(spark, monkeypatch):
    monkeypatch.setattr(graph, "DRIVER_EDGES", 0)
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 120)] + [(300, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 120)}
