"""The links within one family of near copies, in numpy: every pair of it that links is joined."""

from __future__ import annotations

import numpy as np

#: Up to so many sets are compared pair by pair.
FEW = 8
#: A member this much more similar to the centre than what links with it must be leaves the family: that is looked into as well.
CLOSE = 0.25
#: After so many centres, only a centre that an eighth of what is left is close to has a star.
CENTRES = 8


class _Parts:
    """Disjoint sets of places, each named by its smallest."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = sorted((self.root(i), self.root(j)))
        self.up[b] = a
        return a != b


def joined(nodes: list[int], sketches: list[frozenset], least: int, of: int) -> list[tuple[int, int]]:
    """Pairs of ``nodes`` that connect all whose sketches share ``least`` of ``of`` values, or as large a part of fewer."""
    parts, out = _Parts(len(nodes)), []
    for j, b in enumerate(sketches):
        for i in range(j):
            if parts.root(i) != parts.root(j):
                shared = len(sketches[i] & b)
                if shared * of >= least * min(of, len(sketches[i]) + len(b) - shared) and parts.join(i, j) and nodes[i] != nodes[j]:
                    out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return out


def linked_sets(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Each set's component: the smallest of the ``nodes`` that it is reached from; sets of one node are one."""
    parts = _Parts(len(sets))
    first: dict[int, int] = {}
    for i, u in enumerate(nodes.tolist()):
        parts.join(i, first.setdefault(u, i))
    if len(sets) <= FEW:
        _each(sets, range(len(sets)), parts, percent)
    else:
        _stars(sets, parts, percent)
    part = np.array([parts.root(i) for i in range(len(sets))])
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, part, nodes)
    return least[part]


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * 100 >= (len(a) + len(b) - shared) * percent


def _each(sets: list[np.ndarray], places: range, parts: _Parts, percent: int) -> None:
    for j in places:
        for i in range(j):
            if parts.root(i) != parts.root(j) and _links(sets[i], sets[j], percent):
                parts.join(i, j)


def _postings(values: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The owners in the order of their values (below ``n``), and where each value's begin."""
    return owners[np.argsort(values, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(values, minlength=n))])


def _stars(sets: list[np.ndarray], parts: _Parts, percent: int) -> None:
    """Centre by centre: what is close to one is compared with all that it may link with, and leaves.

    The distance of sets, 1 minus their similarity, is a metric, so that what links with a
    close member is at least ``CLOSE`` similar to the centre.  Those that link with the
    centre are joined already; the others' similarity with all comes from the differences
    from the centre, as |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|.
    """
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    top = int(code.max()) + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    rest = np.arange(len(sets))
    for turn in range(len(sets)):
        if len(rest) < 2:
            return
        f = np.concatenate([code[begin[i] : begin[i + 1]] for i in rest])
        o, n = np.repeat(np.arange(len(rest)), size[rest]), size[rest]
        # the centre's shingles are the most widely shared
        centre = int(np.argmax(np.bincount(o, np.bincount(f, minlength=top)[f], len(rest)) / n))
        own = np.full(top, -1)
        base = f[o == centre]
        own[base] = np.arange(len(base))
        place = own[f]
        shared = np.bincount(o[place >= 0], minlength=len(rest))
        union = n + len(base) - shared
        linked = shared * 100 >= union * percent
        close = shared * 100 >= union * (100 * CLOSE + 100 - percent)
        if turn >= CENTRES and close.sum() * 8 < len(rest):
            break
        for i in rest[linked]:
            parts.join(int(rest[centre]), int(i))
        if (close & ~linked).any():
            mid = np.flatnonzero(shared >= union * CLOSE)
            _probe(rest, np.flatnonzero(close & ~linked), mid, f, o, n, place, len(base), top, parts, percent)
        rest = rest[~close]
    _rarest(sets, code, begin, rest, top, parts, percent)


def _probe(rest, far, mid, f, o, n, place, width, top, parts, percent) -> None:  # noqa: ANN001
    """Join each of ``far`` with what it links with among ``mid``; both are places in ``rest``."""
    to = np.full(len(rest), -1)
    to[mid] = np.arange(len(mid))
    keep = to[o] >= 0
    inside = keep & (place >= 0)
    lacks = np.ones((len(mid), width), bool)
    lacks[to[o[inside]], place[inside]] = False
    who, what = np.nonzero(lacks)
    more = keep & (place < 0)
    # a difference is a shingle of the centre that is not there, or, behind these, one that the centre has not
    values, owners = np.concatenate([what, f[more] + width]), np.concatenate([who, to[o[more]]])
    by_value, at = _postings(values, owners, width + top)
    mine, to_mine = _postings(owners, values, len(mid))
    total, size = np.bincount(owners, minlength=len(mid)), n[mid]
    for x in to[far]:
        diff = mine[to_mine[x] : to_mine[x + 1]]
        both = np.bincount(np.concatenate([by_value[at[v] : at[v + 1]] for v in diff]), minlength=len(mid))
        apart = total[x] + total - 2 * both
        for y in np.flatnonzero((size[x] + size - apart) * 100 >= (size[x] + size + apart) * percent):
            parts.join(int(rest[mid[x]]), int(rest[mid[y]]))


def _rarest(sets, code, begin, rest, top, parts, percent) -> None:  # noqa: ANN001
    """Sets that have little in common: two that link share one of so many of their rarest shingles."""
    df = np.bincount(np.concatenate([code[begin[i] : begin[i + 1]] for i in rest]), minlength=top)
    lists: dict[int, list[int]] = {}
    for j in rest.tolist():
        own = code[begin[j] : begin[j + 1]]
        own = own[np.lexsort((own, df[own]))][: len(own) + len(own) * percent // -100 + 1]
        near: set[int] = set()
        for v in own[df[own] > 1].tolist():
            near.update(at := lists.setdefault(v, []))
            at.append(j)
        for i in near:
            if parts.root(i) != parts.root(j) and _links(sets[i], sets[j], percent):
                parts.join(i, j)
