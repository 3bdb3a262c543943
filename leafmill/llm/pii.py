"""Personal data by weak supervision.

Base spans are what the four base patterns and their checks find; they always stay.
Looser patterns propose further candidates, mostly what a base pattern has run together
or missed for its form.  On every span, base ones included, regex, gazetteer and
context labelers vote yes, no or nothing.  The corpus's counts of (kind, vote pattern,
length class), a table whose size doesn't depend on the corpus, go to
expectation-maximisation, which estimates each labeler's reliabilities and each
pattern's probability; a logistic classifier fitted to these decides which candidates
become spans.  Added spans overlap no other span.

Defined cases: a null text counts as empty (no spans, the digest of nothing); rows come
out as they went in, ids null or repeated; without any candidate in the corpus the
classifier adds nothing; other columns are left out of ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, materialize, sliced, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, index of the kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass their check, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            a = m.start()
            while a > end and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                end = m.end()
                out.append((a, end, 0))
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    out.sort(key=lambda x: (x[0], x[2]))
    return out


# Candidates beyond the base patterns.
_LOOSE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]+)+", re.I), ("[at]", "(at)", "{at}")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"), ()),
    (2, re.compile(r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{2,7}(?![0-9])"), ()),
    (2, re.compile(r"(?<![0-9])[0-9]{14,19}(?![0-9])"), ()),
    (3, re.compile(r"(?:(?<![0-9])|(?<=[0-9] ))\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"), ("+",)),
    (3, re.compile(r"(?<![0-9+(])(?<!\+[0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"), ()),
)
# Words that speak for or against a kind, in the languages of the corpus.
_CUES = (
    re.compile(r"(?i)\b(?:e-?mail|mail|contact|kontakt|contacto|courriel|correo|write to)\b"),
    re.compile(r"(?i)\b(?:ip|host|address|server|adresse|direcci[oó]n|client|login)\b"),
    re.compile(r"(?i)\b(?:card|carte|karte|tarjeta|visa|mastercard|credit|payment)\b"),
    re.compile(r"(?i)\b(?:phone|tel|telefon|t[eé]l[eé]phone|tel[eé]fono|call|mobile|cell|fax)\b"),
)
_AGAINST = re.compile(r"(?i)(?:\b(?:version|license|lizenz|licence|licencia|isbn|issn|doi|section|order|invoice)\b|[$€£#=])[^\n]{0,8}$")
_TOP = frozenset("com org net edu gov io info biz de fr es uk eu us ch at".split())
_STRICT = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), _IP, _CARD, _PHONE,
)
_GROUPED = (
    re.compile(r"[A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*@[A-Za-z0-9.-]+"), re.compile(r"[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}"),
    re.compile(r"[3-6](?:[0-9]{13,18}|[0-9]{3}(?:[ -][0-9]{4}){2}[ -][0-9]{2,7})"), re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
)
#: How far the context labelers look back.
CONTEXT = 40


def _valid(kind: int, s: str) -> bool:
    if kind == 0:
        return re.split(r"[^A-Za-z0-9-]+", s.rstrip("])}"))[-1].lower() in _TOP
    if kind == 1:
        return _octets(s)
    n = len(digits_of(s))
    return 14 <= n <= 19 and luhn(digits_of(s)) if kind == 2 else 10 <= n <= 15


def _edge(text: str, a: int, b: int) -> bool:
    return (a == 0 or not (text[a - 1].isalnum() or text[a - 1] in "_=/-")) and (b == len(text) or not (text[b].isalnum() or text[b] in "_=/"))


#: The labelers in order: strict form, check, cue word, word against, free standing, usual grouping.
N_LABELERS = 6


def votes(text: str, span: Span) -> str:
    """One character a labeler: y, n or - for none."""
    a, b, kind = span
    s, before = text[a:b], text[max(0, a - CONTEXT) : a]
    return "".join((
        "y" if _STRICT[kind].fullmatch(s) else "-",
        "y" if _valid(kind, s) else "n",
        "y" if _CUES[kind].search(before) else "-",
        "n" if _AGAINST.search(before) else "-",
        "y" if _edge(text, a, b) else "n",
        "y" if _GROUPED[kind].fullmatch(s) else "n",
    ))


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Loose matches that overlap no base span and no earlier candidate."""
    found: list[Span] = []
    digits, low = _DIGIT.search(text) is not None, text.lower()
    for kind, pattern, needs in _LOOSE:
        if (any(x in low for x in needs) if kind == 0 else digits and all(x in text for x in needs)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    # the taken stretches are disjoint and in order, so the only one to look at is found by bisection
    starts, ends = [], []
    for a, b, _ in sorted(base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out: list[Span] = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        k = bisect_left(starts, b) - 1
        if (k < 0 or ends[k] <= a) and (not out or a >= out[-1][1]):
            out.append((a, b, kind))
    return out


def _length_class(span: Span) -> int:
    return min(7, (span[1] - span[0]) // 4)


# --- reliabilities and the classifier

Row = tuple[int, str, int, int, int]  # kind, votes, length class, is base, count


def expectation_maximisation(counts: dict[tuple[int, str], int], rounds: int = 60) -> dict[tuple[int, str], float]:
    """The probability of each (kind, votes), labelers being independent given the truth."""
    out: dict[tuple[int, str], float] = {}
    for kind in {k for k, _ in counts}:
        patterns = sorted(p for k, p in counts if k == kind)
        n = np.array([counts[kind, p] for p in patterns], float)
        seen = np.array([["yn-".index(c) for c in p] for p in patterns])
        hot = np.eye(3)[seen]  # pattern, labeler, vote
        belief = 1 / (1 + np.exp(-1.5 * ((seen == 0).sum(1) - 2.0 * (seen == 1).sum(1) - 0.5)))
        for _ in range(rounds):
            # two pseudo-counts hold each labeler to be better than chance
            prior = (n @ belief + 1) / (n.sum() + 2)
            yes = np.einsum("p,plv->lv", n * belief, hot) + [2.0, 0.5, 1.0]
            no = np.einsum("p,plv->lv", n * (1 - belief), hot) + [0.5, 2.0, 1.0]
            yes, no = yes / yes.sum(1, keepdims=True), no / no.sum(1, keepdims=True)
            score = np.log(prior / (1 - prior)) + np.einsum("plv,lv->p", hot, np.log(yes / no))
            belief = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        out |= {(kind, p): float(x) for p, x in zip(patterns, belief, strict=True)}
    return out


def _features(kind: int, pattern: str, size: int) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * N_LABELERS + 8)
    x[0] = x[1 + kind] = x[1 + len(KINDS) + 2 * N_LABELERS + size] = 1
    for i, c in enumerate(pattern):
        x[1 + len(KINDS) + 2 * i + (c == "n")] = c != "-"
    return x


def fit(rows: list[Row], steps: int = 300) -> np.ndarray:
    """Weights of the final classifier, from counted vote patterns."""
    if not rows:
        return _features(0, "-" * N_LABELERS, 0) * 0 - 1
    counts: dict[tuple[int, str], int] = {}
    for kind, pattern, _, _, n in rows:
        counts[kind, pattern] = counts.get((kind, pattern), 0) + n
    belief = expectation_maximisation(counts)
    x = np.stack([_features(k, p, s) for k, p, s, _, _ in rows])
    y = np.array([belief[k, p] for k, p, *_ in rows])
    n = np.array([r[-1] for r in rows], float)
    n = np.sqrt(n) / np.sqrt(n).sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton with a small ridge
        q = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (n * (q - y)) + 1e-4 * w
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: A candidate becomes a span from this probability on.
THRESHOLD = 0.6


def accepts(w: np.ndarray, kind: int, pattern: str, size: int) -> bool:
    # a failed check isn't outvoted: such a number can't be in use
    return pattern[1] == "y" and 1 / (1 + np.exp(-float(_features(kind, pattern, size) @ w))) >= THRESHOLD


# --- over tables

_SPANS = "array<struct<start:int,end:int,kind:int,votes:string,base:boolean>>"


def _all(text: str | None) -> list[dict]:
    if not text:
        return []
    base = base_spans(text)
    both = [(s, True) for s in base] + [(s, False) for s in candidates(text, base)]
    return [{"start": s[0], "end": s[1], "kind": s[2], "votes": votes(text, s), "base": b} for s, b in both]


_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("votes", pa.string()), ("base", pa.bool_())]))


def spotted(docs: DataFrame, column: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id by default) and all base and candidate spans with their votes in ``column``."""
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = pa.array([_all(t.as_py()) for t in b.column("text")], _ARROW)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), spans], names=[*keep, column])

    kept = docs.select(*keep)
    names = [*keep] if "text" in keep else [*keep, "text"]
    return docs.select(*names).mapInArrow(sliced(run), _schema(kept, column))


def _schema(kept: DataFrame, column: str) -> str:
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return ", ".join([*fields, f"`{column}` {_SPANS}"])


def train(spots: DataFrame, column: str = "spans") -> np.ndarray:
    """The classifier from the whole corpus's counts; these are at most some thousand rows."""
    s = spots.select(F.explode(column).alias("s"))
    size = F.least(F.lit(7), F.floor((F.col("s.end") - F.col("s.start")) / 4).cast("int"))
    rows = s.groupBy("s.kind", "s.votes", size.alias("size"), F.col("s.base").cast("int").alias("base")).agg(F.count("*").alias("n")).collect()
    return fit(sorted((r.kind, r.votes, r["size"], r.base, r.n) for r in rows))


def _decided(spans: list[dict], w: np.ndarray) -> list[dict]:
    keep = [s for s in spans if s["base"] or accepts(w, s["kind"], s["votes"], _length_class((s["start"], s["end"], s["kind"])))]
    return sorted(keep, key=lambda s: (s["start"], s["kind"], s["end"]))


def _said(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans of each row of ``docs``."""
    spots = materialize(spotted(docs), "pii")
    w = train(spots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans = [], [], []
            for s in b.column("spans").to_pylist():
                base = [x for x in s if x["base"]]
                counts.append([sum(x["kind"] == k for x in base) for k in range(len(KINDS))])
                digests.append(hashlib.sha256(_said(base).encode()).hexdigest())
                spans.append(_said(_decided(s, w)))
            cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return spots.mapInArrow(sliced(run), f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def mask(text: str, spans: list[dict]) -> str:
    """The text with each stretch of spans replaced by its first span's kind."""
    out, end = [], 0
    for s in spans:
        if s["start"] >= end:
            out += [text[end : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        end = max(end, s["end"])
    return "".join([*out, text[end:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, personal data in ``text`` masked."""
    column = free("_spans", docs.columns)
    # written with their spans, so that the patterns run over the corpus once
    spots = materialize(spotted(docs, column, docs.columns), "pii")
    w = train(spots, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, spans = b.schema.get_field_index("text"), b.column(b.schema.get_field_index(column))
            texts = [mask(t, _decided(s, w)) if s else t for t, s in zip(b.column(at).to_pylist(), spans.to_pylist(), strict=True)]
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b.select([c for c in b.schema.names if c != column])

    return spots.mapInArrow(sliced(run), docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
