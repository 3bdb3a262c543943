"""Language identification with a byte convolutional network, trained here in numpy.

Every text is cut into windows of ``WINDOW`` bytes (the last one padded with zeros).
Bytes are embedded, filters of several widths slide over the window, each filter keeps
its maximum, and a softmax over these gives the window's language.  A document's
language is that of the largest mean probability over all its windows, weighted by
their bytes; its score is that mean.

Training reads a bounded sample: the ``TRAIN_DOCS`` rows of smallest hash (of id and text)
among those the caller admits, one window from a place that the hash picks and one from
the start.

For prediction the first layer is tabulated: what a filter makes of a pair of bytes is
looked up, so a filter of width four is the sum of two rows.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; rows
without a language teach nothing; with no labelled row at all everything is ``und``;
rows come out as they went in, ids null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

WINDOW = 256
#: Labelled rows that training reads at most.
TRAIN_DOCS = 6_000
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
EPOCHS = 8
#: Windows that go through the network together.
BATCH = 192
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    embed: np.ndarray  # byte, dimension
    filters: list[np.ndarray]  # by width: width, dimension, filter
    bias: np.ndarray  # filters of all widths
    out: np.ndarray  # filters of all widths, label
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What all filters make of a window's first two bytes, and of its last two."""
        steps = [np.zeros((256, self.bias.size), np.float32) for _ in range(4)]
        for k, f in enumerate(self.filters):
            for j in range(f.shape[0]):
                steps[j][:, k * FILTERS : (k + 1) * FILTERS] = self.embed @ f[j]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        return pair(steps[0] + self.bias, steps[1]), pair(steps[2], steps[3])


def windows_of(raw: bytes) -> np.ndarray:
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[bytes], langs: list[str], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Train on windows and their languages: cross entropy, Adam, classes weighted to count alike."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    y = np.array([labels.index(x) for x in langs])
    x = np.concatenate([windows_of(t[:WINDOW]) for t in texts])
    weight = (len(y) / len(labels) / np.bincount(y, minlength=len(labels)))[y] ** 0.5
    m = Model(
        labels, rng.normal(0, 0.3, (256, EMBED)).astype(np.float32),
        [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32),
    )
    params = [m.embed, *m.filters, m.bias, m.out, m.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, longest = 0, max(WIDTHS)
    places = WINDOW - longest + 1
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            b = x[rows]
            e = m.embed[b]
            pooled, where = [], []
            for f in m.filters:
                z = sum(e[:, j : j + places] @ f[j] for j in range(f.shape[0]))
                k = z.argmax(1)
                where.append(k)
                pooled.append(np.take_along_axis(z, k[:, None], 1)[:, 0])
            h = np.concatenate(pooled, 1) + m.bias
            act = np.maximum(h, 0)
            p = _softmax(act @ m.out + m.out_bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (weight[rows] / len(rows))[:, None]
            dh = (p @ m.out.T) * (h > 0)
            grads = [np.zeros_like(m.embed), *[np.zeros_like(f) for f in m.filters], dh.sum(0), act.T @ p, p.sum(0)]
            i = np.arange(len(rows))[:, None]
            for k, f in enumerate(m.filters):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(f.shape[0]):
                    seen = b[i, where[k] + j]
                    grads[1 + k][j] = np.einsum("nfd,nf->df", m.embed[seen], d)
                    np.add.at(grads[0], seen, d[..., None] * f[j].T)
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for q, g, u, v in zip(params, grads, first, second, strict=True):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                q -= (rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


class Predictor:
    def __init__(self, m: Model) -> None:
        self.m = m
        self.head, self.tail = m.tables()
        places = WINDOW - max(WIDTHS) + 1
        self.a = np.empty((BATCH * places, m.bias.size), np.float32)
        self.b = np.empty_like(self.a)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of each window, by label."""
        out, places = [], WINDOW - max(WIDTHS) + 1
        for at in range(0, len(windows), BATCH):
            w = windows[at : at + BATCH].astype(np.int64)
            pairs = w[:, :-1] * 256 + w[:, 1:]
            n = len(w) * places
            a, b = self.a[:n], self.b[:n]
            np.take(self.head, pairs[:, :places].reshape(-1), 0, a, mode="clip")
            np.take(self.tail, pairs[:, 2 : 2 + places].reshape(-1), 0, b, mode="clip")
            a += b
            h = np.maximum(a.reshape(len(w), places, -1).max(1), 0)
            out.append(_softmax(h @ self.m.out + self.m.out_bias))
        return np.concatenate(out)

    def languages(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The label's index and the score of each text; no text may be empty."""
        best, score = np.zeros(len(texts), int), np.zeros(len(texts))
        at = 0
        while at < len(texts):  # some texts at a time, so that memory stays bounded
            end, size = at, 0
            while end < len(texts) and (end == at or size < 4 << 20):
                size += len(texts[end])
                end += 1
            own = [windows_of(t) for t in texts[at:end]]
            p = self.probabilities(np.concatenate(own))
            bytes_in = np.concatenate([np.minimum(WINDOW, len(t) - WINDOW * np.arange(len(w))) for t, w in zip(texts[at:end], own, strict=True)])
            starts = np.cumsum([0, *map(len, own)])[:-1]
            mean = np.add.reduceat(p * bytes_in[:, None], starts) / np.add.reduceat(bytes_in, starts)[:, None]
            best[at:end], score[at:end] = mean.argmax(1), mean.max(1)
            at = end
        return best, np.clip(score, 0, 1)


def train(docs: DataFrame, admitted: Column, n: int = TRAIN_DOCS) -> Model | None:
    """A model from at most ``n`` rows of ``docs`` (doc_id, text, lang) for which ``admitted`` holds."""
    own = docs.filter(admitted & F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("lang"), F.col("text").cast("binary").alias("text"))
    own = own.filter(F.col("text").isNotNull() & (F.octet_length("text") > 0))
    place = F.xxhash64("doc_id", "text", F.lit(7))
    cut = lambda at: F.substring("text", at.cast("int") + 1, F.lit(WINDOW))
    room = F.greatest(F.lit(1), F.octet_length("text") - WINDOW)
    pick = own.select(place.alias("h"), "lang", cut(F.lit(0)).alias("a"), cut(F.pmod(F.shiftright(place, 8), room)).alias("b"))
    # about three times as many as wanted pass, whatever the corpus, and go to the driver's choice;
    # where rows repeat, these may be too few, and more are let through
    share, rows = min(1.0, 3 * n / max(1, own.count())), []
    while True:
        some = F.pmod(F.col("h"), F.lit(1 << 30)) < int((1 << 30) * share)
        rows = pick.filter(some).orderBy("h", "lang", "a").limit(n).collect()
        if len(rows) >= n or share == 1:
            break
        share = min(1.0, 16 * share)
    if not rows:
        return None
    return fit([bytes(x) for r in rows for x in (r.a, r.b)], [r.lang for r in rows for _ in range(2)])


def _predictor(model: Model, kept: dict = {}) -> Predictor:  # noqa: B006  one a worker
    key = model.embed.tobytes()
    if key not in kept:
        kept.clear()
        kept[key] = Predictor(model)
    return kept[key]


def _labelled(text: pa.Array, letters: pa.Array, model: Model | None) -> tuple[list[str], list[float]]:
    raw = [t.as_py() if ok else None for t, ok in zip(text, letters.to_pylist(), strict=True)]
    at = [i for i, t in enumerate(raw) if t]
    langs, scores = [UNKNOWN] * len(raw), [0.0] * len(raw)
    if at and model is not None:
        best, score = _predictor(model).languages([t if isinstance(t, bytes) else t.encode() for t in (raw[i] for i in at)])
        for i, k, s in zip(at, best, score, strict=True):
            langs[i], scores[i] = model.labels[k], float(s)
    return langs, scores


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = _labelled(b.column("text"), b.column("_letter"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", F.col("text").cast("binary").alias("text"), _has_letter(F.col("text")).alias("_letter"))
    return d.mapInArrow(sliced(run), f"doc_id {kind}, lang_pred string, score double")


#: Below this mean probability a text is in no learned language.
LEAST_SCORE = 0.4


def keep_known(docs: DataFrame, model: Model | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, with its own columns, whose language the model knows."""
    shared, letter = docs.sparkSession.sparkContext.broadcast(model), "_letter"
    while letter in docs.columns:
        letter = f"_{letter}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(letter)
            langs, scores = _labelled(b.column("text"), b.column(at), shared.value)
            ok = pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_())
            kept = b.filter(ok)
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(kept.columns) if i != at], schema=b.schema.remove(at))

    return docs.withColumn(letter, _has_letter(F.col("text"))).mapInArrow(sliced(run), docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs, ~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
