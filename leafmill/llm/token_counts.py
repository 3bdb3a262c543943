"""Edit-aware token counts with a segment tree of pre-tokens per document.

A text is cut into leaves at safe places: before a single space between two
non-white-space characters, and between a letter and a sign that is neither letter,
digit, white space nor apostrophe.  A byte-level BPE pre-tokenizer starts a new pre-token
there whatever stands around, so the tokens of a text are the sum over its leaves.  A
tree above the leaves holds sums of characters and tokens.  (A run of letters without any
sign is one pre-token to the tokenizer, however long, and so one leaf.)

``build_trees`` encodes every text once and gives a table of trees: the text with the
characters and tokens of each leaf.  ``apply_edits`` takes such a table, from wherever it
was kept, and edits, and gives the table of the trees after them.  An edit (start, end,
replacement) touches the leaves that it overlaps.  Only these are encoded again, with the
neighbouring leaves as long as the edit has made the cut to them unsafe, and the sums on
the way to the root are updated.

Defined cases: a null text counts as empty (0 tokens); edits are applied from the last
to the first, at positions of the old text, and must not overlap; rows come out as they
went in, whatever their ids; edits given as a table go to every row of their doc_id, and
rows without one get none; a null replacement is empty; other columns are left out.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sliced, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters in a leaf, at least.
LEAF = 256
_SAFE = regex.compile(r"(?<=\S) (?=\S)|(?<=\p{L})(?=[^\s\p{L}\p{N}'])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")

Edit = tuple[int, int, str]


@cache
def encoder(vocabulary: str) -> Callable[[str], int]:
    """A function that counts a text's tokens; the vocabulary is read from a path that every worker has."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("leafmill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def _is_sign(c: str) -> bool:
    return c != "'" and not c.isspace() and unicodedata.category(c)[0] not in "LN"


def safe(left: str, right: str) -> bool:
    """Whether pre-tokens can't cross the cut between two texts."""
    if not left or not right or left[-1].isspace():
        return False
    a, b = left[-1], right[0]
    if b == " ":
        return len(right) > 1 and not right[1].isspace()
    return a.isalpha() and _is_sign(b) or _is_sign(a) and b.isalpha()


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    out, at = [], 0
    while m := _SAFE.search(text, at + size):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class CountTree:
    """A segment tree over leaves: sums of characters and tokens."""

    def __init__(self, text: str, count: Callable[[str], int], size: int = LEAF, kept: tuple[list[int], list[int]] | None = None) -> None:
        """``kept``: the characters and tokens of the leaves, if the text was encoded before."""
        self.count, self.encoded = count, 0
        if kept is None:
            self.leaves = leaves_of(text, size)
            tokens = [*map(count, self.leaves)]
        else:
            ends = [*accumulate(kept[0])]
            self.leaves, tokens = [text[b - n : b] for b, n in zip(ends, kept[0], strict=True)] or [""], kept[1] or [0]
        self.base = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, x in enumerate(self.leaves):
            self.chars[self.base + i], self.tokens[self.base + i] = len(x), tokens[i]
        for v in range(self.base - 1, 0, -1):
            self.chars[v] = self.chars[2 * v] + self.chars[2 * v + 1]
            self.tokens[v] = self.tokens[2 * v] + self.tokens[2 * v + 1]

    def kept(self) -> tuple[list[int], list[int]]:
        """The characters and tokens of the leaves that have text."""
        own = [self.base + i for i, x in enumerate(self.leaves) if x]
        return [self.chars[v] for v in own], [self.tokens[v] for v in own]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where in it; the last leaf with text for the end."""
        at, v = min(at, self.chars[1]), 1
        while v < self.base:
            v *= 2
            if at > self.chars[v] or at == self.chars[v] and self.chars[v + 1]:
                at -= self.chars[v]
                v += 1
        return v - self.base, at

    def _put(self, i: int, text: str, tokens: int) -> None:
        v = self.base + i
        if self.leaves[i] == "" == text:
            return
        self.leaves[i], self.chars[v], self.tokens[v] = text, len(text), tokens
        while v := v // 2:
            self.chars[v] = self.chars[2 * v] + self.chars[2 * v + 1]
            self.tokens[v] = self.tokens[2 * v] + self.tokens[2 * v + 1]

    def replace(self, start: int, end: int, new: str) -> None:
        a, at = self.find(start)
        b, stop = self.find(max(start, end))
        text = self.leaves[a][:at] + new + self.leaves[b][stop:]
        lo, hi = a - 1, b + 1
        while True:  # boundary context: take in neighbours until both cuts are safe
            while lo >= 0 and self.leaves[lo] == "":
                lo -= 1
            while hi < len(self.leaves) and self.leaves[hi] == "":
                hi += 1
            if lo >= 0 and not (text == "" and hi >= len(self.leaves)) and not safe(self.leaves[lo], text or self.leaves[hi]):
                text, a, lo = self.leaves[lo] + text, lo, lo - 1
            elif hi < len(self.leaves) and text != "" and not safe(text, self.leaves[hi]):
                text, b, hi = text + self.leaves[hi], hi, hi + 1
            else:
                break
        self.encoded += len(text)
        for i in range(a + 1, b + 1):
            self._put(i, "", 0)
        self._put(a, text, self.count(text))

    def text(self) -> str:
        return "".join(self.leaves)


_MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]+|(?<![0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])")

_HINT = re.compile(r"@|[0-9]\.[0-9]")


def cleaning_edits(text: str) -> list[Edit]:
    """The query's edits: e-mail and IP addresses masked, and a last line end where it is missing."""
    out: list[Edit] = []
    if _HINT.search(text):
        out = [(m.start(), m.end(), "[address]") for m in _MASKED.finditer(text)]
    if text and not text.endswith("\n"):
        out.append((len(text), len(text), "\n"))
    return out


_TREE = "text string, chars array<int>, tokens array<int>, n_tokens bigint"


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, chars and tokens of the leaves, and n_tokens, of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary)
        for b in batches:
            trees = [CountTree(t.as_py() or "", count) for t in b.column("text")]
            yield _rows(b.column("doc_id"), trees, b.column("text"))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sliced(run), f"doc_id {kind}, {_TREE}")


def _rows(ids: pa.Array, trees: list[CountTree], texts: pa.Array, **more: list[int]) -> pa.RecordBatch:
    kept, ints = [t.kept() for t in trees], pa.list_(pa.int32())
    cols = [ids, texts, pa.array([k[0] for k in kept], ints), pa.array([k[1] for k in kept], ints), pa.array([t.n_tokens for t in trees], pa.int64())]
    return pa.RecordBatch.from_arrays([*cols, *(pa.array(v, pa.int64()) for v in more.values())], names=["doc_id", "text", "chars", "tokens", "n_tokens", *more])


def apply_edits(trees: DataFrame, edits: DataFrame | Callable[[str], list[Edit]], vocabulary: str = VOCABULARY) -> DataFrame:
    """The trees after the edits, with n_leaves, n_before (tokens), n_edits and chars_encoded of this change.

    ``edits``: a table (doc_id, start, end, new), or a function of a text.  A leaf that no
    edit touches isn't encoded; a text that none touches stays as it is.
    """
    kind = trees.schema["doc_id"].dataType.simpleString()
    own, made_by = trees.select("doc_id", "text", "chars", "tokens"), None if isinstance(edits, DataFrame) else edits
    if isinstance(edits, DataFrame):
        some = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", F.coalesce("new", F.lit("")).alias("new"))).alias("edits"))
        own = own.join(some, "doc_id", "left").select(*own.columns, "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary)
        for b in batches:
            after, leaves, before, made, texts = [], [], [], [], []
            given = b.column("edits").to_pylist() if "edits" in b.schema.names else [None] * b.num_rows
            for text, chars, tokens, said in zip(b.column("text").to_pylist(), b.column("chars").to_pylist(), b.column("tokens").to_pylist(), given, strict=True):
                tree = CountTree(text or "", count, kept=(chars, tokens))
                todo = made_by(text or "") if made_by else [(e["start"], e["end"], e["new"]) for e in said or ()]
                leaves.append(len(tree.leaves))
                before.append(tree.n_tokens)
                made.append(len(todo))
                for start, end, new in sorted(todo, reverse=True):
                    tree.replace(start, end, new)
                after.append(tree)
                texts.append(tree.text() if todo else text)
            yield _rows(b.column("doc_id"), after, pa.array(texts, pa.string()), n_leaves=leaves, n_before=before, n_edits=made, chars_encoded=[t.encoded for t in after])

    return own.mapInArrow(sliced(run), f"doc_id {kind}, {_TREE}, n_leaves bigint, n_before bigint, n_edits bigint, chars_encoded bigint")


def count_tokens(docs: DataFrame, edits: DataFrame | Callable[[str], list[Edit]] = cleaning_edits, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_leaves, n_tokens, n_edits, n_tokens_after, chars_encoded_again of each row of ``docs``; the trees are kept in between."""
    after = apply_edits(materialize(build_trees(docs, vocabulary), "trees"), edits, vocabulary)
    return after.select("doc_id", "n_leaves", F.col("n_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), F.col("chars_encoded").alias("chars_encoded_again"))


#: Characters that are encoded at a time where only a text's sum is wanted.
PIECE = 8192


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary)
        for b in batches:
            n = [sum(map(count, leaves_of(t.as_py() or "", PIECE))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sliced(run), f"doc_id {kind}, n_tokens bigint")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
