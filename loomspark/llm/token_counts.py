"""Edit-aware token counts: segment trees over pre-tokens, re-encoded only where edits touch.

A text is split into pre-tokens by the vocabulary's pattern; its tokens are those of its pre-tokens.
Leaves hold up to ``LEAF`` consecutive pre-tokens, and two trees of sums over the leaves give
characters and tokens of any subtree. An edit descends by characters to the leaves it touches, takes
one more to the left (a split looks a few characters ahead), and splits from there until it meets an
old leaf boundary to the right of the edit; from that point on nothing can differ. Only those leaves
are counted again, and only the sums above them change.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import mapped, table

LEAF = 64
#: Characters to the right of a pre-token that can decide where it ends.
AHEAD = 3
_LIMIT = 400_000

_TREE = "doc_id long, text string, chars array<int>, tokens array<int>"
_COUNTS = "doc_id long, n_tokens long, edited_tokens long, n_chars long, edited_chars long, pretokens long, recounted long"


class Counter:
    """Tokens of a pre-token, with a bounded cache."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks, "rb"))}
        self.encoding = tiktoken.Encoding("loom", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def tokens(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = set(pieces).difference(known)
        if new:
            if len(known) + len(new) > _LIMIT:
                known.clear()
                new = set(pieces)
            encode = self.encoding.encode_ordinary
            known.update((p, len(encode(p))) for p in new)
        return list(map(known.__getitem__, pieces))


_counters: dict[tuple[str, str], Counter] = {}


def counter(ranks: str, pattern: str) -> Counter:
    """The worker's counter for a vocabulary."""
    key = (ranks, pattern)
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def _sums(leaves: np.ndarray) -> np.ndarray:
    """A complete binary tree of sums: node i over nodes 2i and 2i + 1, leaves in the second half."""
    size = 1 << max(0, (len(leaves) - 1).bit_length())
    tree = np.zeros(2 * size, np.int64)
    tree[size : size + len(leaves)] = leaves
    while size > 1:
        size //= 2
        tree[size : 2 * size] = tree[2 * size : 4 * size : 2] + tree[2 * size + 1 : 4 * size : 2]
    return tree


@dataclass
class Tree:
    """The sums of one text; ``leaves`` of each half are in use."""

    chars: np.ndarray
    tokens: np.ndarray
    leaves: int

    @classmethod
    def of(cls, chars: np.ndarray, tokens: np.ndarray) -> Tree:
        return cls(_sums(np.asarray(chars, np.int64)), _sums(np.asarray(tokens, np.int64)), len(chars))

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one at the end), and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        leaf = node - self.size
        if leaf >= self.leaves:
            leaf = self.leaves - 1
            start = int(self.chars[1] - self.chars[self.size + leaf])
        return leaf, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        """Changes one leaf and the sums above it."""
        node = self.size + leaf
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def splice(self, first: int, stop: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Replaces leaves ``first`` up to ``stop``; the trees are laid out anew only if their number changes."""
        if len(chars) == stop - first:
            for i, (c, t) in enumerate(zip(chars.tolist(), tokens.tolist(), strict=True)):
                self.set(first + i, c, t)
            return
        lay = lambda tree, new: np.r_[tree[self.size : self.size + first], new, tree[self.size + stop : self.size + self.leaves]]
        fresh = Tree.of(lay(self.chars, chars), lay(self.tokens, tokens))
        self.chars, self.tokens, self.leaves = fresh.chars, fresh.tokens, fresh.leaves


def _leaves(pieces: list[str], counts: list[int], number: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of consecutive leaves: of ``LEAF`` pre-tokens each, or ``number`` of them."""
    if not pieces:
        n = number or 1
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    if number is None:
        cuts = np.arange(0, len(pieces), LEAF)
    else:
        cuts = np.arange(number) * len(pieces) // number
    widths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.add.reduceat(widths, cuts), np.add.reduceat(np.array(counts, np.int64), cuts)


def build(text: str, count: Counter) -> tuple[np.ndarray, np.ndarray, int]:
    """Leaves of a text and its number of pre-tokens."""
    pieces = count.pattern.findall(text)
    return *_leaves(pieces, count.tokens(pieces)), len(pieces)


def edit(text: str, tree: Tree, start: int, stop: int, new: str, count: Counter) -> tuple[str, int]:
    """Replaces text[start:stop]; updates the tree and returns the text and the pre-tokens counted again."""
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    first, begin = tree.leaf_at(start)
    while first > 0 and begin + AHEAD > start:
        first -= 1
        begin -= int(tree.chars[tree.size + first])
    if first > 0:
        first -= 1
        begin -= int(tree.chars[tree.size + first])
    after, shift = text[:start] + new + text[stop:], len(new) - (stop - start)
    last, at = tree.leaf_at(stop)
    bounds = {}
    end = at + int(tree.chars[tree.size + last])
    pieces: list[str] = []
    scan = count.pattern.finditer(after, begin)
    position, reached = begin, tree.leaves
    known = last
    while True:
        while known < tree.leaves and end + shift <= position:
            if end >= stop:
                bounds[end + shift] = known + 1
            known += 1
            if known < tree.leaves:
                end += int(tree.chars[tree.size + known])
        if position > start + len(new) and position in bounds:
            reached = bounds[position]
            break
        m = next(scan, None)
        if m is None:
            break
        pieces.append(m[0])
        position = m.end()
    counts = count.tokens(pieces)
    room = reached - first
    number = room if pieces and room <= len(pieces) <= 2 * LEAF * room else None
    tree.splice(first, reached, *_leaves(pieces, counts, number))
    return after, len(pieces)


def build_trees(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, text) with the leaves of each text: characters and tokens. Null text is kept as null, with one empty leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                made = [build(x.as_py() or "", count) for x in batch.column("text")]
                leaves = [pa.array([m[j].astype(np.int32) for m in made], pa.list_(pa.int32())) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *leaves], names=["doc_id", "text", "chars", "tokens"])

    return docs.select("doc_id", "text").transform(mapped, run, _TREE)


def apply_edits(trees: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Counts before and after ``edits`` (array of start, stop, text), applied in order.

    Each edit is in the characters of the text it meets; positions outside the text are moved to its
    ends. Null edits change nothing; a null text counts as empty. ``recounted`` is the number of
    pre-tokens that were split and counted again, ``pretokens`` that of the whole edited text's leaves
    times their width at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks, pattern)
        for batch in batches:
            rows = []
            for doc_id, text, chars, tokens, edits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "chars", "tokens", "edits")), strict=True):
                text = text or ""
                tree = Tree.of(np.array(chars), np.array(tokens))
                before, n_chars, again = int(tree.tokens[1]), len(text), 0
                for e in edits or []:
                    if e is not None:
                        text, n = edit(text, tree, e["start"] or 0, e["stop"] or 0, e["text"] or "", count)
                        again += n
                rows.append((doc_id, before, int(tree.tokens[1]), n_chars, len(text), tree.leaves * LEAF, again))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [()] * 7)], names=[c.split()[0] for c in _COUNTS.split(", ")])

    return trees.select("doc_id", "text", "chars", "tokens", "edits").transform(mapped, run, _COUNTS)


def revision(text: F.Column) -> F.Column:
    """The edits of the registered query: an insertion at a quarter, a deletion at half, a replacement at three quarters."""
    n = F.coalesce(F.length(text), F.lit(0))
    one = lambda at, width, new: F.struct(F.floor(n * at / 4).cast("int").alias("start"), (F.floor(n * at / 4) + width).cast("int").alias("stop"), F.lit(new).alias("text"))
    return F.array(one(1, 0, " (revised) "), one(2, 24, ""), one(3, 12, "it's 2 new words"))


def default_vocabulary() -> tuple[str, str]:
    """Ranks and split pattern of the public byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Token counts of every document before and after its revision."""
    ranks, pattern = vocabulary or default_vocabulary()
    trees = build_trees(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, pattern)
    return apply_edits(trees.withColumn("edits", revision(F.col("text"))), ranks, pattern)
