"""Language-model scores by deleted interpolation of trigram, bigram, unigram and uniform estimates.

A token's probability after the tokens ``u v`` is ``m c(u v t) / c(u v) + (1 - m) p(t | v)``, and
``p(t | v)`` is ``w2 c(v t) / c(v) + w1 c(t) / N + w0 / (V + 1)``. Every weight depends on the bucket of
its context's frequency (powers of two; an unseen context has weight 0). They are learned by
expectation-maximisation on counts held back: one training document in 25 is left out of the counts
that its tokens are scored with, and its tokens, gathered into cells of bucket and rounded log
estimates, are what the weights explain best: first those of the bigram mixture, then ``m`` with that
mixture fixed. The final model counts all training documents. The first token of a document has one
token of context, its start.

Texts never leave their chunk: a chunk of documents is stored as its distinct word hashes, the most
frequent first, and one place among them a token. For words, then for bigrams and trigrams, each chunk
sends the hashes of what it holds, with their counts, to buckets dealt by hash; a bucket adds them up
and answers each chunk in the order of its question, so answers are counts alone. A word or n-gram is
sent once a chunk however frequent it is, so frequent words do not gather. N-grams are told apart by
64-bit hashes.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import free_shuffles, id_crc, mapped, materialize, mix64, shared_dir, table, word_hashes, word_spans
from loomspark.llm.substring import _parts

CHUNK_BYTES = 12_000_000
BUCKET = 1_000_000
BUCKETS = 24
#: Roles of documents: counted, counted but left out while weights are learned, not counted.
COUNTED, LEFT_OUT, HELD_OUT = 0, 1, 2
END = np.uint64(0x6A09E667F3BCC908)
START = np.uint64(0xBB67AE8584CAA73B)
#: Steps of the rounded natural logarithm in the cells of expectation-maximisation.
CELL = 8.0

_CHUNK = "chunk long, role int, ids binary, tokens binary, words binary, index binary"
_ASK = "bucket int, chunk long, role int, hashes binary, counts binary"
_SAY = "bucket int, chunk long, counts binary, total long, distinct long"


WORDS, PAIRS, TRIPLES = 0, 1, 2


def planes(index: np.ndarray) -> bytes:
    """Places as three planes of bytes; frequent words come first, so the upper planes compress well."""
    return np.ascontiguousarray(index.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(3, -1).T
    return out.view("<u4").reshape(-1).astype(np.int64)


def _firsts(row: dict) -> np.ndarray:
    """The place of the first token of each document of a chunk."""
    sizes = np.frombuffer(row["tokens"], np.int32)
    return np.cumsum(sizes) - sizes


def _before(values: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """What stands before each token of a document; ``start`` before the first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = start
    return out


def _grams(words: np.ndarray, index: np.ndarray, first: np.ndarray, level: int) -> np.ndarray:
    """The hash of each token with the one or two before it; a first token has no trigram, but ``START``."""
    tokens = words[index]
    pairs = mix64(_before(tokens, first, START) * np.uint64(0x9E3779B97F4A7C15) + tokens)
    if level == PAIRS:
        return pairs
    out = mix64(_before(pairs, first, START) * np.uint64(0xC2B2AE3D27D4EB4F) + tokens)
    out[first] = START
    return out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents of one role: ids, tokens a document, distinct word hashes, an index a token."""

    made = itertools.count(TaskContext.get().partitionId() << 32)

    def chunk(role: int, ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
        data = b"\n".join(texts)
        starts, ends = word_spans(data.lower())
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begin = np.cumsum(sizes) - sizes
        first = np.searchsorted(starts, begin)
        counts = np.diff(np.r_[first, len(starts)])
        hashes = np.insert(word_hashes(data.lower(), starts, ends), np.r_[first[1:], len(starts)], END)
        words, index, often = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        words, index = words[order], rank[index]
        if len(words) >= 1 << 24:
            raise ValueError("a chunk holds more distinct words than three bytes can number")
        kinds = {"chunk": (next(made), pa.int64()), "role": (role, pa.int32()), "ids": (np.array([[i is None, i or 0] for i in ids], np.int64).tobytes(), pa.binary()), "tokens": ((counts + 1).astype(np.int32).tobytes(), pa.binary()), "words": (words.tobytes(), pa.binary()), "index": (planes(index), pa.binary())}
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in kinds.values()], names=list(kinds))

    held: dict[int, tuple[list, list, list]] = {}
    for batch in batches:
        for doc_id, role, text in zip(batch.column("doc_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            ids, texts, size = held.setdefault(role, ([], [], [0]))
            ids.append(doc_id)
            texts.append(text or b"")
            size[0] += len(texts[-1]) + 64
            if size[0] >= CHUNK_BYTES:
                yield chunk(role, ids, texts)
                del held[role]
    for role, (ids, texts, _) in held.items():
        yield chunk(role, ids, texts)


def _hashes(row: dict, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a stored chunk's words or n-grams, and the place of each token among them."""
    words, index = np.frombuffer(row["words"], np.uint64), from_planes(row["index"])
    return (words, index) if level == WORDS else np.unique(_grams(words, index, _firsts(row), level), return_inverse=True)


def _deal(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(hashes) % np.uint64(buckets)).astype(np.int64)


def _ask(buckets: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, index = _hashes(row, level)
                counts = np.bincount(index, minlength=len(hashes)).astype("<u4")
                rows = [(k, row["chunk"], row["role"], hashes[part].tobytes(), counts[part].tobytes()) for k, part in _parts(_deal(hashes, buckets))]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "chunk", "role", "hashes", "counts"])

    return run


def _say(asked: pa.Table) -> pa.Table:
    """Answers each chunk of a bucket: counts in training, less those left out if the chunk is left out itself."""
    rows = asked.to_pylist()
    hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).astype(np.int64)
    sizes = [len(r["hashes"]) // 8 for r in rows]
    role = np.repeat([r["role"] for r in rows], sizes)
    distinct, at = np.unique(hashes, return_inverse=True)
    every = np.bincount(at, weights=counts * (role != HELD_OUT), minlength=len(distinct)).astype(np.int64)
    kept = np.bincount(at, weights=counts * (role == COUNTED), minlength=len(distinct)).astype(np.int64)
    out, lo, first = [], 0, True
    for r, n in zip(rows, sizes, strict=True):
        answer = every[at[lo : lo + n]].astype("<u4")
        if r["role"] == LEFT_OUT:
            answer = np.r_[answer, kept[at[lo : lo + n]].astype("<u4")]
        # totals of the bucket travel once, with its first answer
        out.append((r["bucket"], r["chunk"], answer.tobytes(), int(every.sum()) if first else 0, int((every > 0).sum()) if first else 0))
        lo, first = lo + n, False
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "chunk", "counts", "total", "distinct"])


@dataclass
class Mixture:
    """Totals of the training tokens, the weights (bigram, unigram, uniform) and the trigram weight of each context bucket."""

    tokens: int
    words: int
    weights: np.ndarray
    third: np.ndarray

    def bigram(self, context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        w = self.weights[bucket_of(context)]
        return w[:, 0] * ratio(pair, context) + w[:, 1] * word / max(1, self.tokens) + w[:, 2] / (self.words + 1)

    def probability(self, two: np.ndarray, triple: np.ndarray, context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        m = self.third[bucket_of(two)]
        return m * ratio(triple, two) + (1 - m) * self.bigram(context, pair, word)


def ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the floor of its binary logarithm, up to the last bucket."""
    out = np.zeros(len(context), np.int64)
    seen = context > 0
    out[seen] = np.minimum(np.log2(context[seen]).astype(np.int64) + 1, BUCKETS - 1)
    return out


def _answers(row: dict, replies: list[dict], buckets: tuple[int, ...], level: int, kept: bool) -> np.ndarray:
    """The count of each token's word or n-gram, put together from the chunk's replies."""
    hashes, index = _hashes(row, level)
    counts = np.zeros(len(hashes), np.int64)
    by = {r["bucket"]: r["counts"] for r in replies if r["level"] == level}
    for k, part in _parts(_deal(hashes, buckets[level])):
        got = np.frombuffer(by[k], "<u4")
        counts[part] = got[len(part) :] if kept else got[: len(part)]
    return counts[index]


def _counts(row: dict, replies: list[dict], buckets: tuple[int, ...], kept: bool, documents: int) -> tuple[np.ndarray, ...]:
    """For each token of a chunk: counts of its two tokens of context, the trigram, its one, the bigram, and itself."""
    word, pair, triple = (_answers(row, replies, buckets, level, kept) for level in (WORDS, PAIRS, TRIPLES))
    first = _firsts(row)
    return _before(pair, first, 0), triple, _before(word, first, documents), pair, word


def _rounded(x: np.ndarray) -> np.ndarray:
    """Steps of the logarithm for cells; one step for zero."""
    return np.where(x > 0, np.round(np.log(np.maximum(x, 1e-300)) * CELL), -10_000).astype(np.int64)


def _gathered(columns: list[np.ndarray]) -> list[tuple]:
    """Distinct rows of whole numbers, each with how often it occurs."""
    keys, count = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    return [(*map(int, k), int(c)) for k, c in zip(keys, count, strict=True)]


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def expectation_maximisation(cells: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of each bucket from cells (bucket, tokens, bigram, unigram, uniform estimates)."""
    weights = np.tile(np.array([0.5, 0.4, 0.1]), (BUCKETS, 1))
    weights[0] = (0.0, 0.8, 0.2)
    if not len(cells):
        return weights
    bucket, n, p = cells[:, 0].astype(int), cells[:, 1], cells[:, 2:]
    everywhere = np.array([0.5, 0.4, 0.1])
    for _ in range(rounds):
        mass = weights[bucket] * p
        share = mass / np.maximum(mass.sum(1, keepdims=True), 1e-300) * n[:, None]
        total = np.stack([np.bincount(bucket, weights=share[:, i], minlength=BUCKETS) for i in range(3)], axis=1)
        everywhere = total.sum(0) / total.sum()
        new = total + 2.0 * everywhere + 1e-3  # two tokens' worth of the average bucket
        new[0, 0] = 0.0
        weights = new / new.sum(1, keepdims=True)
    return weights


def third_weights(cells: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The trigram weight of each bucket from cells (bucket, tokens, trigram estimate, bigram mixture)."""
    weights = np.full(BUCKETS, 0.5)
    weights[0] = 0.0
    if not len(cells):
        return weights
    bucket, n, three, two = cells[:, 0].astype(int), cells[:, 1], cells[:, 2], cells[:, 3]
    size = np.bincount(bucket, weights=n, minlength=BUCKETS)
    for _ in range(rounds):
        own = weights[bucket] * three
        share = np.bincount(bucket, weights=n * own / np.maximum(own + (1 - weights[bucket]) * two, 1e-300), minlength=BUCKETS)
        everywhere = share[1:].sum() / max(size[1:].sum(), 1e-9)
        weights = (share + 2.0 * everywhere) / (size + 2.0)  # two tokens' worth of the average bucket
        weights[0] = 0.0
    return weights


def score(docs: DataFrame, held_out: F.Column, left_out: F.Column) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` documents are never learned from; ``left_out`` ones, of the rest, teach the weights.
    Null text is empty: one end token. Repeated rows are scored and counted once each. With nothing to
    learn from every token has the uniform probability.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    role = F.when(held_out, HELD_OUT).when(left_out, LEFT_OUT).otherwise(COUNTED).alias("role")
    store = materialize(docs.select("doc_id", role, "text").transform(mapped, _store, _CHUNK), f"{path}/store")
    size = store.agg(F.sum(F.octet_length("index") / 3), F.sum(F.octet_length("words") / 8), F.sum(F.when(F.col("role") != HELD_OUT, F.octet_length("ids") / 16)), F.sum(F.when(F.col("role") == COUNTED, F.octet_length("ids") / 16))).first()
    tokens, words, documents, fewer = (int(x or 0) for x in size)
    buckets = (max(1, math.ceil(words / BUCKET)), *[max(1, math.ceil(tokens / BUCKET))] * 2)

    def answers(level: int) -> DataFrame:
        asked = store.transform(mapped, _ask(buckets[level], level), _ASK)
        return materialize(asked.groupBy("bucket").applyInArrow(_say, _SAY), f"{path}/counts-{level}")

    about = [answers(level) for level in (WORDS, PAIRS, TRIPLES)]
    train = about[WORDS].agg(F.sum("total"), F.sum("distinct")).first()
    n, v = int(train[0] or 0), int(train[1] or 0)
    replies = functools.reduce(DataFrame.union, (a.select("chunk", F.lit(level).alias("level"), "bucket", "counts") for level, a in enumerate(about)))
    teach = store.where(F.col("role") == LEFT_OUT)
    taught = teach.groupBy("chunk").cogroup(replies.join(teach.select("chunk"), "chunk", "left_semi").groupBy("chunk"))
    kinds = {"b": pa.int32(), "x": pa.int32(), "y": pa.int32(), "n": pa.int64()}

    def low(chunk: pa.Table, said: pa.Table) -> pa.Table:
        rows, said = [], said.to_pylist()
        for row in chunk.to_pylist():
            _, _, context, pair, word = _counts(row, said, buckets, True, fewer)
            rows += _gathered([bucket_of(context), _rounded(ratio(pair, context)), _rounded(word / max(1, n))])
        return _table(rows, kinds)

    def cells(gather) -> list[tuple]:
        """Cells of the documents left out: at most buckets times steps of two logarithms, whatever the input."""
        found = taught.applyInArrow(gather, "b int, x int, y int, n long").groupBy("b", "x", "y").agg(F.sum("n").alias("n"))
        rows = [tuple(r) for r in found.collect()]
        del found
        free_shuffles(spark)
        return rows

    value = lambda x: 0.0 if x <= -10_000 else math.exp(x / CELL)
    weights = expectation_maximisation(np.array([(b, c, value(x), value(y), 1 / (v + 1)) for b, x, y, c in cells(low)], float).reshape(-1, 5))
    lower = Mixture(n, v, weights, np.zeros(BUCKETS))

    def high(chunk: pa.Table, said: pa.Table) -> pa.Table:
        rows, said = [], said.to_pylist()
        for row in chunk.to_pylist():
            two, triple, *rest = _counts(row, said, buckets, True, fewer)
            seen = two > 0
            rows += _gathered([bucket_of(two[seen]), _rounded(ratio(triple[seen], two[seen])), _rounded(lower.bigram(*(x[seen] for x in rest)))])
        return _table(rows, kinds)

    model = Mixture(n, v, weights, third_weights(np.array([(b, c, value(x), value(y)) for b, x, y, c in cells(high)], float).reshape(-1, 4)))
    floor = 0.0 if n else 1.0

    def scored(chunk: pa.Table, said: pa.Table) -> pa.Table:
        rows, said = [], said.to_pylist()
        for row in chunk.to_pylist():
            counts = _counts(row, said, buckets, False, documents)
            word, first, size = counts[-1], _firsts(row), np.frombuffer(row["tokens"], np.int32)
            base = np.add.reduceat(np.log10((word + 0.5) / (n + 0.5 * (v + 1))), first)
            full = np.add.reduceat(np.log10(np.maximum(model.probability(*counts), floor or 1e-300)), first)
            known = np.add.reduceat((word > 0).astype(np.int64), first)
            ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
            held = row["role"] == HELD_OUT
            rows += [(None if null else int(i), held, int(s), int(k), n, float(b), float(f)) for (null, i), s, k, b, f in zip(ids, size, known, base, full, strict=True)]
        return _table(rows, {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()})

    return store.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose crc32 is not 1 modulo 5."""
    crc = id_crc("doc_id")
    return score(table(spark, sf_dir, "documents", "doc_id", "text"), F.pmod(crc, F.lit(5)) == 1, F.pmod(crc, F.lit(25)) == 2)
