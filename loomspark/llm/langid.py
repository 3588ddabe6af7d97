"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, everything but letters becomes single spaces, and runs of one to three
characters are hashed to ``DIMS`` dimensions. A value is the relative frequency of the n-gram in its
text times its inverse document frequency, counted over all labelled training texts. The model is
trained with follow-the-regularised-leader (per-coordinate, elastic net) on a bounded sample: at most
``per_language`` labelled texts of each language, those of smallest hash. One in five of them is held
back to fit the temperature of the softmax.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.common import id_crc, mapped, table

DIMS = 1 << 16
PER_LANGUAGE = 600
#: Shares of a language in which its first rows are chosen before they meet in one task.
SALTS = 64
UNKNOWN = "und"
_SCALE = 100.0
_LETTER = np.zeros(0x110000, dtype=bool)


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTER[ord("a")]:
        _LETTER[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngrams(text: str | None) -> np.ndarray:
    """Hashed n-grams of the whole text, repeats included; none without a letter."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, np.uint32(32))[keep]
    m = np.uint32(0x9E3779B1)
    one = codes * m
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    all_ = np.concatenate([one, two + np.uint32(0x1234567), three + np.uint32(0x89ABCDE)])
    all_ ^= all_ >> np.uint32(16)
    all_ *= np.uint32(0x7FEB352D)
    return all_ >> np.uint32(16)


@dataclass
class Model:
    """Languages and, for each dimension, the weights times the inverse document frequency."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, grams: np.ndarray) -> np.ndarray:
        if len(grams) > 20_000:
            total = np.bincount(grams, minlength=DIMS).astype(np.float32) @ self.weights
        else:
            total = self.weights[grams].sum(axis=0, dtype=np.float64)
        return self.bias + total * (_SCALE / len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(grams) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: the number of texts that hold each dimension, and under -1 the number of texts."""
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for x in batch.column("text"):
            seen = np.zeros(DIMS, bool)
            seen[ngrams(x.as_py())] = True
            df += seen
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[df[at], n])], names=["dim", "df"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of the sampled texts: dimensions and their relative frequencies."""
    for batch in batches:
        rows = []
        for x in batch.column("text"):
            grams = ngrams(x.as_py())
            at, n = np.unique(grams, return_counts=True)
            rows.append((at.astype("<u2").tobytes(), (n / max(1, len(grams))).astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("turn"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "turn", "dims", "tf"])


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 0.1, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dimensions by classes) and bias by FTRL-proximal over sparse rows (dims, values, class)."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def now(at: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0.0, (np.sign(za) * l1 - za) / ((beta + np.sqrt(na)) / alpha + l2))

    for _ in range(epochs):
        for dims, values, y in rows:
            at, x = np.r_[dims, DIMS], np.r_[values, 1.0]
            w = now(at)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = now(np.arange(DIMS + 1))
    return w[:DIMS], w[DIMS]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    lo, hi, ratio = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) that ``learn`` selects and that have a language.

    What reaches the driver is bounded by ``DIMS`` and by ``per_language`` sparse vectors for each
    language: the distinct texts of least hash, so repeated rows count once. The first of a language are
    chosen within ``SALTS`` shares of it, then among those. Without labelled text the model has no
    language and answers ``und``.
    """
    known = docs.where(learn & F.col("lang").isNotNull())
    counts = known.where(F.col("text").isNotNull()).select("text").transform(mapped, _frequencies, "dim int, df long").groupBy("dim").agg(F.sum("df")).collect()
    df, texts = np.zeros(DIMS), 0
    for dim, n in counts:
        if dim < 0:
            texts = n
        else:
            df[dim] = n
    idf = np.log((1.0 + texts) / (1.0 + df)) + 1.0
    turn, print_ = F.xxhash64("doc_id", "lang"), F.xxhash64("text")
    keyed = known.where(F.col("text").isNotNull()).select("lang", turn.alias("turn"), print_.alias("print")).distinct()
    salt = F.pmod("turn", F.lit(SALTS))
    share = W.partitionBy("lang", "salt").orderBy("turn", "print")
    few = keyed.withColumn("salt", salt).withColumn("n", F.row_number().over(share)).where(F.col("n") <= per_language).select("lang", "turn", "print")
    first = W.partitionBy("lang").orderBy("turn", "print")
    chosen = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)
    limit = chosen.groupBy("lang").agg(F.max(F.struct("turn", "print")).alias("last")).collect()
    if not limit:
        return Model([], np.zeros((DIMS, 0)), np.zeros(0), 1.0)
    last = F.map_from_arrays(F.array(*(F.lit(r.lang) for r in limit)), F.array(*(F.struct(F.lit(r.last.turn).alias("turn"), F.lit(r.last.print).alias("print")) for r in limit)))
    bound = F.struct(turn.alias("turn"), print_.alias("print")) <= F.try_element_at(last, F.col("lang"))
    sample = known.where(F.col("text").isNotNull() & bound).select("lang", "text", turn.alias("turn"), print_.alias("print")).dropDuplicates(["lang", "turn", "print"])
    got = sample.transform(mapped, _vectors, "lang string, turn long, dims binary, tf binary").collect()
    got = sorted((r.turn, r.lang, bytes(r.dims), bytes(r.tf)) for r in got)
    languages = sorted({r[1] for r in got})
    rows = []
    for _, lang, dims, tf in got:
        at = np.frombuffer(dims, "<u2").astype(np.int64)
        if len(at):
            rows.append((at, np.frombuffer(tf, "<f4").astype(float) * idf[at] * _SCALE, languages.index(lang)))
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    w, bias = train_ftrl([r for i, r in enumerate(rows) if i % 5 != 4] or rows, len(languages))
    logits = np.array([bias + v @ w[at] for at, v, _ in held]).reshape(len(held), len(languages))
    temperature = fit_temperature(logits, np.array([y for _, _, y in held], dtype=int))
    return Model(languages, (w * idf[:, None]).astype(np.float32), bias, temperature)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to doc_id, text and the other columns of ``docs``, dropping text.

    Null text, empty text and text without a letter give ``und`` with score 0. Whole texts count, of
    any length. Repeated rows keep a row each.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [held.value.predict(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.transform(mapped, run, f"{schema}, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in a language that the model knows with at least ``least`` probability.

    Rows without text or without a letter are rejected. A null lang is filled in; nothing else changes.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [held.value.predict(x.as_py()) for x in batch.column("text")]
            lang = [x.as_py() or g for x, (g, _) in zip(batch.column("lang"), got, strict=True)]
            filled = pa.RecordBatch.from_arrays([pa.array(lang, pa.string()) if c == "lang" else batch.column(c) for c in names], names=names)
            yield filled.filter(pa.array([g != UNKNOWN and p >= least for g, p in got], pa.bool_()))

    return docs.transform(mapped, run, docs.schema)


def held_out(fold: int = 2, folds: int = 4) -> Column:
    return F.pmod(id_crc("doc_id"), F.lit(folds)) == fold


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs, ~held_out())
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
