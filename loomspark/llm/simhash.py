"""SimHash near-duplicates: pigeonhole blocks, then the Hamming distance.

A document's fingerprint has a bit for each of 64 hash bits that is set in more than half of its
shingles. Two fingerprints that differ in at most ``d`` bits, cut into ``b`` blocks, agree on at
least ``b - d`` whole blocks, so joining on every choice of ``b - d`` blocks meets every close pair;
what shares a key is verified. More blocks make longer keys: the number of blocks follows the count
of distinct fingerprints, so that a key is shared by a handful of unrelated fingerprints at any size.

Copies collapse to one fingerprint before any join. Fingerprints that share a key are linked by a
breadth-first walk that looks only at those not yet reached and emits at most one link for each, so
a dense group of n near copies gives n links rather than n squared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.common import drop_path, mapped, materialize, shared_dir, table
from loomspark.llm.graph import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
_SLAB = 1 << 14


def fingerprint(data: bytes | None, width: int = SHINGLE) -> int:
    """The fingerprint of one text in UTF-8; without words it is zero."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h64 = xxhash.xxh64_intdigest
    return majority(np.fromiter((h64(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the 64-bit ``hashes``; zero without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLAB):
        bits = np.unpackbits(hashes[i : i + _SLAB].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        values = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(values.view(np.int64))], names=["doc_id", "mark", "fp"])


def keys(fp: str, count: int, distance: int = DISTANCE) -> F.Column:
    """An array of (choice of blocks, their bits) for a fingerprint column."""
    blocks = next((b for b in range(distance + 1, 2 * distance + 1) if 2 ** (64 * (b - distance) // b) >= 8 * count), 2 * distance)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(edges)]
    out = []
    for i, chosen in enumerate(itertools.combinations(masks, blocks - distance)):
        mask = sum(chosen)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(i).cast("short").alias("choice"), F.col(fp).bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*out)


def _walk(x: np.ndarray, distance: int, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Spanning links of the graph of close values of ``x`` (distinct)."""
    rest = x
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), at), found))
                queue.extend(found)
                rest = rest[~near]


def link_groups(batches: Iterator[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (choice, bits) of a sorted partition."""

    def links(choice: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])])
        sizes = np.diff(np.r_[new, len(fp)])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        group = np.repeat(np.arange(len(new)), sizes)
        few = np.flatnonzero((sizes <= 4)[group])
        for gap in range(1, 4):
            a, b = few[few + gap < len(fp)], few[few + gap < len(fp)] + gap
            same = group[a] == group[b]
            a, b = a[same], b[same]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
            out.append((fp[a[near]], fp[b[near]]))
        for g in np.flatnonzero(sizes > 4):
            _walk(fp[new[g] : new[g] + sizes[g]], distance, out)
        u = np.concatenate([x for x, _ in out] or [np.zeros(0, np.uint64)])
        v = np.concatenate([x for _, x in out] or [np.zeros(0, np.uint64)])
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    held: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        columns = [np.asarray(batch.column(c)) for c in ("choice", "bits", "fp")]
        if not len(columns[0]):
            continue
        choice, bits, fp = columns[0], columns[1], columns[2].view(np.uint64)
        last = np.flatnonzero((choice != choice[-1]) | (bits != bits[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links(*(np.concatenate([*h, x[:cut]]) for h, x in zip(held, (choice, bits, fp), strict=True)))
            held = [[x[cut:]] for x in (choice, bits, fp)]
        elif held[0] and (held[0][-1][-1] != choice[0] or held[1][-1][-1] != bits[0]):
            yield links(*(np.concatenate(h) for h in held))
            held = [[x] for x in (choice, bits, fp)]
        else:
            for h, x in zip(held, (choice, bits, fp), strict=True):
                h.append(x)
    if held[0]:
        yield links(*(np.concatenate(h) for h in held))


def _groups(docs: DataFrame, path: str, distance: int) -> tuple[DataFrame, DataFrame]:
    """Stored fingerprints (doc_id, mark, fp) of all rows, and the root of each distinct fingerprint (fp, first_id, root)."""
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    prints = materialize(marked.transform(mapped, _fingerprints, "doc_id long, mark long, fp long"), f"{path}/prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), f"{path}/distinct")
    keyed = distinct.select("fp", F.explode(keys("fp", distinct.count(), distance)).alias("k")).select("k.choice", "k.bits", "fp")
    keyed = keyed.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")
    edges = keyed.transform(mapped, lambda b: link_groups(b, distance), "u long, v long").distinct()
    joined = distinct.join(components(edges), F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined, f"{path}/roots")
    drop_path(docs.sparkSession, f"{path}/distinct")
    return prints, joined


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row a document: doc_id, fp (signed 64 bits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat keep a row
    each. A null doc_id counts for no minimum; a component of such rows alone has a null id.
    """
    prints, roots = _groups(docs, shared_dir(docs.sparkSession), distance)
    firsts = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(firsts, "root").select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id, then the smallest hash of the text.

    A null doc_id stays only where its group has no other. Of rows wholly alike in both, one stays.
    """
    return keep_first(docs, *_groups(docs, shared_dir(docs.sparkSession), distance))


def keep_first(docs: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """The first row of each root, from (doc_id, mark, fp) of all rows and (fp, root)."""
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
    best = prints.join(roots.select(F.col("fp").alias("f"), "root"), F.col("fp") == F.col("f")).groupBy("root").agg(F.min(rank).alias("best"))
    best = best.select(F.coalesce("best.doc_id", F.lit(0)).alias("k_id"), F.col("best.nameless").alias("k_null"), F.col("best.mark").alias("k_mark"))
    row = docs.select(F.struct(*docs.columns).alias("row"))
    keyed = row.select(F.coalesce("row.doc_id", F.lit(0)).alias("k_id"), F.col("row.doc_id").isNull().alias("k_null"), F.xxhash64("row.text").alias("k_mark"), "row")
    kept = keyed.join(best, ["k_id", "k_null", "k_mark"], "left_semi")
    alike = W.partitionBy("k_id", "k_null", "k_mark").orderBy("k_id")
    return kept.withColumn("k_row", F.row_number().over(alike)).where("k_row = 1").select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
