"""Near copies: SimHash blocks and min-hash bands find candidates, the shingles themselves decide.

A document has the keys of ``simhash.keys``, the choices of blocks of its SimHash fingerprint: every two
documents whose fingerprints differ in at most ``simhash.DISTANCE`` bits share one and are candidates. At a
Jaccard likeness of 0.8 two 64-bit fingerprints differ in about ten bits, which no choice of blocks finds
without meeting most of the corpus. So a document also has ``BANDS`` keys of ``ROWS`` min-hashes each, and
those that share one are candidates too; two with likeness ``s`` share none with probability
(1 - s^ROWS)^BANDS, which is 5e-5 at 0.8, and go where their share of equal min-hashes is three deviations
below the least likeness (about 3e-3 of pairs at it). Only pairs that fingerprints and bands both pass over
are lost. Each candidate is decided on the two sets of shingle hashes (32 bits, so a likeness is off by
about n / 2^32 for n shingles).

Equal sets collapse to one node before any join. A bucket of up to ``FEW`` nodes gives its pairs, which
meet their sets by a join. The nodes of a larger one bring their sets along, and a breadth-first walk
decides at once and looks only at nodes not yet reached, so n near copies give at most n links.
"""

from __future__ import annotations

import itertools
import math
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import drop_path, mapped, materialize, mix64, shared_dir
from loomspark.llm.graph import components
from loomspark.llm.simhash import DISTANCE, keep_first, keys, majority

WIDTH = 5
LIKENESS = 0.8
ROWS, BANDS = 5, 25
SLOTS = ROWS * BANDS
FEW = 32
_SLAB = 1 << 12
_TIMES = mix64(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingles(data: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit hashes of runs of ``width`` words in UTF-8; of all words where there are fewer."""
    words = (data or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h64 = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h64(joined[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def planes(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as four planes of bytes, of which the first compresses to almost nothing."""
    return values.astype(">u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    """The values of ``planes``."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(">u4").reshape(-1).astype(np.uint32)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest of each of ``SLOTS`` hashes over the shingles, 32 bits each."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _SLAB):
        np.minimum(least, (hashes[i : i + _SLAB, None] * _TIMES).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").cast(pa.binary()):
            hashes = shingles(text.as_py())
            low = np.unique((hashes >> np.uint64(32)).astype("<u4"))
            slots = min_hashes(hashes)
            bands = [xxhash.xxh64_intdigest(slots[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
            rows.append((xxhash.xxh64_intdigest(hashes.tobytes()), majority(hashes), np.array(bands, np.uint64).view(np.int64), slots.astype("<u2").tobytes(), planes(low)))
        node = np.array([r[0] for r in rows], np.uint64).view(np.int64)
        print_ = np.array([r[1] for r in rows], np.uint64).view(np.int64)
        columns = [batch.column("doc_id"), batch.column("mark"), pa.array(node), pa.array(print_), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "fp", "print", "bands", "slots", "shingles"])


def _least(likeness: float) -> int:
    """The count of equal slots from which a pair is looked at: three deviations below the likeness."""
    return math.ceil(SLOTS * likeness - 3 * math.sqrt(SLOTS * likeness * (1 - likeness)))


def alike(x: np.ndarray, y: np.ndarray, likeness: float) -> bool:
    """Whether two sorted sets are as alike."""
    both = np.sort(np.concatenate((x, y)))
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= likeness * (len(both) - shared)


def _near(x: np.ndarray, y: np.ndarray, likeness: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` may be as alike: by slots, or by the bits of one fingerprint a row."""
    if x.dtype == np.uint64:
        return np.bitwise_count(x ^ y)[:, 0] <= DISTANCE
    return (x == y).sum(axis=1) >= _least(likeness)


def candidates(slots: np.ndarray, likeness: float = LIKENESS) -> np.ndarray:
    """Pairs of rows of ``slots`` (or fingerprints) that may be as alike, as two columns of places."""
    a, b = np.triu_indices(len(slots), 1)
    near = _near(slots[a], slots[b], likeness)
    return np.stack((a[near], b[near]), axis=1)


def walk(slots: np.ndarray, shingles_of: Callable[[int], np.ndarray], likeness: float = LIKENESS) -> np.ndarray:
    """Spanning links of the graph of pairs that are as alike, as two columns of places."""
    rest, out = np.arange(len(slots)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            own, near = shingles_of(at), _near(slots[rest], slots[at], likeness)
            near[near] = [alike(own, shingles_of(i), likeness) for i in rest[near]]
            out += [(at, i) for i in rest[near]]
            queue.extend(rest[near])
            rest = rest[~near]
    return np.array(out, np.int64).reshape(-1, 2)


class Bucket:
    """The nodes of one key; sets of shingles wait in a file that has no name."""

    def __init__(self) -> None:
        self.nodes, self.slots, self.at, self.file = [], [], [0], None

    def add(self, nodes: np.ndarray, slots: np.ndarray, sets: list[bytes | None]) -> None:
        self.nodes.append(nodes)
        self.slots.append(slots)
        if sets[0] is not None:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
            for x in sets:
                self.file.write(x)
                self.at.append(self.at[-1] + len(x))

    def _set(self, i: int) -> np.ndarray:
        return from_planes(os.pread(self.file.fileno(), self.at[i + 1] - self.at[i], self.at[i]))

    def links(self, likeness: float) -> pa.RecordBatch:
        nodes, slots, sure = np.concatenate(self.nodes), np.concatenate(self.slots), self.file is not None
        if sure:
            self.file.flush()
        found = nodes[walk(slots, self._set, likeness) if sure else candidates(slots, likeness)]
        if sure:
            self.file.close()
        return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1)), pa.array(np.full(len(found), sure))], names=["u", "v", "sure"])


def _links(batches: Iterator[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of a partition sorted by kind of key (``block``: of a fingerprint) and key."""
    last, bucket = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds, shared = batch.column("block").to_numpy(zero_copy_only=False), np.asarray(batch.column("key"))
        fps, traits, sets = np.asarray(batch.column("fp")), batch.column("trait").to_pylist(), batch.column("shingles").to_pylist()
        edges = [0, *(np.flatnonzero((shared[1:] != shared[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(shared)]
        for lo, hi in itertools.pairwise(edges):
            if bucket and (kinds[lo], shared[lo]) != last:
                yield bucket.links(likeness)
                bucket = None
            last, bucket = (kinds[lo], shared[lo]), bucket or Bucket()
            rows = np.frombuffer(b"".join(traits[lo:hi]), "<u8" if kinds[lo] else "<u2").reshape(hi - lo, -1)
            bucket.add(fps[lo:hi], rows, sets[lo:hi])
    if bucket:
        yield bucket.links(likeness)


def _stand(batches: Iterator[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets of shingles are as alike."""
    for batch in batches:
        pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
        keep = [alike(from_planes(a), from_planes(b), likeness) for a, b in pairs]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def links(prints: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(u, v, sure) of distinct nodes of ``prints`` (fp, print, bands, slots, shingles): candidates, and links that stand."""
    nodes = prints.dropDuplicates(["fp"])
    blocks = keys("print", prints.select("print").distinct().count())
    banded = F.transform("bands", lambda x: F.struct(F.lit(False).alias("block"), x.alias("key")))
    blocked = F.transform(blocks, lambda x: F.struct(F.lit(True).alias("block"), F.xxhash64(x["choice"], x["bits"]).alias("key")))
    keyed = nodes.select("fp", F.explode(F.concat(banded, blocked)).alias("k")).select("k.block", "k.key", "fp")
    shared = keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(shared, ["block", "key"]).join(nodes.select("fp", "print", "slots", "shingles"), "fp")
    trait = F.when(F.col("block"), F.unhex(F.lpad(F.hex("print"), 16, "0"))).otherwise(F.col("slots"))
    met = met.select("block", "key", "fp", trait.alias("trait"), F.when(F.col("n") > FEW, F.col("shingles")).alias("shingles"))
    met = met.repartition("block", "key").sortWithinPartitions("block", "key", "fp")
    return met.transform(mapped, lambda b: _links(b, likeness), "u long, v long, sure boolean").groupBy("u", "v").agg(F.bool_or("sure").alias("sure"))


def one_of_each(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """``docs`` with one row of each group of documents linked at ``likeness`` or more.

    Rows are chosen as in ``simhash.one_of_each``. Texts without words are alike.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    rows = materialize(marked.transform(mapped, _prints, "doc_id long, mark long, fp long, print long, bands array<long>, slots binary, shingles binary"), f"{path}/prints")
    pairs = materialize(links(rows, likeness), f"{path}/pairs")
    open_ = pairs.where("not sure")
    wanted = open_.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    sets = materialize(rows.select("fp", "shingles").join(wanted, "fp").dropDuplicates(["fp"]), f"{path}/sets")
    both = open_.join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v")
    edges = materialize(both.select("u", "v", "a", "b").transform(mapped, lambda b: _stand(b, likeness), "u long, v long").union(pairs.where("sure").select("u", "v")), f"{path}/edges")
    prints = materialize(rows.select("doc_id", "mark", "fp"), f"{path}/named")
    for name in ("prints", "pairs", "sets"):
        drop_path(spark, f"{path}/{name}")
    distinct = prints.select("fp").distinct()
    roots = distinct.join(components(edges), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return keep_first(docs, prints, materialize(roots, f"{path}/roots"))
