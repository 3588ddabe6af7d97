"""Substring deduplication over a log-structured fingerprint index.

A window is 20 consecutive words. Every window elects one of its short word runs as its anchor, the
one of least hash, so equal windows elect equal anchors and about one word in eight is an anchor.

The index is a log-structured merge tree of anchors: immutable runs, each cut into buckets by hash
and sorted within. A new batch is merge-joined bucket by bucket with every run; an anchor met before
(in a run or in the batch) is a candidate, with the place of its first occurrence. Anchors not met
before make the batch's own run, and when as many runs as ``fanout`` have gathered they are compacted
into one. Candidates are then verified on the windows themselves: windows that elected a candidate are
compared by 96 bits of two hashes of all 20 words that share no base, and all but the earliest of equal
windows are repeated. A document loses each word that a repeated window covers.

Common passages do not gather in one task: a chunk of documents sends each anchor and each window
once, with its earliest place, and settles its other occurrences itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import drop_path, free_shuffles, gram_hashes, mapped, mix64, shared_dir, table, word_hashes, word_spans

WINDOW = 20
ANCHOR = 6
#: Words of a chunk, at least, and in expectation anchors or windows of a bucket.
CHUNK_WORDS = 1_500_000
ANCHOR_BUCKET = 100_000
BUCKET = 500_000
NULL_ID = -(1 << 63)

_ENTRY = "bucket int, kind int, hashes binary, dids binary, places binary"
_FLAG, _RUN = 1, 2


class Chunk:
    """The words of consecutive documents as one array."""

    def __init__(self, texts: list[bytes]) -> None:
        data = b"\n".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begin = np.cumsum(sizes) - sizes
        starts, ends = word_spans(data)
        self.words = word_hashes(data, starts, ends)
        self.doc = np.searchsorted(self.begin, starts, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))

    def windows(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows within one document, the anchor position of each, and all anchor hashes."""
        n = len(self.words) - window + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        runs = gram_hashes(self.words, anchor)
        at, width, span = np.arange(len(runs)), 1, window - anchor + 1
        while width < span:
            step = min(width, span - width)
            other = at[step:]
            at = at[: len(other)]
            at = np.where(runs[other] < runs[at], other, at)
            width += step
        starts = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :])
        return starts, at[starts], runs


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list, ...]]:
    """Lists of columns for chunks of documents of about ``CHUNK_WORDS`` words."""
    held: list[list] = [[] for _ in columns]
    weight = 0
    for batch in batches:
        for row in zip(*((batch.column(c).cast(pa.binary()) if c == "text" else batch.column(c)).to_pylist() for c in columns), strict=True):
            for h, x in zip(held, row, strict=True):
                h.append(x)
            weight += len(row[columns.index("text")] or b"") + 8
            if weight >= 6 * CHUNK_WORDS:
                yield tuple(held)
                held, weight = [[] for _ in columns], 0
    if held[0]:
        yield tuple(held)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "kind", "hashes", "dids", "places"])


def _dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(hashes + np.uint64(0x632BE59BD9B4E019)) % np.uint64(buckets)).astype(np.int64)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, with the positions of its entries in their order."""
    by = np.argsort(bucket, kind="stable")
    new = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0]) if len(by) else np.zeros(0, np.int64)
    for lo, hi in zip(new.tolist(), np.r_[new[1:], len(by)].tolist(), strict=False):
        yield int(bucket[by[lo]]), by[lo:hi]


def _anchor_rows(buckets: int, window: int, anchor: int):
    """Per chunk and bucket: each anchor once with its first place; places of those that repeat in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dids, texts in _chunks(batches, ["did", "text"]):
            chunk, ids = Chunk([t or b"" for t in texts]), np.array(dids, np.int64)
            _, at, runs = chunk.windows(window, anchor)
            at = np.unique(at)
            doc = chunk.doc[at]
            hashes, did, place = runs[at], ids[doc], (at - chunk.first[doc]).astype(np.int32)
            order = np.argsort(hashes, kind="stable")
            hashes, did, place = hashes[order], did[order], place[order]
            new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
            again = ~new
            again[:-1] |= again[1:]
            bucket = _dealt(hashes, buckets)
            rows = []
            for kind, keep in ((0, new & ~again), (3, new & again)):
                h, d, p, b = hashes[keep], did[keep], place[keep], bucket[keep]
                rows += [(k, kind, h[part].tobytes(), d[part].tobytes(), p[part].tobytes()) for k, part in _parts(b)]
            if again.any():
                rows.append((int(hashes[0] % np.uint64(buckets)), _FLAG, b"", did[again].tobytes(), place[again].tobytes()))
            yield _rows(rows)

    return run


def _joined(found: pa.Table, kinds: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Hashes, ids, places and kinds of the blobs of the given kinds, end to end."""
    at = [i for i, k in enumerate(found["kind"].to_pylist()) if k in kinds]
    take = found.take(pa.array(at, pa.int64()))
    columns = [np.frombuffer(b"".join(take[c].to_pylist()), t) for c, t in (("hashes", np.uint64), ("dids", np.int64), ("places", np.int32))]
    sizes = [len(h) // 8 for h in take["hashes"].to_pylist()]
    return *columns, np.repeat(np.array(take["kind"].to_pylist(), np.int32), np.array(sizes, np.int64))


def _probe(batch: pa.Table, history: pa.Table) -> pa.Table:
    """Merge-joins one bucket of a batch with the runs: candidate places, and what is new."""
    if not batch.num_rows:
        return pa.Table.from_batches([_rows([])])
    bucket = batch["bucket"][0].as_py()
    old, old_did, old_place, _ = _joined(history, (_RUN,))
    new, did, place, kind = _joined(batch, (0, 3))
    order = np.argsort(new, kind="stable")
    new, did, place, kind = new[order], did[order], place[order], kind[order]
    first = np.r_[True, new[1:] != new[:-1]] if len(new) else np.zeros(0, bool)
    repeated = ~first
    repeated[:-1] |= repeated[1:]
    if len(old):
        by = np.argsort(old, kind="stable")  # runs are sorted: this merges them
        old, old_did, old_place = old[by], old_did[by], old_place[by]
        where = np.minimum(np.searchsorted(old, new), len(old) - 1)
        met = old[where] == new
    else:
        where, met = np.zeros(len(new), np.int64), np.zeros(len(new), bool)
    flag = (repeated | met) & (kind == 0)
    hit = np.unique(where[met])
    rows = [(bucket, _FLAG, b"", np.r_[did[flag], old_did[hit]].tobytes(), np.r_[place[flag], old_place[hit]].tobytes())]
    rows += [(bucket, _FLAG, b"", d, p) for k, d, p in zip(*(batch[c].to_pylist() for c in ("kind", "dids", "places")), strict=True) if k == _FLAG]
    fresh = first & ~met
    rows.append((bucket, _RUN, new[fresh].tobytes(), did[fresh].tobytes(), place[fresh].tobytes()))
    return pa.Table.from_batches([_rows(rows)])


def _compact(found: pa.Table) -> pa.Table:
    """One sorted blob from those of several runs of a bucket."""
    hashes, did, place, _ = _joined(found, (_RUN,))
    by = np.argsort(hashes, kind="stable")
    return pa.Table.from_batches([_rows([(found["bucket"][0].as_py(), _RUN, hashes[by].tobytes(), did[by].tobytes(), place[by].tobytes())])])


class FingerprintIndex:
    """Runs of anchors in a shared folder. ``buckets`` is fixed when the index is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, window: int = WINDOW, anchor: int = ANCHOR, fanout: int = 2) -> None:
        self.spark, self.path, self.buckets, self.window, self.anchor, self.fanout = spark, path, buckets, window, anchor, fanout
        self.runs: list[str] = []
        self.flags: list[str] = []
        self.made = 0

    def _read(self, paths: list[str], kind: int) -> DataFrame:
        """Entries of one kind, which is a partition of every folder."""
        found = self.spark.createDataFrame([], _ENTRY)
        for p in paths:
            found = found.unionByName(self.spark.read.schema(_ENTRY).parquet(p).where(F.col("kind") == kind))
        return found

    def ingest(self, docs: DataFrame) -> None:
        """Adds a batch (did, text): writes its run and the candidate places that it brings."""
        rows = docs.select("did", "text").transform(mapped, _anchor_rows(self.buckets, self.window, self.anchor), _ENTRY)
        found = rows.groupBy("bucket").cogroup(self._read(self.runs, _RUN).groupBy("bucket")).applyInArrow(_probe, _ENTRY)
        self.made += 1
        path = f"{self.path}/batch-{self.made}"
        found.write.option("compression", "zstd").partitionBy("kind").parquet(path)
        free_shuffles(self.spark)
        self.flags.append(path)
        self.runs.append(path)
        if len(self.runs) > self.fanout:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one and deletes them."""
        old, self.made = self.runs, self.made + 1
        path = f"{self.path}/compact-{self.made}"
        self._read(old, _RUN).groupBy("bucket").applyInArrow(_compact, _ENTRY).write.option("compression", "zstd").partitionBy("kind").parquet(path)
        self.runs = [path]
        for p in old:
            drop_path(self.spark, f"{p}/kind={_RUN}")

    def candidates(self) -> DataFrame:
        """(did, places): every document's candidate anchors, as 32-bit integers."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dids, places in zip(batch.column("dids").to_pylist(), batch.column("places").to_pylist(), strict=True):
                    did, place = np.frombuffer(dids, np.int64), np.frombuffer(places, np.int32)
                    by = np.lexsort((place, did))
                    did, place = did[by], place[by]
                    new = np.flatnonzero(np.r_[True, did[1:] != did[:-1]]) if len(did) else np.zeros(0, np.int64)
                    data, ends = place.tobytes(), np.r_[new[1:], len(did)][: len(new)]
                    yield pa.RecordBatch.from_arrays([pa.array(did[new]), pa.array([data[4 * a : 4 * b] for a, b in zip(new.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["did", "places"])

        flags = self._read(self.flags, _FLAG).select("dids", "places").transform(mapped, rows, "did long, places binary")
        return flags.groupBy("did").agg(F.collect_list("places").alias("places"))


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every window, and 32 bits of one with another base over otherwise mixed words."""
    check = gram_hashes(mix64(words + np.uint64(0x2545F4914F6CDD1D)), window, base=np.uint64(0xC2B2AE3D27D4EB4F))
    return gram_hashes(words, window, salt=0x5851F42D4C957F2D), (check >> np.uint64(32)).astype(np.uint32)


def _first_of_equal(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Whether an entry differs from the one before it, in sorted order."""
    if not len(hashes):
        return np.zeros(0, bool)
    return np.r_[True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])]


def _window_rows(buckets: int, window: int, anchor: int):
    """Windows that elected a candidate: one entry a chunk, bucket and hash; repeats within the chunk settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for dids, marks, texts, places in _chunks(batches, ["did", "mark", "text", "places"]):
            chunk = Chunk([t or b"" for t in texts])
            starts, at, _ = chunk.windows(window, anchor)
            candidate = np.zeros(len(chunk.words) + 1, bool)
            for first, blobs in zip(chunk.first.tolist(), places, strict=True):
                spots = np.frombuffer(b"".join(blobs), np.int32) + first
                candidate[spots[spots < len(chunk.words)]] = True
            starts = starts[candidate[at]]
            hashes, checks = (h[starts] if len(starts) else np.zeros(0, np.uint64) for h in window_hashes(chunk.words, window))
            ids = np.stack([np.array(dids, np.int64), np.array(marks, np.int64)], axis=1)
            rank = np.unique(ids, axis=0, return_inverse=True)[1].reshape(-1)
            doc = chunk.doc[starts]
            place = starts - chunk.first[doc]
            by = np.lexsort((place, rank[doc], checks, hashes))
            hashes, checks, doc, place = hashes[by], checks[by], doc[by], place[by]
            new = _first_of_equal(hashes, checks)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            repeated = (rank[doc] != rank[doc[lead]]) | (place != place[lead])
            name += 1
            rows = [(-1 - name % 997, name, None, *_compact_places(doc[repeated], place[repeated], ids))] if repeated.any() else []
            hashes, checks, doc, place = hashes[new], checks[new], doc[new], place[new]
            for k, part in _parts(_dealt(hashes, buckets)):
                rows.append((k, name, hashes[part].tobytes() + checks[part].tobytes(), *_compact_places(doc[part], place[part], ids)))
            yield _answer(rows)

    return run


_ANSWER = "bucket int, chunk long, hashes binary, ids binary, places binary"


def _answer(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "chunk", "hashes", "ids", "places"])


def _compact_places(doc: np.ndarray, place: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes]:
    """The ids of the documents that occur, and for each entry its document among them and its place."""
    docs, slot = np.unique(doc, return_inverse=True)
    return ids[docs].tobytes(), np.stack([slot.astype(np.int32), place.astype(np.int32)], axis=1).tobytes()


def _spread(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, document of each entry and its place, of several compact blobs end to end."""
    ids, slots, places, base = [], [], [], 0
    for i, p in rows:
        own, spot = np.frombuffer(i, np.int64).reshape(-1, 2), np.frombuffer(p, np.int32).reshape(-1, 2)
        ids.append(own)
        slots.append(spot[:, 0].astype(np.int64) + base)
        places.append(spot[:, 1])
        base += len(own)
    return np.concatenate(ids), np.concatenate(slots), np.concatenate(places)


def _settle(found: pa.Table) -> pa.Table:
    """Tells each chunk which of its windows in a bucket are repeated: all but the earliest of equal ones.

    What a chunk has settled itself passes.
    """
    if found["bucket"][0].as_py() < 0:
        return found
    blobs = found["hashes"].to_pylist()
    sizes = [len(b) // 12 for b in blobs]
    hashes = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(blobs, sizes, strict=True)])
    checks = np.concatenate([np.frombuffer(b, np.uint32, n, 8 * n) for b, n in zip(blobs, sizes, strict=True)])
    chunk = np.repeat(np.asarray(found["chunk"]), sizes)
    ids, slots, places = _spread(list(zip(found["ids"].to_pylist(), found["places"].to_pylist(), strict=True)))
    distinct, rank = np.unique(ids, axis=0, return_inverse=True)
    doc = rank.reshape(-1)[slots]
    by = np.lexsort((places, doc, checks, hashes))
    hashes, checks, doc, places, chunk = hashes[by], checks[by], doc[by], places[by], chunk[by]
    new = _first_of_equal(hashes, checks)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    repeated = np.flatnonzero((doc != doc[lead]) | (places != places[lead]))
    repeated = repeated[np.lexsort((places[repeated], doc[repeated], chunk[repeated]))]
    doc, places, chunk = doc[repeated], places[repeated], chunk[repeated]
    bucket = found["bucket"][0].as_py()
    return pa.Table.from_batches([_answer([(bucket, int(chunk[part[0]]), None, *_compact_places(doc[part], places[part], distinct)) for _, part in _parts(chunk)])])


_STARTS = "did long, mark long, places binary"


def _gather(found: pa.Table) -> pa.Table:
    """One row a document of a chunk: the starts of its repeated windows."""
    ids, slots, places = _spread(list(zip(found["ids"].to_pylist(), found["places"].to_pylist(), strict=True)))
    distinct, rank = np.unique(ids, axis=0, return_inverse=True)
    doc = rank.reshape(-1)[slots]
    by = np.lexsort((places, doc))
    doc, data = doc[by], places[by].astype(np.int32).tobytes()
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    ends = np.r_[new[1:], len(doc)][: len(new)]
    own = distinct[doc[new]]
    return pa.table([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array([data[4 * a : 4 * b] for a, b in zip(new.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["did", "mark", "places"])


def _removed(words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of a document's words the windows at ``starts`` cover."""
    steps = np.zeros(words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + window, words), -1)
    return np.cumsum(steps)[:-1] > 0


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for mark, text, found in zip(batch.column("mark").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found").to_pylist(), strict=True):
                places = [f["places"] for f in found or [] if f["mark"] == mark]
                words, n = (text or b"").split(), 0
                total = len(words)
                if places:
                    gone = _removed(total, np.frombuffer(b"".join(places), np.int32), window)
                    n = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                rows.append((total, n, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def deduplicate(docs: DataFrame, batches: int = 3, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless asked for).

    Documents are ingested in ``batches`` ranges of ascending doc_id. A null doc_id comes before all
    others; a null text has no words; texts shorter than a window lose nothing. Rows that share a
    doc_id are ordered by a hash of their text, and wholly equal rows are one document to each other.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    own = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), F.xxhash64("text", F.col("doc_id").isNull()).alias("mark"), "text")
    size = own.agg(F.sum(F.octet_length("text")).alias("n"), F.percentile_approx("did", [i / batches for i in range(1, batches)], 10_000).alias("cuts")).first()
    words = (size.n or 0) / 6
    index = FingerprintIndex(spark, f"{path}/index", max(1, math.ceil(words / 8 / ANCHOR_BUCKET)), window, anchor)
    cuts = [None, *dict.fromkeys(size.cuts or []), None]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = own
        if lo is not None:
            part = part.where(F.col("did") > lo)
        if hi is not None:
            part = part.where(F.col("did") <= hi)
        index.ingest(part)
    buckets = max(1, math.ceil(words / 3 / BUCKET))
    # both joins take the same columns of the documents, so that their exchange is one
    asked = own.join(index.candidates(), "did").select("doc_id", "did", "mark", "text", "places")
    found = asked.transform(mapped, _window_rows(buckets, window, anchor), _ANSWER).groupBy("bucket").applyInArrow(_settle, _ANSWER)
    found = found.select("chunk", "ids", "places").groupBy("chunk").applyInArrow(_gather, _STARTS)
    starts = found.groupBy("did").agg(F.collect_list(F.struct("mark", "places")).alias("found"))
    whole = own.join(starts, "did", "left").select("doc_id", "mark", "text", "found")
    return whole.transform(mapped, _kept(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once its repeated passages are removed."""
    return deduplicate(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept_text")


#: The same rows by comparing whole windows as text.
DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS n FROM k) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r),
n AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT n.doc_id, string_agg(word, ' ' ORDER BY n.p) AS t, count(*) AS c FROM n ANTI JOIN g ON n.doc_id = g.doc_id AND n.p = g.p GROUP BY n.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
