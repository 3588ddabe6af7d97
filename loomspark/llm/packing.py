"""Packing by lexical retrieval: windows of one seed document and its unused BM25 neighbours.

Documents become ids; whole windows are cut off and stand alone, and what is left of each document
is packed. Left-overs are sorted by the smallest hash of their id pairs, so texts that share wording
lie side by side, and range partitioning deals them evenly however many share one value. Within a
partition a shard of ``SHARD`` left-overs at a time has its own inverted index. The next unused
left-over is the seed; its unused neighbours in order of BM25 score fill the window, the last one cut
to fit, its rest staying unused. What remains of a shard opens the next one. At the end of a
partition the open window is cut into powers of two, so that nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import mapped, materialize, mix64, shared_dir, table
from loomspark.llm.subwords import encoder

WINDOW = 2048
END = 1
SHARD = 1024
K1, B = 1.2, 0.75

_CUT = "doc_id long, start long, length long, doc_tokens long, crc long, place long, ids binary"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crc(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def place(ids: np.ndarray) -> int:
    """The smallest hash of a pair of neighbouring ids, as a signed 64-bit integer."""
    pairs = ids[:-1].astype(np.uint64) << np.uint64(16) | ids[1:] if len(ids) > 1 else ids.astype(np.uint64)
    return int(mix64(pairs + np.uint64(0x51ED270B)).min().view(np.int64))


def cut_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Whole windows of each document, and its left-over with ids (16 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            names, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, ids in zip(names, words.encode_batch(batch.column("text").cast(pa.binary()).to_pylist()), strict=True):
                ids = np.append(ids, np.uint16(END))
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    full = len(piece) == window
                    rows.append((doc_id, start, len(piece), len(ids), crc(piece) if full else -1, place(piece), piece.astype("<u2").tobytes() if keep_ids or not full else None))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "crc", "place", "ids"])
        words.forget()

    return docs.select("doc_id", "text").transform(mapped, run, _CUT)


class Shard:
    """An inverted index over the distinct ids of the left-overs of a shard."""

    def __init__(self, pieces: list[np.ndarray]) -> None:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        doc = np.repeat(np.arange(n), lengths)
        key, tf = np.unique(np.concatenate(pieces).astype(np.int64) * n + doc, return_counts=True)
        self.n, term, self.doc = n, key // n, key % n
        new = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        self.first, df = new, np.diff(np.r_[new, len(term)])
        self.df = df
        idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
        at = np.repeat(np.arange(len(new)), df)
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        self.weight = idf[at] * tf * (K1 + 1) / (tf + norm[self.doc])
        order = np.argsort(self.doc, kind="stable")
        self.terms = np.split(at[order], np.cumsum(np.bincount(self.doc, minlength=n))[:-1])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every left-over that is still listed for the distinct ids of the seed; the others have 0."""
        terms = self.terms[seed]
        counts = self.df[terms]
        ends = np.cumsum(counts)
        at = np.repeat(self.first[terms] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)

    def forget(self, unused: np.ndarray) -> None:
        """Strikes used left-overs from the lists; the weights of the others stay."""
        keep = unused[self.doc]
        upto = np.r_[0, np.cumsum(keep)]
        edges = upto[np.r_[self.first, len(self.doc)]]
        self.first, self.df = edges[:-1], np.diff(edges)
        self.doc, self.weight = self.doc[keep], self.weight[keep]


class Packer:
    """Fills windows from a stream of left-overs (doc_id, start, doc_tokens, ids)."""

    def __init__(self, first_sequence: int, window: int = WINDOW) -> None:
        self.window, self.sequence, self.rows = window, first_sequence, []
        self.open: list[tuple] = []
        self.waiting: list[tuple] = []

    def whole(self, doc_id: int | None, start: int, tokens: int, check: int) -> None:
        self.rows.append((doc_id, start, self.window, check, tokens, self.sequence, 0))
        self.sequence += 1

    def add(self, piece: tuple) -> None:
        self.waiting.append(piece)
        if len(self.waiting) >= SHARD:
            self.pack()

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, tokens, ids in pieces:
            self.rows.append((doc_id, start, len(ids), crc(ids), tokens, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def pack(self) -> None:
        """Packs one shard; an unfilled last window stays open."""
        pieces, self.waiting = self.waiting, []
        if not pieces:
            return
        shard = Shard([p[3] for p in pieces])
        unused = np.ones(len(pieces), bool)
        listed = len(pieces)
        filled, room = self.open, self.window - sum(len(p[3]) for p in self.open)
        self.open = []
        for seed in range(len(pieces)):
            if not unused[seed]:
                continue
            left = np.flatnonzero(unused)
            if len(left) < 0.7 * listed:
                shard.forget(unused)
                listed = len(left)
            ranked = left[np.argsort(-shard.scores(seed)[left], kind="stable")]
            for i in [seed, *ranked[ranked != seed].tolist()]:
                doc_id, start, tokens, ids = pieces[i]
                filled.append((doc_id, start, tokens, ids[:room]))
                if len(ids) > room:
                    pieces[i] = (doc_id, start + room, tokens, ids[room:])
                else:
                    unused[i] = False
                room -= min(room, len(ids))
                if not room:
                    self._close(filled)
                    filled, room = [], self.window
                    if not (i == seed and unused[seed]):
                        break
                    doc_id, start, tokens, ids = pieces[seed]
                    filled, room = [(doc_id, start, tokens, ids)], self.window - len(ids)
                    unused[seed] = False
        self.open = filled

    def end(self) -> None:
        """Packs what waits and cuts the open window into powers of two."""
        self.pack()
        pieces, self.open = self.open, []
        left = sum(len(p[3]) for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            taken = []
            while size:
                doc_id, start, tokens, ids = pieces.pop(0)
                taken.append((doc_id, start, tokens, ids[:size]))
                if len(ids) > size:
                    pieces.insert(0, (doc_id, start + size, tokens, ids[size:]))
                size -= min(size, len(ids))
            self._close(taken)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [()] * 7)], names=names)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends in id 1, so a null or empty text is one token. Repeated rows are packed once
    each. Every sequence is exactly ``window`` long, or a power of two at the end of a partition. The
    ids are written once, before they are dealt by range.
    """
    path = shared_dir(docs.sparkSession)
    cut = materialize(cut_documents(docs, vocabulary, window), f"{path}/cut")
    dealt = cut.repartitionByRange("place", "doc_id", "start").sortWithinPartitions("place", "doc_id", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, window)
        for batch in batches:
            for doc_id, start, tokens, check, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "crc", "ids")), strict=True):
                if ids is None:
                    packer.whole(doc_id, start, tokens, check)
                else:
                    packer.add((doc_id, start, tokens, np.frombuffer(ids, "<u2")))
            yield packer.batch()
        packer.end()
        yield packer.batch()

    return dealt.transform(mapped, run, _PACKED)


def default_vocabulary() -> str:
    """Where this machine keeps the public word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_pack(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary or default_vocabulary())
