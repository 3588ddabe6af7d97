"""Approximate nearest neighbours by cosine: anisotropic four-bit quantisation and exact reranking.

Vectors are scaled to length one and cut into pairs of coordinates, each coded by one of 16 centroids.
Centroids and codes minimise a loss that weighs the part of the residual along the vector ``eta``
times as much as the rest, because only that part moves large inner products. Codebooks are fitted on
a bounded sample; every row is coded. A search scans the packed codes with one table a byte (two
four-bit codes), keeps the best ``rerank`` of a block of rows, and reranks those on original vectors
in double precision.

Queries meet rows in cells: blocks of rows by blocks of queries, both of bounded size, so memory in a
task does not grow with the table, nothing is broadcast but the codebooks, and each query keeps a few
rows of each block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from loomspark.llm.common import mapped, materialize, shared_dir, table

SAMPLE = 12_000
CENTROIDS = 16
THRESHOLD = 0.2
RERANK = 512
ROW_BLOCK = 8192
QUERY_BLOCK = 1024


@dataclass
class Codebook:
    """``centers[m, k]``: centroid k of the m-th pair of coordinates; ``eta``: weight of the parallel part."""

    dims: int
    centers: np.ndarray
    eta: float

    def pairs(self, unit: np.ndarray) -> np.ndarray:
        """(n, dims) as (n, pairs, 2), with a zero added to an odd number of dimensions."""
        if unit.shape[1] % 2:
            unit = np.hstack([unit, np.zeros((len(unit), 1), unit.dtype)])
        return unit.reshape(len(unit), -1, 2)

    def codes(self, unit: np.ndarray, passes: int = 2) -> np.ndarray:
        """A code for each pair: nearest first, then coordinate descent on the anisotropic loss."""
        x = self.pairs(unit)
        n, m, _ = x.shape
        out = np.empty((n, m), np.uint8)
        along = np.empty((n, m))
        for j in range(m):
            d = x[:, j, None, :] - self.centers[j][None]
            out[:, j] = np.argmin((d * d).sum(-1), axis=1)
            along[:, j] = (d[np.arange(n), out[:, j]] * x[:, j]).sum(-1)
        total = along.sum(1)
        for _ in range(passes):
            for j in range(m):
                d = x[:, j, None, :] - self.centers[j][None]
                dot = (d * x[:, j, None, :]).sum(-1)
                rest = total - along[:, j]
                cost = (d * d).sum(-1) + (self.eta - 1) * (dot + rest[:, None]) ** 2
                out[:, j] = np.argmin(cost, axis=1)
                along[:, j] = dot[np.arange(n), out[:, j]]
                total = rest + along[:, j]
        return out


def fit(unit: np.ndarray, rounds: int = 8, threshold: float = THRESHOLD, seed: int = 11) -> Codebook:
    """Codebooks for unit vectors: k-means a pair at a time, then rounds of the anisotropic loss."""
    r = np.random.default_rng(seed)
    dims = unit.shape[1]
    book = Codebook(dims, np.zeros((0, CENTROIDS, 2)), max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2)))
    x = book.pairs(unit)
    n, m, _ = x.shape
    centers = np.empty((m, CENTROIDS, 2))
    for j in range(m):
        c = x[r.choice(n, CENTROIDS, replace=n < CENTROIDS), j].astype(float)
        for _ in range(10):
            near = ((x[:, j, None, :] - c[None]) ** 2).sum(-1).argmin(1)
            for k in range(CENTROIDS):
                if (near == k).any():
                    c[k] = x[near == k, j].mean(0)
        centers[j] = c
    book.centers = centers
    for _ in range(rounds):
        codes = book.codes(unit, 1)
        residual = x - centers[np.arange(m)[None], codes]
        along = (residual * x).sum(-1)
        total = along.sum(1)
        for j in range(m):
            v, rest = x[:, j], total - along[:, j]
            a = np.eye(2)[None] + (book.eta - 1) * v[:, :, None] * v[:, None, :]
            b = v + (book.eta - 1) * ((v * v).sum(-1) + rest)[:, None] * v
            for k in range(CENTROIDS):
                at = codes[:, j] == k
                if at.any():
                    centers[j, k] = np.linalg.solve(a[at].sum(0), b[at].sum(0))
            along[:, j] = ((v - centers[j][codes[:, j]]) * v).sum(-1)
            total = rest + along[:, j]
    return book


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
    return codes[:, ::2] | codes[:, 1::2] << 4


def scan(book: Codebook, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate inner products of unit queries with coded rows, one table look-up a byte."""
    q = book.pairs(queries).astype(np.float32)
    tables = np.einsum("qmd,mkd->qmk", q, book.centers.astype(np.float32))
    if tables.shape[1] % 2:
        tables = np.concatenate([tables, np.zeros((len(q), 1, CENTROIDS), np.float32)], axis=1)
    both = (tables[:, ::2, None, :] + tables[:, 1::2, :, None]).reshape(len(q), -1, 256)
    out = np.zeros((len(q), len(packed)), np.float32)
    for b in range(packed.shape[1]):
        out += both[:, b].take(packed[:, b], axis=1)
    return out


def best(book: Codebook, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, packed: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, cosine) of the k nearest of each query among rows in ascending order of id.

    Rows of equal approximate score are taken in order of id, so exact copies keep their smallest ids.
    """
    norm_q, norm_x = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    near = scan(book, q / norm_q[:, None], packed)
    out: list[tuple[int, int, float]] = []
    for i in range(len(q)):
        s = near[i]
        at = np.arange(len(ids))
        if len(ids) > rerank:
            edge = np.partition(s, len(s) - rerank)[len(s) - rerank]
            above = np.flatnonzero(s > edge)
            at = np.sort(np.r_[above, np.flatnonzero(s == edge)[: rerank - len(above)]])
        at = at[ids[at] != q_ids[i]]
        score = (x[at] * q[i]).sum(1) / (norm_x[at] * norm_q[i])
        order = np.lexsort((ids[at], -score))[:k]
        out.extend((int(q_ids[i]), int(ids[at[o]]), float(score[o])) for o in order)
    a = np.array([(o[0], o[1]) for o in out], np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1], np.array([o[2] for o in out], float)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(len(flat), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector, single precision kept as it is, without null, zero or non-finite vectors.

    A null vec_id takes no part. Vectors of another length than the commonest take none either.
    """
    kind = vectors.schema["embedding"].dataType
    kept = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType)
    good = vectors.select("vec_id", (F.col("embedding") if kept else F.col("embedding").cast("array<double>")).alias("v"))
    good = good.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    good = good.where(F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < float("inf")) & ~F.isnan(e)) & F.exists("v", lambda e: e != 0))
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (lengths.n if lengths else 0))


def search(vectors: DataFrame, is_query: F.Column, k: int = 5, rerank: int = RERANK) -> DataFrame:
    """The k nearest rows of each query other than itself: query_id, rank, vec_id, score.

    Repeated rows count as rows of their own; rows with the query's own id are never its neighbours.
    Ties go to the smaller id. Fewer candidates than k: all of them. An empty table gives none.
    """
    spark, path = vectors.sparkSession, shared_dir(vectors.sparkSession)
    good = usable(vectors)
    total = good.count()
    share = min(1.0, SAMPLE / max(1, total))
    turn = F.shiftrightunsigned(F.xxhash64(F.col("vec_id"), F.lit(1)), 11).cast("double") * F.lit(2.0**-53)
    sample = good.where(turn <= share).limit(2 * SAMPLE).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = _matrix(sample["v"])
    book = fit(fitted / np.sqrt((fitted**2).sum(1))[:, None])

    def code(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            packed = pack(book.codes(x / np.sqrt((x * x).sum(1))[:, None])) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([p.tobytes() for p in packed], pa.binary())], names=["vec_id", "v", "codes"])

    rows = materialize(good.transform(mapped, code, f"vec_id long, v {good.schema['v'].dataType.simpleString()}, codes binary"), f"{path}/codes")
    queries = rows.where(is_query).select("vec_id", "v").distinct()
    row_blocks, query_blocks = math.ceil(total / ROW_BLOCK), max(1, math.ceil(queries.count() / QUERY_BLOCK))
    left = rows.withColumn("r", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(row_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def cell(data: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not data.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        data = data.sort_by("vec_id")
        packed = np.frombuffer(b"".join(data["codes"].to_pylist()), np.uint8).reshape(data.num_rows, -1)
        found = best(book, np.asarray(asked["vec_id"]), _matrix(asked["v"]), np.asarray(data["vec_id"]), _matrix(data["v"]), packed, k, rerank)
        return pa.table([pa.array(c) for c in found], names=names)

    found = left.groupBy("r", "b").cogroup(right.groupBy("r", "b")).applyInArrow(cell, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of every row whose vec_id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)
