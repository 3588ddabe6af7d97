"""Shared helpers: reading tables, the shared scratch folder, word hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named Parquet table, narrowed to ``columns`` so that extra columns never clash."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a local folder; on a cluster it is an error, since its
    executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


_scratch: list[str] = []


def drop_scratch(spark: SparkSession) -> None:
    """Deletes every scratch folder that this driver's operators made; results not yet written need theirs."""
    while _scratch:
        drop_path(spark, _scratch.pop())


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffles of queries that are over: it does when the driver collects garbage.

    Listeners hold a query that has just ended for a moment longer.
    """
    gc.collect()
    for _ in range(2):
        time.sleep(0.4)
        spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back, which cuts lineage in a way executors share.

    What the write has shuffled is of no more use and is freed.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch to Python, unless the session has a bound that is not Spark's own.
BATCH_BYTES, _SPARKS_BYTES = "8m", "67108864b"


def _free() -> None:
    """Gives freed memory back, so that a worker that waits for its next task holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches bounded by bytes, whatever the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, _SPARKS_BYTES) == _SPARKS_BYTES:
        df.sparkSession.conf.set(key, BATCH_BYTES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _free()

    return df.mapInArrow(whole, schema)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def id_crc(doc_id: str | Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(np.ceil(np.log2(max(n, 1)))))
        steps = np.full(size, _INVERSE if inverse else _BASE, dtype=np.uint64)
        steps[0] = 1
        have = _powers[key] = np.multiply.accumulate(steps)
    return have[:n]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends (exclusive) of the words of UTF-8 ``data``."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(data) + 2, dtype=np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    change = np.flatnonzero(edge[1:] != edge[:-1])
    return change[::2], change[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, slab: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over mixed bytes, then a finaliser with the length.

    Works through about ``slab`` bytes at a time, so that scratch space stays small.
    """
    out = np.empty(len(starts), np.uint64)
    raw = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + slab)))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        total = np.empty(hi - lo + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[raw[lo:hi]] * powers(hi - lo), out=total[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = mix64((total[e] - total[s]) * powers(hi - lo, True)[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        at = stop
    return out


def gram_hashes(words: np.ndarray, n: int, salt: int = 0, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` consecutive word hashes; another base gives an independent one."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out = out * base + words[i : i + m]
    return mix64(out + np.uint64(salt))
