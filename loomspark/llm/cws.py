"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

The terms of a text are its words, weighted by how often they occur. For each slot a term draws
``r`` and ``c`` from Gamma(2, 1) and ``b`` from the unit interval, all from hashes of term and slot;
with ``t = floor(ln w / r + b)`` the term of least ``ln c - r (t - b) - r`` is the sample, and the slot
keeps (term, t). Two texts agree in a slot with the probability of their generalised Jaccard
similarity, the sum of smaller weights over the sum of larger ones.

Texts are dealt once by document; counting words and sampling group by keys that hold the document,
so neither shuffles again. Order of documents comes from ids and lengths only: ranges of ids, a window
within each range, and one row a range for the seams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.common import materialize, shared_dir, table

SLOTS = 32
_KEY = ["did", "mark"]


def neighbours(keys: DataFrame) -> DataFrame:
    """Each row of (did, mark, n_chars) with the one before and after it, the last before the first.

    Rows are distinct in (did, mark). A window sees one range of ids; seams have one row a range.
    """
    dealt = keys.repartitionByRange("did", "mark").withColumn("part", F.spark_partition_id())
    own = F.struct("did", "mark", "n_chars")
    inner = W.partitionBy("part").orderBy("did", "mark")
    dealt = dealt.withColumn("before", F.lag(own).over(inner)).withColumn("after", F.lead(own).over(inner))
    seams = dealt.groupBy("part").agg(F.max(F.when(F.col("before").isNull(), own)).alias("first"), F.max(F.when(F.col("after").isNull(), own)).alias("last"))
    order, everything = W.orderBy("part"), W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seams = seams.select(
        F.col("part").alias("p"),
        F.coalesce(F.lag("last").over(order), F.last("last").over(everything)).alias("seam_before"),
        F.coalesce(F.lead("first").over(order), F.first("first").over(everything)).alias("seam_after"),
    )
    whole = dealt.join(seams, F.col("part") == F.col("p"))
    before, after = F.coalesce("before", "seam_before"), F.coalesce("after", "seam_after")
    return whole.select(*_KEY, "n_chars", before.alias("before"), after["did"].alias("next_did"), after["mark"].alias("next_mark"))


def sample(term: Column, log_weight: Column, slot: int) -> Column:
    """Rank (upper 31 bits) and identity (lower 32 bits) of a term in a slot; the least rank is the sample."""
    h = F.xxhash64(term, F.lit(slot))
    g = F.xxhash64(h)
    unit = lambda x, shift, bits: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * F.lit(2.0**-bits)
    r = -F.log(unit(h, 0, 21) * unit(h, 21, 21))
    c = -F.log(unit(g, 0, 32) * unit(g, 32, 32))
    b = unit(h, 42, 22)
    t = F.floor(log_weight / r + b)
    rank = F.log(c) - r * (t - b + 1)
    return F.shiftleft(F.floor((rank + 128.0) * float(1 << 23)), 32).bitwiseOR(F.shiftrightunsigned(term, 9).bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF)))


def signatures(texts: DataFrame, keys: list[str], columns: list[str], slots: int = SLOTS) -> DataFrame:
    """(keys, a column of text or more) to (keys, for each such column an array of identities of 32 bits).

    A text without words has -1 everywhere. Each distinct word of a row is counted once in every
    column; one of equal weight in all of them, as most words that an edit leaves alone, is sampled once.
    """
    n = len(columns)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("of"), F.col(c).alias("text")) for i, c in enumerate(columns))))
    words = texts.select(*keys, each.alias("x")).select(*keys, "x.of", F.explode_outer(F.split("x.text", r"[\x20\x09-\x0D]+")).alias("word"))
    words = words.select(*keys, "of", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    counted = words.groupBy(*keys, "term").agg(*(F.count_if(F.col("of") == i).alias(f"n_{i}") for i in range(n)))
    weighed = lambda mask, i: F.struct(F.lit(mask).alias("mask"), F.col(f"n_{i}").alias("n"))
    alike = F.greatest(*(f"n_{i}" for i in range(n))) == F.least(*(f"n_{i}" for i in range(n))) if n > 1 else F.lit(True)
    rows = F.when(alike, F.array(weighed((1 << n) - 1, 0))).otherwise(F.array(*(weighed(1 << i, i) for i in range(n))))
    weights = counted.select(*keys, "term", F.explode(rows).alias("x")).where("x.n > 0").select(*keys, "term", "x.mask", F.log(F.col("x.n").cast("double")).alias("log_weight"))
    least = weights.groupBy(*keys, "mask").agg(*(F.min(F.when(F.col("term").isNotNull(), sample(F.col("term"), F.col("log_weight"), k))).alias(f"slot_{k}") for k in range(slots)))
    # at most one row for each column and one for all: their arrays are merged by expressions of fixed size
    least = least.groupBy(*keys).agg(F.collect_list(F.struct("mask", F.array(*(f"slot_{k}" for k in range(slots))).alias("slots"))).alias("rows"))
    none = F.array_repeat(F.lit(None).cast("long"), slots)
    merged = lambda i: F.aggregate(F.filter("rows", lambda r: r["mask"].bitwiseAND(1 << i) != 0), none, lambda have, r: F.zip_with(have, r["slots"], lambda a, b: F.least(a, b)))
    identity = lambda x: F.coalesce(x.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(-1))
    return least.select(*keys, *(F.transform(merged(i), identity).alias(f"slots_{i}") for i in range(n)))


def likeness(a: str, b: str, slots: int) -> Column:
    """The share of slots in which two arrays of identities agree."""
    return sum(((F.col(a)[k] == F.col(b)[k]).cast("double") for k in range(1, slots)), (F.col(a)[0] == F.col(b)[0]).cast("double")) / float(slots)


def printed(slots: str, n: int) -> Column:
    """Identities as hexadecimal text of fixed width."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.col(slots)[k].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for k in range(n))))


def fingerprints(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row a document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last ``floor(n / 2)`` code points replaced by the first as many, or all, of
    the next document in order of doc_id, the last document's next being the first. Null text is
    empty; texts without words share one fingerprint. Rows that share a doc_id follow each other by a
    hash of their text, and a null doc_id counts as 0 in that order; wholly equal rows are one document
    there, and each gets the same result. A single document is its own next.
    """
    path = shared_dir(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    # (did, mark) names a distinct row without nulls.
    own = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("did"), F.xxhash64(text, F.col("doc_id").isNull()).alias("mark"), text.alias("text"))
    order = own.groupBy(*_KEY).agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("doc_id"))
    order = materialize(order, f"{path}/order")
    follow = materialize(neighbours(order.select(*_KEY, "n_chars")), f"{path}/next")
    one_each = W.partitionBy(*_KEY).orderBy("did")
    base = own.select(*_KEY, "text").repartition(*_KEY).withColumn("row", F.row_number().over(one_each)).where("row = 1").drop("row")
    heads = base.join(follow.select(*_KEY, "before"), _KEY)
    heads = heads.select(F.col("before.did").alias("did"), F.col("before.mark").alias("mark"), F.expr("left(text, cast(floor(before.n_chars / 2) as int))").alias("head"))
    both = base.join(heads, _KEY)
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.col("head"))
    both = both.select(*_KEY, "text", edited.alias("edited"))
    pair = signatures(both, _KEY, ["text", "edited"], slots).withColumnsRenamed({"slots_0": "slots", "slots_1": "edited_slots"})
    digests = both.select(*_KEY, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    one = materialize(pair.join(digests, _KEY), f"{path}/slots")
    after = one.select(F.col("did").alias("next_did"), F.col("mark").alias("next_mark"), F.col("slots").alias("next_slots"))
    result = one.join(order, _KEY).join(follow.drop("n_chars", "before"), _KEY).join(after, ["next_did", "next_mark"])
    result = result.select(
        "doc_id", "n_chars", "edited_sha256", printed("slots", slots).alias("fingerprint"), printed("edited_slots", slots).alias("edited_fingerprint"),
        likeness("slots", "edited_slots", slots).alias("near_edited"), likeness("slots", "next_slots", slots).alias("near_next"), "rows",
    )
    return result.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("copy", "rows")


def op10_cws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))
