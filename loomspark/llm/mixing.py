"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Each source has a size (its words) and a weight. The words of all sources together are shared out by
weight, but a source gets at most ``max_epochs`` times its size; what it cannot take is shared again
by weight among the others until none is above its cap. With sources in ascending order of
``cap / weight`` that fixed point is one pass of running sums: a source is clamped while the level
``(total - caps before) / (weights from here on)`` reaches its own ``cap / weight``.

The target of a source over its size is its number of epochs. Every document is repeated the whole
number of times; the fraction is filled by documents in seeded order within hash buckets of a
source, the last of them in part. Buckets hold a bounded number of documents in expectation, so a
source with a third of all rows is spread over as many tasks as it needs, and each bucket meets its
share to the word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.common import WORD, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Documents of one source and bucket, at most in expectation.
BUCKET_DOCS = 8192


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources: (source, source_size) to (source, source_size, target).

    Sources are ordered by code point, null last, and take ``weights`` in turn. The input has one row
    a source, so its windows see the catalogue of sources, never documents. Total size 0: targets 0.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(n, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.cast("double").alias("w"))
    ranked = ranked.withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    ranked = ranked.withColumn("reach", F.col("cap") / F.col("w"))
    by_reach = W.orderBy("reach", F.col("source").asc_nulls_last())
    before = by_reach.rowsBetween(W.unboundedPreceding, -1)
    after = by_reach.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ranked = ranked.withColumn("level", level)
    free = F.max(F.when(F.col("level") < F.col("reach"), F.col("level"))).over(everything)
    target = F.when(F.col("level") < F.col("reach"), F.col("w") * free).otherwise(F.col("cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: bool = False) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, extra, taken.

    With ``carry`` the whole input row comes along as the struct ``row``.

    ``copies`` whole repetitions and ``extra`` words of one more make ``taken``. Null text has size 0;
    a null source is a source of its own. Rows that repeat are documents in their own right: they
    share a seeded position and fill it one after the other. An empty table gives an empty result.
    """
    spread = max(1, math.ceil(docs.count() / BUCKET_DOCS))
    turn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), turn.alias("turn"), *row)
    base = base.withColumn("bucket", F.coalesce(F.pmod(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long"), F.lit(spread)), F.lit(0)))
    base = base.repartition("source", "bucket")
    buckets = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = water_fill(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    plan = buckets.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bucket", "b.bucket_size", "t.source_size", "t.target")
    plan = plan.select(F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), "bucket_size", "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket"))
    rows = base.join(plan, same).drop("p_source", "p_bucket")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("copies", F.floor(epochs)).withColumn("quota", F.floor((epochs - F.col("copies")) * F.col("bucket_size") + 0.5))
    earlier = W.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.coalesce(F.sum("size").over(earlier), F.lit(0)))))
    taken = (F.col("copies") * F.col("size") + F.col("extra")).alias("taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", "extra", taken, *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole repetitions, and the first words of one more.

    A repetition in part joins its words by single spaces. n_chars, where present, is recounted.
    Documents without words have nothing to give and are left out.
    """
    mixed = mix_sources(docs, weights, max_epochs, seed, carry=True)
    words = F.slice(F.filter(F.split(F.col("row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("extra").cast("int"))
    part = F.when((F.col("extra") > 0) & (F.col("extra") < F.col("size")), F.array(F.array_join(words, " "))).when(F.col("extra") > 0, F.array(F.col("row.text"))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat(F.col("row.text"), F.col("copies").cast("int")), part)
    copies = mixed.where("taken > 0").select("row", F.explode(texts).alias("mixed_text"))
    made = {"text": F.col("mixed_text"), "n_chars": F.length("mixed_text").cast("long")}
    return copies.select(*(made[c].alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with the production weights."""
    return mix_sources(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS turn,
         greatest(1, ceil((SELECT count(*) FROM documents) / 8192.0))::BIGINT AS spread
  FROM documents),
b AS (SELECT *, ('0x' || substr(turn, 1, 8))::BIGINT % spread AS bucket FROM base),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w,
             3 * source_size::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS reach FROM w),
l AS (SELECT *, ((SELECT sum(source_size)::BIGINT FROM s)
        - coalesce(sum(cap) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN level < reach THEN w * (SELECT max(level) FROM l WHERE level < reach) ELSE cap END AS target FROM l),
j AS (SELECT b.doc_id, b.source, b.bucket, b.size, b.turn, t.source_size, t.target,
             sum(b.size) OVER (PARTITION BY b.source, b.bucket) AS bucket_size,
             coalesce(sum(b.size) OVER (PARTITION BY b.source, b.bucket ORDER BY b.turn, b.doc_id, b.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS epochs FROM j),
q AS (SELECT *, floor(epochs) AS copies, floor((epochs - floor(epochs)) * bucket_size + 0.5) AS quota FROM e)
SELECT doc_id, size, source_size, target,
       (copies * size + greatest(0, least(size, quota - earlier)))::BIGINT AS taken
FROM q
"""
