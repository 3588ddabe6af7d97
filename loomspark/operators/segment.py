"""Segmentation: turns, steps, runs and bursts as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A burst ends after so many events, or milliseconds, without a touch.
GAP_EVENTS, GAP_MS, MEMBERS = 25, 1_200_000, 16
#: How strong a kind of touch is.
STRENGTH = (("edit", 3), ("read", 2), ("mention", 1))


def strength(kind: Column) -> Column:
    """3 for an edit, 2 for a read, 1 for a mention, else 0."""
    out = F.when(F.lit(False), 0)
    for name, value in STRENGTH:
        out = out.when(kind == name, value)
    return out.otherwise(0)


def islands(rows: DataFrame, keys: list[str], order: list[Column | str], opens: Column, name: str) -> DataFrame:
    """Numbers the islands of each key: one more at every row where ``opens`` holds."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(opens, 1).otherwise(0)).over(w))


def turns(messages: DataFrame) -> DataFrame:
    """Messages with their turn number: one starts at every user message; the prefix has number 0."""
    return islands(messages, ["conv_id"], ["turn"], F.col("role") == "user", "turn_no")


def bursts(touches: DataFrame, gap_ms: int = GAP_MS, gap_events: int = GAP_EVENTS) -> DataFrame:
    """Touches with their burst number: a strictly longer gap in time or events opens one."""
    w = W.partitionBy("session").orderBy("pos")
    marked = touches.withColumn("_ms", F.lag("ms").over(w)).withColumn("_pos", F.lag("pos").over(w))
    opens = F.col("_ms").isNull() | (F.col("ms") - F.col("_ms") > gap_ms) | (F.col("pos") - F.col("_pos") > gap_events)
    return islands(marked, ["session"], ["pos"], opens, "burst").drop("_ms", "_pos")


def members(burst_touches: DataFrame, most: int = MEMBERS) -> DataFrame:
    """Paths of each burst: strongest kind, touches, first and last place; at most ``most``, strongest first."""
    grouped = burst_touches.groupBy("session", "burst", "path").agg(
        F.max(strength(F.col("kind"))).alias("strength"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )
    order = W.partitionBy("session", "burst").orderBy(F.desc("strength"), F.desc("n"), "first_pos")
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def runs(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Runs of equal labels: key, run, label, length, first and last place."""
    w = W.partitionBy(key).orderBy(order)
    before = rows.withColumn("_before", F.lag(label).over(w))
    numbered = islands(before, [key], [order], F.col("_before").isNull() | (F.col("_before") != F.col(label)), "run")
    return numbered.groupBy(key, "run", label).agg(F.count(F.lit(1)).alias("length"), F.min(order).alias("first_pos"), F.max(order).alias("last_pos"))
