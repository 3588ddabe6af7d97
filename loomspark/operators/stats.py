"""Statistics of recovery: intervals, agreement, medians, bootstrap over clusters, scans ahead."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """Rate and its interval in percent; all 0 for n = 0."""
    p = k / n
    scale = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / scale
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / scale
    safe = lambda x: F.when(n == 0, 0.0).otherwise(100 * x)
    return safe(p), safe(centre - half), safe(centre + half)


def kappa(pairs: DataFrame) -> DataFrame:
    """(a, b) labels to one row: n, observed and expected agreement, kappa."""
    table = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    total = table.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("agree"))
    left = table.groupBy(F.col("a").alias("label")).agg(F.sum("c").alias("l"))
    right = table.groupBy(F.col("b").alias("label")).agg(F.sum("c").alias("r"))
    chance = left.join(right, "label").agg(F.sum(F.col("l") * F.col("r")).alias("cross"))
    both = total.select("n", "agree", chance.scalar().alias("cross"))
    observed, expected = F.col("agree") / F.col("n"), F.coalesce(F.col("cross"), F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select("n", observed.alias("observed"), expected.alias("expected"), F.when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected)).alias("kappa"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at place n // 2 of the sorted non-null values of each key."""
    kept = rows.where(F.col(value).isNotNull())
    ranked = kept.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return ranked.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(*keys, F.col(value).alias("median"))


def next_within(rows: DataFrame, key: str, order: str, root: Column, success: Column, stop: Column, reach: int) -> DataFrame:
    """For each root: the distance to the first success within ``reach`` rows, unless a stop comes first."""
    ahead = W.partitionBy(key).orderBy(order).rowsBetween(1, reach)
    hit = F.min(F.when(success, F.col(order))).over(ahead)
    broken = F.min(F.when(stop, F.col(order))).over(ahead)
    out = rows.withColumn("_root", root).withColumn("_hit", hit).withColumn("_stop", broken).where("_root")
    status = F.when(F.col("_hit").isNotNull() & (F.col("_stop").isNull() | (F.col("_hit") <= F.col("_stop"))), "recovered").when(F.col("_stop").isNotNull(), "broken").otherwise("open")
    return out.select(key, order, status.alias("status"), F.when(status == "recovered", F.col("_hit") - F.col(order)).alias("distance"))


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, tolerance: int) -> DataFrame:
    """Each left row with the nearest right row of its key within the tolerance, the earlier of equals.

    ``left`` has (id, key, time), ``right`` (other, key, time). Times are bucketed by the tolerance, so
    a row meets only its own and the two neighbouring buckets.
    """
    l = left.withColumn("_b", F.floor(F.col(time) / tolerance))  # noqa: E741
    r = right.withColumn("_b", F.explode(F.array(*(F.floor(F.col(time) / tolerance) + i for i in (-1, 0, 1))))).withColumnRenamed(time, "_t")
    met = l.join(r, [key, "_b"]).withColumn("distance", F.abs(F.col(time) - F.col("_t"))).where(F.col("distance") <= tolerance)
    order = W.partitionBy("id").orderBy("distance", "_t", "other")
    return met.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("id", "other", "distance")


def cluster_bootstrap(rows: DataFrame, cluster: str, success: Column, resamples: int, seed: int) -> DataFrame:
    """Rate with its 2.5 % and 97.5 % points over resampled clusters.

    A cluster's multiplicity in a resample is a Poisson draw. Clusters of equal counts draw together: m
    of them draw Poisson(m), so the work is that of distinct counts, not of clusters. Draws come from the
    seed and the counts alone: resamples need no shared order and every rerun agrees.
    """
    counts = rows.groupBy(cluster).agg(F.count_if(success).alias("k"), F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy("k", "n").agg(F.count(F.lit(1)).alias("m"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = [np.asarray(batch.column(c)) for c in ("k", "n", "m")]
            times = np.array([np.random.Generator(np.random.Philox(key=[seed, (int(k) << 32) ^ int(n)])).poisson(int(m), resamples) for k, n, m in zip(*cell, strict=True)], np.int64).reshape(-1, resamples)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array((times * cell[0][:, None]).sum(0)), pa.array((times * cell[1][:, None]).sum(0))], names=["b", "hits", "all"])

    rates = cells.mapInArrow(draw, "b long, hits long, all long").groupBy("b").agg((F.sum("hits") / F.sum("all")).alias("rate"))
    whole = counts.agg((F.sum("k") / F.sum("n")).alias("rate"))
    points = rates.agg(F.percentile("rate", F.lit(0.025)).alias("lo"), F.percentile("rate", F.lit(0.975)).alias("hi"), F.count("rate").alias("resamples"))
    return points.select(whole.scalar().alias("rate"), "lo", "hi", "resamples")
