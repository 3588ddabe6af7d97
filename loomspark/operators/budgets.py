"""Selection under budgets: stop at the first overflow, or skip it and go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def until_full(rows: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows in order while their running cost fits the budget."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def skipping(rows: DataFrame, key: str, ident: str, order: list[Column], cost: str, budget: Column, separator: int = 0, most: int = 1 << 30) -> DataFrame:
    """(key, ident, rank, selected, skipped) of a greedy choice that passes over what does not fit.

    Every chosen item but the first also pays ``separator``. A key's items form one array, which the
    caller bounds; the choice is one fold over it.
    """
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    lists = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(ident).alias("ident"), F.col(cost).cast("long").alias("cost")))).alias("items"), F.first(budget).alias("budget"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        price = x["cost"] + F.when(F.size(acc["taken"]) == 0, 0).otherwise(separator)
        fits = (acc["used"] + price <= F.col("budget")) & (F.size(acc["taken"]) < most)
        return F.when(fits, F.struct((acc["used"] + price).alias("used"), F.array_append(acc["taken"], x["rank"]).alias("taken"))).otherwise(acc)

    folded = lists.withColumn("acc", F.aggregate("items", start, step))
    out = folded.select(key, "acc", F.explode("items").alias("x"))
    selected = F.array_contains("acc.taken", F.col("x.rank"))
    reason = F.when(~selected, F.when(F.size("acc.taken") >= most, "max_items").otherwise("budget"))
    return out.select(key, F.col("x.ident").alias(ident), F.col("x.rank").alias("rank"), selected.alias("selected"), reason.alias("skipped"))


def retention(rows: DataFrame, key: str, order: Column, size: str, full: int, essence: int) -> DataFrame:
    """(key, items) with a level for each row, newest first: full, else essence, else skeleton.

    Either budget passes over a row that does not fit. Rows of size 0 stay skeletons.
    """
    lists = rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(order))).groupBy(key)
    lists = lists.agg(F.array_sort(F.collect_list(F.struct("n", F.col(size).cast("long").alias("size")))).alias("items"))
    start = F.struct(F.lit(full).cast("long").alias("full"), F.lit(essence).cast("long").alias("essence"), F.array().cast("array<string>").alias("levels"))

    def step(acc: Column, x: Column) -> Column:
        some = x["size"] > 0
        level = F.when(some & (acc["full"] >= x["size"]), "full").when(some & (acc["essence"] >= x["size"]), "essence").otherwise("skeleton")
        return F.struct(
            (acc["full"] - F.when(level == "full", x["size"]).otherwise(0)).alias("full"),
            (acc["essence"] - F.when(level == "essence", x["size"]).otherwise(0)).alias("essence"),
            F.array_append(acc["levels"], level).alias("levels"),
        )

    levels = lists.select(key, F.arrays_zip("items", F.aggregate("items", start, step)["levels"].alias("levels")).alias("z"))
    return levels.select(key, F.explode("z").alias("z")).select(key, F.col("z.items.n").alias("n"), F.col("z.items.size").alias("size"), F.col("z.levels").alias("level"))
