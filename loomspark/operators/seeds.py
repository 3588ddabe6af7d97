"""What a successor session is given: logs by register, a vault of newest rows, sections under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import text as tx
from loomspark.operators import budgets

#: Which register of an assistant row counts most for the vault.
PRIORITY = (("verdict", 4), ("hazard", 3), ("blocked", 2), ("in_progress", 1))
#: Sections shorter than this carry nothing.
LEAST_SECTION = 48


def register_log(messages: DataFrame, registers: tuple[str, ...], budget: int) -> DataFrame:
    """Assistant messages of the given registers, newest first until the budget is full, each cut to 200 characters."""
    said = messages.where("role = 'assistant'").withColumn("register", tx.register(F.col("text"))).where(F.col("register").isin(*registers))
    lines = said.withColumn("line", F.left(F.substring_index("text", "\n", 1), F.lit(200)))
    return budgets.until_full(lines, ["conv_id"], [F.desc("turn")], F.length("line").cast("long") + 1, budget).select("conv_id", "turn", "register", "line")


def register_rank(register: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, value in PRIORITY:
        out = out.when(register == name, value)
    return out.otherwise(0)


def vault(messages: DataFrame, users: int = 6, assistants: int = 4, pool: int = 24) -> DataFrame:
    """The newest user rows, and of the newest ``pool`` assistant rows the ones of highest register, then newest."""
    newest = W.partitionBy("conv_id", "role").orderBy(F.desc("turn"))
    rows = messages.where("role in ('user', 'assistant')").withColumn("n", F.row_number().over(newest))
    asked = rows.where((F.col("role") == "user") & (F.col("n") <= users)).select("conv_id", "turn", "role", "text")
    best = W.partitionBy("conv_id").orderBy(F.desc("rank"), F.desc("turn"))
    said = rows.where((F.col("role") == "assistant") & (F.col("n") <= pool)).withColumn("rank", register_rank(tx.register(F.col("text"))))
    said = said.withColumn("k", F.row_number().over(best)).where(F.col("k") <= assistants).select("conv_id", "turn", "role", "text")
    return asked.unionByName(said)


def allocate(sections: DataFrame, budget: int) -> DataFrame:
    """(key, section, priority, place, body) under a budget: by priority, passing over what does not fit, in order of place."""
    sized = sections.withColumn("chars", F.length("body").cast("long")).where(F.col("chars") >= LEAST_SECTION)
    chosen = budgets.skipping(sized, "key", "section", [F.col("priority"), F.col("place")], "chars", F.lit(budget), separator=2).where("selected")
    kept = sized.join(chosen.select("key", "section"), ["key", "section"])
    parts = F.array_sort(F.collect_list(F.struct("place", "section", "body")))
    return kept.groupBy("key").agg(F.array_join(F.transform(parts, lambda p: p["body"]), "\n\n").alias("text"), F.array_join(F.transform(parts, lambda p: p["section"]), ",").alias("sections"))


def newest_turns(messages: DataFrame, turns: int) -> DataFrame:
    """The plain baseline: everything from the n-th newest user message on."""
    users = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1))
    return messages.withColumn("_u", F.coalesce(users, F.lit(0))).where(F.col("_u") < turns).drop("_u")
