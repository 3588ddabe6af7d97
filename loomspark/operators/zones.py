"""What resident zones have served, which cards a view still shows, and when a stash may be spent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STASH_AGE = 2
READ_RATE = 3
PROBE = 40


def served(zones: DataFrame) -> DataFrame:
    """Per session of zones (session, target, chapter, complete): chapters, term targets and completed chains, each once and sorted."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return zones.groupBy("session").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("chapter")), lambda x: x.cast("string")), ",").alias("chapters"),
        joined(F.when(F.col("target").startswith("term:"), F.col("target"))).alias("terms"),
        joined(F.when(F.col("complete"), F.col("target"))).alias("completed"),
    )


def served_by_target(zones: DataFrame) -> DataFrame:
    """Chapters of each target of a session, each once and sorted."""
    return zones.groupBy("session", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_set("chapter")), lambda x: x.cast("string")), ",").alias("chapters"))


def headers(views: DataFrame) -> DataFrame:
    """Distinct header lines of episode cards in views (session, text)."""
    lines = views.where(F.col("text").contains("[Episode ")).select("session", F.explode(F.split("text", "\n")).alias("header"))
    return lines.where(F.col("header").rlike(r"^\[Episode (recall|chain) ")).distinct()


def visible_zones(zones: DataFrame, views: DataFrame) -> DataFrame:
    """Zones (session, target, card) whose card's first line is still in the session's view."""
    head = F.substring_index("card", "\n", 1)
    return zones.withColumn("header", head).join(headers(views), ["session", "header"], "left_semi")


def pov(text):
    """Visible text as it is compared: lower case, plain quotation marks, single blanks, a blank at either end."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[‘’]", "'"), "[“”]", '"')
    joined = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.when(joined == "", "").otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def already_visible(cards: DataFrame, visible: DataFrame) -> DataFrame:
    """Cards (session, card, probe) whose every probe of at least 40 characters is in the session's visible text."""
    clean = F.trim(F.regexp_replace(F.trim("probe"), r"(\.{3}|…)+$", ""))
    probes = cards.withColumn("p", pov(clean)).withColumn("counts", F.length(clean) >= PROBE)
    both = probes.join(visible.select("session", pov(F.col("text")).alias("seen")), "session", "left")
    held = F.coalesce(F.col("seen").contains(F.col("p")), F.lit(False))
    return both.groupBy("session", "card").agg((F.bool_and(F.when(F.col("counts"), held)) & (F.count_if("counts") > 0)).alias("shown")).select("session", "card", F.coalesce("shown", F.lit(False)).alias("shown"))


def stash_step(state: dict, row: dict) -> list[dict]:
    """Boundaries (session, pos, cards or null, gated): a stash of cards is spent at the next boundary, once.

    A stash older than two boundaries is lost. At a gated boundary one card is served, and only at every
    third such boundary since the last service; elsewhere all are.
    """
    if row.get("_end"):
        return []
    pos, served, why = int(row["pos"]), 0, "none"
    stash = state.get("stash")
    if row["gated"]:
        state["since"] = state.get("since", 0) + 1
        if state["since"] < READ_RATE:
            why = "held" if stash else "none"
            stash = None
    if stash:
        state["stash"] = None
        if pos - stash["born"] > STASH_AGE:
            why = "stale"
        else:
            served, why = (1 if row["gated"] else stash["n"]), "served"
            if row["gated"]:
                state["since"] = 0
    if row.get("cards"):
        state["stash"] = {"born": pos, "n": int(row["cards"])}
    return [{"session": row["session"], "pos": pos, "served": served, "why": why}]


STASH = "session string, pos long, served int, why string"
