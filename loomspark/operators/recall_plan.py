"""Which folded entries are recalled in a pass, and how: whole cards, or one-line hints, under a budget.

An entry matches by the strongest signal that it shares: a touched path (tier 0), a claimed path
(tier 1), else an error signature or a literal word for word (tier 2). What is still resident, or was
dismissed, is left out. An entry that a later one supersedes is only ever a hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CARDS, HINTS = 3, 4


def card_budget(level: Column, cards: int = CARDS) -> Column:
    """Cards of a pass by pressure."""
    return F.when(level.isin("healthy", "warning"), cards).when(level == "critical", 1).otherwise(0)


def matches(entries: DataFrame, signals: DataFrame) -> DataFrame:
    """Entries (session, id, kind, recency, paths, tokens, errors, ...) with tier and matched.

    ``signals`` has one row a session: touched, claimed, tokens and errors as arrays, and the pass.
    """
    s = signals.select("session", "touched", "claimed", F.col("tokens").alias("asked_tokens"), F.col("errors").alias("asked_errors"), "pass", "level")
    met = entries.join(s, "session")
    first = lambda a, b: F.try_element_at(F.array_sort(F.array_intersect(a, b)), F.lit(1))
    touch, claim = first("paths", "touched"), first("paths", "claimed")
    error = F.when(F.col("kind") == "spool", first("errors", "asked_errors"))
    token = F.when(F.col("kind").isin("turn", "spool"), first("tokens", "asked_tokens"))
    tier = F.when(touch.isNotNull(), 0).when(claim.isNotNull(), 1).when(error.isNotNull() | token.isNotNull(), 2)
    matched = F.coalesce(touch, claim, F.concat(F.lit("error:"), error), F.concat(F.lit("verbatim:"), token))
    return met.withColumn("tier", tier).withColumn("matched", matched).where("tier is not null")


def plan(entries: DataFrame, signals: DataFrame, resident: DataFrame, resident_paths: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(session, id, tier, matched, place, render): the pass's cards and hints in order.

    ``resident`` (session, id, card, until) and ``resident_paths`` (session, path, until) are what earlier
    passes put in; ``dismissed`` (session, id, until) what was sent away. The choice within a session is
    one fold over its matched entries: hints stop at four, but for corrections, which always show.
    """
    m = matches(entries, signals)
    r = resident.select("session", "id", F.col("card").alias("r_card"), F.col("until").alias("r_until"))
    p = resident_paths.select("session", F.col("path").alias("matched"), F.col("until").alias("p_until"))
    d = dismissed.select("session", "id", F.col("until").alias("d_until"))
    m = m.join(r, ["session", "id"], "left").join(p, ["session", "matched"], "left").join(d, ["session", "id"], "left")
    live = lambda c: F.coalesce(F.col("pass") < F.col(c), F.lit(False))
    out = F.when(F.col("correction"), live("r_until")).otherwise(live("d_until") | (live("p_until") & (F.col("tier") > 0)) | (live("r_until") & F.coalesce("r_card", F.lit(False))))
    kept = m.where(~out)
    order = W.partitionBy("session").orderBy("tier", F.desc("correction"), F.desc("recency"), "id")
    ranked = kept.withColumn("place", F.row_number().over(order))
    whole = W.partitionBy("session")
    most = card_budget(F.col("level"))
    ranked = ranked.withColumn("cards", most + F.when((most == 0) & (F.min("tier").over(whole) == 0), 1).otherwise(0))
    listed = ranked.groupBy("session", "cards").agg(F.array_sort(F.collect_list(F.struct("place", "id", "tier", "matched", "correction", "kind"))).alias("items"))
    start = F.struct(F.lit(0).alias("cards"), F.lit(0).alias("hints"), F.array().cast("array<string>").alias("how"))

    def step(s: Column, x: Column) -> Column:
        card = ~x["correction"] & (x["kind"] != "spool") & (s["cards"] < F.col("cards"))
        hint = x["correction"] | (~card & (s["hints"] < HINTS))
        return F.struct((s["cards"] + card.cast("int")).alias("cards"), (s["hints"] + hint.cast("int")).alias("hints"), F.array_append(s["how"], F.when(card, "card").when(hint, "hint").otherwise("none")).alias("how"))

    told = listed.select("session", F.explode(F.arrays_zip("items", F.aggregate("items", start, step)["how"].alias("how"))).alias("z"))
    return told.where("z.how <> 'none'").select("session", "z.items.id", "z.items.tier", "z.items.matched", "z.items.place", F.col("z.how").alias("render"))
