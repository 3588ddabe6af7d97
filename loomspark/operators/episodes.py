"""Episodes: capture from bursts, append-only upserts, supersession, recall under budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators import segment

#: Characters of a card beside the paths it lists.
CARD = 40


def capture(touches: DataFrame, gap_ms: int = segment.GAP_MS) -> tuple[DataFrame, DataFrame]:
    """Episodes (id, session, burst, started, ended, touches, edits) and members (id, path, ...).

    An id is a digest of the session, both times, the summary and the members in order, so a burst that
    moved or touched something else is another episode.
    """
    marked = segment.bursts(touches, gap_ms)
    episodes = marked.groupBy("session", "burst").agg(F.min("ms").alias("started"), F.max("ms").alias("ended"), F.count(F.lit(1)).alias("touches"), F.count_if(F.col("kind") == "edit").alias("edits"))
    members = segment.members(marked)
    listed = members.groupBy("session", "burst").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda m: F.struct(m["path"].alias("path"), m["rank"].alias("ordinal")))).alias("members"))
    told = episodes.join(listed, ["session", "burst"], "left").withColumn("summary", F.concat(F.col("touches").cast("string"), F.lit(" touches")))
    parts = (F.col("session").cast("string"), F.col("started").cast("string"), F.col("ended").cast("string"), F.col("summary"), F.col("members"))
    parts = [F.coalesce(p, F.lit("")) for p in parts]
    named = told.withColumn("id", F.concat(F.lit("episode-"), F.left(F.sha2(F.concat_ws("\0", *parts), 256), F.lit(16))))
    named = named.select("id", "session", "burst", "started", "ended", "touches", "edits")
    return named, members.join(named.select("id", "session", "burst"), ["session", "burst"]).select("id", "path", "strength", "n")


def append_new(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch, one a key, that the store does not hold."""
    return batch.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def fill_source(store: DataFrame, batch: DataFrame) -> DataFrame:
    """(old_id, new_id, source_at) after an upsert: the first write wins, later ones only fill a null source_at."""
    old, new = store.alias("s"), batch.alias("b")
    joined = old.join(new, F.col("s.old_id") == F.col("b.old_id"), "full_outer")
    return joined.select(F.coalesce("s.old_id", "b.old_id").alias("old_id"), F.coalesce("s.new_id", "b.new_id").alias("new_id"), F.coalesce("s.source_at", F.when(F.col("s.old_id").isNull() | (F.col("s.new_id") == F.col("b.new_id")), F.col("b.source_at"))).alias("source_at"))


def terminals(edges: DataFrame) -> DataFrame:
    """(source, target) edges, one target a source, to (source, terminal) by doubling jumps.

    Sources that reach a cycle have no terminal and give no row: no path is longer than the edges are
    many, so what still moves after as many doublings as their number has bits goes in circles.
    """
    jumps = edges.select("source", "target").where("source <> target").persist()
    for i in range(max(1, jumps.count().bit_length())):
        onward = jumps.select(F.col("source").alias("target"), F.col("target").alias("further"))
        stepped = jumps.join(onward, "target", "left").select("source", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved"))
        before, jumps = jumps, stepped.checkpoint() if i % 4 == 3 else stepped.persist()
        still = jumps.where("moved and source <> target").limit(1).count()
        before.unpersist()
        jumps = jumps.select("source", "target") if still else jumps
        if not still:
            break
    sources = edges.select(F.col("source").alias("target"))
    return jumps.join(sources, "target", "left_anti").select("source", F.col("target").alias("terminal"))


def recall(episodes: DataFrame, found: DataFrame, superseded: DataFrame, asked: list[str], budget: int) -> DataFrame:
    """Episodes that touched the asked paths, newest first, those of unknown time last, then by id.

    Superseded episodes are left out. Cards of 40 characters and the length of their paths are taken
    in order while their running length fits ``budget``.
    """
    hits = found.where(F.col("path").isin(asked)).groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    hits = hits.join(superseded, "id", "left_anti").join(episodes.select("id", "session", "ended"), "id")
    scored = hits.select("id", "session", "ended", F.array_join("paths", ",").alias("matched"), (F.size("paths") / len(asked)).alias("score"))
    best = (F.desc_nulls_last("ended"), F.desc("id"))
    order = W.orderBy(*best)
    cards = scored.withColumn("chars", F.length("matched").cast("long") + CARD)
    # a card costs at least CARD, so no more than these can fit: the window sees a top-k, not all hits
    cards = cards.orderBy(*best).limit(budget // CARD + 1)
    ranked = cards.withColumn("rank", F.row_number().over(order)).withColumn("used", F.sum("chars").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.where(F.col("used") <= budget)


def recall_each(episodes: DataFrame, found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best episodes of the same session for every (query, session, path) set of asked paths."""
    wanted = asked.groupBy("query").agg(F.count_distinct("path").alias("asked"))
    hits = asked.join(found.join(episodes.select("id", "session", "ended"), "id"), ["session", "path"])
    scored = hits.groupBy("query", "id", "ended").agg(F.count_distinct("path").alias("matched")).join(wanted, "query")
    scored = scored.withColumn("score", F.col("matched") / F.col("asked"))
    order = W.partitionBy("query").orderBy(F.desc("score"), F.desc("ended"), F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "matched", "score")
