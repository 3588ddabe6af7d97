"""Lines and cards over bursts, runs and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import render
from loomspark.operators import episodes as ep
from loomspark.operators import segment
from loomspark.plans.session_queries import BURST_SQL, EPISODE_SQL
from loomspark.sources.bindings import TOUCHES_SQL, day_bursts, day_episodes, messages, touches

CLOCK_SQL = "'[' || strftime(make_timestamp(first_ms * 1000), '%-I:%M %p') || ']'"


def tombstone_lines(spark: SparkSession, d: str) -> DataFrame:
    b = day_bursts(touches(spark, d)).groupBy("session", "burst").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return b.select("session", "burst", render.tombstone(iso("a"), iso("b"), F.col("n")).alias("line"), render.episode_date(iso("a")).alias("date"), render.epoch_stamp(F.col("burst"), F.lit("sealed")).alias("stamp"))


def lane_lines(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).withColumn("lane", F.when(F.col("kind") == "read", "read").when(F.col("kind") == "mention", "navigation").otherwise("other"))
    w = W.partitionBy("session").orderBy("pos")
    runs = segment.islands(t.withColumn("l", F.lag("lane").over(w)), ["session"], ["pos"], F.col("l").isNull() | (F.col("l") != F.col("lane")), "run")
    g = runs.groupBy("session", "run", "lane").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("path")).alias("paths"), F.min("ms").alias("first_ms"))
    line = render.lane_line(F.col("lane"), F.col("n"), F.slice("paths", 1, 6), F.size("paths") - 6, F.col("first_ms"), F.lit(None).cast("string"))
    return g.where("lane <> 'other'").select("session", "run", line.alias("line"))


def episode_cards(spark: SparkSession, d: str) -> DataFrame:
    episodes, found = day_episodes(touches(spark, d))
    paths = found.groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    card = render.episode_card(F.col("id"), F.when(F.col("edits") > 0, "verdict").otherwise("window_end"), F.col("ended").cast("string"), F.concat(F.col("touches").cast("string"), F.lit(" touches")), F.slice("paths", 1, 3))
    return episodes.join(paths, "id").select("id", card.alias("card"), F.length(card).cast("long").alias("chars"))


def payload_records(spark: SparkSession, d: str) -> DataFrame:
    kind, text = render.read_record(F.col("line"))
    lines = messages(spark, d).withColumn("line", render.record("fold-turn", F.col("text")))
    return lines.select("conv_id", "turn", kind.alias("kind"), (text == F.col("text")).alias("same"), F.sha2("text", 256).alias("text_sha256"))


def usage_ids(spark: SparkSession, d: str) -> DataFrame:
    ident = render.correlation_id(F.col("pos"), F.col("event_id"), F.lit(None).cast("string"), F.col("kind"), F.col("path"))
    return touches(spark, d).where("kind = 'mention'").select("event_id", ident.alias("id"))


def claim_escapes(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.col("text"), F.lit("\\ [ Origin = x] [other]"))
    m = messages(spark, d).withColumn("marked", F.when(F.col("turn") % 2 == 0, marked).otherwise(F.col("text")))
    return m.select("conv_id", "turn", render.escaped_claim(F.col("marked")).alias("escaped"), (render.unescaped_claim(render.escaped_claim(F.col("marked"))) == F.col("marked")).alias("same"))


QUERIES = {
    "tombstone_lines": (tombstone_lines, f"""WITH {BURST_SQL}, g AS (SELECT session, burst, min(ts) AS a, max(ts) AS b, count(*) AS n FROM bursts GROUP BY ALL)
      SELECT session, burst, '{render.TOMBSTONE}' || CASE WHEN a::DATE = b::DATE THEN strftime(a, '%Y-%m-%d') ELSE strftime(a, '%Y-%m-%d') || '→' || strftime(b, '%Y-%m-%d') END || ', ' || n || ' turns; recallable by touching member paths]' AS line,
      strftime(a, '%Y-%m-%d %H:%M') AS date, '{render.EPOCH_STAMP}' || burst || ' — sealed]' AS stamp FROM g"""),
    "lane_lines": (lane_lines, f"""WITH {TOUCHES_SQL}, l AS (SELECT *, CASE kind WHEN 'read' THEN 'read' WHEN 'mention' THEN 'navigation' ELSE 'other' END AS lane FROM touches), b AS (SELECT *, lag(lane) OVER (PARTITION BY session ORDER BY pos) AS p FROM l),
      r AS (SELECT *, sum((p IS NULL OR p <> lane)::INT) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b),
      g AS (SELECT session, run, lane, count(*) AS n, list_sort(list(DISTINCT path)) AS paths, min(ms) AS first_ms FROM r WHERE lane <> 'other' GROUP BY ALL)
      SELECT session, run, {CLOCK_SQL} || CASE lane WHEN 'read' THEN ' 📖 reads' ELSE ' 🧭 navigation' END || ' ×' || n || ' — paths: ' || array_to_string(paths[1:6], ', ') || CASE WHEN len(paths) > 6 THEN ' (+' || (len(paths) - 6) || ' more)' ELSE '' END || ' ↞ source=unknown' AS line FROM g"""),
    "episode_cards": (episode_cards, f"""WITH {EPISODE_SQL}, p AS (SELECT id, list_sort(list(DISTINCT path)) AS paths FROM found GROUP BY id),
      c AS (SELECT e.id, '[Recalled episode ' || e.id || ' — ' || CASE WHEN edits > 0 THEN 'verdict' ELSE 'window_end' END || ', ' || ended || ']' || chr(10) || 'Summary: ' || touches || ' touches' || chr(10) || 'Matched paths: ' || array_to_string(paths[1:3], ', ') AS card FROM episodes e JOIN p USING (id)) SELECT id, card, len(card) AS chars FROM c"""),
    "payload_records": (payload_records, "SELECT conv_id, turn, 'fold-turn' AS kind, true AS same, sha256(text) AS text_sha256 FROM conversations"),
    "usage_ids": (usage_ids, f"WITH {TOUCHES_SQL} SELECT event_id, 'fru:' || pos || ':' || event_id || ':' || url_encode(chr(0) || kind || chr(0) || path) AS id FROM touches WHERE kind = 'mention'"),
    "claim_escapes": (claim_escapes, r"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN replace(text, '\', '\\') || '\\ \u005b Origin = x] [other]' ELSE text END AS escaped, true AS same FROM conversations"),
}
