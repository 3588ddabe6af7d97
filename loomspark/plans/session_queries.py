"""Segmentation, sessions, bursts and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators import episodes as ep
from loomspark.operators import segment
from loomspark.sources.bindings import TABLE_GAP_MS, TOUCHES_SQL, day_bursts, day_episodes, messages, touches

ASKED = ["src/mod7.ts", "src/mod21.ts", "src/mod42.ts", "src/mod63.ts"]

BURST_SQL = f"""{TOUCHES_SQL},
marked AS (SELECT *, lag(ms) OVER w AS before_ms, lag(pos) OVER w AS before_pos FROM touches WINDOW w AS (PARTITION BY session ORDER BY pos)),
bursts AS (SELECT *, sum(CASE WHEN before_ms IS NULL OR ms - before_ms > {TABLE_GAP_MS} OR pos - before_pos > {segment.GAP_EVENTS} THEN 1 ELSE 0 END)
  OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM marked)"""
STRENGTH_SQL = "CASE kind WHEN 'edit' THEN 3 WHEN 'read' THEN 2 WHEN 'mention' THEN 1 ELSE 0 END"
MEMBER_SQL = f"""{BURST_SQL},
grouped AS (SELECT session, burst, path, max({STRENGTH_SQL}) AS strength, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM bursts GROUP BY ALL),
members AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, burst ORDER BY strength DESC, n DESC, first_pos) AS rank FROM grouped) WHERE rank <= {segment.MEMBERS})"""
EPISODE_SQL = f"""{MEMBER_SQL},
listed AS (SELECT session, burst, '[' || string_agg('{{"path":"' || path || '","ordinal":' || rank || '}}', ',' ORDER BY rank) || ']' AS j FROM members GROUP BY ALL),
told AS (SELECT session, burst, min(ms) AS started, max(ms) AS ended, count(*) AS touches, count(*) FILTER (kind = 'edit') AS edits FROM bursts GROUP BY ALL),
episodes AS (SELECT 'episode-' || left(sha256(session::VARCHAR || chr(0) || started::VARCHAR || chr(0) || ended::VARCHAR || chr(0) || touches::VARCHAR || ' touches' || chr(0) || j), 16) AS id, session, burst, started, ended, touches, edits FROM told JOIN listed USING (session, burst)),
found AS (SELECT e.id, m.path, m.strength, m.n FROM members m JOIN episodes e USING (session, burst))"""


def turn_segmentation(spark: SparkSession, d: str) -> DataFrame:
    t = segment.turns(messages(spark, d)).where("turn_no > 0")
    return t.groupBy("conv_id", "turn_no").agg(F.min("turn").alias("start"), (F.max("turn") + 1).alias("stop"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


def step_segmentation(spark: SparkSession, d: str) -> DataFrame:
    rows = segment.islands(touches(spark, d), ["session"], ["pos"], F.col("kind") == "edit", "step")
    last = W.partitionBy("session")
    kept = rows.withColumn("keep", F.col("step") > F.max("step").over(last) - 3)
    return kept.groupBy("session", "keep").agg(F.count_distinct("step").alias("steps"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def burst_gap_islands(spark: SparkSession, d: str) -> DataFrame:
    b = day_bursts(touches(spark, d))
    return b.groupBy("session", "burst").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("ms").alias("started"), F.max("ms").alias("ended"), F.count(F.lit(1)).alias("n"))


def burst_members(spark: SparkSession, d: str) -> DataFrame:
    return segment.members(day_bursts(touches(spark, d)))


def run_length_collapse(spark: SparkSession, d: str) -> DataFrame:
    r = segment.runs(touches(spark, d), "session", "pos", "kind")
    return r.where("length >= 2 and kind not in ('edit', 'error')")


def annotation_asof_burst(spark: SparkSession, d: str) -> DataFrame:
    b = day_bursts(touches(spark, d).where("kind <> 'error'")).groupBy("session", "burst").agg(F.min("pos").alias("pos"))
    notes = touches(spark, d).where("kind = 'error'").select("session", "pos", "event_id")
    both = b.select("session", "pos", "burst", F.lit(None).cast("long").alias("event_id"), F.lit(0).alias("tag")).unionByName(notes.select("session", "pos", F.lit(None).cast("long").alias("burst"), "event_id", F.lit(1).alias("tag")))
    w = W.partitionBy("session").orderBy("pos", "tag").rowsBetween(W.unboundedPreceding, 0)
    first = F.min("burst").over(W.partitionBy("session"))
    return both.withColumn("at", F.coalesce(F.last("burst", ignorenulls=True).over(w), first)).where("tag = 1").select("event_id", F.col("at").alias("burst"))


def intent_asof(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    m = messages(spark, d).withColumn("intent", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w))
    return m.where("role = 'assistant'").select("conv_id", "turn", "intent")


def open_burst(spark: SparkSession, d: str) -> DataFrame:
    b = day_bursts(touches(spark, d)).withColumn("latest", F.max("burst").over(W.partitionBy("session"))).where("burst = latest")
    return b.groupBy("session").agg(F.max("burst").alias("bursts"), F.min("pos").alias("start"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("held"))


def newest_per_lane(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("conv_id", "role").orderBy(F.desc("turn"))
    return messages(spark, d).withColumn("n", F.row_number().over(order)).where("n <= case role when 'user' then 2 when 'assistant' then 1 else 1 end").select("conv_id", "turn", "role")


def time_bounds(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("session").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    known = F.when(F.col("kind") != "error", F.col("ms"))
    return touches(spark, d).select("session", F.first(known, ignorenulls=True).over(w).alias("first_ms"), F.last(known, ignorenulls=True).over(w).alias("last_ms")).distinct()


def trailing_user_run(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).groupBy("conv_id").agg(F.max(F.when(F.col("role") != "user", F.col("turn"))).alias("last_other"), F.max("turn").alias("last"))
    return m.select("conv_id", (F.coalesce("last_other", F.lit(-1)) + 1).alias("trace_end"), (F.col("last") - F.coalesce("last_other", F.lit(-1))).alias("trailing"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = touches(spark, d).select("session", F.col("ts").cast("timestamp").alias("at"))
    w = e.groupBy("session", F.session_window("at", "12 hours")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("session", F.unix_micros("session_window.start").alias("start_us"), "n")


def value_floor_paths(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).where("kind in ('edit', 'read', 'mention')")
    w = W.partitionBy("session", "path")
    later = t.withColumn("first_pos", F.min("pos").over(w)).where("pos > first_pos")
    weight = F.when(F.col("kind") == "edit", 4).when(F.col("kind") == "mention", 3).otherwise(1)
    scored = later.groupBy("session", "path").agg(F.sum(weight).alias("weight")).where("weight >= 4")
    order = W.partitionBy("session").orderBy(F.desc("weight"), "path")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 20")


def episode_capture(spark: SparkSession, d: str) -> DataFrame:
    return day_episodes(touches(spark, d))[0]


def episode_path_recall(spark: SparkSession, d: str) -> DataFrame:
    episodes, found = day_episodes(touches(spark, d))
    gone = episodes.where("edits = 0").select("id")
    return ep.recall(episodes, found, gone, ASKED, 6000).select("id", "session", "ended", "matched", "score", "rank")


def chain_score_topk(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    episodes, found = day_episodes(t)
    order = W.partitionBy("session").orderBy(F.desc("pos"))
    asked = t.withColumn("n", F.row_number().over(order)).where("n <= 5").select(F.col("session").alias("query"), "session", "path").distinct()
    return ep.recall_each(episodes, found, asked, 3)


def episode_append(spark: SparkSession, d: str) -> DataFrame:
    episodes, _ = day_episodes(touches(spark, d))
    store = episodes.where("burst % 2 = 0")
    fresh = ep.append_new(store, episodes, "id")
    return fresh.groupBy("session").agg(F.count(F.lit(1)).alias("inserted"), F.sum("touches").alias("touches"))


def supersession_upsert(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).where("kind = 'edit'")
    w = W.partitionBy("session", "path").orderBy("pos")
    edges = t.select(F.col("event_id").alias("old_id"), F.lead("event_id").over(w).alias("new_id"), "ms").where("new_id is not null")
    store = edges.where("old_id % 2 = 0").select("old_id", "new_id", F.when(F.col("old_id") % 4 == 0, F.col("ms")).alias("source_at"))
    batch = edges.select("old_id", "new_id", (F.col("ms") + 1).alias("source_at"))
    return ep.fill_source(store, batch)


def supersession_closure(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).where("kind = 'edit'")
    w = W.partitionBy("session", "path").orderBy("pos")
    edges = t.select(F.col("event_id").alias("source"), F.lead("event_id").over(w).alias("target")).where("target is not null")
    return ep.terminals(edges)


def superseded_anti_join(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    gone = t.withColumn("newer", F.max(F.when(F.col("kind") == "edit", F.col("pos"))).over(W.partitionBy("session", "path"))).where("newer > pos").select("event_id")
    return t.join(gone, "event_id", "left_anti").groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"))


def served_dedupe(spark: SparkSession, d: str) -> DataFrame:
    episodes, found = day_episodes(touches(spark, d))
    served = ep.recall(episodes, found, episodes.where("edits = 0").select("id"), ASKED[:2], 600).select("id")
    again = ep.recall(episodes, found, episodes.where("edits = 0").select("id").union(served), ASKED, 6000)
    return again.select("id", "matched", "score", "rank")


RECALL_SQL = """hits AS (SELECT id, array_to_string(list_sort(list(DISTINCT path)), ',') AS matched, count(DISTINCT path) / {n}.0 AS score FROM found WHERE path IN ({paths}) AND id NOT IN ({gone}) GROUP BY id),
cards AS (SELECT h.id, session, ended, matched, score, len(matched) + 40 AS chars FROM hits h JOIN episodes USING (id)),
ranked AS (SELECT *, row_number() OVER w AS rank, sum(chars) OVER (ORDER BY ended DESC NULLS LAST, id DESC ROWS UNBOUNDED PRECEDING) AS used FROM cards WINDOW w AS (ORDER BY ended DESC NULLS LAST, id DESC))"""


def _recall(n: int, gone: str) -> str:
    return RECALL_SQL.format(n=n, paths=", ".join(f"'{p}'" for p in ASKED[:n]), gone=gone)


DULL = "SELECT id FROM episodes WHERE edits = 0"

QUERIES = {
    "turn_segmentation": (turn_segmentation, "SELECT conv_id, turn_no, min(turn) AS start, max(turn) + 1 AS stop, count(*) AS n, sum(len(text))::BIGINT AS chars FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM conversations) WHERE turn_no > 0 GROUP BY ALL"),
    "step_segmentation": (step_segmentation, f"""WITH {TOUCHES_SQL}, s AS (SELECT *, sum((kind = 'edit')::INT) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING) AS step FROM touches),
      k AS (SELECT *, step > max(step) OVER (PARTITION BY session) - 3 AS keep FROM s) SELECT session, keep, count(DISTINCT step) AS steps, count(*) AS n, min(pos) AS first_pos FROM k GROUP BY ALL"""),
    "burst_gap_islands": (burst_gap_islands, f"WITH {BURST_SQL} SELECT session, burst, min(pos) AS first_pos, max(pos) AS last_pos, min(ms) AS started, max(ms) AS ended, count(*) AS n FROM bursts GROUP BY ALL"),
    "burst_members": (burst_members, f"WITH {MEMBER_SQL} SELECT * FROM members"),
    "run_length_collapse": (run_length_collapse, f"""WITH {TOUCHES_SQL}, b AS (SELECT *, lag(kind) OVER (PARTITION BY session ORDER BY pos) AS k FROM touches),
      r AS (SELECT *, sum((k IS NULL OR k <> kind)::INT) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b)
      SELECT session, run, kind, count(*) AS length, min(pos) AS first_pos, max(pos) AS last_pos FROM r WHERE kind NOT IN ('edit', 'error') GROUP BY ALL HAVING count(*) >= 2"""),
    "annotation_asof_burst": (annotation_asof_burst, f"""WITH {BURST_SQL.replace('FROM touches WINDOW', "FROM touches WHERE kind <> 'error' WINDOW")},
      starts AS (SELECT session, burst, min(pos) AS pos FROM bursts GROUP BY ALL)
      SELECT t.event_id, coalesce(max(s.burst) FILTER (s.pos <= t.pos), min(s.burst)) AS burst FROM touches t LEFT JOIN starts s USING (session) WHERE t.kind = 'error' GROUP BY t.event_id"""),
    "intent_asof": (intent_asof, "SELECT conv_id, turn, intent FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS intent FROM conversations) WHERE role = 'assistant'"),
    "open_burst": (open_burst, f"WITH {BURST_SQL}, l AS (SELECT *, max(burst) OVER (PARTITION BY session) AS latest FROM bursts) SELECT session, max(burst) AS bursts, min(pos) AS start, array_to_string(list_sort(list(DISTINCT path)), ',') AS held FROM l WHERE burst = latest GROUP BY session"),
    "newest_per_lane": (newest_per_lane, "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) WHERE n <= CASE role WHEN 'user' THEN 2 ELSE 1 END"),
    "time_bounds": (time_bounds, f"WITH {TOUCHES_SQL} SELECT session, min_by(ms, pos) FILTER (kind <> 'error') AS first_ms, max_by(ms, pos) FILTER (kind <> 'error') AS last_ms FROM touches GROUP BY session"),
    "trailing_user_run": (trailing_user_run, "SELECT conv_id, coalesce(max(turn) FILTER (role <> 'user'), -1) + 1 AS trace_end, max(turn) - coalesce(max(turn) FILTER (role <> 'user'), -1) AS trailing FROM conversations GROUP BY conv_id"),
    "session_windows": (session_windows, """WITH l AS (SELECT user_id AS session, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
      s AS (SELECT *, sum((b IS NULL OR us - b >= 43200000000)::INT) OVER (PARTITION BY session ORDER BY us ROWS UNBOUNDED PRECEDING) AS w FROM l) SELECT session, min(us) AS start_us, count(*) AS n FROM s GROUP BY session, w"""),
    "value_floor_paths": (value_floor_paths, f"""WITH {TOUCHES_SQL}, f AS (SELECT *, min(pos) OVER (PARTITION BY session, path) AS first_pos FROM touches WHERE kind IN ('edit', 'read', 'mention')),
      s AS (SELECT session, path, sum(CASE kind WHEN 'edit' THEN 4 WHEN 'mention' THEN 3 ELSE 1 END)::BIGINT AS weight FROM f WHERE pos > first_pos GROUP BY ALL HAVING sum(CASE kind WHEN 'edit' THEN 4 WHEN 'mention' THEN 3 ELSE 1 END) >= 4)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY weight DESC, path) AS rank FROM s) WHERE rank <= 20"""),
    "episode_capture": (episode_capture, f"WITH {EPISODE_SQL} SELECT * FROM episodes"),
    "episode_path_recall": (episode_path_recall, f"WITH {EPISODE_SQL}, {_recall(4, DULL)} SELECT id, session, ended, matched, score, rank FROM ranked WHERE used <= 6000"),
    "chain_score_topk": (chain_score_topk, f"""WITH {EPISODE_SQL}, asked AS (SELECT DISTINCT session AS query, session, path FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS n FROM touches) WHERE n <= 5),
      wanted AS (SELECT query, count(DISTINCT path) AS asked FROM asked GROUP BY query),
      hits AS (SELECT a.query, f.id, e.ended, count(DISTINCT a.path) AS matched FROM asked a JOIN episodes e USING (session) JOIN found f ON f.id = e.id AND f.path = a.path GROUP BY ALL)
      SELECT query, rank, id, matched, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ended DESC, id DESC) AS rank FROM (SELECT h.*, matched / asked AS score FROM hits h JOIN wanted USING (query))) WHERE rank <= 3"""),
    "episode_append": (episode_append, f"WITH {EPISODE_SQL} SELECT session, count(*) AS inserted, sum(touches)::BIGINT AS touches FROM episodes WHERE id NOT IN (SELECT id FROM episodes WHERE burst % 2 = 0) GROUP BY session"),
    "supersession_upsert": (supersession_upsert, f"""WITH {TOUCHES_SQL}, edges AS (SELECT event_id AS old_id, lead(event_id) OVER (PARTITION BY session, path ORDER BY pos) AS new_id, ms FROM touches WHERE kind = 'edit')
      SELECT old_id, new_id, CASE WHEN old_id % 4 = 0 THEN ms ELSE ms + 1 END AS source_at FROM edges WHERE new_id IS NOT NULL"""),
    "supersession_closure": (supersession_closure, f"""WITH RECURSIVE {TOUCHES_SQL}, edges AS (SELECT event_id AS source, lead(event_id) OVER (PARTITION BY session, path ORDER BY pos) AS target FROM touches WHERE kind = 'edit'),
      walk AS (SELECT source, target FROM edges WHERE target IS NOT NULL UNION ALL SELECT w.source, e.target FROM walk w JOIN edges e ON e.source = w.target WHERE e.target IS NOT NULL)
      SELECT source, target AS terminal FROM walk WHERE target NOT IN (SELECT source FROM edges WHERE target IS NOT NULL)"""),
    "superseded_anti_join": (superseded_anti_join, f"WITH {TOUCHES_SQL}, n AS (SELECT *, max(CASE WHEN kind = 'edit' THEN pos END) OVER (PARTITION BY session, path) AS newer FROM touches) SELECT session, count(*) AS n, max(pos) AS last_pos FROM n WHERE newer IS NULL OR newer <= pos GROUP BY session"),
    "served_dedupe": (served_dedupe, f"""WITH {EPISODE_SQL}, {_recall(2, DULL).replace('hits', 'hits1').replace('cards', 'cards1').replace('ranked', 'ranked1')},
      {_recall(4, DULL + ' UNION ALL SELECT id FROM ranked1 WHERE used <= 600')} SELECT id, matched, score, rank FROM ranked WHERE used <= 6000"""),
}
