"""Stateful rules replayed over the tables; sequential folds have no SQL form, but tests hold them to their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators import decode, fold, rails
from loomspark.sources.bindings import TOUCHES_SQL, messages, table, touches
from loomspark.streaming import folds, replay


def raw_messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as raw JSON messages: every other answer calls a tool first."""
    m = messages(spark, d).select(F.col("conv_id").cast("string").alias("session"), "turn", "role", "text")
    path = F.concat(F.lit("/home/a/b/src/mod"), F.pmod(F.xxhash64("session", "turn"), F.lit(50)).cast("string"), F.lit(".ts"))
    block = lambda *fields: F.to_json(F.struct(*fields))
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    name = F.when(F.col("turn") % 3 == 0, "Edit").otherwise("Read")
    use = block(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), name.alias("name"), F.struct(path.alias("file_path")).alias("input"))).alias("content"))
    result = block(F.lit("user").alias("role"), F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("tool_use_id"), F.col("text").alias("content"))).alias("content"))
    calls = (F.col("role") == "assistant") & (F.col("turn") % 2 == 1)
    rows = F.when(calls, F.array(use, result, plain)).otherwise(F.array(plain))
    return m.select("session", "turn", F.posexplode(rows).alias("i", "raw")).select("session", (F.col("turn") * 3 + F.col("i")).alias("pos"), "raw")


def _touches(spark: SparkSession, d: str) -> DataFrame:
    return touches(spark, d).select(F.col("session").cast("string").alias("session"), F.col("pos").cast("long").alias("pos"), "ms", "path", "kind", "value", "event_id")


def tool_call_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = decode.tool_calls(decode.decode(raw_messages(spark, d)))
    return c.select("session", "pos", "name", F.length("result").cast("long").alias("result_chars"))


def turn_categories(spark: SparkSession, d: str) -> DataFrame:
    return decode.categories(decode.decode(raw_messages(spark, d))).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def folded_view(spark: SparkSession, d: str) -> DataFrame:
    return fold.view(decode.decode(raw_messages(spark, d)), keep=1, full=800, brief=1200)


def burst_replay(spark: SparkSession, d: str) -> DataFrame:
    rows = _touches(spark, d).select("session", "pos", F.floor(F.col("ms") / 60).alias("ms"), "path", (F.col("kind") == "mention").alias("pivot"))
    return replay.replay(rows, "session", "pos", folds.burst_step, folds.BURST)


def zone_replay(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(_touches(spark, d).select("session", "pos", "path"), "session", "pos", folds.zone_step, folds.ZONE)


def freeze_replay(spark: SparkSession, d: str) -> DataFrame:
    rows = _touches(spark, d).select("session", "pos", F.floor(F.col("ms") / 100).alias("ms"), F.floor(F.col("value") * 400).alias("chars"), F.when(F.col("kind") == "error", "lean").alias("mode"))
    return replay.replay(rows, "session", "pos", folds.freeze_step, folds.FREEZE)


def watch_replay(spark: SparkSession, d: str) -> DataFrame:
    rows = _touches(spark, d).select("session", "pos", F.substring_index("path", "d", -1).substr(1, 1).alias("path"), F.when(F.col("kind") == "mention", "recall").otherwise(F.col("kind")).alias("kind"))
    return replay.replay(rows, "session", "pos", folds.watch_step, folds.WATCHED)


def rail_replay(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    again = W.partitionBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy("l_returnflag")
    line = line.withColumn("copy", F.row_number().over(again))
    none = F.lit(None).cast("string")
    event = lambda pos, op, step, status: F.struct(F.lit(pos).alias("at"), F.lit(op).alias("op"), step.alias("step"), status.alias("status"))
    step = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "copy")))
    ack = F.when(F.col("l_returnflag") == "R", "blocked").when(F.col("l_returnflag") == "A", "done").otherwise("skipped")
    rows = line.select("l_orderkey", F.explode(F.array(event(1, "append", step, none), event(4, "ack", step, ack))).alias("e"))
    rows = rows.unionByName(line.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.array(event(0, "create", none, none), event(2, "lock", none, none), event(3, "sprint", none, none))).alias("e")))
    order = F.concat(F.col("e.at").cast("string"), F.lit(":"), F.coalesce("e.step", F.lit("")))
    events = rows.select(F.col("l_orderkey").cast("string").alias("rail"), order.alias("pos"), "e.op", "e.step", none.alias("title"), "e.status", F.lit(None).cast("int").alias("at"), F.lit(3).alias("n"))
    return replay.replay(events.withColumn("rank", F.col("pos")), "rail", "rank", _numbered, rails.RAIL)


def _numbered(state: dict, row: dict) -> list[dict]:
    """A rail step whose place is the number of events before it."""
    inner = state.setdefault("rail", {})
    n = state["n"] = state.get("n", -1) + 1
    return rails.rail_step(inner, {**row, "pos": n})


ZONE_SQL = f"""WITH RECURSIVE {TOUCHES_SQL}, t AS (SELECT session::VARCHAR AS session, pos::BIGINT AS pos, path, lag(pos) OVER (PARTITION BY session, path ORDER BY pos) AS before FROM touches),
z AS (SELECT *, sum((before IS NULL OR pos - before > {folds.ZONE_TTL})::INT) OVER (PARTITION BY session, path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS zone FROM t)
SELECT session, path, min(pos) AS opened, max(pos) + {folds.ZONE_TTL} AS closed, count(*) AS touches FROM z GROUP BY session, path, zone"""

FREEZE_SQL = f"""WITH RECURSIVE {TOUCHES_SQL}, r AS (SELECT session::VARCHAR AS session, pos::BIGINT AS pos, floor(ms / 100)::BIGINT AS ms, floor(value * 400)::BIGINT AS chars, CASE WHEN kind = 'error' THEN 'lean' ELSE '' END AS mode, row_number() OVER (PARTITION BY session ORDER BY pos) AS n FROM touches),
f AS (SELECT session, pos, ms, mode, n, 'first-call' AS decision, 1 AS epoch, 0::BIGINT AS tail FROM r WHERE n = 1 UNION ALL
SELECT session, pos, ms, mode, n, decision, epoch + (decision <> 'reuse')::INT, CASE WHEN decision = 'reuse' THEN tail + chars ELSE 0 END FROM (SELECT r.session, r.pos, r.ms, r.mode, r.n, r.chars, f.epoch, f.tail,
CASE WHEN r.ms - f.ms > {folds.TTL_MS} THEN 'cold-gap' WHEN r.mode <> f.mode THEN 'context-changed' WHEN f.tail + r.chars > {folds.MAX_TAIL} THEN 'tail-epoch' ELSE 'reuse' END AS decision FROM f JOIN r ON r.session = f.session AND r.n = f.n + 1))
SELECT session, pos, decision, epoch, tail FROM f"""
_BURSTY = "len(list_filter(list_distinct(f.paths), lambda x: len(list_filter(f.paths, lambda y: y = x)) >= 3)) > 0"
BURST_REPLAY_SQL = f"""WITH RECURSIVE {TOUCHES_SQL}, r AS (SELECT session::VARCHAR AS session, pos::BIGINT AS pos, floor(ms / 60)::BIGINT AS ms, path, kind = 'mention' AS pivot, row_number() OVER (PARTITION BY session ORDER BY pos) AS n, count(*) OVER (PARTITION BY session) AS last FROM touches),
f AS (SELECT session, n, last, pos AS a, pos AS z, ms AS a_ms, ms AS z_ms, [path] AS paths, 1 AS burst, NULL::VARCHAR AS why, NULL::BIGINT AS old_a, NULL::BIGINT AS old_z, NULL::VARCHAR[] AS old_paths FROM r WHERE n = 1 UNION ALL
SELECT session, n, last, CASE WHEN why IS NULL THEN a ELSE pos END, pos, CASE WHEN why IS NULL THEN a_ms ELSE ms END, ms, CASE WHEN why IS NULL THEN list_append(paths, path) ELSE [path] END, burst + (why IS NOT NULL)::INT, why, a, z, paths
FROM (SELECT r.session, r.n, r.last, r.pos, r.ms, r.path, f.a, f.z, f.a_ms, f.paths, f.burst, CASE WHEN r.pivot THEN 'pivot' WHEN r.pos - f.z > {folds.GAP_EVENTS} THEN 'events' WHEN r.ms - f.z_ms > CASE WHEN {_BURSTY} THEN {int(folds.GAP_MS * folds.FLOOR)} ELSE {folds.GAP_MS} END THEN 'time'
WHEN r.pos - f.a > {folds.SPAN_EVENTS} OR r.ms - f.a_ms > {folds.SPAN_MS} THEN 'span' END AS why FROM f JOIN r ON r.session = f.session AND r.n = f.n + 1)),
s AS (SELECT session, burst - 1 AS burst, old_a AS first_pos, old_z AS last_pos, old_paths AS p, why AS closed_by FROM f WHERE why IS NOT NULL UNION ALL SELECT session, burst, a, z, paths, 'end' FROM f WHERE n = last)
SELECT session, burst, first_pos, last_pos, len(p) AS n, array_to_string(list_sort(list_distinct(p)), ',') AS paths, closed_by FROM s"""
RAW_SQL = """m AS (SELECT conv_id, turn, role, text FROM conversations),
t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS no FROM m)"""
CATEGORY_SQL = f"""WITH {RAW_SQL}, g AS (SELECT conv_id, no, sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS chars, count(*) FILTER (role = 'assistant' AND turn % 2 = 1) AS calls, count(*) FILTER (role = 'assistant' AND turn % 2 = 1 AND turn % 3 = 0) AS acts FROM t WHERE no > 0 GROUP BY ALL)
SELECT CASE WHEN acts > 0 THEN 'action' WHEN calls > 0 THEN 'research' WHEN chars < 100 THEN 'navigation' ELSE 'decision' END AS category, count(*) AS n FROM g GROUP BY category"""

WATCH_SQL = f"""WITH RECURSIVE {TOUCHES_SQL}, w AS (SELECT session::VARCHAR AS session, pos::BIGINT AS pos, substring(split_part(path, 'd', -1), 1, 1) AS card, kind FROM touches), z AS (SELECT session, max(pos) AS last FROM w GROUP BY session),
c AS (SELECT a.session, a.card, a.pos, min(b.pos) AS met, any_value(z.last) AS last FROM w a JOIN z USING (session) LEFT JOIN w b ON b.session = a.session AND b.card = a.card AND b.kind IN ('edit', 'read') AND b.pos > a.pos AND b.pos <= a.pos + {folds.WATCH + 1} WHERE a.kind = 'mention' GROUP BY a.session, a.card, a.pos),
n AS (SELECT *, coalesce(met + 1, CASE WHEN last > pos + {folds.WATCH} THEN pos + {folds.WATCH + 1} END) AS free FROM c),
f AS (SELECT session, card, min(pos) AS pos FROM n GROUP BY session, card UNION ALL SELECT f.session, f.card, (SELECT min(x.pos) FROM n x WHERE x.session = f.session AND x.card = f.card AND x.pos >= n.free) FROM f JOIN n ON n.session = f.session AND n.card = f.card AND n.pos = f.pos WHERE n.free IS NOT NULL)
SELECT n.session, n.card, n.pos AS injected, CASE WHEN met IS NOT NULL THEN CASE WHEN k.kind = 'edit' THEN 'edited' ELSE 'echoed' END WHEN free IS NOT NULL THEN 'expired' ELSE 'open' END AS outcome, coalesce(met, CASE WHEN free IS NOT NULL THEN n.pos + {folds.WATCH} END) AS "at"
FROM f JOIN n ON n.session = f.session AND n.card = f.card AND n.pos = f.pos LEFT JOIN w k ON k.session = n.session AND k.pos = met"""
RAIL_SQL = """WITH l AS (SELECT l_orderkey, l_returnflag AS flag, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_returnflag) AS step FROM lineitem),
s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS total, count(*) FILTER (flag <> 'R') OVER w AS done, min(CASE WHEN flag = 'R' THEN row_number END) OVER w AS held FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY step) AS row_number FROM l) WINDOW w AS (PARTITION BY l_orderkey ORDER BY step)),
t AS (SELECT l_orderkey, any_value(total) AS total, min(step) AS first FROM s GROUP BY l_orderkey), h AS (SELECT s.*, b.step AS holder FROM s LEFT JOIN s b ON b.l_orderkey = s.l_orderkey AND b.i = s.held),
e AS (SELECT l_orderkey, 0 AS pos, 'create' AS op, 'planned' AS state, 0 AS revision, NULL AS active, 0 AS done, 0 AS total FROM t UNION ALL SELECT l_orderkey, i, 'append', 'planned', i, NULL, 0, i FROM s
UNION ALL SELECT l_orderkey, total + 1, 'lock', 'planned', total + 1, NULL, 0, total FROM t UNION ALL SELECT l_orderkey, total + 2, 'sprint', 'active', total + 2, first, 0, total FROM t
UNION ALL SELECT l_orderkey, total + 2 + i, 'ack', CASE WHEN holder IS NOT NULL THEN 'blocked' WHEN i = total THEN 'review' ELSE 'active' END, total + 2 + i, holder, done, total FROM h)
SELECT l_orderkey::VARCHAR AS rail, pos, op, state, revision, active, done, total, CASE WHEN total > 0 THEN floor(100.0 * done / total + 0.5) ELSE 0 END::BIGINT AS percent, NULL::VARCHAR AS error FROM e"""

QUERIES = {
    "tool_call_pairs": (tool_call_pairs, "SELECT conv_id::VARCHAR AS session, turn * 3 + 1 AS pos, CASE WHEN turn % 3 = 0 THEN 'Edit' ELSE 'Read' END AS name, len(text) AS result_chars FROM conversations WHERE role = 'assistant' AND turn % 2 = 1 AND turn > (SELECT min(c.turn) FROM conversations c WHERE c.conv_id = conversations.conv_id AND c.role = 'user')"),
    "turn_categories": (turn_categories, CATEGORY_SQL),
    "folded_view": (folded_view, ""),
    "burst_replay": (burst_replay, BURST_REPLAY_SQL),
    "zone_replay": (zone_replay, ZONE_SQL),
    "freeze_replay": (freeze_replay, FREEZE_SQL),
    "watch_replay": (watch_replay, WATCH_SQL),
    "rail_replay": (rail_replay, RAIL_SQL),
}
