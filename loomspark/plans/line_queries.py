"""Rendered lines, envelopes, audits of completion and receipts of preparation, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import lines as ln
from loomspark.functions import rules
from loomspark.plans.rule_queries import _pick
from loomspark.sources.bindings import TOUCHES_SQL, table, touches

ORDER = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
_K, _C = "o_orderkey", "o_custkey"
CARD = {
    "id": _K, "instance": f"'inst-' || CAST({_C} AS VARCHAR(20))", "first_event": f"{_K} % 100", "last_event": f"{_K} % 100 + {_C} % 9", "kind": _pick(["chain", "term", "rail", "mention"], _K),
    "target": _pick(["src/a.ts", "term:cache+limit", "rail-1", "lib/b.py"], _K), "chapter": f"CASE WHEN {_C} % 6 > 0 THEN {_C} % 40 END", "more": f"{_C} % 3", "gate": _pick(["", "star:gotcha", "narration:hazard"], _C),
}
WAYPOINT = {
    "id": _K, "message": f"{_K} % 500", "register": _pick(["verdict", "tap_star", "working"], _K), "category": _pick(["", "decision", "gotcha"], _C), "authority": _pick(["", "", "live"], _K), "completion": _pick(["", "sufficient"], _C),
    "stamp": _pick(["", "2026-01-02T03:04:05Z"], _K), "identity": _pick(["", "msg-7"], _C), "status": _pick(["", "unresolved", "superseded"], _C), "newer": f"CASE WHEN {_K} % 4 = 0 THEN {_K} % 500 + 3 END", "glyph": _pick(["🏁", "⭐", "🔍"], _K), "headline": "o_orderpriority",
}
DECISION = {
    "id": _K, "stamp": _pick(["", "[3:04 AM]"], _K), "reconcile": f"{_C} % 5 = 0", "state": _pick(["standing", "superseded"], _K), "outcome": _pick(["applied", "failed", "unknown"], _C), "subject": "o_orderpriority", "explicit": f"{_K} % 2 = 0",
    "range_text": _pick(["", "1..5"], _C), "holder": _pick(["", "inst \"a\""], _K), "decision": f"'d' || CAST({_K} AS VARCHAR(20))", "statement": f"repeat('because \\t', CAST({_K} % 40 AS INT))".replace("\\t", " of "), "source": _pick(["", "msg-1"], _C),
}
ENVELOPES = {
    "id": _K, "artifact": _pick(["band", " ", "seed one"], _K), "start_at": f"CAST({_K} % 50 AS BIGINT)", "end_at": f"CASE WHEN {_C} % 4 > 0 THEN CAST({_K} % 50 + {_C} % 7 - 1 AS BIGINT) END", "n": f"CASE WHEN {_C} % 3 > 0 THEN {_C} % 7 - 1 END", "unit_a": "'event'",
    "unit_b": _pick(["event", "event", "message"], _C), "trace_a": _pick(["", "t1"], _K), "trace_b": _pick(["", "t1", "t2"], _C), "tail": f"{_K} % 4 - 1", "resumes": f"CASE WHEN {_C} % 2 = 0 THEN CAST({_K} % 60 AS BIGINT) END", "supersession": _pick(["none", "explicit"], _C),
    "superseded_at": f"CASE WHEN {_K} % 3 = 0 THEN 1 END", "objective": _pick(["", "ship it", " "], _K), "confidence": _pick(["unknown", "high", ""], _C), "rail": _pick(["", "rail-1", " "], _K), "step": _pick(["", "s1"], _C),
}
COMPLETION = {"id": _K, "rail_state": _pick(["complete", "active"], _K), "validation": _pick(["", "verified", "failed"], _C), "source_id": _pick(["", "run-1", " "], _K), "stamp_ms": f"CASE WHEN {_C} % 4 > 0 THEN 1 END", "claimed": f"{_K} % 3 > 0", "signals": f"{_C} % 2"}
RECEIPT = {
    "conv_id": "conv_id", "turn": "turn", "version": "CASE WHEN turn % 11 = 0 THEN 2 ELSE 1 END", "history": "text", "folded": "substring(text, 1, 200)", "boundary": "CASE WHEN turn % 3 > 0 THEN 20 ELSE 0 END", "config": _pick(["", "a", "b"], "turn"),
    "p_history": "CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 5 = 1 THEN text || '!' ELSE text END", "p_folded": "CASE WHEN turn % 4 = 0 THEN NULL WHEN turn % 4 = 1 THEN 'x' || text ELSE substring(text, 1, 200) END", "p_boundary": "CASE WHEN turn % 7 = 0 THEN 0 ELSE 20 END", "p_config": _pick(["", "a"], "turn"),
}
BLOCK = {"conv_id": "conv_id", "turn": "turn", "turns": "turn", "before_chars": "length(text) * 37", "after_chars": "length(text) * 5", "view": "CASE WHEN turn % 4 = 0 THEN '' ELSE text END", "block": "CASE WHEN turn % 3 = 0 THEN '' ELSE '[cognitive]' END", "rows_text": "CASE WHEN turn % 5 = 0 THEN '' ELSE role || ': ' || text END"}


def _asked(source: str, needs: list[str], inputs: dict[str, str], steps: list, columns: list[str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        bound = table(spark, d, source, *needs).selectExpr(*(f"{rules.spark(e)} AS {c}" for c, e in inputs.items()))
        return rules.apply(bound, steps).select(*columns)

    return run, rules.query("SELECT " + ", ".join(f"{e} AS {c}" for c, e in inputs.items()) + f" FROM {source}", steps, columns)


TURN = ["conv_id", "turn", "role", "text"]


# radars and fits under a budget
def radar_lines(spark: SparkSession, d: str) -> DataFrame:
    """Hazards of a path by line, those of a whole file last, up to six lines and 300 characters."""
    t = touches(spark, d).where("kind in ('edit', 'error')")
    row = t.selectExpr("path", "event_id", "CASE WHEN kind = 'error' THEN NULL ELSE pos END AS start", "pos + event_id % 3 AS stop")
    span = F.when(F.col("start").isNull(), "").when(F.col("start") == F.col("stop"), F.concat(F.lit(" (L"), F.col("start"), F.lit(")"))).otherwise(F.concat(F.lit(" (L"), F.col("start"), F.lit("-"), F.col("stop"), F.lit(")")))
    line = row.withColumn("line", F.concat(F.lit("⚠️ event "), F.col("event_id"), span)).withColumn("chars", F.length("line").cast("long") + 1)
    w = W.partitionBy("path").orderBy(F.asc_nulls_last("start"), "event_id").rowsBetween(W.unboundedPreceding, 0)
    kept = line.withColumn("used", F.sum("chars").over(w)).withColumn("n", F.count(F.lit(1)).over(w)).where("used <= 300 and n <= 6")
    return kept.select("path", "n", "line")


RADAR_SQL = f"""WITH {TOUCHES_SQL}, r AS (SELECT path, event_id, CASE WHEN kind = 'error' THEN NULL ELSE pos END AS start, pos + event_id % 3 AS stop FROM touches WHERE kind IN ('edit', 'error')),
l AS (SELECT *, '⚠️ event ' || event_id || CASE WHEN start IS NULL THEN '' WHEN start = stop THEN ' (L' || start || ')' ELSE ' (L' || start || '-' || stop || ')' END AS line FROM r),
u AS (SELECT *, sum(len(line) + 1) OVER w AS used, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY path ORDER BY start NULLS LAST, event_id ROWS UNBOUNDED PRECEDING)) SELECT path, n, line FROM u WHERE used <= 300 AND n <= 6"""


def ranked_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of a session by worth, then newest known time, then place."""
    t = touches(spark, d).selectExpr("session", "event_id", "path", "pos", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE ms END AS ms", "CASE kind WHEN 'edit' THEN 600 WHEN 'mention' THEN 500 ELSE 440 END AS worth")
    order = W.partitionBy("session").orderBy(F.desc("worth"), F.desc_nulls_last("ms"), F.desc("pos"))
    return t.withColumn("rank", F.row_number().over(order)).select("session", "event_id", "rank")


def chronological_items(spark: SparkSession, d: str) -> DataFrame:
    """Receipts and runs of one session in one order: open reconciliations first, known times before unknown, then time, then key."""
    t = touches(spark, d)
    receipts = t.where("kind in ('edit', 'error')").selectExpr("session", "concat('receipt:', event_id) AS key", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE ms END AS ms", "kind = 'error' AND event_id % 2 = 0 AS open")
    looks = t.where("kind = 'read'").groupBy("session", "path").agg(F.min("ms").alias("ms")).selectExpr("session", "concat('run:', path) AS key", "ms", "false AS open")
    order = W.partitionBy("session").orderBy(F.desc("open"), F.asc_nulls_last("ms"), "key")
    return receipts.unionByName(looks).withColumn("place", F.row_number().over(order)).select("session", "place", "key")


ITEMS_SQL = f"""WITH {TOUCHES_SQL}, i AS (SELECT session, 'receipt:' || event_id AS key, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ms END AS ms, kind = 'error' AND event_id % 2 = 0 AS open FROM touches WHERE kind IN ('edit', 'error')
UNION ALL SELECT session, 'run:' || path, min(ms), FALSE FROM touches WHERE kind = 'read' GROUP BY session, path) SELECT session, row_number() OVER (PARTITION BY session ORDER BY open DESC, ms NULLS LAST, key) AS place, key FROM i"""


def episode_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What a session's day was about: its changelog, else a decision, else the three strongest paths."""
    t = touches(spark, d).withColumn("day", F.floor(F.col("ms") / 86_400_000))
    strength = F.when(F.col("kind") == "edit", 3).when(F.col("kind") == "read", 2).otherwise(1)
    members = t.groupBy("session", "day", "path").agg(F.max(strength).alias("s"), F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("a"), (-F.col("n")).alias("b"), "path")))
    names = members.groupBy("session", "day").agg(listed.alias("m"))
    told = F.concat(F.array_join(F.transform(F.slice("m", 1, 3), lambda x: F.concat(F.substring_index(x["path"], "/", -1), F.when(x["a"] == -3, "*").otherwise(""))), ", "), F.when(F.size("m") > 3, F.concat(F.lit(" (+"), (F.size("m") - 3).cast("string"), F.lit(")"))).otherwise(""))
    notes = t.groupBy("session", "day").agg(F.min(F.when(F.col("event_id") % 19 == 0, F.concat(F.lit("changed "), "event_id"))).alias("changelog"), F.min(F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("decided "), "event_id"))).alias("decision"))
    return names.join(notes, ["session", "day"]).select("session", "day", F.coalesce("changelog", "decision", told).alias("summary"))


SUMMARY_SQL = f"""WITH {TOUCHES_SQL}, t AS (SELECT *, ms // 86400000 AS day FROM touches), m AS (SELECT session, day, path, max(CASE kind WHEN 'edit' THEN 3 WHEN 'read' THEN 2 ELSE 1 END) AS s, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY session, day ORDER BY s DESC, n DESC, path) AS r FROM m),
l AS (SELECT session, day, string_agg(split_part(path, '/', -1) || CASE WHEN s = 3 THEN '*' ELSE '' END, ', ' ORDER BY r) FILTER (r <= 3) || CASE WHEN count(*) > 3 THEN ' (+' || (count(*) - 3) || ')' ELSE '' END AS told FROM k GROUP BY ALL),
o AS (SELECT session, day, min('changed ' || event_id) FILTER (event_id % 19 = 0) AS c, min('decided ' || event_id) FILTER (event_id % 13 = 0) AS d FROM t GROUP BY ALL) SELECT session, day, coalesce(c, d, told) AS summary FROM l JOIN o USING (session, day)"""


QUERIES = {
    "card_lines": _asked("orders", ORDER, CARD, ln.CARDS, ["id", "pointer", "provenance", "signature"]),
    "waypoint_lines": _asked("orders", ORDER, WAYPOINT, ln.WAYPOINTS, ["id", "provenance", "line"]),
    "decision_lines": _asked("orders", ORDER, DECISION, ln.DECISIONS, ["id", "line", "resolution", "authority"]),
    "provenance_envelopes": _asked("orders", ORDER, ENVELOPES, ln.ENVELOPE, ["id", "errors", "compact"]),
    "completion_audit": _asked("orders", ORDER, COMPLETION, ln.COMPLETION, ["id", "authoritative", "issues"]),
    "prepare_receipts": _asked("conversations", TURN, RECEIPT, ln.RECEIPT, ["conv_id", "turn", "raw_digest", "prefix_digest", "stale", "verdict"]),
    "view_blocks": _asked("conversations", TURN, BLOCK, ln.BLOCKS, ["conv_id", "turn", "header", "merged", "vault"]),
    "radar_lines": (radar_lines, RADAR_SQL),
    "ranked_coordinates": (ranked_coordinates, f"WITH {TOUCHES_SQL} SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY CASE kind WHEN 'edit' THEN 600 WHEN 'mention' THEN 500 ELSE 440 END DESC, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ms END DESC NULLS LAST, pos DESC) AS rank FROM touches"),
    "chronological_items": (chronological_items, ITEMS_SQL),
    "episode_summaries": (episode_summaries, SUMMARY_SQL),
}

CONTROLS = {
    "id": _K, "edge": _pick(["continuation", "fresh_fork", "brain_merge", "resurrection", "odd"], _K), "name": _pick(["", "ada"], _C), "status": _pick(["", "live"], _K), "trace": _pick(["", "t-1", "t-22"], _C), "events": f"CAST({_K} % 900 AS BIGINT)",
    "claims": _pick(["", "src/a.ts, src/b.ts", "x.py"], _K), "files": _pick(["", "c.md"], _C), "fact": _pick(["", "42 tests passed", "typecheck clean"], _C), "hazards": _pick(["", "provider error"], _K),
}
STEPS_INPUT = {"conv_id": "conv_id", "turn": "turn", "scope": "CASE WHEN turn % 3 = 0 THEN NULL ELSE 'src/Mod' || CAST(turn AS VARCHAR(20)) || '.ts, lib/x.py; plain' END", "instruction": "'edit SRC/mod' || CAST(turn AS VARCHAR(20)) || '.TS and docs/a/b.md. ' || text"}


def branch_traces(spark: SparkSession, d: str) -> DataFrame:
    """The steps of a session as runs, the newest that fit 450 characters."""
    w = W.partitionBy("session").orderBy("pos")
    t = touches(spark, d).withColumn("step", F.concat("kind", F.lit("("), F.substring_index("path", "/", -1), F.lit(")")))
    t = t.withColumn("run", F.sum(F.when(F.lag("step").over(w).eqNullSafe(F.col("step")), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = t.groupBy("session", "run", "step").agg(F.count(F.lit(1)).alias("n")).withColumn("token", F.concat("step", F.when(F.col("n") > 1, F.concat(F.lit(" ×"), "n")).otherwise("")))
    used = F.sum(F.length("token").cast("long") + 3).over(W.partitionBy("session").orderBy(F.desc("run")).rowsBetween(W.unboundedPreceding, 0))
    kept = runs.withColumn("used", used).where("used <= 453")
    return kept.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "token"))), lambda x: x["token"]), " → ").alias("trace"), F.min("run").alias("from_run"))


TRACE_SQL = f"""WITH {TOUCHES_SQL}, s AS (SELECT *, kind || '(' || split_part(path, '/', -1) || ')' AS step FROM touches), b AS (SELECT *, lag(step) OVER (PARTITION BY session ORDER BY pos) AS before FROM s),
r AS (SELECT *, sum((before IS NULL OR before <> step)::INT) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b), g AS (SELECT session, run, step || CASE WHEN count(*) > 1 THEN ' ×' || count(*) ELSE '' END AS token FROM r GROUP BY session, run, step),
u AS (SELECT *, sum(len(token) + 3) OVER (PARTITION BY session ORDER BY run DESC ROWS UNBOUNDED PRECEDING) AS used FROM g) SELECT session, string_agg(token, ' → ' ORDER BY run) AS trace, min(run) AS from_run FROM u WHERE used <= 453 GROUP BY session"""


def narration_of_windows(spark: SparkSession, d: str) -> DataFrame:
    """Of every ten turns: up to two lines that tell a verdict or a hazard, declared ones first, and one that gives a reason."""
    from loomspark.functions import literals as lt
    from loomspark.plans.rule_queries import _lines

    rows = rules.apply(_lines(spark, d), lt.NARRATION).where("narrates or process = 'process:decision'")
    rows = rows.withColumn("win", F.floor(F.col("turn") / 10)).withColumn("rank", F.when(~F.col("narrates"), 2).when(F.col("mode").isin("verdict", "hazard"), 0).otherwise(1))
    order = W.partitionBy("conv_id", "win", F.col("rank") == 2).orderBy("rank", "turn", "i")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.when(F.col("rank") == 2, 1).otherwise(2)).select("conv_id", "win", "turn", "i", "rank")


def _narration_sql() -> str:
    from loomspark.functions import literals as lt
    from loomspark.plans.rule_queries import LINES_SQL

    inner = rules.query(LINES_SQL, lt.NARRATION, ["conv_id", "turn", "i", "narrates", "process", "mode"])
    return f"""WITH n AS ({inner}), r AS (SELECT *, (turn // 10)::BIGINT AS win, CASE WHEN NOT narrates THEN 2 WHEN mode IN ('verdict', 'hazard') THEN 0 ELSE 1 END AS rank FROM n WHERE narrates OR process = 'process:decision'),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, win, rank = 2 ORDER BY rank, turn, i) AS k FROM r) SELECT conv_id, win, turn, i, rank FROM k WHERE k <= CASE WHEN rank = 2 THEN 1 ELSE 2 END"""


QUERIES |= {
    "receipt_controls": _asked("orders", ORDER, CONTROLS, ln.CONTROL, ["id", "block", "read_edge", "read_trace", "read_events", "read_claims", "read_fact", "valid", "same"]),
    "predicted_paths": _asked("conversations", TURN, STEPS_INPUT, ln.PREFETCH, ["conv_id", "turn", "predicted"]),
    "branch_traces": (branch_traces, TRACE_SQL),
    "window_narration": (narration_of_windows, _narration_sql()),
}
