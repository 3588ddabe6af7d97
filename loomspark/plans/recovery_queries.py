"""Recovery classes, scores and rates over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import rules
from loomspark.operators import recovery as rc
from loomspark.plans.rule_queries import _pick
from loomspark.sources.bindings import TOUCHES_SQL, messages, table, touches

# What conversations lack, by turn: openings of requests, reasons, labels, stamps and tools.
OPENING = _pick(["", "continue with ", "[Chat Room \"dev\"] ", "ok", "fix it: ", "[DIGEST DELTA] ", "   ", "did you land ", "thanks!"], "(turn + conv_id)")
DRESSED = f"CASE (turn + conv_id) % 9 WHEN 3 THEN 'ok' WHEN 6 THEN '   ' WHEN 8 THEN 'thanks!' ELSE coalesce({OPENING}, '') || text END"
REASON = _pick(["", "Manual UI reset", "turn-threshold hit", "auto compact", "resume session", "watchdog", "evolution-chamber run", "wave protocol step", "code review", "context got too long", "restore from library", "self"], "(turn + conv_id * 5)")
LABEL = _pick(["same_intent_nudge_or_reask", "operator_supersession_new_intent", "external_chat_or_system_preemption", "ambiguous", "hard_churn/no_success", "recovered_after_same_nudge", "", "typo"], "(turn * 3 + conv_id)")
STAMP = _pick(["", "1700000000000", "2026-01-02T03:04:05Z", "yesterday", " 42 "], "(turn + conv_id)")
INPUTS = {"text": DRESSED, "reason": REASON, "chat_tool": "turn % 4 = 0", "label": LABEL, "stamp": STAMP, "success": "turn % 7 = 5"}
COLUMNS = ["conv_id", "turn", "source", "actionable", "overlap", "reason_class", "trigger", "ms", "status", "break_label", "recovered", "censor"]
ALLOWED = ("same_intent_nudge_or_reask", "operator_supersession_new_intent", "external_chat_or_system_preemption", "ambiguous", "hard_churn/no_success", "recovered_after_same_nudge")

ROOT_SQL = "SELECT conv_id, arg_min(text, turn) AS root_text FROM conversations WHERE role = 'user' GROUP BY conv_id"
SOURCE_SQL = "SELECT conv_id, turn, root_text, " + ", ".join(f"{rules.duck(e)} AS {n}" for n, e in INPUTS.items()) + f" FROM conversations JOIN ({ROOT_SQL}) r USING (conv_id) WHERE role = 'user'"


def classified(spark: SparkSession, d: str) -> DataFrame:
    """Requests with the classes of a turn; the root of a chain is its first request."""
    users = messages(spark, d).where("role = 'user'")
    roots = users.groupBy("conv_id").agg(F.min_by("text", "turn").alias("root_text"))
    rows = users.join(roots, "conv_id").selectExpr("conv_id", "turn", "root_text", *(f"{rules.spark(e)} AS {n}" for n, e in INPUTS.items()))
    return rules.apply(rows, rc.CLASSES)


def _classes_sql(columns: list[str]) -> str:
    return rules.query(SOURCE_SQL, rc.CLASSES, columns)


def recovery_classes(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select(*COLUMNS)


def trigger_classes(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).groupBy("trigger", "source").agg(F.count(F.lit(1)).alias("n"))


def recoded_rates(spark: SparkSession, d: str) -> DataFrame:
    return rc.recoded(classified(spark, d), "reason_class")


def nudge_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return rc.after_nudge(classified(spark, d).select("conv_id", "turn", "break_label", "success"))


def _window(spark: SparkSession, d: str) -> DataFrame:
    g = touches(spark, d).groupBy("session").agg(
        F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "mention").alias("known_retrievals"), F.count_if(F.col("kind") == "read").alias("retrievals"),
        F.count_if(F.col("kind") == "edit").alias("handed"), F.count(F.lit(1)).alias("turns"))
    return g.selectExpr("session", "CAST(floor(errors / 2) AS BIGINT) AS unjustified", "handed", "least(known_retrievals, retrievals) AS known_retrievals", "retrievals", "session % 3 = 0 AS resumed", "session % 2 = 0 AS rail", "errors", "turns")


WINDOW_SQL = f"""SELECT session, CAST(floor(errors / 2) AS BIGINT) AS unjustified, handed, least(known_retrievals, retrievals) AS known_retrievals, retrievals, session % 3 = 0 AS resumed, session % 2 = 0 AS rail, errors, turns
FROM (WITH {TOUCHES_SQL} SELECT session, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'mention') AS known_retrievals, count(*) FILTER (kind = 'read') AS retrievals, count(*) FILTER (kind = 'edit') AS handed, count(*) AS turns FROM touches GROUP BY session)"""
SCORE_COLUMNS = ["session", "r_read", "r_ret", "t_pos", "redundancy", "err_rate", "score"]


def continuity_score(spark: SparkSession, d: str) -> DataFrame:
    return rules.apply(_window(spark, d), rc.SCORE).select(*SCORE_COLUMNS)


TOOL_OF = _pick(["Read", "mcp__atlas__atlas_query", "Grep", "chatroom", "Bash", "mcp__fs__Edit", "WebFetch", "TodoWrite"], "(event_id * 3 + pos)")


def reorientation(spark: SparkSession, d: str) -> DataFrame:
    calls = touches(spark, d).selectExpr("session AS chain", "pos", f"{TOOL_OF} AS tool")
    return rc.before_substance(calls)


REORIENTATION_SQL = f"""WITH {TOUCHES_SQL}, c AS (SELECT session AS chain, pos, regexp_replace({TOOL_OF}, '^mcp__[a-z0-9-]+__', '') AS name FROM touches),
f AS (SELECT chain, min(pos) FILTER (name IN ({', '.join(repr(x) for x in rc.SUBSTANTIVE)})) AS first FROM c GROUP BY chain)
SELECT chain, count(*) FILTER (name IN ({', '.join(repr(x) for x in rc.REORIENT)}) AND (first IS NULL OR pos < first)) AS reorient, bool_or(first IS NOT NULL) AS substantive FROM c JOIN f USING (chain) GROUP BY chain"""


def recent_reads(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).select("session", "pos", "path", "kind")
    return rc.recent_reads(t, t.where("kind = 'error'").select("session", F.col("pos").alias("at")))


RECENT_SQL = f"""WITH {TOUCHES_SQL} SELECT a.session, a.pos AS at, count(DISTINCT b.path) AS reads FROM touches a JOIN touches b ON a.session = b.session AND b.pos < a.pos AND b.pos >= a.pos - 60
WHERE a.kind = 'error' AND b.kind = 'read' GROUP BY a.session, a.pos"""


def judge_index(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).selectExpr("conv_id % 2 AS judge", "conv_id * 1000 + turn AS pos", "CASE WHEN turn % 8 = 7 THEN '' ELSE CAST(conv_id AS STRING) || '-' || CAST(turn % 6 AS STRING) END AS root", f"{LABEL} AS label")
    return rc.judged(rows, ALLOWED)


JUDGE_SQL = f"""WITH r AS (SELECT conv_id % 2 AS judge, conv_id * 1000 + turn AS pos, CASE WHEN turn % 8 = 7 THEN '' ELSE conv_id::VARCHAR || '-' || (turn % 6)::VARCHAR END AS root, {LABEL} AS label FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY judge, root ORDER BY pos) AS again FROM r)
SELECT judge, pos, root, label, CASE WHEN root = '' THEN 'missing root' WHEN again > 1 THEN 'duplicate root' WHEN label IS NULL OR label NOT IN ({', '.join(repr(x) for x in ALLOWED)}) THEN 'invalid label' END AS error FROM n"""

CLASSIFIED_SQL = _classes_sql([*COLUMNS, "success"])
QUERIES = {
    "recovery_classes": (recovery_classes, _classes_sql(COLUMNS)),
    "trigger_classes": (trigger_classes, f"SELECT trigger, source, count(*) AS n FROM ({CLASSIFIED_SQL}) GROUP BY trigger, source"),
    "recoded_rates": (recoded_rates, f"""SELECT reason_class, count(*) AS n_total, count(*) FILTER (censor IS NULL) AS n_uncensored, count(*) FILTER (censor IS NULL AND recovered) AS k, count(*) FILTER (censor IS NOT NULL) AS censored_n,
count(*) FILTER (censor IS NULL AND NOT recovered) AS hard_fail, count(*) FILTER (status = 'needs_human_adjudication') AS unsure, count(*) FILTER (actionable) AS actionable_n FROM ({CLASSIFIED_SQL}) GROUP BY reason_class"""),
    "nudge_outcomes": (nudge_outcomes, f"""WITH c AS ({CLASSIFIED_SQL}), s AS (SELECT conv_id, min(turn) AS start FROM c WHERE break_label = 'same_intent_nudge_or_reask' GROUP BY conv_id),
l AS (SELECT c.conv_id, c.turn, CASE WHEN success THEN 'recovered_after_same_nudge' ELSE 'censored_after_same_nudge_' || break_label END AS outcome, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS n FROM c JOIN s USING (conv_id)
WHERE c.turn > start AND (success OR break_label <> 'same_intent_nudge_or_reask'))
SELECT s.conv_id, start, coalesce(outcome, 'hard_churn_after_same_nudge') AS outcome, turn AS decided_at FROM s LEFT JOIN l ON s.conv_id = l.conv_id AND n = 1"""),
    "continuity_score": (continuity_score, rules.query(WINDOW_SQL, rc.SCORE, SCORE_COLUMNS)),
    "reorientation": (reorientation, REORIENTATION_SQL),
    "recent_reads": (recent_reads, RECENT_SQL),
    "judge_index": (judge_index, JUDGE_SQL),
}
