"""Receipts of tool calls, transcripts as alternating messages, identities and visible zones over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import fold, receipts, zones
from loomspark.plans.rule_queries import _pick
from loomspark.sources import providers, transcripts
from loomspark.sources.bindings import TOUCHES_SQL, messages, touches

# Events as completed calls of tools.
NAME = _pick(["Read", "Grep", "Bash", "Bash", "Bash", "Edit", "mcp__hub__claim_file", "mcp__hub__release_file", "Agent", "record_decision", "Mystery"], "event_id")
COMMAND = "CASE event_id % 11 WHEN 2 THEN 'rg needle' WHEN 3 THEN 'pytest -q' WHEN 4 THEN 'rm -rf out' ELSE '' END"
INPUT = f"'{{\"path\":\"' || path || '\",\"command\":\"' || {COMMAND} || '\",\"pattern\":\"p' || CAST(event_id % 3 AS VARCHAR(20)) || '\"}}'"
RESULT = "CASE WHEN event_id % 7 = 0 THEN 'pending' WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN 'Error: no' ELSE repeat('ok ', CAST(1 + event_id % 400 AS INT)) END"
CALLS = ["session", "CAST(floor(pos / 12) AS BIGINT) AS turn", "CAST(event_id AS VARCHAR(20)) AS tool_id", f"{NAME} AS name", f"{INPUT} AS input", f"{RESULT} AS result", "event_id % 19 = 0 AS is_error", "pos", "CASE WHEN event_id % 23 = 0 THEN NULL ELSE ms END AS ts_ms"]


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return touches(spark, d).selectExpr(*CALLS)


CALLS_SQL = f"""{TOUCHES_SQL}, calls AS (SELECT {', '.join(CALLS)}, path, event_id, event_id % 11 AS k FROM touches),
f AS (SELECT *, is_error OR regexp_matches(ltrim(result), '^(Error\\b|error:|FAILED\\b|Traceback )') AS failed FROM calls),
c AS (SELECT *, CASE WHEN k = 9 THEN 'decision' WHEN k IN (6, 7) THEN 'claim-op' WHEN k = 5 THEN 'file-edit' WHEN k = 4 THEN 'shell-mutation' WHEN failed THEN 'tool-error' WHEN k = 3 THEN 'test-run' END AS kind,
CASE WHEN trim(result) = '' OR result = 'pending' THEN 'unknown' WHEN failed THEN 'failed' ELSE 'applied' END AS outcome FROM f),
classified AS (SELECT *, CASE WHEN kind IS NOT NULL THEN 'receipt' WHEN k IN (1, 2) THEN 'search' WHEN k = 0 THEN 'read' WHEN k = 8 THEN 'orchestration' ELSE 'other' END AS lane, path AS target FROM c)"""


def call_lanes(spark: SparkSession, d: str) -> DataFrame:
    return receipts.classify(_calls(spark, d)).select("session", "pos", "lane", "kind", "outcome", "target")


def look_up_runs(spark: SparkSession, d: str) -> DataFrame:
    a = receipts.aggregates(receipts.classify(_calls(spark, d)))
    return a.select("session", "run", "lane", "n", F.array_join("paths", " ").alias("paths"), F.col("more_paths").cast("long").alias("more_paths"), "first_ms", "last_ms", "unknown_times")


RUNS_SQL = f"""WITH {CALLS_SQL}, b AS (SELECT *, lag(lane) OVER (PARTITION BY session ORDER BY pos) AS before FROM classified),
r AS (SELECT *, sum((before IS NULL OR before <> lane)::INT) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b),
p AS (SELECT session, run, lane, count(*) AS n, list(target ORDER BY pos) AS t, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) FILTER (ts_ms IS NULL) AS unknown_times FROM r WHERE lane <> 'receipt' GROUP BY ALL),
d AS (SELECT *, list_filter(t, lambda x, i: list_position(t, x) = i) AS u FROM p)
SELECT session, run, lane, n, array_to_string(u[1:6], ' ') AS paths, greatest(len(u) - 6, 0) AS more_paths, first_ms, last_ms, unknown_times FROM d"""


def standing_receipts(spark: SparkSession, d: str) -> DataFrame:
    return receipts.standing(receipts.classify(_calls(spark, d))).select("session", "pos", "kind", "superseded")


def claim_states(spark: SparkSession, d: str) -> DataFrame:
    return receipts.claims(receipts.classify(_calls(spark, d)))


CLAIMS_SQL = f"""WITH {CALLS_SQL}, o AS (SELECT session, target, arg_max(outcome, pos) AS last_outcome, arg_max(k, pos) FILTER (outcome = 'applied') AS last_op FROM classified WHERE kind = 'claim-op' GROUP BY ALL)
SELECT session, target, CASE WHEN last_outcome = 'unknown' THEN 'unknown' WHEN last_op = 6 THEN 'held' ELSE 'released' END AS state, last_outcome = 'unknown' AS reconcile FROM o"""


def validation_runs(spark: SparkSession, d: str) -> DataFrame:
    return receipts.validations(receipts.classify(_calls(spark, d))).select("session", "pos", "kind", "outcome", "freshness")


def kept_calls(spark: SparkSession, d: str) -> DataFrame:
    return fold.intra_turn(_calls(spark, d)).select("session", "pos", "kept")


# transcripts
ROWS = ["conv_id AS session", "turn AS pos", "CASE WHEN role = 'user' THEN 'user' WHEN turn % 6 = 1 THEN 'assistant_text' WHEN turn % 6 = 3 THEN 'tool_use' ELSE 'reasoning' END AS ty", "CASE WHEN turn % 10 = 4 THEN '' ELSE text END AS tx", "'Read' AS tn", "CASE WHEN turn % 4 = 1 THEN NULL ELSE '{}' END AS ti", "turn % 14 = 8 AS sg"]


def alternating_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).selectExpr(*ROWS)
    return transcripts.alternating(rows, 6_000).select("session", "pos", "role", F.sha2("content", 256).alias("content_sha256"))


ALTERNATING_SQL = f"""WITH r AS (SELECT {', '.join(ROWS)} FROM conversations),
s AS (SELECT session, pos, CASE WHEN ty = 'user' THEN 'user' ELSE 'assistant' END AS role, CASE WHEN ty = 'tool_use' THEN '⟨tool Read⟩ ' || coalesce(ti, '') ELSE tx END AS text FROM r WHERE NOT sg AND ty <> 'reasoning'),
b AS (SELECT *, lag(role) OVER (PARTITION BY session ORDER BY pos) AS before FROM s WHERE text <> ''), n AS (SELECT *, sum((before IS NULL OR before <> role)::INT) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b),
m AS (SELECT session, run, role, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS content FROM n GROUP BY ALL),
u AS (SELECT *, sum(len(content)) OVER (PARTITION BY session ORDER BY run DESC) AS used, row_number() OVER (PARTITION BY session ORDER BY run DESC) AS newest FROM m)
SELECT session, run AS pos, role, sha256(content) AS content_sha256 FROM u WHERE used <= 6000 OR newest = 1"""


def measured_tokens(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.newest_measured(messages(spark, d).selectExpr("conv_id AS session", "turn AS pos", "CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(length(text) AS BIGINT) END AS tokens"))


MEASURED_SQL = """WITH k AS (SELECT conv_id AS session, turn AS pos, len(text) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE turn % 3 <> 0)
SELECT session, pos, tokens FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tokens DESC, pos DESC) AS best FROM k WHERE n <= 6) WHERE best = 1"""


def chain_lines(spark: SparkSession, d: str) -> DataFrame:
    """Messages as linked lines: each names its predecessor."""
    lines = transcripts.linked(messages(spark, d).selectExpr("CAST(conv_id AS STRING) AS session", "turn AS pos", "role", "text AS content"), "2026-01-01T00:00:00")
    return lines.select("session", "pos", F.get_json_object("value", "$.uuid").alias("uuid"), F.get_json_object("value", "$.parentUuid").alias("parent"), F.sha2(F.get_json_object("value", "$.message.content"), 256).alias("content_sha256"))


_UUID = "substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12)"
CHAIN_SQL = f"""WITH h AS (SELECT *, sha256(conv_id::VARCHAR || '|' || turn::VARCHAR || '|' || role || '|' || text) AS h FROM conversations), u AS (SELECT *, {_UUID} AS uuid FROM h)
SELECT conv_id::VARCHAR AS session, turn AS pos, uuid, lag(uuid) OVER (PARTITION BY conv_id ORDER BY turn) AS parent, sha256(text) AS content_sha256 FROM u"""


# identities and flattened content
OWN, OTHERS = _pick(["", " m1 ", "m2", "  "], "turn"), [_pick(["m1", " ", "t1", ""], "(turn + 1)"), _pick(["m2", "t2", "", " t1"], "conv_id")]


def source_identities(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    kept = providers.identities(F.expr(OWN), F.array(*(F.expr(o) for o in OTHERS)))
    blocks = F.array(F.struct(F.expr("CASE WHEN turn % 3 = 0 THEN NULL ELSE text END").alias("text"), F.expr("CASE WHEN turn % 3 = 0 THEN concat('{\"n\":', turn, '}') END").alias("raw")), F.struct(F.expr("CASE WHEN turn % 2 = 0 THEN '' ELSE 'end' END").alias("text"), F.lit(None).cast("string").alias("raw")))
    return m.select("conv_id", "turn", F.array_join(kept, ",").alias("identities"), F.sha2(providers.flattened(blocks), 256).alias("flat_sha256"))


IDENTITY_SQL = f"""WITH i AS (SELECT *, list_filter(list_transform(list_filter([{OWN}, {', '.join(OTHERS)}], lambda x: x IS NOT NULL), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list_filter(l, lambda x, k: list_position(l, x) = k), ','), '') AS identities,
sha256(CASE WHEN turn % 3 = 0 THEN '{{"n":' || turn || '}}' ELSE text END || CASE WHEN turn % 2 = 0 THEN '' ELSE chr(10) || 'end' END) AS flat_sha256 FROM i"""

CARD = "'[Episode ' || CASE WHEN turn % 3 = 0 THEN 'recall ' ELSE 'chain ' END || CAST(turn % 9 AS VARCHAR(20)) || ']' || chr(10) || text"


def zones_in_view(spark: SparkSession, d: str) -> DataFrame:
    """Zones whose card's header is still in what the session shows."""
    m = messages(spark, d).selectExpr("conv_id AS session", "turn AS target", f"{CARD} AS card", "role")
    views = m.where("role = 'assistant' and target % 4 = 1").select("session", F.col("card").alias("text"))
    return zones.visible_zones(m.select("session", "target", "card"), views).select("session", "target")


IN_VIEW_SQL = f"""WITH m AS (SELECT conv_id AS session, turn AS target, split_part({CARD}, chr(10), 1) AS header, role FROM conversations)
SELECT session, target FROM m WHERE (session, header) IN (SELECT (session, header) FROM m WHERE role = 'assistant' AND target % 4 = 1)"""


QUERIES = {
    "call_lanes": (call_lanes, f"WITH {CALLS_SQL} SELECT session, pos, lane, kind, outcome, target FROM classified"),
    "look_up_runs": (look_up_runs, RUNS_SQL),
    "standing_receipts": (standing_receipts, f"WITH {CALLS_SQL} SELECT session, pos, kind, count(*) FILTER (outcome = 'applied') OVER (PARTITION BY session, kind, target ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > 0 AS superseded FROM classified WHERE lane = 'receipt'"),
    "claim_states": (claim_states, CLAIMS_SQL),
    "validation_runs": (validation_runs, f"WITH {CALLS_SQL}, v AS (SELECT *, count(*) FILTER (kind IN ('file-edit', 'shell-mutation') AND outcome = 'applied') OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS changed FROM classified) SELECT session, pos, kind, outcome, CASE WHEN outcome = 'unknown' THEN 'unknown' WHEN changed > 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM v WHERE kind = 'test-run'"),
    "kept_calls": (kept_calls, f"WITH {CALLS_SQL} SELECT session, pos, row_number() OVER (PARTITION BY session, turn ORDER BY pos DESC) <= 5 OR is_error OR len(result) < 500 OR (k = 1 AND len(result) <= 8000) AS kept FROM classified"),
    "alternating_messages": (alternating_messages, ALTERNATING_SQL),
    "measured_tokens": (measured_tokens, MEASURED_SQL),
    "chain_lines": (chain_lines, CHAIN_SQL),
    "source_identities": (source_identities, IDENTITY_SQL),
    "zones_in_view": (zones_in_view, IN_VIEW_SQL),
}
