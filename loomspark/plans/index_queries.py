"""Indexes, signals, closets, appended blocks, traces, manifests and baselines over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import rules
from loomspark.functions import text as tx
from loomspark.operators import index as ix
from loomspark.plans.rule_queries import _pick
from loomspark.sources.bindings import TOUCHES_SQL, messages, touches

INPUT = """CASE event_id % 6 WHEN 0 THEN '{"path":"./' || path || '","cwd":"/repo"}' WHEN 1 THEN '{"paths":["' || path || '","a/b.ts",""]}' WHEN 2 THEN '{"file_path":"/' || path || '","x":1}' WHEN 3 THEN '{"command":"ls"}' WHEN 4 THEN '{"files":["z.py","z.py"],"path":" "}' ELSE '{"filePath":"' || path || '","workdir":"w"}' END"""
SET_SQL = """CASE event_id % 6 WHEN 0 THEN [path, 'repo'] WHEN 1 THEN [path, 'a/b.ts'] WHEN 2 THEN [path] WHEN 3 THEN [] WHEN 4 THEN ['z.py'] ELSE [path, 'w'] END"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return touches(spark, d).selectExpr("session", "pos", "event_id", f"{INPUT} AS input")


def input_touch_sets(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("event_id", F.array_join(ix.touch_set(F.col("input")), " ").alias("paths"))


def session_tool_paths(spark: SparkSession, d: str) -> DataFrame:
    return ix.tool_paths(_calls(spark, d))


def fold_entries(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    turns = m.where("role = 'user' and turn % 10 < 8").selectExpr("conv_id AS session", "turn", "text")
    results = m.where("role = 'assistant'").selectExpr("conv_id AS session", "turn - 1 AS turn", "turn AS pos", "concat('src/p', turn % 7, '.ts') AS path")
    return ix.fold_index(turns, results)


ENTRY_SQL = f"""WITH t AS (SELECT conv_id AS session, turn, {tx.terms_sql('text')} AS w FROM conversations WHERE role = 'user' AND turn % 10 < 8),
b AS (SELECT session, 'turn:' || turn AS id, 'turn' AS kind, turn * 1000 AS recency, NULL AS path, len(w) AS terms FROM t
UNION ALL SELECT c.conv_id, 'result:' || c.turn, 'result', (c.turn - 1) * 1000 + 1, 'src/p' || (c.turn % 7) || '.ts', 0 FROM conversations c JOIN t ON t.session = c.conv_id AND t.turn = c.turn - 1 WHERE role = 'assistant')
SELECT *, row_number() OVER (PARTITION BY session ORDER BY recency DESC, id) AS rank FROM b"""

ACTIVE = "CASE event_id % 5 WHEN 0 THEN 'TypeError: bad' WHEN 1 THEN 'see deadbeef0123 now' WHEN 2 THEN 'the of' ELSE 'rewrite parser module' END"


def boundary_signals(spark: SparkSession, d: str) -> DataFrame:
    text = touches(spark, d).where("event_id % 4 < 3").selectExpr("session", "pos", f"{ACTIVE} AS text")
    return ix.boundary_signals(_calls(spark, d), text)


SIGNAL_SQL = f"""WITH {TOUCHES_SQL}, c AS (SELECT session, pos, list_sort(list_distinct({SET_SQL})) AS p, CASE WHEN event_id % 4 < 3 THEN {ACTIVE} END AS text FROM touches),
s AS (SELECT session, pos, p, len({tx.terms_sql("coalesce(text, '')")}) AS terms, coalesce(contains(text, 'TypeError'), FALSE) AS error, coalesce(contains(text, 'deadbeef0123'), FALSE) AS token FROM c)
SELECT session, pos, coalesce(array_to_string(p, ' '), '') AS paths, terms, error, token, len(p) > 0 OR terms > 0 OR error OR token AS proceed FROM s"""


def active_windows(spark: SparkSession, d: str) -> DataFrame:
    return ix.active_window(messages(spark, d)).select("conv_id", F.sha2("window", 256).alias("window_sha256"), F.length("window").cast("long").alias("chars"))


WINDOW_SQL = """WITH g AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS first, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS said FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, right(concat_ws(chr(10), first, nullif(said, '')), 1600) AS w FROM g) SELECT conv_id, sha256(w) AS window_sha256, len(w) AS chars FROM w"""


def coordinate_closets(spark: SparkSession, d: str) -> DataFrame:
    return ix.closet(touches(spark, d).selectExpr("session", "path AS literal", "pos"), 300)


CLOSET_SQL = f"""WITH {TOUCHES_SQL}, l AS (SELECT session, path AS literal, max(pos) AS pos FROM touches GROUP BY ALL),
u AS (SELECT *, sum(len(literal) + 3) OVER (PARTITION BY session ORDER BY pos DESC, literal ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY session ORDER BY pos DESC, literal) AS n FROM l) SELECT session, n, literal, pos FROM u WHERE used <= 300"""


def appended_blocks(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    blocks = m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("conv_id % 3 > 0").select("conv_id", F.concat(F.lit("[vault of "), "n", F.lit("]")).alias("block"))
    return ix.appended(m, blocks).select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"), "appended")


APPEND_SQL = """WITH a AS (SELECT *, max(CASE WHEN role = 'user' AND text <> '' THEN turn END) OVER (PARTITION BY conv_id) AS at_turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT *, coalesce(turn = at_turn AND conv_id % 3 > 0, FALSE) AS put FROM a) SELECT conv_id, turn, sha256(CASE WHEN put THEN text || chr(10) || chr(10) || '[vault of ' || n || ']' ELSE text END) AS text_sha256, put AS appended FROM p"""

ROLE = "CASE kind WHEN 'mention' THEN 'user' WHEN 'read' THEN 'tool' ELSE 'assistant' END"


def trace_scores(spark: SparkSession, d: str) -> DataFrame:
    return ix.trace_occurrences(touches(spark, d).selectExpr("session", "pos", f"{ROLE} AS role"))


TRACE_SQL = f"""WITH {TOUCHES_SQL}, m AS (SELECT session, pos, {ROLE} AS role FROM touches),
i AS (SELECT m.session, m.pos, m.role, (SELECT max(x.pos) FROM m x WHERE x.session = m.session AND x.role = 'user' AND x.pos BETWEEN m.pos - 3 AND m.pos) AS intent FROM m),
e AS (SELECT i.*, (SELECT min(x.pos) FROM m x WHERE x.session = i.session AND x.role = 'tool' AND x.pos > i.intent AND x.pos BETWEEN i.pos - 3 AND i.pos + 3) AS evidence FROM i),
c AS (SELECT e.*, (SELECT min(x.pos) FROM m x WHERE x.session = e.session AND x.role = 'assistant' AND x.pos > e.evidence AND x.pos BETWEEN e.pos - 3 AND e.pos + 3) AS conclusion FROM e)
SELECT session, pos, CASE WHEN intent IS NULL THEN 0 ELSE 20 END + CASE WHEN evidence IS NULL THEN 0 ELSE 30 END + CASE WHEN conclusion IS NULL THEN 0 ELSE 90 END + CASE WHEN role = 'tool' THEN 10 ELSE 0 END AS score FROM c"""


def active_path_cards(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    zones = t.groupBy("session", "path").agg(F.count(F.lit(1)).alias("value")).withColumn("header", F.concat(F.lit("[Episode recall "), "path", F.lit("]")))
    newest = t.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy(F.desc("pos")))).where("n <= 6")
    shown = t.where("kind = 'error'").selectExpr("session", "concat('[Episode recall ', path, ']') AS header")
    return ix.active_cards(zones, newest, shown)


ACTIVE_SQL = f"""WITH {TOUCHES_SQL}, z AS (SELECT session, path, count(*) AS value, bool_or(kind = 'error') AS shown FROM touches GROUP BY ALL), n AS (SELECT DISTINCT session, path FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS n FROM touches) WHERE n <= 6),
r AS (SELECT z.session, z.path, row_number() OVER (PARTITION BY z.session ORDER BY value DESC, z.path) AS rank FROM z JOIN n USING (session, path) WHERE NOT shown) SELECT * FROM r WHERE rank <= 2"""


def input_manifest(spark: SparkSession, d: str) -> DataFrame:
    return ix.manifest(messages(spark, d), "role", "text")


def starred_moments(spark: SparkSession, d: str) -> DataFrame:
    notes = touches(spark, d).where("event_id % 7 = 0").selectExpr("session", "pos", "concat('⭐ [', kind, '] ', path) AS line")
    return ix.starred(notes, 200, 30)


STARRED_SQL = f"""WITH {TOUCHES_SQL}, n AS (SELECT session, pos, '⭐ [' || kind || '] ' || path AS line FROM touches WHERE event_id % 7 = 0), u AS (SELECT *, 30 + sum(len(line) + 1) OVER (PARTITION BY session ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS used FROM n)
SELECT session, count(*) AS kept, string_agg(line, chr(10) ORDER BY pos) AS text FROM u WHERE used <= 200 GROUP BY session"""


def residency(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    resident = t.where("kind = 'mention'").selectExpr("session", "event_id AS id", "path AS header", "pos + 8 AS until")
    end = t.groupBy("session").agg(F.max("pos").alias("pass"))
    views = t.where("kind = 'edit'").selectExpr("session", "path AS header")
    return ix.residency_sweep(resident.join(end, "session"), views, F.col("pass"))


RESIDENCY_SQL = f"""WITH {TOUCHES_SQL}, e AS (SELECT session, max(pos) AS pass FROM touches GROUP BY session)
SELECT t.session, event_id AS id, CASE WHEN (t.session, path) IN (SELECT (session, path) FROM touches WHERE kind = 'edit') THEN 'seen' WHEN pass < pos + 8 THEN 'waiting' ELSE 'gone' END AS state FROM touches t JOIN e USING (session) WHERE kind = 'mention'"""


def summary_baseline(spark: SparkSession, d: str) -> DataFrame:
    return ix.summary_baseline(messages(spark, d), 2, 40)


BASELINE_SQL = """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, coalesce(string_agg(substring(text, 1, 40), ' | ' ORDER BY turn) FILTER (n > 2), '') AS summary, coalesce(sum(len(text)) FILTER (n <= 2), 0)::BIGINT AS live_chars FROM m GROUP BY conv_id"""


def vault_seed(spark: SparkSession, d: str) -> DataFrame:
    """The last six texts of the user that are not blank, the newest one the frontier of its task."""
    n = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages(spark, d).where("role = 'user' and trim(text) <> ''").withColumn("n", n).where("n <= 6").select("conv_id", "turn", (F.col("n") == 1).alias("frontier"))


SMALL = [
    {
        "capped": "substring(body, 1, 64000)", "affinity": "anchor || chr(31) || other", "hazard": "instr(body, '⚠️ UNRESOLVED PROVIDER/RUNTIME ERROR') > 0",
        "record_id": "CASE record WHEN 'claim' THEN claim_id WHEN 'decision' THEN decision_id ELSE action_id END",
        "glyph_body": r"CASE WHEN regexp_like(body, r'^\s*(🔍|▶️|▶|🏁|⚠️|⚠|❓|❔)') THEN replace_all(body, r'^\s*(🔍|▶️|▶|🏁|⚠️|⚠|❓|❔)\s*', '') ELSE body END",
        "matches": "CASE query WHEN 'range' THEN place >= lo AND place < hi WHEN 'path' THEN other = anchor WHEN 'term' THEN instr(lower(body), lower(trim(needle))) > 0 ELSE FALSE END",
        "ranking": r"substring(replace_all(replace_all(body, r'\s+', ' '), r'^ | $', ''), 1, 12000)",
        "rationale": r"regexp_like(lower(body), r'\b(chose|selected|preferred|prefer|went with|opted|opt|decided|trade[- ]?off|instead of|rather than|rejected|the (reason|rationale)|the (key|main|real) (reason|factor))\b') AND length(body) BETWEEN 25 AND 300 AND NOT regexp_like(body, r'[?]$')",
        "path": "'/home/u/.sessions/' || replace_all(anchor, r'[^A-Za-z0-9]', '-') || '/' || other || '.jsonl'",
    },
    {"anchor_back": "substring(affinity, 1, instr(affinity, chr(31)) - 1)", "other_back": "substring(affinity, instr(affinity, chr(31)) + 1, 100000)"},
]
SMALL_INPUT = {
    "body": "CASE turn % 6 WHEN 0 THEN '🏁 fixed: ' || text WHEN 1 THEN text || ' ⚠️ UNRESOLVED PROVIDER/RUNTIME ERROR' WHEN 2 THEN 'We chose it rather than ' || substring(text, 1, 60) WHEN 3 THEN '  ▶️ go' ELSE text END", "anchor": "'src/a' || CAST(turn % 3 AS VARCHAR(20))", "other": "'src/a' || CAST(conv_id % 3 AS VARCHAR(20))",
    "record": _pick(["claim", "decision", "action"], "turn"), "claim_id": "'c' || CAST(turn AS VARCHAR(20))", "decision_id": "'d' || CAST(turn AS VARCHAR(20))", "action_id": "'a' || CAST(turn AS VARCHAR(20))", "query": _pick(["range", "path", "term", "episode"], "(turn + conv_id)"), "place": "turn", "lo": "conv_id % 5", "hi": "conv_id % 5 + 4",
    "needle": _pick([" Fixed ", "the", "zzz"], "turn"),
}
SMALL_COLUMNS = ["conv_id", "turn", "affinity", "hazard", "record_id", "matches", "rationale", "path", "anchor_back", "other_back", "digest_capped", "digest_body", "digest_ranking"]
SMALL_STEPS = [*SMALL, {"digest_capped": "digest(capped)", "digest_body": "digest(glyph_body)", "digest_ranking": "digest(ranking)"}]


def small_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).selectExpr("conv_id", "turn", *(f"{rules.spark(e)} AS {n}" for n, e in SMALL_INPUT.items()))
    return rules.apply(rows, SMALL_STEPS).select(*SMALL_COLUMNS)


def persistence_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Edits by what came before them, and whether their path is one of the three before."""
    w = W.partitionBy("session").orderBy("pos")
    near = F.collect_set("path").over(w.rowsBetween(-3, -1))
    t = touches(spark, d).withColumn("cohort", F.when(F.lag("kind").over(w) == "error", "interrupted").otherwise("clean")).withColumn("first", F.lag("kind").over(w).isNull()).withColumn("kept", F.array_contains(near, F.col("path")))
    return t.where("kind = 'edit' and not first").groupBy("session", "cohort").agg(F.count_if("kept").alias("k"), F.count(F.lit(1)).alias("n"))


COHORT_SQL = f"""WITH {TOUCHES_SQL}, l AS (SELECT *, lag(kind) OVER w AS before, list(path) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS near FROM touches WINDOW w AS (PARTITION BY session ORDER BY pos))
SELECT session, CASE WHEN before = 'error' THEN 'interrupted' ELSE 'clean' END AS cohort, count(*) FILTER (list_contains(near, path)) AS k, count(*) AS n FROM l WHERE kind = 'edit' AND before IS NOT NULL GROUP BY ALL"""

RAW = "CASE event_id % 5 WHEN 0 THEN '{broken' WHEN 1 THEN '{\"t\":' || CAST(ms AS VARCHAR(20)) || ',\"files\":[\"a.ts\",\"' || path || '\"],\"rail\":\"r1\"}' WHEN 2 THEN '{\"files\":[]}' ELSE '{\"t\":' || CAST(ms AS VARCHAR(20)) || '}' END"


def artifact_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of a session in order of time, bad lines and those without a time left out, with what they hand over."""
    t = touches(spark, d).selectExpr("session", "event_id", f"{RAW} AS raw")
    v = F.try_parse_json("raw")
    rows = t.select("session", "event_id", F.try_variant_get(v, "$.t", "long").alias("t"), F.size(F.from_json(F.get_json_object("raw", "$.files"), "array<string>")).alias("files"), F.try_variant_get(v, "$.rail", "string").alias("rail")).where("t is not null")
    n = F.row_number().over(W.partitionBy("session").orderBy("t", "event_id"))
    return rows.select("session", n.alias("n"), "t", F.greatest(F.coalesce("files", F.lit(0)), F.lit(0)).cast("long").alias("files"), "rail")


LINES_SQL = f"""WITH {TOUCHES_SQL} SELECT session, row_number() OVER (PARTITION BY session ORDER BY ms, event_id) AS n, ms AS t, CASE WHEN event_id % 5 = 1 THEN 2 ELSE 0 END AS files, CASE WHEN event_id % 5 = 1 THEN 'r1' END AS rail FROM touches WHERE event_id % 5 NOT IN (0, 2)"""

QUERIES = {
    "input_touch_sets": (input_touch_sets, f"WITH {TOUCHES_SQL} SELECT event_id, coalesce(array_to_string(list_sort(list_distinct({SET_SQL})), ' '), '') AS paths FROM touches"),
    "session_tool_paths": (session_tool_paths, f"WITH {TOUCHES_SQL} SELECT DISTINCT session, unnest({SET_SQL}) AS path FROM touches"),
    "fold_entries": (fold_entries, ENTRY_SQL),
    "boundary_signals": (boundary_signals, SIGNAL_SQL),
    "active_windows": (active_windows, WINDOW_SQL),
    "coordinate_closets": (coordinate_closets, CLOSET_SQL),
    "appended_blocks": (appended_blocks, APPEND_SQL),
    "trace_scores": (trace_scores, TRACE_SQL),
    "active_path_cards": (active_path_cards, ACTIVE_SQL),
    "input_manifest": (input_manifest, "SELECT role, count(*) AS rows, sum(strlen(text))::BIGINT AS bytes, sum(('0x' || substring(sha256(text), 1, 8))::BIGINT)::BIGINT AS digest FROM conversations GROUP BY role".replace(" AS rows", ' AS "rows"')),
    "starred_moments": (starred_moments, STARRED_SQL),
    "residency": (residency, RESIDENCY_SQL),
    "summary_baseline": (summary_baseline, BASELINE_SQL),
    "vault_seed": (vault_seed, "SELECT conv_id, turn, n = 1 AS frontier FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user' AND trim(text) <> '') WHERE n <= 6"),
    "small_rules": (small_rules, rules.query("SELECT conv_id, turn, " + ", ".join(f"{e} AS {n}" for n, e in SMALL_INPUT.items()) + " FROM conversations", SMALL_STEPS, SMALL_COLUMNS)),
    "persistence_cohorts": (persistence_cohorts, COHORT_SQL),
    "artifact_lines": (artifact_lines, LINES_SQL),
}
