"""Rules of budgets, eligibility, guards, settings, paths, literals, tools and texts, asked of whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from loomspark.functions import context_budget as cb
from loomspark.functions import literals as lt
from loomspark.functions import models, rules
from loomspark.sources.bindings import messages, table

ENGINES = [*cb.ENGINE_WINDOWS, "", "other"]


def _pick(values: list[str], number: str) -> str:
    """One of several texts by a number; the empty text stands for null."""
    return f"nullif(CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END, '')"


#: Each rule: the table, its inputs as SELECT list, the steps, the columns of the answer.
RULES: dict[str, tuple[str, list[str], dict[str, str], list, list[str]]] = {
    "context_budgets": (
        "orders", ["o_orderkey", "o_custkey"],
        {"id": "o_orderkey", "engine": _pick(ENGINES, "o_orderkey"), "known_model": "o_custkey % 3 = 0", "asked_window": "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 70 AS BIGINT) * 30000 END", "single": "o_custkey % 2 = 0"},
        cb.GEOMETRY,
        ["id", "win", "limit_source", "tier", "profile", "output_reserve", "tools_reserve", "margin", "message_ceiling", "band", "pressure", "saturation", "fold_trigger", "tail_cap", "tool_result_cap",
         "eviction", "cli_target", "hard_epoch", "full_chars", "essence_chars", "evict_chars", "boundary_chars", "cold_closet_chars"],
    ),
    "epoch_eligibility": (
        "orders", ["o_orderkey", "o_custkey", "o_totalprice"],
        {"id": "o_orderkey", "measured": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END", "ceiling": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 180000 END",
         "floor_tokens": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice * 0.6 END", "trigger": "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 150000 END", "appends": "o_orderkey % 3",
         "tail_asked": "o_orderkey % 5 <> 0", "append_on": "o_custkey % 11 <> 0", "single": "o_orderkey % 2 = 0", "forced": "o_custkey % 13 = 0", "append_target": "5000", "least_runway": "30000"},
        cb.ELIGIBILITY, ["id", "decision", "reason", "m", "pressed", "basis", "runway", "band_tokens", "holds"],
    ),
    "reconstruction_due": (
        "orders", ["o_orderkey", "o_custkey", "o_totalprice"],
        {"id": "o_orderkey", "raw_chars": _pick(["", "500000", "abc", "0", "30000", " 70000x", "-5"], "o_orderkey"), "asked_window": "CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE CAST(o_custkey % 50 AS BIGINT) * 20000 END",
         "usage": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END", "last_usage": "CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE CAST(floor(o_totalprice * 0.8) AS BIGINT) END",
         "step": "20000", "target": "150000", "flag": _pick(["", "off", "FALSE", "Dry-Run", "on"], "o_custkey")},
        cb.RECONSTRUCTION, ["id", "configured", "birth_cap", "seed_cap", "due", "policy_trigger", "mode", "should_fold"],
    ),
    "sealed_guards": (
        "orders", ["o_orderkey", "o_custkey", "o_totalprice"],
        {"id": "o_orderkey", "ratio": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey % 101 AS DOUBLE) / 100 END", "measured": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END",
         "trigger": "150000", "least_runway": "CASE WHEN o_custkey % 2 = 0 THEN 30000 END", "transition": _pick(["", "hot-reuse", "append-tail-epoch", "cold-gap", "first-call"], "o_orderkey"),
         "target_kind": _pick(["band-append", "raw-tail-append", "frozen-prefix", "sealed-band", "transient-render", "recall-card-injection"], "o_custkey"), "hard": "o_orderkey % 4 = 0"},
        cb.GUARDS, ["id", "disposition", "alarm", "unshrunk", "low_yield", "stratum", "allowed", "violation"],
    ),
    "recall_geometry": (
        "orders", ["o_orderkey", "o_custkey"],
        {"id": "o_orderkey", "passes": "o_orderkey % 12", "window_turns": "o_custkey % 8", "recency_turns": "o_custkey % 9", "total_chars": "CAST(o_orderkey % 2000 AS BIGINT)", "card_chars": "CAST(o_custkey % 900 AS BIGINT)"},
        cb.RECALL_GEOMETRY, ["id", "dead_zone", "below_window", "card_body", "card_too_small"],
    ),
    "settings": (
        "orders", ["o_orderkey", "o_custkey"],
        {"id": "o_orderkey", "flag": _pick(["", " OFF ", "1", "yes", "no", "true", "False", "on", "0", "maybe"], "o_orderkey"), "number_text": _pick(["", "12", "0", "-3", " 7 ", "9x", "x9", "+5"], "o_custkey"),
         "fraction_text": _pick(["", "0.5", "1", "1.5", "0", "abc", " .25", "0.75x"], "o_orderkey")},
        cb.SETTINGS, ["id", "default_on", "default_off", "number", "positive", "fraction", "unit"],
    ),
    "small_scores": (
        "orders", ["o_orderkey", "o_custkey", "o_totalprice"],
        {"id": "o_orderkey", "distance": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 9 END", "behavioural": "CAST(o_custkey % 11 AS DOUBLE) / 10", "event_kind": _pick(["path_edited", "verbatim_reused", "term_echo", "ignored"], "o_custkey"),
         "used": "CAST(floor(o_totalprice) AS BIGINT)", "win": "CASE WHEN o_custkey % 6 = 0 THEN 0 ELSE 200000 END", "per_turn": "o_orderkey % 4 * 1500", "chars": "CAST(o_orderkey % 9000 AS BIGINT)",
         "level": _pick(["healthy", "warning", "critical", "auto_compact"], "o_orderkey"), "ttl": _pick(["5m", "1h"], "o_orderkey")},
        cb.SCORES, ["id", "booster", "blended", "event_weight", "turns_left", "auction_chars", "beta_header"],
    ),
}


def _asked(name: str) -> Callable[[SparkSession, str], DataFrame]:
    source, needs, inputs, steps, columns = RULES[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        bound = table(spark, d, source, *needs).selectExpr(*(f"{rules.spark(e)} AS {c}" for c, e in inputs.items()))
        return rules.apply(bound, steps).select(*columns)

    run.__name__ = name
    return run


def _sql(name: str) -> str:
    source, _, inputs, steps, columns = RULES[name]
    return rules.query("SELECT " + ", ".join(f"{e} AS {c}" for c, e in inputs.items()) + f" FROM {source}", steps, columns)




def _words(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words of all documents."""
    words = table(spark, d, "documents", "text").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("value"))
    return words.where("value <> ''").distinct()


WORDS_SQL = r"SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS value FROM documents"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all messages, some of them dressed as prose about work."""
    rows = messages(spark, d).select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return rows.selectExpr("conv_id", "turn", "CAST(i AS BIGINT) AS i", f"{DRESSED} AS line")


DRESSED = _pick(["-", "Found: ", "🏁 fixed the thing: ", "⚠️ ", "🔍 tracing ", "> decided to ", "validation passed: ", "💬 ", "3. root cause "], "turn").replace("nullif(", "replace(coalesce(").replace(", '')", ", ''), '-', '')") + " || text"
LINES_SQL = f"SELECT conv_id, turn, i - 1 AS i, {DRESSED} AS line FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)"

RAW = """CASE event_id % 16 WHEN 0 THEN '/home/u/repo/src/mod' || n || '.ts:12:3' WHEN 1 THEN './src/mod' || n || '.ts' WHEN 2 THEN '`src/mod' || n || '.ts`,' WHEN 3 THEN 'https://host/mod' || n || '.ts'
WHEN 4 THEN 'node_modules/p/mod' || n || '.js' WHEN 5 THEN '/dev/null' WHEN 6 THEN '"src/mod' || n || '.ts").' WHEN 7 THEN 'mod' || n WHEN 8 THEN '/usr/lib/mod' || n || '.so' WHEN 9 THEN 'src/*.ts'
WHEN 10 THEN 'a/b' WHEN 11 THEN '/tmp/tool-result-spool/scr_123456_' || n || '.txt:7' WHEN 12 THEN 'data:' || n || '/x.ts' WHEN 13 THEN ' /etc/x' || n || '.conf ' WHEN 14 THEN 'key=' || n || '/y.md' ELSE '../lib/mod' || n || '.test.tsx' END"""
NUMBERED = "SELECT event_id, CAST(event_id % 97 AS VARCHAR(20)) AS n FROM events"
TOOL = _pick(["", "Edit", "mcp__files__str_replace", "TodoWrite", "task_rail", "x__task_rail", "fold_recall", "w__fold_recall", "mcp_atlas_search", "atlas_query", "a.atlas_lookup", "tap_star", "h__tap_star", "Read", "chatroom", "NotebookEdit"], "event_id")
ACTION = _pick(["", "search", "lookup", "pin", "cluster", " PIN ", "brief"], "(event_id // 3)")
CATEGORY = _pick(["decision", "", "Decision ", "gotcha"], "(event_id // 5)")
DIVIDED = "CAST(floor(event_id / {n}) AS BIGINT)"
HEAD = _pick(["", "[birth-fold] carried over" , "[User Message Vault]", "[Chat Room \"x\"]", "@bob", "[2026-01-02 03:04]", "[CONTEXT REBIRTH]", "[Digest Delta]", "[Fold epoch #3]", "[Request interrupted by user]"], "turn")
DIVIDED_ACTION, DIVIDED_CATEGORY = (x.replace(f"(event_id // {k})", DIVIDED.format(n=k)) for x, k in ((ACTION, 3), (CATEGORY, 5)))
HEADED = f"CASE WHEN turn % 10 = 9 THEN {HEAD} WHEN turn % 10 = 1 THEN {HEAD} || chr(10) || chr(10) || text WHEN turn % 10 = 0 THEN text ELSE {HEAD} || ' ' || text END"
CLAIM = {
    "id": "o_orderkey", "claim": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END", "origin": _pick(["witnessed", "derived", "synthesized", "", "other"], "o_orderkey"), "source_id": _pick(["", "src-1", " ", " s2 "], "o_custkey"),
    "content_class": _pick(["raw", "exact-excerpt", "synthesized-history", "retrieved-history", "reconstructed-state", "live-state", "boundary"], "o_orderkey"), "lifecycle": _pick(["", "", "fresh_fork", "continuation"], "o_custkey"),
    "fresh": "o_orderkey % 6 = 0", "merged": "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 2 END",
}


def _over(rows: Callable[[SparkSession, str], DataFrame], steps: list, columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rules.apply(rows(spark, d), steps).select(*columns)


def _events(expressions: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    def rows(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "events", "event_id").selectExpr("event_id", "CAST(event_id % 97 AS STRING) AS n")
        return e.selectExpr("event_id", *(f"{rules.spark(x)} AS {c}" for c, x in expressions.items()))

    return rows


def _from_events(expressions: dict[str, str]) -> str:
    return "SELECT event_id, " + ", ".join(f"{x} AS {c}" for c, x in expressions.items()) + f" FROM ({NUMBERED})"


PATH_COLUMNS = ["event_id", "path", "eligible", "member", "absolute", "key_part", "touch"]
LITERAL_COLUMNS = ["value", "key", "number_form", "opaque", "noise", "anchor_worthy", "anchor_value"]
TOOL_COLUMNS = ["event_id", "leaf", "short_name", "edits", "bookkeeping", "recalls", "discovers", "live_read", "decision_input", "boundary_class"]
TEXT_COLUMNS = ["conv_id", "turn", "synthetic", "genuine", "objective", "stamp", "vault_text", "head_line"]
LINE_COLUMNS = ["conv_id", "turn", "i", "mode", "kind", "narrates", "process", "gotcha", "eligible_glyph", "validation"]
CLAIM_COLUMNS = ["id", "kept_origin", "valid", "witnessed", "rendered", "class_origin", "boundary"]
TOOL_INPUTS = {"tool": TOOL, "action": DIVIDED_ACTION, "category": DIVIDED_CATEGORY}
RULES["historical_claims"] = ("orders", ["o_orderkey", "o_custkey", "o_orderpriority"], CLAIM, lt.CLAIMS, CLAIM_COLUMNS)

QUERIES = {name: (_asked(name), _sql(name)) for name in RULES}
MODEL = _pick(["claude-sonnet-4-6", "Claude-Opus-4-9", "gpt-5.4-mini", " gpt-5.6-sol ", "gpt-5.5-x", "codex-5.4", "GEMINI-2.5-pro-x", "minimax-M3-beta", "grok-9", "", "o3-pro-2", "qwen3.6-flash", "gpt-4o-mini", "glm-5v"], "o_orderkey")
MODEL_INPUT = {"id": "o_orderkey", "model": f"coalesce({MODEL}, '')", "engine": _pick(["", "claude", "codex-api", "openai", "Grok", "gemini", "nobody"], "o_custkey")}
RANKS = dict(zip(models.AUTHORITY, ("o_orderkey % 7 = 1", "o_orderkey % 3 = 1", "o_custkey % 5 = 2", "o_custkey % 2 = 0", "o_orderkey % 11 = 4", "o_custkey % 3 = 0", "o_orderkey % 2 = 0", "o_custkey % 7 = 1"), strict=True))


def model_windows(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "orders", "o_orderkey", "o_custkey").selectExpr(*(f"{e} AS {c}" for c, e in MODEL_INPUT.items()))
    return models.model_windows(asked).select("id", "window")


def authority(spark: SparkSession, d: str) -> DataFrame:
    winner, below = models.authority({r: F.expr(e) for r, e in RANKS.items()})
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), winner.alias("winner"), below.alias("outranks"))


AUTHORITY_SQL = "WITH l AS (SELECT o_orderkey AS id, list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{r}' END" for r, e in RANKS.items()) + "], lambda x: x IS NOT NULL) AS p FROM orders) SELECT id, p[1] AS winner, coalesce(array_to_string(p[2:], ' > '), '') AS outranks FROM l"
QUERIES |= {
    "model_windows": (model_windows, "WITH a AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in MODEL_INPUT.items()) + f" FROM orders) SELECT id, {models.model_windows_sql()}::BIGINT AS window FROM a".replace(" AS window", ' AS "window"')),
    "authority": (authority, AUTHORITY_SQL),
    "touch_paths": (_over(_events({"raw": RAW}), lt.PATHS, PATH_COLUMNS), rules.query(_from_events({"raw": RAW}), lt.PATHS, PATH_COLUMNS)),
    "literal_worth": (_over(_words, lt.LITERALS, LITERAL_COLUMNS), rules.query(WORDS_SQL, lt.LITERALS, LITERAL_COLUMNS)),
    "tool_roles": (_over(_events(TOOL_INPUTS), lt.TOOLS, TOOL_COLUMNS), rules.query(_from_events(TOOL_INPUTS), lt.TOOLS, TOOL_COLUMNS)),
    "operator_texts": (_over(lambda spark, d: messages(spark, d).selectExpr("conv_id", "turn", f"{HEADED} AS text"), lt.OPERATOR_TEXT, TEXT_COLUMNS), rules.query(f"SELECT conv_id, turn, {HEADED} AS text FROM conversations", lt.OPERATOR_TEXT, TEXT_COLUMNS)),
    "narration_lines": (_over(_lines, lt.NARRATION, LINE_COLUMNS), rules.query(LINES_SQL, lt.NARRATION, LINE_COLUMNS)),
}
