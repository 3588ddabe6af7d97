"""Recovery after a lost context: what broke a chain, why, from whom, and how rates are recoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frames of a chat room, and other texts that no operator wrote.
CHAT = r"\[Chat Room \x22|Mentioned by|(^|\n)-- .+ in #|(^|\n)── .+ in #"
EXTERNAL = r"\[Chat Room |Mentioned by|(^|\n)-- .+ in #|(^|\n)── .+ in #|\[DIGEST DELTA|\[CHATROOM SIGNALS|\[Task rail|\[CONTEXT REBIRTH\]"
# Texts that only close, and words that mean the same intent.
CLOSER = r"^\s*(ok(ay)?|k|thx|thanks?|thank you|ty|cool|nice|great|perfect|got it|sounds good|yes|yep|yeah|no|nope|stop|done|continue|go ahead|go|proceed|sure|right|exactly|[.?!])[^a-z0-9_]*$"
SAME = (
    r"\b(continue|keep going|go ahead|go for it|proceed|finish|finish it|carry on|resume|pick up|same|that|those|it|this|do it|do that|did you|have you|any update|status|fixed|fix it|"
    r"ship it|land it|do all|do it all|load a rail|run it|rerun|re-run|try again|yes|yep|yeah|ok|okay|sounds good)\b"
)
# Words that say nothing about a shared topic.
STOP = "the and for you that this with from have what when where how are all can into our your".split()
# Tools that look around again, and tools that change something.
REORIENT = "atlas_query atlas_graph Grep Glob Read tap_instance_messages psychic_pov query_global_index query_turns chatroom WebSearch WebFetch search_docs partner_file_claims squad_file_claims".split()
SUBSTANTIVE = "Edit Write NotebookEdit apply_migration apply_patch".split()
# Labels of a judge that take a row out of the rate.
CENSORED = ("external_chat_or_system_preemption", "operator_supersession_new_intent", "ambiguous")


def _holds(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"instr({column}, '{w}') > 0" for w in words) + ")"


def _words(column: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP)
    return f"array_distinct(filter(regexp_extract_all(lower({column}), r'([a-z0-9_/-]{{4,}})', 1), x -> x NOT IN ({stop})))"


#: From (text, root_text, reason, chat_tool, label, stamp): classes of a turn.
CLASSES = [
    {"body": "coalesce(text, '')", "why": "lower(coalesce(reason, ''))", "stamped": "trim(coalesce(stamp, ''))"},
    {"stripped": r"replace_all(body, r'^\s+|\s+$', '')", "framed": f"regexp_like(body, r'{CHAT}')"},
    {
        "source": "CASE WHEN framed THEN 'chatroom_agent' ELSE 'human_direct' END",
        "actionable": f"length(stripped) >= 8 AND NOT regexp_like(lower(stripped), r'{CLOSER}')",
        "overlap": f"size(array_intersect({_words('coalesce(root_text, ' + repr('') + ')')}, {_words('stripped')})) >= 2",
        "same": f"regexp_like(lower(stripped), r'{SAME}')",
        "reason_class": "CASE WHEN why = '' THEN 'unknown' "
        f"WHEN {_holds('why', ('wave', 'decompose', 'shoot', 'review', 'improve'))} THEN 'wave_pipeline' WHEN {_holds('why', ('manual', 'operator', 'ui', 'button'))} THEN 'manual_operator' "
        f"WHEN {_holds('why', ('threshold', 'context', 'compact', 'ceiling'))} THEN 'threshold_or_context_pressure' WHEN {_holds('why', ('resume', 'restore', 'library'))} THEN 'resume_restore' "
        f"WHEN instr(why, 'self') > 0 THEN 'self_rebirth_tool' WHEN {_holds('why', ('watchdog', 'refresh', 'health'))} THEN 'watchdog_refresh' WHEN {_holds('why', ('evolution', 'alternating', 'protocol'))} THEN 'pipeline_other' ELSE 'other' END",
        "trigger": "CASE WHEN why = '' THEN 'unknown' WHEN instr(why, 'manual ui') > 0 THEN 'manual_ui' WHEN instr(why, 'turn-threshold') > 0 THEN 'turn_threshold' WHEN instr(why, 'compact') > 0 THEN 'compact' "
        "WHEN regexp_like(why, r'^(resume|restore)') THEN 'cold_resume' WHEN instr(why, 'watchdog') > 0 THEN 'watchdog' WHEN instr(why, 'evolution-chamber') > 0 THEN 'evolution_chamber' "
        "WHEN instr(why, 'wave') > 0 THEN 'wave_protocol' WHEN instr(why, 'review') > 0 THEN 'review' ELSE 'context_pressure' END",
        "ms": "CASE WHEN regexp_like(stamped, r'^[0-9]{1,18}$') THEN CAST(stamped AS BIGINT) WHEN regexp_like(stamped, r'^[0-9]{4}-[0-9]{2}-[0-9]{2}T') THEN iso_ms(CASE WHEN regexp_like(stamped, r'^[0-9]{4}-[0-9]{2}-[0-9]{2}T') THEN stamped END) END",
        "status": "CASE WHEN label IN ('recovered_after_same_nudge', 'hard_churn/no_success') THEN label WHEN label IN (" + ", ".join(f"'{c}'" for c in CENSORED) + ") THEN 'censored_' || label "
        "WHEN label = 'same_intent_nudge_or_reask' THEN 'hard_churn_after_same_nudge' ELSE 'needs_human_adjudication' END",
    },
    {
        "break_label": f"CASE WHEN regexp_like(body, r'{EXTERNAL}') OR (chat_tool AND framed) THEN 'external_chat_or_system_preemption' WHEN stripped = '' THEN 'ambiguous' "
        "WHEN same AND (length(stripped) <= 80 OR overlap) THEN 'same_intent_nudge_or_reask' WHEN length(stripped) < 10 THEN 'ambiguous' ELSE 'operator_supersession_new_intent' END",
        "recovered": "coalesce(label, '') = 'recovered_after_same_nudge'",
        "censor": "CASE WHEN status = 'needs_human_adjudication' THEN 'ambiguous' WHEN substring(status, 1, 9) = 'censored_' THEN label END",
    },
]

#: From (unjustified, handed, known_retrievals, retrievals, resumed, rail, errors, turns): the score of a window.
SCORE = [
    {
        "r_read": "CASE WHEN handed > 0 THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - CAST(unjustified AS DOUBLE) / handed)) END",
        "r_ret": "CASE WHEN retrievals > 0 THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - CAST(known_retrievals AS DOUBLE) / retrievals)) END",
        "t_pos": "CASE WHEN rail THEN CAST(CASE WHEN resumed THEN 1 ELSE 0 END AS DOUBLE) END",
        "redundancy": "unjustified + known_retrievals",
        "err_rate": "CASE WHEN turns > 0 THEN round(CAST(errors AS DOUBLE) / turns, 4) ELSE CAST(0 AS DOUBLE) END",
    },
    {"parts": "CASE WHEN r_read IS NULL THEN 0 ELSE 1 END + CASE WHEN r_ret IS NULL THEN 0 ELSE 1 END + CASE WHEN t_pos IS NULL THEN 0 ELSE 1 END"},
    {"score": "CASE WHEN parts > 0 THEN round((coalesce(r_read, CAST(0 AS DOUBLE)) + coalesce(r_ret, CAST(0 AS DOUBLE)) + coalesce(t_pos, CAST(0 AS DOUBLE))) / parts, 9) END"},
]


def recoded(rows: DataFrame, by: str) -> DataFrame:
    """For each group of classified rows: the uncensored rate, what is censored, and hard failures."""
    free = F.col("censor").isNull()
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(free).alias("n_uncensored"),
        F.count_if(free & F.col("recovered")).alias("k"),
        F.count_if(~free).alias("censored_n"),
        F.count_if(free & ~F.col("recovered")).alias("hard_fail"),
        F.count_if(F.col("status") == "needs_human_adjudication").alias("unsure"),
        F.count_if(F.col("actionable")).alias("actionable_n"),
    )


def after_nudge(rows: DataFrame) -> DataFrame:
    """For each chain (conv_id, turn, break_label, success) after its first nudge: how it went on.

    The first later turn that succeeds, or whose label is another than a nudge, decides; without one
    the chain churned. One aggregation of the deciding turn, no scan in order.
    """
    start = rows.where("break_label = 'same_intent_nudge_or_reask'").groupBy("conv_id").agg(F.min("turn").alias("start"))
    later = rows.join(start, "conv_id").where("turn > start")
    decides = F.col("success") | (F.col("break_label") != "same_intent_nudge_or_reask")
    row = F.when(decides, F.struct("turn", F.when(F.col("success"), "recovered_after_same_nudge").otherwise(F.concat(F.lit("censored_after_same_nudge_"), "break_label")).alias("outcome")))
    first = later.groupBy("conv_id").agg(F.min(row).alias("first"))
    return start.join(first, "conv_id", "left").select("conv_id", "start", F.coalesce("first.outcome", F.lit("hard_churn_after_same_nudge")).alias("outcome"), F.col("first.turn").alias("decided_at"))


def before_substance(calls: DataFrame) -> DataFrame:
    """For each chain of tool calls (chain, pos, tool): calls that look around before the first that changes something."""
    name = F.regexp_replace("tool", "^mcp__[a-z0-9-]+__", "")
    calls = calls.withColumn("name", name)
    first = calls.groupBy("chain").agg(F.min(F.when(F.col("name").isin(*SUBSTANTIVE), F.col("pos"))).alias("first"))
    looked = F.col("name").isin(*REORIENT) & (F.col("first").isNull() | (F.col("pos") < F.col("first")))
    return calls.join(first, "chain").groupBy("chain").agg(F.count_if(looked).alias("reorient"), F.bool_or(F.col("first").isNotNull()).alias("substantive"))


def recent_reads(calls: DataFrame, at: DataFrame, lookback: int = 60) -> DataFrame:
    """Distinct paths read among the last ``lookback`` calls (session, pos, path, kind) before each asked place (session, at)."""
    joined = at.join(calls, "session").where((F.col("pos") < F.col("at")) & (F.col("pos") >= F.col("at") - lookback))
    return joined.where("kind = 'read'").groupBy("session", "at").agg(F.count_distinct("path").alias("reads"))


def judged(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Verdicts (judge, pos, root, label) with what is wrong: no root, a root again, or a label that is not allowed."""
    from pyspark.sql import Window as W

    again = F.row_number().over(W.partitionBy("judge", "root").orderBy("pos")) > 1
    error = F.when(F.coalesce("root", F.lit("")) == "", "missing root").when(again, "duplicate root").when(~F.coalesce(F.col("label").isin(*allowed), F.lit(False)), "invalid label")
    return rows.select("judge", "pos", "root", "label", error.alias("error"))
