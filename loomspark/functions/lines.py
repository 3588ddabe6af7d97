"""Lines that others parse, their checks, and audits that end in a list of reasons, as rules over columns."""

from __future__ import annotations

# Formats of lines. Absent values are written as words.
#: From (instance, first_event, last_event, kind, target, chapter, more, gate): the pointer to an episode and why a card is shown.
CARDS = [
    {"pointer": "'  ⌖ verbatim: ' || instance || ' events ' || CAST(first_event AS VARCHAR(20)) || '..' || CAST(last_event AS VARCHAR(20)) || ' [origin=witnessed]'"},
    {
        "source": "CASE WHEN chapter IS NULL THEN 'ep#?' ELSE 'ep#' || CAST(chapter AS VARCHAR(20)) || CASE WHEN more > 0 THEN '+' || CAST(more AS VARCHAR(20)) ELSE '' END END",
        "why": "CASE kind WHEN 'term' THEN 'term-match (' || replace(replace_all(target, r'^[^:]*:', ''), '+', ', ') || ')' WHEN 'rail' THEN 'rail-match' WHEN 'mention' THEN 'mention-match' ELSE 'path-match' END",
        "gated": r"CASE WHEN gate IS NULL THEN '' ELSE ' · gate:' || replace_all(gate, r'^star:', '') END",
    },
    {"provenance": "'↞ why: ' || why || ' · ' || source || gated", "signature": "kind || ':' || coalesce(CAST(chapter AS VARCHAR(20)), '') || ':' || CAST(length(pointer) AS VARCHAR(20)) || ':' || substring(pointer, 1, 200)"},
]

#: From (message, register, category, authority, completion, stamp, identity, status, newer, glyph, headline): a waypoint's two lines.
WAYPOINTS = [
    {
        "kind": "CASE WHEN register = 'tap_star' THEN 'tap_star:' || coalesce(category, 'unknown') ELSE register END",
        "power": "coalesce(authority, CASE WHEN register = 'tap_star' THEN 'pointer' ELSE 'historical_observation' END)",
        "source": "coalesce(identity, 'fold-window:message:' || CAST(message AS VARCHAR(20)))",
        "since": "CASE WHEN newer IS NULL THEN '' ELSE ' · superseded-by=fold-window:message:' || CAST(newer AS VARCHAR(20)) || ' (msg#' || CAST(newer AS VARCHAR(20)) || ')' END",
    },
    {
        "provenance": "'↞ msg#' || CAST(message AS VARCHAR(20)) || ' · ' || kind || ' · authority=' || power || ' · completion=' || coalesce(completion, 'insufficient_alone') || ' · source-time=' || coalesce(stamp, 'unknown') || ' · source-id=' || source "
        "|| ' · source-identity=' || CASE WHEN identity IS NULL THEN 'synthetic-position' ELSE 'provider' END || CASE WHEN coalesce(status, 'unresolved') = 'unresolved' THEN '' ELSE ' · current=' || status END || since",
        "line": "CASE WHEN newer IS NOT NULL THEN '↺' ELSE glyph END || ' ' || CASE WHEN register = 'tap_star' THEN '[' || coalesce(category, 'unknown') || '] ' ELSE '' END || headline",
    },
]

#: From (stamp, reconcile, state, outcome, subject, explicit, range_text, holder, decision, statement, source): a decision's line.
DECISIONS = [
    {"cut": "CASE WHEN length(statement) <= 180 THEN statement ELSE substring(statement, 1, 179) || '…' END"},
    {
        "line": "coalesce(stamp, '[time unknown]') || ' ' || CASE WHEN reconcile THEN '⚠️ RECONCILIATION REQUIRED · ' ELSE '' END || 'DECISION state=' || state || ' outcome=' || outcome || ' reconciliation-required=' || CASE WHEN reconcile THEN 'true' ELSE 'false' END "
        "|| ' subject=' || json_text(subject) || ' subject-explicit=' || CASE WHEN explicit THEN 'true' ELSE 'false' END || ' range=' || json_text(coalesce(range_text, 'unspecified')) || ' holder=' || json_text(coalesce(holder, 'unknown')) "
        "|| ' decision-id=' || json_text(decision) || ' statement=' || json_text(cut) || ' ↞ source=' || coalesce(source, 'unknown')",
        "resolution": "'RECONCILIATION version=1 record-type=decision record-id=' || json_text(decision) || ' target=' || json_text(coalesce(holder, 'unknown')) || ' outcome=' || outcome || ' reconciliation-required=' || CASE WHEN reconcile THEN 'true' ELSE 'false' END",
        "authority": "'authority resolution · winner=' || state || ' · source=' || json_text(coalesce(source, 'unknown')) || ' · outranks=' || CASE WHEN explicit THEN 'prose > none' ELSE 'none' END",
    },
]

#: From (turns, before_chars, after_chars, view, block, rows_text): headers of folded text, and a block put at the end of a view.
BLOCKS = [
    {
        "header": "'[Conversation Context — ' || CAST(turns AS VARCHAR(20)) || ' turns folded, ' || CAST(CAST(floor(before_chars / 1000 + 0.5) AS BIGINT) AS VARCHAR(20)) || 'K → ' || CAST(CAST(floor(after_chars / 1000 + 0.5) AS BIGINT) AS VARCHAR(20)) || 'K chars]'",
        "merged": "CASE WHEN block = '' THEN view WHEN view = '' THEN block ELSE view || chr(10) || chr(10) || block END",
        "vault": "CASE WHEN rows_text = '' THEN '' ELSE '[User Message Vault]' || chr(10) || rows_text || chr(10) || '[/User Message Vault]' END",
    },
]

#: From an envelope (artifact, start_at, end_at, n, unit_a, unit_b, trace_a, trace_b, tail, resumes, supersession, superseded_at, objective,
#: confidence, rail, step): the rules that it breaks, joined by commas, and its compact line.
ENVELOPE = [
    {
        "errors": "listed("
        "CASE WHEN trim(artifact) = '' THEN 'artifact' END, CASE WHEN end_at IS NOT NULL AND unit_a <> unit_b THEN 'source.unit-mismatch' END, CASE WHEN end_at IS NOT NULL AND coalesce(trace_a, '') <> coalesce(trace_b, '') THEN 'source.trace-mismatch' END, "
        "CASE WHEN end_at < start_at THEN 'source.reverse-range' END, CASE WHEN end_at - start_at <> n THEN 'source.count-mismatch' END, CASE WHEN n < 0 THEN 'source.count' END, CASE WHEN tail < 0 THEN 'topology.rawTailCount' END, "
        "CASE WHEN tail > 0 AND resumes IS NULL THEN 'rawResumesAt.missing' END, CASE WHEN tail = 0 AND resumes IS NOT NULL THEN 'rawResumesAt.without-tail' END, CASE WHEN supersession = 'explicit' AND superseded_at IS NULL THEN 'supersededAt.missing' END, "
        "CASE WHEN confidence <> 'unknown' AND coalesce(trim(objective), '') = '' THEN 'liveObjective.missing' END, CASE WHEN rail IS NOT NULL AND trim(rail) = '' THEN 'activeRailId' END, "
        "CASE WHEN step IS NOT NULL AND coalesce(trim(rail), '') = '' THEN 'activeRailId.missing' END, CASE WHEN resumes < end_at THEN 'rawResumesAt.before-source-end' END)"
    },
    {
        "compact": "'[Chronological Provenance v1] artifact=' || CASE WHEN errors <> '' THEN coalesce(nullif(replace_all(artifact, r'\\s+', '_'), ''), 'unknown') || ' provenance=invalid errors=' || errors "
        "ELSE artifact || ' source=' || CAST(start_at AS VARCHAR(20)) || '..' || coalesce(CAST(end_at AS VARCHAR(20)), '') || ' raw-resumes=' || CASE WHEN resumes IS NULL THEN 'none' ELSE CAST(resumes AS VARCHAR(20)) || '(' || CAST(tail AS VARCHAR(20)) || ' exact)' END END"
    },
]

#: From (rail_state, validation, source_id, stamp_ms, claimed, signals): whether a claim of completion is borne out.
COMPLETION = [
    {"done": "rail_state = 'complete'", "checked": "coalesce(validation = 'verified' AND trim(source_id) <> '' AND stamp_ms IS NOT NULL, FALSE)"},
    {
        "authoritative": "done AND checked",
        "issues": "listed(CASE WHEN claimed AND NOT done THEN 'error:completion-rail-not-complete' END, CASE WHEN claimed AND NOT checked THEN CASE WHEN validation IS NULL THEN 'warning' ELSE 'error' END || ':completion-validation-missing' END, "
        "CASE WHEN signals > 0 AND NOT (done AND checked) THEN 'warning:advisory-signals' END)",
    },
]

#: From (history, folded, boundary, config) as stored and as probed (p_...): digests of a preparation and what has gone stale since.
RECEIPT = [
    {"raw_digest": "digest(history)", "view_digest": "digest(folded)", "prefix_digest": "CASE WHEN boundary > 0 THEN digest(substring(folded, 1, CAST(boundary AS INT))) END", "config_digest": "CASE WHEN config IS NOT NULL THEN digest(config) END"},
    {
        "stale": "listed(CASE WHEN version <> 1 THEN 'receipt_version_unsupported' END, CASE WHEN p_history IS NOT NULL AND digest(p_history) <> raw_digest THEN 'raw_history_digest_changed' END, CASE WHEN p_folded IS NOT NULL AND digest(p_folded) <> view_digest THEN 'folded_view_digest_changed' END, "
        "CASE WHEN p_folded IS NOT NULL AND prefix_digest IS NOT NULL AND coalesce(CASE WHEN p_boundary > 0 THEN digest(substring(p_folded, 1, CAST(p_boundary AS INT))) END, '') <> prefix_digest THEN 'frozen_prefix_digest_changed' END, "
        "CASE WHEN p_config IS NOT NULL AND coalesce(config_digest, '') <> digest(p_config) THEN 'config_digest_changed' END)"
    },
    {"verdict": "CASE WHEN stale = '' THEN 'safe_to_resume' ELSE 'stale' END"},
]

#: From (edge, name, status, trace, events, claims, files, fact, hazards): a receipt's control block, and what is read back from one.
CONTROL = [
    {
        "block": "'boundary=' || edge || ' · identity=' || coalesce(name, 'self') || ' · runtime=' || coalesce(status, 'unknown') || chr(10) || 'frontier=' || CASE WHEN trace IS NULL THEN 'unknown' ELSE trace || '@event#' || CAST(events AS VARCHAR(20)) END || chr(10) "
        "|| 'active files · claims=' || coalesce(claims, 'none') || ' · recent edits=' || coalesce(files, 'none') || CASE WHEN fact IS NULL THEN '' ELSE chr(10) || 'validation=' || fact END || CASE WHEN hazards IS NULL THEN '' ELSE chr(10) || 'unresolved hazards: ' || hazards END",
    },
    {
        "read_edge": r"regexp_extract(block, r'boundary=([a-z_]+)', 1)", "read_trace": r"nullif(regexp_extract(block, r'frontier=([^\n@]+)@event#', 1), '')", "read_events": r"CAST(nullif(regexp_extract(block, r'@event#([0-9]+)', 1), '') AS BIGINT)",
        "read_claims": r"nullif(regexp_extract(block, r'claims=([^·\n]*[^·\n ])', 1), 'none')", "read_fact": r"nullif(regexp_extract(block, r'\nvalidation=([^\n]+)', 1), '')",
    },
    {"valid": "read_edge IN ('continuation', 'fresh_fork', 'brain_merge', 'resurrection') AND (read_events IS NULL OR read_events >= 0)", "same": "read_edge = edge AND coalesce(read_trace, '') = coalesce(trace, '') AND coalesce(read_events, -1) = CASE WHEN trace IS NULL THEN -1 ELSE events END AND coalesce(read_claims, '') = coalesce(claims, '') AND coalesce(read_fact, '') = coalesce(fact, '')"},
]

#: From (scope, instruction): the paths a step predicts, those of its scope first, each once whatever its case, at most 24.
PREFETCH = [
    {"found": r"joined(regexp_extract_all(coalesce(scope, ''), r'([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+)', 1), regexp_extract_all(coalesce(instruction, ''), r'([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+)', 1))"},
    {"low": "first_distinct(transform(found, x -> lower(replace_all(x, r'[.,;:]+$', ''))))"},
    {"predicted": "array_join(head(low, 24), ' ')"},
]
