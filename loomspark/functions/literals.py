"""Paths, literals, tool names and operator texts judged by rules over columns.

In regular expressions \\x27 is the apostrophe, \\x22 the quotation mark and \\x60 the grave accent, so that a
pattern can stand in any SQL literal.
"""

from __future__ import annotations

# First path segments that make a chain of words a path of code.
CODE_ROOTS = "src test tests dist lib app relay packages shared docs sop data logs scripts node_modules components stores routes crossinstancetools __tests__ home tmp var usr etc mnt opt".split()
# Tools that only keep books.
BOOKKEEPING = (
    "task_rail partner_claim_file partner_release_file partner_file_claims atlas_commit atlas_commit_batch chatroom tap_star raw_signal inbox_send "
    "wave_advance wave_complete wave_complete_implementation wave_set_next_directive agent_slots slot_report"
).split()
# Parts of the names of tools that edit.
EDIT_HINTS = "edit write apply_patch notebookedit str_replace create_file".split()
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_IDS = "sig|msg|inst|task|thread|summon|fork|group|epoch|tool|call"


def _among(column: str, values: list[str]) -> str:
    return f"{column} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


def _any(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_like({column}, r'{p}')" for p in patterns) + ")"


#: From raw: the touched path without quotes, closing marks and line numbers, and what it may be used for.
PATHS = [
    {"bare": r"replace_all(replace_all(trim(raw), r'^[\x27\x22\x60]+', ''), r'[\x27\x22\x60.,)]+$', '')"},
    {"path": r"replace_all(bare, r':[0-9]+(:[0-9]+)?$', '')"},
    {
        "eligible": r"length(path) BETWEEN 3 AND 512 AND NOT regexp_like(path, r'^https?://') AND NOT regexp_like(path, r'[\r\n\t]') AND instr(path, 'node_modules/') = 0 "
        r"AND substring(path, 1, 5) <> 'data:' AND instr(path, '/') > 0 AND regexp_like(path, r'[.][A-Za-z0-9]{1,12}$')",
        "member": r"length(raw) BETWEEN 1 AND 512 AND NOT regexp_like(raw, r'[\s\x22\x27\x60;=]') AND substring(raw, 1, 1) <> '!' AND NOT regexp_like(raw, r'[*{}]') "
        r"AND regexp_like(raw, r'[^/]*[.][^/]*$') AND NOT regexp_like(raw, r'^/(bin|sbin|dev)(/|$)') AND NOT regexp_like(raw, r'^/(usr|etc|opt|proc|sys)/') AND instr(raw, 'node_modules') = 0",
        "absolute": "substring(raw, 1, 1) = '/'",
        "key_part": r"replace_all(raw, r'^[.]?/', '')",
    },
    {"touch": "CASE WHEN eligible THEN path END"},
]

#: From value: whether a literal is worth carrying, and how much.
LITERALS = [
    {"v": "trim(value)"},
    {
        "key": "CASE WHEN substring(v, 1, 1) = '/' THEN substring(v, 2, 100000) ELSE v END",
        "number_form": r"CASE WHEN regexp_like(v, r'^[0-9]{1,15}$') THEN CAST(CAST(v AS BIGINT) AS VARCHAR(40)) ELSE v END",
        "opaque": r"v = '' OR (NOT regexp_like(v, r'\s[(][^)]+[)]$') AND NOT regexp_like(v, r'^[A-Za-z_][A-Za-z0-9_.-]{0,40}[=:]') AND regexp_like(v, r'^([0-9a-fA-F]{6,}|[0-9]+)$'))",
        "chain": r"instr(v, '/') > 0 AND NOT regexp_like(v, r'(^/|//|/$)')",
        "rooted": "regexp_like(lower(v), r'(^|/)(" + "|".join(CODE_ROOTS) + ")(/|$)')",
    },
    {
        "plain_chain": r"chain AND NOT rooted AND regexp_like(v, r'^[A-Za-z_-]+(/[A-Za-z_-]+){1,3}$')",
        "single_segment": r"chain AND NOT rooted AND NOT regexp_like(v, r'[.0-9]') AND regexp_like(v, r'(^|/)[^/](/|$)')",
    },
    {
        "noise": "v = '' OR instr(v, 'tool-result-spool/') > 0 OR instr(v, 'browser-artifacts/') > 0 OR instr(v, '/*') > 0 OR plain_chain OR single_segment OR "
        + _any("v", [
            r"(^|/)scr_[0-9]{6,}_[0-9a-f]{6,}", r"(^|/)tmp/", r"^[0-9a-fA-F]{40,}$", r"^[0-9]{1,4}/[0-9]{1,4}$", r"^[A-Za-z_][A-Za-z0-9_.-]{0,40}[=:][ ]?[0-9]{1,4}/[0-9]{1,4}$",
            r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$", r"^[0-9]{1,4}/[A-Za-z]{2,}$", r"^[A-Z][A-Za-z0-9_.-]{0,40}:[ ]?", r"^[A-Za-z][A-Za-z0-9_-]*-[A-Za-z0-9_-]+/[0-9]{1,3}$",
            r"^[A-Za-z0-9_.-]+[.][A-Za-z]{1,5}:[0-9]+(:[0-9]*)?$", r"^[A-Za-z]{1,5}:[0-9]+:[0-9]+$", r"^Lines?: ?[0-9]+(-[0-9]+)?$", r"^[0-9]+(-[0-9]+)?(/[0-9]+(-[0-9]+)?)+$", r"^[.]{1,2}/[A-Za-z]{1,2}$",
        ])
        + r" OR (regexp_like(v, r'^[A-Za-z]{2,}/[A-Za-z]{2,}$') AND regexp_like(v, r'[A-Z]'))",
        "anchor_worthy": "instr(v, '/') > 0 OR substring(v, 1, 9) = 'verbatim:' OR "
        + _any("lower(v)", [r"^spool:", r"-spool\b", r"^rail-[0-9a-f]{6,}", rf"^({_IDS})[-_][a-z0-9][a-z0-9_.:-]{{5,}}$", rf"^{_UUID}$"])
        + r" OR regexp_like(v, r'^[A-Za-z_][A-Za-z0-9_.-]{0,40}[=:][^\s]{2,}$')",
        "anchor_value": "CASE WHEN instr(v, '/') > 0 THEN 600 WHEN regexp_like(lower(v), r'^rail-[0-9a-f]{6,}') THEN 580 WHEN substring(v, 1, 9) = 'verbatim:' THEN 560 "
        r"WHEN regexp_like(lower(v), r'(^spool:|tool-result-spool|rebirth-spool|-spool\b)') THEN 540 WHEN regexp_like(lower(v), r'^" + _UUID + r"$') THEN 520 "
        rf"WHEN regexp_like(lower(v), r'^({_IDS})[-_]') THEN 500 WHEN regexp_like(v, r'^[A-Za-z_][A-Za-z0-9_.-]{{0,40}}[=:][^\s]{{2,}}$') THEN 440 ELSE 0 END",
    },
]

#: From (tool, action, category): what a tool is to the engine.
TOOLS = [
    {"low": "lower(coalesce(tool, ''))", "leaf": r"lower(trim(replace_all(replace_all(coalesce(tool, ''), r'^.*(__|[.])', ''), r'^(mcp_to_|mcp_)', '')))", "short_name": r"CASE WHEN regexp_like(tool, r'__[^_]') THEN replace_all(tool, r'^.*__', '') ELSE tool END"},
    {
        "edits": "regexp_like(low, r'(" + "|".join(EDIT_HINTS) + ")')",
        "bookkeeping": "coalesce(" + _among("tool", BOOKKEEPING) + ", FALSE)",
        "recalls": r"regexp_like(coalesce(tool, ''), r'(^|__)fold_recall$')",
        "discovers": "leaf = 'atlas_search' OR (leaf = 'atlas_query' AND coalesce(action, '') IN ('search', 'catalog', 'cluster'))",
        "live_read": "leaf IN ('atlas_lookup', 'atlas_brief', 'atlas_snippet') OR (leaf = 'atlas_query' AND coalesce(action, '') IN ('lookup', 'brief', 'snippet'))",
        "decision_input": "coalesce(short_name, '') = 'tap_star' AND lower(trim(coalesce(category, ''))) = 'decision' AND lower(trim(coalesce(action, 'pin'))) = 'pin'",
    },
    {"boundary_class": r"CASE WHEN low = '' THEN 'gated' WHEN low = 'task_rail' OR regexp_like(low, r'__task_rail$') THEN 'rail_anchor' WHEN edits AND instr(low, 'todowrite') = 0 THEN 'edit' ELSE 'gated' END"},
]

# How the engine's own texts begin.
SYNTHETIC = ("[Conversation Context —", "[Recalled from fold —", "[Fold recall hint —", "[Fold epoch #", "[User Message Vault]", "[Episodic recall —", "[Chronological Provenance v1]")

#: From text: whether it is the engine's own, and whether a person wrote it.
OPERATOR_TEXT = [
    {"t": r"replace_all(coalesce(text, ''), r'^\s+|\s+$', '')"},
    {
        "synthetic": "(" + " OR ".join(f"substring(coalesce(text, ''), 1, {len(p)}) = '{p}'" for p in SYNTHETIC) + ")",
        "genuine": "t <> '' AND NOT "
        + _any("t", [
            r"^\[Chat Room \x22", r"^── .+ in #.+ ──(\n|$)", r"^\[(DIGEST DELTA|Digest Delta|RELAY DIGEST DELTA|Control Signals|System)\]", r"^\[([Ll][Oo][Nn][Gg]-horizon-continue|sidequest-cleanup)\b",
            r"^🏁 Your agent \x22.+\x22 [(].+[)] is done[.]", r"^\[(CONTEXT REBIRTH|INSTANCE RESURRECTED|FIXER MODE BATCH #[0-9]+)\]", r"^\[Chronological Provenance v[0-9]+\]", r"^package_version:\s*[0-9]+\s*\n\[CONTEXT REBIRTH\]",
        ])
        + r" AND NOT (regexp_like(t, r'^@[A-Za-z0-9_]+') AND length(t) < 200)",
        "own_artifact": r"regexp_like(t, r'(\[CONTEXT REBIRTH\]|\[Context band [0-9]+\s+—\s+tail-epoch fold\]|\[Epoch Continuity Capsule\]|artifact=tail-epoch#|\[User Message Vault\]|\[System Note: Context pressure limits)')",
        "interrupt": r"regexp_like(t, r'^(\[Request interrupted by user( for tool use)?\]|(<[^>]+>\s*)+)$')",
        "birth_body": r"CASE WHEN substring(coalesce(text, ''), 1, 12) <> '[birth-fold]' THEN coalesce(text, '') WHEN instr(text, chr(10) || chr(10)) > 0 THEN replace_all(substring(text, instr(text, chr(10) || chr(10)) + 2, 1000000), r'^\s+|\s+$', '') ELSE '' END",
        "head_line": "CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, 1, instr(text, chr(10)) - 1) ELSE text END",
    },
    {"objective": "CASE WHEN t = '' OR own_artifact OR interrupt THEN 'unknown' ELSE 'high' END", "stamp": r"nullif(regexp_extract(birth_body, r'^\[([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2})\] ', 1), '')"},
    {"vault_text": r"CASE WHEN stamp IS NULL THEN birth_body ELSE replace_all(birth_body, r'^\[[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}\] ', '') END"},
]

#: From (claim, origin, source_id): the origin a historical claim is given, and how it is written.
CLAIMS = [
    {"witness": "nullif(trim(coalesce(source_id, '')), '')", "body": "coalesce(claim, '[invalid historical claim]')"},
    {
        "kept_origin": "CASE WHEN origin = 'witnessed' AND witness IS NOT NULL AND claim IS NOT NULL THEN 'witnessed' WHEN origin = 'synthesized' THEN 'synthesized' ELSE 'derived' END",
        "valid": "claim IS NOT NULL AND coalesce(CASE WHEN origin = 'witnessed' THEN witness IS NOT NULL WHEN origin IN ('derived', 'synthesized') THEN source_id IS NULL END, FALSE)",
        "class_origin": "CASE WHEN content_class IN ('raw', 'exact-excerpt') THEN 'witnessed' WHEN content_class IN ('synthesized-history', 'reconstructed-state') THEN 'synthesized' ELSE 'derived' END",
        "boundary": "CASE WHEN lifecycle IS NOT NULL THEN lifecycle WHEN fresh THEN 'fresh_fork' WHEN coalesce(merged, 0) > 0 THEN 'brain_merge' ELSE 'continuation' END",
    },
    {"witnessed": "kept_origin = 'witnessed' AND valid", "rendered": "body || ' [origin=' || kept_origin || CASE WHEN valid THEN '' ELSE ' invalid-origin=untrusted-or-mixed' END || ']'"},
]

_NARRATED = r"^(([Ff]ound|[Ff]ixed|[Cc]onfirmed|[Vv]erified|[Ii]mplemented|[Ll]anded|[Ss]hipped|[Rr]esolved|[Dd]iagnosed|[Rr]oot cause|[Tt]urns out|[Ii]t was|[Cc]aused by|[Nn]o longer|[Tt]ests? pass(ed|ing)?|[Tt]ypecheck (clean|passes)|[Aa]ll [0-9]+ tests)\b|([Dd]one|[Rr]esults?|[Cc]onclusion|[Vv]erdict)\s*[:—–-]|[Tt]he (bug|fix|issue|problem|culprit|root cause)\b)"
_DECISION = r"\b(chose|choosing|selected|selecting|decided|deciding|went with|going with|will use|will keep|approach (is|will be)|rather than|instead of)\b"
_DISCOVERY = r"\b(found|discovered|identified|isolated|key seam|key gap|root cause|evidence (shows|points)|audit (found|shows|revealed)|trace (shows|revealed)|turns out)\b"
_INVESTIGATION = r"\b(audit(ing)?|trac(e|ed|ing)|inspect(ed|ing|ion)?|investigat(e|ed|ing|ion)|compar(e|ed|ing|ison)|map(ped|ping)?|review(ed|ing)?|check(ed|ing)?|narrow(ed|ing)?|verify(ing)?)\b"

#: From line: what a line of prose says of the work.
NARRATION = [
    {"trimmed": r"replace_all(line, r'^\s+|\s+$', '')"},
    {
        "mode": "CASE WHEN substring(trimmed, 1, 1) = '🔍' THEN 'working' WHEN substring(trimmed, 1, 1) = '▶' THEN 'executing' WHEN substring(trimmed, 1, 1) = '🏁' THEN 'verdict' WHEN substring(trimmed, 1, 1) = '⚠' THEN 'hazard' WHEN substring(trimmed, 1, 1) IN ('❓', '❔') THEN 'blocked' END",
        "quoted": "substring(trimmed, 1, 1) IN ('✎', '⭐', '💬', '🗣', '⌖', 'Δ', '↞', '↠')",
        "stripped": r"replace_all(trimmed, r'^[\s#>*\-•·–—0-9.)✓✗✅❌🎯⚠️🏁]+', '')",
    },
    {
        "eligible_glyph": "coalesce(mode, '') NOT IN ('working', 'executing', 'blocked')",
        "kind": "CASE WHEN mode = 'verdict' THEN 'narration:verdict' WHEN mode = 'hazard' THEN 'narration:hazard' ELSE 'narration' END",
        "verdict_shape": f"regexp_like(stripped, r'{_NARRATED}')",
        "sized": "length(stripped) BETWEEN 25 AND 300 AND substring(stripped, length(stripped), 1) <> '?' AND NOT quoted",
    },
    {
        "narrates": "sized AND verdict_shape AND coalesce(mode, '') NOT IN ('working', 'executing', 'blocked')",
        "process": f"CASE WHEN NOT sized OR coalesce(mode, '') IN ('blocked', 'verdict', 'hazard') THEN NULL WHEN regexp_like(lower(stripped), r'{_DECISION}') THEN 'process:decision' "
        f"WHEN regexp_like(lower(stripped), r'{_DISCOVERY}') THEN 'process:discovery' WHEN coalesce(mode, '') = 'working' AND regexp_like(lower(stripped), r'{_INVESTIGATION}') THEN 'process:investigation' END",
        "gotcha": "kind = 'narration:hazard'",
        "validation": r"nullif(CASE WHEN regexp_like(lower(trimmed), r'^(validation|verification)(\s+(passed|state|facts?))?\s*:') THEN replace_all(trimmed, r'^[^:]+:\s*', '') ELSE '' END, '')",
    },
]
