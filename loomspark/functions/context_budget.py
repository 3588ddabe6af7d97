"""Token budgets of a context window and the decisions taken against them, as rules over columns.

Inputs that may be absent are null; a token count that is null or not positive counts as not measured.
"""

from __future__ import annotations

# Windows that stand for an engine when neither the model nor the caller gives one.
ENGINE_WINDOWS = {
    "claude": 200_000, "claude-cli": 1_000_000, "claude-interactive": 1_000_000, "codex": 258_000, "gemini": 1_048_576,
    "minimax": 512_000, "mistral": 128_000, "grok": 1_000_000, "openai": 400_000, "glm": 200_000, "deepseek": 1_000_000,
    "kimi": 256_000, "qwen": 1_000_000, "inkling": 512_000, "codex-api": 1_048_576, "gemini-api": 1_048_576,
}
#: Where pressure starts for engines that differ from the common ceiling.
ENGINE_CEILINGS = {"codex": 220_000, "claude-cli": 220_000, "claude-interactive": 220_000}
CEILING, TRIGGER, BAND, APPEND_BAND = 180_000, 150_000, 40_000, 5_000
RUNWAY, LEAST_RUNWAY, CLI_RUNWAY, LEAST_TAIL = 10_000, 30_000, 20_000, 4_000
WINDOW = 200_000


def _case(column: str, values: dict[str, int], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {otherwise} END"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def _clamped(fraction: str, low: int, high: int) -> str:
    return f"greatest({low}, least({high}, {half_up(f'win * {fraction}')}))"


#: From (engine, known_model, asked_window, single) to the geometry of a window. ``known_model`` says whether the
#: model's name is of a known family; ``asked_window`` is the window that the caller or the model table gives.
GEOMETRY = [
    {"eng": "lower(trim(coalesce(engine, '')))"},
    {"engine_window": _case("eng", ENGINE_WINDOWS, "NULL"), "given": "CASE WHEN asked_window > 0 THEN asked_window END"},
    {
        "win": f"CAST(coalesce(given, engine_window, {WINDOW}) AS BIGINT)",
        "limit_source": "CASE WHEN given IS NOT NULL THEN 'explicit-override' WHEN known_model THEN 'model-or-engine-table' WHEN engine_window IS NOT NULL THEN 'engine-default' ELSE 'conservative-fallback' END",
    },
    {
        "tier": "CASE WHEN limit_source = 'conservative-fallback' THEN 'unknown-conservative' WHEN win <= 128000 THEN 'tiny-window' WHEN win <= 258000 THEN 'small-200k' "
        "WHEN win <= 512000 THEN 'mid-400k' WHEN win <= 1048576 THEN 'large-1m' ELSE 'huge-2m' END",
        "output_reserve": "CASE WHEN win <= 128000 THEN 8000 WHEN win <= 258000 THEN 16000 WHEN win <= 512000 THEN 32000 ELSE 64000 END",
        "tools_reserve": _clamped("0.08", 8_000, 37_000),
        "margin": _clamped("CASE WHEN win <= 258000 THEN 0.02 ELSE 0.03 END", 4_000, 48_000),
    },
    {
        "profile": "CASE WHEN tier IN ('tiny-window', 'small-200k', 'unknown-conservative') THEN 'survival' WHEN tier = 'mid-400k' THEN 'balanced' WHEN tier = 'large-1m' THEN 'cache-economic' ELSE 'wide-cache-economic' END",
        "message_ceiling": "greatest(1, win - output_reserve - margin)",
    },
    {
        "band": f"least({BAND}, {half_up('win * 0.6')}, message_ceiling)",
        "pressure": f"least({half_up('win * 0.9')}, message_ceiling, {_case('eng', ENGINE_CEILINGS, str(CEILING))})",
        "saturation": f"least({half_up('win * 0.9')}, message_ceiling)",
        "least_runway": f"CASE WHEN single THEN {LEAST_RUNWAY} ELSE {RUNWAY} END",
    },
    {
        "asked_trigger": f"CASE WHEN eng = 'codex' THEN least({TRIGGER}, greatest(1, message_ceiling - {LEAST_RUNWAY}), {half_up('win * 0.9')}) ELSE {TRIGGER} END",
        "pressure_margin": f"greatest(0, pressure - tools_reserve - band - {RUNWAY})",
    },
    {
        "fold_trigger": "CASE WHEN single THEN greatest(1, pressure) ELSE least(greatest(asked_trigger, band), greatest(1, pressure - least_runway)) END",
        "tail_cap": f"least(greatest(1, CASE WHEN single THEN pressure ELSE greatest({LEAST_TAIL}, pressure - tools_reserve - band - pressure_margin) END), greatest(1, message_ceiling - band))",
        "batch_chars": f"greatest(1, {half_up('greatest(1, message_ceiling - band - tools_reserve) * 4.0')})",
    },
    {
        "tool_result_cap": f"least(band * 4, greatest(least({half_up('win * 4 * 0.15')}, batch_chars), {half_up('batch_chars * 0.8')}))",
        "eviction": "CASE WHEN profile = 'survival' THEN 'hard-epoch-only' ELSE 'hard-epoch-on-prefix-saturation' END",
        "cli_target": f"least(fold_trigger, greatest(1, message_ceiling - {CLI_RUNWAY}))",
        "hard_epoch": "CASE WHEN profile = 'survival' THEN pressure ELSE greatest(saturation, pressure) END",
        "full_chars": half_up("band * 4 * 0.125"),
        "essence_chars": half_up("band * 4 * 0.25"),
        "evict_chars": half_up("band * 4 * 0.055"),
        "boundary_chars": half_up("band * 4 * 0.005"),
        "cold_closet_chars": f"least(4000, greatest(1000, {half_up('band * 4 * 0.05')}))",
    },
]

#: From (measured, ceiling, floor_tokens, trigger, appends, tail_asked, append_on, single, forced, append_target,
#: least_runway) to what a boundary does and why. The first append after a hard epoch always goes through.
ELIGIBILITY = [
    {
        "m": "CASE WHEN measured > 0 THEN CAST(floor(measured) AS BIGINT) END",
        "c": "CASE WHEN ceiling > 0 THEN CAST(floor(ceiling) AS BIGINT) END",
        "f": "CASE WHEN floor_tokens > 0 THEN CAST(floor(floor_tokens) AS BIGINT) END",
        "t": "CASE WHEN trigger > 0 THEN CAST(floor(trigger) AS BIGINT) END",
        "armed": "coalesce(appends, 0) >= 1",
        "least_band": "greatest(1, CAST(floor(append_target) AS BIGINT))",
    },
    {
        "pressed": "c IS NOT NULL AND m IS NOT NULL AND m >= c",
        "projected": f"least(25000, greatest(least_band, {half_up('(m - CASE WHEN f IS NULL OR m <= f THEN 0 ELSE f END) * 0.18')}))",
    },
    {
        "stage": "CASE WHEN m IS NULL THEN 'unmeasured' WHEN c IS NULL THEN 'no-ceiling' WHEN single AND NOT pressed THEN 'below' WHEN NOT single AND forced THEN 'forced' "
        "WHEN NOT single AND pressed THEN 'pressed' WHEN NOT (tail_asked AND append_on) THEN 'no-append' "
        "WHEN single AND f IS NOT NULL AND armed THEN 'single-floor' WHEN single THEN 'single-first' WHEN f IS NOT NULL AND t IS NOT NULL AND armed THEN 'floor' ELSE 'runway' END",
    },
    {
        "runway": "CASE stage WHEN 'unmeasured' THEN NULL WHEN 'no-ceiling' THEN NULL WHEN 'single-floor' THEN c - (f + projected) WHEN 'floor' THEN t - f ELSE c - m END",
    },
    {
        "holds": "CASE stage WHEN 'unmeasured' THEN NULL WHEN 'forced' THEN FALSE WHEN 'pressed' THEN FALSE WHEN 'no-append' THEN NOT (single AND pressed) "
        "WHEN 'single-floor' THEN runway >= least_runway WHEN 'floor' THEN runway > 0 WHEN 'runway' THEN runway >= least_runway ELSE TRUE END",
        "basis": "CASE WHEN stage = 'unmeasured' THEN 'unknown' WHEN stage = 'no-ceiling' THEN 'disabled' WHEN stage IN ('single-floor', 'floor') THEN 'floor' ELSE 'measured' END",
        "band_tokens": "CASE WHEN stage = 'single-floor' THEN projected END",
    },
    {
        "decision": "CASE WHEN stage = 'unmeasured' THEN 'unknown' WHEN stage = 'no-ceiling' THEN CASE WHEN tail_asked AND append_on THEN 'append' ELSE 'reuse' END WHEN stage = 'below' THEN 'reuse' "
        "WHEN stage IN ('forced', 'pressed') THEN 'hard-epoch' WHEN stage = 'no-append' THEN CASE WHEN single AND pressed THEN 'hard-epoch' ELSE 'reuse' END WHEN holds THEN 'append' ELSE 'hard-epoch' END",
        "reason": "CASE WHEN stage = 'unmeasured' THEN 'telemetry-unavailable' WHEN stage = 'no-ceiling' THEN CASE WHEN tail_asked AND append_on THEN 'pressure-disabled' ELSE 'no-tail-epoch' END "
        "WHEN stage = 'below' THEN 'below-single-ceiling' WHEN stage = 'forced' THEN 'governor-pressure' WHEN stage = 'pressed' THEN 'pressure-ceiling' "
        "WHEN stage = 'no-append' THEN CASE WHEN append_on THEN 'no-tail-epoch' ELSE 'append-disabled' END WHEN holds THEN 'runway-holds' ELSE 'runway-exhausted' END",
    },
]

#: From (raw_chars, asked_window, usage, last_usage, step, target) to the caps of a seed and whether a session of a
#: command-line engine is due for reconstruction. ``raw_chars`` is the text of a setting; 600,000 stands for a bad one.
RECONSTRUCTION = [
    {"parsed": r"regexp_extract(coalesce(raw_chars, ''), r'^\s*([+]?[0-9]{1,9})', 1)"},
    {"configured": "CASE WHEN parsed = '' THEN 600000 WHEN CAST(replace(parsed, '+', '') AS BIGINT) > 0 THEN CAST(replace(parsed, '+', '') AS BIGINT) ELSE 600000 END"},
    {"fit": half_up("asked_window * 0.15 * 4")},
    {
        "birth_cap": "CASE WHEN coalesce(asked_window, 0) <= 0 THEN configured ELSE greatest(least(configured, 40000), least(configured, fit)) END",
        "seed_cap": "CASE WHEN coalesce(asked_window, 0) <= 0 THEN configured ELSE greatest(40000, least(configured, fit)) END",
        "due_at": "CASE WHEN target > 0 THEN least(target, asked_window * 0.7) ELSE asked_window * 0.7 END",
    },
    {
        "due": "coalesce(usage > 0 AND asked_window > 0 AND usage >= 8000 AND usage >= due_at AND (last_usage IS NULL OR usage - last_usage >= step), FALSE)",
        "policy_trigger": f"CASE WHEN asked_window > 0 THEN least(target, {half_up('asked_window * 0.7')}) ELSE target END",
    },
    {
        "mode": "CASE WHEN lower(flag) IN ('off', 'false') THEN 'off' WHEN lower(flag) = 'dry-run' THEN 'dry-run' ELSE 'on' END",
        "measured_due": "usage IS NOT NULL AND usage >= policy_trigger",
    },
    {"should_fold": "mode <> 'off' AND measured_due"},
]

#: From (ratio, measured, trigger, least_runway, transition, target_kind, hard) to guards of sealed text.
GUARDS = [
    {
        "disposition": "CASE WHEN transition IS NULL THEN 'unknown' WHEN transition IN ('hot-reuse', 'append-tail-epoch') THEN 'preserved' ELSE 'replaced' END",
        "alarm": "coalesce(ratio > 0.6, FALSE)",
        "unshrunk": "coalesce(ratio > 0.9, FALSE)",
        "low_yield": "coalesce(ratio > 0.7 AND measured > 0 AND trigger > 0 AND CASE WHEN least_runway > 0 THEN trigger - measured < least_runway ELSE measured >= trigger END, FALSE)",
        "stratum": "CASE WHEN target_kind IN ('band-append', 'raw-tail-append', 'recall-card-injection', 'transient-render') THEN 'overlay' ELSE 'frozen-stratum' END",
    },
    {"allowed": "stratum = 'overlay' OR hard"},
    {"violation": "CASE WHEN NOT allowed THEN 'frozen-stratum write rejected: ''' || target_kind || ''' may only be replaced during a hard-epoch materialization' END"},
]

#: From (passes, window_turns, recency_turns, total_chars, card_chars) to the rules of recall that do not hold.
RECALL_GEOMETRY = [
    {
        "dead_zone": "passes - window_turns > 5",
        "below_window": "recency_turns < window_turns",
        "card_body": "least(card_chars, least(800, total_chars) - 200)",
    },
    {"card_too_small": "card_body < 400"},
]

#: From (flag, number_text, fraction_text) to settings: on unless switched off, off unless switched on, bounded numbers.
SETTINGS = [
    {"low": "lower(trim(coalesce(flag, '')))", "digits": r"regexp_extract(trim(coalesce(number_text, '')), r'^[+]?([0-9]{1,9})', 1)", "part": r"regexp_extract(trim(coalesce(fraction_text, '')), r'^[0-9]{1,6}([.][0-9]{1,9})?', 0)"},
    {"default_on": "low NOT IN ('0', 'false', 'off', 'no')", "default_off": "low IN ('1', 'true', 'on', 'yes')", "number": "CASE WHEN digits <> '' THEN CAST(digits AS BIGINT) END", "fraction": "CASE WHEN part <> '' THEN CAST(part AS DOUBLE) END"},
    {"positive": "CASE WHEN number > 0 THEN number END", "unit": "CASE WHEN fraction > 0 AND fraction <= 1 THEN fraction END"},
]

#: From (distance, behavioural, event_kind, used, win, per_turn, chars, level, ttl) to small scores and budgets.
SCORES = [
    {"booster": "CAST(CASE WHEN distance IS NULL THEN 0 ELSE greatest(0, 1 - CAST(distance AS DOUBLE) / 6) END AS DOUBLE)"},
    {
        "blended": "greatest(behavioural, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), behavioural * CAST(0.7 AS DOUBLE) + booster * CAST(0.3 AS DOUBLE))))",
        "event_weight": "CAST(CASE WHEN event_kind IN ('path_edited', 'verbatim_reused') THEN 1.0 WHEN event_kind = 'term_echo' THEN 0.5 END AS DOUBLE)",
        "turns_left": "CASE WHEN win <= 0 OR per_turn <= 0 THEN NULL WHEN win - used <= 0 THEN 0 ELSE CAST(floor((win - used) / per_turn) AS BIGINT) END",
        "auction_chars": "CASE level WHEN 'healthy' THEN chars WHEN 'warning' THEN CAST(floor(chars / 2) AS BIGINT) WHEN 'critical' THEN CAST(floor(chars / 4) AS BIGINT) ELSE least(800, CAST(floor(chars / 4) AS BIGINT)) END",
        "beta_header": "CASE WHEN ttl = '1h' THEN 'extended-cache-ttl-2025-04-11' END",
    },
]
