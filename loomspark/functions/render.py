"""Lines and cards as column expressions; formats that others parse are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import clock

# Prefixes and kinds of lines that others recognise.
EPOCH_STAMP = "[Fold epoch #"
TOMBSTONE = "[Paged to episodic store — "
RECORD = "[H1:"
RECORD_KINDS = ("fold-turn", "fold-artifact", "fold-closet", "rebirth-section", "vault-row")
LANE_ICONS = (("read", "📖"), ("search", "🔍"), ("navigation", "🧭"), ("orchestration", "⚙️"))
ORIGIN = r"(?i)\[(?=\s*origin\s*=)"


def clipped_end(text: Column, most: int) -> Column:
    """The text, or its first characters and an ellipsis, ``most`` in all."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(max(0, most - 1))), F.lit("…")))


def epoch_stamp(epoch: Column, detail: Column) -> Column:
    return F.concat(F.lit(EPOCH_STAMP), epoch.cast("string"), F.lit(" — "), F.left(detail, F.lit(120)), F.lit("]"))


def tombstone(first_iso: Column, last_iso: Column, turns: Column) -> Column:
    """One line for evicted turns: the range of days and their number."""
    a, b = F.left(first_iso, F.lit(10)), F.left(last_iso, F.lit(10))
    days = F.when(a == b, a).otherwise(F.concat(a, F.lit("→"), b))
    return F.concat(F.lit(TOMBSTONE), days, F.lit(", "), turns.cast("string"), F.lit(" turns; recallable by touching member paths]"))


def quoted(text: Column) -> Column:
    """The text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("t")))
    return F.when(text.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def record(kind: str, text: Column) -> Column:
    """Historical text as one line of data: its kind and a JSON string without line separators."""
    safe = F.replace(F.replace(quoted(text), F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))
    return F.concat(F.lit(f"{RECORD}{kind}] "), safe)


def read_record(line: Column) -> tuple[Column, Column]:
    """Kind and text of a record line; both null for anything else."""
    kind = F.regexp_extract(line, r"^\[H1:([a-z-]+)\] ", 1)
    body = F.regexp_replace(line, r"^\[H1:[a-z-]+\] ", "")
    text = F.try_variant_get(F.try_parse_json(body), "$", "string")
    good = line.startswith(RECORD) & kind.isin(*RECORD_KINDS) & body.startswith('"') & text.isNotNull()
    return F.when(good, kind), F.when(good, text)


def episode_card(ident: Column, closed_by: Column, ended: Column, summary: Column, paths: Column) -> Column:
    """Three lines: what it is, its summary, the paths that matched."""
    return F.concat(F.lit("[Recalled episode "), ident, F.lit(" — "), closed_by, F.lit(", "), ended, F.lit("]\nSummary: "), summary, F.lit("\nMatched paths: "), F.array_join(paths, ", "))


def lane_line(lane: Column, n: Column, paths: Column, left_out: Column, first_ms: Column, source: Column) -> Column:
    """One line for a run of look-ups: time, icon, label, count, the paths shown and how many are not."""
    icon, label = F.when(F.lit(False), ""), F.when(lane == "read", "reads").when(lane == "search", "searches").otherwise(lane)
    for name, sign in LANE_ICONS:
        icon = icon.when(lane == name, sign)
    shown = F.when(F.size(paths) > 0, F.concat(F.lit(" — paths: "), F.array_join(paths, ", "), F.when(left_out > 0, F.concat(F.lit(" (+"), left_out.cast("string"), F.lit(" more)"))).otherwise(""))).otherwise("")
    at = F.coalesce(clock(F.timestamp_millis(first_ms)), F.lit("[time unknown]"))
    return F.concat(at, F.lit(" "), icon.otherwise("🔧"), F.lit(" "), label, F.lit(" ×"), n.cast("string"), shown, F.lit(" ↞ source="), F.coalesce(source, F.lit("unknown")))


def claim_line(time_ms: Column, operation: Column, state: Column, outcome: Column, again: Column, subject: Column, holder: Column, ident: Column) -> Column:
    """One line of a claim's life; a claim that needs reconciling says so first."""
    at = F.coalesce(clock(F.timestamp_millis(time_ms)), F.lit("[time unknown]"))
    need = F.when(again, "⚠️ RECONCILIATION REQUIRED · ").otherwise("")
    return F.concat(at, F.lit(" "), need, F.lit("CLAIM operation="), operation, F.lit(" state="), state, F.lit(" outcome="), outcome, F.lit(" reconciliation-required="), again.cast("string"), F.lit(" subject="), quoted(subject), F.lit(' range="whole-file" holder='), quoted(F.coalesce(holder, F.lit("unknown"))), F.lit(" claim-id="), quoted(ident), F.lit(" ↞ source=unknown"))


def escaped_claim(text: Column) -> Column:
    """Text in which no bracket can pass for an origin mark; reversible by ``unescaped_claim``."""
    slashes = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.when(text.rlike(ORIGIN), F.regexp_replace(slashes, ORIGIN, r"\\u005b")).otherwise(text)


def unescaped_claim(text: Column) -> Column:
    """The text before ``escaped_claim`` escaped it."""
    held = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    return F.replace(F.replace(held, F.lit("\\u005b"), F.lit("[")), F.lit("\x00"), F.lit("\\"))


def correlation_id(boundary: Column, episode: Column, exposure: Column, kind: Column, path: Column) -> Column:
    source = F.concat_ws("\x00", F.coalesce(F.trim(exposure), F.lit("")), kind, path)
    return F.concat(F.lit("fru:"), boundary.cast("string"), F.lit(":"), episode.cast("string"), F.lit(":"), F.replace(F.url_encode(source), F.lit("+"), F.lit("%20")))


def episode_date(iso: Column) -> Column:
    """Day and minute, or a word where the time is not known."""
    minute = F.concat(F.left(iso, F.lit(10)), F.lit(" "), F.substring(iso, 12, 5))
    return F.when(iso.isNull() | (iso == "unknown"), "time unknown").when((F.length(iso) >= 16) & (F.substring(iso, 11, 1) == "T"), minute).otherwise(F.left(iso, F.lit(16)))
