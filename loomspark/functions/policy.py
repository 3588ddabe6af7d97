"""Budget and policy arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of a context window at which utilisation changes its level.
WARNING, CRITICAL, AUTO_COMPACT = 0.75, 0.88, 0.93
#: Largest span of a hot cache in milliseconds, and the largest tail in characters.
TTL_MS, MAX_TAIL = 300_000, 150_000
#: Value ledger of zones: half-life in boundaries, saturations, and the neutral value.
HALF_LIFE, FREQUENT, DEEP = 6, 5, 4


def round_half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity, negatives too."""
    return F.floor(x + 0.5)


def utilisation_level(used: Column, window: Column) -> Column:
    """The level of a share of the window; healthy where there is no window."""
    share = used / F.when(window > 0, window)
    return F.when(share >= AUTO_COMPACT, "auto_compact").when(share >= CRITICAL, "critical").when(share >= WARNING, "warning").otherwise("healthy")


def pressure_budget(chars: Column, level: Column, least: int = 800) -> Column:
    """All, a half, a quarter, or a quarter up to ``least`` characters as pressure rises."""
    quarter = F.floor(chars / 4)
    return F.when(level == "healthy", chars).when(level == "warning", F.floor(chars / 2)).when(level == "critical", quarter).otherwise(F.least(F.lit(least), quarter))


def turns_to_fold(chars: Column, turns: Column, window: int, soft: int, hard: int, most_turns: int) -> Column:
    """How many of the oldest turns to fold: a share by size, the excess by count, or none."""
    free = turns - window
    by_count = F.when(turns > most_turns, F.least(free, turns - most_turns + window)).otherwise(0)
    sized = F.when(chars >= hard, F.greatest(F.ceil(free * 0.6), F.lit(1))).when(chars >= soft, F.greatest(F.ceil(free * 0.3), F.lit(1))).otherwise(by_count)
    return F.when(turns <= window, 0).otherwise(sized).cast("long")


def freeze_decision(has_view: Column, gap_ms: Column, mode_changed: Column, new_claim: Column, tail_chars: Column) -> Column:
    """Why a frozen view must be computed anew, or that it can be used again; a gap of exactly the limit is hot."""
    return (
        F.when(~has_view, "first-call").when(gap_ms > TTL_MS, "cold-gap").when(mode_changed | new_claim, "context-changed")
        .when(tail_chars > MAX_TAIL, "tail-epoch").otherwise("reuse")
    )


def append_band(measured: Column, floor: Column, target: Column) -> Column:
    """Tokens to keep after an append: 18 % above the floor, at least the target and at most 25,000."""
    return F.least(F.lit(25_000), F.greatest(target, round_half_up((measured - floor) * 0.18)))


def zone_value(age: Column, visits: Column, depth: Column, anchor: Column, claimed: Column) -> Column:
    """Mean of recency, frequency, depth and anchor in [0, 1], a quarter more when claimed."""
    parts = F.pow(F.lit(0.5), age / HALF_LIFE) + F.least(visits / FREQUENT, F.lit(1.0)) + F.least(depth / DEEP, F.lit(1.0)) + anchor
    return F.least(F.lit(1.0), parts / 4 + F.when(claimed, 0.25).otherwise(0.0))


def zone_ttl(value: Column, base: int = 8) -> Column:
    """Boundaries to live: half the base at value 0, the base at one half, twice at 1."""
    factor = F.when(value <= 0.5, 0.5 + value).otherwise(2 * value)
    return F.greatest(F.lit(1), round_half_up(factor * base))


def repeat_ratio(shown: Column) -> Column:
    """Share of its budget that a card gets when shown again."""
    return F.greatest(F.lit(0.35), F.pow(F.lit(0.6), shown))


def utility_factor(utility: Column) -> Column:
    """0.75 to 1.25 by utility clamped to [0, 1]; 1 when not measured."""
    return F.when(utility.isNull(), 1.0).otherwise(0.75 + 0.5 * F.least(F.greatest(utility, F.lit(0.0)), F.lit(1.0)))


def input_cost(fresh: Column, cached: Column, fresh_price: float, cached_price: float) -> Column:
    """Cost of tokens at prices a million."""
    return fresh / 1e6 * fresh_price + cached / 1e6 * cached_price
