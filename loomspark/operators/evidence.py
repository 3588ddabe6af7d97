"""Relations between messages, evidence, vaults and artifacts: windows and joins that rank, match and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.rules import BOUNDARY

# Words of a claim that match nothing.
CLAIM_STOP = "about after again also because been being done fixed from have into issue problem result that their there these this those through verified with without".split()
# How a line of a result counts as evidence.
SIGNAL = r"\b(?:root cause|because|found|mismatch|expected|actual|failed|failure|error|exception|passed|verified|confirmed)\b"
FILE = r"(?:^|\s)[^\s:]+\.(?:[cm]?[jt]sx?|json|md|py|rs|go|java|kt|swift|sql|sh)(?::\d+)?(?:[:\s]|$)"
GENERIC = r"^(?:ok|done|success|successful|committed|sent|pinned|claimed|released|updated|complete|completed|true|false|\[\])?[.!]?$"
COORDINATES = r"claim|release|chatroom|tap_star|task_rail|atlas_commit"
INVESTIGATES = r"read|open|search|find|grep|rg|query|lookup|inspect|test|typecheck|tsc|vitest|build|lint"


def terms(text: Column) -> Column:
    """The distinct words of three signs or more that a claim and its evidence can share."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9][a-z0-9_-]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*CLAIM_STOP)))


def line_score(line: Column, tool: Column, is_error: Column) -> Column:
    """How strong a line of a tool's result is as evidence; null where it is none."""
    plain = F.trim(F.regexp_replace(line, r"\s+", " "))
    score = (
        F.when(is_error, 80).otherwise(0) + F.when(F.lower(plain).rlike(SIGNAL.replace(r"\b", BOUNDARY)), 35).otherwise(0) + F.when(F.lower(plain).rlike(FILE), 20).otherwise(0)
        + F.when(F.lower(tool).rlike(INVESTIGATES), 12).otherwise(0) - F.when(F.lower(tool).rlike(COORDINATES), 25).otherwise(0) + F.when(F.length(plain) >= 24, 5).otherwise(0)
    )
    return F.when((F.length(plain) >= 4) & ~F.lower(plain).rlike(GENERIC) & (score >= 25), score)


def best_evidence(results: DataFrame) -> DataFrame:
    """The strongest line, the first among equals, of each result (session, pos, tool, is_error, text)."""
    lines = results.select("session", "pos", "tool", "is_error", F.posexplode(F.split("text", "\r?\n")).alias("i", "line"))
    scored = lines.withColumn("score", line_score(F.col("line"), F.col("tool"), F.col("is_error"))).where("score is not null")
    best = scored.groupBy("session", "pos", "tool").agg(F.max(F.struct("score", (-F.col("i")).alias("first"), F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line"))).alias("x"))
    return best.select("session", "pos", "tool", F.col("x.score").cast("long").alias("score"), F.substring("x.line", 1, 120).alias("evidence"))


def claim_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each claim (session, at, text) the earlier evidence (session, pos, score, evidence) that shares most words with it.

    Candidates meet by shared words, not by session alone; ties go to the higher score, then the nearer.
    """
    asked = claims.select("session", "at", F.explode(terms(F.col("text"))).alias("term"))
    held = evidence.select("session", "pos", "score", F.explode(terms(F.concat_ws(" ", "evidence", "tool"))).alias("term"))
    shared = asked.join(held, ["session", "term"]).where("pos <= at").groupBy("session", "at", "pos", "score").agg(F.count(F.lit(1)).alias("overlap"))
    value = F.col("overlap") * 10_000 + F.col("score") * 10 - (F.col("at") - F.col("pos"))
    best = shared.groupBy("session", "at").agg(F.max(F.struct(value.alias("value"), (-F.col("pos")).alias("p"), "overlap")).alias("x"))
    return best.select("session", "at", (-F.col("x.p")).alias("pos"), "x.overlap", "x.value")


def voice_inlays(notes: DataFrame, most: int = 2) -> DataFrame:
    """Annotations (episode, priority, ms or null, text) with the best priority, shown by time, unknown times first."""
    choose = W.partitionBy("episode").orderBy("priority", F.asc_nulls_first("ms"), "text")
    kept = notes.withColumn("n", F.row_number().over(choose)).where(F.col("n") <= most)
    show = W.partitionBy("episode").orderBy(F.asc_nulls_first("ms"), "n")
    return kept.withColumn("place", F.row_number().over(show)).select("episode", "place", "text", "priority")


def current_task(rows: DataFrame) -> DataFrame:
    """Vault rows (session, pos, frontier) from the newest frontier on; all of them where there is none."""
    newest = F.max(F.when(F.col("frontier"), F.col("pos"))).over(W.partitionBy("session"))
    return rows.withColumn("newest", newest).where("newest is null or pos >= newest").drop("newest")


def vault_delta(rows: DataFrame, sealed: DataFrame) -> DataFrame:
    """Vault rows whose fingerprint is not sealed, without those still unanswered."""
    return rows.where("liveness <> 'unanswered'").join(sealed.select("session", "fingerprint").distinct(), ["session", "fingerprint"], "left_anti")


def pairing_safe_start(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked start of a raw tail (session, start), moved back until no call (session, call, result or null) is cut from its result.

    Calls chain: moving back over one may cut another. Spans of calls that overlap are islands, and a
    start inside an island goes to where it begins; a call without a result reaches to the end.
    """
    spans = pairs.select("session", "call", F.coalesce("result", F.lit(1 << 40)).alias("until"))
    w = W.partitionBy("session").orderBy("call", "until")
    reach = F.max("until").over(w.rowsBetween(W.unboundedPreceding, -1))
    opened = spans.withColumn("new", F.when(reach.isNull() | (reach < F.col("call")), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    islands = opened.groupBy("session", "island").agg(F.min("call").alias("begins"), F.max("until").alias("ends"))
    met = asked.join(islands, "session", "left").withColumn("inside", (F.col("begins") < F.col("start")) & (F.col("ends") >= F.col("start")))
    return met.groupBy("session", "start").agg(F.min(F.when(F.col("inside"), F.col("begins"))).alias("moved")).select("session", "start", F.coalesce("moved", "start").alias("safe"))


def route_literals(literals: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each literal (session, literal, source, ms) to one artifact (session, artifact, source_index, ms, text, n).

    The artifact of the same source wins, then one that contains the literal, then the nearest in time,
    then the first.
    """
    a = artifacts.select("session", "artifact", "source_index", F.col("ms").alias("a_ms"), F.col("text").alias("a_text"), "n")
    both = literals.join(a, "session")
    rank = F.when(F.col("source") == F.col("source_index"), 0).when(F.col("a_text").contains(F.col("literal")), 1).when(F.col("ms").isNotNull() & F.col("a_ms").isNotNull(), 2).otherwise(3)
    key = F.struct(rank.alias("rank"), F.when(rank == 2, F.abs(F.col("ms") - F.col("a_ms"))).otherwise(0).alias("distance"), "n", "artifact")
    return both.groupBy("session", "literal").agg(F.min(key).alias("x")).select("session", "literal", "x.artifact", F.element_at(F.array(F.lit("structural"), F.lit("contained"), F.lit("nearest"), F.lit("first")), F.col("x.rank") + 1).alias("why"))


def peer_disposition(episodes: DataFrame, checks: DataFrame) -> DataFrame:
    """Evidence of peers (id, observed, current): verified by a check of the same source and revisions, stale, or unverified."""
    keys = checks.where("method in ('read', 'test', 'review') and verified_ms is not null").select("id", F.col("source_revision").alias("observed"), F.col("local_revision").alias("current")).distinct()
    known = episodes.join(keys.withColumn("met", F.lit(True)), ["id", "observed", "current"], "left")
    return known.select("id", F.when(F.col("met"), "verified").when(F.col("observed") != F.col("current"), "stale-revision").otherwise("unverified").alias("disposition"))


def prefetch(caches: DataFrame, touches: DataFrame) -> DataFrame:
    """Prefetched cards (session, made_ms, ttl_ms, paths): spent by the first predicted path that is touched in time."""
    paths = caches.select("session", "made_ms", "ttl_ms", F.explode("paths").alias("path")).distinct()
    hits = touches.join(paths, ["session", "path"]).where("ms >= made_ms")
    first = hits.groupBy("session").agg(F.min(F.struct("ms", "pos", "path")).alias("x"))
    out = caches.join(first, "session", "left")
    late = F.col("x.ms") - F.col("made_ms") > F.col("ttl_ms")
    return out.select("session", F.when(F.col("x").isNull(), "waiting").when(late, "expired").otherwise("promoted").alias("state"), F.when(~late, F.col("x.path")).alias("path"))


def order_zone(paths: DataFrame, affinity: DataFrame | None = None) -> DataFrame:
    """Paths of a zone (anchor, path, n): the anchor, then by affinity where it is known, then by shared leading folders."""
    folders = lambda c: F.slice(F.split(c, "/"), 1, F.size(F.split(c, "/")) - 1)
    same = F.zip_with(folders(F.col("anchor")), folders(F.col("path")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))["n"]
    near = paths.withColumn("shared", F.when(F.col("path") == F.col("anchor"), 1 << 20).otherwise(shared))
    near = near.withColumn("proximity", F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("shared"), "n")))
    score = F.lit(0.0)
    if affinity is not None:
        near = near.join(affinity.select(F.col("a").alias("anchor"), F.col("b").alias("path"), "score"), ["anchor", "path"], "left")
        score = F.when(F.col("path") == F.col("anchor"), float(1 << 20)).otherwise(F.coalesce("score", F.lit(-1.0)))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("anchor").orderBy(score.desc(), "proximity"))).select("anchor", "path", "rank")


def evictable(turns: DataFrame, cursors: DataFrame, frontiers: DataFrame) -> DataFrame:
    """How many oldest turns may go: those wholly before the durable cursor, and folded two epochs ago at least."""
    w = W.partitionBy("session").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    below = turns.join(cursors, "session").withColumn("all_below", F.bool_and(F.col("stop") <= F.col("cursor")).over(w))
    cursor = below.groupBy("session").agg(F.count_if("all_below").alias("by_cursor"))
    age = frontiers.where("epoch <= upcoming - 2").groupBy("session").agg(F.max("folded").alias("by_age"))
    return cursor.join(age, "session", "left").select("session", F.least(F.col("by_cursor"), F.greatest(F.coalesce("by_age", F.lit(0)), F.lit(0))).alias("evictable"))


def settled(bursts: DataFrame, ends: DataFrame, gap_events: int = 25, gap_ms: int = 1_200_000) -> DataFrame:
    """Whether each session's last burst (session, last_pos, last_ms) is over at its end (session, n, now_ms, seal_pos)."""
    last = bursts.groupBy("session").agg(F.max(F.struct("last_pos", "last_ms")).alias("x"))
    sealed = F.coalesce((F.col("seal_pos") > F.col("x.last_pos")) & (F.col("seal_pos") < F.col("n")), F.lit(False))
    return last.join(ends, "session").select("session", (sealed | (F.col("n") - F.col("x.last_pos") > gap_events) | F.coalesce(F.col("now_ms") - F.col("x.last_ms") > gap_ms, F.lit(False))).alias("settled"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common start of two texts: a binary search over prefixes of up to 2**20 signs."""
    fits = lambda n: (n <= F.length(a)) & (n <= F.length(b)) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.aggregate(F.array(*(F.lit(1 << bit) for bit in reversed(range(20)))), F.lit(0), lambda n, bit: F.when(fits(n + bit), n + bit).otherwise(n))
