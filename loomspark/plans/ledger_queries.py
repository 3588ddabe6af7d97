"""Drafts, seals, snapshots, provider shapes and resident zones over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import rules
from loomspark.operators import drafts, rails, seals, zones
from loomspark.plans.rule_queries import _pick
from loomspark.sources import providers
from loomspark.sources.bindings import TOUCHES_SQL, messages, table, touches
from loomspark.streaming import replay


def _draft_events(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    line = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    lines = line.groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("s"), n.cast("string"))), ",").alias("names"),
        F.bool_or((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")).alias("drop_first"))
    rows = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none, text = F.lit(None), F.lit(None).cast("string")

    def event(pos: int, op: str, steps=text, statuses=text, actor=text, live=none, when=None):
        e = F.struct(F.lit(pos).cast("long").alias("pos"), F.lit(op).alias("op"), steps.alias("steps"), statuses.alias("statuses"), actor.alias("actor"), live.cast("long").alias("live"), F.lit("r").alias("rail"), F.lit(False).alias("force"), F.lit(None).cast("int").alias("at"))
        return e if when is None else F.when(when, e)

    merger = F.when(F.col("o_orderkey") % 4 == 0, "other").when(F.col("o_orderkey") % 4 == 1, "user").otherwise("owner")
    events = F.array(
        event(0, "create", actor=F.lit("owner"), live=F.col("o_custkey") % 3), event(1, "append", F.col("names")), event(2, "remove", F.lit("s1"), when=F.col("drop_first")),
        event(3, "merge", actor=merger, live=F.col("o_orderkey") % 3), event(4, "batch", F.lit("s2"), F.lit("done"), when=F.col("o_custkey") % 5 == 0), event(5, "abandon", when=F.col("o_custkey") % 7 == 0))
    return rows.select(F.col("o_orderkey").cast("string").alias("draft"), F.explode(F.array_compact(events)).alias("e")).select("draft", "e.*")


def draft_outcomes(spark: SparkSession, d: str) -> DataFrame:
    told = replay.replay(_draft_events(spark, d), "draft", "pos", drafts.draft_step, drafts.DRAFT)
    last = told.groupBy("draft").agg(F.max_by(F.struct("state", "revision", "steps", "reason"), "pos").alias("x"))
    return last.select("draft", "x.state", F.col("x.revision").cast("long").alias("revision"), "x.steps", "x.reason")


DRAFT_SQL = """WITH l AS (SELECT l_orderkey, list('s' || l_linenumber::VARCHAR ORDER BY l_linenumber) AS names, bool_or(l_linenumber = 1 AND l_returnflag = 'R') AS dropped FROM lineitem GROUP BY l_orderkey),
a AS (SELECT o_orderkey, o_custkey, coalesce(names, []) AS names, coalesce(dropped, FALSE) AS dropped, o_orderkey % 4 <> 0 AS may, o_orderkey % 3 AS live, o_custkey % 3 AS base FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
b AS (SELECT *, CASE WHEN dropped THEN names[2:] ELSE names END AS left_names, 1 + (len(names) > 0)::INT + dropped::INT + may::INT AS r3, CASE WHEN NOT may THEN 'open' WHEN live <> base THEN 'conflicted' ELSE 'merged' END AS s3 FROM a),
c AS (SELECT *, o_custkey % 5 = 0 AND s3 <> 'merged' AND list_contains(left_names, 's2') AS done FROM b),
d AS (SELECT *, CASE WHEN done THEN 'open' ELSE s3 END AS s4 FROM c),
e AS (SELECT *, o_custkey % 7 = 0 AND s4 <> 'merged' AS gone FROM d)
SELECT o_orderkey::VARCHAR AS draft, CASE WHEN gone THEN 'abandoned' ELSE s4 END AS state, (r3 + done::INT + gone::INT)::BIGINT AS revision,
array_to_string(list_transform(left_names, lambda x, i: x || CASE WHEN done AND i = list_position(left_names, 's2') THEN ':done' ELSE ':pending' END), ',') AS steps,
CASE WHEN s4 = 'conflicted' THEN 'Live rail revision moved from ' || base::VARCHAR || ' to ' || live::VARCHAR || '.' END AS reason FROM e"""


def _templates(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return rails.template(line.selectExpr("l_orderkey AS rail", "l_linenumber AS n", "concat('s', l_linenumber) AS id", "concat('title ', l_returnflag) AS title"))


def rail_template_index(spark: SparkSession, d: str) -> DataFrame:
    return drafts.template_index(_templates(spark, d))


def rail_template_seeds(spark: SparkSession, d: str) -> DataFrame:
    return drafts.template_seeds(_templates(spark, d))


TEMPLATE_SQL = """SELECT l_orderkey AS rail, '[' || string_agg('{"id":"s' || l_linenumber || '","title":"title ' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_returnflag) || ']' AS template, count(*) AS n FROM lineitem GROUP BY l_orderkey"""


def draft_merges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    asked = o.select(F.col("o_orderkey").alias("draft"), F.col("o_custkey").alias("rail"), (F.col("o_orderkey") % 3).alias("base"))
    live = table(spark, d, "customer", "c_custkey").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("rail"), (F.col("c_custkey") % 3).alias("revision"))
    return rails.merge_conflicts(asked, live)


MERGES_SQL = """SELECT o_orderkey AS draft, o_custkey AS rail, o_orderkey % 3 AS base, c_custkey % 3 AS revision, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_custkey % 3 = o_orderkey % 3 THEN 'mergeable' ELSE 'conflicted' END AS state
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey"""


# seals
def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """One row a conversation: the text of its first half, the rest raw, and the rest folded to line heads."""
    m = messages(spark, d)
    half = m.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).alias("cut"), F.count(F.lit(1)).alias("n"))
    rows = m.join(half, "conv_id").groupBy("conv_id", "cut", "n").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("all"))
    part = lambda keep, shown: F.array_join(F.transform(F.filter("all", keep), shown), "\n")
    old, new = (lambda x: x["turn"] <= F.col("cut")), (lambda x: x["turn"] > F.col("cut"))
    cid = F.col("conv_id")
    return rows.select(
        "conv_id", F.when(cid % 7 != 0, part(old, lambda x: x["text"])).alias("view"), F.size(F.filter("all", old)).cast("long").alias("raw_count"), F.when(cid % 11 == 0, F.lit(0)).otherwise(F.col("n")).alias("history_count"),
        part(new, lambda x: x["text"]).alias("raw_tail"), F.when(cid % 5 == 0, part(new, lambda x: x["text"])).otherwise(part(new, lambda x: F.substring(x["text"], 1, 60))).alias("folded_tail"))


SESSIONS_SQL = """SELECT conv_id, CASE WHEN conv_id % 7 <> 0 THEN coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (turn <= cut), '') END AS view, count(*) FILTER (turn <= cut) AS raw_count, CASE WHEN conv_id % 11 = 0 THEN 0 ELSE count(*) END AS history_count,
coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (turn > cut), '') AS raw_tail, coalesce(CASE WHEN conv_id % 5 = 0 THEN string_agg(text, chr(10) ORDER BY turn) FILTER (turn > cut) ELSE string_agg(substring(text, 1, 60), chr(10) ORDER BY turn) FILTER (turn > cut) END, '') AS folded_tail
FROM (SELECT *, floor(max(turn) OVER (PARTITION BY conv_id) / 2) AS cut FROM conversations) GROUP BY conv_id"""
NOW = [{"now_view": "CASE WHEN conv_id % 4 = 0 THEN view || 'x' ELSE view END", "now_count": "CASE WHEN conv_id % 6 = 0 THEN raw_count + 1 ELSE raw_count END"}]
STORED = [
    {
        "version": "CASE WHEN conv_id % 13 = 0 THEN 3 WHEN conv_id % 17 = 0 THEN 1 ELSE 2 END", "stored_view": "CASE WHEN conv_id % 10 = 3 THEN next_view || '!' ELSE next_view END", "stored_chars": "CASE WHEN conv_id % 10 = 4 THEN -1 ELSE next_chars + CASE WHEN conv_id % 10 = 3 THEN 1 ELSE 0 END END",
        "stored_seed": "CASE WHEN conv_id % 10 = 6 THEN NULL ELSE next_digest END", "stored_manifest": "CASE WHEN conv_id % 10 = 5 THEN manifest || '0' ELSE manifest END", "stored_manifest_digest": "manifest_digest", "layout": "CASE WHEN conv_id % 10 = 9 THEN -1 ELSE prefix_chars END",
    },
]
PLAN_COLUMNS = ["conv_id", "skip", "tail_chars", "band_chars", "prefix_chars", "saved", "ratio", "alarm", "base_digest", "next_digest", "next_count"]
COMMIT_STEPS = [*seals.PLAN, *NOW, *seals.COMMIT]
RESTORE_STEPS = [*seals.PLAN, *seals.SNAPSHOT, *STORED, *seals.VERIFY]
COMMIT_COLUMNS = ["conv_id", "outcome", "final_digest", "final_count"]
RESTORE_COLUMNS = ["conv_id", "manifest_digest", "failure", "restored", "restored_view_chars"]


def _sealed(steps: list, columns: list[str]):
    return lambda spark, d: rules.apply(_sessions(spark, d), steps).select(*columns)


def band_summary(spark: SparkSession, d: str) -> DataFrame:
    """Bands of ten messages of a conversation: characters of each and of all before it."""
    b = messages(spark, d).groupBy("conv_id", F.floor(F.col("turn") / 10).alias("band")).agg(F.sum(F.length("text").cast("long")).alias("chars"))
    w = W.partitionBy("conv_id").orderBy("band")
    return b.select("conv_id", "band", "chars", F.coalesce(F.sum("chars").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.first("chars").over(w).alias("seed_chars"))


BAND_SQL = """WITH b AS (SELECT conv_id, (turn // 10)::BIGINT AS band, sum(len(text))::BIGINT AS chars FROM conversations GROUP BY ALL)
SELECT conv_id, band, chars, coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, first_value(chars) OVER (PARTITION BY conv_id ORDER BY band) AS seed_chars FROM b"""


# providers
def provider_shapes(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    role, text = F.col("role"), F.col("text")
    return m.select("conv_id", "turn", *(F.sha2(f(role, text), 256).alias(n) for n, f in (("blocks", providers.block_message), ("chat", providers.chat_message), ("parts", providers.parts_message), ("item", providers.response_item))))


SHAPES_SQL = """WITH m AS (SELECT conv_id, turn, text, CASE WHEN role IN ('assistant', 'model') THEN 'assistant' ELSE 'user' END AS r, to_json(text) AS t FROM conversations)
SELECT conv_id, turn, sha256('{"role":"' || r || '","content":[{"type":"text","text":' || t || '}]}') AS blocks, sha256('{"role":"' || r || '","content":' || t || '}') AS chat,
sha256('{"role":"' || CASE r WHEN 'assistant' THEN 'model' ELSE 'user' END || '","parts":[{"text":' || t || '}]}') AS parts,
CASE WHEN len(text) > 0 THEN sha256('{"type":"message","role":"' || r || '","content":[{"type":"' || CASE r WHEN 'assistant' THEN 'output_text' ELSE 'input_text' END || '","text":' || t || '}]}') END AS item FROM m"""


def cache_marks(spark: SparkSession, d: str) -> DataFrame:
    last = F.max("turn").over(W.partitionBy("conv_id"))
    rows = messages(spark, d).select("conv_id", "turn", "text", last.alias("last"))
    boundary = F.when(F.col("conv_id") % 3 > 0, F.col("conv_id") % 9)
    head = F.length(providers.cached_system(F.col("text"), " the ")).cast("long")
    return rows.select("conv_id", "turn", providers.cache_mark(F.col("turn"), F.col("last"), boundary).alias("marked"), head.alias("stable_chars"))


MARKS_SQL = """WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, CASE WHEN conv_id % 3 > 0 THEN conv_id % 9 END AS b, instr(text, ' the ') AS spot FROM conversations)
SELECT conv_id, turn, coalesce(b > 0 AND b <= last AND turn = b - 1, FALSE) OR turn = last AS marked, CASE WHEN spot > 1 AND trim(substring(text, 1, spot - 1)) <> '' AND trim(substring(text, spot)) <> '' THEN spot - 1 ELSE len(text) END AS stable_chars FROM m"""

EVENT_JSON = """CASE event_id % 6 WHEN 0 THEN '{"type":"message.updated","properties":{"info":{"sessionID":"s' || CAST(user_id AS VARCHAR(20)) || '","tokens":{"total":' || CAST(event_id AS VARCHAR(20)) || '}}}}'
WHEN 1 THEN '{"type":"message.updated","properties":{"info":{"sessionID":"s","tokens":{"input":' || CAST(user_id AS VARCHAR(20)) || ',"output":7,"cache":{"read":100,"write":5}}}}}'
WHEN 2 THEN '{"type":"message.updated","properties":{"info":{"tokens":{"total":0,"input":0}}}}' WHEN 3 THEN '{"type":"session.idle","properties":{"info":{"sessionID":"z","tokens":{"total":9}}}}'
WHEN 4 THEN '{"type":"message.updated","properties":{}}' ELSE '{"type":"message.updated","properties":{"info":{"sessionID":"q","tokens":{"total":"x","input":3}}}}' END"""


def event_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id").selectExpr("event_id", f"{EVENT_JSON} AS event")
    return e.select("event_id", providers.input_tokens(F.col("event")).alias("tokens"), providers.session_id(F.col("event")).alias("session"))


EVENT_SQL = f"""WITH e AS (SELECT event_id, {EVENT_JSON} AS j FROM events), n AS (SELECT event_id, json_extract_string(j, '$.type') AS type, json_extract_string(j, '$.properties.info.sessionID') AS session,
TRY_CAST(json_extract_string(j, '$.properties.info.tokens.total') AS BIGINT) AS total, coalesce(TRY_CAST(json_extract_string(j, '$.properties.info.tokens.input') AS BIGINT), 0) + coalesce(TRY_CAST(json_extract_string(j, '$.properties.info.tokens.output') AS BIGINT), 0)
+ coalesce(TRY_CAST(json_extract_string(j, '$.properties.info.tokens.cache.read') AS BIGINT), 0) + coalesce(TRY_CAST(json_extract_string(j, '$.properties.info.tokens.cache.write') AS BIGINT), 0) AS summed FROM e)
SELECT event_id, CASE WHEN type = 'message.updated' THEN CASE WHEN total > 0 THEN total WHEN summed > 0 THEN summed END END AS tokens, session FROM n"""


# zones
def _zones(spark: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("kind") == "mention", F.concat(F.lit("term:"), "path")).otherwise(F.col("path"))
    return touches(spark, d).select("session", target.alias("target"), F.floor(F.col("pos") / 5).alias("chapter"), (F.col("kind") == "edit").alias("complete"))


ZONES_SQL = f"{TOUCHES_SQL}, z AS (SELECT session, CASE WHEN kind = 'mention' THEN 'term:' || path ELSE path END AS target, (pos // 5)::BIGINT AS chapter, kind = 'edit' AS complete FROM touches)"


def zone_served(spark: SparkSession, d: str) -> DataFrame:
    return zones.served(_zones(spark, d))


def zone_served_by_target(spark: SparkSession, d: str) -> DataFrame:
    return zones.served_by_target(_zones(spark, d))


CARD = "'[Episode ' || CASE WHEN turn % 3 = 0 THEN 'recall ' WHEN turn % 3 = 1 THEN 'chain ' ELSE 'note ' END || CAST(turn AS VARCHAR(20)) || ']' || chr(10) || text"


def card_headers(spark: SparkSession, d: str) -> DataFrame:
    views = messages(spark, d).where("role = 'assistant'").selectExpr("conv_id AS session", f"{CARD} AS text")
    return zones.headers(views)


HEADERS_SQL = f"SELECT DISTINCT conv_id AS session, header FROM (SELECT conv_id, unnest(string_split({CARD}, chr(10))) AS header FROM conversations WHERE role = 'assistant') WHERE regexp_matches(header, '^\\[Episode (recall|chain) ')"


def card_visibility(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    cards = m.where("role = 'user'").selectExpr("conv_id AS session", "turn AS card", "concat(substring(upper(text), 1, 30 + CAST(turn % 40 AS INT)), '...') AS probe")
    seen = m.where("role = 'user' and turn % 4 < 2").groupBy(F.col("conv_id").alias("session")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.substring_index(x["text"], ".", 1)), " ").alias("text"))
    return zones.already_visible(cards, seen)


_POV = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[‘’]', '''', 'g'), '[“”]', '\"', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
VISIBLE_SQL = f"""WITH c AS (SELECT conv_id AS session, turn AS card, trim(regexp_replace(trim(substring(upper(text), 1, 30 + turn % 40) || '...'), '(\\.{{3}}|…)+$', '')) AS clean FROM conversations WHERE role = 'user'),
v AS (SELECT conv_id AS session, string_agg(split_part(text, '.', 1), ' ' ORDER BY turn) AS text FROM conversations WHERE role = 'user' AND turn % 4 < 2 GROUP BY conv_id),
p AS (SELECT session, card, len(clean) >= 40 AS counts, {_POV.format('clean')} AS p FROM c), s AS (SELECT session, {_POV.format('text')} AS t FROM v)
SELECT session, card, coalesce(counts AND contains(' ' || t || ' ', ' ' || p || ' '), FALSE) AS shown FROM p LEFT JOIN s USING (session)"""


def stash_service(spark: SparkSession, d: str) -> DataFrame:
    rows = touches(spark, d).selectExpr("CAST(session AS STRING) AS session", "CAST(pos AS BIGINT) AS pos", "CASE WHEN kind = 'error' THEN 1 + pos % 3 END AS cards", "kind <> 'edit' AS gated")
    return replay.replay(rows, "session", "pos", zones.stash_step, zones.STASH)


STASH_SQL = f"""WITH RECURSIVE {TOUCHES_SQL}, r AS (SELECT session::VARCHAR AS session, pos::BIGINT AS pos, CASE WHEN kind = 'error' THEN 1 + pos % 3 END AS cards, kind <> 'edit' AS gated, row_number() OVER (PARTITION BY session ORDER BY pos) AS n FROM touches),
f AS (SELECT session, pos, n, 0 AS served, 'none' AS why, gated::INT AS since, CASE WHEN cards IS NOT NULL THEN pos END AS born, cards AS held FROM r WHERE n = 1 UNION ALL
SELECT session, pos, n, CASE WHEN why = 'served' THEN CASE WHEN gated THEN 1 ELSE held END ELSE 0 END, why, CASE WHEN why = 'served' AND gated THEN 0 ELSE since END, CASE WHEN cards IS NOT NULL THEN pos WHEN spent THEN NULL ELSE born END, CASE WHEN cards IS NOT NULL THEN cards WHEN spent THEN NULL ELSE held END
FROM (SELECT *, CASE WHEN NOT open THEN CASE WHEN held IS NULL THEN 'none' ELSE 'held' END WHEN held IS NULL THEN 'none' WHEN pos - born > {zones.STASH_AGE} THEN 'stale' ELSE 'served' END AS why, open AND held IS NOT NULL AS spent FROM (
SELECT r.session, r.pos, r.n, r.cards, r.gated, f.since + r.gated::INT AS since, f.born, f.held, NOT r.gated OR f.since + 1 >= {zones.READ_RATE} AS open FROM f JOIN r ON r.session = f.session AND r.n = f.n + 1)))
SELECT session, pos, served, why FROM f"""

QUERIES = {
    "draft_outcomes": (draft_outcomes, DRAFT_SQL),
    "draft_merges": (draft_merges, MERGES_SQL),
    "rail_template_index": (rail_template_index, f"SELECT rail, n AS step_count, sha256(template) AS digest FROM ({TEMPLATE_SQL})"),
    "rail_template_seeds": (rail_template_seeds, "SELECT l_orderkey AS rail, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS n, 's' || l_linenumber AS id, 'title ' || l_returnflag AS title FROM lineitem"),
    "seal_plans": (_sealed(seals.PLAN, PLAN_COLUMNS), rules.query(SESSIONS_SQL, seals.PLAN, PLAN_COLUMNS)),
    "seal_commits": (_sealed(COMMIT_STEPS, COMMIT_COLUMNS), rules.query(SESSIONS_SQL, COMMIT_STEPS, COMMIT_COLUMNS)),
    "snapshot_restores": (_sealed(RESTORE_STEPS, RESTORE_COLUMNS), rules.query(SESSIONS_SQL, RESTORE_STEPS, RESTORE_COLUMNS)),
    "band_summary": (band_summary, BAND_SQL),
    "provider_shapes": (provider_shapes, SHAPES_SQL),
    "cache_marks": (cache_marks, MARKS_SQL),
    "event_tokens": (event_tokens, EVENT_SQL),
    "zone_served": (zone_served, f"""WITH {ZONES_SQL} SELECT session, array_to_string(list_sort(list_distinct(list(chapter))), ',') AS chapters, coalesce(array_to_string(list_sort(list_distinct(list(target) FILTER (starts_with(target, 'term:')))), ','), '') AS terms,
coalesce(array_to_string(list_sort(list_distinct(list(target) FILTER (complete))), ','), '') AS completed FROM z GROUP BY session"""),
    "zone_served_by_target": (zone_served_by_target, f"WITH {ZONES_SQL} SELECT session, target, array_to_string(list_sort(list_distinct(list(chapter))), ',') AS chapters FROM z GROUP BY session, target"),
    "card_headers": (card_headers, HEADERS_SQL),
    "card_visibility": (card_visibility, VISIBLE_SQL),
    "stash_service": (stash_service, STASH_SQL),
}
