"""Evidence, vault rows, routing, prefetches, zone orders and settled bursts over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators import evidence as ev
from loomspark.plans.rule_queries import _pick
from loomspark.sources.bindings import TOUCHES_SQL, messages, table, touches

TOOL = _pick(["Read", "Bash", "task_rail", "run_tests", "Edit"], "turn")
RESULT = "CASE turn % 4 WHEN 0 THEN 'Expected 3 but found 4' WHEN 1 THEN 'ok' WHEN 2 THEN 'see src/a.py:12' ELSE 'done' END || chr(10) || text || chr(10) || 'tests passed in lib/b.ts:'"


def _results(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where("role = 'assistant'").selectExpr("conv_id AS session", "turn AS pos", f"{TOOL} AS tool", "turn % 3 = 0 AS is_error", f"{RESULT} AS text")


def result_evidence(spark: SparkSession, d: str) -> DataFrame:
    return ev.best_evidence(_results(spark, d))


_ONE = "trim(regexp_replace(line, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_SIGNAL, _FILE, _GENERIC = (x.replace("'", "''") for x in (ev.SIGNAL, ev.FILE, ev.GENERIC))
EVIDENCE_SQL = f"""r AS (SELECT conv_id AS session, turn AS pos, {TOOL} AS tool, turn % 3 = 0 AS is_error, {RESULT} AS text FROM conversations WHERE role = 'assistant'),
l AS (SELECT session, pos, tool, is_error, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS i FROM r),
s AS (SELECT session, pos, tool, i, {_ONE} AS plain, CASE WHEN is_error THEN 80 ELSE 0 END + CASE WHEN regexp_matches(lower({_ONE}), '{_SIGNAL}') THEN 35 ELSE 0 END + CASE WHEN regexp_matches(lower({_ONE}), '{_FILE}') THEN 20 ELSE 0 END
+ CASE WHEN regexp_matches(lower(tool), '{ev.INVESTIGATES}') THEN 12 ELSE 0 END - CASE WHEN regexp_matches(lower(tool), '{ev.COORDINATES}') THEN 25 ELSE 0 END + CASE WHEN len({_ONE}) >= 24 THEN 5 ELSE 0 END AS score FROM l),
e AS (SELECT session, pos, tool, score, substring(plain, 1, 120) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY session, pos ORDER BY score DESC, i) AS n FROM s WHERE len(plain) >= 4 AND NOT regexp_matches(lower(plain), '{_GENERIC}') AND score >= 25) WHERE n = 1)"""


def claim_evidence(spark: SparkSession, d: str) -> DataFrame:
    claims = messages(spark, d).where("role = 'user'").selectExpr("conv_id AS session", "turn AS at", "concat(text, ' we found and expected src tests') AS text")
    return ev.claim_evidence(claims, ev.best_evidence(_results(spark, d)))


_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({}), '([a-z0-9][a-z0-9_-]{{2,}})', 1), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in ev.CLAIM_STOP) + ")))"
CLAIM_SQL = f"""WITH {EVIDENCE_SQL}, c AS (SELECT conv_id AS session, turn AS at, unnest({_TERMS.format("text || ' we found and expected src tests'")}) AS term FROM conversations WHERE role = 'user'),
h AS (SELECT session, pos, score, unnest({_TERMS.format("evidence || ' ' || tool")}) AS term FROM e),
o AS (SELECT c.session, c."at", h.pos, score, count(*) AS overlap FROM c JOIN h USING (session, term) WHERE h.pos <= c."at" GROUP BY ALL)
SELECT session, "at", pos, overlap, value FROM (SELECT *, overlap * 10000 + score * 10 - ("at" - pos) AS value, row_number() OVER (PARTITION BY session, "at" ORDER BY overlap * 10000 + score * 10 - ("at" - pos) DESC, pos, overlap DESC) AS n FROM o) WHERE n = 1"""


def voice_inlays(spark: SparkSession, d: str) -> DataFrame:
    notes = touches(spark, d).selectExpr("session AS episode", "CAST(event_id % 5 AS INT) AS priority", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE ms END AS ms", "concat(path, '#', event_id) AS text")
    return ev.voice_inlays(notes)


VOICE_SQL = f"""WITH {TOUCHES_SQL}, n AS (SELECT session AS episode, (event_id % 5)::INTEGER AS priority, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ms END AS ms, path || '#' || event_id AS text FROM touches),
k AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY priority, ms NULLS FIRST, text) AS n FROM n)
SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY ms NULLS FIRST, n) AS place, text, priority FROM k WHERE n <= 2"""


def task_vault(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).where("role = 'user'").selectExpr("conv_id AS session", "turn AS pos", "turn % 5 = 2 AND conv_id % 3 > 0 AS frontier")
    return ev.current_task(rows).select("session", "pos")


def vault_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).selectExpr("conv_id AS session", "turn", "CASE WHEN turn % 7 = 3 THEN 'unanswered' ELSE 'answered' END AS liveness", "sha2(lower(text), 256) AS fingerprint")
    return ev.vault_delta(rows, rows.where("turn % 2 = 0")).select("session", "turn")


def pairing_safe_tails(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    pairs = t.where("kind = 'read'").selectExpr("session", "pos AS call", "CASE WHEN event_id % 17 <> 0 THEN pos + 1 + event_id % 4 END AS result")
    asked = t.groupBy("session").agg(F.count(F.lit(1)).alias("n")).select("session", F.explode(F.array(F.floor(F.col("n") / 4), F.floor(F.col("n") / 2), F.col("n") - 1)).alias("start")).distinct()
    return ev.pairing_safe_start(pairs, asked)


PAIRING_SQL = f"""WITH RECURSIVE {TOUCHES_SQL}, p AS (SELECT session, pos::BIGINT AS call, CASE WHEN event_id % 17 <> 0 THEN pos + 1 + event_id % 4 END AS result FROM touches WHERE kind = 'read'),
a AS (SELECT DISTINCT session, unnest([n // 4, n // 2, n - 1]) AS start FROM (SELECT session, count(*) AS n FROM touches GROUP BY session)),
m AS (SELECT session, start, start AS safe FROM a UNION ALL
SELECT m.session, m.start, (SELECT min(call) FROM p WHERE p.session = m.session AND call < m.safe AND (result IS NULL OR result >= m.safe)) AS safe FROM m WHERE EXISTS (SELECT 1 FROM p WHERE p.session = m.session AND call < m.safe AND (result IS NULL OR result >= m.safe)))
SELECT session, start, min(safe) AS safe FROM m GROUP BY session, start"""


def literal_routes(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    literals = m.where("role = 'user'").selectExpr("conv_id AS session", "concat(split(text, ' ')[0], '/', turn) AS literal", "CASE WHEN turn % 6 = 0 THEN turn + 1 WHEN turn % 6 = 2 THEN NULL ELSE -1 END AS source", "CASE WHEN turn % 4 = 0 THEN NULL ELSE turn * 1000 END AS ms")
    artifacts = m.where("role = 'assistant' and turn % 4 = 1").selectExpr("conv_id AS session", "concat('a', turn) AS artifact", "turn AS source_index", "CASE WHEN turn % 8 = 1 THEN NULL ELSE turn * 1000 + 300 END AS ms", "concat(text, ' ', split(text, ' ')[0], '/4') AS text", "turn AS n")
    return ev.route_literals(literals, artifacts)


ROUTE_SQL = """WITH l AS (SELECT conv_id AS session, split_part(text, ' ', 1) || '/' || turn AS literal, CASE WHEN turn % 6 = 0 THEN turn + 1 WHEN turn % 6 = 2 THEN NULL ELSE -1 END AS source, CASE WHEN turn % 4 = 0 THEN NULL ELSE turn * 1000 END AS ms FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id AS session, 'a' || turn AS artifact, turn AS source_index, CASE WHEN turn % 8 = 1 THEN NULL ELSE turn * 1000 + 300 END AS a_ms, text || ' ' || split_part(text, ' ', 1) || '/4' AS a_text, turn AS n FROM conversations WHERE role = 'assistant' AND turn % 4 = 1),
r AS (SELECT l.session, literal, artifact, n, CASE WHEN source = source_index THEN 0 WHEN contains(a_text, literal) THEN 1 WHEN ms IS NOT NULL AND a_ms IS NOT NULL THEN 2 ELSE 3 END AS rank, abs(ms - a_ms) AS gap FROM l JOIN a USING (session))
SELECT session, literal, artifact, ['structural', 'contained', 'nearest', 'first'][rank + 1] AS why FROM (SELECT *, row_number() OVER (PARTITION BY session, literal ORDER BY rank, CASE WHEN rank = 2 THEN gap ELSE 0 END, n, artifact) AS k FROM r) WHERE k = 1"""


def peer_dispositions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    episodes = o.selectExpr("o_orderkey AS id", "CASE WHEN o_custkey % 5 > 0 THEN concat('r', o_custkey % 3) END AS observed", "concat('r', o_orderkey % 2) AS current")
    checks = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS id", "concat('r', o_custkey % 3) AS source_revision", "concat('r', o_orderkey % 2) AS local_revision", "CASE WHEN o_custkey % 4 = 0 THEN 'guess' ELSE 'test' END AS method", "CASE WHEN o_custkey % 7 > 0 THEN 1 END AS verified_ms")
    return ev.peer_disposition(episodes, checks)


PEER_SQL = """WITH e AS (SELECT *, CASE WHEN o_custkey % 5 > 0 THEN 'r' || (o_custkey % 3) END AS observed, 'r' || (o_orderkey % 2) AS current FROM orders)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND observed IS NOT NULL AND o_custkey % 4 > 0 AND o_custkey % 7 > 0 THEN 'verified' WHEN observed <> current THEN 'stale-revision' ELSE 'unverified' END AS disposition FROM e"""


def prefetch_promotions(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).select("session", "pos", "ms", "path")
    caches = t.groupBy("session").agg(F.min("ms").alias("first")).selectExpr("session", "first + 86400000 AS made_ms", "CASE WHEN session % 2 = 0 THEN 86400000 ELSE 3456000000 END AS ttl_ms", "array(concat('src/mod', session % 50, '.ts'), concat('src/mod', (session * 7) % 50, '.ts')) AS paths")
    return ev.prefetch(caches, t)


PREFETCH_SQL = f"""WITH {TOUCHES_SQL}, c AS (SELECT session, min(ms) + 86400000 AS made, CASE WHEN session % 2 = 0 THEN 86400000 ELSE 3456000000 END AS ttl FROM touches GROUP BY session),
h AS (SELECT c.session, made, ttl, t.ms, t.path, row_number() OVER (PARTITION BY c.session ORDER BY t.ms, t.pos) AS n FROM c JOIN touches t ON t.session = c.session AND t.ms >= made AND t.path IN ('src/mod' || (c.session % 50) || '.ts', 'src/mod' || ((c.session * 7) % 50) || '.ts'))
SELECT c.session, CASE WHEN h.ms IS NULL THEN 'waiting' WHEN h.ms - c.made > c.ttl THEN 'expired' ELSE 'promoted' END AS state, CASE WHEN h.ms - c.made <= c.ttl THEN h.path END AS path FROM c LEFT JOIN h ON h.session = c.session AND n = 1"""

ZONE_PATH = "concat(CASE l_linenumber % 4 WHEN 0 THEN 'src/a/' WHEN 1 THEN 'src/b/' WHEN 2 THEN 'lib/' ELSE 'src/a/c/' END, 'p', l_partkey % 20, '.ts')"


def _zone_paths(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").selectExpr("l_orderkey", f"{ZONE_PATH} AS path", "l_linenumber AS n")
    zone = line.groupBy("l_orderkey", "path").agg(F.min("n").alias("n"))
    anchor = zone.groupBy("l_orderkey").agg(F.min("path").alias("first"))
    return zone.join(anchor, "l_orderkey").select(F.concat("first", F.lit("@"), F.col("l_orderkey").cast("string")).alias("anchor"), F.when(F.col("path") == F.col("first"), F.concat("path", F.lit("@"), F.col("l_orderkey").cast("string"))).otherwise(F.col("path")).alias("path"), "n")


def zone_order(spark: SparkSession, d: str) -> DataFrame:
    return ev.order_zone(_zone_paths(spark, d).withColumn("n", F.struct("n", "path")))


ZONE_SQL = f"""WITH z AS (SELECT l_orderkey, {ZONE_PATH} AS path, min(l_linenumber) AS n FROM lineitem GROUP BY ALL), f AS (SELECT *, min(path) OVER (PARTITION BY l_orderkey) AS first FROM z),
p AS (SELECT first || '@' || l_orderkey AS anchor, CASE WHEN path = first THEN path || '@' || l_orderkey ELSE path END AS path, n FROM f),
s AS (SELECT *, list_transform(string_split(anchor, '/')[:-2], lambda x, i: i) AS idx, string_split(anchor, '/')[:-2] AS a, string_split(path, '/')[:-2] AS b FROM p),
k AS (SELECT *, CASE WHEN path = anchor THEN 1048576 ELSE len(list_filter(idx, lambda i: a[1:i] = b[1:i])) END AS shared FROM s)
SELECT anchor, path, row_number() OVER (PARTITION BY anchor ORDER BY shared DESC, n, path) AS rank FROM k"""


def evictable_turns(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    turns = m.selectExpr("conv_id AS session", "turn", "turn + 1 + (turn % 3) AS stop")
    ends = m.groupBy(F.col("conv_id").alias("session")).agg(F.count(F.lit(1)).alias("n"))
    cursors = ends.selectExpr("session", "floor(n * 0.7) AS cursor")
    frontiers = ends.selectExpr("session", "explode(array(1, 2, 3, 4)) AS epoch", "n").selectExpr("session", "epoch", "floor(n * epoch / 6) AS folded", "3 + session % 3 AS upcoming")
    return ev.evictable(turns, cursors, frontiers)


EVICT_SQL = """WITH e AS (SELECT conv_id AS session, count(*) AS n FROM conversations GROUP BY conv_id),
c AS (SELECT session, count(*) FILTER (below) AS by_cursor FROM (SELECT conv_id AS session, bool_and(turn + 1 + (turn % 3) <= floor(n * 0.7)) OVER (PARTITION BY conv_id ORDER BY turn) AS below FROM conversations JOIN e ON e.session = conv_id) GROUP BY session),
a AS (SELECT session, max(floor(n * epoch / 6)) AS by_age FROM e, (SELECT unnest([1, 2, 3, 4]) AS epoch) WHERE epoch <= 3 + session % 3 - 2 GROUP BY session)
SELECT c.session, least(by_cursor, coalesce(by_age, 0))::BIGINT AS evictable FROM c LEFT JOIN a USING (session)"""


def settled_bursts(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).where("kind <> 'error'")
    bursts = t.selectExpr("session", "pos AS last_pos", "ms AS last_ms")
    ends = touches(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("ms").alias("now_ms"), F.max(F.when(F.col("event_id") % 9 == 0, F.col("pos"))).alias("seal_pos"))
    return ev.settled(bursts, ends)


SETTLED_SQL = f"""WITH {TOUCHES_SQL}, l AS (SELECT session, max(pos) AS p, arg_max(ms, pos) AS m FROM touches WHERE kind <> 'error' GROUP BY session), e AS (SELECT session, count(*) AS n, max(ms) AS now, max(pos) FILTER (event_id % 9 = 0) AS s FROM touches GROUP BY session)
SELECT session, coalesce(s > p AND s < n, FALSE) OR n - p > 25 OR now - m > 1200000 AS settled FROM l JOIN e USING (session)"""


def view_overlap(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    m = messages(spark, d).withColumn("before", F.lag("text").over(w)).where("before is not null")
    facts = F.split("before", " ")
    present = F.size(F.filter(F.array_distinct(facts), lambda x: (x != "") & F.col("text").contains(x))).cast("long")
    return m.select("conv_id", "turn", ev.common_prefix(F.col("text"), F.col("before")).cast("long").alias("common"), present.alias("present"))


OVERLAP_SQL = """WITH m AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, len(list_filter(range(1, least(len(text), len(before)) + 1), lambda i: text[1:i] = before[1:i])) AS common, len(list_filter(list_distinct(string_split(before, ' ')), lambda x: x <> '' AND contains(text, x))) AS present FROM m WHERE before IS NOT NULL"""


QUERIES = {
    "result_evidence": (result_evidence, f"WITH {EVIDENCE_SQL} SELECT session, pos, tool, score, evidence FROM e"),
    "claim_evidence": (claim_evidence, CLAIM_SQL),
    "voice_inlays": (voice_inlays, VOICE_SQL),
    "task_vault": (task_vault, "SELECT session, pos FROM (SELECT conv_id AS session, turn AS pos, max(CASE WHEN turn % 5 = 2 AND conv_id % 3 > 0 THEN turn END) OVER (PARTITION BY conv_id) AS newest FROM conversations WHERE role = 'user') WHERE newest IS NULL OR pos >= newest"),
    "vault_delta": (vault_delta, "WITH r AS (SELECT conv_id AS session, turn, sha256(lower(text)) AS f FROM conversations) SELECT session, turn FROM r WHERE turn % 7 <> 3 AND (session, f) NOT IN (SELECT (session, f) FROM r WHERE turn % 2 = 0)"),
    "pairing_safe_tails": (pairing_safe_tails, PAIRING_SQL),
    "literal_routes": (literal_routes, ROUTE_SQL),
    "peer_dispositions": (peer_dispositions, PEER_SQL),
    "prefetch_promotions": (prefetch_promotions, PREFETCH_SQL),
    "zone_order": (zone_order, ZONE_SQL),
    "evictable_turns": (evictable_turns, EVICT_SQL),
    "settled_bursts": (settled_bursts, SETTLED_SQL),
    "view_overlap": (view_overlap, OVERLAP_SQL),
}
