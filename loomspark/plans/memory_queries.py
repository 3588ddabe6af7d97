"""Waypoints, covering literals, query vectors, synonyms, deltas, steps, spools, points and fits over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import text as tx
from loomspark.operators import memory, recall_plan, retrieve
from loomspark.plans.rule_queries import _pick
from loomspark.plans.text_queries import FREQ_SQL, TOK
from loomspark.sources.bindings import TOUCHES_SQL, messages, table, touches

REGISTER = _pick(["verdict", "", "working", "hazard", "in_progress", ""], "turn")


def waypoints(spark: SparkSession, d: str) -> DataFrame:
    return memory.waypoints(messages(spark, d).where("role = 'assistant'").selectExpr("conv_id AS session", "turn AS pos", "substring(text, 1, 100 + turn * 40) AS text", f"{REGISTER} AS register"))


WAYPOINT_SQL = f"""WITH r AS (SELECT conv_id AS session, turn AS pos, substring(text, 1, 100 + turn * 40) AS text, {REGISTER} AS register FROM conversations WHERE role = 'assistant'),
l AS (SELECT *, CASE WHEN register IN ('verdict', 'hazard') THEN 'durable' WHEN len(text) <= 240 THEN 'transient' END AS lane FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY session, lane ORDER BY pos DESC) AS n FROM l WHERE lane IS NOT NULL)
SELECT session, pos, lane, substring(regexp_replace(split_part(trim(text), chr(10), 1), '[ \\t\\r\\f]+', ' ', 'g'), 1, 120) AS headline,
CASE WHEN lane = 'transient' THEN min(CASE WHEN lane = 'durable' THEN pos END) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS superseded_by FROM k WHERE n <= CASE lane WHEN 'durable' THEN 20 ELSE 6 END"""

LITERAL = "CASE event_id % 6 WHEN 0 THEN '/repo/' || path WHEN 1 THEN path WHEN 2 THEN split_part(path, '/', 2) WHEN 3 THEN 'repo/' || path WHEN 4 THEN ' key=' || CAST(event_id % 9 AS VARCHAR(20)) ELSE '/' || path END"


def covering_literals(spark: SparkSession, d: str) -> DataFrame:
    return memory.covering_literals(touches(spark, d).selectExpr("session", f"{LITERAL} AS literal"))


COVER_SQL = f"""WITH {TOUCHES_SQL}, l AS (SELECT DISTINCT session, trim({LITERAL}) AS literal FROM touches), k AS (SELECT *, CASE WHEN starts_with(literal, '/') THEN substring(literal, 2) ELSE literal END AS key FROM l),
o AS (SELECT session, key, arg_max(literal, (starts_with(literal, '/'), literal)) AS literal FROM k GROUP BY ALL)
SELECT session, literal FROM o WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.session = o.session AND x.key <> o.key AND ends_with(x.key, '/' || o.key))"""


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    asked = messages(spark, d).where("role = 'user' and turn < 4").select(F.concat_ws("-", "conv_id", "turn").alias("query"), "text")
    hints = asked.select("query", F.concat(F.lit("src/"), F.substring_index("query", "-", 1), F.lit(".ts")).alias("file"))
    v = memory.query_vector(asked, retrieve.inverse_frequency(docs), hints)
    return v.groupBy("query").agg(F.count(F.lit(1)).alias("dims"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("norm"))


VECTOR_SQL = f"""WITH {FREQ_SQL}, n AS (SELECT count(*) AS n FROM documents), i AS (SELECT token, ln(n / (1.0 + df)) AS idf FROM df, n),
q AS (SELECT conv_id || '-' || turn AS query, unnest({TOK('text')}) AS token FROM conversations WHERE role = 'user' AND turn < 4), t AS (SELECT query, token, count(*) AS tf FROM q GROUP BY ALL),
w AS (SELECT query, (1 + ln(tf)) * idf AS w FROM t JOIN i USING (token) WHERE idf > 0 UNION ALL SELECT conv_id || '-' || turn, 3.0 FROM conversations WHERE role = 'user' AND turn < 4)
SELECT query, count(*) AS dims, round(sqrt(sum(w * w)), 6) AS norm FROM w GROUP BY query"""


def synonym_stems(spark: SparkSession, d: str) -> DataFrame:
    stems = messages(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.explode(tx.distinctive_terms(F.col("text"))).alias("stem"))
    table_ = stems.select("stem").distinct().where(F.length("stem") % 3 == 0).select("stem", F.concat(F.lit("syn-"), F.substring("stem", 1, 3)).alias("synonym"))
    return memory.with_synonyms(stems, table_).groupBy("key").agg(F.count(F.lit(1)).alias("stems"), F.count_if(F.col("stem").startswith("syn-")).alias("added"))


SYNONYM_SQL = f"""WITH s AS (SELECT conv_id || '-' || turn AS key, unnest({tx.terms_sql('text')}) AS stem FROM conversations), a AS (SELECT key, stem FROM s UNION SELECT key, 'syn-' || substring(stem, 1, 3) FROM s WHERE len(stem) % 3 = 0)
SELECT key, count(*) AS stems, count(*) FILTER (starts_with(stem, 'syn-')) AS added FROM a GROUP BY key"""

OLD, NEW = ("replace(text, '. ', '.' || chr(10))", "CASE turn % 4 WHEN 0 THEN replace(text, '. ', '.' || chr(10)) WHEN 1 THEN replace(text, '. ', '.' || chr(10)) || chr(10) || 'added' WHEN 2 THEN 'head' || chr(10) || replace(text, '. ', '.' || chr(10)) ELSE 'other' END")


def line_deltas(spark: SparkSession, d: str) -> DataFrame:
    pre, post, alike = memory.line_delta(F.col("old"), F.col("new"))
    return messages(spark, d).selectExpr("conv_id", "turn", f"{OLD} AS old", f"{NEW} AS new").select("conv_id", "turn", pre.cast("long").alias("pre"), post.cast("long").alias("post"), alike.alias("alike"))


DELTA_SQL = f"""WITH m AS (SELECT conv_id, turn, string_split({OLD}, chr(10)) AS a, string_split({NEW}, chr(10)) AS b FROM conversations), p AS (SELECT *, least(len(a), len(b)) AS s FROM m),
q AS (SELECT *, len(list_filter(range(1, s + 1), lambda i: a[1:i] = b[1:i])) AS pre FROM p), r AS (SELECT *, len(list_filter(range(1, s - pre + 1), lambda i: a[len(a) - i + 1:] = b[len(b) - i + 1:])) AS post FROM q)
SELECT conv_id, turn, pre, post, pre + post >= greatest(1, ceil(0.15 * s)) AS alike FROM r"""

STEPS = "CASE turn % 3 WHEN 0 THEN ' [\"plan ' || CAST(turn AS VARCHAR(20)) || '\",\"do\", \"check\"] ' WHEN 1 THEN 'one' || chr(10) || chr(10) || '  two ' || chr(10) || CAST(turn AS VARCHAR(20)) ELSE '' END"


def file_steps(spark: SparkSession, d: str) -> DataFrame:
    return memory.steps_of(messages(spark, d).selectExpr("concat(conv_id, '-', turn) AS file", f"{STEPS} AS text"))


STEPS_SQL = f"""WITH f AS (SELECT conv_id || '-' || turn AS file, trim({STEPS}) AS t FROM conversations),
l AS (SELECT file, CASE WHEN starts_with(t, '[') THEN from_json(t, '["VARCHAR"]') ELSE list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') END AS s FROM f)
SELECT file, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS step FROM l"""

SPOOL = """CASE turn % 4 WHEN 0 THEN '[Codex tool-result spool]' || chr(10) || 'Full raw output scheduled for internal spool: art-' || CAST(turn AS VARCHAR(20)) || '.' || chr(10) || 'path: /tmp/x y.txt' || chr(10) || 'category: test-run' || chr(10) || 'sha256: 0123456789abcdef' || chr(10) || 'chars: 12,345' || chr(10) || chr(10) || text
WHEN 1 THEN '[Forge tool-result spool]' || chr(10) || 'no id here' ELSE text END"""


def spool_envelopes(spark: SparkSession, d: str) -> DataFrame:
    fields = memory.spool(F.col("content"))
    return messages(spark, d).selectExpr("conv_id", "turn", f"{SPOOL} AS content").select("conv_id", "turn", *(v.alias(k) for k, v in fields.items()))


SPOOL_SQL = """SELECT conv_id, turn, CASE WHEN g THEN 'Codex' END AS source, CASE WHEN g THEN 'art-' || turn END AS artifact, CASE WHEN g THEN 'test-run' END AS category, CASE WHEN g THEN '/tmp/x y.txt' END AS path,
CASE WHEN g THEN '0123456789abcdef' END AS sha256, CASE WHEN g THEN 12345 END AS chars, CASE WHEN g THEN substring(text, 1, 2000) END AS digest FROM (SELECT *, turn % 4 = 0 AS g FROM conversations)"""


def point_rows(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    rows = t.selectExpr("session", "pos AS index", "concat('id-', event_id % 3000) AS identity", "event_id AS row")
    points = t.selectExpr("event_id AS point", "session", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE pos + event_id % 2 END AS index", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('id-', event_id % 3000) END AS identity")
    return memory.point_rows(points, rows)


POINT_SQL = f"""WITH {TOUCHES_SQL}, p AS (SELECT event_id AS point, session, CASE WHEN event_id % 3 = 0 THEN NULL ELSE pos + event_id % 2 END AS i, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3000 END AS j FROM touches),
a AS (SELECT point, p.i, p.j, (SELECT list(t.event_id) FROM touches t WHERE t.session = p.session AND t.pos = p.i) AS x, (SELECT list(t.event_id) FROM touches t WHERE t.session = p.session AND t.event_id % 3000 = p.j) AS y FROM p)
SELECT point, CASE WHEN i IS NULL AND j IS NULL THEN NULL WHEN i IS NULL THEN CASE WHEN len(y) = 1 THEN y[1] END WHEN j IS NULL THEN CASE WHEN len(x) = 1 THEN x[1] END WHEN len(x) = 1 AND len(y) = 1 AND x[1] = y[1] THEN x[1] END AS row FROM a"""


def coordinate_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = touches(spark, d).selectExpr("session", "pos AS place", "CASE WHEN event_id % 2 = 0 THEN concat('/repo/', path) ELSE path END AS literal", "CASE WHEN event_id % 4 = 0 THEN event_id % 9 END AS root", f"{CONTEXT} AS context")
    return memory.nominations(rows)


CONTEXT = _pick(["the Target is", "plain", "[x tool-result spool]", "cwd here", "stepwise"], "event_id")
RANK_SQL = f"""WITH {TOUCHES_SQL}, r AS (SELECT session, pos AS place, CASE WHEN event_id % 2 = 0 THEN '/repo/' || path ELSE path END AS literal, CASE WHEN event_id % 4 = 0 THEN event_id % 9 END AS root, event_id % 5 AS c FROM touches),
s AS (SELECT *, CASE WHEN c = 2 THEN -200 ELSE 0 END + CASE WHEN starts_with(literal, '/') THEN 40 ELSE 0 END + CASE WHEN root IS NOT NULL THEN greatest(60, 120 - root * 10) ELSE 0 END + CASE WHEN c IN (0, 3) THEN 30 ELSE 0 END AS score FROM r)
SELECT session, literal, score, row_number() OVER (PARTITION BY session ORDER BY score DESC, place) AS rank FROM s"""


def fitted_lines(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("session").orderBy("pos")
    rows = touches(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 60").selectExpr("session", "CAST(pos AS BIGINT) AS place", "repeat(path, CAST(1 + event_id % 7 AS INT)) AS line")
    return memory.fitted(rows, 400, 30)


FITTED_SQL = f"""WITH RECURSIVE {TOUCHES_SQL}, l AS (SELECT session, pos::BIGINT AS place, len(path) * (1 + event_id % 7) + 1 AS cost, row_number() OVER (PARTITION BY session ORDER BY pos) AS n FROM touches), k AS (SELECT * FROM l WHERE n <= 60),
f AS (SELECT session, n, 30 + cost AS used, [place] AS taken FROM k WHERE n = 1 UNION ALL
SELECT f.session, k.n, CASE WHEN f.used + k.cost <= 400 THEN f.used + k.cost ELSE f.used END, CASE WHEN f.used + k.cost <= 400 THEN list_append(f.taken, k.place) ELSE f.taken END FROM f JOIN k ON k.session = f.session AND k.n = f.n + 1)
SELECT session, used, array_to_string(taken, ',') AS kept, n - len(taken) AS elided FROM (SELECT *, max(n) OVER (PARTITION BY session) AS last FROM f) WHERE n = last"""


QUERIES = {
    "waypoints": (waypoints, WAYPOINT_SQL),
    "covering_literals": (covering_literals, COVER_SQL),
    "query_vectors": (query_vectors, VECTOR_SQL),
    "synonym_stems": (synonym_stems, SYNONYM_SQL),
    "line_deltas": (line_deltas, DELTA_SQL),
    "file_steps": (file_steps, STEPS_SQL),
    "spool_envelopes": (spool_envelopes, SPOOL_SQL),
    "point_rows": (point_rows, POINT_SQL),
    "coordinate_ranks": (coordinate_ranks, RANK_SQL),
    "fitted_lines": (fitted_lines, FITTED_SQL),
}


def _entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Eight touches of a session are an entry; its newest eight touches are the signals of the pass."""
    t = touches(spark, d).withColumn("g", F.floor(F.col("pos") / 8))
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("path"))))
    e = t.groupBy("session", "g").agg(F.array_sort(F.collect_set(F.when(F.col("kind") != "error", F.col("path")))).alias("paths"), pick("mention").alias("tokens"), pick("error").alias("errors"), F.max("pos").alias("recency"), F.min("event_id").alias("e"))
    entries = e.selectExpr("session", "concat('e', e) AS id", "CASE e % 4 WHEN 0 THEN 'spool' WHEN 1 THEN 'tool' ELSE 'turn' END AS kind", "recency", "CASE WHEN e % 3 = 0 THEN array() ELSE paths END AS paths", "tokens", "errors", "e % 9 = 0 AS correction", "e")
    last = t.withColumn("last", F.max("g").over(W.partitionBy("session"))).where("g = last")
    s = last.groupBy("session").agg(pick("edit").alias("touched"), pick("read").alias("claimed"), pick("mention").alias("tokens"), pick("error").alias("errors"), F.max("pos").alias("pass"))
    return entries, s.withColumn("level", F.element_at(F.array(*map(F.lit, ("healthy", "warning", "critical", "auto_compact"))), (F.col("session") % 4 + 1).cast("int")))


def tiered_recall(spark: SparkSession, d: str) -> DataFrame:
    entries, signals = _entries(spark, d)
    resident = entries.where("e % 5 = 0").selectExpr("session", "id", "e % 2 = 0 AS card", "recency + 40 AS until")
    paths = entries.where("e % 7 = 0").select("session", F.explode("paths").alias("path"), (F.col("recency") + 30).alias("until")).groupBy("session", "path").agg(F.max("until").alias("until"))
    dismissed = entries.where("e % 11 = 0").selectExpr("session", "id", "recency + 50 AS until")
    return recall_plan.plan(entries.drop("e"), signals, resident, paths, dismissed)


_SET = "coalesce(list_sort(list_distinct(list(path) FILTER ({}))), [])"
PLAN_SQL = f"""WITH RECURSIVE {TOUCHES_SQL}, t AS (SELECT *, pos // 8 AS g, max(pos // 8) OVER (PARTITION BY session) AS last FROM touches),
e AS (SELECT session, g, min(event_id) AS e, max(pos) AS recency, {_SET.format("kind <> 'error'")} AS p, {_SET.format("kind = 'mention'")} AS tokens, {_SET.format("kind = 'error'")} AS errors FROM t GROUP BY session, g),
n AS (SELECT *, 'e' || e AS id, CASE e % 4 WHEN 0 THEN 'spool' WHEN 1 THEN 'tool' ELSE 'turn' END AS kind, CASE WHEN e % 3 = 0 THEN [] ELSE p END AS paths, e % 9 = 0 AS correction FROM e),
s AS (SELECT session, max(pos) AS pass, {_SET.format("kind = 'edit'")} AS touched, {_SET.format("kind = 'read'")} AS claimed, {_SET.format("kind = 'mention'")} AS st, {_SET.format("kind = 'error'")} AS se FROM t WHERE g = last GROUP BY session),
q AS (SELECT n.*, pass, list_sort(list_intersect(paths, touched))[1] AS a, list_sort(list_intersect(paths, claimed))[1] AS b, CASE WHEN kind = 'spool' THEN list_sort(list_intersect(errors, se))[1] END AS c, CASE WHEN kind <> 'tool' THEN list_sort(list_intersect(tokens, st))[1] END AS k FROM n JOIN s USING (session)),
m AS (SELECT *, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN c IS NOT NULL OR k IS NOT NULL THEN 2 END AS tier, coalesce(a, b, 'error:' || c, 'verbatim:' || k) AS matched FROM q),
r AS (SELECT session, path, max(recency + 30) AS until FROM (SELECT session, recency, unnest(paths) AS path FROM n WHERE e % 7 = 0) GROUP BY ALL),
w AS (SELECT m.*, e % 5 = 0 AND pass < recency + 40 AS here, coalesce(pass < r.until, FALSE) AS there FROM m LEFT JOIN r ON r.session = m.session AND r.path = m.matched WHERE tier IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tier, correction DESC, recency DESC, id) AS place, min(tier) OVER (PARTITION BY session) AS best FROM w WHERE NOT CASE WHEN correction THEN here ELSE (e % 11 = 0 AND pass < recency + 50) OR (there AND tier > 0) OR (here AND e % 2 = 0) END),
u AS (SELECT *, CASE session % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE CASE WHEN best = 0 THEN 1 ELSE 0 END END AS cards FROM o),
f AS (SELECT session, 0::BIGINT AS place, 0 AS c, 0 AS h, 'none' AS how FROM (SELECT DISTINCT session FROM u) UNION ALL
SELECT f.session, u.place, f.c + (NOT u.correction AND u.kind <> 'spool' AND f.c < u.cards)::INT, f.h + (u.correction OR (NOT (u.kind <> 'spool' AND f.c < u.cards) AND f.h < 4))::INT,
CASE WHEN NOT u.correction AND u.kind <> 'spool' AND f.c < u.cards THEN 'card' WHEN u.correction OR f.h < 4 THEN 'hint' ELSE 'none' END FROM f JOIN u ON u.session = f.session AND u.place = f.place + 1)
SELECT u.session, id, tier, matched, u.place, how AS render FROM u JOIN f ON f.session = u.session AND f.place = u.place WHERE how <> 'none'"""

QUERIES["tiered_recall"] = (tiered_recall, PLAN_SQL)


def recall_context(spark: SparkSession, d: str) -> DataFrame:
    """What a pass shows: its cards, then its hints, while their text fits the character budget of the pressure."""
    planned = tiered_recall(spark, d)
    budget = F.element_at(F.array(*map(F.lit, (900, 450, 225, 225))), (F.col("session") % 4 + 1).cast("int"))
    text = F.concat(F.lit("[Recalled from fold — "), "id", F.lit("]"), F.when(F.col("render") == "card", F.concat(F.lit("\n"), "matched", F.lit("\nbody of "), "id", F.lit("\n[End fold recall]"))).otherwise(""))
    order = W.partitionBy("session").orderBy("render", "place").rowsBetween(W.unboundedPreceding, 0)
    shown = planned.withColumn("text", text).withColumn("used", F.sum(F.length("text").cast("long") + 2).over(order)).where(F.col("used") <= budget)
    return shown.groupBy("session").agg(F.count(F.lit(1)).alias("shown"), F.count_if(F.col("render") == "card").alias("cards"), F.max("used").alias("chars"))


CONTEXT_SQL = f"""WITH p AS ({PLAN_SQL}), x AS (SELECT *, '[Recalled from fold — ' || id || ']' || CASE WHEN render = 'card' THEN chr(10) || matched || chr(10) || 'body of ' || id || chr(10) || '[End fold recall]' ELSE '' END AS text FROM p),
u AS (SELECT *, sum(len(text) + 2) OVER (PARTITION BY session ORDER BY render, place ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM x)
SELECT session, count(*) AS shown, count(*) FILTER (render = 'card') AS cards, max(used) AS chars FROM u WHERE used <= [900, 450, 225, 225][session % 4 + 1] GROUP BY session"""

QUERIES["recall_context"] = (recall_context, CONTEXT_SQL)


LOOSE = "CASE event_id % 3 WHEN 0 THEN '{ \"b\" : ' || CAST(event_id AS VARCHAR(20)) || ', \"a\":{\"d\":[2, 1],\"c\":\"' || path || '\"}}' WHEN 1 THEN '[ true,null , {\"z\":1,\"y\":\"é\"} ]' ELSE '{broken' END"
TIGHT = "CASE event_id % 3 WHEN 0 THEN '{\"a\":{\"c\":\"' || path || '\",\"d\":[2,1]},\"b\":' || CAST(event_id AS VARCHAR(20)) || '}' WHEN 1 THEN '[true,null,{\"y\":\"é\",\"z\":1}]' END"


def canonical_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of JSON texts that do not depend on the order of keys or on blanks; none of what is not JSON."""
    rows = touches(spark, d).selectExpr("event_id", f"{LOOSE} AS value")
    return rows.select("event_id", F.sha2(memory.canonical_json(F.col("value")), 256).alias("digest"))


QUERIES["canonical_digests"] = (canonical_digests, f"WITH {TOUCHES_SQL} SELECT event_id, sha256({TIGHT}) AS digest FROM touches")
