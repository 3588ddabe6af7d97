"""Budgets, policy, receipts, audits, rails and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import policy as po
from loomspark.operators import budgets, retrieve, segment, stats
from loomspark.plans.session_queries import BURST_SQL
from loomspark.sources.bindings import TOUCHES_SQL, day_bursts, messages, table, touches

ROUND_UP = "floor({0} + 0.5)"


# budgets
def break_budget(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).withColumn("size", F.length("text").cast("long"))
    return budgets.until_full(m, ["conv_id"], [F.desc("turn")], F.col("size"), 2000).select("conv_id", "turn", "size", "used")


def skip_budget_auction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount", "l_partkey", "l_suppkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("tier"), F.col("l_discount").alias("value"), F.col("l_quantity").alias("chars"))
    return budgets.skipping(rows, "l_orderkey", "l_linenumber", [F.col("tier"), F.desc("value"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], "chars", F.lit(60), separator=2, most=4)


AUCTION_SQL = """WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS cost, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem),
    f AS (SELECT l_orderkey, 0::BIGINT AS rank, 0::BIGINT AS used, 0 AS n, false AS selected, NULL::INTEGER AS l_linenumber FROM r WHERE rank = 1
      UNION ALL SELECT r.l_orderkey, r.rank, f.used + CASE WHEN {fits} THEN r.cost + CASE WHEN f.n > 0 THEN 2 ELSE 0 END ELSE 0 END, f.n + ({fits})::INT, {fits}, r.l_linenumber FROM f JOIN r ON r.l_orderkey = f.l_orderkey AND r.rank = f.rank + 1),
    t AS (SELECT l_orderkey, max(n) AS taken FROM f GROUP BY l_orderkey)
    SELECT l_orderkey, l_linenumber, rank, selected, CASE WHEN NOT selected THEN CASE WHEN taken >= 4 THEN 'max_items' ELSE 'budget' END END AS skipped FROM f JOIN t USING (l_orderkey) WHERE rank > 0""".replace("{fits}", "(f.n < 4 AND f.used + r.cost + CASE WHEN f.n > 0 THEN 2 ELSE 0 END <= 60)")


def recency_retention(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where("role = 'assistant'").withColumn("size", F.length("text").cast("long"))
    return budgets.retention(m, "conv_id", F.desc("turn"), "size", 1500, 2500)


RETENTION_SQL = """WITH RECURSIVE m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, len(text)::BIGINT AS size FROM conversations WHERE role = 'assistant'),
    f AS (SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS size, 1500::BIGINT AS f1, 2500::BIGINT AS f2, '' AS level FROM m WHERE n = 1
      UNION ALL SELECT m.conv_id, m.n, m.size, f1 - CASE WHEN m.size > 0 AND f1 >= m.size THEN m.size ELSE 0 END,
        f2 - CASE WHEN m.size > 0 AND f1 < m.size AND f2 >= m.size THEN m.size ELSE 0 END,
        CASE WHEN m.size > 0 AND f1 >= m.size THEN 'full' WHEN m.size > 0 AND f2 >= m.size THEN 'essence' ELSE 'skeleton' END
      FROM f JOIN m ON m.conv_id = f.conv_id AND m.n = f.n + 1)
    SELECT conv_id, n, size, level FROM f WHERE n > 0"""


def intra_turn_keep(spark: SparkSession, d: str) -> DataFrame:
    b = day_bursts(touches(spark, d))
    order = W.partitionBy("session", "burst").orderBy(F.desc("pos"))
    kept = (F.row_number().over(order) <= 5) | (F.col("kind") == "error") | (F.col("value") < 5)
    return b.withColumn("kept", kept).groupBy("session", "burst").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("folded"), F.round(F.sum(F.when(F.col("kept"), 0.0).otherwise(F.col("value"))), 6).alias("saved"))


def eviction_spans(spark: SparkSession, d: str) -> DataFrame:
    b = day_bursts(touches(spark, d)).groupBy("session", "burst").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("session").orderBy(F.desc("burst"))
    slot = F.least(F.row_number().over(order), F.lit(6))
    return b.withColumn("slot", slot).groupBy("session", "slot").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("merged"))


# policy
def utilisation(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    used, level = F.col("o_totalprice"), po.utilisation_level(F.col("o_totalprice"), F.lit(300_000.0))
    o = o.withColumn("level", level)
    return o.select("o_orderkey", "level", po.pressure_budget(F.floor(used / 10), F.col("level")).cast("long").alias("budget"), po.append_band(F.floor(used), F.lit(37_000), F.lit(5_000)).cast("long").alias("band"))


def fold_trigger(spark: SparkSession, d: str) -> DataFrame:
    s = touches(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.floor(F.col("value") * 400)).alias("chars"))
    return s.select("session", "turns", "chars", po.turns_to_fold(F.col("chars"), F.col("turns"), 20, 800_000, 1_500_000, 60).alias("to_fold"))


def freeze_decisions(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("session").orderBy("pos")
    t = touches(spark, d).withColumn("before", F.lag("ms").over(w)).withColumn("kind_before", F.lag("kind").over(w))
    decision = po.freeze_decision(F.col("before").isNotNull(), F.floor((F.col("ms") - F.col("before")) / 100), (F.col("kind") == "mention") & (F.col("kind_before") == "edit"), F.lit(False), F.floor(F.col("value") * 2000))
    return t.select("event_id", decision.alias("decision"))


def zone_values(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    z = t.groupBy("session", "path").agg(F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("visits"), F.count_distinct("kind").alias("depth"), F.max(segment.strength(F.col("kind"))).alias("strength"))
    z = z.withColumn("age", F.max("last_pos").over(W.partitionBy("session")) - F.col("last_pos"))
    value = po.zone_value(F.col("age"), F.col("visits"), F.col("depth"), F.col("strength") / 3, F.col("strength") == 3)
    return z.select("session", "path", F.round(value, 6).alias("value"), po.zone_ttl(F.round(value, 6)).cast("long").alias("ttl"))


def card_ratios(spark: SparkSession, d: str) -> DataFrame:
    shown = F.row_number().over(W.partitionBy("session", "path").orderBy("pos")) - 1
    t = touches(spark, d).withColumn("shown", shown)
    return t.select("event_id", "shown", F.round(po.repeat_ratio(F.col("shown")), 9).alias("ratio"), F.round(po.utility_factor(F.when(F.col("kind") != "error", F.col("value") / 100)), 9).alias("factor"))


def replay_cost(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    m = messages(spark, d).select("conv_id", "turn", F.length("text").cast("long").alias("fresh"), F.coalesce(F.sum(F.length("text").cast("long")).over(w), F.lit(0)).alias("cached"))
    return m.groupBy("conv_id").agg(F.sum("fresh").alias("fresh"), F.sum("cached").alias("cached"), F.round(F.sum(po.input_cost(F.col("fresh"), F.col("cached"), 3.0, 0.3)), 9).alias("usd"))


# joins
def call_result_pairing(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    calls = m.where("role = 'user'").select("conv_id", "turn")
    results = m.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("result_chars"))
    return calls.join(results, ["conv_id", "turn"])


def forward_reference_value(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).withColumn("g", F.floor(F.col("pos") / 5))
    live = t.groupBy("session").agg((F.max("g") - 2).alias("fold"))
    weight = F.when(F.col("kind") == "edit", 4).when(F.col("kind") == "mention", 3).otherwise(1)
    held = t.join(live, "session").groupBy("session", "path", "g", "fold").agg(F.sum(weight * F.when(F.col("g") >= F.col("fold"), 2).otherwise(1)).alias("w"))
    later = F.sum("w").over(W.partitionBy("session", "path").orderBy("g").rowsBetween(1, W.unboundedFollowing))
    return held.withColumn("later", later).where("later is not null and g < fold").groupBy("session", "g").agg(F.sum("later").alias("score"))


def nearest_asof(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    left = t.where("kind = 'edit'").select(F.col("event_id").alias("id"), "session", "ms")
    right = t.where("kind = 'mention'").select(F.col("event_id").alias("other"), "session", "ms")
    return stats.nearest(left, right, "session", "ms", 43_200_000)


def path_affinity(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("set_id"), (F.col("l_partkey") % 200).alias("item"))
    return retrieve.affinity(items, 2).select("a", "b", F.round("score", 9).alias("score"))


def recall_utility(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).where("kind in ('edit', 'read')")
    last = retrieve.best_of(t, ["session", "path", "kind"], [F.desc("pos")])
    g = last.groupBy("path").agg(F.count_if(F.col("kind") == "edit").alias("edits"), F.count(F.lit(1)).alias("uses"), F.round(F.avg(F.when(F.col("kind") == "edit", 1.0).otherwise(0.5)), 9).alias("utility"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("utility"), F.desc("uses"), F.desc("edits"), "path")))


def explicit_range_recall(spark: SparkSession, d: str) -> DataFrame:
    b = day_bursts(touches(spark, d)).groupBy("session", "burst").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
    asked = touches(spark, d).select("session", F.col("pos").alias("lo"), (F.col("pos") + 4).alias("hi"))
    # ranges and bursts meet in stretches of 32 places, each pair in the first one that they share
    cell = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / 32), F.floor(F.col(z) / 32)))
    met = asked.withColumn("cell", cell("lo", "hi")).join(b.withColumn("cell", cell("start", "stop")), ["session", "cell"])
    met = met.where("start <= hi and stop >= lo and cell = greatest(floor(lo / 32), floor(start / 32))")
    return met.groupBy("session", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("burst").alias("first_burst"))


def watch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    ahead = W.partitionBy("session").orderBy("pos").rowsBetween(1, 6)
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("pos"))).over(ahead) - F.col("pos")
    g = t.select("event_id", "kind", first("edit").alias("edit"), first("read").alias("read"), F.count(F.lit(1)).over(ahead).alias("n")).where("kind = 'mention' and n > 0")
    return g.select("event_id", F.when(F.col("edit").isNotNull(), "edited").when(F.col("read").isNotNull(), "echoed").when(F.col("n") < 6, "watching").otherwise("expired").alias("outcome"), F.coalesce("edit", "read").alias("distance"))


# receipts and audits
def newest_per_target(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).where("kind in ('edit', 'error')")
    w = W.partitionBy("session", "path").orderBy(F.desc("pos"))
    r = t.withColumn("n", F.row_number().over(w))
    return r.groupBy("kind").agg(F.count_if(F.expr("n = 1")).alias("standing"), F.count_if(F.expr("n > 1")).alias("superseded"))


def band_audit(spark: SparkSession, d: str) -> DataFrame:
    b = day_bursts(touches(spark, d)).groupBy("session", "burst").agg((F.min("pos") + F.when(F.col("burst") % 5 == 0, 1).when(F.col("burst") % 7 == 0, -1).otherwise(0)).alias("start"), (F.max("pos") + 1).alias("stop"))
    w = W.partitionBy("session").orderBy("burst")
    p = b.withColumn("expected", F.lag("stop").over(w))
    issues = F.array_compact(F.array(F.when(F.col("start") > F.col("expected"), "gap"), F.when(F.col("start") < F.col("expected"), "overlap"), F.when(F.col("stop") <= F.col("start"), "empty")))
    return p.select("session", "burst", F.explode(issues).alias("issue"))


def rail_progress(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    status = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "A", "skipped").otherwise("done")).when(F.col("l_returnflag") == "R", "blocked").otherwise("pending")
    s = line.withColumn("status", status)
    terminal = F.count_if(F.col("status").isin("done", "skipped"))
    return s.groupBy("l_orderkey").agg(
        F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.count_if(F.col("status") == "pending").alias("pending"),
        po.round_half_up(terminal * 100 / F.count(F.lit(1))).cast("long").alias("percent"),
        F.min(F.when(F.col("status") == "blocked", F.col("l_linenumber"))).alias("blocking_step"), F.min(F.when(F.col("status") == "pending", F.col("l_linenumber"))).alias("next_step"))


def rail_sprint(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus").where("l_linestatus = 'O'")
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return line.select("l_orderkey", "l_linenumber", n.alias("n")).where("n <= 3").select("l_orderkey", "l_linenumber", F.when(F.col("n") == 1, "active").otherwise("reserved").alias("status"))


def reconcile_outcomes(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag")
    seen = line.select("l_orderkey", F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("outcome"))
    g = seen.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("outcome")).alias("o"))
    return g.select("l_orderkey", F.when(F.size("o") == 1, F.col("o")[0]).otherwise("unknown").alias("outcome"), (F.size("o") > 1).alias("conflict"))


# statistics
def wilson_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders", "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count(F.lit(1)).alias("n"))
    pct, lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("o_orderpriority", "k", "n", F.round(pct, 9).alias("pct"), F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


def kappa_labels(spark: SparkSession, d: str) -> DataFrame:
    k = stats.kappa(table(spark, d, "labels", "quality", "toxic").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")))
    return k.select("n", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


def upper_median_cost(spark: SparkSession, d: str) -> DataFrame:
    return stats.upper_median(table(spark, d, "orders", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice")


def window_actions(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    w = W.partitionBy("session").orderBy("pos").rowsBetween(1, 20)
    n = lambda k: F.count_if(F.col("kind") == k).over(w)
    again = F.size(F.array_distinct(F.collect_list(F.when(F.col("kind") == "read", F.col("path"))).over(w))).cast("long")
    s = t.select("event_id", "kind", n("edit").alias("edits"), n("read").alias("reads"), again.alias("read_paths"))
    return s.where("kind = 'mention'").drop("kind")


def recovery_scan(spark: SparkSession, d: str) -> DataFrame:
    return stats.next_within(touches(spark, d), "session", "pos", F.col("kind") == "error", F.col("kind") == "edit", F.col("kind") == "mention", 15)


def rate_block(spark: SparkSession, d: str) -> DataFrame:
    s = recovery_scan(spark, d)
    return s.groupBy("session").agg(F.count_if(F.col("status") == "recovered").alias("k"), F.count(F.lit(1)).alias("n"), F.count_if((F.col("status") == "recovered") & (F.col("distance") == 1)).alias("immediate"))


def persistence(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    w = W.partitionBy("session").orderBy("pos")
    near = F.collect_list("path").over(w.rowsBetween(-3, -1))
    p = t.withColumn("cohort", F.lag("kind").over(w)).withColumn("kept", F.array_contains(near, F.col("path"))).where("kind = 'edit' and cohort is not null")
    return p.groupBy("cohort").agg(F.count_if("kept").alias("k"), F.count(F.lit(1)).alias("n"))


def path_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    a = t.where("kind = 'edit'").select("session", F.concat(F.lit("repo/"), "path").alias("a")).distinct()
    b = t.where("kind = 'mention'").select("session", F.col("path").alias("b")).distinct()
    key = F.element_at(F.split("a", "/"), -1)
    met = a.withColumn("leaf", key).join(b.withColumn("leaf", F.element_at(F.split("b", "/"), -1)), ["session", "leaf"]).where(F.expr("a = b or endswith(a, concat('/', b)) or endswith(b, concat('/', a))"))
    return met.groupBy("session").agg(F.count(F.lit(1)).alias("n"))


def cluster_interval(spark: SparkSession, d: str) -> DataFrame:
    return stats.cluster_bootstrap(table(spark, d, "orders", "o_custkey", "o_orderstatus"), "o_custkey", F.col("o_orderstatus") == "F", 5000, 20260608)


T = f"WITH {TOUCHES_SQL}"
B = f"WITH {BURST_SQL}"
SCAN_SQL = f"""{T}, s AS (SELECT session, pos, kind, min(CASE WHEN kind = 'edit' THEN pos END) OVER w AS hit, min(CASE WHEN kind = 'mention' THEN pos END) OVER w AS stop FROM touches WINDOW w AS (PARTITION BY session ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)),
  r AS (SELECT session, pos, CASE WHEN hit IS NOT NULL AND (stop IS NULL OR hit <= stop) THEN 'recovered' WHEN stop IS NOT NULL THEN 'broken' ELSE 'open' END AS status, hit - pos AS d FROM s WHERE kind = 'error'),
  scan AS (SELECT session, pos, status, CASE WHEN status = 'recovered' THEN d END AS distance FROM r)"""
LEVEL_SQL = "CASE WHEN s >= 0.93 THEN 'auto_compact' WHEN s >= 0.88 THEN 'critical' WHEN s >= 0.75 THEN 'warning' ELSE 'healthy' END"
ZONE_SQL = "least(1.0, (power(0.5, age / 6) + least(visits / 5, 1.0) + least(depth / 4, 1.0) + strength / 3) / 4 + CASE WHEN strength = 3 THEN 0.25 ELSE 0.0 END)"
WILSON_SQL = "(100 * ((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) {0} 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)))"

QUERIES = {
    "break_budget": (break_budget, "SELECT conv_id, turn, size, used FROM (SELECT conv_id, turn, len(text) AS size, sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) WHERE used <= 2000"),
    "skip_budget_auction": (skip_budget_auction, AUCTION_SQL),
    "recency_retention": (recency_retention, RETENTION_SQL),
    "intra_turn_keep": (intra_turn_keep, f"{B}, k AS (SELECT *, row_number() OVER (PARTITION BY session, burst ORDER BY pos DESC) <= 5 OR kind = 'error' OR value < 5 AS kept FROM bursts) SELECT session, burst, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS folded, round(sum(CASE WHEN kept THEN 0.0 ELSE value END), 6) AS saved FROM k GROUP BY ALL"),
    "eviction_spans": (eviction_spans, f"{B}, g AS (SELECT session, burst, min(pos) AS start, max(pos) + 1 AS stop, count(*) AS n FROM bursts GROUP BY ALL), s AS (SELECT *, least(row_number() OVER (PARTITION BY session ORDER BY burst DESC), 6) AS slot FROM g) SELECT session, slot, min(start) AS start, max(stop) AS stop, sum(n)::BIGINT AS n, count(*) AS merged FROM s GROUP BY ALL"),
    "utilisation": (utilisation, f"""WITH o AS (SELECT *, {LEVEL_SQL} AS level, floor(o_totalprice / 10)::BIGINT AS chars FROM (SELECT *, o_totalprice / 300000.0 AS s FROM orders))
      SELECT o_orderkey, level, CASE level WHEN 'healthy' THEN chars WHEN 'warning' THEN chars // 2 WHEN 'critical' THEN chars // 4 ELSE least(800, chars // 4) END AS budget,
      least(25000, greatest(5000, floor((floor(o_totalprice) - 37000) * 0.18 + 0.5)))::BIGINT AS band FROM o"""),
    "fold_trigger": (fold_trigger, f"""{T}, s AS (SELECT session, count(*) AS turns, sum(floor(value * 400))::BIGINT AS chars FROM touches GROUP BY session)
      SELECT session, turns, chars, (CASE WHEN turns <= 20 THEN 0 WHEN chars >= 1500000 THEN greatest(ceil((turns - 20) * 0.6), 1) WHEN chars >= 800000 THEN greatest(ceil((turns - 20) * 0.3), 1) WHEN turns > 60 THEN least(turns - 20, turns - 40) ELSE 0 END)::BIGINT AS to_fold FROM s"""),
    "freeze_decisions": (freeze_decisions, f"""{T}, l AS (SELECT *, lag(ms) OVER w AS b, lag(kind) OVER w AS k FROM touches WINDOW w AS (PARTITION BY session ORDER BY pos))
      SELECT event_id, CASE WHEN b IS NULL THEN 'first-call' WHEN (ms - b) // 100 > 300000 THEN 'cold-gap' WHEN kind = 'mention' AND k = 'edit' THEN 'context-changed' WHEN floor(value * 2000) > 150000 THEN 'tail-epoch' ELSE 'reuse' END AS decision FROM l"""),
    "zone_values": (zone_values, f"""{T}, z AS (SELECT session, path, max(pos) AS last_pos, count(*) AS visits, count(DISTINCT kind) AS depth, max(CASE kind WHEN 'edit' THEN 3 WHEN 'read' THEN 2 WHEN 'mention' THEN 1 ELSE 0 END) AS strength FROM touches GROUP BY ALL),
      a AS (SELECT *, max(last_pos) OVER (PARTITION BY session) - last_pos AS age FROM z), v AS (SELECT session, path, round({ZONE_SQL}, 6) AS value FROM a)
      SELECT session, path, value, greatest(1, floor(CASE WHEN value <= 0.5 THEN 0.5 + value ELSE 2 * value END * 8 + 0.5))::BIGINT AS ttl FROM v"""),
    "card_ratios": (card_ratios, f"{T}, s AS (SELECT *, (row_number() OVER (PARTITION BY session, path ORDER BY pos) - 1)::INT AS shown FROM touches) SELECT event_id, shown, round(greatest(0.35, power(0.6, shown)), 9) AS ratio, round(CASE WHEN kind = 'error' THEN 1.0 ELSE 0.75 + 0.5 * least(greatest(value / 100, 0.0), 1.0) END, 9)::DOUBLE AS factor FROM s"),
    "replay_cost": (replay_cost, "WITH m AS (SELECT conv_id, len(text) AS fresh, coalesce(sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cached FROM conversations) SELECT conv_id, sum(fresh)::BIGINT AS fresh, sum(cached)::BIGINT AS cached, round(sum(fresh / 1e6 * 3.0 + cached / 1e6 * 0.3), 9) AS usd FROM m GROUP BY conv_id"),
    "call_result_pairing": (call_result_pairing, "SELECT a.conv_id, a.turn, len(b.text) AS result_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"),
    "forward_reference_value": (forward_reference_value, f"""{T}, t AS (SELECT *, pos // 5 AS g FROM touches), live AS (SELECT session, max(g) - 2 AS fold FROM t GROUP BY session), own AS (SELECT DISTINCT session, g, path FROM t)
      SELECT o.session, o.g, sum(CASE r.kind WHEN 'edit' THEN 4 WHEN 'mention' THEN 3 ELSE 1 END * CASE WHEN r.g >= fold THEN 2 ELSE 1 END)::BIGINT AS score FROM own o JOIN t r ON r.session = o.session AND r.path = o.path AND r.g > o.g JOIN live l ON l.session = o.session WHERE o.g < fold GROUP BY ALL"""),
    "nearest_asof": (nearest_asof, f"""{T}, p AS (SELECT a.event_id AS id, b.event_id AS other, abs(a.ms - b.ms) AS distance, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.ms - b.ms), b.ms, b.event_id) AS n FROM touches a JOIN touches b ON a.session = b.session WHERE a.kind = 'edit' AND b.kind = 'mention' AND abs(a.ms - b.ms) <= 43200000) SELECT id, other, distance FROM p WHERE n = 1"""),
    "path_affinity": (path_affinity, "WITH s AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 200 AS i FROM lineitem), c AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.i <> y.i GROUP BY ALL) SELECT a, b, round(n / (SELECT max(n) FROM c), 9) AS score FROM c WHERE n >= 2"),
    "recall_utility": (recall_utility, f"{T}, l AS (SELECT DISTINCT session, path, kind FROM touches WHERE kind IN ('edit', 'read')), g AS (SELECT path, count(*) FILTER (kind = 'edit') AS edits, count(*) AS uses, round(avg(CASE WHEN kind = 'edit' THEN 1.0 ELSE 0.5 END), 9) AS utility FROM l GROUP BY path) SELECT *, row_number() OVER (ORDER BY utility DESC, uses DESC, edits DESC, path) AS rank FROM g"),
    "explicit_range_recall": (explicit_range_recall, f"{B}, e AS (SELECT session, burst, min(pos) AS start, max(pos) AS stop FROM bursts GROUP BY ALL) SELECT t.session, t.pos AS lo, count(*) AS n, min(burst) AS first_burst FROM touches t JOIN e ON e.session = t.session AND start <= t.pos + 4 AND stop >= t.pos GROUP BY ALL"),
    "watch_outcomes": (watch_outcomes, f"""{T}, g AS (SELECT c.event_id, min(t.pos - c.pos) FILTER (t.kind = 'edit') AS e, min(t.pos - c.pos) FILTER (t.kind = 'read') AS r, count(*) AS n FROM touches c JOIN touches t ON t.session = c.session AND t.pos BETWEEN c.pos + 1 AND c.pos + 6 WHERE c.kind = 'mention' GROUP BY c.event_id)
      SELECT event_id, CASE WHEN e IS NOT NULL THEN 'edited' WHEN r IS NOT NULL THEN 'echoed' WHEN n < 6 THEN 'watching' ELSE 'expired' END AS outcome, coalesce(e, r) AS distance FROM g"""),
    "newest_per_target": (newest_per_target, f"{T}, r AS (SELECT kind, row_number() OVER (PARTITION BY session, path ORDER BY pos DESC) AS n FROM touches WHERE kind IN ('edit', 'error')) SELECT kind, count(*) FILTER (n = 1) AS standing, count(*) FILTER (n > 1) AS superseded FROM r GROUP BY kind"),
    "band_audit": (band_audit, f"""{B}, g AS (SELECT session, burst, min(pos) + CASE WHEN burst % 5 = 0 THEN 1 WHEN burst % 7 = 0 THEN -1 ELSE 0 END AS start, max(pos) + 1 AS stop FROM bursts GROUP BY session, burst), p AS (SELECT *, lag(stop) OVER (PARTITION BY session ORDER BY burst) AS want FROM g)
      SELECT session, burst, 'gap' AS issue FROM p WHERE start > want UNION ALL SELECT session, burst, 'overlap' FROM p WHERE start < want UNION ALL SELECT session, burst, 'empty' FROM p WHERE stop <= start"""),
    "rail_progress": (rail_progress, """WITH s AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'A' THEN 'skipped' ELSE 'done' END WHEN l_returnflag = 'R' THEN 'blocked' ELSE 'pending' END AS status FROM lineitem)
      SELECT l_orderkey, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'pending') AS pending, floor(count(*) FILTER (status IN ('done', 'skipped')) * 100 / count(*) + 0.5)::BIGINT AS percent,
      min(l_linenumber) FILTER (status = 'blocked') AS blocking_step, min(l_linenumber) FILTER (status = 'pending') AS next_step FROM s GROUP BY l_orderkey"""),
    "rail_sprint": (rail_sprint, "SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN 'active' ELSE 'reserved' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_linestatus = 'O') WHERE n <= 3"),
    "reconcile_outcomes": (reconcile_outcomes, "WITH g AS (SELECT l_orderkey, list(DISTINCT l_linestatus) FILTER (l_returnflag <> 'N') AS o FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN len(o) = 1 THEN o[1] ELSE 'unknown' END AS outcome, coalesce(len(o), 0) > 1 AS conflict FROM g"),
    "wilson_by_stratum": (wilson_by_stratum, f"WITH g AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, k, n, round(100 * (k / n), 9) AS pct, round({WILSON_SQL.format('-')}, 9) AS lo, round({WILSON_SQL.format('+')}, 9) AS hi FROM g"),
    "kappa_labels": (kappa_labels, "WITH l AS (SELECT quality AS a, 1 - toxic AS b FROM labels), t AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS agree FROM l), e AS (SELECT sum(x.c * y.c)::BIGINT AS cross_ FROM (SELECT a, count(*) AS c FROM l GROUP BY a) x JOIN (SELECT b, count(*) AS c FROM l GROUP BY b) y ON x.a = y.b), r AS (SELECT n, agree / n AS o, cross_ / (n * n) AS e FROM t, e) SELECT n, round(o, 9) AS observed, round(e, 9) AS expected, round((o - e) / (1 - e), 9) AS kappa FROM r"),
    "upper_median_cost": (upper_median_cost, "SELECT o_orderpriority, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median FROM orders GROUP BY o_orderpriority"),
    "window_actions": (window_actions, f"{T}, w AS (SELECT event_id, kind, count(*) FILTER (kind = 'edit') OVER x AS edits, count(*) FILTER (kind = 'read') OVER x AS reads, coalesce(len(list_distinct(list(CASE WHEN kind = 'read' THEN path END) OVER x)), 0) AS read_paths FROM touches WINDOW x AS (PARTITION BY session ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)) SELECT event_id, edits, reads, read_paths FROM w WHERE kind = 'mention'"),
    "recovery_scan": (recovery_scan, f"{SCAN_SQL} SELECT * FROM scan"),
    "rate_block": (rate_block, f"{SCAN_SQL} SELECT session, count(*) FILTER (status = 'recovered') AS k, count(*) AS n, count(*) FILTER (status = 'recovered' AND distance = 1) AS immediate FROM scan GROUP BY session"),
    "persistence": (persistence, f"{T}, l AS (SELECT *, lag(kind) OVER w AS cohort, lag(path, 1) OVER w AS p1, lag(path, 2) OVER w AS p2, lag(path, 3) OVER w AS p3 FROM touches WINDOW w AS (PARTITION BY session ORDER BY pos)) SELECT cohort, count(*) FILTER (path = p1 OR path = p2 OR path = p3) AS k, count(*) AS n FROM l WHERE kind = 'edit' AND cohort IS NOT NULL GROUP BY cohort"),
    "path_suffix_match": (path_suffix_match, f"{T}, a AS (SELECT DISTINCT session, 'repo/' || path AS a FROM touches WHERE kind = 'edit'), b AS (SELECT DISTINCT session, path AS b FROM touches WHERE kind = 'mention') SELECT session, count(*) AS n FROM a JOIN b USING (session) WHERE a = b OR ends_with(a, '/' || b) OR ends_with(b, '/' || a) GROUP BY session"),
    "cluster_interval": (cluster_interval, ""),
}
