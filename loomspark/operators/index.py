"""An index of what is folded, the signals of a boundary, closets of coordinates, and texts put at the end of a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import text as tx

# Keys of a tool's input that name files or folders.
TOUCH_KEYS = ("path", "paths", "file", "files", "file_path", "filePath", "cwd", "workdir")


def touch_set(input_json: Column) -> Column:
    """The paths that a tool's input names, without a leading ``./`` or slash, each once and sorted."""
    texts = [F.when(F.trim(x) != "", F.array(x)) for k in TOUCH_KEYS if not k.endswith("s") for x in (F.get_json_object(input_json, f"$.{k}"),)]
    lists = [F.from_json(F.get_json_object(input_json, f"$.{k}"), "array<string>") for k in TOUCH_KEYS if k.endswith("s")]
    every = F.flatten(F.array_compact(F.array(*texts, *lists)))
    return F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda p: F.trim(p) != ""), lambda p: F.regexp_replace(p, r"^\.?/", ""))))


def tool_paths(calls: DataFrame) -> DataFrame:
    """Distinct paths that the calls of a session (session, input) name."""
    return calls.select("session", F.explode(touch_set(F.col("input"))).alias("path")).distinct()


def fold_index(turns: DataFrame, results: DataFrame) -> DataFrame:
    """One entry a folded turn (session, turn, text) and one a tool result in it (session, turn, pos, path), newest first."""
    t = turns.select("session", F.concat(F.lit("turn:"), "turn").alias("id"), F.lit("turn").alias("kind"), (F.col("turn") * 1000).alias("recency"), F.lit(None).cast("string").alias("path"), F.size(tx.distinctive_terms(F.col("text"))).cast("long").alias("terms"))
    r = results.join(turns.select("session", "turn"), ["session", "turn"], "left_semi").select("session", F.concat(F.lit("result:"), "pos").alias("id"), F.lit("result").alias("kind"), (F.col("turn") * 1000 + 1).alias("recency"), "path", F.lit(0).cast("long").alias("terms"))
    both = t.unionByName(r)
    return both.withColumn("rank", F.row_number().over(W.partitionBy("session").orderBy(F.desc("recency"), "id")))


def boundary_signals(calls: DataFrame, text: DataFrame) -> DataFrame:
    """What a boundary (session, pos, input) brings with the active text (session, pos, text), and whether anything is worth a recall."""
    both = calls.join(text, ["session", "pos"], "left")
    terms = F.size(tx.distinctive_terms(F.coalesce("text", F.lit(""))))
    error = F.coalesce(F.col("text").rlike(r"\b[A-Z][A-Za-z0-9]*(Error|Exception)\b"), F.lit(False))
    token = F.coalesce(F.col("text").rlike(r"[0-9a-f]{12,64}"), F.lit(False))
    paths = touch_set(F.col("input"))
    return both.select("session", "pos", F.array_join(paths, " ").alias("paths"), terms.cast("long").alias("terms"), error.alias("error"), token.alias("token"), ((F.size(paths) > 0) | (terms > 0) | error | token).alias("proceed"))


def active_window(messages: DataFrame, most: int = 1600) -> DataFrame:
    """The first user text of a session and all assistant texts, the last ``most`` characters of them."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    g = messages.groupBy("conv_id").agg(first.alias("first"), said.alias("said"))
    whole = F.concat_ws("\n", "first", F.when(F.col("said") != "", F.col("said")))
    return g.select("conv_id", F.right(whole, F.lit(most)).alias("window"))


def closet(literals: DataFrame, most: int) -> DataFrame:
    """Coordinates of a session (session, literal, pos), each by its newest place, newest first until the budget is full, with its source row."""
    newest = literals.groupBy("session", "literal").agg(F.max("pos").alias("pos"))
    used = F.sum(F.length("literal").cast("long") + 3).over(W.partitionBy("session").orderBy(F.desc("pos"), "literal").rowsBetween(W.unboundedPreceding, 0))
    n = F.row_number().over(W.partitionBy("session").orderBy(F.desc("pos"), "literal"))
    return newest.withColumn("used", used).withColumn("n", n).where(F.col("used") <= most).select("session", "n", "literal", "pos")


def appended(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Messages with a block (conv_id, block) after the text of the newest user message that has one."""
    newest = F.max(F.when((F.col("role") == "user") & (F.col("text") != ""), F.col("turn"))).over(W.partitionBy("conv_id"))
    joined = messages.withColumn("at", newest).join(blocks, "conv_id", "left")
    put = (F.col("turn") == F.col("at")) & F.col("block").isNotNull()
    return joined.select("conv_id", "turn", F.when(put, F.concat("text", F.lit("\n\n"), "block")).otherwise(F.col("text")).alias("text"), F.coalesce(put, F.lit(False)).alias("appended"))


def trace_occurrences(messages: DataFrame, radius: int = 3) -> DataFrame:
    """Places (session, pos, role) with the causal score of their neighbourhood: intent 20, evidence 30, conclusion 30, all three 60 more, a tool 10."""
    w = W.partitionBy("session").orderBy("pos")
    before, after = w.rowsBetween(-radius, 0), w.rowsBetween(-radius, radius)
    intent = F.max(F.when(F.col("role") == "user", F.col("pos"))).over(before)
    tools = F.collect_list(F.when(F.col("role") == "tool", F.col("pos"))).over(after)
    said = F.collect_list(F.when(F.col("role") == "assistant", F.col("pos"))).over(after)
    rows = messages.withColumn("intent", intent).withColumn("tools", tools).withColumn("said", said)
    rows = rows.withColumn("evidence", F.array_min(F.filter("tools", lambda x: x > F.col("intent"))))
    rows = rows.withColumn("conclusion", F.array_min(F.filter("said", lambda x: x > F.col("evidence"))))
    has = lambda c: F.col(c).isNotNull()
    score = F.when(has("intent"), 20).otherwise(0) + F.when(has("evidence"), 30).otherwise(0) + F.when(has("conclusion"), 90).otherwise(0) + F.when(F.col("role") == "tool", 10).otherwise(0)
    return rows.select("session", "pos", score.alias("score"))


def active_cards(zones: DataFrame, touched: DataFrame, shown: DataFrame, most: int = 2) -> DataFrame:
    """Cards of live zones (session, path, value, header) that the boundary touches and no view shows, the most valuable first."""
    live = zones.join(touched.select("session", "path").distinct(), ["session", "path"], "left_semi").join(shown.select("session", "header").distinct(), ["session", "header"], "left_anti")
    rank = F.row_number().over(W.partitionBy("session").orderBy(F.desc("value"), "path"))
    return live.withColumn("rank", rank).where(F.col("rank") <= most).select("session", "path", "rank")


def manifest(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Per key: rows, bytes, and an order-free digest of the texts."""
    low = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text).cast("long")).alias("bytes"), F.sum(low).alias("digest"))


def starred(notes: DataFrame, most: int, header: int) -> DataFrame:
    """The newest notes (session, pos, line) whose lines fit under a header, told in order of time."""
    used = F.sum(F.length("line").cast("long") + 1).over(W.partitionBy("session").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0))
    kept = notes.withColumn("used", used + header).where(F.col("used") <= most)
    return kept.groupBy("session").agg(F.count(F.lit(1)).alias("kept"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def residency_sweep(resident: DataFrame, views: DataFrame, now: Column) -> DataFrame:
    """Resident cards (session, id, header, until, pass): seen ones live on, others until their time."""
    seen = views.select("session", "header").distinct().withColumn("seen", F.lit(True))
    out = resident.join(seen, ["session", "header"], "left")
    return out.select("session", "id", F.when(F.col("seen"), "seen").when(now < F.col("until"), "waiting").otherwise("gone").alias("state"))


def summary_baseline(messages: DataFrame, newest: int, head: int) -> DataFrame:
    """The plain baseline of a rolling summary: heads of all older messages in one line, and the newest as they are."""
    n = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    m = messages.withColumn("n", n)
    old = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > newest, F.struct("turn", "text")))), lambda x: F.substring(x["text"], 1, head)), " | ")
    live = F.sum(F.when(F.col("n") <= newest, F.length("text").cast("long")))
    return m.groupBy("conv_id").agg(old.alias("summary"), F.coalesce(live, F.lit(0)).alias("live_chars"))
