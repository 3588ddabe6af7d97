"""Receipts: what each tool call was, how it ended, and what still stands.

Calls that act, validate, decide, claim or fail become receipts of their own; runs of mere look-ups
become one aggregate a run. Everything is a projection and windows within a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators import decode
from loomspark.operators.segment import islands

# Tools by lane, and commands that run tests, check types or search.
READING, SEARCHING, MOVING, DIRECTING = ("Read", "NotebookRead", "WebFetch"), ("Grep", "Glob", "WebSearch", "ToolSearch"), ("LS", "TodoRead", "chatroom", "task_rail"), ("Agent", "Task")
CLAIMING, DECIDING = ("claim_file", "release_file"), ("record_decision",)
TESTS = r"\b(?:vitest|jest|pytest|mocha|cargo test|go test|npm (?:run )?test|pnpm (?:run )?test)\b"
TYPES = r"\b(?:tsc|mypy|pyright|typecheck)\b"
SEARCH = r"^\s*(?:rg|grep|find|fd|ag)\b"
UNKNOWN_RESULT = r"(?i)^(?:pending|interrupted|cancelled|timed? ?out)\b"


def short_name(name: Column) -> Column:
    """A tool's name without the server it comes from."""
    return F.regexp_replace(name, "^mcp__.*__", "")


def failed(calls: DataFrame) -> Column:
    """Whether a call failed: by its flag, or by how its result opens."""
    return F.col("is_error") | F.ltrim("result").rlike(r"^(?:Error\b|error:|FAILED\b|Traceback )")


def outcome(calls: DataFrame) -> Column:
    """unknown without a result or after an interruption, failed, else applied."""
    result = F.trim("result")
    return F.when((result == "") | result.rlike(UNKNOWN_RESULT), "unknown").when(failed(calls) | result.rlike(r'"ok"\s*:\s*false\b'), "failed").otherwise("applied")


def classify(calls: DataFrame) -> DataFrame:
    """Completed calls with lane (receipt, read, search, navigation, orchestration, other), kind and outcome."""
    name, command = short_name(F.col("name")), F.coalesce(F.get_json_object("input", "$.command"), F.lit(""))
    shell = name == "Bash"
    kind = (
        F.when(name.isin(*DECIDING), "decision").when(name.isin(*CLAIMING), "claim-op").when(name.isin(*decode.ACTING), "file-edit").when(shell & decode.mutates(command), "shell-mutation")
        .when(failed(calls), "tool-error").when((shell & command.rlike(TESTS)) | (name == "run_tests"), "test-run").when(shell & command.rlike(TYPES), "typecheck")
    )
    lane = (
        F.when(kind.isNotNull(), "receipt").when(shell, F.when(command.rlike(SEARCH), "search").otherwise("read")).when(name.isin(*READING), "read").when(name.isin(*SEARCHING), "search")
        .when(name.isin(*MOVING), "navigation").when(name.isin(*DIRECTING), "orchestration").otherwise("other")
    )
    return calls.withColumn("lane", lane).withColumn("kind", kind).withColumn("outcome", outcome(calls)).withColumn("target", decode.path_of(F.col("input")))


def aggregates(classified: DataFrame, most_paths: int = 6, most_queries: int = 4) -> DataFrame:
    """Runs of look-ups of one lane: count, first paths and queries, how many are left out, time bounds, unknown times."""
    w = W.partitionBy("session").orderBy("pos", "tool_id")
    runs = islands(classified.withColumn("_l", F.lag("lane").over(w)), ["session"], ["pos", "tool_id"], ~F.col("_l").eqNullSafe(F.col("lane")), "run").where("lane <> 'receipt'")
    query = F.coalesce(*(F.get_json_object("input", f"$.{k}") for k in ("pattern", "query", "command")))
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("pos", "tool_id", c.alias("v"))))), lambda x: x["v"]))
    g = runs.groupBy("session", "run", "lane").agg(F.count(F.lit(1)).alias("n"), ordered(F.col("target")).alias("paths"), ordered(query).alias("queries"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count_if(F.col("ts_ms").isNull()).alias("unknown_times"))
    left = lambda c, most: F.greatest(F.size(c) - most, F.lit(0))
    return g.select("session", "run", "lane", "n", F.slice("paths", 1, most_paths).alias("paths"), left("paths", most_paths).alias("more_paths"), F.slice("queries", 1, most_queries).alias("queries"), left("queries", most_queries).alias("more_queries"), "first_ms", "last_ms", "unknown_times")


def standing(classified: DataFrame) -> DataFrame:
    """Receipts with whether a later one of the same kind and target supersedes them; failures supersede nothing."""
    w = W.partitionBy("session", "kind", "target").orderBy("pos", "tool_id").rowsBetween(1, W.unboundedFollowing)
    later = F.count_if(F.col("outcome") == "applied").over(w)
    return classified.where("lane = 'receipt'").withColumn("superseded", (later > 0) & F.col("target").isNotNull())


def claims(classified: DataFrame) -> DataFrame:
    """Claims by target: who holds it after the last operation, and whether an unknown outcome needs reconciling."""
    c = classified.where("kind = 'claim-op'").withColumn("op", F.when(short_name(F.col("name")) == "claim_file", "acquire").otherwise("release"))
    known = F.when(F.col("outcome") == "applied", F.struct("pos", "op"))
    g = c.groupBy("session", "target").agg(F.max(known).alias("last"), F.max(F.struct("pos", "outcome")).alias("end"))
    state = F.when(F.col("end.outcome") == "unknown", "unknown").when(F.col("last.op") == "acquire", "held").otherwise("released")
    return g.select("session", "target", state.alias("state"), (F.col("end.outcome") == "unknown").alias("reconcile"))


def validations(classified: DataFrame) -> DataFrame:
    """Test and type runs with their freshness: stale after a later applied change, unknown if they did not end."""
    w = W.partitionBy("session").orderBy("pos", "tool_id").rowsBetween(1, W.unboundedFollowing)
    changed = F.count_if(F.col("kind").isin("file-edit", "shell-mutation") & (F.col("outcome") == "applied")).over(w)
    v = classified.withColumn("changed", changed).where("kind in ('test-run', 'typecheck')")
    return v.select("session", "pos", "tool_id", "kind", "outcome", F.when(F.col("outcome") == "unknown", "unknown").when(F.col("changed") > 0, "stale").otherwise("fresh").alias("freshness"))
