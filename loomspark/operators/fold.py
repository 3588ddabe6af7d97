"""Compaction of a history: old turns become one line or keep their text by budget, the newest stay whole.

The result is a function of the rows alone: no clock, no chance. Levels of retention go from the
newest folded turn to the oldest; adjacent folded turns of one quiet category collapse into one line.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators import budgets, decode

KEEP_TURNS, FULL, ESSENCE, MARK = 20, 4_000, 8_000, "⟨folded⟩"


_FILLER = [
    r"^(Let me|I'll|I will|I need to|I should|I want to|Going to|I'm going to)\b",
    r"^(Okay|OK|Sure|Got it|Understood|Alright|Great|Perfect|Right|Interesting|Good question)\b[.,!]?\s*$",
    r"^(Looking at|Checking|Examining|Investigating|Searching|Now let|Let's see)\b",
    r"^(As (you can see|mentioned|expected|we discussed))\b",
    r"^(I (think|believe|suspect|notice|see) (that )?)",
]
_KEPT = [
    r"\bdecision\b",
    r"\bbecause\b",
    r"\bthe (fix|issue|problem|bug|solution|answer|reason|cause) (is|was)\b",
    r"\bconclu(sion|de)\b",
    r"\bfound (that|the)\b",
    r"\bturns out\b",
    r"→",
    r"\bmu(st|stn't)\b",
    r"\bbreaking change\b",
    r"\bhazard\b",
    r"\b(?:chose|selected|prefer(?:red)?|went with|opt(?:ed)?|decided)\b",
    r"\btrade[- ]?off\b",
    r"\balternative\b",
    r"\binstead of\b",
    r"\brather than\b",
    r"\breject(?:ed|ing)?\b",
    r"\bdue to\b",
    r"^[-*•]\s",
    r"^\d+\.\s",
    r"^#+\s",
    r"^\|",
]
_FILLER, _KEPT = (re.compile("|".join(f"(?:{p})" for p in x), re.I | re.A) for x in (_FILLER, _KEPT))
_units = lambda text: len(text.encode("utf-16-le", "surrogatepass")) // 2


def essence_of(text: str | None) -> str | None:
    """``text`` without filler and without long prose that gives no reason; code and the first line stay. Lengths are in UTF-16 units."""
    if not text or _units(text) < 50:
        return text
    kept, code, first = [], False, False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            code = not code
            kept.append(line)
        elif code:
            kept.append(line)
        elif not bare:
            if kept and kept[-1].strip():
                kept.append("")
        elif not first:
            first = True
            kept.append(line)
        elif _KEPT.search(bare) or not _FILLER.search(bare) and _units(bare) <= 250:
            kept.append(line)
    while kept and not kept[-1].strip():
        kept.pop()
    result, size = "\n".join(kept), _units(text)
    if _units(result) < size * 0.1 and size > 200:
        return text.encode("utf-16-le", "surrogatepass")[: 2 * min(200, size // 5)].decode("utf-16-le", "ignore") + "…"
    return result


def essence(text: F.Column) -> F.Column:
    """``essence_of`` as a column."""
    return F.udf(essence_of, "string", useArrow=True)(text)


def folded_turns(m: DataFrame, keep: int = KEEP_TURNS, full: int = FULL, brief: int = ESSENCE) -> DataFrame:
    """(session, turn, category, level, line) of every turn older than the newest ``keep``."""
    t = decode.turns(m).where("turn > 0")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("role").isin("assistant", "model"), decode.texts(m)).otherwise("").alias("t")))), lambda x: x["t"]), "\n")
    per = t.groupBy("session", "turn").agg(F.trim(said).alias("said"), F.max("pos").alias("last_pos"))
    latest = per.groupBy("session").agg(F.max("turn").alias("turns"))
    old = per.join(latest, "session").where(F.col("turn") <= F.col("turns") - keep)
    old = old.join(decode.categories(m), ["session", "turn"]).withColumn("size", F.length("said").cast("long"))
    level = budgets.retention(old, "session", F.desc("turn"), "size", full, brief)
    ranked = old.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy(F.desc("turn"))))
    calls = decode.tool_calls(m).withColumn("line", decode.skeleton(F.col("name"), F.col("input"), F.col("result")))
    tools = calls.groupBy("session", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("tools"))
    joined = ranked.join(level.select("session", "n", "level"), ["session", "n"]).join(tools, ["session", "turn"], "left")
    body = F.when(F.col("level") == "full", F.col("said")).when(F.col("level") == "essence", essence(F.col("said"))).otherwise("")
    line = F.trim(F.concat_ws(" ", F.concat(F.lit("#"), F.col("turn").cast("string")), "category", "tools", body))
    return joined.select("session", "turn", "category", "level", line.alias("line"), "size")


def collapsed(folded: DataFrame) -> DataFrame:
    """Runs of at least two adjacent turns of one category as one row; actions, errors and decisions stay apart."""
    w = W.partitionBy("session").orderBy("turn")
    quiet = ~F.col("category").isin("action", "decision", "error")
    joins = quiet & F.lag("category").over(w).eqNullSafe(F.col("category"))
    runs = folded.withColumn("_j", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("_j").over(w.rowsBetween(W.unboundedPreceding, 0)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return runs.groupBy("session", "run", "category").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_join(lines, " → ").alias("line"), F.sum("size").alias("saved"))


def view(m: DataFrame, keep: int = KEEP_TURNS, full: int = FULL, brief: int = ESSENCE) -> DataFrame:
    """(session, pos, role, content): the prefix, one message for everything folded, and the newest turns as they are."""
    t = decode.turns(m)
    latest = t.groupBy("session").agg(F.max("turn").alias("turns"))
    marked = t.join(latest, "session")
    whole = marked.where((F.col("turn") == 0) | (F.col("turn") > F.col("turns") - keep)).select("session", F.when(F.col("turn") == 0, F.col("pos")).otherwise(F.col("pos") + 1).alias("pos"), "role", F.coalesce("content", F.get_json_object("raw", "$.content"), F.get_json_object("raw", "$.parts"), F.lit("")).alias("content"))
    lines = collapsed(folded_turns(m, keep, full, brief))
    lines = lines.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_turn", "line"))), lambda x: x["line"]), "\n").alias("body"), F.sum(F.col("last_turn") - F.col("first_turn") + 1).alias("n"), F.sum("saved").alias("saved"))
    start = marked.where((F.col("turn") > 0) & (F.col("turn") <= F.col("turns") - keep)).groupBy("session").agg((F.max("pos") + 1).alias("pos"))
    head = F.concat(F.lit(MARK + " "), F.col("n").cast("string"), F.lit(" turns, "), F.col("saved").cast("string"), F.lit(" characters\n"), F.col("body"))
    return whole.unionByName(lines.join(start, "session").select("session", "pos", F.lit("user").alias("role"), head.alias("content")))


def intra_turn(calls: DataFrame, newest: int = 5, small: int = 500, lookup: int = 8_000) -> DataFrame:
    """Completed calls with ``kept``: the newest of each turn, errors, small results and short look-ups."""
    order = W.partitionBy("session", "turn").orderBy(F.desc("pos"), F.desc("tool_id"))
    kept = (F.row_number().over(order) <= newest) | F.col("is_error") | (F.length("result") < small) | (F.col("name").isin("Grep", "Glob") & (F.length("result") <= lookup))
    return calls.withColumn("kept", kept)
