"""What is kept of a session: waypoints, literals that cover others, query vectors, synonyms, line deltas, recorded steps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import text as tx

#: Newest durable waypoints and newest flow notes that a fold keeps, and the longest text of a note.
DURABLE, FLOW, NOTE = 20, 6, 240
FINAL, PASSING = ("verdict", "hazard"), ("in_progress", "working", "executing")


def waypoints(said: DataFrame) -> DataFrame:
    """Waypoints of assistant texts (session, pos, text, register): the newest durable ones and the newest short flow notes.

    A later durable waypoint supersedes an earlier flow note.
    """
    durable = F.col("register").isin(*FINAL)
    lane = F.when(durable, "durable").when(F.length("text") <= NOTE, "transient")
    rows = said.withColumn("lane", lane).where("lane is not null")
    newest = W.partitionBy("session", "lane").orderBy(F.desc("pos"))
    kept = rows.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= F.when(F.col("lane") == "durable", DURABLE).otherwise(FLOW))
    after = W.partitionBy("session").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    newer = F.min(F.when(F.col("lane") == "durable", F.col("pos"))).over(after)
    headline = F.substring(F.regexp_replace(F.substring_index(F.trim("text"), "\n", 1), r"\s+", " "), 1, 120)
    return kept.select("session", "pos", "lane", headline.alias("headline"), F.when(F.col("lane") == "transient", newer).alias("superseded_by"))


def covering_literals(literals: DataFrame) -> DataFrame:
    """Literals (session, literal) without those that another one covers: the same with a leading slash, or a longer path that ends in it.

    Each literal offers the ends of its path, and a literal that is offered by another goes: one join on
    equal texts, whose rows grow with the depth of paths, instead of a comparison of all pairs.
    """
    own = literals.select("session", F.trim("literal").alias("literal")).where("literal <> ''").distinct()
    keyed = own.withColumn("key", F.when(F.col("literal").startswith("/"), F.substring("literal", 2, 1 << 20)).otherwise(F.col("literal")))
    one = keyed.groupBy("session", "key").agg(F.max(F.struct(F.col("literal").startswith("/").alias("rooted"), "literal")).alias("x")).select("session", "key", F.col("x.literal").alias("literal"))
    parts = F.split("key", "/")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    offered = one.where(F.size(parts) > 1).select("session", F.explode(ends).alias("key")).distinct()
    return one.join(offered, ["session", "key"], "left_anti").select("session", "literal")


def query_vector(queries: DataFrame, idf: DataFrame, hints: DataFrame, hint_weight: float = 3.0) -> DataFrame:
    """(query, dim, w) of query texts: (1 + ln tf) idf of known tokens of positive idf, and 3 for each hinted file."""
    tf = queries.select("query", F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("query", "token").agg(F.count(F.lit(1)).alias("tf"))
    words = tf.join(idf.where("idf > 0").select("token", "idf"), "token").select("query", F.col("token").alias("dim"), ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    return words.unionByName(hints.select("query", F.concat(F.lit("file:"), "file").alias("dim"), F.lit(hint_weight).alias("w")).distinct())


def with_synonyms(stems: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(key, stem) and, once each, what a table (stem, synonym) adds; with an empty table the stems alone."""
    more = stems.join(synonyms, "stem").select("key", F.col("synonym").alias("stem"))
    return stems.select("key", "stem").unionByName(more).distinct()


def line_delta(old: Column, new: Column) -> tuple[Column, Column, Column]:
    """Equal lines at the start, equal lines at the end of what is left, and whether the texts are alike enough to compare.

    At least 15 % of the shorter text, and one line, must be common.
    """
    a, b = F.split(old, "\n"), F.split(new, "\n")
    shorter = F.least(F.size(a), F.size(b))
    run = lambda x, y, most: F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, i: F.struct((s["n"] + F.when(s["on"] & (i <= most) & (F.try_element_at(x, i) == F.try_element_at(y, i)), 1).otherwise(0)).alias("n"), (s["on"] & F.coalesce(F.try_element_at(x, i) == F.try_element_at(y, i), F.lit(False))).alias("on")))["n"]
    pre = run(a, b, shorter)
    post = run(F.reverse(a), F.reverse(b), shorter - pre)
    return pre, post, (pre + post) >= F.greatest(F.lit(1), F.ceil(0.15 * shorter))


def steps_of(files: DataFrame) -> DataFrame:
    """Steps of a file's text (file, text): the items of a JSON array, or one step a line that is not blank."""
    whole = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    listed = F.from_json(whole, "array<string>")
    lines = F.filter(F.transform(F.split(whole, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cell = F.when(whole.startswith("["), listed).otherwise(lines)
    return files.select("file", F.posexplode(cell).alias("n", "step")).select("file", F.col("n").cast("long").alias("n"), "step")


def spool(content: Column) -> dict[str, Column]:
    """Fields of a spooled result's envelope; all null where its header or id is missing."""
    line = lambda p: F.regexp_extract(content, r"(?:^|\n)" + p + r"(?:\n|$)", 1)
    source, ident = line(r"\[([A-Za-z][A-Za-z0-9_-]*) tool-result spool\]"), line(r"Full raw output scheduled for internal spool: ([^\s]+)\.")
    good = (source != "") & (ident != "")
    at = F.instr(content, "\n\n")
    fields = {
        "source": source, "artifact": ident, "category": F.nullif(line(r"category: ([a-z0-9][a-z0-9-]{0,79})"), F.lit("")), "path": F.trim(line(r"path: ([^\n]+)")), "sha256": line(r"sha256: ([0-9a-f]{16,64})"),
        "chars": F.regexp_replace(line(r"chars: ([0-9,]+)"), ",", "").try_cast("long"), "digest": F.when(at > 0, F.substring(content, at + 2, F.lit(2000))).otherwise(""),
    }
    return {k: F.when(good, v) for k, v in fields.items()}


def canonical_json(value: Column) -> Column:
    """A JSON text with sorted keys and no blanks, whatever its depth; null for what is not JSON. Arrow batches, not rows."""
    return F.udf(_canonical, "string", useArrow=True)(value)


def _canonical(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text, parse_constant=lambda _: None), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def point_rows(points: DataFrame, rows: DataFrame) -> DataFrame:
    """The row of each point (point, session, index or null, identity or null): by both where both are given, which must agree and be one row."""
    by_index = points.where("index is not null").join(rows.select("session", F.col("index"), F.col("row").alias("row")), ["session", "index"]).select("point", "row")
    by_identity = points.where("identity is not null").join(rows.select("session", "identity", "row"), ["session", "identity"]).select("point", "row")
    found = by_index.select("point", "row", F.lit(1).alias("i"), F.lit(0).alias("j")).unionByName(by_identity.select("point", "row", F.lit(0).alias("i"), F.lit(1).alias("j")))
    per = found.groupBy("point").agg(F.count_distinct("row").alias("rows"), F.min("row").alias("row"), F.sum("i").alias("i"), F.sum("j").alias("j"))
    out = points.join(per, "point", "left")
    asked_i, asked_j = F.col("index").isNotNull().cast("int"), F.col("identity").isNotNull().cast("int")
    sure = (F.col("rows") == 1) & (F.col("i") == asked_i) & (F.col("j") == asked_j)
    return out.select("point", F.when(sure, F.col("row")).alias("row"))


def nominations(literals: DataFrame) -> DataFrame:
    """Coordinates (session, place, literal, root or null, context): absolute ones, those under preferred roots and in telling contexts first."""
    score = (
        F.when(F.col("context").rlike(r"(?i)tool-result spool"), -200).otherwise(0) + F.when(F.col("literal").startswith("/"), 40).otherwise(0)
        + F.when(F.col("root").isNotNull(), F.greatest(F.lit(60), 120 - F.col("root") * 10)).otherwise(0) + F.when(F.lower("context").rlike(r"\b(rail|step|file_path|target|workspace|cwd|source|trace|session|instance|commit)\b"), 30).otherwise(0)
    )
    ranked = literals.withColumn("score", score)
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("session").orderBy(F.desc("score"), "place"))).select("session", "literal", "score", "rank")


def fitted(rows: DataFrame, budget: int, header: int) -> DataFrame:
    """Lines (session, place, line) that fit a budget in order, later ones passed over one by one; the first always stays.

    The first line is a fixed cost of its session; the others are chosen greedily by a fold over the
    session's lines, of which the caller bounds the number.
    """
    sized = rows.withColumn("cost", F.length("line").cast("long") + 1)
    listed = sized.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("place", "cost"))).alias("items"))
    step = lambda s, x: F.when((s["used"] + x["cost"] <= budget) | (F.size(s["taken"]) == 0), F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["taken"], F.array(x["place"])).alias("taken"))).otherwise(s)
    start = F.struct(F.lit(header).cast("long").alias("used"), F.array().cast("array<long>").alias("taken"))
    kept = listed.select("session", F.aggregate("items", start, step).alias("s"), F.size("items").alias("n"))
    return kept.select("session", F.col("s.used").alias("used"), F.array_join(F.transform("s.taken", lambda x: x.cast("string")), ",").alias("kept"), (F.col("n") - F.size("s.taken")).cast("long").alias("elided"))
