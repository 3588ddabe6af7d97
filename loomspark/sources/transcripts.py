"""Sources and sinks of conversations: JSON lines in, linked JSON lines out.

Readers keep the raw line beside its place, so that decoding stays a projection. Writers go to a
staging folder by Spark's committer, which publishes whole outputs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a provider's log: kind, text, tool name, tool input, time, id, streaming flag.
ROW = "session string, pos long, ty string, tx string, tn string, ti string, toolUseId string, isError boolean, ts string, id string, sg boolean"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Transcript rows from JSON lines; lines that cannot be parsed are dropped."""
    return spark.read.schema(ROW).option("mode", "DROPMALFORMED").json(path)


def read_messages(spark: SparkSession, path: str, session: str) -> DataFrame:
    """(session, pos, raw) of a text file with a message a line; pos follows the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    order = W.partitionBy("file").orderBy("at")
    return lines.where("value <> ''").select(F.lit(session).alias("session"), (F.row_number().over(order) - 1).alias("pos"), F.col("value").alias("raw"))


def within_budget(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """The newest rows of each session whose running weight fits; the newest always stays."""
    newest = W.partitionBy("session").orderBy(F.desc("pos"))
    used = F.sum(weight).over(newest.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_u", used).withColumn("_n", F.row_number().over(newest)).where((F.col("_u") <= most) | (F.col("_n") == 1)).drop("_u", "_n")


def alternating(rows: DataFrame, most: int = 600_000) -> DataFrame:
    """Transcript rows as strictly alternating messages: session, pos, role, content.

    Reasoning, system and streaming rows are left out; consecutive rows of a role merge, joined by
    blank lines. The newest messages that fit ``most`` characters stay.
    """
    role = F.when(F.col("ty") == "user", "user").when(F.col("ty").isin("assistant_text", "tool_use", "tool_result"), "assistant")
    text = F.when(F.col("ty") == "tool_use", F.concat(F.lit("⟨tool "), F.coalesce("tn", F.lit("")), F.lit("⟩ "), F.coalesce("ti", F.lit("")))).when(F.col("ty") == "tool_result", F.concat(F.lit("⟨result⟩ "), F.coalesce("tx", F.lit("")))).otherwise(F.col("tx"))
    said = rows.where(~F.coalesce(F.col("sg"), F.lit(False))).select("session", "pos", role.alias("role"), text.alias("text")).where("role is not null and text <> ''")
    w = W.partitionBy("session").orderBy("pos")
    opens = F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)
    numbered = said.withColumn("_o", opens).withColumn("run", F.sum("_o").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    merged = numbered.groupBy("session", "run", "role").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("content"))
    merged = merged.select("session", F.col("run").alias("pos"), "role", "content")
    return within_budget(merged, F.length("content").cast("long"), most)


def newest_measured(records: DataFrame, newest: int = 6) -> DataFrame:
    """(session, pos, tokens): of the newest records with token counts, the one of largest count."""
    order = W.partitionBy("session").orderBy(F.desc("pos"))
    kept = records.where("tokens is not null").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= newest)
    return kept.groupBy("session").agg(F.max_by("pos", F.struct("tokens", "pos")).alias("pos"), F.max("tokens").alias("tokens"))


def linked(messages: DataFrame, started: str) -> DataFrame:
    """Messages (session, pos, role, content) as JSON lines that name their predecessor, a second apart."""
    w = W.partitionBy("session").orderBy("pos")
    uuid = F.sha2(F.concat_ws("|", "session", F.col("pos").cast("string"), "role", "content"), 256)
    rows = messages.withColumn("uuid", F.concat_ws("-", F.substring(uuid, 1, 8), F.substring(uuid, 9, 4), F.substring(uuid, 13, 4), F.substring(uuid, 17, 4), F.substring(uuid, 21, 12)))
    rows = rows.withColumn("parentUuid", F.lag("uuid").over(w)).withColumn("n", F.row_number().over(w) - 1)
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(started))) + F.col("n")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.to_json(F.struct("parentUuid", "uuid", F.col("session").alias("sessionId"), at.alias("timestamp"), F.col("role").alias("type"), F.struct("role", "content").alias("message")))
    return rows.select("session", "pos", line.alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One folder a session, lines in their order."""
    lines.repartition("session").sortWithinPartitions("session", "pos").select("session", "value").write.mode("overwrite").partitionBy("session").text(path)


def snapshot(files: DataFrame, before: DataFrame, most: int = 16_384) -> DataFrame:
    """(path, content) with a digest of at most ``most`` bytes, and whether it is as in ``before`` (path, digest)."""
    now = files.select("path", F.left(F.sha2(F.substring("content", 1, most), 256), F.lit(16)).alias("digest"))
    old = before.select("path", F.col("digest").alias("old"))
    return now.join(old, "path", "left").select("path", "digest", F.coalesce(F.col("digest") == F.col("old"), F.lit(False)).alias("stable"))
