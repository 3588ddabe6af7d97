"""Reference-shaped rows from the fixed tables: messages, touches, transcript chunks.

Each reader narrows its table at the scan. ``*_SQL`` are the same rows as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators import episodes, segment

#: Event types as kinds of touch.
KINDS = (("purchase", "edit"), ("view", "read"), ("click", "read"), ("signup", "mention"), ("error", "error"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text."""
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, pos (from 0 in time order), event_id, ts, ms, path, kind, value."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    kind = F.when(F.lit(False), F.lit(""))
    for name, k in KINDS:
        kind = kind.when(F.col("event_type") == name, k)
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    path = F.concat(F.lit("src/mod"), F.get_json_object("props", "$.k"), F.lit(".ts"))
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return e.select(F.col("user_id").alias("session"), (F.row_number().over(order) - 1).alias("pos"), "event_id", "ts", ms.alias("ms"), path.alias("path"), kind.alias("kind"), "value")


#: Touches of the fixed tables are hours apart, so their bursts end after a day, not after the twenty minutes of a live session.
TABLE_GAP_MS = 86_400_000


def day_bursts(rows: DataFrame) -> DataFrame:
    """Bursts of touches of the fixed tables."""
    return segment.bursts(rows, TABLE_GAP_MS)


def day_episodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes and members of touches of the fixed tables."""
    return episodes.capture(rows, TABLE_GAP_MS)


TOUCHES_SQL = """touches AS (
  SELECT user_id AS session, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS pos, event_id, ts,
         epoch_us(ts) // 1000 AS ms, 'src/mod' || (props->>'$.k') || '.ts' AS path,
         CASE event_type WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'mention' WHEN 'error' THEN 'error' ELSE 'read' END AS kind, value
  FROM events)"""
