"""Logs, vaults and sections for a successor session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as tx
from loomspark.operators import seeds
from loomspark.sources.bindings import messages

_GLYPHS = [r[0] for r in tx.REGISTERS]
MARKED_SQL = f"m AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN ([{', '.join(f"'{g}'" for g in _GLYPHS)}, '-'])[((conv_id * 7 + turn) % 6 + 1)::INTEGER] || ' ' || text ELSE text END AS text FROM conversations)"


def marked(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose assistant rows open with a glyph by their place."""
    glyphs = F.array(*map(F.lit, _GLYPHS), F.lit("-"))
    glyph = F.element_at(glyphs, (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(6)) + 1).cast("int"))
    return messages(spark, d).withColumn("text", F.when(F.col("role") == "assistant", F.concat(glyph, F.lit(" "), F.col("text"))).otherwise(F.col("text")))


def lineage_log(spark: SparkSession, d: str) -> DataFrame:
    return seeds.register_log(marked(spark, d), ("verdict", "hazard"), 300)


def open_questions(spark: SparkSession, d: str) -> DataFrame:
    return seeds.register_log(marked(spark, d), ("blocked",), 250)


def vault_rows(spark: SparkSession, d: str) -> DataFrame:
    return seeds.vault(marked(spark, d), users=2, assistants=1).select("conv_id", "turn", "role")


def section_allocation(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    sections = m.select(F.col("conv_id").alias("key"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("section"), F.pmod(F.col("turn") * 3, F.lit(4)).alias("priority"), F.col("turn").alias("place"), F.col("text").alias("body"))
    got = seeds.allocate(sections, 1500)
    return got.select("key", "sections", F.sha2("text", 256).alias("text_sha256"))


def truncation_baseline(spark: SparkSession, d: str) -> DataFrame:
    kept = seeds.newest_turns(messages(spark, d), 2)
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"), F.sum(F.length("text").cast("long")).alias("chars"))


def _log_sql(registers: str, budget: int) -> str:
    return f"""WITH {MARKED_SQL}, l AS (SELECT conv_id, turn, {tx.register_sql('text')} AS register, left(string_split(text, chr(10))[1], 200) AS line FROM m WHERE role = 'assistant'),
      u AS (SELECT *, sum(len(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM l WHERE register IN ({registers})) SELECT conv_id, turn, register, line FROM u WHERE used <= {budget}"""


SECTION_SQL = """WITH RECURSIVE r AS (SELECT conv_id, turn, text, len(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY (turn * 3) % 4, turn) AS rank FROM conversations WHERE len(text) >= 48),
    f AS (SELECT DISTINCT conv_id, 0::BIGINT AS rank, 0::BIGINT AS used, false AS took, NULL::BIGINT AS turn, NULL::VARCHAR AS text FROM r
      UNION ALL SELECT r.conv_id, r.rank, f.used + CASE WHEN {fits} THEN r.chars + CASE WHEN f.used > 0 THEN 2 ELSE 0 END ELSE 0 END, {fits}, r.turn, r.text FROM f JOIN r ON r.conv_id = f.conv_id AND r.rank = f.rank + 1)
    SELECT conv_id AS key, string_agg('s' || turn, ',' ORDER BY turn) AS sections, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_sha256 FROM f WHERE took GROUP BY conv_id""".replace("{fits}", "(f.used + r.chars + CASE WHEN f.used > 0 THEN 2 ELSE 0 END <= 1500)")

QUERIES = {
    "lineage_log": (lineage_log, _log_sql("'verdict', 'hazard'", 300)),
    "open_questions": (open_questions, _log_sql("'blocked'", 250)),
    "vault_rows": (vault_rows, f"""WITH {MARKED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n, {tx.register_sql('text')} AS g FROM m),
      a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE g WHEN 'verdict' THEN 4 WHEN 'hazard' THEN 3 WHEN 'blocked' THEN 2 WHEN 'in_progress' THEN 1 ELSE 0 END DESC, turn DESC) AS k FROM n WHERE role = 'assistant' AND n <= 24)
      SELECT conv_id, turn, role FROM n WHERE role = 'user' AND n <= 2 UNION ALL SELECT conv_id, turn, role FROM a WHERE k <= 1"""),
    "section_allocation": (section_allocation, SECTION_SQL),
    "truncation_baseline": (truncation_baseline, "WITH u AS (SELECT *, coalesce(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM conversations) SELECT conv_id, count(*) AS n, min(turn) AS first_turn, sum(len(text))::BIGINT AS chars FROM u WHERE u < 2 GROUP BY conv_id"),
}
