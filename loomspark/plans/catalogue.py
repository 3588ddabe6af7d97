"""The registered queries over the reference-shaped tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.plans import evidence_queries, extract_queries, index_queries, ledger_queries, line_queries, memory_queries, policy_queries, receipt_queries, recovery_queries, render_queries, rule_queries, seed_queries, session_queries, state_queries, text_queries

_ALL = {**text_queries.QUERIES, **session_queries.QUERIES, **policy_queries.QUERIES, **state_queries.QUERIES, **render_queries.QUERIES, **seed_queries.QUERIES, **rule_queries.QUERIES, **recovery_queries.QUERIES, **ledger_queries.QUERIES, **extract_queries.QUERIES, **evidence_queries.QUERIES, **line_queries.QUERIES, **receipt_queries.QUERIES, **memory_queries.QUERIES, **index_queries.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed bursts that touched the asked paths, best first."""
    return _ALL["episode_path_recall"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
