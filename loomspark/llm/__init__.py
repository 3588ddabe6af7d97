"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. ``queries()`` and ``oracle_sql()`` collect what the
operator modules offer.
"""

from loomspark.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
