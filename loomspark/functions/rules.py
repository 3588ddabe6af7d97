"""Rules as named SQL expressions: applied to a DataFrame step by step, or spelled out as one query.

A step is a dictionary from new column to expression; expressions see the columns of earlier steps
only. The text is SQL that both Spark and DuckDB know, but for names that ``spark`` and ``duck`` rewrite.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

Step = dict[str, str]


def apply(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """``df`` with the columns of every step; plain projections, which Catalyst collapses."""
    for step in steps:
        df = df.selectExpr("*", *(f"{spark(e)} AS {name}" for name, e in step.items()))
    return df


def _calls(expression: str, name: str, render: Callable[[str], str]) -> str:
    """Every call of ``name`` replaced by what ``render`` makes of its arguments."""
    while (found := re.search(rf"\b{name}\(", expression)) is not None:
        at, depth, quoted = found.end(), 1, False
        while depth:
            c = expression[at]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            at += 1
        expression = expression[: found.start()] + render(expression[found.end() : at - 1]) + expression[at:]
    return expression


#: A word boundary of ASCII letters, digits and underscores, as DuckDB means it; Java's also counts other letters.
BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def spark(expression: str) -> str:
    """The expression for Spark, with the shared names for what is called differently."""
    expression = expression.replace("\\b", BOUNDARY)
    out = re.sub(r"\breplace_all\(", "regexp_replace(", _calls(expression, "walk_up", lambda x: f"aggregate({x}, '', (a, x) -> {_UP})"))
    out = _calls(out, "digest", lambda x: f"sha2({x}, 256)")
    out = _calls(out, "iso_ms", lambda x: f"unix_millis(try_to_timestamp({x}))")
    out = _calls(out, "json_text", lambda x: f"substring(to_json(named_struct('t', {x})), 6, length(to_json(named_struct('t', {x}))) - 6)")
    out = _calls(out, "listed", lambda x: f"array_join(array({x}), ',')")
    out = _calls(out, "first_distinct", lambda x: f"array_distinct({x})")
    out = _calls(out, "string_lines", lambda x: f"split({x}, r'\\r?\\n')")
    out = _calls(out, "pieces", lambda x: "split({}, {})".format(*_arguments(x)))
    out = _calls(out, "head", lambda x: "slice({}, 1, {})".format(*_arguments(x)))
    out = _calls(out, "joined", lambda x: f"concat({x})")
    out = _calls(out, "quoted", lambda x: f"(r'\\Q' || {x} || r'\\E')")
    out = _calls(out, "between_signs", lambda x: "regexp_like({}, r'(^|[^A-Za-z0-9])' || r'\\Q' || {} || r'\\E' || r'([^A-Za-z0-9]|$)')".format(*_arguments(x)))
    return _calls(out, "units", lambda x: f"CAST(octet_length(encode({x}, 'UTF-16BE')) / 2 AS BIGINT)")


#: One step of a path: up drops the last segment, or stays where there is none to drop.
_UP = "CASE WHEN x <> '..' THEN CASE WHEN a = '' THEN x ELSE a || '/' || x END WHEN a = '' OR a = '..' OR regexp_like(a, r'/[.][.]$') THEN CASE WHEN a = '' THEN '..' ELSE a || '/..' END ELSE replace_all(a, r'/?[^/]+$', '') END"


def _arguments(text: str) -> list[str]:
    """The arguments of a call."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'"
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if c == "," and not depth and not quoted:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


_DUCK = {"regexp_like(": "regexp_matches(", "size(": "len(", "array_intersect(": "list_intersect(", "array_distinct(": "list_distinct(", "filter(": "list_filter(", "transform(": "list_transform(", "array_sort(": "list_sort(", "array_join(": "array_to_string("}


def duck(expression: str) -> str:
    """The expression for DuckDB."""
    out = re.sub(r"\br'", "'", expression)
    for name, other in _DUCK.items():
        out = re.sub(rf"(?<![A-Za-z_]){re.escape(name)}", other, out)
    out = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", out)
    out = _calls(out, "json_text", lambda x: f"CAST(to_json({x}) AS VARCHAR)")
    out = _calls(out, "listed", lambda x: f"coalesce(array_to_string([{x}], ','), '')")
    out = _calls(out, "first_distinct", lambda x: f"list_filter({x}, lambda e, i: list_position({x}, e) = i)")
    out = _calls(out, "string_lines", lambda x: f"string_split_regex({x}, '\\r?\\n')")
    out = _calls(out, "pieces", lambda x: "string_split({}, {})".format(*_arguments(x)))
    out = _calls(out, "head", lambda x: "list_slice({}, 1, {})".format(*_arguments(x)))
    out = _calls(out, "joined", lambda x: "list_concat({}, {})".format(*_arguments(x)))
    out = _calls(out, "quoted", lambda x: f"('\\Q' || {x} || '\\E')")
    out = _calls(out, "between_signs", lambda x: "regexp_matches({}, '(^|[^A-Za-z0-9])\\Q' || {} || '\\E([^A-Za-z0-9]|$)')".format(*_arguments(x)))
    if "walk_up(" in out:
        out = _calls(out, "walk_up", lambda x: f"list_reduce({x}, lambda a, x: {duck(_UP)}, '')")
    out = _calls(out, "replace_all", lambda x: f"regexp_replace({x}, 'g')")
    out = _calls(out, "digest", lambda x: f"sha256({x})")
    out = _calls(out, "iso_ms", lambda x: f"epoch_ms(TRY_CAST({x} AS TIMESTAMPTZ))")
    return _calls(out, "units", lambda x: f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))")


def query(source: str, steps: Sequence[Step], columns: Sequence[str]) -> str:
    """One SQL statement with the same rows: ``source`` is a SELECT for the first table."""
    ctes, before = [f"s0 AS ({duck(source)})"], "s0"
    for i, step in enumerate(steps, 1):
        ctes.append(f"s{i} AS (SELECT *, " + ", ".join(f"{duck(e)} AS {name}" for name, e in step.items()) + f" FROM {before})")
        before = f"s{i}"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {', '.join(columns)} FROM {before}"
