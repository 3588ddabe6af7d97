"""Queries over conversations see whole texts."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators import fold
from loomspark.plans import state_queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    rows = [(1, t, role, f"{role} {t} " + "word " * 200 + f"end{t}") for t, role in enumerate(["user", "assistant"] * 3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(path / "conversations.parquet"))
    return str(path)


def test_tool_results_are_whole(spark, tables):
    raw = state_queries.raw_messages(spark, tables).where(F.col("raw").contains("tool_result")).collect()
    got = {json.loads(r.raw)["content"][0]["content"].split()[-1] for r in raw}
    assert got == {"end1", "end3", "end5"}
    shown = state_queries.folded_view(spark, tables).where(F.col("content").contains("tool_result")).collect()
    assert shown and all("end5" in r.content for r in shown)


def test_essence_keeps_code_plain_lines_and_the_end(spark):
    long = "prose " * 50
    lines = ["First line of an answer.", "Let me look at it.", "plain words", "```", "Let me stay()", "", "", "```", "", "", "because " + long, long, "Okay.", *["more"] * 10_001, "the last line", ""]
    want = ["First line of an answer.", "plain words", "```", "Let me stay()", "", "", "```", "", "because " + long, *["more"] * 10_001, "the last line"]
    got = spark.createDataFrame([("\n".join(lines),), ("Let me see.",), (None,), ("x" + "\n" + "y" * 2000,)], "t string").select(fold.essence(F.col("t"))).collect()
    assert [r[0] for r in got] == ["\n".join(want), "Let me see.", None, "x\n" + "y" * 198 + "…"]
