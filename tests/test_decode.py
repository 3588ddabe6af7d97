"""The same conversation in three provider shapes decodes to the same calls."""

import json

from pyspark.sql import functions as F

from loomspark.operators import decode
from loomspark.sources import transcripts


def shapes():
    call = {"file_path": "/home/me/project/src/a.ts"}
    blocks = [
        {"role": "user", "content": "please read"},
        {"role": "assistant", "content": [{"type": "text", "text": "reading"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": call}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "body"}], "tsMs": 7},
        {"role": "assistant", "content": "done"},
    ]
    listed = [
        {"role": "user", "content": "please read"},
        {"role": "assistant", "content": "reading", "tool_calls": [{"id": "t1", "function": {"name": "Read", "arguments": json.dumps(call)}}]},
        {"role": "tool", "tool_call_id": "t1", "content": "body", "tsMs": 7},
        {"role": "assistant", "content": "done"},
    ]
    parts = [
        {"role": "user", "parts": [{"text": "please read"}]},
        {"role": "model", "parts": [{"text": "reading"}, {"functionCall": {"id": "t1", "name": "Read", "args": call}}]},
        {"role": "user", "parts": [{"functionResponse": {"id": "t1", "name": "Read", "response": {"result": "body"}}}], "tsMs": 7},
        {"role": "model", "parts": [{"text": "done"}]},
    ]
    return {"blocks": blocks, "listed": listed, "parts": parts}


def raw(spark, sessions):
    rows = [(s, i, m if isinstance(m, str) else json.dumps(m)) for s, ms in sessions.items() for i, m in enumerate(ms)]
    return decode.decode(spark.createDataFrame(rows, "session string, pos long, raw string"))


def test_three_shapes_agree(spark):
    m = raw(spark, shapes())
    calls = {r.session: (r.turn, r.name, r.result, r.pos, r.ts_ms, r.path) for r in decode.tool_calls(m).withColumn("path", decode.path_of(F.col("input"))).collect()}
    assert set(calls.values()) == {(1, "Read", "body", 2, 7, "src/a.ts")} and len(calls) == 3
    assert {(r.session, r.category) for r in decode.categories(m).collect()} == {(s, "research") for s in shapes()}
    turns = decode.turns(m).groupBy("session").agg(F.max("turn").alias("n")).collect()
    assert {r.n for r in turns} == {1}


def test_pending_and_repeated_calls(spark):
    use = lambda i: {"role": "assistant", "content": [{"type": "tool_use", "id": i, "name": "Bash", "input": {"command": "ls"}}]}
    result = lambda i, t, bad=False: {"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "content": t, "is_error": bad}]}
    ms = [{"role": "user", "content": "go"}, use("a"), use("b"), result("a", "1"), result("a", "again"), use("a"), result("a", "2", True), "not json", {"role": "user", "content": "next"}, result("b", "late")]
    got = decode.tool_calls(raw(spark, {"s": ms})).orderBy("pos").collect()
    assert [(r.tool_id, r.result, r.is_error) for r in got] == [("a", "1", False), ("a", "2", True)]
    assert {r.turn: r.category for r in decode.categories(raw(spark, {"s": ms})).collect()} == {1: "error", 2: "navigation"}


def test_commands_that_mutate(spark):
    cases = {"ls -la": False, "rm -rf x": True, "echo 'rm x'": False, "cat a > b": True, "cat a > /dev/null": False, "cd x && git commit -m y": True, "git status": False, "sudo npm install": True, "ls 2>&1": False}
    df = spark.createDataFrame(list(cases.items()), "c string, want boolean")
    assert df.where(decode.mutates(F.col("c")) != F.col("want")).count() == 0


def test_weights_and_skeletons(spark):
    m = raw(spark, {"s": [{"role": "user", "content": "abc", "reasoning_content": "de"}, {"role": "user"}]})
    assert [r.w for r in m.orderBy("pos").select(decode.weight(m).alias("w")).collect()] == [5, 0]
    line = spark.range(1).select(decode.skeleton(F.lit("Read"), F.lit('{"path": "/home/a/b/c.py"}'), F.lit("xyz")).alias("s")).first().s
    assert line == "[Read c.py → 3c]"


def test_transcript_rows_become_alternating_messages(spark, tmp_path):
    rows = [("s", 0, "user", "hi", None, None), ("s", 1, "assistant_text", "a", None, None), ("s", 2, "tool_use", None, "Read", "{}"), ("s", 3, "tool_result", "r", None, None), ("s", 4, "system", "x", None, None), ("s", 5, "user", "bye", None, None)]
    lines = [json.dumps({"session": s, "pos": p, "ty": ty, "tx": tx, "tn": tn, "ti": ti}) for s, p, ty, tx, tn, ti in rows] + ["{broken"]
    (tmp_path / "rows.jsonl").write_text("\n".join(lines))
    got = transcripts.alternating(transcripts.read_rows(spark, str(tmp_path / "rows.jsonl")))
    said = [(r.role, r.content) for r in got.orderBy("pos").collect()]
    assert said == [("user", "hi"), ("assistant", "a\n\n⟨tool Read⟩ {}\n\n⟨result⟩ r"), ("user", "bye")]
    assert [r.content for r in transcripts.alternating(transcripts.read_rows(spark, str(tmp_path / "rows.jsonl")), 5).collect()] == ["bye"]
    out = transcripts.linked(got, "2026-01-01T00:00:00Z")
    transcripts.write_lines(out, str(tmp_path / "out"))
    back = [json.loads(x.value) for x in out.orderBy("pos").collect()]
    assert [b.get("parentUuid") for b in back] == [None, back[0]["uuid"], back[1]["uuid"]]
    assert back[2]["timestamp"] == "2026-01-01T00:00:02Z"
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_snapshot_and_measured_tokens(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")
    first = transcripts.snapshot(files, spark.createDataFrame([], "path string, digest string"))
    again = transcripts.snapshot(spark.createDataFrame([("a", "x"), ("b", "z")], "path string, content string"), first)
    assert {r.path: r.stable for r in again.collect()} == {"a": True, "b": False}
    records = spark.createDataFrame([("s", i, t) for i, t in enumerate([90, 5, None, 7, 6, 3, 2, 1])], "session string, pos long, tokens long")
    assert transcripts.newest_measured(records).first().tokens == 7
