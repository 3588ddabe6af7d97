"""Keyed folds agree between replay and stream; rails, bursts, zones and compaction follow their rules."""

import json

import pytest

from loomspark.operators import decode, fold, rails
from loomspark.streaming import folds, replay

MIN = 60_000


def bursts(spark, touches):
    rows = [("s", p, None if ms is None else ms, path, pivot) for p, ms, path, pivot in touches]
    df = spark.createDataFrame(rows, "session string, pos long, ms long, path string, pivot boolean")
    return [(r.first_pos, r.last_pos, r.closed_by) for r in replay.replay(df, "session", "pos", folds.burst_step, folds.BURST).orderBy("burst").collect()]


def test_burst_rules(spark):
    assert bursts(spark, [(0, 0, "a", False), (25, MIN, "a", False)]) == [(0, 25, "end")]
    assert bursts(spark, [(0, 0, "a", False), (26, MIN, "a", False)]) == [(0, 0, "events"), (26, 26, "end")]
    assert bursts(spark, [(0, 0, "a", False), (1, 20 * MIN, "a", False)]) == [(0, 1, "end")]
    assert bursts(spark, [(0, 0, "a", False), (1, 20 * MIN + 1, "b", False)]) == [(0, 0, "time"), (1, 1, "end")]
    assert bursts(spark, [(0, 0, "a", False), (1, 1, "a", False), (2, 2, "a", False), (3, 25 * MIN, "b", False)]) == [(0, 3, "end")]
    assert bursts(spark, [(0, 0, "a", False), (1, 16 * MIN, "b", False), (2, 31 * MIN, "c", False)]) == [(0, 1, "span"), (2, 2, "end")]
    assert bursts(spark, [(0, None, "a", False), (1, None, "b", True)]) == [(0, 0, "pivot"), (1, 1, "end")]


def test_zones_expire_in_turn(spark):
    rows = [("s", 0, "a"), ("s", 5, "b"), ("s", 8, "a"), ("s", 17, "c")]
    df = spark.createDataFrame(rows, "session string, pos long, path string")
    got = {(r.path, r.opened, r.closed, r.touches) for r in replay.replay(df, "session", "pos", folds.zone_step, folds.ZONE).collect()}
    assert got == {("b", 5, 13, 1), ("a", 0, 16, 2), ("c", 17, 25, 1)}


def calls():
    rows = []
    for s in ("x", "y", "z"):
        ms = 0
        for i in range(40):
            ms += 400_000 if i % 11 == 10 else 1000
            rows.append((s, i, ms, 9_000 * (1 + i % 3), "lean" if i > 30 else None))
    return rows


def test_freeze_ladder_and_stream_parity(spark, tmp_path):
    schema = "session string, pos long, ms long, chars long, mode string"
    df = spark.createDataFrame(calls(), schema)
    want = replay.replay(df, "session", "pos", folds.freeze_step, folds.FREEZE).collect()
    assert {r.decision for r in want} == {"first-call", "cold-gap", "context-changed", "tail-epoch", "reuse"}
    for part in range(4):
        df.where(f"pos div 10 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = replay.stream(live, "session", "pos", folds.freeze_step, folds.FREEZE)
    query = out.writeStream.format("memory").queryName("freezes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert sorted(map(tuple, spark.table("freezes").collect())) == sorted(map(tuple, want))


def test_watches(spark):
    rows = [("s", 3, "a", "recall"), ("s", 4, "b", "recall"), ("s", 6, "a", "edit"), ("s", 9, "c", "read"), ("s", 11, "c", "read"), ("s", 12, "b", "recall")]
    df = spark.createDataFrame(rows, "session string, pos long, path string, kind string")
    got = {(r.card, r.injected, r.outcome, r.at) for r in replay.replay(df, "session", "pos", folds.watch_step, folds.WATCHED, finish=False).collect()}
    assert got == {("a", 3, "edited", 6), ("b", 4, "expired", 10)}


def rail(spark, events):
    rows = [("r", i, e.get("op"), e.get("step"), e.get("title"), e.get("status"), e.get("at"), e.get("n")) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "rail string, pos long, op string, step string, title string, status string, at int, n int")
    return replay.replay(df, "rail", "pos", rails.rail_step, rails.RAIL).orderBy("pos").collect()


def test_rail_life(spark):
    add = lambda s: {"op": "append", "step": s}
    got = rail(spark, [{"op": "create"}, add("a"), add("b"), {"op": "insert", "step": "c", "at": 0}, add("a"), {"op": "lock"}, add("d"), {"op": "sprint", "n": 2}, {"op": "shoot"}, {"op": "shoot", "status": "blocked"}, {"op": "sprint"}, {"op": "ack", "step": "a", "status": "done"}, {"op": "activate"}, {"op": "shoot", "status": "skipped"}, {"op": "activate"}, {"op": "clear"}, add("z")])
    assert [r.error for r in got] == [None, None, None, None, "duplicate", None, "locked", None, None, None, "blocked", None, None, None, None, None, "abandoned"]
    assert got[7].active == "c" and got[8].active == "a" and got[9].state == "blocked"
    assert got[13].state == "review" and got[13].percent == 100 and got[14].state == "complete" and got[15].state == "abandoned"
    assert got[-2].revision == 12


def test_rail_merges(spark):
    drafts = spark.createDataFrame([("d1", "r", 3), ("d2", "r", 2), ("d3", "q", 1)], "draft string, rail string, base int")
    now = spark.createDataFrame([("r", 3)], "rail string, revision int")
    assert {r.draft: r.state for r in rails.merge_conflicts(drafts, now).collect()} == {"d1": "mergeable", "d2": "conflicted", "d3": "missing"}


@pytest.fixture
def history(spark):
    rows = [("s", 0, json.dumps({"role": "system", "content": "rules"}))]
    for i in range(12):
        rows.append(("s", len(rows), json.dumps({"role": "user", "content": f"question {i}"})))
        if i % 3 == 0:
            rows.append(("s", len(rows), json.dumps({"role": "assistant", "content": [{"type": "tool_use", "id": f"t{i}", "name": "Read", "input": {"path": f"src/m{i}.ts"}}]})))
            rows.append(("s", len(rows), json.dumps({"role": "user", "content": [{"type": "tool_result", "tool_use_id": f"t{i}", "content": "x" * (100 + 100 * i)}]})))
        rows.append(("s", len(rows), json.dumps({"role": "assistant", "content": f"answer {i}\nplain words\nsee src/m{i}.ts " + "y" * (90 if i % 2 else 200)})))
    return decode.decode(spark.createDataFrame(rows, "session string, pos long, raw string"))


def test_compaction(spark, history):
    old = {r.turn: r for r in fold.folded_turns(history, keep=4, full=250, brief=400).collect()}
    assert sorted(old) == list(range(1, 9))
    assert old[8].level == "full" and "plain words" in old[8].line
    assert {r.level for r in old.values()} == {"full", "essence", "skeleton"}
    assert "[Read src/m6.ts → 700c]" in old[7].line and old[7].category == "research"
    view = fold.view(history, keep=4, full=250, brief=400).orderBy("pos").collect()
    assert view[0].content == "rules" and view[1].content.startswith(fold.MARK + " 8 turns")
    assert [r.content for r in view if r.role == "user"][1] == "question 8"
    assert view == fold.view(history, keep=4, full=250, brief=400).orderBy("pos").collect()
    kept = {r.tool_id: r.kept for r in fold.intra_turn(decode.tool_calls(history), newest=0).collect()}
    assert kept == {"t0": True, "t3": True, "t6": False, "t9": False}
