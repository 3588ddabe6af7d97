"""Lanes, aggregates, supersession, claims and freshness of receipts."""

import json

import pytest

from loomspark.operators import receipts


@pytest.fixture(scope="module")
def calls(spark):
    spec = [
        ("Read", {"path": "a.ts"}, "x", False), ("Read", {"path": "b.ts"}, "x", False), ("Grep", {"pattern": "foo"}, "x", False), ("Bash", {"command": "rg bar"}, "x", False),
        ("Edit", {"path": "a.ts"}, "ok", False), ("Bash", {"command": "npx vitest run"}, "2 passed", False), ("Edit", {"path": "a.ts"}, "ok", False), ("Edit", {"path": "a.ts"}, "boom", True),
        ("Bash", {"command": "pytest -q"}, "", False), ("mcp__hub__claim_file", {"path": "a.ts"}, "granted", False), ("mcp__hub__claim_file", {"path": "b.ts"}, "pending", False), ("mcp__hub__release_file", {"path": "a.ts"}, "released", False),
        ("Read", {"path": "zz"}, "Error: no such file", False), ("Bash", {"command": "rm -rf out"}, "ok", False), ("record_decision", {}, "noted", False), ("Agent", {}, "spawned", False), ("Mystery", {}, "?", False),
    ]
    rows = [("s", 1, f"t{i:02d}", n, json.dumps(a), r, e, i, None if i == 1 else 1000 * i) for i, (n, a, r, e) in enumerate(spec)]
    df = spark.createDataFrame(rows, "session string, turn int, tool_id string, name string, input string, result string, is_error boolean, pos long, ts_ms long")
    return receipts.classify(df)


def test_lanes_and_outcomes(calls):
    got = [(r.lane, r.kind, r.outcome) for r in calls.orderBy("pos").collect()]
    receipt = lambda k, o="applied": ("receipt", k, o)
    assert got == [
        ("read", None, "applied"), ("read", None, "applied"), ("search", None, "applied"), ("search", None, "applied"),
        receipt("file-edit"), receipt("test-run"), receipt("file-edit"), receipt("file-edit", "failed"), receipt("test-run", "unknown"), receipt("claim-op"), receipt("claim-op", "unknown"), receipt("claim-op"),
        receipt("tool-error", "failed"), receipt("shell-mutation"), receipt("decision"), ("orchestration", None, "applied"), ("other", None, "applied"),
    ]


def test_runs_of_look_ups(calls):
    got = {r.lane: r for r in receipts.aggregates(calls, most_paths=1).collect()}
    assert got["read"].n == 2 and got["read"].paths == ["a.ts"] and got["read"].more_paths == 1 and got["read"].unknown_times == 1
    assert got["search"].queries == ["foo", "rg bar"] and (got["search"].first_ms, got["search"].last_ms) == (2000, 3000)


def test_what_stands(calls):
    edits = {r.pos: r.superseded for r in receipts.standing(calls).where("kind = 'file-edit'").collect()}
    assert edits == {4: True, 6: False, 7: False}
    assert {r.target: (r.state, r.reconcile) for r in receipts.claims(calls).collect()} == {"a.ts": ("released", False), "b.ts": ("unknown", True)}
    assert {r.pos: r.freshness for r in receipts.validations(calls).collect()} == {5: "stale", 8: "unknown"}
