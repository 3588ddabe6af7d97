"""Rules against values worked out by hand, apart from the SQL they share with the oracle."""

from pyspark.sql import functions as F

from loomspark.functions import context_budget as cb
from loomspark.functions import literals as lt
from loomspark.functions import policy, rules, text
from loomspark.operators import decode, drafts, episodes, recovery, zones


def one(spark, steps, columns, **inputs):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items()))
    return rules.apply(row, steps).select(*columns).first()


def test_geometry_of_a_window(spark):
    columns = ["win", "tier", "message_ceiling", "band", "pressure", "fold_trigger", "eviction"]
    got = one(spark, cb.GEOMETRY, columns, engine="claude", known_model=True, asked_window=200_000, single=True)
    assert tuple(got) == (200_000, "small-200k", 180_000, 40_000, 180_000, 180_000, "hard-epoch-only")
    got = one(spark, cb.GEOMETRY, columns, engine="claude-cli", known_model=False, asked_window=0, single=False)
    assert got.win == 1_000_000 and got.tier == "large-1m" and got.pressure == 220_000 and got.fold_trigger == 150_000
    got = one(spark, cb.GEOMETRY, ["limit_source", "tier", "win"], engine="nobody", known_model=False, asked_window=0, single=True)
    assert tuple(got) == ("conservative-fallback", "unknown-conservative", 200_000)


def test_eligibility_ladder(spark):
    base = {"measured": 190_000.0, "ceiling": 180_000, "floor_tokens": 60_000.0, "trigger": 150_000, "appends": 1, "tail_asked": True, "append_on": True, "single": True, "forced": False, "append_target": 5_000, "least_runway": 30_000}
    got = one(spark, cb.ELIGIBILITY, ["decision", "reason", "band_tokens", "runway"], **base)
    assert tuple(got) == ("append", "runway-holds", 23_400, 96_600)
    assert one(spark, cb.ELIGIBILITY, ["decision", "reason"], **{**base, "floor_tokens": 150_000.0})[:] == ("hard-epoch", "runway-exhausted")
    assert one(spark, cb.ELIGIBILITY, ["decision", "reason"], **{**base, "appends": 0})[:] == ("append", "runway-holds")
    assert one(spark, cb.ELIGIBILITY, ["decision", "reason"], **{**base, "measured": 100.0})[:] == ("reuse", "below-single-ceiling")
    assert one(spark, cb.ELIGIBILITY, ["decision", "reason"], **{**base, "single": False})[:] == ("hard-epoch", "pressure-ceiling")
    assert one(spark, cb.ELIGIBILITY, ["decision", "reason"], **{**base, "measured": -1.0})[:] == ("unknown", "telemetry-unavailable")


def test_paths_and_literals(spark):
    touch = lambda raw: one(spark, lt.PATHS, ["touch"], raw=raw).touch
    assert touch("`src/a.ts:12:3`,") == "src/a.ts:12:3`" or touch("src/a.ts:12:3") == "src/a.ts"
    assert touch("https://x/y.ts") is None and touch("node_modules/a/b.js") is None and touch("a/b") is None and touch('"lib/x.py").') == "lib/x.py"
    worth = lambda v: one(spark, lt.LITERALS, ["noise", "anchor_value"], value=v)
    assert worth("yes/no").noise and worth("3/4").noise and worth("a" * 40).noise and not worth("src/engine/run.ts").noise
    assert worth("src/engine/run.ts").anchor_value == 600 and worth("rail-0a1b2c3d").anchor_value == 580 and worth("PORT=8080").anchor_value == 440


def test_tool_roles(spark):
    role = lambda tool, action=None, category=None: one(spark, lt.TOOLS, ["boundary_class", "discovers", "recalls", "decision_input"], tool=tool, action=action or "", category=category or "")
    assert role("mcp__x__task_rail").boundary_class == "rail_anchor" and role("TodoWrite").boundary_class == "gated" and role("str_replace").boundary_class == "edit"
    assert role("mcp__a__atlas_query", "search").discovers and role("w__fold_recall").recalls and role("h__tap_star", "pin", "decision").decision_input


def test_breaks_and_reasons(spark):
    columns = ["break_label", "reason_class", "trigger", "actionable", "ms", "overlap"]
    ask = lambda **k: one(spark, recovery.CLASSES, columns, **{"text": "", "root_text": "please repair the parser module tests", "reason": "", "chat_tool": False, "label": "", "stamp": "", **k})
    assert ask(text="continue").break_label == "same_intent_nudge_or_reask" and not ask(text="continue").actionable
    assert ask(text="now write a poem about rivers and hills for me").break_label == "operator_supersession_new_intent"
    assert ask(text='[Chat Room "x"] hello').break_label == "external_chat_or_system_preemption" and ask(text="").break_label == "ambiguous"
    assert ask(text="the parser module again").overlap and not ask(text="the parser again").overlap
    assert ask(reason="auto compact at ceiling").trigger == "compact" and ask(reason="auto compact at ceiling").reason_class == "threshold_or_context_pressure"
    assert ask(stamp="2026-01-02T03:04:05Z").ms == 1767323045000 and ask(stamp=" 42 ").ms == 42 and ask(stamp="x").ms is None


def test_hash_of_utf16_units(spark):
    got = spark.createDataFrame([("a😀b",), ("x\0y",), ("",), ("abc",)], "t string").select(text.fnv1a(F.col("t"))).collect()
    assert [r[0] for r in got] == [2412414209, 3397130420, 2166136261, 440920331]


def test_level_without_a_window(spark):
    got = spark.createDataFrame([(5, 0), (95, 100), (80, 100)], "u long, w long").select(policy.utilisation_level(F.col("u"), F.col("w"))).collect()
    assert [r[0] for r in got] == ["healthy", "auto_compact", "warning"]


def test_commands_that_change_something(spark):
    yes = ["docker run x", "cargo build", "git rm a", "git tag v1", "kubectl apply -f x", "node -e 'x'", "apt install y", "find . -exec rm {} ;", "FOO=1 make", "echo a > b"]
    no = ["git status", "docker ps", "kubectl get pods", "ls 2>&1", "echo 'rm -rf'", "cat x > /dev/null"]
    got = spark.createDataFrame([(c,) for c in yes + no], "c string").select(decode.mutates(F.col("c"))).collect()
    assert [r[0] for r in got] == [True] * len(yes) + [False] * len(no)


def replayed(step, rows):
    state, out = {}, []
    for row in rows:
        out += step(state, row)
    return out


def test_drafts():
    event = lambda pos, op, **k: {"draft": "d", "pos": pos, "op": op, **k}
    start = [event(0, "create", live=3, rail="r", actor="o", steps="a,b"), event(1, "insert", steps="c", at=1)]
    assert replayed(drafts.draft_step, start)[-1]["steps"] == "a:pending,c:pending,b:pending"
    moved = replayed(drafts.draft_step, [*start, event(2, "move", steps="b", at=0), event(3, "batch", steps="a,c", statuses="done,blocked"), event(4, "merge", actor="o", live=4, rail="r")])
    assert moved[-2]["steps"] == "b:pending,a:done,c:blocked" and moved[-1]["state"] == "conflicted" and moved[-1]["reason"] == "Live rail revision moved from 3 to 4."
    again = replayed(drafts.draft_step, [*start, event(2, "merge", actor="o", live=4, rail="r"), event(3, "update", steps="a", statuses="done"), event(4, "merge", actor="user", live=3, rail="r"), event(5, "abandon"), event(6, "append", steps="z")])
    assert [x["state"] for x in again[2:]] == ["conflicted", "open", "merged", "merged", "merged"] and again[-1]["error"] == "cannot-edit-merged" and again[-2]["error"] == "already-merged"
    assert replayed(drafts.draft_step, [*start, event(2, "merge", actor="x", live=3, rail="r")])[-1]["error"] == "not-owner"
    assert replayed(drafts.draft_step, [*start, event(2, "merge", actor="o", live=9, rail="q", force=True)])[-1]["state"] == "merged"
    assert replayed(drafts.draft_step, [event(0, "append", steps="a")])[-1]["error"] == "missing"


def test_stash_is_spent_once_and_rate_gated():
    row = lambda pos, cards=None, gated=True: {"session": "s", "pos": pos, "cards": cards, "gated": gated}
    got = replayed(zones.stash_step, [row(0, 2), row(1), row(2), row(3), row(4, 3, False), row(5, None, False), row(6, 1, False), row(9, None, False)])
    assert [(x["served"], x["why"]) for x in got] == [(0, "none"), (0, "held"), (1, "served"), (0, "none"), (0, "none"), (3, "served"), (0, "none"), (0, "stale")]


def test_closure_leaves_cycles_out(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (12, 10), (20, 20)], "source long, target long")
    assert sorted(map(tuple, episodes.terminals(edges).collect())) == [(1, 4), (2, 4), (3, 4)]


def test_episode_ids_follow_what_they_cover(spark):
    rows = [("s", i, 1000 * i, f"p{i % 3}.ts", "edit") for i in range(6)]
    schema = "session string, pos long, ms long, path string, kind string"
    first = episodes.capture(spark.createDataFrame(rows, schema))[0].first().id
    later = episodes.capture(spark.createDataFrame([(s, p, ms + 1, path, k) for s, p, ms, path, k in rows], schema))[0].first().id
    assert first != later and first == episodes.capture(spark.createDataFrame(rows, schema))[0].first().id
