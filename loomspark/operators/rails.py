"""Task rails as event-sourced rows: one step function, replayed or streamed.

An event is (rail, pos, op, step, title, status, at, n). Operations: create, append, insert, update,
remove, move, lock, unlock, clear, ack, activate, reset, sprint, shoot. What an operation must not do
gives a row with an error and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAIL = "rail string, pos long, op string, state string, revision int, active string, done int, total int, percent int, error string"
#: States in which a step needs no more work, or holds the rail.
RESOLVED, HOLDING = ("done", "skipped"), ("active", "in_progress", "blocked", "needs_review")
ACKS = ("done", "skipped", "blocked", "needs_review", "in_progress")
SPRINT_DEFAULT, SPRINT_MOST = 6, 20


def _find(steps: list[dict], name: str | None) -> int:
    return next((i for i, s in enumerate(steps) if s["id"] == name), -1)


def _activate(steps: list[dict]) -> None:
    """Makes the first reserved, else the first pending step active, unless one holds the rail."""
    if any(s["status"] in HOLDING for s in steps):
        return
    nxt = next((s for s in steps if s.get("reserved") and s["status"] == "pending"), None) or next((s for s in steps if s["status"] == "pending"), None)
    if nxt:
        nxt["status"] = "active"
        nxt["reserved"] = False


def _state(state: dict) -> str:
    steps = state["steps"]
    if state["state"] == "abandoned":
        return "abandoned"
    if not steps:
        return "planned"
    if all(s["status"] in RESOLVED for s in steps):
        return "complete" if state["state"] in ("review", "complete") else "review"
    if any(s["status"] in ("blocked", "needs_review") for s in steps):
        return "blocked"
    return "active" if any(s["status"] != "pending" for s in steps) else "planned"


def rail_step(state: dict, row: dict) -> list[dict]:
    """Applies one event and tells the rail's state after it."""
    if row.get("_end"):
        return []
    op, error = row["op"], None
    if op == "create":
        state.clear()
        state.update(steps=[], state="planned", revision=0, locked=False, history=[])
    elif "steps" not in state:
        error = "missing"
    elif state["state"] == "abandoned":
        error = "abandoned"
    steps = state.get("steps", [])
    at = _find(steps, row.get("step"))
    place = len(steps) if row.get("at") is None else max(0, min(int(row["at"]), len(steps)))
    if not error and op in ("append", "insert"):
        if state["locked"]:
            error = "locked"
        elif at >= 0:
            error = "duplicate"
        else:
            steps.insert(len(steps) if op == "append" else place, {"id": row["step"], "title": row.get("title"), "status": "pending"})
    elif not error and op in ("update", "remove", "move", "reset", "ack"):
        if at < 0:
            error = "unknown-step"
        elif op == "update":
            steps[at]["title"] = row.get("title") or steps[at]["title"]
        elif op == "remove":
            steps.pop(at)
        elif op == "move":
            steps.insert(min(place, len(steps) - 1), steps.pop(at))
        elif op == "reset":
            steps[at].update(status="pending", reserved=False)
        elif row.get("status") not in ACKS:
            error = "invalid-status"
        else:
            steps[at]["status"] = row["status"]
    elif not error and op == "lock":
        error = None if steps else "empty"
        state["locked"] = state["locked"] or bool(steps)
    elif not error and op == "unlock":
        state["locked"] = False
    elif not error and op == "clear":
        state["state"] = "abandoned"
    elif not error and op == "activate":
        _activate(steps)
    elif not error and op == "sprint":
        if any(s["status"] in ("blocked", "needs_review") for s in steps):
            error = "blocked"
        else:
            n = max(1, min(SPRINT_MOST, int(row.get("n") or SPRINT_DEFAULT)))
            for s in [s for s in steps if s["status"] == "pending"][:n]:
                s["reserved"] = True
            _activate(steps)
    elif not error and op == "shoot":
        holding = next((s for s in steps if s["status"] in HOLDING), None)
        status = row.get("status") or "done"
        if status not in ACKS:
            error = "invalid-status"
        elif not holding:
            error = "nothing-active"
        else:
            holding["status"] = status
            if status in RESOLVED:
                _activate(steps)
    if not error:
        state["revision"] += op != "create"
        state["history"] = [*state["history"], op][-200:]
        state["state"] = _state(state)
    done = sum(s["status"] in RESOLVED for s in steps)
    active = next((s["id"] for s in steps if s["status"] in HOLDING), None)
    return [{"rail": row["rail"], "pos": row["pos"], "op": op, "state": state.get("state", "missing"), "revision": state.get("revision", 0), "active": active, "done": done, "total": len(steps), "percent": int(100 * done / len(steps) + 0.5) if steps else 0, "error": error}]


def merge_conflicts(drafts: DataFrame, rails: DataFrame) -> DataFrame:
    """(draft, rail, base) against (rail, revision): whether a draft can merge, or on which revision it conflicts."""
    now = rails.select("rail", "revision")
    joined = drafts.join(now, "rail", "left")
    state = F.when(F.col("revision").isNull(), "missing").when(F.col("revision") == F.col("base"), "mergeable").otherwise("conflicted")
    return joined.select("draft", "rail", "base", "revision", state.alias("state"))


def template(steps: DataFrame) -> DataFrame:
    """Steps (rail, n, id, title, ...) without anything of their execution, as one row a rail."""
    seeds = F.array_sort(F.collect_list(F.struct("n", "id", "title")))
    return steps.groupBy("rail").agg(F.to_json(F.transform(seeds, lambda s: F.struct(s["id"].alias("id"), s["title"].alias("title")))).alias("template"), F.count(F.lit(1)).alias("steps"))
