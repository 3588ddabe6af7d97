"""Drafts of task rails as event-sourced rows, and templates of rails as JSON.

A draft is a copy of a rail's steps that is edited apart and merged back when the rail has not moved.
An event is (draft, pos, op, steps, statuses, actor, live, rail, force, at): create, update, batch,
append, insert, remove, move, abandon, merge. An event that must not happen changes nothing and tells why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAFT = "draft string, pos long, op string, state string, revision int, steps string, reason string, error string"
EDITABLE = ("open", "conflicted")
_EDITS = ("update", "batch", "append", "insert", "remove", "move")


def is_editable(state: str | None) -> bool:
    """An open draft can be edited, and so can one in conflict, which an edit opens again."""
    return state in EDITABLE


def merge_error(state: dict, actor: str | None) -> str | None:
    """Why ``actor`` may not merge the draft at all."""
    if actor not in (state["owner"], "user"):
        return "not-owner"
    return None if state["state"] not in ("merged", "abandoned") else f"already-{state['state']}"


def conflict(state: dict, live: int | None, rail: str | None, force: bool) -> str | None:
    """Why a merge would overwrite what others did: another base rail, or a revision that moved."""
    if force:
        return None
    if state.get("rail") and rail != state["rail"]:
        return f"Base rail changed from {state['rail']} to {rail or 'none'}."
    if live is None or int(live) != state["base"]:
        return f"Live rail revision moved from {state['base']} to {'none' if live is None else int(live)}."
    return None


def _edit(state: dict, op: str, row: dict) -> str | None:
    steps, names = state["steps"], [s for s in (row.get("steps") or "").split(",") if s]
    known: dict[str, int] = {}
    for i, (name, _) in enumerate(steps):
        known.setdefault(name, i)
    place = max(0, min(len(steps), int(row["at"]) if row.get("at") is not None else len(steps)))
    if op in ("append", "insert"):
        if not names:
            return "empty"
        where = len(steps) if op == "append" else place
        steps[where:where] = [[s, "pending"] for s in names]
        return None
    missing = next((s for s in names if s not in known), None)
    if not names or missing is not None:
        return f"Step not found: {missing}" if names else "empty"
    if op in ("update", "batch"):
        for s, status in zip(names, (row.get("statuses") or "").split(","), strict=False):
            steps[known[s]][1] = status or steps[known[s]][1]
    else:
        taken = steps.pop(known[names[0]])
        if op == "move":
            steps.insert(min(place, len(steps)), taken)
    return None


def draft_step(state: dict, row: dict) -> list[dict]:
    """Applies one event and tells the draft's state after it; an edit of a draft in conflict opens it again."""
    if row.get("_end"):
        return []
    op, error = row["op"], None
    if op == "create":
        names = [s for s in (row.get("steps") or "").split(",") if s]
        state.clear()
        state.update(state="open", revision=1, base=int(row.get("live") or 0), rail=row.get("rail"), owner=row.get("actor"), steps=[[s, "pending"] for s in names], reason=None)
    elif "state" not in state:
        error = "missing"
    elif op in _EDITS:
        error = _edit(state, op, row) if is_editable(state["state"]) else f"cannot-edit-{state['state']}"
        if not error:
            state.update(state="open", reason=None, revision=state["revision"] + 1)
    elif op == "abandon":
        error = f"already-{state['state']}" if state["state"] in ("merged", "abandoned") else None
        if not error:
            state.update(state="abandoned", revision=state["revision"] + 1)
    elif op == "merge":
        error = merge_error(state, row.get("actor"))
        if not error:
            reason = conflict(state, row.get("live"), row.get("rail"), bool(row.get("force")))
            state.update(state="conflicted" if reason else "merged", reason=reason, revision=state["revision"] + 1)
            error = "conflict" if reason else None
    else:
        error = "unknown-operation"
    shown = ",".join(f"{s}:{status}" for s, status in state.get("steps", []))
    return [{"draft": row["draft"], "pos": row["pos"], "op": op, "state": state.get("state", "missing"), "revision": state.get("revision", 0), "steps": shown, "reason": state.get("reason"), "error": error}]


_SEED = "array<struct<id:string,title:string>>"


def template_index(templates: DataFrame) -> DataFrame:
    """(rail, template) to one index row each: the rail it came from and how many steps it has."""
    return templates.select("rail", F.size(F.from_json("template", _SEED)).cast("long").alias("step_count"), F.sha2("template", 256).alias("digest"))


def template_seeds(templates: DataFrame) -> DataFrame:
    """(rail, template) back to its steps in order, without anything of their execution."""
    seeds = templates.select("rail", F.posexplode(F.from_json("template", _SEED)).alias("n", "seed"))
    return seeds.select("rail", F.col("n").cast("long").alias("n"), "seed.id", "seed.title")
