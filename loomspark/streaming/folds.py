"""The stateful rules of a session as steps for ``replay`` and ``stream``."""

from __future__ import annotations

# Limits of a burst in events and milliseconds, and how far a floor stretches the gap.
GAP_EVENTS, GAP_MS, SPAN_EVENTS, SPAN_MS, FLOOR = 25, 1_200_000, 240, 1_800_000, 1.5
# Boundaries that a zone lives, that a watch stays open, and that a dismissal lasts.
ZONE_TTL, WATCH, DISMISSAL = 8, 6, 2
TTL_MS, MAX_TAIL = 300_000, 150_000

BURST = "session string, burst int, first_pos long, last_pos long, n int, paths string, closed_by string"
ZONE = "session string, path string, opened long, closed long, touches int"
FREEZE = "session string, pos long, decision string, epoch int, tail long"
WATCHED = "session string, card string, injected long, outcome string, at long"


def burst_step(state: dict, row: dict) -> list[dict]:
    """Bursts of touches (session, pos, ms or null, path, pivot): sealed by gap, pivot or span.

    A touch more than the gap after the last one, in events or time, opens a new burst; so does a pivot,
    or a burst that would span too many events or too long. A burst with a path touched three times
    stretches its time gap. Unknown times never seal. The end of the rows seals what is open.
    """
    open_ = state.get("open")

    def seal(why: str) -> list[dict]:
        state["n"] = state.get("n", 0) + 1
        return [{"session": row["session"], "burst": state["n"], "first_pos": open_["first"], "last_pos": open_["last"], "n": sum(open_["paths"].values()), "paths": ",".join(sorted(open_["paths"])), "closed_by": why}]

    if row.get("_end"):
        return seal("end") if open_ else []
    out: list[dict] = []
    pos, ms = int(row["pos"]), None if row.get("ms") is None else int(row["ms"])
    if open_:
        wait = GAP_MS * (FLOOR if max(open_["paths"].values()) >= 3 else 1)
        why = None
        if row.get("pivot"):
            why = "pivot"
        elif pos - open_["last"] > GAP_EVENTS:
            why = "events"
        elif ms is not None and open_["last_ms"] is not None and ms - open_["last_ms"] > wait:
            why = "time"
        elif pos - open_["first"] > SPAN_EVENTS or (ms is not None and open_["first_ms"] is not None and ms - open_["first_ms"] > SPAN_MS):
            why = "span"
        if why:
            out, open_ = seal(why), None
    if not open_:
        open_ = {"first": pos, "last": pos, "first_ms": ms, "last_ms": ms, "paths": {}}
    open_["last"] = pos
    open_["last_ms"] = ms if ms is not None else open_["last_ms"]
    open_["first_ms"] = open_["first_ms"] if open_["first_ms"] is not None else ms
    open_["paths"][row["path"]] = open_["paths"].get(row["path"], 0) + 1
    state["open"] = open_
    return out


def zone_step(state: dict, row: dict) -> list[dict]:
    """Zones by path over boundaries: a touch opens or extends its own zone only; others expire in turn."""
    zones = state.setdefault("zones", {})
    at = None if row.get("_end") else int(row["pos"])
    gone = sorted(p for p, z in zones.items() if at is None or at > z["expires"])
    out = [{"session": row["session"], "path": p, "opened": zones[p]["opened"], "closed": zones[p]["expires"], "touches": zones[p]["touches"]} for p in gone]
    for p in gone:
        del zones[p]
    if at is not None:
        z = zones.setdefault(row["path"], {"opened": at, "touches": 0})
        z["expires"], z["touches"] = at + ZONE_TTL, z["touches"] + 1
    return out


def freeze_step(state: dict, row: dict) -> list[dict]:
    """For each call (session, pos, ms, chars, mode): why the frozen view is computed anew, or reuse.

    First call, a gap longer than the cache lives (exactly that long is hot), a changed mode, or a
    rewound history compute the whole view; a tail over its limit is sealed as one more epoch.
    """
    if row.get("_end"):
        return []
    pos, ms, mode = int(row["pos"]), int(row["ms"]), row.get("mode")
    if "epoch" not in state:
        why = "first-call"
    elif pos < state["pos"]:
        why = "boundary-mismatch"
    elif ms - state["ms"] > TTL_MS:
        why = "cold-gap"
    elif mode != state["mode"]:
        why = "context-changed"
    elif state["tail"] + int(row["chars"]) > MAX_TAIL:
        why = "tail-epoch"
    else:
        why = "reuse"
    tail = state.get("tail", 0) + int(row["chars"]) if why == "reuse" else 0
    state.update(epoch=state.get("epoch", 0) + (why != "reuse"), pos=pos, ms=ms, mode=mode, tail=tail)
    return [{"session": row["session"], "pos": pos, "decision": why, "epoch": state["epoch"], "tail": tail}]


def watch_step(state: dict, row: dict) -> list[dict]:
    """Watches on recalled cards: a later edit of the path, else a mention, else expiry after the window.

    Rows are boundaries (session, pos, path, kind); kind ``recall`` injects a card for its path.
    """
    open_ = state.setdefault("open", [])
    out, left = [], []
    at = None if row.get("_end") else int(row["pos"])
    for w in open_:
        outcome = None
        if at is None:
            outcome = "open"
        elif row["path"] == w["card"] and row["kind"] in ("edit", "read"):
            outcome = "edited" if row["kind"] == "edit" else "echoed"
        elif at - w["injected"] > WATCH:
            outcome = "expired"
        if outcome:
            out.append({"session": row["session"], "card": w["card"], "injected": w["injected"], "outcome": outcome, "at": w["injected"] + WATCH if outcome == "expired" else at})
        else:
            left.append(w)
    if at is not None and row["kind"] == "recall" and all(w["card"] != row["path"] for w in left):
        left.append({"card": row["path"], "injected": at})
    state["open"] = left[-128:]
    return out
