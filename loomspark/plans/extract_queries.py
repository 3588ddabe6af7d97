"""Paths, errors, ids and literals taken out of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.functions import extract as ex
from loomspark.functions import rules
from loomspark.plans.rule_queries import _events, _from_events, _over, _pick
from loomspark.sources.bindings import messages

COMMAND = """CASE event_id % 7 WHEN 0 THEN 'cat src/mod' || n || '.ts ./lib/a.py; rm -rf "/tmp/a b' || n || '.txt" --out=/x > /dev/null' WHEN 1 THEN 'ls' WHEN 2 THEN 'curl https://host/a' || n || ' -o out/' || n || '.json,'
WHEN 3 THEN 'cp a/1 b/2 c/3 d/4 e/' || n || ' a/1' WHEN 4 THEN 'grep x /home/u/repo/src/mod' || n || '.ts: /dev/tty' WHEN 5 THEN 'echo a/b<c d>/e' ELSE 'vi ''q/s' || n || '.md'' q/s' || n || '.md' END"""
PATH = _pick(["/home/u/repo/src/../lib/./a.ts", "src//mod.ts", "../x/../../y.ts", "/../../etc/a.b", "/home/u/repo/packages/p/q.ts", "a/b/../../c.md", "./", "/home/u/other/z.py", "..", "/home/u/repo"], "event_id")
ERROR = _pick(["", "TypeError: bad value ", "fatal: not a thing ", "ENOENT: no such file ", "all good ", "AssertionError", "Build failed - see log "], "turn")
TEXT = f"coalesce({ERROR}, '') || text || chr(10) || coalesce({ERROR}, '') || 'again' || chr(13) || chr(10) || 'error: ' || CAST(turn % 5 AS VARCHAR(20)) || ' problems'"
MENTION = "text || CASE turn % 4 WHEN 0 THEN ' supersedes: episode-0123456789ab ↺ episode-ffff0000aaaa supersedes episode-0123456789AB' WHEN 1 THEN ' see src/a.ts, /home/u/repo/lib/b.py and ./docs/c.md.' WHEN 2 THEN ' ↺ episode-12' ELSE ' read lib/b.py twice: lib/b.py' END"
VALUE = _pick(["PORT=8080", "port: 8080.000", "7", "a.b", "v1.0", "x+y", "100.0", "the"], "turn")
HAYSTACK = "text || ' 8080 ' || CASE turn % 3 WHEN 0 THEN 'PORT=8080,' WHEN 1 THEN '100 a.b' ELSE 'xa.bx v1.0!' END"
LABELLED = "'retry_count: 17 and commit = deadbeef01, then host name \"17\" max.size 250' || text"
LABEL_VALUE = _pick(["17", "deadbeef01", "250", "a/b", "nothere", "#x"], "turn")
BLOCKED = """CASE turn % 5 WHEN 0 THEN 'a' || chr(10) || chr(10) || '[User Message Vault]' || chr(10) || 'x' || chr(10) || '[/User Message Vault]' || chr(10) || text WHEN 1 THEN '[Recalled from fold — p]' || chr(10) || 'body' || chr(10) || '[End fold recall]' || chr(10) || text
WHEN 2 THEN text || chr(10) || '[Fold recall hint — q]' WHEN 3 THEN 'b [Fold recall hint — one]' || chr(10) || 'c [Recalled from fold — r] z [End fold recall]  ' || text ELSE text END"""


def _messages(expressions: dict[str, str]):
    return lambda spark, d: messages(spark, d).selectExpr("conv_id", "turn", *(f"{rules.spark(e)} AS {n}" for n, e in expressions.items()))


def _sql(expressions: dict[str, str], steps: list, columns: list[str]) -> str:
    return rules.query("SELECT conv_id, turn, " + ", ".join(f"{e} AS {n}" for n, e in expressions.items()) + " FROM conversations", steps, columns)


def _query(expressions: dict[str, str], steps: list, columns: list[str]):
    columns = ["conv_id", "turn", *columns]
    return _over(_messages(expressions), steps, columns), _sql(expressions, steps, columns)


QUERIES = {
    "shell_paths": (_over(_events({"command": COMMAND}), ex.SHELL_PATHS, ["event_id", "spellings", "normal"]), rules.query(_from_events({"command": COMMAND}), ex.SHELL_PATHS, ["event_id", "spellings", "normal"])),
    "canonical_paths": (_over(_events({"path": PATH}), ex.CANONICAL, ["event_id", "normal", "workspace", "relative"]), rules.query(_from_events({"path": PATH}), ex.CANONICAL, ["event_id", "normal", "workspace", "relative"])),
    "error_signatures": _query({"text": TEXT}, ex.ERRORS, ["signatures"]),
    "mentions": _query({"text": MENTION}, ex.MENTIONS, ["superseded", "mentioned", "named"]),
    "conserved_literals": _query({"haystack": HAYSTACK, "value": VALUE}, ex.CONSERVED, ["whole", "as_part", "as_number", "conserved"]),
    "literal_labels": _query({"text": LABELLED, "value": LABEL_VALUE}, ex.LABEL, ["label"]),
    "stripped_texts": _query({"text": BLOCKED}, ex.STRIPS, ["clean"]),
}
