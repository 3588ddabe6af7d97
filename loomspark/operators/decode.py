"""Messages of three provider shapes as rows: text, tool calls paired with results, weights, categories.

A raw message is one JSON text. Content is a text, or blocks; calls come as blocks, as a list beside
the content, or as parts. Decoding is a projection over VARIANT; pairing is one window per session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Tools that act, that look, and that coordinate.
ACTING = ("Edit", "Write", "NotebookEdit")
LOOKING = ("Read", "Grep", "Glob", "WebSearch", "WebFetch", "ToolSearch")
COORDINATING = ("Agent",)
# Commands that change something, by family.
MUTATING_VERBS = (
    r"(?:rm|rmdir|unlink|mv|cp|mkdir|touch|ln|truncate|dd|shred|tee|patch)\b",
    r"(?:chmod|chown|chgrp|setfacl)\b",
    r"(?:kill|pkill|killall|pm2|systemctl|service|launchctl|supervisorctl)\b",
    r"(?:sed|perl|ruby)\s+(?:-[\w-]+\s+)*-[\w]*i",
    r"(?:(?:ba|z)?sh\s+-c|(?:node|tsx|python3?|perl|ruby|deno|bun)\s+-(?:e|c))\b",
    r"git\s+(?:commit|push|add|rm|mv|reset|checkout|switch|restore|merge|rebase|stash|cherry-pick|revert|tag|branch|clean|apply|am|init|clone|remote|fetch|pull|submodule|worktree|gc|prune|filter-branch)\b",
    r"(?:npm|pnpm|yarn|bun)\s+(?:install|ci|add|remove|rm|uninstall|update|upgrade|link|unlink|publish|prune|dedupe|i|run\s+build)\b",
    r"(?:pip|pip3|uv|poetry|pipenv)\s+(?:install|uninstall|add|remove|sync|lock)\b",
    r"(?:apt|apt-get|dnf|yum|zypper|pacman|apk|brew|port)\s+(?:install|remove|purge|upgrade|update|autoremove)\b",
    r"(?:make|ninja|gradle|gradlew|mvn|bazel|cmake)\b",
    r"cargo\s+(?:build|install|publish|clean|add|remove|update|fix)\b",
    r"go\s+(?:build|install|get|mod|generate|clean)\b",
    r"(?:docker|podman|nerdctl)\s+(?:run|build|rm|rmi|push|pull|create|start|stop|kill|restart|exec|compose|tag|commit|volume|network|system|prune)\b",
    r"kubectl\s+(?:apply|create|delete|patch|replace|scale|rollout|edit|annotate|label|cordon|drain|taint)\b",
    r"rclone\s+(?:copy|copyto|move|moveto|sync|delete|purge|mkdir|rmdir|deletefile|touch)\b",
    r"(?:rsync|scp|sftp)\b",
)
#: Such a command where a command can begin.
MUTATING = r"(?:^|[\n;&|(){}`]|-exec\b|-execdir\b)\s*(?:(?:sudo|nohup|time|command|xargs|env)\s+|\w+=\S*\s+)*(?:" + "|".join(MUTATING_VERBS) + ")"
REDIRECT = r"(?:^|[^0-9>=<-])>>?\s*(?!&|/dev/null\b)[^\s;&|<>()]"

_BLOCK = "array<struct<type:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,text:string>>"
_CALL = "array<struct<id:string,function:struct<name:string,arguments:string>>>"
_PART = "array<struct<text:string,functionCall:struct<id:string,name:string,args:string>,functionResponse:struct<id:string,name:string,response:string>>>"


def decode(raw: DataFrame) -> DataFrame:
    """(session, pos, raw) to role, content (a text or null), blocks, tool_calls, tool_call_id, parts, ts_ms.

    A line that is not JSON gives nulls. Block content that is not a text keeps its JSON.
    """
    v = F.try_parse_json("raw")
    get = lambda path, kind: F.try_variant_get(F.col("v"), path, kind)
    kind = F.schema_of_variant(F.try_variant_get(F.col("v"), "$.content", "variant"))
    is_list = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    nested = lambda path, schema: F.from_json(F.get_json_object("raw", path), schema)
    out = raw.withColumn("v", v)
    return out.select(
        "session", "pos", get("$.role", "string").alias("role"),
        F.when(~is_list, get("$.content", "string")).alias("content"),
        F.when(is_list, nested("$.content", _BLOCK)).alias("blocks"),
        nested("$.tool_calls", _CALL).alias("tool_calls"), get("$.tool_call_id", "string").alias("tool_call_id"),
        nested("$.parts", _PART).alias("parts"), get("$.tsMs", "long").alias("ts_ms"), get("$.reasoning_content", "string").alias("reasoning"), "raw",
    )


def texts(m: DataFrame) -> Column:
    """Text of a decoded message: its content, or the texts of blocks or parts, a line each."""
    of = lambda c: F.array_join(F.filter(F.transform(c, lambda b: b["text"]), lambda t: t.isNotNull() & (F.trim(t) != "")), "\n")
    return F.coalesce(F.col("content"), of(F.col("blocks")), of(F.col("parts")), F.lit(""))


def weight(m: DataFrame) -> Column:
    """Characters of a decoded message: of its text, or of the JSON of its blocks or parts; reasoning too."""
    listed = lambda path: F.length(F.get_json_object("raw", path)) - F.size(F.from_json(F.get_json_object("raw", path), "array<string>")) - 1
    body = F.when(F.col("content").isNotNull(), F.length("content")).when(F.col("blocks").isNotNull(), listed("$.content[*]")).when(F.col("parts").isNotNull(), listed("$.parts[*]")).otherwise(0)
    return (body + F.coalesce(F.length("reasoning"), F.lit(0))).cast("long")


def turns(m: DataFrame) -> DataFrame:
    """Decoded messages with turn numbers: a user message with text of its own opens one, results do not."""
    opens = (F.col("role") == "user") & (F.trim(texts(m)) != "")
    w = W.partitionBy("session").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return m.withColumn("turn", F.sum(F.when(opens, 1).otherwise(0)).over(w))


def tool_calls(m: DataFrame) -> DataFrame:
    """Completed calls: session, turn, tool_id, name, input, result, is_error, pos (of the result), ts_ms.

    A result pairs with the call of the same id in the same turn when nothing else of that id lies
    between; a call without a result, or a result without a call, gives no row.
    """
    t = turns(m)
    event = lambda what, i, name, data, bad: F.struct(F.lit(what).alias("what"), i.alias("tool_id"), name.alias("name"), data.cast("string").alias("data"), bad.alias("is_error"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    empty = F.array().cast("array<struct<what:string,tool_id:string,name:string,data:string,is_error:boolean>>")
    from_blocks = F.transform("blocks", lambda b: F.when(b["type"] == "tool_use", event("call", b["id"], b["name"], b["input"], no)).when(b["type"] == "tool_result", event("result", b["tool_use_id"], none, F.coalesce(b["content"], F.lit("")), F.coalesce(b["is_error"], no))))
    from_calls = F.transform("tool_calls", lambda c: event("call", c["id"], c["function"]["name"], c["function"]["arguments"], no))
    from_role = F.when(F.col("role") == "tool", F.array(event("result", F.col("tool_call_id"), none, F.coalesce(texts(m), F.lit("")), no)))
    response = lambda r: F.coalesce(F.get_json_object(r, "$.result"), r)
    from_parts = F.transform("parts", lambda p: F.when(p["functionCall"].isNotNull(), event("call", F.coalesce(p["functionCall"]["id"], F.lit("")), p["functionCall"]["name"], p["functionCall"]["args"], no)).when(p["functionResponse"].isNotNull(), event("result", F.coalesce(p["functionResponse"]["id"], F.lit("")), none, response(p["functionResponse"]["response"]), no)))
    every = F.concat(*(F.coalesce(x, empty) for x in (from_blocks, from_calls, from_role, from_parts)))
    events = t.select("session", "turn", "pos", "ts_ms", F.posexplode(F.array_compact(every)).alias("i", "e")).select("session", "turn", "pos", "i", "ts_ms", "e.*").where("tool_id is not null")
    w = W.partitionBy("session", "turn", "tool_id").orderBy("pos", "i")
    paired = events.withColumn("before", F.lag("what").over(w)).withColumn("call_name", F.lag("name").over(w)).withColumn("input", F.lag("data").over(w))
    done = paired.where("what = 'result' and before = 'call'")
    return done.select("session", "turn", "tool_id", F.col("call_name").alias("name"), "input", F.col("data").alias("result"), "is_error", "pos", "ts_ms")


def path_of(input_json: Column) -> Column:
    """The path that a tool's input names, without a leading home and project folder."""
    first = F.coalesce(*(F.get_json_object(input_json, f"$.{k}") for k in ("file_path", "path", "filePath", "file")))
    return F.regexp_replace(first, "^/home/[^/]+/[^/]+/", "")


def mutates(command: Column) -> Column:
    """Whether a shell command changes something, quoted text apart."""
    bare = F.regexp_replace(F.coalesce(command, F.lit("")), "'[^']*'|\"[^\"]*\"", "''")
    return bare.rlike(MUTATING) | bare.rlike(REDIRECT)


def categories(m: DataFrame) -> DataFrame:
    """(session, turn, category): error, action, coordination, research, navigation or decision."""
    t = turns(m).where("turn > 0")
    said = t.groupBy("session", "turn").agg(F.sum(F.when(F.col("role").isin("assistant", "model"), F.length(texts(m))).otherwise(0)).alias("chars"))
    c = tool_calls(m)
    shell, change = F.col("name") == "Bash", mutates(F.get_json_object("input", "$.command"))
    failed = shell & (F.col("result").contains("Error:") | F.col("result").contains("FAILED"))
    g = c.groupBy("session", "turn").agg(
        F.max("is_error").alias("bad"), (F.max(failed) & F.min(shell)).alias("failed"),
        F.max(F.col("name").isin(*ACTING) | (shell & change)).alias("acts"), F.max(F.col("name").isin(*LOOKING) | (shell & ~change)).alias("looks"), F.max(F.col("name").isin(*COORDINATING)).alias("talks"),
    )
    joined = said.join(g, ["session", "turn"], "left")
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    category = (
        F.when(yes("bad") | yes("failed"), "error").when(yes("acts"), "action").when(yes("talks") & ~yes("looks"), "coordination").when(yes("looks"), "research")
        .when((F.col("chars") < 100) & F.col("bad").isNull(), "navigation").otherwise("decision")
    )
    return joined.select("session", "turn", category.alias("category"))


def skeleton(name: Column, input_json: Column, result: Column) -> Column:
    """One line for a call: its name, path, command or query, and the size of its result."""
    what = F.coalesce(path_of(input_json), *(F.get_json_object(input_json, f"$.{k}") for k in ("command", "pattern", "query", "url")), F.lit(""))
    return F.concat(F.lit("["), name, F.lit(" "), F.left(what, F.lit(120)), F.lit(" → "), F.length(result).cast("string"), F.lit("c]"))
