"""Messages in the shapes of providers, as JSON columns, and what is read back from their events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _model(role: Column) -> Column:
    return role.isin("assistant", "model")


def block_message(role: Column, text: Column) -> Column:
    """A message whose content is one text block."""
    return _json(F.when(_model(role), "assistant").otherwise("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))


def chat_message(role: Column, text: Column) -> Column:
    """A message whose content is plain text."""
    return _json(F.when(_model(role), "assistant").otherwise("user").alias("role"), text.alias("content"))


def parts_message(role: Column, text: Column) -> Column:
    """A message of parts, in which the assistant is called model."""
    return _json(F.when(_model(role), "model").otherwise("user").alias("role"), F.array(F.struct(text.alias("text"))).alias("parts"))


def response_item(role: Column, text: Column) -> Column:
    """An item of a response list: input text, or output text of the assistant; null for an empty text, which is left out."""
    kind = F.when(_model(role), "output_text").otherwise("input_text")
    item = _json(F.lit("message").alias("type"), F.when(_model(role), "assistant").otherwise("user").alias("role"), F.array(F.struct(kind.alias("type"), text.alias("text"))).alias("content"))
    return F.when(F.length(text) > 0, item)


def flattened(blocks: Column) -> Column:
    """One text of an array of blocks (text, raw): texts joined by line ends, other blocks as their JSON; empty ones go."""
    one = F.transform(blocks, lambda b: F.coalesce(b["text"], b["raw"], F.lit("")))
    return F.array_join(F.filter(one, lambda t: t != ""), "\n")


def cache_mark(pos: Column, last: Column, boundary: Column) -> Column:
    """Whether the last block of a message closes a cached stretch: at the end of the sealed part, and at the very end."""
    return F.coalesce((boundary > 0) & (boundary <= last) & (pos == boundary - 1), F.lit(False)) | (pos == last)


def cached_system(prompt: Column, marker: str) -> Column:
    """The stable head of a system prompt, before the marker of its volatile tail; all of it where either part is blank."""
    at = F.instr(prompt, marker)
    head, tail = F.expr("NULL"), F.expr("NULL")
    head = F.substring(prompt, F.lit(1), at - 1)
    tail = F.substring(prompt, at, F.length(prompt))
    return F.when((at > 1) & (F.trim(head) != "") & (F.trim(tail) != ""), head).otherwise(prompt)


def input_tokens(event: Column) -> Column:
    """Tokens of an event's JSON: the total, else input, output and both cache counts; null where nothing was measured."""
    read = lambda path: F.get_json_object(event, f"$.properties.info.tokens.{path}").try_cast("long")
    parts = [F.coalesce(read(p), F.lit(0)) for p in ("input", "output", "cache.read", "cache.write")]
    total, summed = read("total"), parts[0] + parts[1] + parts[2] + parts[3]
    return F.when(F.get_json_object(event, "$.type") == "message.updated", F.when(total > 0, total).when(summed > 0, summed))


def session_id(event: Column) -> Column:
    return F.get_json_object(event, "$.properties.info.sessionID")


def identities(own: Column, others: Column) -> Column:
    """Source identities of a message: trimmed, without empty ones, each once, in order."""
    trimmed = F.transform(F.array_compact(F.concat(F.array(own), others)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))
