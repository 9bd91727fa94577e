"""Preference pairs as training texts.

The chosen and the rejected conversation of a pair share their first turns. This longest
common prefix is rendered once, as the prompt; the turns after it are the two completions,
with the stretches in them that count for the loss: what the assistant says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Template:
    """How a turn is written: opening, role, break, text, end. ``marker`` cannot occur in a role or text;
    there it is written as ``escaped``."""

    opening: str = "<|start|>"
    break_: str = "\n"
    end: str = "<|end|>\n"
    marker: str = "<|"
    escaped: str = "< |"


def turns_of(conversations: DataFrame, by: str = "conv_id") -> DataFrame:
    """One row per conversation: its ``turns`` in the order of ``turn``, then role, then text.

    Null turn numbers come first, a null role or text is empty, repeated turns stay. Rows without
    an id belong to no other row: each is a conversation of its own. A conversation is one training record and has to
    fit into a row.
    """
    blank = F.lit("")
    rows = conversations.select(
        F.col(by),
        F.struct(F.col("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")).alias("t"),
    )
    plain = lambda turns: F.transform(turns, lambda t: F.struct(t["role"], t["text"])).alias("turns")
    whole = rows.filter(F.col(by).isNotNull()).groupBy(by).agg(plain(F.array_sort(F.collect_list("t"))))
    return whole.unionByName(rows.filter(F.col(by).isNull()).select(by, plain(F.array("t"))))


def pairs_by_last_reply(conversations: DataFrame, by: str = "conv_id", assistant: str = "assistant") -> DataFrame:
    """A pair for each conversation: ``chosen`` are its turns up to the assistant's last reply, ``rejected``
    the same turns with a stale reply, the assistant's first, in its place; ``closing`` are the turns after that reply.

    Where the first reply is no different text, the rejected turns end without a reply. Conversations
    without any reply are paired with themselves.
    """
    turns = turns_of(conversations, by)
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == assistant, i + 1)), lambda i: i.isNotNull())
    placed = turns.withColumn("replies", replies)
    last, first = F.try_element_at("replies", F.lit(-1)), F.try_element_at("replies", F.lit(1))
    stale = F.try_element_at("turns", first)
    before = F.slice("turns", 1, F.greatest(last - 1, F.lit(0)))
    differs = stale["text"] != F.try_element_at("turns", last)["text"]
    return placed.select(
        by,
        F.when(last.isNull(), F.col("turns")).otherwise(F.slice("turns", 1, F.coalesce(last, F.lit(0)))).alias("chosen"),
        F.when(last.isNull(), F.col("turns")).when(differs, F.concat(before, F.array(stale))).otherwise(before).alias("rejected"),
        F.when(last.isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("turns", F.coalesce(last, F.lit(0)) + 1, F.size("turns"))).alias("closing"),
    )


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the start that are equal in role and text."""
    shortest = F.least(F.size(a), F.size(b))
    equal = F.transform(F.slice(a, 1, shortest), lambda t, i: t.eqNullSafe(F.get(b, i)))
    mismatch = F.array_position(equal, F.lit(False))
    return F.when(mismatch > 0, mismatch - 1).otherwise(shortest).cast("int")


def _written(turn: Column, template: Template) -> tuple[Column, Column]:
    """What stands before the text of a turn, and the text with its end."""
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(template.marker), F.lit(template.escaped))
    head = F.concat(F.lit(template.opening), clean(turn["role"]), F.lit(template.break_))
    return head, F.concat(clean(turn["text"]), F.lit(template.end))


def rendered(turns: Column, template: Template = Template()) -> Column:
    """Turns as one text."""
    return _rendered(turns, template)


def _rendered(turns: Column, template: Template) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(*_written(t, template))), "")


def _trained(turns: Column, template: Template, assistant: str) -> Column:
    """Stretches (start, end), in characters, of the assistant's texts with their end marks."""
    sizes = F.transform(turns, lambda t: F.struct(*[F.length(p).alias(n) for n, p in zip(("head", "body"), _written(t, template))], (t["role"] == assistant).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        begin = done["at"] + t["head"]
        own = F.array(F.struct(begin.alias("start"), (begin + t["body"]).alias("end")))
        return F.struct((begin + t["body"]).alias("at"), F.when(t["own"], F.concat(done["spans"], own)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(sizes, start, step, lambda done: done["spans"])


def format_preferences(pairs: DataFrame, template: Template = Template(), assistant: str = "assistant") -> DataFrame:
    """Replace ``chosen`` and ``rejected`` (arrays of role and text) by texts: ``prompt``, the longest common
    turn prefix, and the two completions, with ``chosen_trained`` and ``rejected_trained``, the stretches
    (start, end) of the completions that count for the loss, and ``prompt_turns``.

    Other columns stay, columns of these names are replaced; repeated rows stay. A null conversation
    has no turns, a null role or text is empty. Conversations without a common turn have an empty
    prompt; of two equal ones everything is prompt and the completions are empty.
    """
    none = F.array().cast(f"array<{TURN}>")
    turns = {side: F.coalesce(F.col(side).cast(f"array<{TURN}>"), none) for side in ("chosen", "rejected")}
    sides = {side: F.transform(turns[side], lambda t: F.struct(*[F.coalesce(t[f], F.lit("")).alias(f) for f in ("role", "text")])) for side in turns}
    cut = pairs.withColumns(sides).withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    behind = {side: F.slice(side, F.col("prompt_turns") + 1, F.size(side)) for side in turns}
    parts = cut.withColumns({"prompt": F.slice("chosen", F.lit(1), F.col("prompt_turns")), **behind})
    return parts.withColumns(
        {f"{side}_trained": _trained(F.col(side), template, assistant) for side in turns}
    ).withColumns({side: _rendered(F.col(side), template) for side in ("prompt", *turns)})
