"""Operator 1: chat formatting with a grammar round trip.

A conversation is rendered as one string. Each turn is an opener, the text and
a closer; the three known roles have their own control strings, any other role
is written out in the opener. A text that holds a control string is escaped (the
opener says so): a backslash breaks up each of them, so none ever stands in a
text, and backslashes are doubled. After rendering, a deterministic parser reads
the string back and the recovered turns are compared with the source. Turns that
do not survive are rendered again at the next level, until the recovered turns
are identical: verbatim, then control strings and backslashes escaped, then
every character that a control string could be made of. Only conflicting content is
ever changed, and parsing undoes it.

One shuffle by conversation; the rest is per conversation.

Defined results: null text or role counts as empty; turns are ordered by turn
number (nulls first), ties by role and text, so repeated rows stay and stand
side by side; rows without a conversation id form the conversation null; other
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template: opener and closer by role.
OPENERS = {"system": "<<SYS>>", "user": "[INST]", "assistant": "[ANSWER]"}
CLOSERS = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER_CLOSER = "[/TURN]"
CONTROLS = [*OPENERS.values(), *CLOSERS.values(), "[TURN", OTHER_CLOSER]

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_CONFLICT = re.compile(_CONTROL.pattern + r"|\\")
_ANY_START = re.compile(r"[\\<>\[\]/]|(?<=\[)T")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
# An opener: a known one or [TURN role]; then the level as a run of "!", then a blank.
_OPENER = re.compile(
    "(?:" + "|".join(f"(?P<{r}>{re.escape(o)})" for r, o in OPENERS.items())
    + r"|\[TURN (?P<other>(?:\\.|[^\\\]])*)\])(?P<level>!{0,2}) ", re.DOTALL)
_BODY = {
    (role, level): re.compile(("(.*?)" if not level else r"((?:\\.|[^\\])*?)") + " " + re.escape(closer), re.DOTALL)
    for role, closer in [*CLOSERS.items(), (None, OTHER_CLOSER)] for level in range(3)}


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:  # a control string is broken up behind its first character
        return _CONFLICT.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)
    return _ANY_START.sub(lambda m: "\\" + m[0], text)


def unescape(text: str, level: int) -> str:
    return _ESCAPED.sub(r"\1", text) if level else text


def render_turn(role: str, text: str, level: int) -> str:
    opener = OPENERS.get(role) or f"[TURN {escape(role, 2)}]"
    return f"{opener}{'!' * level} {escape(text, level)} {CLOSERS.get(role, OTHER_CLOSER)}"


def parse(rendered: str) -> list[tuple[str, str, int, int, int]] | None:
    """``(role, text, start, stop, level)`` of each turn: where its content
    stands in the string, and unescaped. None if it is not a whole sentence of
    the grammar."""
    out, at = [], 0
    while at < len(rendered):
        head = _OPENER.match(rendered, at)
        if not head:
            return None
        role = next((r for r in OPENERS if head[r] is not None), None)
        level = len(head["level"])
        body = _BODY[role, level].match(rendered, head.end())
        if not body:
            return None
        name = role if role is not None else unescape(head["other"], 2)
        out.append((name, unescape(body[1], level), body.start(1), body.end(1), level))
        at = body.end()
    return out


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int, int]]]:
    """The rendered conversation and its turns read back from it."""
    levels = [1 if _CONTROL.search(text) else 0 for _, text in turns]
    for level in (0, 1, 2):
        rendered = "".join(render_turn(r, t, n) for (r, t), n in zip(turns, levels, strict=True))
        back = parse(rendered)
        if back is not None and [(r, t) for r, t, *_ in back] == turns:
            return rendered, back
        for i, (role, text) in enumerate(turns):  # which turns do not survive by themselves
            alone = parse(render_turn(role, text, levels[i]))
            if levels[i] <= level and (alone is None or [(r, t) for r, t, *_ in alone] != [(role, text)]):
                levels[i] = level + 1
    raise AssertionError("the grammar escapes every text at its last level")


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` string, and ``turns``
    read back from it, an array of ``(role, text, start, stop, in_loss)``;
    ``start``/``stop`` are code point positions of the (escaped) content in
    ``formatted``, ``in_loss`` marks the spans under the loss mask: the content
    of assistant turns."""
    empty = F.lit("")
    rows = df.select(F.col(conv).alias("conv"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text).cast("string"), empty).alias("text")).alias("t"))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    kind = df.schema[conv].dataType.simpleString()
    shape = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("start", pa.int64()),
                                ("stop", pa.int64()), ("in_loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, turns = [], []
            for conversation in batch.column(1).to_pylist():
                rendered, back = format_turns([(x["role"], x["text"]) for x in conversation])
                formatted.append(rendered)
                turns.append([{"role": r, "text": t, "start": a, "stop": b, "in_loss": r == "assistant"}
                              for r, t, a, b, _ in back])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(formatted, pa.string()), pa.array(turns, shape)],
                ["conv", "formatted", "turns"])

    out = grouped.mapInArrow(run, f"conv {kind}, formatted string, turns array<struct<role:string,text:string,"
                                  "start:long,stop:long,in_loss:boolean>>")
    return out.withColumnRenamed("conv", conv)
