"""Conversations as training text: a role machine, a declarative template, loss flags for each segment.

A finite-state machine reads the roles of a conversation in turn order; its
state is the last role, and a table says which role may follow. A template gives
for each role what stands before and after a turn's text and whether the text
counts for the loss. The output is a table of segments; a conversation's
formatted text is its segments joined in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

START = "start"
SEGMENTS = "conv_id long, turn_no long, part string, role string, text string, loss boolean, allowed boolean"


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers by role, the control strings that texts may not hold, and the machine's table."""

    turns: dict[str, Turn]
    other: tuple[str, str, str]  # a turn of any other role: before the role's name, before the text, after it
    follows: dict[str, tuple[str, ...]]
    accepting: tuple[str, ...]
    escape: str = "\\"
    controls: tuple[str, ...] = field(default=())

    def pattern(self) -> re.Pattern:
        """Every place where a control string or the escape sign begins, overlapping ones too."""
        names = sorted({*self.controls}, key=len, reverse=True)
        return re.compile(f"{re.escape(self.escape)}|(?=({'|'.join(map(re.escape, names))})).", re.S)

    def reader(self) -> re.Pattern:
        """One turn of a formatted text; group names are r0, r1, … by role, and name and text for other roles."""
        known = [f"{re.escape(t.before)}(?P<r{i}>.*?){re.escape(t.after)}" for i, t in enumerate(self.turns.values())]
        a, b, c = map(re.escape, self.other)
        return re.compile("|".join([*known, f"{a}(?P<name>.*?){b}(?P<text>.*?){c}"]), re.S)


INSTRUCTION = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s> ", " </s>", loss=True),
    },
    other=("[ROLE] ", " [TEXT] ", " [/TEXT]"),
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)},
    accepting=("assistant",),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/TEXT]"),
)


def escaped(text: str, template: Template, pattern: re.Pattern) -> str:
    """``text`` with the escape sign doubled and put after the first character of each control string."""
    sign = template.escape
    return pattern.sub(lambda m: m.group() + sign, text)


def unescaped(text: str, template: Template) -> str:
    return re.sub(re.escape(template.escape) + "(.)", r"\1", text, flags=re.S) if template.escape in text else text


def segments(rows: Iterator[tuple], template: Template) -> Iterator[tuple]:
    """Segments of (conv_id, role, text) rows that come conversation by conversation, in turn order."""
    pattern = template.pattern()
    conv, state, n, first = None, START, 0, True
    for conv_id, role, text in rows:
        if first or conv_id != conv:
            conv, state, n, first = conv_id, START, 0, False
        allowed = role in template.follows.get(state, ())
        turn = template.turns.get(role)
        before, after = (turn.before, turn.after) if turn else (f"{template.other[0]}{escaped(role, template, pattern)}{template.other[1]}", template.other[2])
        yield conv_id, n, "before", role, before, False, allowed
        yield conv_id, n, "text", role, escaped(text, template, pattern), bool(turn and turn.loss), allowed
        yield conv_id, n, "after", role, after, False, allowed
        state, n = role, n + 1


def format_conversations(turns: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """Segments of ``turns`` (conv_id, turn, role, text), in order within each partition.

    One exchange brings each conversation together; its rows then stream through
    the task in turn order, so a conversation of any length needs the memory of
    one batch. Null texts and roles are empty; a null ``turn`` comes first, equal
    turns follow by role and text, and rows that repeat are turns of their own.
    Null ``conv_id`` is one conversation. A turn that the machine doesn't allow is
    formatted all the same, with ``allowed`` false. Other columns are not read. An
    empty table gives no segments.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_or_empty().alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

        yield from batched(segments(each(), template), SEGMENTS)

    return ordered.select("conv_id", "role", "text").mapInArrow(task, SEGMENTS)


ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def batched(rows: Iterator[tuple], schema: str, most: int = 4096, most_chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as record batches, bounded by rows and by characters."""
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    held, chars = [], 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(zip(*held, strict=True), types, strict=True)], list(names))

    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or chars >= most_chars:
            yield close()
            held, chars = [], 0
    if held:
        yield close()


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_refused long"


class Reader:
    """Reads one conversation's formatted text as it comes; holds the part that no whole turn has left yet."""

    def __init__(self, template: Template, pattern: re.Pattern):
        self.template, self.pattern = template, pattern
        self.names = list(template.turns)
        self.rest, self.chars, self.turns = "", 0, 0
        self.all, self.loss, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0
        self.refused, self.last = None, START

    def add(self, text: str, loss: bool, allowed: bool, part: str) -> None:
        self.chars += len(text)
        self.rest += text
        if loss:
            plain = unescaped(text, self.template)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        if not allowed and self.refused is None:
            self.refused = self.turns
        if part == "after":
            self.read()

    def read(self) -> None:
        at = 0
        while m := self.pattern.match(self.rest, at):
            if m.lastgroup == "text":
                role, text = unescaped(m["name"], self.template), m["text"]
            else:
                role, text = self.names[int(m.lastgroup[1:])], m[m.lastgroup]
            self.all.update(f"{role}\n{unescaped(text, self.template)}\n".encode("utf-8", "surrogatepass"))
            self.turns, self.last, at = self.turns + 1, role, m.end()
        self.rest = self.rest[at:]

    def row(self, conv_id) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv_id}: {len(self.rest)} characters are no turn")
        valid = self.refused is None and self.last in self.template.accepting
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid, self.refused


def read_conversations(formatted: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """One row per conversation, read back from the segments that ``format_conversations`` returned.

    Turns are found in the formatted text by the template's markers, the loss
    text by the segments' flags. It reads the partitions as they are, so no second
    exchange follows the first. ``valid``: the machine allowed every turn and
    ended in an accepting role; ``first_refused``: the number of the first turn
    that it didn't allow, or null.
    """
    pattern = template.reader()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader, conv = None, None
        for batch in batches:
            for conv_id, part, text, loss, allowed in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "text", "loss", "allowed")), strict=True):
                if reader is None or conv_id != conv:
                    if reader is not None:
                        yield reader.row(conv)
                    reader, conv = Reader(template, pattern), conv_id
                reader.add(text, loss, allowed, part)
        if reader is not None:
            yield reader.row(conv)

    return formatted.mapInArrow(lambda batches: batched(rows(batches), READ), READ)
