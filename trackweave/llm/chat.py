"""Chat formatting by a grammar round trip (operator 5)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.scratch import lean
from trackweave.session import reach_workers

#: What opens and closes a turn of each role; any other role's name stands in its opening.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
NAME_END = "[NAME]"
LOSS_ROLE = "assistant"

CONTROLS = [m for pair in [*MARKS.values(), OTHER] for m in pair] + [NAME_END]
_CONTROL = "|".join(map(re.escape, CONTROLS))
#: A control string with any number of backslashes behind its first character.
_MAYBE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_TURN = re.compile(
    "|".join(f"{re.escape(o)}(?P<{role}>(?:(?!{_CONTROL}).)*){re.escape(c)}" for role, (o, c) in MARKS.items())
    + f"|{re.escape(OTHER[0])}(?P<name>(?:(?!{_CONTROL}).)*){re.escape(NAME_END)}(?P<other>(?:(?!{_CONTROL}).)*){re.escape(OTHER[1])}",
    re.DOTALL,
)


class ParseError(ValueError):
    """The text isn't a sequence of turns."""


def escaped(text: str) -> str:
    """One backslash more in all that is, or looks like, a control string."""
    return _MAYBE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return _MAYBE.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def _turn(m: re.Match) -> tuple[str, str]:
    """Role and text of a matched turn."""
    return unescaped(m["name"]) if m.lastgroup == "other" else m.lastgroup, unescaped(m[m.lastgroup])


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the raw text's start and end of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        if not (m := _TURN.match(text, at)):
            raise ParseError(f"no turn at {at}")
        out.append((*_turn(m), *m.span(m.lastgroup)))
        at = m.end()
    return out


def render(role: str, text: str) -> str:
    """One turn. Content goes in as it is; if parsing doesn't give it back, its control strings are escaped."""
    for change in (lambda x: x, escaped):
        opening, closing = MARKS.get(role) or (OTHER[0] + change(role) + NAME_END, OTHER[1])
        out = opening + change(text) + closing
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out
        except ParseError:
            continue
    raise ParseError("a turn can't be read back")


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """Render each row (conv_id, turn, role, text) to its ``segment``; a conversation's text is its segments by turn.

    Defined cases: a null text or role counts as empty; an empty role is one of the other roles;
    repeated rows each are a turn; an empty table gives none; other columns are ignored.
    """
    reach_workers(conversations.sparkSession)

    @F.pandas_udf("string")
    def segment(roles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([render(r, t) for r, t in zip(roles, texts, strict=True)], dtype=object)

    full = lambda c: F.coalesce(F.col(c), F.lit(""))
    return conversations.select("conv_id", "turn", segment(full("role"), full("text")).alias("segment"))


class _Reader:
    """Reads a conversation's text as it comes, whatever the pieces; keeps digests and the turn that isn't closed yet."""

    def __init__(self, key):
        self.key, self.n, self.chars, self.loss_chars, self.pending = key, 0, 0, 0, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str) -> None:
        self.chars += len(text)
        self.pending += text
        at = 0
        while m := _TURN.match(self.pending, at):
            at = m.end()
            role, said = _turn(m)
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode())
            if role == LOSS_ROLE:
                self.loss_chars += len(said)
                self.loss.update(said.encode())
        self.pending = self.pending[at:]

    def row(self) -> tuple:
        if self.pending:
            raise ParseError("the last turn isn't closed")
        return self.key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """Parse formatted conversations; one row each: turns, digests of turns and of what is under the loss mask, length.

    Rows go to a task by conversation and come sorted by turn (ties: by segment), and the task reads
    them as a stream, so a conversation's length doesn't bound memory.
    """
    reach_workers(segments.sparkSession)
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names, ids = None, [c.split()[0] for c in schema.split(", ")], None
        counts = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        packed = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [ids, *counts], strict=True)], names)
        for b in batches:
            ids, done = b.schema.field("conv_id").type, []
            for key, segment in zip(b.column("conv_id"), b.column("segment"), strict=True):
                key = key.as_py()  # exact, also where other ids are null
                if reader is None or key != reader.key:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(key)
                reader.feed(segment.as_py())
            if done:
                yield packed(done)
        if reader is not None:
            yield packed([reader.row()])

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(lean(read), schema)
