"""Chat formatting: a finite-state machine over roles checks turn order, a declarative template gives the text segments.

Turns are sorted by conversation, and each task walks through its turns once with the state of the current conversation
only, so a conversation of any length needs no more memory than its longest turn.

Control strings of the template that occur inside a text, or that it forms with the mark before or after it, are escaped by a
backslash inside them, and backslashes are doubled; ``unescape`` takes both back.  So no text holds a control string, and
formatted output can be parsed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How a role's turn is marked, and whether its text is learned."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, marks of any other role ({role} stands for its quoted name), and the machine's moves.

    ``moves`` maps (state, role) to the next state.  A turn without a move is an error; the machine then goes on as if the
    role had been allowed: to ``after_error`` of the role, or stays.
    """

    turns: dict[str, Turn]
    other: Turn
    moves: dict[tuple[str, str], str]
    start: str = "start"
    final: frozenset[str] = frozenset()
    after_error: dict[str, str] = field(default_factory=dict)
    controls: tuple[str, ...] = ()

    def turn(self, role: str) -> Turn:
        if role in self.turns:
            return self.turns[role]
        return Turn(self.other.before.replace("{role}", quote(role, safe="")), self.other.after, self.other.loss)


INSTRUCT = Template(
    turns={"system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": Turn("<s>[INST] ", " [/INST]"), "assistant": Turn("[ANS] ", " </s>", loss=True)},
    other=Turn("[TURN {role}] ", " [/TURN]"),
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    final=frozenset({"assistant"}),
    after_error={"system": "system", "user": "user", "assistant": "assistant"},
    controls=("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[TURN ", "[/TURN]"),
)


def escape(text: str, controls: tuple[str, ...], before: str = "", after: str = "") -> str:
    """``text`` without a control string, also none that it forms with the marks that stand before and after it."""
    text = text.replace("\\", "\\\\")
    whole, n = text + after, len(text)
    if any(c in whole for c in controls):
        starts = [m.start() for m in re.finditer("(?=" + "|".join(map(re.escape, controls)) + ")", whole) if m.start() < n]
        cuts = [0, *(k + 1 for k in starts), n]
        text = "\\".join(text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    if any(before.endswith(c[:k]) and (text + after).startswith(c[k:]) for c in controls for k in range(1, len(c))):
        text = "\\" + text
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


SEGMENTS = "conv_id long, turn_no long, part int, text string, loss boolean, state string, error string"


def format_conversations(turns: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments in order: (conv_id, turn_no, part 0 to 2, text, loss, state, error), sorted by conversation in each partition.

    ``turn_no`` counts a conversation's rows by ``turn`` (null first; ties by role, then text).  ``state`` is the machine's
    state after the turn.  ``error`` names a turn that the machine has no move for; such turns are formatted all the same.
    Null texts and roles count as empty; rows of a null conversation form one; an empty table gives no segment.
    """
    columns = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    ordered = columns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, number = object(), template.start, 0
        for batch in batches:
            out: list[tuple] = []
            for c, r, t in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if c != here:
                    here, state, number = c, template.start, 0
                r, t = r or "", t or ""
                to, error = template.moves.get((state, r)), None
                if to is None:
                    to, error = template.after_error.get(r, state), f"{r!r} after {state}"
                state, marks = to, template.turn(r)
                out += [(c, number, 0, marks.before, False, state, error), (c, number, 1, escape(t, template.controls, marks.before, marks.after), marks.loss, state, error), (c, number, 2, marks.after, False, state, error)]
                number += 1
            yield arrow_rows(out, SEGMENTS)

    return ordered.mapInArrow(segments, SEGMENTS)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def arrow_rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """A batch from row tuples and a DDL schema of simple types."""
    fields = [x.split() for x in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(v), _TYPES[t]) for v, (_, t) in zip(columns, fields, strict=True)], names=[k for k, _ in fields])


def parser(template: Template) -> re.Pattern:
    """Reads one turn off formatted text: the groups r<i> hold the texts of the i-th role, role and other those of any other."""
    known = [f"{re.escape(t.before)}(?P<r{i}>.*?){re.escape(t.after)}" for i, t in enumerate(template.turns.values())]
    head, tail = map(re.escape, template.other.before.split("{role}"))
    return re.compile("|".join([*known, f"{head}(?P<role>[^ ]*?){tail}(?P<other>.*?){re.escape(template.other.after)}"]), re.S)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_errors long, complete boolean"


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of each conversation, parsed from its formatted text and its loss mask.

    ``segments`` must be sorted as ``format_conversations`` leaves them.  A conversation's text is parsed turn by turn as it
    comes, so only an unfinished turn is held.  ``complete``: the machine ended in a final state without an error.
    """
    roles = list(template.turns)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = parser(template)
        open_, pending = None, ""

        def row() -> tuple:
            c, n, turns, chars, loss, formatted, errors, state = open_
            if pending:
                raise ValueError(f"conversation {c}: {pending[:80]!r} is no turn")
            return (c, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, errors, not errors and state in template.final)

        for batch in batches:
            out = []
            for c, part, text, loss, state, error in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "part", "text", "loss", "state", "error")), strict=True):
                if open_ is None or c != open_[0]:
                    if open_ is not None:
                        out.append(row())
                    open_, pending = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, template.start], ""
                pending += text
                open_[5] += len(text)
                open_[7] = state
                if loss:
                    plain = unescape(text)
                    open_[3] += len(plain)
                    open_[4].update(plain.encode("utf-8", "surrogatepass"))
                if part == 2:
                    open_[6] += error is not None
                    found = pattern.fullmatch(pending)
                    if found is None:
                        raise ValueError(f"conversation {c}: {pending[:80]!r} is no turn")
                    if found["other"] is not None:
                        role, said = unquote(found["role"]), found["other"]
                    else:
                        role, said = next((r, found[f"r{i}"]) for i, r in enumerate(roles) if found[f"r{i}"] is not None)
                    open_[1] += 1
                    open_[2].update(f"{role}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
                    pending = ""
            if out:
                yield arrow_rows(out, DIGESTS)
        if open_ is not None:
            yield arrow_rows([row()], DIGESTS)

    return segments.mapInArrow(digests, DIGESTS)
