"""Chat formatting: a state machine over roles, and a declarative template with a loss flag per segment.

A conversation becomes a stream of segments: an opening mark, the escaped text of the turn, a closing mark. Only
segments that the template says so carry loss. Control strings inside texts are escaped, so the marks alone tell where
turns begin and end and the reader gets every role and text back exactly.

Rows of a conversation are sorted by turn (then role and text) and streamed: a conversation of any length needs memory
for one turn. Defined results: a null text is empty, a null role is the empty role, a null conversation id is a
conversation of its own, a null turn comes first, repeated rows are turns of their own, an empty table gives no rows.
Turn orders that the machine refuses are formatted all the same and flagged ``valid = false`` from that turn on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilohour.llm.common import sized_batches


@dataclass(frozen=True)
class Marks:
    """What stands around a turn of one role, and whether its text carries loss."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, and the roles that may follow each role (``None``: the start)."""

    roles: dict[str, Marks] = field(
        default_factory=lambda: {
            "system": Marks("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": Marks("<s>[INST] ", " [/INST]"),
            "assistant": Marks(" [OUT] ", "</s>", loss=True),
        }
    )
    # A role without marks of its own: its name, escaped, stands between the first two.
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/TEXT]")
    follows: dict[str | None, tuple[str, ...]] = field(
        default_factory=lambda: {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    def controls(self) -> list[str]:
        """All control strings without the white space around them, longest first."""
        marks = {m.strip() for r in self.roles.values() for m in (r.opening, r.closing)} | {o.strip() for o in self.other}
        marks |= {part for m in marks for part in m.split()}  # "<s>[INST]" may also come apart
        marks |= {part for m in marks for part in re.findall(r"<+/?\w+>+|\[/?\w+\]", m)}
        return sorted(marks, key=lambda m: (-len(m), m))


class Escaper:
    """Control string number k becomes a backslash and the k-th letter; a backslash is doubled."""

    def __init__(self, controls: list[str]):
        if len(controls) > 52 or any("\\" in c for c in controls):
            raise ValueError("at most 52 control strings, none with a backslash")
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
        self.code = {"\\": "\\\\"} | {c: "\\" + letters[i] for i, c in enumerate(controls)}
        self.text = {v: k for k, v in self.code.items()}
        self.find = re.compile("|".join(map(re.escape, ["\\", *controls])))
        self.back = re.compile(r"\\.", re.DOTALL)

    def escape(self, text: str) -> str:
        return self.find.sub(lambda m: self.code[m[0]], text)

    def unescape(self, text: str) -> str:
        return self.back.sub(lambda m: self.text[m[0]], text)


SEGMENTS = "conv_id {id}, segment long, turn long, role string, text string, loss boolean, valid boolean"


def format_conversations(df: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of all conversations, each partition sorted by conversation and segment.

    Columns: conv_id, segment (from 0), turn, role, text, loss, valid. Concatenating the texts of a conversation gives
    its formatted form.
    """
    template = template or Template()
    kind = dict(df.dtypes)["conv_id"]
    rows = df.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = Escaper(template.controls())
        now, began, before, number, good = None, False, None, 0, True
        for batch in sized_batches(batches, "text"):
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not began or conv != now:
                    now, began, before, number, good = conv, True, None, 0, True
                good = good and role in template.follows.get(before, ())
                before = role
                marks = template.roles.get(role)
                if marks:
                    parts = ((marks.opening, False), (escaper.escape(text), marks.loss), (marks.closing, False))
                else:
                    head = template.other[0] + escaper.escape(role) + template.other[1]
                    parts = ((head, False), (escaper.escape(text), False), (template.other[2], False))
                for part, loss in parts:
                    out.append((conv, number, turn, role, part, loss, good))
                    number += 1
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                ["conv_id", "segment", "turn", "role", "text", "loss", "valid"],
            )

    return rows.mapInArrow(run, SEGMENTS.format(id=kind))


class Reader:
    """Turns of one conversation, read from its formatted text piece by piece."""

    def __init__(self, template: Template):
        self.template, self.escaper = template, Escaper(template.controls())
        self.start = {m.opening: (r, m.closing) for r, m in template.roles.items()}
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """Role and text of each turn that ends inside what has come so far."""
        self.rest += piece
        while True:
            found = self._turn()
            if found is None:
                return
            yield found

    def _turn(self) -> tuple[str, str] | None:
        text, other = self.rest, self.template.other
        for opening, (role, closing) in self.start.items():
            if text.startswith(opening):
                return self._until(len(opening), closing, role)
        if text.startswith(other[0]) and (middle := text.find(other[1], len(other[0]))) >= 0:
            return self._until(middle + len(other[1]), other[2], self.escaper.unescape(text[len(other[0]) : middle]))
        return None

    def _until(self, begin: int, closing: str, role: str) -> tuple[str, str] | None:
        # White space of a text may look like that of a mark; only the control string itself is sure, so the mark's
        # own white space is cut off from the end of what stands before it.
        core = closing.strip()
        lead = closing[: closing.index(core)]
        at = self.rest.find(core, begin)
        if at < 0 or len(self.rest) < at - len(lead) + len(closing):
            return None
        body = self.rest[begin : at - len(lead)]
        self.rest = self.rest[at - len(lead) + len(closing) :]
        return role, self.escaper.unescape(body)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of every conversation, read from the formatted segments of ``format_conversations`` alone.

    The reader sees the texts and loss flags, not the roles: roles come from the marks. Segments must be in order inside
    their partitions, as the formatter leaves them. A turn is held until its closing mark has come.
    """
    template = template or Template()
    kind = dict(segments.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        done: list[tuple] = []
        state = None

        def close() -> None:
            conv, reader, turns, loss, n_turns, loss_chars, chars, valid = state
            if reader.rest:
                raise ValueError(f"conversation {conv} ends inside a turn")
            done.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))

        def flush() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [()] * 7
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"],
            )
            done.clear()
            return out

        for batch in batches:
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            for conv, piece, loss, valid in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True]
                for role, text in state[1].feed(piece):
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[4] += 1
                if loss:
                    plain = state[1].escaper.unescape(piece)
                    state[3].update(plain.encode())
                    state[5] += len(plain)
                state[6] += len(piece)
                state[7] = state[7] and valid
            if done:
                yield flush()
        if state is not None:
            close()
            yield flush()

    return segments.select("conv_id", "text", "loss", "valid").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )
