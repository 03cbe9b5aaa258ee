"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags.

Turns of a conversation are streamed in order past the machine, which holds one state and
emits text segments: an opening mark, the escaped text, a closing mark, each with its loss
flag. Control strings inside texts are broken by a backslash, reversibly. Reading streams the
segments back and hashes as it goes, so a conversation of any length needs no more memory
than its longest turn. The hashes of one conversation are sequential, so its segments pass
through one task, in order and spilled by the sort where need be.

Defined cases: a null text or role is empty; turns that share a number are ordered by role,
then text; rows without a conversation id form one conversation; repeated turns all stay;
turns that break the order are formatted too and counted in ``n_faults``, as is an end after
a role that may not end a conversation.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import written

SEGMENTS = "conv_id long, seq long, text string, loss boolean, fault boolean"


@dataclass(frozen=True)
class Template:
    """Marks, control strings, the roles whose texts are learnt, and the allowed next roles.

    "" stands for the start of a conversation; ``last`` are the roles that may end it. The opening
    and the closing mark are controls whether listed or not; all are escaped inside texts.
    """

    opening: str = "<|im_start|>"
    header_end: str = "\n"
    closing: str = "<|im_end|>\n"
    # Strings that chat models take for control.
    controls: tuple[str, ...] = (
        "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    )
    learnt: tuple[str, ...] = ("assistant",)
    after: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user", "tool")), ("tool", ("assistant",)),
    )
    last: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for control in self.guarded():
            if len(control) < 2 or "\\" in control:
                raise ValueError(f"a mark or control string needs two characters or more, white space around it apart, and no backslash: {control!r}")
        for start, roles in self.after:
            if "" in roles:
                raise ValueError(f"nothing leads back to the start, but {start!r} does")

    def guarded(self) -> tuple[str, ...]:
        """All strings that must not stand whole in an escaped text."""
        return tuple(dict.fromkeys((*self.controls, self.opening.strip(), self.closing.strip())))


@cache
def _starts(controls: tuple[str, ...]) -> re.Pattern:
    return re.compile(f"(?s)(?={'|'.join(map(re.escape, controls))}).")


def escape(text: str, template: Template) -> str:
    """The text with backslashes doubled and every control string, overlapping ones too, broken after its first character."""
    return _starts(template.guarded()).sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    picked = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_segments(
    turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, seq, text, loss, fault): three segments per turn, in order by seq."""
    template = template or Template()
    allowed = dict(template.after)
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("fault", pa.bool_())])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)

    def run(stream):
        # The closing segment waits for the next row: only then is it known whether the conversation ends.
        waiting: tuple | None = None
        state, seq = "", 0

        def closed(ends: bool) -> list[tuple]:
            return [] if waiting is None else [(*waiting, template.closing, False, ends and state not in template.last)]

        for batch in (whole.slice(k, 1024) for whole in stream for k in range(0, len(whole), 1024)):
            out: list[tuple] = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ends = waiting is not None and conv != waiting[0]
                out += closed(ends)
                if ends:
                    state, seq = "", 0
                out.append((conv, seq, template.opening + escape(role, template) + template.header_end, False, role not in allowed.get(state, ())))
                out.append((conv, seq + 1, escape(text, template), role in template.learnt, False))
                waiting, state, seq = (conv, seq + 2), role, seq + 3
            yield batch_of(out)
        if waiting is not None:
            yield batch_of(closed(True))

    return _ordered(turns, conv_col, turn_col, role_col, text_col).mapInArrow(run, SEGMENTS)


class _Conversation:
    """What is gathered while the segments of one conversation pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.role = conv_id, None
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = self.faults = 0

    def take(self, text: str, loss: bool, fault: bool, template: Template) -> None:
        self.formatted += len(text)
        self.faults += fault
        if self.role is None:
            if not text.startswith(template.opening):
                raise ValueError("a turn without an opening mark")
            self.role = unescape(text[len(template.opening) : len(text) - len(template.header_end)])
            self.turns.update(self.role.encode("utf-8", "surrogatepass") + b"\n")
            self.n_turns += 1
        elif text == template.closing:
            self.role = None
        else:
            plain = unescape(text)
            data = plain.encode("utf-8", "surrogatepass")
            self.turns.update(data + b"\n")
            if loss:
                self.loss.update(data)
                self.loss_chars += len(plain)

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, self.faults


def read_segments(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, parsed back from its segments."""
    template = template or Template()
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_faults", pa.int64())]
    )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    def run(stream):
        open_: _Conversation | None = None
        for batch in (whole.slice(k, 2048) for whole in stream for k in range(0, len(whole), 2048)):
            over = []
            for conv, text, loss, fault in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if open_ is None or conv != open_.conv_id:
                    if open_ is not None:
                        over.append(open_.row())
                    open_ = _Conversation(conv)
                open_.take(text, loss, fault, template)
            yield batch_of(over)
        if open_ is not None:
            yield batch_of([open_.row()])

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_faults long")


def formatted(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Format, write the segments to the shared folder, and read the conversations back."""
    return read_segments(written(format_segments(turns, template), "chat-segments"), template)
