"""Chat formatting by incremental black-box rendering: what a template adds for a turn is seen by rendering prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BooleanType, LongType, StringType, StructField, StructType)

Message = tuple[str, str]

#: Two texts that differ from the first to the last character.
PROBES = ("\ue000", "\ue001")


@dataclass(frozen=True)
class Template:
    """A black box: ``render`` turns messages (role, text) into one string, also for no message at all.

    ``unescape`` gives back a text from its place in the output, ``read`` all messages from the whole output.
    """

    render: Callable[[list[Message]], str]
    unescape: Callable[[str], str]
    read: Callable[[str], list[Message]]


_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """No ``<|`` is left; each one, however often escaped already, gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render_turns(messages: list[Message]) -> str:
    return "".join(f"{_OPEN}{_role(role)}\n{escape(text)}{_CLOSE}\n" for role, text in messages)


def read_turns(formatted: str) -> list[Message]:
    out = []
    for part in formatted.split(_OPEN)[1:]:
        role, _, text = part.removesuffix("\n").removesuffix(_CLOSE).partition("\n")
        out.append((_role_back(role), unescape(text)))
    return out


TURNS = Template(render_turns, unescape, read_turns)


@dataclass
class Located:
    """The output, whether the template rewrote what it had rendered before, and for each turn (start, end, text start,
    text end) in code points, or None where the turn cannot be told apart in the output."""

    formatted: str
    rewrites: bool
    spans: list[tuple[int, int, int, int] | None]


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def _text_place(render, context: list[Message], role: str, before: int, piece: int) -> tuple[int, int]:
    """Where the text lies in what the turn adds: the two probes differ nowhere else."""
    one, two = (render([*context, (role, p)])[before:] for p in PROBES)
    first, last = _common(one, two), _common(one[::-1], two[::-1])
    return first, max(first, piece - last)


def locate(messages: list[Message], render: Callable[[list[Message]], str]) -> Located:
    """Renders every prefix in full and compares consecutive outputs.

    A template that only appends gives each turn the part by which the output grew. Where an output does not go on from the one
    before it, the template rewrites history, also if the output of the whole shows no trace of it; a turn is then located if
    what it added is still in place at the end. A black box can only be known by its outputs, so a conversation costs the
    square of its turns; two outputs are held at a time.
    """
    whole = render(messages)
    before, rewrites, spans = render([]), False, []
    for k, (role, _) in enumerate(messages):
        after = render(messages[:k + 1]) if k + 1 < len(messages) else whole
        start = len(before)
        if not after.startswith(before):
            rewrites, start = True, _common(before, after)
        if whole[start:len(after)] == after[start:]:
            first, last = _text_place(render, messages[:k], role, start, len(after) - start)
            spans.append((start, len(after), start + first, start + last))
        else:
            spans.append(None)
        before = after
    return Located(whole, rewrites, spans)


_SPAN = ("role", "start", "end", "text_start", "text_end")
_SPAN_TYPE = StructType([StructField("role", StringType()), *[StructField(n, LongType()) for n in _SPAN[1:]]])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Message]]]:
    """Conversations from sorted rows; one may reach over several batches."""
    open_id, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or conv != open_id:
                if begun:
                    yield open_id, turns
                open_id, turns, begun = conv, [], True
            turns.append((role or "", text or ""))
    if begun:
        yield open_id, turns


def _formatted(template: Template):
    span_type = pa.list_(pa.struct([("role", pa.string()), *[(n, pa.int64()) for n in _SPAN[1:]]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = [], 0
        for conv, turns in _conversations(batches):
            found = locate(turns, template.render)
            rows.append((conv, len(turns), found.formatted, found.rewrites, [
                dict(zip(_SPAN, (role, *span))) for (role, _), span in zip(turns, found.spans) if span]))
            weight += len(found.formatted)
            if weight > 4_000_000:
                yield batch_of(rows)
                rows, weight = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), span_type)
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "formatted", "rewrites", "spans"])
    return run


def format_conversations(turns: DataFrame, template: Template = TURNS) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, ``formatted``, ``rewrites`` and ``spans`` of the turns.

    ``turns`` has conv_id, turn, role and text. Rows are dealt by conversation, sorted by turn (null first, then role and
    text among equal turns) and streamed; a task holds one conversation at a time. Offsets are code points.

    Null texts and roles are empty; turns without a conv_id form the conversation null; repeated rows are turns like
    any other; an empty table gives no rows; further columns are left out.
    """
    schema = StructType([
        StructField("conv_id", LongType()), StructField("n_turns", LongType()), StructField("formatted", StringType()),
        StructField("rewrites", BooleanType()), StructField("spans", ArrayType(_SPAN_TYPE))])
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_formatted(template), schema)


def loss_text(formatted: str, spans: list[dict], template: Template, roles: tuple[str, ...] = ("assistant",)) -> str:
    """All text under the loss mask, unescaped: the texts of the given roles, in order."""
    return "".join(template.unescape(formatted[s["text_start"]:s["text_end"]]) for s in spans if s["role"] in roles)


def _digested(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            ids, texts, spans = batch.columns
            turns = [template.read(t) for t in texts.to_pylist()]
            loss = [loss_text(t, s, template) for t, s in zip(texts.to_pylist(), spans.to_pylist())]
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(map(len, turns), pa.int64()),
                pa.array([sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns]),
                pa.array(map(len, loss), pa.int64()), pa.array(map(sha, loss), pa.string()),
                pa.array(map(len, texts.to_pylist()), pa.int64()),
            ], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return run


def digests(formatted: DataFrame, template: Template = TURNS) -> DataFrame:
    """What can be read back from the formatted conversations: turns, and the text under the loss mask."""
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(
        _digested(template),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
