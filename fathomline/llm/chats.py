"""Chat formatting with a template that is only ever called, never looked into.

The template is a function from a list of messages to a string. Rendering the turns 1..k-1 and 1..k and
comparing the two outputs gives the span of turn k; where the longer output does not start with the
shorter one, the template has rewritten history. Where a text lies inside its span is told by
rendering two probe texts in its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Message = dict[str, str]
Template = Callable[[list[Message]], str]

# Turns whose prefixes are rendered from one starting point.
BLOCK = 8

# The control strings of the marked-turn template.
CONTROLS = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]", "[END]",
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Break every control string in a text; ``unescape`` gives the text back."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text) if "\\" in text else text


def appending(template: Template) -> Template:
    """Declare that a template only appends: a turn's output stays as it is and sees no turn before its predecessor."""
    template.appending = True
    return template


@appending
def marked_turns(messages: list[Message]) -> str:
    """The template of the registered query: [INST] marks users, </s> ends assistants."""
    out = ["<s>"]
    for m in messages:
        role, text = m["role"], escape(m["text"])
        if role == "user":
            out.append(f"[INST]{text}[/INST]")
        elif role == "assistant":
            out.append(f"{text}</s>")
        elif role == "system":
            out.append(f"<<SYS>>{text}<</SYS>>")
        else:
            out.append(f"[TURN]{escape(role)}[/TURN]{text}[END]")
    return "".join(out)


_ROLE_OF_END = {"[/INST]": "user", "</s>": "assistant", "<</SYS>>": "system"}


def read_marked(formatted: str) -> Iterator[Message]:
    """The turns of a ``marked_turns`` output."""
    at, role = len("<s>"), None
    for m in _CONTROL.finditer(formatted, at):
        piece = formatted[at:m.start()]
        at = m.end()
        if m[0] == "[/TURN]":
            role = unescape(piece)
        elif m[0] == "[END]":
            yield {"role": role, "text": unescape(piece)}
        elif m[0] in _ROLE_OF_END:
            yield {"role": _ROLE_OF_END[m[0]], "text": unescape(piece)}


class Span:
    """A turn's place in the whole output, and its text's place (both in code points)."""

    __slots__ = ("start", "end", "text_start", "text_end", "rewrites")

    def __init__(self, start: int, end: int, text_start: int, text_end: int, rewrites: bool) -> None:
        self.start, self.end, self.rewrites = start, end, rewrites
        self.text_start, self.text_end = text_start, text_end


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _tail(a: str, b: str) -> int:
    return _common(a[::-1], b[::-1])


def _frame(template: Template, before: list[Message], role: str, base: int, known: dict) -> tuple[int, int]:
    """Characters of a turn's span before and after its text, from two probe texts."""
    key = (bool(before), before[-1]["role"] if before else None, role)
    if key not in known:
        one = template([*before[-1:], {"role": role, "text": "x"}])
        two = template([*before[-1:], {"role": role, "text": "yy"}])
        start = len(template(before[-1:])) if before else len(template([]))
        known[key] = (_common(one, two) - start, _tail(one, two))
    return known[key]


def render_turns(messages: list[Message], template: Template) -> tuple[str, list[Span]]:
    """Output of all messages and the span of each, by rendering every prefix.

    A span whose turn changed what stood before it is marked ``rewrites`` and begins where the
    outputs part.
    """
    spans: list[Span] = []
    frames: dict = {}
    last = template([])
    for k in range(1, len(messages) + 1):
        now = template(messages[:k])
        rewrites = not now.startswith(last)
        start = _common(last, now) if rewrites else len(last)
        head, tail = _frame(template, messages[:k - 1], messages[k - 1]["role"], start, frames)
        spans.append(Span(start, len(now), min(start + max(head, 0), len(now)), max(len(now) - tail, start), rewrites))
        last = now
    return last, spans


def render_long(messages: list[Message], template: Template, block: int = BLOCK) -> tuple[str, list[Span]]:
    """As ``render_turns``; for templates declared ``appending``, each prefix only from the start of its block.

    A block is rendered after the last turn of the block before it. Any other template may change what stands
    any number of turns back, so all its prefixes are rendered from the beginning, and so are those of a
    template whose blocks rewrite history or do not add up to its output of all messages.
    """
    if len(messages) <= block or not getattr(template, "appending", False):
        return render_turns(messages, template)
    out, spans = render_turns(messages[:block], template)
    pieces, at = [out], len(out)
    broken = any(s.rewrites for s in spans)
    for low in range(block, len(messages), block):
        if broken:
            break
        text, found = render_turns([*messages[low - 1:low], *messages[low:low + block]], template)
        cut = found[0].end
        broken = any(s.rewrites for s in found)
        spans += [Span(s.start - cut + at, s.end - cut + at, s.text_start - cut + at, s.text_end - cut + at, False) for s in found[1:]]
        pieces.append(text[cut:])
        at += len(text) - cut
    out = "".join(pieces)
    return render_turns(messages, template) if broken or out != template(messages) else (out, spans)


FORMATTED = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>, rewrites boolean"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Message]]]:
    rows = (
        (c, {"role": r or "", "text": t or ""})
        for b in batches
        for c, r, t in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist())
    )
    for key, turns in groupby(rows, key=lambda x: x[0]):
        yield key, [m for _, m in turns]


def format_chats(
    turns: DataFrame, template: Template = marked_turns, *, learn: tuple[str, ...] = ("assistant",),
    block: int = BLOCK,
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (spans of the learnt texts), rewrites.

    Turns are ordered by turn, then role and text (nulls first, so ties and repeated rows keep a fixed
    place and all are rendered). A null role or text is an empty one, rows with a null conv_id form one
    conversation, an empty table gives none, extra columns are ignored. A task holds one conversation
    at a time. Where the template is declared ``appending``, prefixes are rendered in blocks and the work grows
    with the length; for all others every prefix is rendered, and it grows with the square.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for key, messages in _conversations(batches):
            text, spans = render_long(messages, template, block)
            loss = [{"start": s.text_start, "end": s.text_end} for m, s in zip(messages, spans) if m["role"] in learn]
            held.append((key, len(messages), text, loss, any(s.rewrites for s in spans)))
            size += len(text)
            if size > 1 << 22:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return (
        turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
        .mapInArrow(run, FORMATTED)
    )


_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("rewrites", pa.bool_()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, rewrites boolean"
)


def read_back(formatted: DataFrame, reader: Callable[[str], Iterator[Message]] = read_marked) -> DataFrame:
    """Digests of what a reader finds in the output: every turn, and all text under the loss mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for key, text, loss, rewrites in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "rewrites"))):
                whole, learnt, chars, n = hashlib.sha256(), hashlib.sha256(), 0, 0
                for m in reader(text):
                    whole.update(f"{m['role']}\n{m['text']}\n".encode())
                    n += 1
                for span in loss:
                    piece = unescape(text[span["start"]:span["end"]])
                    learnt.update(piece.encode())
                    chars += len(piece)
                for column, value in zip(out, (key, n, whole.hexdigest(), chars, learnt.hexdigest(), len(text), rewrites)):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return formatted.select("conv_id", "formatted", "loss", "rewrites").mapInArrow(run, DIGEST)


def with_planted(turns: DataFrame) -> DataFrame:
    """The turns plus conversation -7, whose texts are made of control strings."""
    rows = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(rows)
