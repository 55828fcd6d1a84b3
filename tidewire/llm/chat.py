"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of turns (role, text) to a string.
Successive turn prefixes are rendered; each output must begin with the one
before, and what it adds is the turn's span.  A template whose output for a
longer prefix does not begin with the shorter one's rewrites history and is
reported (``rewrites``: the first such turn).  A turn's text is found inside
its span by rendering two stand-ins for it that differ in their first and last
characters.  Only for a template that its caller declares ``local`` (what a turn
adds depends on the last ``context`` turns alone, as with the default one) are
prefixes of more than ``prefix_turns`` turns rendered over the last ``context``
turns; the whole conversation is rendered once to verify the sum of the spans,
and if it differs, all prefixes are rendered whole.  All prefixes of any other
template are rendered, which takes a time that grows with the square of the
number of turns.

The default template marks turns and escapes control strings inside texts
reversibly: a backslash more goes into every ``<``, backslashes, ``|``.

Defined results: null text and null role are empty; rows of one conversation
are ordered by turn, then role, then text (null turns first); rows of a null
conv_id form one conversation; repeated rows are turns of their own; an empty
table gives no rows; further columns are not read.  Conversations are
streamed in order, one at a time: a conversation is one training example and
has to fit a task."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import map_arrow

Turn = tuple[str, str]
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_SPANS = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def chatml(turns: list[Turn]) -> str:
    return "".join(f"{START}{escape(role).replace(chr(10), LINE)}\n{escape(text)}{END}\n" for role, text in turns)


def read_chatml(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    found, at = [], 0
    for m in re.finditer(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", formatted, re.DOTALL):
        if m.start() != at:
            raise ValueError(f"text between turns at {at}")
        found.append((unescape(m[1].replace(LINE, "\n")), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"text after the last turn at {at}")
    return found


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _inside(render: Callable[[list[Turn]], str], before: list[Turn], turn: Turn) -> tuple[int, int]:
    """Characters of the template before and after the turn's text within its span."""
    base = len(render(before))
    a, b = render([*before, (turn[0], "aXa")])[base:], render([*before, (turn[0], "bXb")])[base:]
    return _common(a, b), _common(a[::-1], b[::-1])


def locate(turns: list[Turn], render: Callable[[list[Turn]], str] = chatml, prefix_turns: int = 64,
           context: int = 2, local: bool | None = None) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """(formatted, spans as (start, end, text start, text end), the first turn
    that rewrites history or None).  ``local``: by default that of ``chatml``
    alone."""
    local = render is chatml if local is None else local
    whole = render(turns)
    for near in (True, False) if local else (False,):
        out, spans, done = render([]), [], True
        for k, turn in enumerate(turns):
            far = near and k >= prefix_turns
            before = turns[k - context:k] if far else turns[:k]
            old = render(before) if far else out
            new = render([*before, turn])
            if not new.startswith(old):
                if far:
                    done = False
                    break
                return whole, spans, k
            lead, tail = _inside(render, before, turn)
            start, added = len(out), new[len(old):]
            spans.append((start, start + len(added), start + lead, start + len(added) - tail))
            out = out + added if far else new
        if done and out == whole:
            return whole, spans, None
    return whole, spans, len(turns) - 1


def _formatter(render: Callable[[list[Turn]], str], local: bool):
    def turns_of(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

    def send(rows):
        ids, texts, spans, breaks = zip(*rows, strict=True)
        span = pa.struct([("role", pa.string()), *((k, pa.int32()) for k in ("start", "end", "text_start", "text_end"))])
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string()),
                                pa.array(spans, pa.list_(span)), pa.array(breaks, pa.int32())],
                               names=["conv_id", "formatted", "spans", "rewrites"])

    def run(batches):
        rows, held = [], 0
        for conv, group in groupby(turns_of(batches), key=lambda r: r[0]):
            turns = [(role or "", text or "") for _, role, text in group]
            formatted, spans, breaks = locate(turns, render, local=local)
            rows.append((conv, formatted, [dict(zip(("role", "start", "end", "text_start", "text_end"), (t[0], *s),
                                                    strict=True)) for t, s in zip(turns, spans, strict=False)], breaks))
            held += len(formatted)
            if held > 1 << 20:
                yield send(rows)
                rows, held = [], 0
        if rows:
            yield send(rows)

    return run


def format_chats(turns: DataFrame, render: Callable[[list[Turn]], str] = chatml,
                 local: bool | None = None) -> DataFrame:
    """conv_id, formatted, spans (of each turn and of its text, in characters),
    rewrites (null if the template appends only)."""
    local = render is chatml if local is None else local  # here: executors have a copy of the template
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(dealt, _formatter(render, local), f"conv_id long, formatted string, spans {_SPANS}, rewrites int")


def _digest(batches):
    import hashlib

    for batch in batches:
        out = []
        for conv, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans")),
                                          strict=True):
            sha, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            found = read_chatml(formatted)
            for role, text in found:
                sha.update(f"{role}\n{text}\n".encode())
            for s in spans:
                if s["role"] == "assistant":
                    text = unescape(formatted[s["text_start"]:s["text_end"]])
                    loss.update(text.encode())
                    chars += len(text)
            out.append((conv, len(found), sha.hexdigest(), chars, loss.hexdigest(), len(formatted)))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                  names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                         "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What the default template's output says when it is read back."""
    return map_arrow(formatted.select("conv_id", "formatted", "spans"), _digest,
                     "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                     "formatted_chars long")
