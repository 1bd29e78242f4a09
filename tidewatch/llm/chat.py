"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation:

    chat      = "<s>" turn*
    turn      = "[INST] " content " [/INST]"            user
              | "[SYS] " content " [/SYS]"              system
              | "[ROLE " name "] " content " [/ROLE]"   any other role
              | content "</s>"                          assistant
    content   = characters; a backslash makes the next character plain

A deterministic parser reads the rendered text back. Texts are first written as they
are; turns that the parser does not recover are escaped (a backslash before every control
string and backslash), until the recovered turns equal the source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

START = "<s>"
OPEN = {"user": "[INST] ", "system": "[SYS] "}
CLOSE = {"user": " [/INST]", "system": " [/SYS]", "assistant": "</s>"}
OTHER_CLOSE = " [/ROLE]"
CONTROL = re.compile(r"\\|<s>|</s>|\[/?INST\]|\[/?SYS\]|\[ROLE|\[/ROLE\]")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
NAME = re.compile(r"\[ROLE ((?:\\.|[^\\\]])*)\] ", re.DOTALL)
ENDS = {c: re.compile(r"\\.|" + re.escape(c), re.DOTALL) for c in [*CLOSE.values(), OTHER_CLOSE]}

Turn = tuple[str, str]


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _turn(role: str, content: str) -> str:
    if role == "assistant":
        return content + CLOSE[role]
    if role in OPEN:
        return OPEN[role] + content + CLOSE[role]
    return "[ROLE " + re.sub(r"([\\\]])", r"\\\1", role) + "] " + content + OTHER_CLOSE


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of every turn, with the span of its content; None if the
    text does not follow the grammar."""
    if not formatted.startswith(START):
        return None
    at, turns = len(START), []
    while at < len(formatted):
        role, close = "assistant", CLOSE["assistant"]
        for known, mark in OPEN.items():
            if formatted.startswith(mark, at):
                role, close, at = known, CLOSE[known], at + len(mark)
                break
        else:
            if name := NAME.match(formatted, at):
                role, close, at = unescape(name[1]), OTHER_CLOSE, name.end()
        end, found = at, ENDS[close].search(formatted, at)
        while found and found.group() != close:
            found = ENDS[close].search(formatted, found.end())
        if not found:
            return None
        end = found.start()
        turns.append((role, unescape(formatted[at:end]), at, end))
        at = found.end()
    return turns


def _read(formatted: str) -> list[Turn] | None:
    turns = parse(formatted)
    return None if turns is None else [t[:2] for t in turns]


def render(turns: list[Turn]) -> str:
    """The formatted conversation; its parse equals `turns`."""
    parts = []
    for role, text in turns:
        plain = _turn(role, text)
        parts.append(plain if _read(START + plain) == [(role, text)] else _turn(role, escape(text)))
    while True:
        formatted = START + "".join(parts)
        back = _read(formatted) or []
        if back == turns:
            return formatted
        for i, turn in enumerate(turns):
            safe = _turn(turn[0], escape(turn[1]))
            if (i >= len(back) or back[i] != turn) and parts[i] != safe:
                parts[i] = safe
                break
        else:
            raise ValueError("conversation can't be escaped")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Runs of equal conv_id in sorted rows; one conversation is held at a time."""
    last, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if turns and conv != last:
                yield last, turns
                turns = []
            last = conv
            turns.append((role or "", text or ""))
    if turns:
        yield last, turns


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


FORMATTED = pa.schema(
    [("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))]
)


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and the spans [loss_start, loss_end)
    of the formatted text (code points) that the loss covers, one per assistant turn.

    Turns go by `turn` (null first), ties by role and text. A null text or role counts as
    empty; an unknown role keeps its name; rows with a null conv_id form one conversation;
    repeated rows are turns each. Other columns are ignored. An empty table gives none.
    Rows are shuffled by conversation and streamed in order, so a task holds one
    conversation at a time, which is the size of one output row.
    """

    def run(batches):
        def each():
            for conv, turns in _conversations(batches):
                formatted = render(turns)
                spans = [t[2:] for t in parse(formatted) if t[0] == "assistant"]
                yield conv, formatted, [s for s, _ in spans], [e for _, e in spans]

        yield from _batches(each(), FORMATTED)

    ordered = (
        rows.select("conv_id", "role", "text", "turn")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return ordered.mapInArrow(run, "conv_id long, formatted string, loss_start array<long>, loss_end array<long>")


DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the formatted text."""

    def run(batches):
        def each():
            for batch in batches:
                for conv, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    turns = parse(text)
                    sha = hashlib.sha256()
                    for role, said, _, _ in turns:
                        sha.update(f"{role}\n{said}\n".encode())
                    loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                    yield conv, len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)

        yield from _batches(each(), DIGEST)

    return formatted.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
