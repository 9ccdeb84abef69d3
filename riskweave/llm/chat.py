"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, seq, kind, turn, role, text).  It is partitioned by conversation and sorted by turn and
sequence, then folded as a stream, so a task holds one message and one rendered conversation at a time:

* ``message`` starts a message at its turn, ``delta`` appends to the message of its turn, ``edit`` replaces its text;
* ``regenerate`` replaces the text and discards what later turns had received before it.

Messages are rendered in turn order.  Every turn stands between its role's marks; a control string inside a text gets a
backslash after its first character, and a backslash is doubled, which ``unescape`` reverts.  The loss mask covers the
(escaped) text of the assistant turns.

Edge rows: null text or role is empty; a null turn or seq comes first; events of one seq that repeat are applied once,
rows without seq never count as repeated; a delta or edit without a message starts one; unknown kinds count as ``message``;
a null conv_id is a conversation of its own; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template; other roles go between the last marks, with their name.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
CONTROL = ["<</SYS>>", "<<SYS>>", "</s>", "<s>", "[/INST]", "[INST]", "[/ROLE]", "[ROLE]", "[TEXT]"]
CONTROLS = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))


def escape(text: str) -> str:
    """``text`` without any control string; ``unescape`` gives it back."""
    return CONTROLS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text begins and ends in that."""
    begin, end = MARKS.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
    body = escape(text)
    return begin + body + end, len(begin), len(begin) + len(body)


TURN = re.compile(
    "|".join(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items())
    + f"|{re.escape(OTHER[0])}(?P<name>.*?){re.escape(OTHER[1])}(?P<other>.*?){re.escape(OTHER[2])}",
    re.DOTALL,
)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, read back; raises where the string isn't a sequence of turns."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        role = m.lastgroup if m.lastgroup != "other" else unescape(m["name"])
        turns.append((role, unescape(m[m.lastgroup])))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) per final message, and None after each conversation; rows are (conv_id, turn, seq, kind, role,
    text) in order of conversation, turn and sequence."""
    begun, conv, turn, role, parts, cutoff, next_cutoff, last = False, None, None, "", None, None, None, None
    for row in rows:
        c, t, seq, kind, r, text = row
        if begun and c != conv:
            if parts is not None:
                yield conv, role, "".join(parts)
            yield None
            parts, cutoff, next_cutoff = None, None, None
        elif begun and t != turn:
            if parts is not None:
                yield conv, role, "".join(parts)
            parts, cutoff = None, next_cutoff
        fresh = not begun or c != conv or t != turn
        begun, conv, turn = True, c, t
        if not fresh and seq is not None and row == last:
            continue  # the same event once more
        last = row
        if cutoff is not None and seq is not None and seq < cutoff:
            continue  # an earlier turn was regenerated after this
        if kind == "delta" and parts is not None:
            parts.append(text or "")
            continue
        if kind in ("delta", "edit", "regenerate"):
            role = r or (role if parts is not None else "")
        else:
            if parts is not None:
                yield conv, role, "".join(parts)
            role = r or ""
        parts = [text or ""]
        if kind == "regenerate" and seq is not None:
            next_cutoff = seq if next_cutoff is None else max(next_cutoff, seq)
    if begun:
        if parts is not None:
            yield conv, role, "".join(parts)
        yield None


def events(rows: DataFrame, kind: Column | None = None, seq: Column | None = None) -> DataFrame:
    """A log from rows (conv_id, turn, role, text): by default every row is a message of its own."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        (F.lit(None) if seq is None else seq).cast("long").alias("seq"), (F.lit("message") if kind is None else kind).alias("kind"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def format_chats(log: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_start, loss_end) per conversation; the arrays are the loss mask in code points of
    ``formatted``."""
    wire = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        turns, begin, end, at, conv = [], [], [], 0, None
        done, held = [], 0
        for message in fold(rows):
            if message is None:
                done.append((conv, "".join(turns), begin, end))
                held += at
                turns, begin, end, at = [], [], [], 0
                if held > 1 << 20:
                    yield pa.RecordBatch.from_pydict(dict(zip(wire.names, map(list, zip(*done)))), schema=wire)
                    done, held = [], 0
                continue
            conv, role, text = message
            written, a, b = render(role, text)
            turns.append(written)
            if role == "assistant":
                begin.append(at + a)
                end.append(at + b)
            at += len(written)
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(wire.names, map(list, zip(*done)))), schema=wire)

    order = ["conv_id", "turn", "seq", "kind", "role", "text"]
    dealt = log.select(*order).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "conv_id bigint, formatted string, loss_start array<bigint>, loss_end array<bigint>")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from ``formatted``."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    wire = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                turns = parse(text)
                every, loss = hashlib.sha256(), "".join(unescape(text[a:b]) for a, b in zip(begin, end))
                for role, body in turns:
                    every.update(f"{role}\n{body}\n".encode())
                rows.append((conv, len(turns), every.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}, schema=wire)

    return formatted.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
