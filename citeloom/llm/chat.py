"""Chat formatting by columnar byte assembly, and its exact inverse.

A turn is written as ``### role: text</turn>`` and a line end.  Inside roles and
texts the bytes of control strings are escaped by a backslash and a letter, so no
control string can come from a text and every text can be read back.

Rows arrive sorted by conversation and turn.  For each Arrow batch numpy computes
the lengths of all segments (header, escaped text, end mark), their cumulative
offsets and the place of every byte, and fills one preallocated Arrow buffer.
A conversation longer than a piece is cut between turns into numbered pieces, so
no conversation has to fit one cell or one batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.textscan import column_bytes

HEAD, MIDDLE, END = b"### ", b": ", b"</turn>\n"

#: Escapes: every byte that a control string, header or escape begins with.
ESCAPES = {"\\": "\\", "#": "h", "<": "l", ":": "c", "\n": "n"}
#: Texts may hold colons and line ends as they are; roles may not.
_TEXT = np.zeros(256, np.uint8)
for _plain in "\\#<":
    _TEXT[ord(_plain)] = ord(ESCAPES[_plain])
_BACK = {"\\" + code: plain for plain, code in ESCAPES.items()}

#: Bytes of text after which an unfinished conversation is written as a piece.
PIECE_BYTES = 4 << 20

FORMATTED = "conv_id long, piece int, n_turns long, formatted string, loss array<long>"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str, marks: str = "\\#<:\n") -> str:
    """Escape ``marks``; the slow twin of the byte assembly, used for roles."""
    return "".join("\\" + ESCAPES[c] if c in marks else c for c in text)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: _BACK[m.group()], text) if "\\" in text else text


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for every length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all turns, and where turns, texts and text ends lie.

    Returns the buffer, the turn offsets (n + 1), and the starts and ends of the
    escaped texts.
    """
    n = len(texts)
    coded = roles.cast(pa.string()).fill_null("").dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    heads = [HEAD + escape(r).encode() + MIDDLE for r in coded.dictionary.to_pylist()]
    head_len = np.array([len(h) for h in heads], np.int64)
    head_at = np.cumsum(head_len) - head_len
    head_bytes = np.frombuffer(b"".join(heads), np.uint8)

    raw, offsets = column_bytes(texts)
    marks = _TEXT[raw]
    placed = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(1 + (marks > 0), out=placed[1:])
    body_from = placed[offsets[:-1]]
    body_len = placed[offsets[1:]] - body_from

    own_head = head_len[code]
    ends = np.cumsum(own_head + body_len + len(END))
    turn_at = np.concatenate([[0], ends]).astype(np.int64)
    body_at = turn_at[:-1] + own_head
    buffer = pa.allocate_buffer(int(turn_at[-1]))
    out = np.frombuffer(buffer, np.uint8)
    out.flags.writeable = True
    out[_ranges(turn_at[:-1], own_head)] = head_bytes[_ranges(head_at[code], own_head)]
    to = placed[:-1] + np.repeat(body_at - body_from, np.diff(offsets))
    out[to] = np.where(marks > 0, np.uint8(ord("\\")), raw)
    special = np.flatnonzero(marks)
    out[to[special] + 1] = marks[special]
    end_at = body_at + body_len
    out[(end_at[:, None] + np.arange(len(END))).ravel()] = np.tile(np.frombuffer(END, np.uint8), n)
    return buffer, turn_at, body_at, end_at


def _format(table: pa.Table, cuts: np.ndarray, pieces: np.ndarray) -> pa.RecordBatch:
    """One row for the rows between two cuts."""
    roles, texts = (table[c].combine_chunks() for c in ("role", "text"))
    buffer, turn_at, body_at, body_end = assemble(roles, texts)
    data = np.frombuffer(buffer, np.uint8)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    own = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    base = chars[turn_at[cuts[:-1]]]
    learnt = np.flatnonzero(np.asarray(roles.cast(pa.string()).fill_null("").to_numpy(zero_copy_only=False) == "assistant"))
    spans = np.stack([chars[body_at[learnt]], chars[body_end[learnt]]], 1) - base[own[learnt]][:, None]
    counts = np.bincount(own[learnt], minlength=len(cuts) - 1) * 2
    formatted = pa.LargeStringArray.from_buffers(
        len(cuts) - 1, pa.py_buffer(turn_at[cuts].astype(np.int64)), buffer
    ).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [
            table["conv_id"].combine_chunks().take(pa.array(cuts[:-1])),
            pa.array(pieces, pa.int32()),
            pa.array(np.diff(cuts), pa.int64()),
            formatted,
            pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(spans.ravel(), pa.int64())
            ),
        ],
        names=["conv_id", "piece", "n_turns", "formatted", "loss"],
    )


def _changes(ids: pa.Array) -> np.ndarray:
    """Positions at which a sorted column with nulls takes another value."""
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return np.flatnonzero((values[1:] != values[:-1]) | (missing[1:] != missing[:-1])) + 1


def _writer(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the conversation that may go on
        piece, last = 0, ()  # pieces of that conversation that are written
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if not len(table):
                continue
            cuts = _changes(table["conv_id"].combine_chunks())
            ready = int(cuts[-1]) if len(cuts) else 0
            rest = table.slice(ready)
            if rest["text"].nbytes > limit:  # too long to wait for its end
                ready, rest = len(table), None
            bounds = np.concatenate([[0], cuts[cuts < ready], [ready]]) if ready else np.zeros(1, np.int64)
            if ready:
                first = table["conv_id"][0].as_py()
                numbers = np.zeros(len(bounds) - 1, np.int32)
                numbers[0] = piece if last == (first,) else 0
                yield _format(table.slice(0, ready), bounds, numbers)
                final = table["conv_id"][ready - 1].as_py()
                piece = int(numbers[-1]) + 1
                last = (final,)
            held = rest
        if held is not None and len(held):
            first = held["conv_id"][0].as_py()
            yield _format(held, np.array([0, len(held)]), np.array([piece if last == (first,) else 0], np.int32))

    return run


def formatted(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """``conv_id, piece, n_turns, formatted, loss`` in template form.

    ``loss`` holds start and end, in code points of ``formatted``, of each
    assistant text.  Null roles and texts count as empty, a null conversation is
    one conversation, null turns come first and equal turns are ordered by role
    and text.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return ordered.mapInArrow(_writer(piece_bytes), FORMATTED)


def parse(formatted_text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    out = []
    end, head, middle = END.decode(), HEAD.decode(), MIDDLE.decode()
    for turn in formatted_text.split(end)[:-1]:
        role, _, text = turn.removeprefix(head).partition(middle)
        out.append((unescape(role), unescape(text)))
    return out


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state: list | None = None

    def close(s):
        return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

    for batch in batches:
        done = []
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(close(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for a, b in zip(loss[::2], loss[1::2], strict=True):
                learnt = unescape(text[a:b])
                state[3] += len(learnt)
                state[4].update(learnt.encode())
            state[5] += len(text)
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done, strict=True)), strict=True)), schema=_DIGEST)
    if state is not None:
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, close(state), strict=True)}, schema=_DIGEST)


_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation from its formatted pieces alone."""
    ordered = pieces.select("conv_id", "piece", "formatted", "loss").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "piece").mapInArrow(_reader, DIGEST)
