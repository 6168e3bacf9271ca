"""Answer token streams: hold back protocol markers, emit visible text.

State per run is a few characters: the undecided opening, the tail that may be
the start of the source marker, two flags, and tokens that came before their turn.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeloom.operators.answers import NO_EVIDENCE, REFUSAL, SOURCES

OUTPUT = "run_id long, seq long, type string, text string"
STATE = "pending string, tail string, emitting boolean, footer boolean, following long, waiting string"


def undecided(text: str) -> bool:
    """Opening text that may still turn out to be a refusal."""
    head = text.lstrip()
    return any(m.startswith(head) or head.startswith(m) for m in (NO_EVIDENCE, REFUSAL))


def held_tail(text: str) -> int:
    """Length of the longest suffix that could begin the source marker."""
    for n in range(min(len(SOURCES) - 1, len(text)), 0, -1):
        if SOURCES.startswith(text[-n:]):
            return n
    return 0


def advance(state: tuple, delta: str) -> tuple[tuple, str]:
    """One token: new (pending, tail, emitting, footer) and the visible text."""
    pending, tail, emitting, footer = state
    if not emitting:
        pending += delta
        if undecided(pending):
            return (pending, tail, False, footer), ""
        delta, pending, emitting = pending, "", True
    if footer:
        return (pending, tail, emitting, True), ""
    shown = tail + delta
    if SOURCES in shown:
        return (pending, "", emitting, True), shown.split(SOURCES, 1)[0]
    keep = held_tail(shown)
    cut = len(shown) - keep
    return (pending, shown[cut:], emitting, False), shown[:cut]


def _run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pending, tail, emitting, footer, following, waiting = (
        state.get if state.exists else ("", "", False, False, 0, "{}")
    )
    held = {int(k): v for k, v in json.loads(waiting).items()}
    for rows in batches:
        for seq, text, final in zip(rows["seq"].tolist(), rows["text"], rows["final"].tolist(), strict=True):
            if seq >= following:  # an earlier number was taken before: a replay
                held[int(seq)] = (text or "", bool(final))
        out = []
        while following in held:
            text, final = held.pop(following)
            (pending, tail, emitting, footer), visible = advance((pending, tail, emitting, footer), text)
            if final and tail:
                visible, tail = visible + tail, ""
            if visible:
                out.append((key[0], following, "delta", visible))
            if final:
                out.append((key[0], following, "done", "" if emitting else pending.strip()))
            following += 1
        if out:
            yield pd.DataFrame(out, columns=["run_id", "seq", "type", "text"])
    state.update((pending, tail, emitting, footer, following, json.dumps(held)))


def visible_deltas(tokens: DataFrame) -> DataFrame:
    """Delta and done events of a token stream (run_id, seq, text, final).

    ``seq`` numbers the tokens of a run from 0 without gaps.  Tokens may come in any
    order, also across micro-batches: a token waits in the state until those before
    it have come.  A repeated token is ignored.
    """
    return tokens.groupBy("run_id").applyInPandasWithState(
        _run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )


def event_frame(*columns: str):
    """Server-sent event text of a row."""
    from pyspark.sql import functions as F

    return F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n"))


def frame_payloads(text):
    """Payloads of event frames in a text, ``data:`` lines of a frame joined."""
    from pyspark.sql import functions as F

    frames = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n")
    joined = F.transform(
        frames,
        lambda f: F.array_join(
            F.transform(
                F.filter(F.split(f, "\n"), lambda ln: ln.startswith("data:")),
                lambda ln: F.ltrim(F.substring(ln, F.lit(6), F.length(ln))),
            ),
            "\n",
        ),
    )
    return F.filter(joined, lambda v: v != "")
