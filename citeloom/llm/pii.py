"""Personal data: base patterns, and candidates chosen by boosted trees.

The base spans come from fixed patterns with checks.  High-recall generators propose
further spans, which may overlap: addresses with a spelt-out @, numbers written like
a phone without country code, cards and network addresses with other separators.
Boosted trees judge each by format and context, and a threshold per kind, set on
held-back examples for a given precision, selects those that are added.

The trees learn from every candidate of every document (right if a base span covers
it, wrong if a base check refuses it, the others not) and from written variants of each
kind, which together weigh as much.  Examples with the same codes of all features are
one row with a count; each level of a tree is one pass over these rows.  Every document
is then judged; base spans always stay.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.boosting import Boosted, coded, decoded, grown, sums
from citeloom.session import materialize, release

KINDS = ("email", "ip", "card", "phone")
#: Distinct rows of examples that fit in the driver; more are summed by Spark, pass by pass.
HELD_ROWS = 1 << 17
#: Steps of scores that a threshold can lie at.
STEPS = 1 << 16
#: Written variants of each kind, right and wrong.
VARIANTS = 400
PRECISION = 0.99
#: Characters before and after a candidate that count as context.
CONTEXT = 24

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_REGION = re.compile(r"[0-9][0-9 .\-]*")
# A match inside a run of digits goes on like one from its start, so only that is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_AT = re.compile(r"(?=( ?[\[({] ?(?:at|AT|@) ?[\])}] ?| at | AT ))")
_SPELT_HOST = re.compile(
    r"[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| dot | DOT )[A-Za-z0-9-]++)+"
)
_NUMBER = re.compile(r"[(+]?[0-9](?:[ ().\-/‐-― ]{0,2}[0-9]){6,}")
_GROUP = re.compile(r"[0-9]+")
#: Groups of digits of a number that is part of a longer run.
GROUPS = 8
_DOTTED = re.compile(r"[0-9]{1,3}(?:(?: ?[\[({]?(?:\.|dot)[\])}]? ?)[0-9]{1,3}){3,}")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(digits: str) -> bool:
    """At most 255; digits may be many more than ``int`` takes."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, 0, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    for region in _REGION.finditer(text):
        a, b = region.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            if all(_octet(p) for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, a, b):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[Span]:
    """High-recall spans with their likely kind; they may overlap."""
    out: list[Span] = []
    out += _spelt(text)
    for m in _NUMBER.finditer(text):
        out += _numbers(text, *m.span())
    out += [(m.start(), 1, m.end()) for m in _DOTTED.finditer(text)]
    return sorted(set(out))


def _spelt(text: str) -> list[Span]:
    """Addresses around a written-out @: walk back from it, match the host after it."""
    out: list[Span] = []
    done = 0
    for m in _AT.finditer(text):
        start = at = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _SPELT_HOST.match(text, m.end(1)) if start < at else None
        if host:
            out.append((start, 0, host.end()))
            done = host.end()
        elif start < at:
            done = at  # what stands before this mark ends there
    return out


def _numbers(text: str, start: int, end: int) -> list[Span]:
    """Phones and cards among the sub-runs of whole digit groups of a run, which may
    touch other numbers: of eight groups at most, as numbers are written, or the whole
    run.  A sub-run has 19 digits at most, so each group begins few."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    out: list[Span] = []
    for i, (a, _) in enumerate(groups):
        # A sign or bracket before the group is part of a phone.
        signed = a - 1 if a > start and text[a - 1] in "(+" else a
        n = 0
        for k, (first, b) in enumerate(itertools.islice(groups, i, i + 19)):
            n += b - first
            if n > 19:
                break
            if k >= GROUPS and (i > 0 or k + 1 < len(groups)):
                continue
            if n >= 12:
                out.append((a if i else start, 2, b))
            if 7 <= n <= 15:
                out.append((signed, 3, b))
    return out


_WORDS = (
    re.compile(r"(?i)mail|contact|write|adress|address|correo|courriel"),
    re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|whatsapp|telefon|teléfono)"),
    re.compile(r"(?i)card|visa|master|credit|karte|carte|tarjeta|payment"),
    re.compile(r"(?i)\bip\b|server|address|client|from|host"),
    re.compile(r"(?i)version|release|order|invoice|isbn|article|number|\bno\b|section|build"),
)
N_FEATURES = 26
#: Cuts of the features: counts and flags between whole numbers, the share of letters by 32nds.
_COUNTS = np.concatenate([np.arange(20), [24, 32, 48, 64, 96, 128]]) + 0.5
CUTS = [_COUNTS] * 12 + [np.arange(1, 32) / 32] + [_COUNTS] * 13
_WIDE = max(map(len, CUTS)) + 1


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    start, kind, end = span
    own = text[start:end]
    digits = _digits(own)
    groups = re.findall(r"[0-9]+", own)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    labels = re.split(r"[^A-Za-z0-9-]+", own.strip())
    parts_ok = len(groups) == 4 and all(_octet(g) for g in groups)
    last = labels[-1] if labels else ""
    return [
        kind, len(own), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        own.startswith("+"), "(" in own, own.count("."), own.count("-"), own.count(" "), own.count("/"),
        sum(c.isalpha() for c in own) / len(own), any(x in own.lower() for x in ("[at]", "(at)", "{at}")),
        "@" in own, 2 <= len(last) <= 6 and last.isalpha(),
        12 <= len(digits) <= 19 and luhn(digits), parts_ok,
        before[-1:].isalnum(), after[:1].isalnum(),
        *(bool(p.search(before) or p.search(after)) for p in _WORDS),
        len(set(map(len, groups))) if groups else 0,
    ]


_ROW = pa.schema(
    [("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()),
     ("base", pa.list_(pa.int64())), ("base_sha256", pa.string()), ("proposed", pa.list_(pa.int64())),
     ("right", pa.list_(pa.int8())), ("features", pa.binary())]
)
_ROW_DDL = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<long>, base_sha256 string, "
    "proposed array<long>, right array<tinyint>, features binary"
)


def named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


class Spans:
    """Base spans by start, with the furthest end so far: overlap by bisection."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.starts = [s for s, _, _ in self.spans]
        self.ends = list(itertools.accumulate((e for _, _, e in self.spans), max))

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def nearly(self, a: int, kind: int, b: int) -> bool:
        """Whether one of the kind has these bounds, give or take one."""
        near = self.spans[bisect_left(self.starts, a - 1) : bisect_right(self.starts, a + 1)]
        return any(k == kind and abs(b - e) <= 1 for _, k, e in near)


def weak_label(text: str, span: Span, base: Spans | list[Span]) -> int:
    """1 if a base span has nearly these bounds, 0 if a base pattern's check refused
    the span or another base span lies across it, -1 where the base patterns say nothing."""
    a, k, b = span
    base = base if isinstance(base, Spans) else Spans(base)
    if base.nearly(a, k, b):
        return 1
    own = text[a:b]
    # A card that passes the check was only merged with its neighbour.
    digits = _digits(own)
    card = k == 2 and _CARD.fullmatch(own) and not (12 <= len(digits) <= 19 and luhn(digits))
    refused = (k == 1 and _IP.fullmatch(own)) or card or (k == 3 and own.isdigit())
    return 0 if refused or base.meets(a, b) else -1


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            base, proposed = base_spans(text), candidates(text)
            x = np.array([features(text, s) for s in proposed], np.float32).reshape(-1, N_FEATURES)
            counts = [sum(k == i for _, k, _ in base) for i in range(4)]
            known = Spans(base)
            rows.append(
                {
                    "doc_id": key, **dict(zip(("n_email", "n_ip", "n_card", "n_phone"), counts, strict=True)),
                    "base": [v for s in base for v in s],
                    "base_sha256": hashlib.sha256(named(base).encode()).hexdigest(),
                    "proposed": [v for s in proposed for v in s],
                    "right": [weak_label(text, s, known) for s in proposed],
                    "features": x.tobytes(),
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)


def proposals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans, and candidates with features and weak labels, of every document."""
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(_proposals, _ROW_DDL)


def variants(n: int = VARIANTS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Written examples that the base patterns do not know, right and wrong."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    number = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    syllable = lambda: pick("ma", "ton", "er", "li", "sa", "ven", "dor", "ki", "ra", "bel")
    word = lambda: "".join(syllable() for _ in range(int(rng.integers(1, 4))))

    def card() -> str:
        body = number(15)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    x, y = [], []

    def add(before: str, own: str, after: str, kind: int, right: int) -> None:
        text = f"{word()} {word()}{before}{own}{after}{word()} {word()}"
        start = text.index(own, len(text) - len(own) - len(after) - 40 if len(text) > 80 else 0)
        x.append(features(text, (start, kind, start + len(own))))
        y.append(right)

    for _ in range(n):
        at, dot = pick("[at]", " [at] ", "(at)", " (at) ", "{at}"), pick(".", "[dot]", " (dot) ", " [dot] ")
        add(pick(" ", " mail ", " contact "), f"{word()}{pick('.', '_', '')}{word()}{at}{word()}{dot}{pick('com', 'org', 'net', 'de')}", " ", 0, 1)
        add(" ", f"{word()} at {word()}.{word()}", " ", 0, 0)
        add(pick(" tel ", " phone: ", " call "), f"({number(3)}) {number(3)}-{number(4)}", " ", 3, 1)
        add(pick(" tel ", " phone: ", " call "), f"0{number(3)} {number(3)} {number(4)}", " ", 3, 1)
        add(pick(" ", " order ", " number "), number(int(rng.integers(7, 16))), " ", 3, 0)
        add(pick(" ", " on "), f"20{number(2)}-0{rng.integers(1, 10)}-1{rng.integers(0, 10)}", " ", 3, 0)
        c = card()
        add(pick(" ", " card ", " visa "), pick(".", "‑", " ").join(c[i : i + 4] for i in (0, 4, 8, 12)), " ", 2, 1)
        wrong = c[:-1] + str((int(c[-1]) + 1 + int(rng.integers(9))) % 10)
        add(pick(" ", " order "), pick("", ".", " ").join(wrong[i : i + 4] for i in (0, 4, 8, 12)), " ", 2, int(luhn(wrong)))
        parts = [str(v) for v in rng.integers(0, 256, 4)]
        add(pick(" ", " server ", " ip "), pick("[.]", "[dot]", "(.)").join(parts), " ", 1, 1)
        add(pick(" version ", " section ", " "), ".".join(number(int(rng.integers(1, 4))).lstrip("0") or "0" for _ in range(5)), " ", 1, 0)
        add(" ", ".".join(str(v) for v in rng.integers(200, 999, 4)), " ", 1, 0)
    return np.array(x, np.float32), np.array(y, np.float64)


@dataclass
class Judge:
    trees: Boosted
    threshold: np.ndarray


def calibrated(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which the share of right examples is ``precision``."""
    if not len(y) or not y.any():
        return 2.0
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share >= precision)
    return float(max(score[order][good[-1]], 0.5)) if len(good) else 2.0


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled candidates by the codes of their features."""
    for batch in batches:
        right = batch.column("right")
        x = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32).reshape(-1, N_FEATURES)
        y = right.flatten().to_numpy(zero_copy_only=False)
        held = np.repeat(batch.column("held").to_numpy(zero_copy_only=False), pa.compute.list_value_length(right))
        known = y >= 0
        keys, n = np.unique(
            np.column_stack([coded(x[known], CUTS), y[known], held[known]]).astype(np.uint8), axis=0, return_counts=True
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(n.astype(np.int64))], names=["example", "n"]
        )


def _matrix(examples: pa.Array) -> np.ndarray:
    """Codes of the features, label and whether it is held back, a row each."""
    return np.frombuffer(b"".join(examples.to_pylist()), np.uint8).reshape(-1, N_FEATURES + 2).astype(np.int64)


def examples(proposed: DataFrame) -> DataFrame:
    """``example, n`` of all labelled candidates and the written variants; a quarter of
    the documents, and every fourth variant, is held back."""
    useful = proposed.filter(F.size("right") > 0)
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).alias("held")
    found = useful.select("right", "features", held).mapInArrow(_examples, "example binary, n long")
    found = materialize(found.groupBy("example").agg(F.sum("n").alias("n")), "pii-found")
    x, y = variants()
    total = found.agg(F.sum("n")).first()[0] or 0
    rows = np.column_stack([coded(x, CUTS), y, np.arange(len(y)) % 4 == 3]).astype(np.uint8)
    written = proposed.sparkSession.createDataFrame(
        [(bytearray(r.tobytes()), max(1, round(total / len(y)))) for r in rows], "example binary, n long"
    )
    return materialize(found.unionByName(written).groupBy("example").agg(F.sum("n").alias("n")), "pii-examples")


def _passes(rows: DataFrame):
    """Sums of a level over all rows: one pass, whose bounded sums come to the driver."""

    def histogram(model: Boosted, feature: np.ndarray, cut: np.ndarray, level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 2**level * N_FEATURES * _WIDE), np.int64)
            for batch in batches:
                m = _matrix(batch.column("example"))
                own = sums(model, feature, cut, level, m[:, :N_FEATURES], m[:, -2], batch.column("n").to_numpy(), _WIDE)
                total += np.stack([v.ravel() for v in own])
            cell = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cell, *total[:, cell])], names=["cell", "s", "b"])

        parts = rows.mapInArrow(run, "cell long, s long, b long")
        found = parts.groupBy("cell").agg(F.sum("s").alias("s"), F.sum("b").alias("b")).toArrow()
        out = np.zeros((2, 2**level * N_FEATURES * _WIDE), np.int64)
        out[:, found.column("cell").to_numpy()] = [found.column(c).to_numpy() for c in ("s", "b")]
        return out.reshape(2, 2**level, N_FEATURES, _WIDE)

    return histogram


def _scored(trees: Boosted):
    """Examples, and right ones, by kind and step of their score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("example"))
            step = np.floor(trees.probability(m[:, :N_FEATURES]) * STEPS).astype(np.int64)
            n = batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[:, 0]), pa.array(step), pa.array(n), pa.array(n * m[:, -2])], names=["kind", "step", "n", "good"]
            )

    return run


def stepped(step: np.ndarray, n: np.ndarray, good: np.ndarray, precision: float) -> float:
    """``calibrated`` for examples counted by step."""
    order = np.argsort(-step)
    share = np.cumsum(good[order]) / np.maximum(np.cumsum(n[order]), 1)
    fine = np.flatnonzero(share >= precision)
    return float(max(step[order][fine[-1]] / STEPS, 0.5)) if good.any() and len(fine) else 2.0


def fit(proposed: DataFrame, precision: float = PRECISION, held_rows: int = HELD_ROWS) -> Judge:
    """Trees of all examples that are not held back, and thresholds of those that are."""
    rows = examples(proposed)
    back = F.substring("example", N_FEATURES + 2, 1) == F.lit(b"\x01")
    learnt, held = rows.filter(~back), rows.filter(back)
    label = (F.substring("example", N_FEATURES + 1, 1) == F.lit(b"\x01")).cast("long")
    many, n, right = learnt.agg(F.count("*"), F.sum("n"), F.sum(label * F.col("n"))).first()
    histogram = _passes(learnt)
    if many <= held_rows:
        table = learnt.toArrow()
        m, times = _matrix(table.column("example")), table.column("n").to_numpy()
        histogram = lambda *at: sums(*at, m[:, :N_FEATURES], m[:, -2], times, _WIDE)
    trees = grown(histogram, right / n, [len(c) + 1 for c in CUTS])
    scored = held.mapInArrow(_scored(trees), "kind long, step long, n long, good long")
    counted = scored.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toArrow()
    kind, *by = (counted.column(c).to_numpy() for c in ("kind", "step", "n", "good"))
    thresholds = [stepped(*(v[kind == k] for v in by), precision) for k in range(len(KINDS))]
    release(rows)
    return Judge(decoded(trees, CUTS), np.array(thresholds))


def chosen(base: list[Span], proposed: list[Span], score: np.ndarray, threshold: np.ndarray) -> list[Span]:
    """Base spans, and accepted candidates that overlap none, best first."""
    known, added = Spans(base), []
    for i in np.argsort(-score, kind="stable"):
        a, k, b = proposed[i]
        if score[i] < threshold[k] or known.meets(a, b):
            continue
        at = bisect_left(added, (a, -1, -1))
        free = (at == 0 or added[at - 1][2] <= a) and (at == len(added) or b <= added[at][0])
        if free:
            insort(added, proposed[i])
    return sorted([*base, *added])


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    The counts are those of base spans; ``spans`` names them and the added ones as
    kind:start:end in code points.  Null texts count as empty and have no spans; a
    table without candidates adds none, and an empty one gives no rows.  Repeated rows
    are judged one by one; of candidates with one score the first in the text goes
    first; other columns are ignored.  Texts and runs of digits may be of any length:
    the time grows with the length of a text, not with its square.
    """
    found = materialize(proposals(docs, key, text), "pii-proposals")
    held = docs.sparkSession.sparkContext.broadcast(fit(found))

    @F.arrow_udf("string")
    def spans(base: pa.Array, proposed: pa.Array, x: pa.Array) -> pa.Array:
        judge = held.value
        rows = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in x.to_pylist()]
        score = judge.trees.probability(np.concatenate(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for b, p, r in zip(base.to_pylist(), proposed.to_pylist(), rows, strict=True):
            own = [list(zip(v[::3], v[1::3], v[2::3], strict=True)) for v in (b, p)]
            out.append(named(chosen(*own, score[at : at + len(r)], judge.threshold)))
            at += len(r)
        return pa.array(out, pa.string())

    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans("base", "proposed", "features").alias("spans")
    )


def redact(text: str, spans: str) -> str:
    """The text with each named span replaced by its kind in brackets."""
    out, at = [], 0
    for part in spans.split(",") if spans else []:
        kind, a, b = part.split(":")
        if int(b) > at:
            out += [text[at : max(at, int(a))], f"[{kind}]"]
            at = int(b)
    return "".join([*out, text[at:]])
