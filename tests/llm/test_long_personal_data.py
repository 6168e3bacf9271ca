"""Personal data in long texts: no crash, linear time, the same spans as slow readings."""

import random
import re
import time

import numpy as np
import pytest

from citeloom.llm import pii

SPELT = re.compile(
    r"[A-Za-z0-9._%+-]+(?: ?[\[({] ?(?:at|AT|@) ?[\])}] ?| at | AT )"
    r"[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| dot | DOT )[A-Za-z0-9-]+)+"
)
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")


def proposed(text):
    base, found = pii.base_spans(text), pii.candidates(text)
    known = pii.Spans(base)
    x = np.array([pii.features(text, s) for s in found], np.float32).reshape(-1, pii.N_FEATURES)
    [pii.weak_label(text, s, known) for s in found]
    return pii.chosen(base, found, x.sum(axis=1) * 0 + 0.9, np.full(4, 0.5))


@pytest.mark.parametrize(
    "text",
    [
        "0" * 5000 + ".1.2.3",
        "1.2.3." + "7" * 5000 + " at foo.com",
        "a" * 1_000_000 + " at b.com",
        "1" * 1_000_000,
        "1 " * 30_000,
        "1." * 30_000,
        "a at " * 100_000,
        "+1 (555) 010-9999, " * 20_000,
        "x@y " * 100_000,
    ],
)
def test_long_texts_end(text):
    start = time.time()
    proposed(text)
    assert time.time() - start < 20


def test_octets_of_many_zeros_count():
    assert pii.base_spans("0" * 5000 + ".1.2.3 and 1.2.3.4") == [(0, 1, 5006), (5011, 1, 5018)]
    assert pii.base_spans("1.2.3." + "4" * 5000) == []


def test_same_spans_as_the_slow_readings():
    rng = random.Random(4)
    pieces = ["joe", ".", " at ", "[at]", " (at) ", " AT ", "site", " dot ", "[dot]", ".com", "@", " ", "12", "255", "999", "\n", "(", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        assert pii._spelt(text) == [(m.start(), 0, m.end()) for m in SPELT.finditer(text)], text
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in IP.finditer(text)], text


def test_choice_and_labels_as_by_comparing_all():
    rng = random.Random(5)
    for _ in range(500):
        spans = [(a, rng.randrange(4), a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 25)))]
        base, found = sorted(set(spans[: len(spans) // 3])), sorted(set(spans[len(spans) // 3 :]))
        score = np.array([rng.choice([0.1, 0.5, 0.7, 0.9]) for _ in found])
        kept = list(base)
        for i in np.argsort(-score, kind="stable"):
            a, k, b = found[i]
            if score[i] >= 0.5 and all(b <= s or e <= a for s, _, e in kept):
                kept.append(found[i])
        assert pii.chosen(base, found, score, np.full(4, 0.5)) == sorted(kept)
        known = pii.Spans(base)
        for a, k, b in found:
            near = any(k == kind and abs(a - s) <= 1 and abs(b - e) <= 1 for s, kind, e in base)
            assert known.nearly(a, k, b) == near
            assert known.meets(a, b) == any(a < e and s < b for s, _, e in base)


def test_through_spark(spark):
    rows = [(1, "0" * 5000 + ".1.2.3"), (2, None), (2, "mail joe [at] site [dot] com"), (3, "1.2.3." + "4" * 5000 + " at foo.com")]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_ip"]) for r in got) == [(1, 1), (2, 0), (2, 0), (3, 0)]
