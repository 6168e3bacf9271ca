"""Term audit against a plain recount."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from citeloom.llm import divergence, textscan

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, item string, value string, term string, rank string, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, *["x"] * 5) for i, (t, g, s) in enumerate(rows)], SCHEMA)


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, least=10):
    docs, uses = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = terms(text)
        docs[lang or ""].update(set(found))
        uses[lang or "", source or ""].update(found)
    out = []
    for lang, seen in docs.items():
        kept = sorted(t for t, n in seen.items() if n >= least)
        groups = {s: c for (g, s), c in uses.items() if g == lang}

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1000000000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum(groups.values(), Counter()))
        share = {s: shares(c) for s, c in groups.items()}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s, p in share.items():
            pairs = [(sum(f(p[t], q[t]) for t in kept), o) for o, q in share.items() if o != s]
            pairs.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(pairs)]
            top = [(f(p[t], whole[t]), t) for t in kept if groups[s][t] and p[t] > whole[t]]
            top.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(top[:10])]
    return sorted(out)


def result(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def corpus():
    rng = np.random.default_rng(3)
    names = ["the", "The", "é", "東京", "ß x", "longerthansix", "longerthanseven", "longerthanseventeenletters", "a" * 60, "b", "Ab-cd"]
    names += [f"w{'xyz'[i % 3]}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    odds = 1 / np.arange(1, len(names) + 1)
    rows = []
    for _ in range(400):
        picked = rng.choice(len(names), rng.integers(0, 40), p=odds / odds.sum())
        text = " ".join(names[k] for k in picked)
        rows.append((text, ["en", "de", None][rng.integers(3)], ["a", "b", "ä", None, "z"][rng.integers(5)]))
    rows += [(None, "en", "a"), ("", "fr", "lonely"), ("123 456", "fr", "other"), ("the " * 400000, "en", "hot")]
    return rows + [rows[5]] * 15


@pytest.mark.parametrize(("cells", "bitmap"), [(1 << 20, 1 << 26), (40, 64)])
def test_against_a_recount(spark, cells, bitmap):
    rows = corpus()
    got = result(divergence.audit(table(spark, rows).repartition(6), cells=cells, bitmap=bitmap))
    assert got == brute(rows)


def test_a_text_of_many_pieces_counts_once(spark, monkeypatch):
    monkeypatch.setattr(textscan, "PIECE", 32)
    monkeypatch.setattr(textscan.words, "__defaults__", (*textscan.words.__defaults__[:1], 32))
    rows = [("alpha beta gamma alpha delta epsilonlonger beta " * 9, "en", "s")] * 12 + [("alpha zeta " * 30, "en", "t")] * 9
    column = pa.record_batch({"lang": [r[1] for r in rows], "source": [r[2] for r in rows], "text": [r[0] for r in rows]})
    found = Counter()
    for batch in divergence._level(6, 0, None)(iter([column])):
        for r in batch.to_pylist():
            found[r["source"], r["piece"], r["complete"]] += r["docs"]
    assert found["s", b"alpha", True] == 12 and found["t", b"alpha", True] == 9 and found["s", b"beta", True] == 12
    assert found[None, b"epsilo", False] == 12 and found["t", b"zeta", True] == 9


def test_empty_table(spark):
    assert divergence.audit(table(spark, [("a", "b", "c")]).filter("false")).count() == 0
