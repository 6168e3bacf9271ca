"""Version families are compared in one task or block by block, with the same result."""

from __future__ import annotations

import random

import numpy as np

from citeloom.operators import versions

SCHEMA = "course_id string, name string, doc_id long, text string"


def cut(text):
    t = "".join((text or "").lower().split())
    return {t[i : i + 5] for i in range(0, len(t) - 4, 5)} if len(t) >= 5 else {t} - {""}


def brute_force(rows):
    want = {}
    for c, f, i, text in rows:
        best = (0.0, 0)
        for c2, f2, j, other in rows:
            a, b = cut(text), cut(other)
            if None not in (c, f) and (c, f) == (c2, f2) and j < i and a and b:
                best = max(best, (len(a & b) / len(a | b), -j))
        want[i] = (-best[1], round(best[0], 9)) if best[0] >= versions.SIMILARITY else (None, None)
    return want


def made(n=60):
    rng = random.Random(7)
    alphabet = "abcdefé𝒳中 "
    base = ["".join(rng.choice(alphabet) for _ in range(90)) for _ in range(3)]
    texts = ["", None, "ab", "AB ", "abcde", "ab\x00", "ab\x00\x00\x00"]
    while len(texts) < n:
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 2, 8, 30])):
            t[rng.randrange(len(t))] = rng.choice(alphabet)
        texts.append("".join(t))
    rng.shuffle(texts)
    return [(rng.choice(["c", "c", "d", None]), rng.choice(["x", "x", None]), i, t) for i, t in enumerate(texts)]


def found(spark, rows, **how):
    out = versions.similar_earlier(spark.createDataFrame(rows, SCHEMA), ["course_id", "name"], **how).collect()
    return {r["doc_id"]: (r["best_doc"], r["similarity"] and round(r["similarity"], 9)) for r in out}, len(out)


def test_blocks_find_what_one_task_finds(spark):
    rows = made()
    want = brute_force(rows)
    # Whole families, blocks of a few texts, and blocks of about one.
    for size in (versions.BLOCK_BYTES, 700, 100):
        assert found(spark, rows, block_bytes=size) == (want, len(rows))


def test_repeated_documents_keep_their_rows(spark):
    rows = made(30)
    got, n = found(spark, rows * 2, block_bytes=300)
    assert (got, n) == (brute_force(rows), 60)


def test_only_results_are_written(spark, monkeypatch):
    written = []
    kept = versions.materialize

    def noted(df, *args):
        written.append(df)
        return kept(df, *args)

    monkeypatch.setattr(versions, "materialize", noted)
    found(spark, made(12))
    # Neither sets nor texts are written, and one shuffle deals the sets to their families.
    assert all(c not in df.columns for df in written for c in ("set", "text", "shingles"))
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_shingles_of_one_sum_are_told_apart():
    # The mix of the first two is the same: a step in one is undone in the other.
    step = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    back = np.uint64((-pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64)) % (1 << 64))
    with np.errstate(over="ignore"):
        one = np.array([5, 5, 5, 5], np.uint64) + np.array([0, 1, 1, 0], np.uint64) * step
        two = np.array([9, 9, 9, 9], np.uint64) + np.array([0, 1, 0, 0], np.uint64) * back
    got = {b: counts.tolist() for b, counts in versions._common((one, two), np.array([1, 1, 1, 1]))}
    assert got == {3: [1, 0, 0]}


def test_long_lists_of_holders_are_counted_in_slices(monkeypatch):
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(40)]
    codes = np.array([x for s in sets for x in s], np.uint64)
    for held in (versions.HELD, 3):
        monkeypatch.setattr(versions, "HELD", held)
        got = dict(versions._common((codes, codes + np.uint64(1)), np.array([len(s) for s in sets])))
        for b, own in enumerate(sets):
            counts = [len(set(own) & set(s)) for s in sets[:b]]
            assert got[b].tolist() == counts if any(counts) else b not in got
