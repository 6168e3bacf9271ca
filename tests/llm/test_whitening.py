"""Whitening against plain integer arithmetic and a direct eigendecomposition."""

import math

import numpy as np
import pytest

from citeloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, w string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, components=8):
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in usable]
    d = max(set(lengths), key=lambda m: (lengths.count(m), m))
    kept = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in usable if len(v) == d]
    n = len(kept)
    s = [sum(x[k] for _, x in kept) for k in range(d)]
    cov = np.array(
        [[sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for _, x in kept) / n**3 for b in range(d)] for a in range(d)]
    )
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        dev = sum((n * x[k] - s[k]) ** 2 for k in range(d))
        w = np.array([(n * x[k] - s[k]) / n for k in range(d)]) @ vectors
        out.append((i, n, dev, np.abs(w / np.sqrt(values)), values / np.trace(cov)))
    return out


def collected(df):
    by = {}
    for r in df.collect():
        by.setdefault((r["vec_id"], r["deviation_digits"]), []).append(r)
    return {k: sorted(v, key=lambda r: r["component"]) for k, v in by.items()}


def agree(got, want, components):
    assert len(got) == len({(i, str(dev)) for i, _, dev, _, _ in want})
    for i, n, dev, w, explained in want:
        copies = sum((i, dev) == (j, other) for j, _, other, _, _ in want)
        assert len(got[(i, str(dev))]) == copies * components
        rows = got[(i, str(dev))][::copies]
        assert [r["component"] for r in rows] == list(range(1, components + 1))
        for c, r in enumerate(rows):
            assert r["n"] == n
            assert r["deviation"] == (dev if dev < 2**63 else None)
            assert abs(r["whitened"]) == pytest.approx(w[c], abs=1e-8)
            assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
            assert r["identity_error"] < 1e-6


def test_awkward_rows_and_far_entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * rng.uniform(0.1, 4, 12)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rng.normal(size=12).tolist()), (900, None), (901, []), (902, [1.0] * 5)]
    rows += [(903, [math.nan] + [0.0] * 11), (904, [None] + [0.0] * 11), (905, [math.inf] + [0.0] * 11)]
    rows += [(906, [-123456.789] + [0.25] * 11)]
    got = collected(whitening.whitened(table(spark, rows).repartition(5)))
    agree(got, brute(rows), 8)


def test_few_dimensions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(130, 3)).tolist())]
    got = collected(whitening.whitened(table(spark, rows)))
    agree(got, brute(rows), 3)


def test_scatter_of_wide_entries_is_exact():
    rng = np.random.default_rng(7)
    y = rng.integers(0, 1 << 63, (200, 3), dtype=np.uint64)
    width = np.array([63, 63, 63])
    scatter = whitening.Scatter(width)
    scatter.add(y[:150])
    scatter.add(y[150:])
    for i in range(3):
        for j in range(i, 3):
            got = sum(int(scatter.parts[k, i, j]) << (whitening.LIMB * k) for k in range(scatter.limbs))
            assert got == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True))


def test_deviation_beyond_a_long(spark):
    rows = [(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [0.0, 2.0])]
    got = whitening.whitened(table(spark, rows)).collect()
    want = {i: dev for i, _, dev, _, _ in brute(rows, 2)}
    assert {(r["vec_id"], r["deviation_digits"]) for r in got} == {(i, str(v)) for i, v in want.items()}
    assert {r["deviation"] for r in got if r["vec_id"] != 2} == {None}


def test_no_variance_and_no_rows(spark):
    same = whitening.whitened(table(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in same] == [(0.0, 0.0, 0, 1.0)] * 4
    assert whitening.whitened(table(spark, [(1, None), (2, [math.nan])])).count() == 0


def test_whole_table(spark, sf):
    from citeloom.llm import queries

    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    agree(collected(queries.whiten(spark, sf)), brute(rows), 8)
