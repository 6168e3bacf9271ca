"""The trees of personal data learn from every candidate, in memory or pass by pass."""

import numpy as np

from citeloom.llm import pii


def test_every_candidate_counts(spark):
    # One text with far more candidates than a few, and more documents of the other kind.
    many = " ".join(f"10.0.{i}.300" for i in range(250))
    rows = [(1, many)] + [(k, f"call +1 (826) 555-{1000 + k} or 10.0.0.{k % 250}") for k in range(2, 4500)]
    found = pii.proposals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    labels = [v for r in found.select("right").collect() for v in r.right if v >= 0]
    x, y = pii.variants()
    weight = max(1, round(len(labels) / len(y)))
    counted = pii.examples(found).collect()
    assert sum(r.n for r in counted) == len(labels) + weight * len(y)
    right = sum(r.n for r in counted if r.example[pii.N_FEATURES])
    assert right == sum(labels) + weight * int(y.sum())


def test_passes_grow_the_same_trees(spark, monkeypatch):
    rows = [(k, f"mail a{k} [at] b.org or 10.1.{k}.7 tel (826) 555-{1000 + k} no 1.2.3.{k + 200}") for k in range(60)]
    found = pii.proposals(spark.createDataFrame(rows, "doc_id long, text string"))
    few = pii.grown
    monkeypatch.setattr(pii, "grown", lambda h, share, bins: few(h, share, bins, rounds=3))
    held, passed = pii.fit(found), pii.fit(found, held_rows=0)
    assert np.array_equal(held.threshold, passed.threshold)
    for name in ("feature", "cut", "leaf"):
        assert all(map(np.array_equal, getattr(held.trees, name), getattr(passed.trees, name))), name
