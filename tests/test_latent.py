"""The trained text vectors against a direct decomposition of the same table."""

import re

import numpy as np

from citeloom.operators import latent


def texts():
    rng = np.random.default_rng(4)
    topics = [[f"{'abcdef'[t]}{i}" for i in range(15)] for t in range(6)]
    rows = [" ".join(rng.choice(topics[i % 6], 8).tolist() + rng.choice(topics[(i + 1) % 6], 2).tolist()) for i in range(240)]
    return rows + ["", None, "unseen1", "a1 a1 A1"]


def test_vectors_are_those_of_the_table(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    model = latent.fit(df, dim=5, rounds=12)
    table = np.zeros((len(rows), len(model.terms)))
    for i, t in enumerate(rows):
        for w in set(re.findall("[a-z0-9]+", (t or "").lower())) & set(model.terms):
            table[i, model.terms[w]] = model.idf[model.terms[w]]
    size = np.linalg.norm(table, axis=1, keepdims=True)
    table = np.divide(table, size, out=np.zeros_like(table), where=size > 0)
    _, values, right = np.linalg.svd(table, full_matrices=False)
    assert np.allclose(model.values, values[:5], rtol=1e-4)
    assert np.allclose(np.abs(np.sum(model.vectors * right[:5].T, axis=0)), 1, atol=1e-2)
    want = table @ model.vectors
    got = latent.with_embedding(df, model, name="v").withColumn("known", latent.encodable("v"))
    for r in got.collect():
        row = want[r["doc_id"]]
        if not np.linalg.norm(row):
            assert r["v"] is None and not r["known"]
        else:
            assert r["known"] and np.allclose(r["v"], row / np.linalg.norm(row), atol=1e-5)


def test_no_terms(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    model = latent.fit(df)
    assert [r["embedding"] for r in latent.with_embedding(df, model).collect()] == [None, None]


def test_terms_are_looked_up_once(spark, monkeypatch):
    # The rounds read places of terms; only the coding pass reads words.
    written = []
    real = latent.materialize
    monkeypatch.setattr(latent, "materialize", lambda df, name: written.append(df.schema.simpleString()) or real(df, name))
    texts = spark.createDataFrame([(i, f"a{i % 5} b{i % 3} c") for i in range(40)] + [(50, None), (51, "")], "doc_id long, text string")
    model = latent.fit(texts, dim=3)
    assert written == ["struct<terms:array<int>>"] and len(model.terms) == 9
    table = np.zeros((40, 9))
    for i in range(40):
        for w in (f"a{i % 5}", f"b{i % 3}", "c"):
            table[i, model.terms[w]] = model.idf[model.terms[w]]
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    assert np.allclose(np.linalg.svd(table)[1][:3], model.values, atol=1e-6)
