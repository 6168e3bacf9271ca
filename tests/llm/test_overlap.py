"""The pipeline's near-duplicates against brute force over five-word shingles."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
import pytest

from citeloom.llm import components, overlap
from tests.llm.test_pipeline import COLUMNS


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_labels(texts):
    sets = [slow_shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def edited():
    """Texts with some words changed, among them pairs just above and below 0.8."""
    rng = random.Random(7)
    texts = ["", None, " \t", "word", "WORD", "a b c", "a  b\tc", "long text " * 3000]
    for _ in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([12, 60, 150, 2049]))]
        for edits in (0, 1, 1, 2, 3, 4):
            new = list(words)
            for at in rng.sample(range(len(new)), edits):
                new[at] = "changed"
            texts.append(" ".join(new) + " the one line that is found in all of them")
    return texts


@pytest.mark.parametrize(("cell", "sample"), [(overlap.CELL, overlap.SAMPLE_TEXTS), (3, 10)])
def test_links_match_brute_force(spark, cell, sample):
    texts = edited()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    nodes = {r.doc_id: r.node for r in docs.select("doc_id", overlap.node().alias("node")).collect()}
    roots = {r.node: r.root for r in components.components(overlap.links(docs, cell=cell, sample=sample)).collect()}
    got = [roots.get(nodes[i], nodes[i]) for i in range(len(texts))]
    label = slow_labels(texts)
    assert len(set(zip(got, label, strict=True))) == len(set(got)) == len(set(label))


def test_pipeline_keeps_one_of_edited_copies(spark):
    texts = edited()
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], COLUMNS)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(slow_labels(texts))


def test_parities_never_refuse_a_linked_pair():
    rng = np.random.default_rng(8)
    for n in (1, 10, 1900, 2040, 2048, 2049, 2200, 4090, 4100, 9000):
        for _ in range(20):
            both = int(n * rng.uniform(0.8, 1))
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[:both], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            shared = len(np.intersect1d(a, b))
            ok = overlap._fitting(*(pa.array([v]) for v in (len(a), len(b), overlap.parities(a), overlap.parities(b))))[0].as_py()
            assert ok or 5 * shared < 4 * (len(a) + len(b) - shared)


def test_fingerprints_come_first_and_are_verified(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    near = base[:-1] + ["changed"]
    few = ["a b c d e", "a b c d e f g h"]  # fingerprints may be near, sets are not
    texts = [" ".join(base), " ".join(near), " ".join(rng.sample(base, 400)), *few]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.select(overlap.node().alias("node"), "text")
    node = {r.text: r.node for r in rows.collect()}
    found = {frozenset((r.a, r.b)) for r in overlap.fingerprinted(rows).collect()}
    assert found == {frozenset((node[texts[0]], node[texts[1]]))}
    # The exact join brings the others; what is known is not found again.
    again = overlap.links(docs).collect()
    assert [frozenset((r.a, r.b)) for r in again] == list(found)
