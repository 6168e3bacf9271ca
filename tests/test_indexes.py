"""Stored postings and vector cells against the searches they stand for."""

import random

import numpy as np
import pytest

from citeloom.operators import cells, lexical, postings, vector
from citeloom.session import materialize


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(80)]
    odds = [1 / (i + 1) for i in range(80)]
    rows = []
    for i in range(600):
        text = " ".join(rng.choices(words, odds, k=rng.randint(0, 40)))
        rows.append(("ab"[rng.random() < 0.7], rng.randrange(5000), i % 3, text if i % 50 else None))
    rows += [(None, 1, 0, "w1"), ("a", None, 0, "w1 w2"), ("b", -7, 0, "w1 w2 w70")] + [rows[3]] * 2
    return spark.createDataFrame(rows, "course_id string, doc_id long, chunk_index int, text string").dropDuplicates(
        ["course_id", "doc_id", "chunk_index"]
    )


def hits(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["chunk_index"], round(r["raw"], 9), round(r["score"], 9)) for r in df.collect())


def test_indexed_search_equals_bm25(spark, chunks):
    asked = [(1, "a", "w70 w3"), (2, "b", "w1 w2 w40"), (3, "b", "none of these"), (4, "c", "w1"), (5, "b", "w79"), (6, "a", None)]
    queries = spark.createDataFrame(asked, "query_id long, course_id string, query_text string")
    index = postings.build(chunks, span=16, parts=4)
    found = chunks.filter("course_id IS NOT NULL AND doc_id IS NOT NULL")
    for k in (1, 10):
        assert hits(postings.topk(index, queries, k, seeds=2)) == hits(lexical.bm25_topk(found, queries, k))
    kept, ranges, *_ = postings.open_ranges(index, queries, 1, seeds=2)
    assert 0 < kept.count() < ranges.count()


def shuffled_records(spark):
    context = spark.sparkContext
    nothing = context._jvm.java.util.ArrayList()
    store = context._jsc.sc().statusStore()
    stages = store.stageList(nothing, False, False, context._gateway.new_array(context._jvm.double, 0), nothing)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_postings_are_not_shuffled(spark, chunks):
    stored = materialize(chunks.dropna(subset=["text"]), "chunks")
    before = shuffled_records(spark)
    index = postings.build(stored, span=16, parts=4, task_postings=1000)
    moved = shuffled_records(spark) - before
    # One row a chunk and the partial counts of terms; it was each posting, twice.
    assert moved < 0.8 * index.terms.agg({"df": "sum"}).first()[0]


def test_index_without_rows(spark, chunks):
    queries = spark.createDataFrame([(1, "a", "w1")], "query_id long, course_id string, query_text string")
    assert postings.topk(postings.build(chunks.filter("doc_id = 10000000")), queries, 3).count() == 0


def vectors(spark):
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(12, 16))
    rows = [("xy"[i % 5 == 0], i, 0, (middle[i % 12] + 0.2 * rng.normal(size=16)).tolist()) for i in range(900)]
    rows += [("x", 1000, 0, [0.0] * 16), ("x", 1001, 0, None), ("x", 1002, 0, [1.0] * 3), ("x", 7, 1, rows[7][3])]
    return spark.createDataFrame(rows, "course_id string, doc_id long, chunk_index int, embedding array<double>"), middle


def test_cells_lose_no_hit(spark):
    stored, middle = vectors(spark)
    asked = [(i, "xyz"[i % 3], (middle[i] + 0.1).tolist()) for i in range(12)] + [(50, "x", [0.0] * 16), (51, "x", [1.0])]
    queries = spark.createDataFrame(asked, "query_id long, course_id string, query_vec array<double>")
    index = cells.build(stored, cells=24)
    fit = stored.filter("size(embedding) = 16")
    want = vector.vector_topk(fit, queries.filter("size(query_vec) = 16"), 10).collect()
    key = ["query_id", "rank", "doc_id", "chunk_index", "score"]
    assert sorted(tuple(r[c] for c in key) for r in cells.topk(index, queries, 10).collect()) == sorted(
        tuple(r[c] for c in key) for r in want
    )
    bound = cells.bounds(index, queries).filter("query_id = 1")
    assert bound.filter("bound < 0.8").count() > 0  # cells that a good k-th score excludes


def test_recall_of_the_nearest_cells(spark, sf):
    from citeloom.plans import load

    rows = load().queries["vector_cells_recall"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    assert sum(r["hits"] for r in rows) >= 0.9 * sum(r["wanted"] for r in rows)


def test_blocks_find_what_the_jvm_finds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 6)).astype(np.float32)
    x[40:60], x[100], x[101, 2] = x[40], 0, np.nan
    rows = [(str(i % 3), i, i % 2, [float(v) for v in x[i]]) for i in range(240)]
    rows += [("0", 300, 0, [1.0]), ("1", 301, 0, [None] * 6), ("2", 302, 0, [])]
    stored = spark.createDataFrame(rows, "course_id string, doc_id long, chunk_index int, embedding array<float>")
    asked = spark.createDataFrame(
        [(i, str(i % 3), [float(v) for v in (x[i] if i % 2 else -np.abs(x[i]))]) for i in range(0, 240, 5)]
        + [(900, "0", None), (901, "1", [0.5]), (902, "2", [0.0] * 6)],
        "query_id long, course_id string, query_vec array<float>",
    )

    def hits(made):
        return sorted((r.query_id, r.rank, r.doc_id, str(r.score)) for r in made.collect())

    few = hits(vector.vector_topk(stored, asked, 12, 51))
    assert few == hits(vector.vector_topk(stored, asked, 12))
    blocks = vector.nearest(stored, asked, ["course_id"], 12, block=20, asked=3)
    assert few == hits(vector._ranked(blocks, 12))

    own = stored.filter("doc_id % 2 = 0 AND size(embedding) = 6").selectExpr("doc_id AS query_id", "course_id", "embedding AS query_vec")
    assert hits(vector.vector_topk(stored, own, 12, 51)) == hits(vector.vector_topk(stored, own, 12))
