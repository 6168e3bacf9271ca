"""The pipeline's stages against brute force, on awkward rows, and without rows."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from citeloom.llm import decontam, mixing, quality, tokens
from tests.llm.test_text_operators import slow_tiling

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of small tables with nulls, empty and long texts, copies and repeats."""
    root = str(tmp_path_factory.mktemp("tables"))
    item = "this passage of the benchmark has quite a number of words in it so that it can be found again anywhere"
    near = " ".join(f"word{i}" for i in range(300))
    rows = [
        (1, near + " alpha", "en", "a"), (2, near + " beta", "en", "b"), (3, None, "en", None), (4, "", "en", "a"),
        (5, f"before that {item} and after", "en", "b"), (6, "plain words of a plain text", "en", "a"),
        (6, "plain words of a plain text", "en", "a"), (7, "long text " * 20000, "en", "c"), (None, "row without id", None, "c"),
    ]
    rows += [(100 + i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(20 + i)), "en", "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], COLUMNS)
    docs.write.parquet(f"{root}/documents.parquet")
    labels = spark.createDataFrame([(k, 1, 0) for k in (1, 2, 5, 6, 7, *range(100, 130))], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, item


def test_stage_names_and_columns(spark, tables):
    root, _ = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near-duplicates", "benchmark decontamination", "source mixing", "token files"
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, root).columns == docs.columns
        assert stage(spark, docs.limit(0), root).count() == 0
    assert corpus_pipeline.write_tokens(spark, docs.limit(0), root).count() == 0


def test_stages_against_brute_force(spark, tables):
    root, item = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    labels = spark.read.parquet(f"{root}/labels.parquet")
    good = {r.doc_id for r in quality.classified(docs, labels).collect() if r.score >= quality.ACCEPT}
    kept = corpus_pipeline.classify(spark, docs, root).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in docs.collect() if r.doc_id in good)

    from tests.llm.test_overlap import slow_labels

    label = slow_labels([r.text for r in kept])
    best = {}
    for r, o in zip(kept, label, strict=True):
        if o not in best or (r.doc_id is None, r.doc_id or 0) < (best[o].doc_id is None, best[o].doc_id or 0):
            best[o] = r
    second = corpus_pipeline.near_dedup(spark, spark.createDataFrame(kept, docs.schema), root).collect()
    assert sorted(map(str, second)) == sorted(map(str, best.values()))
    assert {r.doc_id for r in second} & {1, 2} == {1}

    w = re.findall("[a-z0-9]+", item)

    def holds(text):
        own = re.findall("[a-z0-9]+", (text or "").lower())
        return "passage" in own and slow_tiling(own, w, decontam.TILE) >= decontam.COVERAGE * len(w)

    third = corpus_pipeline.decontaminate(spark, spark.createDataFrame(second, docs.schema), root).collect()
    assert sorted(map(str, third)) == sorted(str(r) for r in second if not holds(r.text))
    assert 5 not in {r.doc_id for r in third}

    frame = spark.createDataFrame(third, docs.schema)
    times = {}
    for r in mixing.mixed(frame).collect():
        times[r.doc_id] = r.taken // r.size if r.size else None
    fourth = corpus_pipeline.mix(spark, frame, root).collect()
    count = {k: sum(r.doc_id == k for r in fourth) // max(1, sum(r.doc_id == k for r in third)) for k in times}
    assert all(count[k] == n for k, n in times.items() if n is not None)

    written = corpus_pipeline.write_tokens(spark, spark.createDataFrame(fourth, docs.schema), root).collect()
    encoder = tokens.Encoder(tokens.tokenizer_path())
    digests = sorted(
        zlib.crc32(np.frombuffer(encoder.whole(r.text or "") + b"\0\0", np.uint16).astype("<u4").tobytes()) for r in fourth
    )
    assert sorted(r.ids_crc32 for r in written) == digests

    whole = corpus_pipeline.run(spark, root).collect()
    assert sorted(map(str, whole)) == sorted(map(str, written))


def test_one_row_stays_of_equal_ids_and_extra_columns_pass(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(1, text, "x"), (1, text, "y"), (1, text + " end", "z"), (2, text, "x"), (None, text, "x"), (None, "alone", "x"), (None, "alone", "x")]
    docs = spark.createDataFrame([(*r, "k", "k", "k") for r in rows], "doc_id long, text string, source string, node string, root string, rows string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text[:5]) for r in kept.collect()) == [("1", "word0"), ("None", "alone")]
