"""Segmentation against trying all paths, and BM25 over dictionary tokens."""

import math
import random

import pytest

from citeloom.operators import lexical, segmentation

FREQ = {"卷积": 900, "定理": 800, "卷积定理": 40, "信号": 700, "与": 2000, "系统": 900, "信": 100, "号": 90, "处理": 600, "信号处理": 30}


def brute(run, freq):
    total = sum(freq.values())
    best = None

    def go(at, lengths, value):
        nonlocal best
        if at == len(run):
            if best is None or (value, lengths) > best:
                best = (value, lengths)
            return
        for end in range(at + 1, len(run) + 1):
            word = run[at:end]
            if word in freq or end == at + 1:
                go(end, [*lengths, end - at], value + segmentation.weight(freq.get(word, 1), total))

    go(0, [], 0)
    out, at = [], 0
    for n in best[1]:
        out.append(run[at : at + n])
        at += n
    return out, best[0]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([*FREQ.items(), ("", 5), ("零", 0), ("信号", 3)], "word string, freq long")


def test_best_paths_of_random_runs(spark):
    rng = random.Random(2)
    freq = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))): rng.randint(1, 500) for _ in range(60)}
    frame = spark.createDataFrame(list(freq.items()), "word string, freq long")
    made = segmentation.trie(frame)
    runs = ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    paths, weights, _, _ = made.paths(runs)
    for run, cut, value in zip(runs, made.cut(runs), weights, strict=True):
        assert (cut, value) == brute(run, freq)


def test_custom_words_change_the_path(words):
    run = "信号与系统"
    assert segmentation.trie(words).cut([run]) == [["信号", "与", "系统"]]
    assert segmentation.trie(words, [(run, None)]).cut([run]) == [[run]]
    assert segmentation.trie(words, [("号与", 10.0)]).cut([run]) == [["信号", "与", "系统"]]
    assert segmentation.trie(words, [("号与系", 1e12)]).cut([run]) == [["信", "号与系", "统"]]


def test_search_mode_adds_the_words_inside(words):
    made = segmentation.trie(words, [("卷积定理", 5000.0)])
    assert made.cut(["卷积定理"], search=True) == [["卷积", "定理", "卷积定理"]]


def test_long_run_and_unknown_characters(words):
    made = segmentation.trie(words)
    long = "信号与系统" * 20000
    assert made.cut([long, "", "ééé"]) == [["信号", "与", "系统"] * 20000, [], ["é", "é", "é"]]


def test_tokens_and_bm25(spark, words):
    held = segmentation.broadcast(spark, segmentation.trie(words))
    rows = [("Signal 信号处理 x", ["signal", "x", "信号", "处理"]), (None, []), ("", [])]
    df = spark.createDataFrame([(t,) for t, _ in rows], "text string")
    got = [r[0] for r in df.select(segmentation.tokenize("text", held, pairs=False)).collect()]
    # The whole compound is likelier than its parts only with a higher frequency.
    total = sum(FREQ.values())
    parts = math.log(FREQ["信号"] / total) + math.log(FREQ["处理"] / total)
    whole = ["信号", "处理", "信号处理"] if math.log(FREQ["信号处理"] / total) > parts else ["信号", "处理"]
    assert got == [["signal", "x", *whole], [], []]

    chunks = spark.createDataFrame(
        [("c", 1, 0, "卷积定理"), ("c", 2, 0, "信号与系统"), ("c", 3, 0, "系统")],
        "course_id string, doc_id long, chunk_index int, text string",
    )
    asked = spark.createDataFrame([(1, "c", "信号")], "query_id long, course_id string, query_text string")
    # Character pairs meet across words, dictionary words do not.
    stored = lexical.with_tokens(chunks, held)
    hits = lexical.bm25_topk(stored, lexical.with_query_tokens(asked, held), 5).collect()
    assert [h["doc_id"] for h in hits] == [2]
