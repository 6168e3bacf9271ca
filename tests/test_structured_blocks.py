"""Structured chunks stay with their document: one shuffle, and the same results as plain loops."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.operators import blocks


def test_texts_are_shuffled_once(spark):
    payload = '[{"type": "title", "text": "t"}, {"type": "image"}]'
    docs = spark.createDataFrame([(i, payload) for i in range(3)], "doc_id long, payload string")
    dealt = docs.groupBy("doc_id").agg(F.max("payload").alias("payload"))
    out = blocks.structured_chunks(blocks.to_blocks(blocks.content_items(dealt)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_section_paths_at_any_depth(spark):
    rng = random.Random(3)
    rows = [
        (d, i, rng.choice(["title", "title", "text"]), f"h{d}.{i}", rng.choice([None, 0, 1, 2, 3, 4, 9]))
        for d in (1, 2, 3) for i in range(60)
    ]
    want = {}
    for d in (1, 2, 3):
        stack = []
        for _, i, kind, text, level in rows[(d - 1) * 60 : d * 60]:
            if kind == "title":
                stack = [*stack[: max(level or 1, 1) - 1], text] if level is not None else [text]
            want[(d, i)] = " / ".join(stack)
    df = spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string, level int")
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # With two heading columns most titles are deeper and collected.
    for depths in (2, blocks.DEPTHS):
        got = {(r["doc_id"], r["pos"]): r["section_path"] for r in blocks.section_paths(df, upto, depths).collect()}
        assert got == want


def test_captions_go_to_the_nearest_target(spark):
    rng = random.Random(9)
    kinds = ["image", "table", "text", "text", "text", "image_caption", "table_caption", "image_caption"]
    rows = [(d, i, rng.choice(kinds), rng.choice(["", " ", f"c{i}", f"c{i}"])) for d in range(40) for i in range(12)]
    rows += [(None, 0, "image", ""), (None, 1, "image_caption", "no document")]
    want = {}
    for d in range(40):
        mine = [r for r in rows if r[0] == d]
        targets = [r[1] for r in mine if r[2] in ("image", "table")]
        for _, i, kind, text in mine:
            if kind.endswith("caption") and text.strip():
                near = max([t for t in targets if t < i], default=min(targets, default=None))
                want[(d, i)] = near if near is not None and abs(near - i) <= blocks.REACH else None
    items = spark.createDataFrame(rows, "doc_id long, pos int, type string, text string")
    found = blocks.mount_captions(items).collect()
    assert {(r["doc_id"], r["pos"]): r["target_pos"] for r in found} == want
    last = {(d, t): max(i for (e, i), u in want.items() if (e, u) == (d, t)) for (d, _), t in want.items() if t is not None}
    assert {(r["doc_id"], r["target_pos"]): r["pos"] for r in found if r["is_last"]} == last
    mounted = {(r["doc_id"], r["pos"]): r["mounted"] for r in blocks.captioned(items).collect() if r["mounted"]}
    assert mounted == {(d, t): f"c{i}" for (d, t), i in last.items()}


def test_formula_context_keeps_its_budget(spark):
    texts = {
        0: "甲其中乙。丙丁。", 1: "远处满足条件。", 2: "无关文字。再一句。第三句。", 3: "甲其中乙。", 5: "no ideographs", 6: "推导" + "长" * 500,
    }
    rows = [(1, None, i, "text", "content", t) for i, t in texts.items()]
    rows += [(1, None, 4, "formula", "content", "$$x$$"), (1, 2, 7, "formula", "content", "$$y$$"), (2, None, 1, "text", "content", "其中")]
    df = spark.createDataFrame(
        rows, "doc_id long, page int, pos int, block_type string, content_role string, text string"
    )
    got = {r["pos"]: r["context"] for r in blocks.formula_context(df).collect()}
    # Cued blocks by distance, an equal sentence once, cut where 420 characters are used.
    assert got == {4: ("甲其中乙。\n推导" + "长" * 500)[:420]}
    small = {r["pos"]: r["context"] for r in blocks.formula_context(df.filter("pos <> 6")).collect()}
    assert small == {4: "甲其中乙。\n远处满足条件。\n再一句。\n第三句。"}
