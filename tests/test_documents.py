"""Chunking, layout, versions, stores and sources."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from citeloom.operators import blocks, chunking, ordered, store, versions
from citeloom.sources import files, office


def split(spark, text, size, plain=False):
    fn = chunking.split_plain if plain else chunking.split_text
    return spark.createDataFrame([(text,)], "t string").select(fn("t", size).alias("v")).first()["v"]


def pack(text, size):
    """Independent packing of one text without formulas."""
    out = []
    for para in [p.strip() for p in text.split("\n\n")]:
        if not para:
            continue
        if len(para) <= size:
            out.append(para)
            continue
        current = ""
        piece = ""
        sentences = []
        for ch in para:
            piece += ch
            if ch in "。！？；\n":
                sentences.append(piece)
                piece = ""
        sentences.append(piece)
        for s in sentences:
            if not s.strip():
                continue
            if len(current) + len(s) <= size:
                current += s
                continue
            out.append(current.strip())
            current = ""
            if len(s) > size:
                out += [s[i : i + size].strip() for i in range(0, len(s), size)]
            else:
                current = s
        out.append(current.strip())
    return [c for c in out if c]


def test_packing_matches_an_independent_version(spark):
    rng = random.Random(3)
    for _ in range(12):
        text = "".join(rng.choice(["abc ", "长句子", "。", "\n", "\n\n", "x" * 30, "；"]) for _ in range(60))
        assert split(spark, text, 25, plain=True) == pack(text, 25)
        assert split(spark, text, 25) == pack(text, 25)


def test_formulas_stay_whole(spark):
    text = "引言。" * 8 + "公式 $a+b=c+d+e+f+g$ 之后。" + "结尾。" * 8
    out = split(spark, text, 20)
    assert any("$a+b=c+d+e+f+g$" in c for c in out)
    nested = "前文 $$\\begin{aligned}a\\\\b\\end{aligned}$$ 后文"
    assert split(spark, nested, 800) == [nested]


def test_overlap_takes_the_original_previous_chunk(spark):
    docs = spark.createDataFrame([(1, "aaaa。bbbb。cccc。")], "doc_id long, text string")
    got = [r["text"] for r in chunking.chunk_documents(docs, size=5, overlap=3).orderBy("chunk_index").collect()]
    assert got == ["aaaa。", "aa。\n\nbbbb。", "bb。\n\ncccc。"]
    assert chunking.chunk_documents(docs.withColumn("text", F.lit("  ")), size=5).count() == 0


def test_chapter_headings(spark):
    rows = [(1, 0, "# 绪论"), (1, 1, "正文"), (1, 2, "## 第二章 信源"), (1, 3, "熵"), (1, 4, "### 小节"), (1, 5, "内容"), (2, 0, "无题")]
    lines = spark.createDataFrame(rows, "doc_id long, pos int, text string").withColumn("page", F.col("pos") + 1)
    got = {(r["doc_id"], r["pos"]): r["chapter"] for r in chunking.assign_chapters(lines, ["doc_id"], page="page").collect()}
    assert got[(1, 1)] == "绪论" and got[(1, 3)] == "第二章 信源" and got[(1, 5)] == "第二章 信源"
    assert got[(2, 0)] == "第1页"


def test_carry_last_across_blocks(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, None, i])) for k in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, pos int, v int")
    got = {(r["k"], r["pos"]): r["p"] for r in ordered.carry_last(df, ["k"], "pos", F.col("v"), "p", block=7).collect()}
    last = {}
    for k, i, v in rows:
        assert got[(k, i)] == last.get(k)
        last[k] = v if v is not None else last.get(k)
    n = {(r["k"], r["pos"]): r["n"] for r in ordered.running_count(df, ["k"], "pos", "n", block=7).collect()}
    assert all(n[(k, i)] == i + 1 for k, i, _ in rows)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_similar_earlier_matches_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdef") for _ in range(120)) for _ in range(3)]
    texts = []
    for i in range(24):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 2, 8, 40])):
            t[rng.randrange(len(t))] = rng.choice("abcdef")
        texts.append("".join(t))
    docs = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "course_id string, doc_id long, text string")
    got = {r["doc_id"]: r for r in versions.similar_earlier(docs, ["course_id"]).collect()}
    sets = [{t[i : i + 5] for i in range(0, len(t) - 4, 5)} for t in texts]
    for i in range(24):
        best = max(((jaccard(sets[i], sets[j]), -j) for j in range(i)), default=(0.0, 0))
        if best[0] >= 0.2:
            assert (got[i]["best_doc"], round(got[i]["similarity"], 9)) == (-best[1], round(best[0], 9))
        else:
            assert got[i]["best_doc"] is None


def test_update_decisions(spark):
    stored = spark.createDataFrame(
        [
            (1, "c", "/a.pdf", "h1", "notes", "abcdefghij" * 5, 1, True),
            (2, "c", "/b.pdf", "h2", "notes", "zyxwvutsrq" * 5, 1, True),
            (3, "c", "/c.pdf", "h3", "old", "text", 1, False),
        ],
        "doc_id long, course_id string, path string, content_hash string, logical_name string, text string, version_number int, is_active boolean",
    )
    incoming = spark.createDataFrame(
        [
            (10, "c", "/new.pdf", "h1", "notes", "same bytes"), (11, "c", "/b.pdf", "h9", "x", "other"),
            (12, "c", "/n.pdf", "h8", "notes", "abcdefghij" * 4 + "0123456789"), (13, "c", "/m.pdf", "h7", "notes", "nothing alike here"),
            (14, "c", "/c.pdf", "h3", "old", "text"),
        ],
        "file_id long, course_id string, path string, content_hash string, logical_name string, text string",
    )
    got = {r["file_id"]: (r["action"], r["previous_doc_id"]) for r in versions.match_candidates(incoming, stored).collect()}
    assert got == {10: ("unchanged", None), 11: ("updated", 2), 12: ("updated", 1), 13: ("created", None), 14: ("created", None)}


def test_promotion(spark):
    docs = spark.createDataFrame(
        [(1, True, "done", 3, None, None), (2, False, "done", 1, None, None)],
        "doc_id long, is_active boolean, status string, version_number int, previous_doc_id long, superseded_by long",
    )
    change = spark.createDataFrame([(1, 2)], "old_doc long, new_doc long")
    a, b = versions.promote_versions(docs, change).orderBy("doc_id").collect()
    assert (a["is_active"], a["status"], a["superseded_by"]) == (False, "superseded", 2)
    assert (b["is_active"], b["version_number"], b["previous_doc_id"]) == (True, 4, 1)


PAYLOAD = """{"data": {"content_list": [
 {"type": "title", "text": "第一章 绪论", "level": 1, "page_idx": 0},
 {"type": "text", "text": "本节公式满足下列关系。", "page_idx": 0},
 {"type": "equation", "latex": "$$x=1$$", "page_idx": 0},
 {"type": "image", "img_path": "a.png", "page_idx": 0},
 {"type": "image_caption", "text": "图 1 波形", "page_idx": 0},
 {"type": "title", "text": "1.1 模型", "level": 2, "page_idx": 1},
 {"type": "text", "text": "甲。", "page_idx": 1}, {"type": "text", "text": "乙。", "page_idx": 1},
 {"type": "table", "html": "<tr><th>参数</th></tr><tr><td>1</td></tr>", "page_idx": 1},
 {"type": "footer", "text": "页脚", "page_idx": 1},
 {"type": "text", "text": "第 12 页 例3", "page_idx": 1}]}}"""


def test_structured_chunks(spark):
    docs = spark.createDataFrame([(1, PAYLOAD)], "doc_id long, payload string")
    b = blocks.to_blocks(blocks.content_items(docs))
    out = blocks.structured_chunks(b, size=200, overlap=0).orderBy("chunk_index").collect()
    # Paragraphs split before packing, so a heading is a chunk of its own.
    first, second = "第一章 绪论", "第一章 绪论 / 1.1 模型"
    assert [(r["block_type"], r["page"], r["section_path"]) for r in out] == [
        ("text", 1, first), ("text", 1, first), ("formula", 1, first), ("image", 1, first),
        ("text", 2, second), ("text", 2, second), ("text", 2, second), ("table", 2, second),
        ("reference", 2, second),
    ]
    assert out[1]["text"] == "§ 第一章 绪论\n本节公式满足下列关系。"
    assert out[2]["text"] == "§ 第一章 绪论\n公式上下文：本节公式满足下列关系。\n第一章 绪论\n公式：$$x=1$$"
    assert out[3]["image_caption"] == "图 1 波形"
    assert out[5]["text"] == "§ 1.1 模型\n甲。"
    assert out[7]["table_headers"] == "参数"
    pages = {r["page"]: r["text"] for r in blocks.pages_of(b).collect()}
    assert pages[1].startswith("第一章 绪论\n\n本节公式")


def test_candidate_choice(spark):
    df = spark.createDataFrame([(1, 0, 0.4), (1, 1, 0.6), (1, 2, 0.9), (2, 0, 0.1), (2, 1, 0.3)], "doc_id int, attempt int, score double")
    got = {r["doc_id"]: r["attempt"] for r in blocks.choose_candidate(df).collect()}
    assert got == {1: 1, 2: 1}


def test_caption_pages_and_missing_figures(spark):
    caps = spark.createDataFrame([(1, 0, "图 2 — 频谱"), (1, 1, "图 9 无")], "doc_id int, caption_no int, caption string")
    pages = spark.createDataFrame([(1, 1, "目录 图2"), (1, 2, "见 图 2－频谱 说明")], "doc_id int, page int, text string")
    got = {r["caption_no"]: r["page"] for r in blocks.caption_pages(caps, pages).collect()}
    assert got == {0: 2, 1: None}
    b = spark.createDataFrame(
        [(1, 1, 0, 0, "image", "图 1 a", ""), (1, 1, 1, 1, "text", "图 1 a", ""), (1, 1, 2, 2, "text", "图 2 b", ""), (1, 1, 3, 3, "text", "由图 3 可知", "")],
        "doc_id int, page int, ord int, pos int, block_type string, text string, caption string",
    )
    assert [r["label"] for r in blocks.missing_figures(b).collect()] == ["图2"]


def test_recognised_formulas(spark):
    have = spark.createDataFrame([(1, 1, 0, "formula", "$$a b$$", "a b")], "doc_id long, page int, ord int, block_type string, text string, latex string")
    found = spark.createDataFrame([(1, 0, 1, "ab"), (1, 1, 1, "c"), (1, 2, 1, "c "), (1, 3, 2, "")], "doc_id long, seq int, page int, latex string")
    rows = blocks.add_formulas(have, found).filter("ord > 0").collect()
    assert [(r["latex"], r["ord"]) for r in rows] == [("c", 100002)]


def test_store_functions(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, v string, n int")
    new = spark.createDataFrame([(2, "z", 7), (3, "c", 9)], "id int, v string, n int")
    rows = lambda df: sorted((r["id"], r["v"], r["n"]) for r in df.collect())
    assert rows(store.upsert(old, new, ["id"])) == [(1, "a", 5), (2, "z", 7), (3, "c", 9)]
    assert [r[0] for r in rows(store.append_missing(old, new, ["id"]).fillna(0))] == [1, 2, 3]
    assert rows(store.delete(old, new, ["id"])) == [(1, "a", 5)]
    change = spark.createDataFrame([(1, None, 6)], "id int, v string, n int")
    assert (1, "a", 6) in rows(store.patch(old, change, ["id"]).fillna(0))
    assert [r["v"] for r in store.patch(old, change, ["id"], keep_null=True).filter("id = 1").collect()] == [None]
    diff = {r["id"]: r["difference"] for r in store.snapshot_changes(old, new, ["id"], ["v", "n"]).collect()}
    assert diff == {1: "removed", 2: "changed", 3: "added"}


def test_scan_plan(spark):
    found = spark.createDataFrame([("/a.md", 10.0), ("/b.md", 10.0), ("/c.pdf", 1.0), ("/d.md", 1.0), ("/e.md", 1.0)], "path string, mtime double")
    docs = spark.createDataFrame(
        [("/a.md", 1, "c", "done", 10.0), ("/b.md", 2, "c", "done", 9.0), ("/d.md", 3, "x", "done", 1.0), ("/e.md", 4, "c", "processing", None)],
        "path string, doc_id long, course_id string, status string, file_mtime double",
    )
    got = {r["path"]: r["action"] for r in store.scan_plan(found, docs, "c").collect()}
    assert got == {"/a.md": "unchanged", "/b.md": "ingest", "/c.pdf": "fingerprint", "/d.md": "skip_other_course", "/e.md": "unchanged"}


def test_chunk_rows_reject_missing_course(spark):
    df = spark.createDataFrame([(" ", 1, 0, "t", None)], "course_id string, doc_id long, chunk_index int, text string, page int")
    with pytest.raises(Exception, match="course_id is required"):
        store.chunk_rows(df).collect()
    row = store.chunk_rows(df.withColumn("course_id", F.lit("c"))).first()
    assert (row["id"], row["page"], row["effective_from_sort"], row["content_role"]) == ("1_0", -1, 10101, "content")


def docx(body, header=""):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {ns}>{header}</w:hdr>")
    return buf.getvalue()


def para(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_office_readers():
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("first") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}{cell('c')}</w:tr></w:tbl>" + para("last")
    assert office.docx_text(docx(body, para("top"))) == "top\n\nfirst\n\na | b\nc\n\nlast"
    assert office.pages_of("x", "docx", b"broken")[0][5].startswith("BadZipFile")
    assert office.pages_of("x", "pdf", b"")[0][5] == "no reader for pdf"


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿# 标题\n正文".encode())
    (tmp_path / "b.txt").write_bytes("中文内容".encode("gbk"))
    (tmp_path / "c.docx").write_bytes(docx(para("word")))
    (tmp_path / "d.txt").write_bytes(b"  ")
    (tmp_path / "e.bin").write_bytes(b"x")
    pages = {r["path"].rsplit("/", 1)[1]: r for r in files.parse_pages(files.scan(spark, str(tmp_path))).collect()}
    assert set(pages) == {"a.md", "b.txt", "c.docx", "d.txt"}
    assert pages["a.md"]["text"] == "# 标题\n正文" and pages["b.txt"]["text"] == "中文内容"
    assert pages["c.docx"]["text"] == "word" and pages["d.txt"]["error"] == "empty document"
    prints = files.fingerprint(files.scan(spark, str(tmp_path)))
    assert prints.select("content_hash").distinct().count() == 4


def test_folder_stream(spark, tmp_path):
    from citeloom.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("hello")
    args = (str(tmp_path / "out"), str(tmp_path / "state"))
    run = lambda: ingest.run_available(
        ingest.watch_folder(spark, str(src)), lambda b: ingest.file_chunks(b, "c"), *args
    )
    run()
    (src / "b.txt").write_text("world")
    out = spark.read.parquet(run())
    assert sorted(r["text"] for r in out.collect()) == ["hello", "world"]


def test_markdown_blocks(spark):
    md = "开头\n![](images/a.jpg)\n图 1 波形\n后文\n![图 2 频谱](b.png)\n结尾"
    docs = spark.createDataFrame([(1, md)], "doc_id long, text string")
    got = [(r["block_type"], r["text"], r["image_path"]) for r in blocks.markdown_blocks(docs).orderBy("ord").collect()]
    assert got == [
        ("text", "开头", ""), ("image", "图 1 波形", "images/a.jpg"), ("text", "后文", ""),
        ("image", "图 2 频谱", "b.png"), ("text", "结尾", ""),
    ]


def test_generic_envelope(spark):
    body = '{"pages": [{"page": 3, "blocks": [{"type": "text", "text": "a"}]}, {"blocks": [{"text": "b"}]}]}'
    docs = spark.createDataFrame([(1, body)], "doc_id long, payload string")
    got = [(r["pos"], r["page_idx"], r["text"]) for r in blocks.generic_items(docs).orderBy("pos").collect()]
    assert got == [(0, "2", "a"), (1, "1", "b")]


def test_catalog(spark):
    from citeloom.operators import catalog

    colleges = spark.createDataFrame([("old", "x"), ("k", "y")], "id string, name string")
    courses = spark.createDataFrame([("c0", "old", "legacy"), ("c1", "k", "b")], "id string, college_id string, name string")
    docs = spark.createDataFrame([("c0",), ("c9",)], "course_id string")
    left, kept, moved = catalog.migrate_legacy(colleges, courses, docs, ["c0"], ["old"], "c1")
    assert [r["id"] for r in left.collect()] == ["k"] and [r["id"] for r in kept.collect()] == ["c1"]
    assert [r["course_id"] for r in catalog.missing_courses(moved, kept).collect()] == ["c9"]
    seeded = catalog.seed(courses, spark.createDataFrame([("c1", "k", "new"), ("d", "k", "def")], "id string, college_id string, name string"))
    assert {r["id"]: r["name"] for r in seeded.collect()} == {"c0": "legacy", "c1": "new", "d": "def"}


def test_embeddings(spark):
    from citeloom.operators.embedding import hash_embedding, model_embedding
    from citeloom.streaming.tokens import event_frame, frame_payloads

    df = spark.createDataFrame([("alpha beta",), ("",)], "t string")
    a, b = (r["v"] for r in df.select(hash_embedding("t", 8).alias("v")).collect())
    assert abs(sum(x * x for x in a) - 1) < 1e-6 and set(b) == {0.0}
    lengths = lambda: lambda texts: [[float(len(t))] for t in texts]
    assert [r["v"] for r in df.select(model_embedding("t", lengths).alias("v")).collect()] == [[10.0], [0.0]]
    framed = df.select(event_frame("t").alias("f")).select(frame_payloads(F.col("f")).alias("p"))
    assert framed.first()["p"] == ['{"t":"alpha beta"}']
