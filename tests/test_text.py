import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import evidence, intent, markup, queries, tasks, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "value, tokens",
    [
        ("Hello hello WORLD 42", ["hello", "world", "42"]),
        ("通信系统", ["通", "信", "系", "统", "通信", "信系", "系统"]),
        ("AM调制 am", ["am", "调", "制", "调制"]),
        ("récent", ["r", "cent"]),
        ("学", ["学"]),
        ("", []),
        (None, []),
    ],
)
def test_tokenize(spark, value, tokens):
    assert one(spark, text.tokenize(F.lit(value).cast("string"))) == tokens


@pytest.mark.parametrize(
    "name, family",
    [
        ("讲义_v2.pdf", "讲义"), ("讲义-修订3.pdf", "讲义"), ("lecture1.pdf", "lecture"),
        ("Notes  Final.PDF", "notes final"), ("2024.pdf", "2024"), ("/a/b/Week Version 3.md", "week"),
    ],
)
def test_logical_name(spark, name, family):
    assert one(spark, text.logical_name(F.lit(name))) == family


def test_shingles_do_not_overlap(spark):
    assert sorted(one(spark, text.shingles(F.lit("ab cde FGHIJ kl")))) == ["abcde", "fghij"]
    assert one(spark, text.shingles(F.lit("a b"))) == ["ab"]
    assert one(spark, text.shingles(F.lit("  "))) == []


def test_scope_keys(spark):
    cases = {"": "all", " 期末 考试! ": "期末_考试", "__": "all", "Lab-1": "lab-1", None: "all"}
    for raw, key in cases.items():
        assert one(spark, text.normalize_scope(F.lit(raw).cast("string"))) == key


@pytest.mark.parametrize(
    "q, topic",
    [
        ("什么是调制？", "调制"), ("奈奎斯特准则是什么", "奈奎斯特准则"), ("熵的定义", "熵"),
        ("信噪比", "信噪比"), ("为什么要调制", None), ("A与B的关系", None),
    ],
)
def test_definition_topic(spark, q, topic):
    assert one(spark, queries.definition_topic(F.lit(q))) == topic


@pytest.mark.parametrize(
    "q, out",
    [
        ("你好，请问什么是调制？", "调制"), ("请介绍一下采样定理的条件", "采样定理的条件"),
        ("帮我解释器原理如何工作", "解释器原理如何工作"), ("为什么要调制", "为什么要调制"),
    ],
)
def test_search_query(spark, q, out):
    assert one(spark, queries.search_query(F.lit(q))) == out


def test_defines_topic_is_literal(spark):
    for body, topic, hit in [
        ("**熵** 是不确定性", "熵", True), ("熵很重要", "熵", False), ("a.c 定义为 x", "a.c", True),
        ("abc 是 x", "a.c", False), ("前文熵值；熵指信息量", "熵", True),
    ]:
        assert one(spark, queries.defines_topic(F.lit(body), F.lit(topic))) is hit


@pytest.mark.parametrize(
    "value, n", [("一", 1), ("两", 2), ("十", 10), ("十二", 12), ("二十", 20), ("九十九", 99), ("7", 7), ("0", None), ("百", None)]
)
def test_numbers(spark, value, n):
    assert one(spark, queries.number_value(F.lit(value))) == n


def test_list_items(spark):
    body = "(1) a\n2、b\n（三）c\n 四、d\n不是 5 e"
    assert one(spark, queries.list_item_numbers(F.lit(body))) == [1, 2, 3, 4]
    assert one(spark, queries.expected_list_count(F.lit("共三个条件，5 步"))) == 5
    assert one(spark, queries.has_list_cue(F.lit("综上所述有三个必要条件"))) is True


def test_count_in_briefs_equals_count_in_texts(spark):
    rng = random.Random(4)
    bits = ["1", "2", "9", "三", "十二", "步", "个", "方面", "必要", "条件", "a", " ", "\t", "", "xy", "\n"]
    lines = [["".join(rng.choices(bits, k=rng.randint(0, 7))) for _ in range(5)] for _ in range(400)] + [["a 123 ", "", "步"]]
    df = spark.createDataFrame([(x,) for x in lines], "lines array<string>")
    whole, brief = F.array_join("lines", "\n"), F.array_join(F.transform("lines", queries.count_brief), "\n")
    got = df.select(queries.expected_list_count(whole).alias("w"), queries.expected_list_count(brief).alias("b")).collect()
    assert [r["w"] for r in got] == [r["b"] for r in got] and got[-1]["b"] == 23 and None in [r["w"] for r in got]


def test_list_items_as_two_passes(spark):
    rng = random.Random(5)
    bits = ["(", "（", ")", "）", "1", "２", "33", "二", "十", "、", ".", "．", "\n", " ", "\u3000", "a", "\r"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(800)]

    def two(pattern):
        found = [F.regexp_extract_all("t", F.lit("(?U)" + pattern), F.lit(i)) for i in (1, 2)]
        return F.filter(F.concat(*found), lambda v: v != "")

    arabic = F.transform(two(queries.ARABIC_ITEM), lambda v: text.ascii_digits(v).cast("int"))
    chinese = F.filter(F.transform(two(queries.CHINESE_ITEM), queries.chinese_number), lambda n: n > 0)
    both = F.array_sort(F.array_distinct(F.concat(arabic, chinese)))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(both.alias("two"), queries.list_item_numbers("t").alias("one")).collect()
    assert [r["two"] for r in got] == [r["one"] for r in got] and sum(map(len, (r["one"] for r in got))) > 50
    # A digit of another script is no number of an item; it used to end the query.
    assert one(spark, queries.list_item_numbers(F.lit("(٣) a\n(2) b"))) == [2]


def test_strip_is_the_space_class(spark):
    points = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in points], "t string")
    old = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.filter(text.strip("t") != old).count() == 0 and df.filter(text.strip("t") != F.col("t")).count() == len(text.SPACES)
    # The middle of a long run of blanks was walked once for every blank.
    assert one(spark, F.length(text.strip(F.concat(F.lit("a"), F.repeat(F.lit(" "), F.lit(200_000)), F.lit("b"))))) == 200_002


def test_short_texts_are_one_shingle(spark):
    cases = {"": [], " \n": [], "A b": ["ab"], "abcde": ["abcde"], "abcdefg": ["abcde"], "abcdeABCDE xyzzy": ["abcde", "xyzzy"]}
    for body, want in cases.items():
        assert one(spark, text.shingles(F.lit(body))) == want
    plan = spark.createDataFrame([("a",)], "t string").select(text.shingles("t").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_extract_all") == 1  # the text was cut twice


def test_evidence_metadata(spark):
    body = "国家标准\n版本：2.1\n生效日期：2024年3月5日\n有效期至 2026-01-31\n适用范围：全体学生"
    got = one(spark, evidence.evidence_metadata(F.lit(body), F.lit("x.pdf"))).asDict()
    assert got["source_version"] == "2.1"
    assert (got["effective_from"], got["effective_to"]) == ("2024-03-05", "2026-01-31")
    assert (got["authority_level"], got["authority_label"]) == (90, "国家标准")
    assert got["metadata_confidence"] == 0.95
    plain = one(spark, evidence.evidence_metadata(F.lit("hello"), F.lit("x.md"))).asDict()
    assert (plain["authority_level"], plain["metadata_confidence"]) == (30, 0.2)


def test_invalid_date_is_null(spark):
    assert one(spark, evidence.iso_date(F.lit("2024年2月30日"))) is None
    assert one(spark, evidence.iso_date(F.lit("于2024.2.29起"))) == "2024-02-29"


@pytest.mark.parametrize(
    "q, task, scenario, as_of",
    [
        ("请出5道选择题", "question_generate", None, None), ("新旧版本的区别", "version_compare", None, None),
        ("第三章讲了什么", "chapter", None, None), ("期末考试可以带计算器吗", "rule_query", "考试", None),
        ("2024年3月5日的规定", "rule_query", None, "2024-03-05"), ("什么是熵的含义", "concept", None, None),
        ("最新规定", "rule_query", None, "2025-01-01"), ("你好", "conversation", None, None),
        ("讲讲这门课", "qa", None, None),
    ],
)
def test_rule_intent(spark, q, task, scenario, as_of):
    d = one(spark, intent.resolve_intent(F.lit(q), today=F.lit("2025-01-01")))
    assert (d["task"], d["scenario"], d["as_of"]) == (task, scenario, as_of)


def test_context_intent(spark):
    prev = F.struct(
        F.lit("rule_query").alias("task"), F.lit("qa").alias("mode"), F.lit("考试").alias("scenario"),
        F.lit("2024-03-05").alias("as_of"),
    )
    d = one(spark, intent.resolve_intent(F.lit("那这个规定呢"), prev))
    assert (d["task"], d["scenario"], d["as_of"], d["layer"]) == ("rule_query", "考试", "2024-03-05", "context")
    d = one(spark, intent.resolve_intent(F.lit("那实验的规定呢"), prev))
    assert (d["scenario"], d["layer"]) == ("实验", "rule")


def test_model_intent_is_checked(spark):
    good = '```json{"task":"qa","mode":"qa","scenario":"Lab 1","as_of":"2024-01-02","confidence":7}```'
    d = one(spark, intent.valid_model_intent(F.lit(good)))
    assert (d["task"], d["scenario"], d["confidence"]) == ("qa", "lab_1", 0.6)
    for bad in ('{"task":"x","mode":"qa"}', '{"task":"qa","mode":"qa","as_of":"2024-13-01"}', "no json"):
        assert one(spark, intent.valid_model_intent(F.lit(bad))) is None


@pytest.mark.parametrize(
    "q, before, granted",
    [
        ("出题并保存", False, True), ("不要保存", True, False), ("能不能保存到题库", False, False),
        ("他说“请保存”", False, False), ("把题目存入题库", False, True), ("继续", True, True),
    ],
)
def test_save_permission(spark, q, before, granted):
    assert one(spark, intent.save_authorization(F.lit(q), F.lit(before))) is granted


def test_markup(spark):
    html = "<table><tr><th>A <b>x</b></th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert one(spark, markup.table_headers(F.lit(html))) == "A x | B"
    assert one(spark, markup.html_to_text(F.lit(html))).splitlines()[1] == "| 1 | 2"
    assert one(spark, markup.bare_latex(F.lit("$$ a+b $$"))) == "a+b"
    assert one(spark, markup.bare_latex(F.lit("\\[x\\]"))) == "x"
    assert one(spark, markup.textbook_references(F.lit("见 P28 Ex2 与第 3 页"))) == ["P28 Ex2", "第 3 页"]
    assert one(spark, markup.slide_text(F.lit("**==> pic <==**\n# T\n|---|\n**b** x "))) == "T\nb x"
    cap = one(spark, markup.figure_caption(F.lit("正文\n图 5.3-1 频谱")))
    assert cap["label"] == "图 5.3-1"
    boxes = F.array(F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)]), F.array(*[F.lit(float(v)) for v in (0, 3, 5, 9)]))
    assert one(spark, markup.bbox_text(boxes)) == "0.00,2.00,5.00,9.00"


@pytest.mark.parametrize(
    "kind, body, role",
    [
        ("header", "x", "noise"), ("text", "12:30", "noise"), ("text", "注意：别忘了", "annotation"),
        ("text", "P28 Ex2", "reference"), ("text", "普通正文", "content"),
    ],
)
def test_content_role(spark, kind, body, role):
    assert one(spark, markup.content_role(F.lit(kind), F.lit(body))) == role


def test_question_slots_and_blueprint(spark):
    s = one(spark, tasks.question_slots(F.lit("请根据第 3 章出五道选择题，困难，并保存")))
    assert (s["chapter"], s["count"], s["question_type"], s["difficulty"], s["save_requested"]) == (
        "第3章", 5, "choice", "hard", True,
    )
    text_ = F.lit("组卷：2道选择题，每题5分；1道简答题，困难，每题10分，总分20分")
    rules = tasks.blueprint_rules(text_, F.lit(""), F.lit("medium"))
    got = [(r["question_type"], r["count"], r["difficulty"], r["score"]) for r in one(spark, rules)]
    assert got == [("choice", 2, "medium", 5.0), ("short_answer", 1, "hard", 10.0)]
    totals = one(spark, tasks.blueprint_totals(rules, text_))
    assert (totals["count"], totals["total_score"], totals["issues"]) == (3, 20.0, [])


def test_parsed_questions(spark):
    raw = '说明 {"questions": [{"stem": " s ", "options": ["a","b","c","d"], "answer": "b"}]} 结束'
    got = one(spark, tasks.parsed_questions(F.lit(raw), F.lit("choice"), F.lit(1)))
    assert got[0]["stem"] == "s" and got[0]["options"] == ["a", "b", "c", "d"]
    bad = '[{"stem": "s", "options": ["a","b"], "answer": "b"}]'
    assert one(spark, tasks.parsed_questions(F.lit(bad), F.lit("choice"), F.lit(1))) is None
    assert one(spark, tasks.parsed_questions(F.lit("nothing"), F.lit("choice"), F.lit(1))) is None


def test_tool_arguments(spark):
    a = one(spark, tasks.tool_arguments(F.lit('{"query": " x ", "page": 0, "top_k": 99, "course_id": "z"}')))
    assert (a["query"], a["page"], a["top_k"]) == ("x", 1, 20)


def test_drafts_after_a_read_list_are_not_parsed(spark):
    # The first readable list counts, and later brackets add nothing.
    raw = 'see [x] {"a": 1} [{"stem": "s", "answer": "a"}] [{"stem": "t", "answer": "b"}] ' + "[" * 50
    row = spark.createDataFrame([(raw,), ("no list",), (None,)], "raw string")
    got = [r.d for r in row.select(tasks.first_list(F.col("raw")).alias("d")).collect()]
    assert got[0] is not None and got[1] is None and got[2] is None
    assert [d.stem for d in got[0]] in (["s"], [None], [])
    # The text is stripped and cleaned once, not once a bracket.
    plan = row.select(tasks.first_list(F.col("raw")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2
