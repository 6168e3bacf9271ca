"""Expressions over question text: normalisation, topics, query classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import as_col, ascii_digits, strip

# Patterns that classify and normalise a question.
POLITE_PREFIX = r"^(?:你好[，,\s]*)?(?:(?:请问|麻烦你?|请你?|帮我|给我)\s*)+"
REQUEST_VERB = r"^(?:详细|简单|简要)?(?:介绍|讲解|解释|说明)一下\s*"
DEFINITION_ASK = r"^(?:什么是|何为)(.+)\z|^(.+?)(?:是什么|的定义(?:是什么)?|的概念)\z"
TOPIC_STOP = r"[，,。！？?]|如何|为什么|区别|哪些|与|和|的|关系|公式"
FORMULA_QUERY = (
    r"公式|表达式|关系式|方程|恒等式|推导|推导过程|数学关系|"
    r"(?:与|和).{1,30}(?:之间)?的?关系(?:是什么|如何|怎样|怎么|$)"
)
LIST_QUERY = (
    r"有哪些|哪些|列出|列举|分别(?:是|为)|包括什么|几(?:个|条|项|种|步|点|方面|类)|"
    r"必要条件|充分条件|条件|要点|步骤|流程|特点|特征|"
    r"原因|因素|类型|分类|组成|构成|注意事项|要求|原则|措施|方面"
)
LIST_CUE = (
    r"(?:综上|如下|分别|包括|包含|归纳|得出|共有|共计|分为)"
    r".{0,60}(?:条件|步骤|原因|要点|特点|原则|方法|类型|方面|项)"
)
LIST_COUNT = (
    r"([0-9]{1,2}|[一二三四五六七八九十两]{1,3})\s*(?:个|条|项|种|步|点|方面|类)\s*"
    r"(?:必要|充分|主要|基本|核心|关键|具体)?\s*"
    r"(?:条件|要求|步骤|原因|特点|要点|原则|方法|类型|方面|内容)?"
)
ARABIC_ITEM = r"(?m)(?:^|\n)\s*(?:[（(]\s*(\d{1,2})\s*[）)]|(\d{1,2})\s*[、.．])"
CHINESE_ITEM = (
    r"(?m)(?:^|\n)\s*(?:[（(]\s*([一二三四五六七八九十两]{1,3})\s*[）)]|"
    r"([一二三四五六七八九十两]{1,3})\s*[、.])"
)
#: Either of the two: they cannot overlap, so one pass finds all of both.
ANY_ITEM = "(?U)" + ARABIC_ITEM + "|" + CHINESE_ITEM
#: The signs that every announced count and every cue begins or ends with.
COUNT_SIGN, CUE_SIGN = "[个条项种步点方类]", "[综如分包归得共]"
FIGURE_REF = r"(?i)(?:图|figure|fig\.?)\s*([0-9]+(?:[.\-][0-9]+)*)"
DIGITS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def definition_topic(query: Column | str) -> Column:
    """Subject of a definition question, or a short bare term, else NULL."""
    t = F.btrim(as_col(query), F.lit(" \t\n？?。"))
    asked = F.coalesce(
        F.nullif(F.regexp_extract(t, DEFINITION_ASK, 1), F.lit("")),
        F.nullif(F.regexp_extract(t, DEFINITION_ASK, 2), F.lit("")),
    )
    bare = F.length(t).between(2, 30) & ~t.rlike(TOPIC_STOP)
    return F.when(asked.isNotNull(), F.btrim(asked, F.lit(" ‘'\"“”「」"))).when(bare, t)


def search_query(question: Column | str) -> Column:
    """Question without polite wrapping, reduced to its definition topic."""
    whole = strip(question)
    q = F.regexp_replace(whole, POLITE_PREFIX, "")
    q = strip(F.regexp_replace(q, REQUEST_VERB, ""))
    q = F.coalesce(F.nullif(q, F.lit("")), whole)
    return F.coalesce(F.nullif(definition_topic(q), F.lit("")), q)


def defines_topic(text: Column | str, topic: Column | str) -> Column:
    """Text contains ``topic`` followed by a defining phrase.

    The topic is data, so it is quoted before it becomes part of the pattern.
    """
    clean = F.regexp_replace(F.coalesce(as_col(text), F.lit("")), "[*`]+", "")
    quoted = F.replace(as_col(topic), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit(r"(?U)\Q"), quoted, F.lit(r"\E\s*(?:是|指|定义为|定义[:：])"))
    return F.coalesce(F.regexp_like(clean, pattern), F.lit(False))


def is_formula_query(query: Column | str) -> Column:
    return as_col(query).rlike(FORMULA_QUERY)


def is_list_query(query: Column | str) -> Column:
    return as_col(query).rlike(LIST_QUERY)


def has_list_cue(text: Column | str) -> Column:
    return as_col(text).rlike(CUE_SIGN) & as_col(text).rlike(LIST_CUE)


def _digit(ch: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv])
    return F.try_element_at(table, ch)


def chinese_number(value: Column | str) -> Column:
    """一 … 九十九 (两 counts as two); NULL for anything else."""
    v = as_col(value)
    left, right = F.substring_index(v, "十", 1), F.regexp_replace(v, "^[^十]*十", "")
    tens = F.when(left == "", F.lit(1)).otherwise(F.coalesce(_digit(left), F.lit(1)))
    ones = F.coalesce(_digit(right), F.lit(0))
    return F.when(v == "十", F.lit(10)).when(v.contains("十"), tens * 10 + ones).otherwise(_digit(v))


def number_value(value: Column | str) -> Column:
    """Arabic 1..99 or a Chinese numeral, else NULL."""
    v = ascii_digits(value)
    arabic = F.try_to_number(v, F.lit("999999999")).cast("int")
    return F.when(v.rlike(r"^\d+$"), F.when(arabic.between(1, 99), arabic)).otherwise(
        chinese_number(v)
    )


def list_item_numbers(text: Column | str) -> Column:
    """Sorted distinct item numbers of numbered lines.

    The whole text is read once; digits are folded in the few signs found.
    """
    found = F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(ANY_ITEM), F.lit(0))
    signs = F.transform(found, lambda m: ascii_digits(F.regexp_extract(m, r"(?U)[\d一二三四五六七八九十两]+", 0)))
    numbers = F.transform(
        signs,
        lambda v: F.when(v.rlike("^[0-9]+$"), v.try_cast("int")).otherwise(
            F.when(chinese_number(v) > 0, chinese_number(v))
        ),
    )
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))


def expected_list_count(text: Column | str) -> Column:
    """Largest announced item count, NULL without one."""
    found = F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(LIST_COUNT), F.lit(1))
    return F.array_max(F.filter(F.transform(found, number_value), lambda n: n.isNotNull()))


def count_brief(text: Column | str) -> Column:
    """What ``expected_list_count`` needs of a line among others.

    A line without a sign that ends a count can only lend its last number to a
    sign on a later line, so its last three characters stand for it.
    """
    t = F.coalesce(as_col(text), F.lit(""))
    return F.when(t.rlike(COUNT_SIGN), t).otherwise(F.right(F.rtrim(t, F.lit(" \t\n\x0b\f\r")), F.lit(3)))


def figure_refs(text: Column | str) -> Column:
    """Figure numbers named in a text, dots folded to dashes."""
    found = F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(FIGURE_REF), F.lit(1))
    return F.array_distinct(F.transform(found, lambda v: F.replace(v, F.lit("."), F.lit("-"))))
