"""Evidence metadata read from document text: versions, dates, authority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import as_col, ascii_digits, let

# Patterns of dates, versions, validity and scope, and the
# authority levels by wording (first match wins, higher is stronger).
DATE = r"(20\d{2})[年./-](\d{1,2})[月./-](\d{1,2})日?"
VERSION_NUMBER = r"(?i)(?:版本|版次|version|ver\.?|v)\s*[:：#]?[\s]*([0-9]+(?:\.[0-9]+){0,3})"
VERSION_EDITION = r"第\s*([0-9一二三四五六七八九十]+)\s*版"
EFFECTIVE_FROM = r"(?i)(?:生效日期|施行日期|实施日期|自|effective\s*date)\s*[:：]?\s*" + DATE
EFFECTIVE_TO = r"(?i)(?:失效日期|有效期至|截至|effective\s*(?:to|until))\s*[:：]?\s*" + DATE
SCOPE = r"(?i)(?:适用范围|适用场景|适用对象|适用于)\s*[:：]?\s*([^\n。；;]{2,100})"
AUTHORITY_RULES = (
    (r"(?:中华人民共和国)?(?:法律|国务院令|行政法规|国务院)", 100, "国家法律法规"),
    (r"(?:国家标准|GB/T?|标准号\s*GB)", 90, "国家标准"),
    (r"(?:教育部|国家部委|部令)", 80, "部委规范"),
    (r"(?:行业标准|协会标准|团体标准)", 70, "行业规范"),
    (r"(?:省|市|自治区).{0,12}(?:规定|办法|通知)", 60, "地方规范"),
    (r"(?:学校|大学|学院).{0,20}(?:规定|办法|通知|制度)", 50, "机构文件"),
    (r"(?:课程组|教研室|教学团队)", 40, "课程资料"),
    (r"(?:讲义|课件|课堂笔记|教师)", 30, "教学材料"),
    (r"(?:草案|征求意见|讨论稿|试行)", 10, "草案或试行稿"),
)
DEFAULT_RULE = (30, "教学材料")


def iso_date(text: Column | str, pattern: str = DATE) -> Column:
    """First date of the pattern as ``YYYY-MM-DD``; NULL if absent or invalid."""
    t = as_col(text)
    # (?U): digits and white space of any script, as the patterns mean them.
    parts = [ascii_digits(F.regexp_extract(t, "(?U)" + pattern, i)) for i in (1, 2, 3)]
    day = F.try_to_date(F.concat_ws("-", *parts), "yyyy-M-d")
    return F.date_format(day, "yyyy-MM-dd")


def evidence_metadata(text: Column | str, filename: Column | str) -> Column:
    """Struct of version, validity, authority, scope and confidence."""
    t, name = F.coalesce(as_col(text), F.lit("")), F.coalesce(as_col(filename), F.lit(""))
    number = F.regexp_extract(t, "(?U)" + VERSION_NUMBER, 1)
    edition = F.regexp_extract(t, "(?U)" + VERSION_EDITION, 1)
    version = F.when(number != "", number).otherwise(edition)
    start = F.coalesce(iso_date(t, EFFECTIVE_FROM), F.lit("0001-01-01"))
    end = F.coalesce(iso_date(t, EFFECTIVE_TO), F.lit("9999-12-31"))
    rank = F.lit(None).cast("int")
    for i, (pattern, _, _) in reversed(list(enumerate(AUTHORITY_RULES))):
        rank = F.when(t.rlike(pattern) | name.rlike(pattern), F.lit(i)).otherwise(rank)
    base = F.struct(
        version.alias("source_version"), start.alias("start"), end.alias("end"),
        rank.alias("rule"), t.rlike(SCOPE).alias("names_scope"),
    )
    # One struct, so that each pattern runs once per text.
    return let(base, _assemble)


def _assemble(m: Column) -> Column:
    levels = F.array(*[F.lit(level) for _, level, _ in AUTHORITY_RULES])
    labels = F.array(*[F.lit(label) for _, _, label in AUTHORITY_RULES])
    level = F.coalesce(F.get(levels, m["rule"]), F.lit(DEFAULT_RULE[0]))
    label = F.coalesce(F.get(labels, m["rule"]), F.lit(DEFAULT_RULE[1]))
    # Hundredths as integers: the parts add up exactly.
    points = (
        F.lit(20)
        + F.when(m["source_version"] != "", 20).otherwise(0)
        + F.when(m["start"] != "0001-01-01", 25).otherwise(0)
        + F.when(label != DEFAULT_RULE[1], 25).otherwise(0)
        + F.when(m["names_scope"], 10).otherwise(0)
    )
    return F.struct(
        m["source_version"].alias("source_version"),
        m["start"].alias("effective_from"),
        m["end"].alias("effective_to"),
        level.alias("authority_level"),
        label.alias("authority_label"),
        F.lit("all").alias("applicability_scope"),
        (F.least(points, F.lit(95)) / 100.0).alias("metadata_confidence"),
        F.lit("auto").alias("metadata_source"),
    )
