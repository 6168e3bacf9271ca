"""Markup to text: tables, headings, figure captions, slide Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import as_col, collapse_space, let, squeeze, strip

# Figure wording, reference wording, noise and annotation marks.
FIGURE_LABEL = r"图\s*\d+(?:\.\d+)*(?:\s*[-－—]\s*\d+)*"
ANY_FIGURE_LABEL = (
    r"(?i)(?:图\s*\d+(?:\.\d+)*(?:\s*[-－—]\s*\d+)*|"
    r"figure\s*\d+(?:[.\-]\d+)*|fig\.?\s*\d+(?:[.\-]\d+)*)"
)
TEXTBOOK_REFERENCES = (
    r"(?<![A-Za-z0-9])(?:P|p)\s*\d{1,4}(?:\s*(?:例|Ex|T|习题)\s*\d+(?:\s*\([^)]{1,20}\))*)?",
    r"第\s*\d{1,4}\s*页",
    r"(?i)(?<![一-鿿A-Za-z0-9])(?:例|Ex|T)\s*\d+(?:\s*\([^)]{1,20}\))*",
)
ANNOTATION = r"(?i)^(?:考点|注意|易错|方法|提示|结论|证明|思路)\s*[:：]"
UI_NOISE = (
    r"(?i)^(?:\d{1,2}:\d{2}|[2-5]G|[0-9]{1,3}%|仅供参考|如有错误欢迎指正|"
    r"https?://\S+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,})$"
)
MARGIN_TYPES = ("header", "footer", "page_number", "footnote")
NUMBERED_SECTION = r"(?m)^(?:#{1,6}\s*)?((?:\d+\.)+\d+\s+[^\n]{1,80})$"
FORMULA_TYPES = {
    "equation": "formula",
    "equation_interline": "formula",
    "display_formula": "formula",
    "inline_equation": "formula_inline",
    "inline_formula": "formula_inline",
}
FORMULA_KEYS = (
    "latex", "rec_formula", "formula", "formula_text", "math_content", "math", "content", "text",
)


def _tidy_lines(text: Column) -> Column:
    lines = F.transform(
        F.split(text, "\n"), lambda ln: strip(F.regexp_replace(ln, r"(?U)\s*[|]\s*$", ""))
    )
    return F.array_join(F.filter(lines, lambda ln: ln != ""), "\n")


def html_to_text(html: Column | str) -> Column:
    """Table markup to lines of ``" | "``-separated cells, other tags dropped."""
    t = F.regexp_replace(F.coalesce(as_col(html), F.lit("")), r"(?i)<t[dh][^>]*>", " | ")
    t = F.regexp_replace(t, r"(?i)</tr>", "\n")
    t = F.regexp_replace(t, r"(?i)</t[dh]>", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"(?i)&nbsp;?", " ")
    return _tidy_lines(t)


def tag_texts(html: Column | str, tag: str) -> Column:
    """Collapsed inner texts of every element of one tag, empty ones dropped."""
    inner = F.regexp_extract_all(
        F.coalesce(as_col(html), F.lit("")), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)
    )
    return F.filter(
        F.transform(inner, lambda v: collapse_space(F.regexp_replace(v, r"<[^>]+>", " "))),
        lambda v: v != "",
    )


def table_headers(html: Column | str) -> Column:
    """Column heads of a table joined by ``" | "``."""
    return F.array_join(tag_texts(html, "th"), " | ")


def plain_line(value: Column | str) -> Column:
    return collapse_space(F.regexp_replace(as_col(value), r"<[^>]+>", ""))


def page_key(value: Column | str) -> Column:
    """Whitespace-free lower-case text with dashes folded, for containment."""
    folded = F.translate(as_col(value), "－—", "--")
    return F.lower(squeeze(folded))


def slide_text(markdown: Column | str) -> Column:
    """Converter Markdown without markers, headings marks, rules, blank lines."""
    t = F.regexp_replace(as_col(markdown), r"(?s)\*\*==>.*?<==\*\*", "")
    t = F.regexp_replace(t, r"(?m)^\s*#+\s*$", "")
    t = F.regexp_replace(t, r"(?m)^\s*#{1,6}\s+", "")
    t = F.regexp_replace(t, r"\*\*|__", "")
    t = F.regexp_replace(t, r"(?m)^\s*\|?[\s:|-]+\|?\s*$", "")
    lines = F.transform(F.split(t, "\n"), lambda v: F.regexp_replace(v, r"(?U)\s+$", ""))
    return strip(F.array_join(F.filter(lines, lambda v: v != ""), "\n"))


def textbook_references(text: Column | str) -> Column:
    """Page and exercise references; one contained in a longer one is dropped."""
    t = F.coalesce(as_col(text), F.lit(""))
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in TEXTBOOK_REFERENCES])
    refs = F.array_distinct(F.filter(F.transform(found, collapse_space), lambda v: v != ""))
    return let(
        refs,
        lambda r: F.filter(r, lambda v: ~F.exists(r, lambda c: (c != v) & F.contains(c, v))),
    )


def content_role(block_type: Column | str, text: Column | str) -> Column:
    """noise, annotation, reference or content."""
    kind = as_col(block_type)

    def role(clean: Column) -> Column:
        return (
            F.when(kind.isin(*MARGIN_TYPES), "noise")
            .when((clean != "") & (F.length(clean) <= 100) & clean.rlike(UI_NOISE), "noise")
            .when(clean.rlike(ANNOTATION), "annotation")
            .when(
                (clean != "") & (F.length(clean) <= 80) & (F.size(textbook_references(clean)) > 0),
                "reference",
            )
            .otherwise("content")
        )

    return let(collapse_space(F.coalesce(as_col(text), F.lit(""))), role)


def bare_latex(value: Column | str) -> Column:
    """Formula text without its delimiters."""

    def unwrap(v: Column) -> Column:
        def inner(pattern: str) -> Column:
            return strip(F.regexp_extract(v, pattern, 1))

        display = r"(?s)^\$\$(.*)\$\$\z"
        return (
            F.when(v.rlike(display), inner(display))
            .when(v.rlike(r"(?s)^\\\[.*\\\]\z"), inner(r"(?s)^\\\[(.*)\\\]\z"))
            .when(v.rlike(r"(?s)^\\\(.*\\\)\z"), inner(r"(?s)^\\\((.*)\\\)\z"))
            .when(v.rlike(r"(?s)^\$.*\$\z"), inner(r"(?s)^\$(.*)\$\z"))
            .otherwise(v)
        )

    return let(strip(F.coalesce(as_col(value), F.lit(""))), unwrap)


def formula_latex(fields: dict[str, Column]) -> Column:
    """First non-empty formula among the known field names."""
    values = [F.nullif(bare_latex(fields[k]), F.lit("")) for k in FORMULA_KEYS if k in fields]
    return F.coalesce(*values, F.lit(""))


def figure_caption(text: Column | str) -> Column:
    """Struct (label, caption) of a line that starts with a figure label."""
    lines = F.filter(
        F.transform(F.split(F.coalesce(as_col(text), F.lit("")), "\n"), plain_line),
        lambda v: v.rlike("(?i)^" + ANY_FIGURE_LABEL.removeprefix("(?i)")),
    )
    line = F.get(lines, F.lit(0))
    return F.when(
        line.isNotNull(),
        F.struct(
            F.regexp_extract(line, "(?i)^" + ANY_FIGURE_LABEL.removeprefix("(?i)"), 0).alias("label"),
            F.substring(line, 1, 240).alias("caption"),
        ),
    )


def section_hint(context: Column | str) -> Column:
    """Last numbered heading in a context text, empty without one."""
    found = F.regexp_extract_all(
        F.coalesce(as_col(context), F.lit("")), F.lit(NUMBERED_SECTION), F.lit(1)
    )
    return F.coalesce(strip(F.try_element_at(found, F.lit(-1))), F.lit(""))


def bbox_text(boxes: Column) -> Column:
    """Union of bounding boxes as ``x0,y0,x1,y1`` with two decimals."""
    good = F.filter(boxes, lambda b: b.isNotNull() & (F.size(b) == 4) & ~F.exists(b, F.isnull))

    def side(i: int, best) -> Column:
        return F.format_string("%.2f", best(F.transform(good, lambda b: b[i])))

    return F.when(F.coalesce(F.size(good), F.lit(0)) <= 0, F.lit("")).otherwise(
        F.concat_ws(
            ",", side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max)
        )
    )


def polygon_bbox(points: Column) -> Column:
    """Bounding box of a polygon given as an array of [x, y] arrays."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(
        F.size(points) >= 4,
        F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)),
    )
