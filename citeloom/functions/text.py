"""Text expressions.  Everything is a Column built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the lexical tokens.
WORD_PATTERN = "[a-z0-9ıſ]+"
CJK_PATTERN = "[一-鿿㐀-䶿豈-﫿]+"

#: Unicode-aware whitespace class (Java's plain ``\s`` is ASCII only).
SPACE = r"(?U)\s"
#: The characters of that class.
SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ascii_digits(value: Column | str) -> Column:
    """Full-width digits as their ASCII forms."""
    return F.translate(as_col(value), "０１２３４５６７８９", "0123456789")


def strip(value: Column | str) -> Column:
    """Trim Unicode whitespace from both ends; what lies between is not read."""
    return F.btrim(as_col(value), F.lit(SPACES))


def collapse_space(value: Column | str) -> Column:
    """Runs of whitespace to one blank, ends trimmed."""
    return F.btrim(F.regexp_replace(as_col(value), r"(?U)\s+", " "))


def squeeze(value: Column | str) -> Column:
    """Remove all whitespace."""
    return F.regexp_replace(as_col(value), r"(?U)\s+", "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def is_blank(value: Column | str) -> Column:
    c = as_col(value)
    return c.isNull() | (strip(c) == "")


def _cjk_grams(run: Column) -> Column:
    chars = F.filter(F.split(run, ""), lambda ch: ch != "")
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: i < F.length(run)),
        lambda i: F.substring(run, i, F.lit(2)),
    )
    return F.concat(chars, pairs)


def tokenize(value: Column | str) -> Column:
    """Ordered distinct tokens: ASCII words, then CJK unigrams and bigrams.

    Each token is kept once, so term frequency is never above one.
    """
    lowered = F.lower(F.coalesce(as_col(value), F.lit("")))
    words = F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0))
    runs = F.regexp_extract_all(lowered, F.lit(CJK_PATTERN), F.lit(0))
    grams = F.flatten(F.transform(runs, _cjk_grams))
    # Text without ideographs skips the gram arrays altogether.
    return F.array_distinct(F.when(F.size(runs) == 0, words).otherwise(F.concat(words, grams)))


def passage_key(text: Column | str, fallback_id: Column | str) -> Column:
    """Duplicate key of a passage: collapsed text, or the id when blank."""
    norm = collapse_space(F.coalesce(as_col(text), F.lit("")))
    return F.when(norm != "", norm).otherwise(as_col(fallback_id).cast("string"))


def shingles(value: Column | str, size: int = 5) -> Column:
    """Distinct non-overlapping character shingles of the whole whitespace-free text."""
    norm = F.lower(squeeze(F.coalesce(as_col(value), F.lit(""))))
    # Consecutive matches of a fixed length are the non-overlapping pieces; a
    # lambda over start positions would evaluate the text once per piece.  A
    # shorter text is a match as a whole, so the text is cut once.
    short = f"|\\A.{{1,{size - 1}}}\\z" if size > 1 else ""
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(f"(?s).{{{size}}}{short}"), F.lit(0)))


def stem_key(value: Column | str) -> Column:
    """Question-stem identity: word characters only, lower-cased."""
    return F.lower(F.regexp_replace(as_col(value), r"(?U)\W", ""))


def logical_name(filename: Column | str) -> Column:
    """Document family name: stem without a trailing version marker."""
    base = F.regexp_replace(as_col(filename), r"^.*[/\\]", "")
    stem = F.lower(F.regexp_replace(base, r"(?<=.)\.[^.]+$", ""))
    bare = F.regexp_replace(
        strip(stem),
        r"(?iU)(?:[\s_.-]*(?:v|ver|version|rev|revision|更新|修订|新版)?\s*\d+)$",
        "",
    )
    bare = F.btrim(F.regexp_replace(bare, r"(?U)\s+", " "), F.lit(" _.-"))
    return F.when(bare != "", bare).otherwise(stem)


def normalize_scope(value: Column | str) -> Column:
    """Controlled scope key; blank becomes ``all``."""
    low = F.lower(strip(F.coalesce(as_col(value), F.lit(""))))
    key = F.btrim(F.regexp_replace(low, "[^a-z0-9_\\-一-鿿]+", "_"), F.lit("_-"))
    return F.when(key == "", F.lit("all")).otherwise(key)


def section_label(path: Column | str) -> Column:
    """Last element of a ``" / "`` section path."""
    return F.element_at(F.split(F.coalesce(as_col(path), F.lit("")), " / "), -1)


def join_references(values: Column) -> Column:
    """Trimmed, ordered-distinct, non-empty values joined by ``"; "``."""
    trimmed = F.transform(values, lambda v: strip(F.coalesce(v, F.lit(""))))
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda v: v != "")), "; ")


def sigmoid(x: Column | str) -> Column:
    c = as_col(x).cast("double")
    return F.when(c >= 0, 1.0 / (1.0 + F.exp(-c))).otherwise(F.exp(c) / (1.0 + F.exp(c)))


def tail(value: Column | str, n: int = 1200) -> Column:
    return F.right(as_col(value), F.lit(n))


# Document type groups by file extension, with display labels.
TYPE_LABELS = {
    "md": ("markdown", "Markdown 笔记"),
    "txt": ("text", "纯文本"),
    "pdf": ("pdf", "PDF 讲义"),
    "doc": ("word", "Word 文档"),
    "docx": ("word", "Word 文档"),
    "pptx": ("ppt", "PPT 讲义"),
}
OTHER_TYPE = ("other", "其他")

# Image media types by file extension.
IMAGE_MIMES = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
    "gif": "image/gif",
    "bmp": "image/bmp",
}


def extension(filename: Column | str) -> Column:
    """Lower-case extension without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(as_col(filename), r"[^/\\]\.([^./\\]+)$", 1))


def _lookup(key: Column, table: dict, default: str, pick=lambda v: v) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, pick(value)).otherwise(out)
    return out


def document_type(filename: Column | str) -> Column:
    return _lookup(extension(filename), TYPE_LABELS, OTHER_TYPE[0], lambda v: v[0])


def document_type_label(filename: Column | str) -> Column:
    return _lookup(extension(filename), TYPE_LABELS, OTHER_TYPE[1], lambda v: v[1])


def image_mime(path: Column | str, content_type: Column | str | None = None) -> Column:
    """Declared media type when supported, else the one of the extension."""
    by_ext = _lookup(extension(path), IMAGE_MIMES, "")
    if content_type is None:
        return by_ext
    declared = F.lower(F.btrim(F.split(F.coalesce(as_col(content_type), F.lit("")), ";")[0]))
    return F.when(declared.isin(sorted(set(IMAGE_MIMES.values()))), declared).otherwise(by_ext)
