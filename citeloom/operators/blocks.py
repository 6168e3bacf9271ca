"""Layout blocks: reconstruction from parser JSON, pages, structured chunks.

A block row has doc_id, pos (order in the document), page, block_type, text and
the layout attributes.  Reconstruction is relational; the heading stack of a
document is a fold over its titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import markup
from citeloom.functions.text import join_references, squeeze, strip
from citeloom.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents

CAPTION_TYPES = ("image_caption", "table_caption", "figure_caption")
FORMULA_BLOCKS = ("formula", "formula_inline")
REACH = 3
FORMULA_CUE = r"公式|表达式|关系式|方程|恒等式|可表示为|可写为|可得|推导|其中|满足|定义为"
CJK = "[一-鿿]"

ITEM_SCHEMA = (
    "type string, text string, page_idx string, `order` int, level string, html string, "
    "img_path string, bbox array<double>, pdf_page_label string, page_label string, "
    "lines array<struct<text:string, content:string>>, "
    "latex string, rec_formula string, formula string, formula_text string, "
    "math_content string, math string, content string"
)


def content_items(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """Items of the three accepted JSON envelopes, one row each.

    A bare array, ``{content_list: [...]}`` or ``{data: {content_list: [...]}}``.
    """
    items = f"array<struct<{_struct_fields()}>>"
    raw = F.col(payload)
    listed = F.coalesce(
        F.from_json(raw, f"struct<content_list:{items}>")["content_list"],
        F.from_json(raw, f"struct<data:struct<content_list:{items}>>")["data"]["content_list"],
    )
    both = F.when(F.btrim(raw).startswith("["), F.from_json(raw, items)).otherwise(listed)
    # An inner explode would parse the JSON once more, for a test of its size.
    rows = docs.select("doc_id", F.posexplode_outer(both).alias("pos", "item"))
    return rows.filter("pos IS NOT NULL").select("doc_id", "pos", "item.*")


def _struct_fields() -> str:
    import re

    return re.sub(r"(^|, )(`?\w+`?) ", r"\1\2:", ITEM_SCHEMA)


def generic_items(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """Items of the page-wise envelope ``{pages: [{blocks: [...]}]}``."""
    items = f"array<struct<{_struct_fields()}>>"
    pages = F.from_json(payload, f"struct<pages:array<struct<page:int,blocks:{items}>>>")["pages"]
    rows = docs.select("doc_id", F.posexplode(pages).alias("page_no", "p")).select(
        "doc_id", "page_no", F.coalesce(F.col("p.page") - 1, F.col("page_no")).alias("idx"),
        F.posexplode("p.blocks").alias("n", "item"),
    )
    order = Window.partitionBy("doc_id").orderBy("page_no", "n")
    return rows.select(
        "doc_id", (F.row_number().over(order) - 1).alias("pos"),
        F.col("item").withField("page_idx", F.coalesce("item.page_idx", F.col("idx").cast("string"))).alias("item"),
    ).select("doc_id", "pos", "item.*")


MD_IMAGE = r"!\[([^\]]*)\]\(\s*(<[^>]*>|[^)\s]+)[^)]*\)"


def markdown_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Text and image blocks of Markdown, in order.

    The text around image links alternates with the links.  A figure caption on
    the first line after an image becomes its caption and leaves the text; the
    alternative text serves where there is none.
    """
    t = strip(text)

    def links(i: int) -> Column:
        return F.regexp_extract_all(t, F.lit(MD_IMAGE), F.lit(i))

    zipped = F.arrays_zip(
        F.split(t, MD_IMAGE).alias("before"), links(1).alias("alt"), links(2).alias("path"),
        F.slice(F.split(t, MD_IMAGE), 2, F.greatest(F.size(F.split(t, MD_IMAGE)) - 1, F.lit(0))).alias("after"),
    )
    first_line = r"^[ \t]*\r?\n\s*([^\r\n]+)"
    label = "(?i)^(?:" + markup.ANY_FIGURE_LABEL.removeprefix("(?i)") + ")"
    rows = docs.select("doc_id", F.posexplode(zipped).alias("i", "z"))
    after_image = F.col("i") > 0
    lead = markup.plain_line(F.regexp_extract(F.col("z.before"), first_line, 1))
    consumed = after_image & lead.rlike(label)
    body = F.when(consumed, F.regexp_replace("z.before", first_line, "")).otherwise(F.col("z.before"))
    line = markup.plain_line(F.regexp_extract(F.coalesce("z.after", F.lit("")), first_line, 1))
    alt = markup.plain_line(F.coalesce("z.alt", F.lit("")))
    caption = F.when(line.rlike(label), line).when(alt.rlike(label), alt).otherwise("")
    texts = rows.select(
        "doc_id", (F.col("i") * 2).alias("ord"), F.lit("text").alias("block_type"),
        strip(body).alias("text"), F.lit("").alias("caption"), F.lit("").alias("image_path"),
    ).filter("text <> ''")
    images = rows.filter("z.path IS NOT NULL").select(
        "doc_id", (F.col("i") * 2 + 1).alias("ord"), F.lit("image").alias("block_type"),
        caption.alias("text"), caption.alias("caption"), F.btrim("z.path", F.lit("<>")).alias("image_path"),
    )
    both = texts.unionByName(images)
    return annotate(both.withColumns({"page": F.lit(None).cast("int"), "pos": F.col("ord")}))


def captioned(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Items with what ``mount_captions`` finds, as columns of the items themselves.

    ``note`` is the text of a caption that has one, ``target_pos`` and ``is_last``
    are as there, ``mounted`` is the caption that stays with a target.  All windows
    lie within the keys: items already dealt by them are not shuffled again.
    """
    keys = keys or ["doc_id"]
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    is_target = F.col("type").isin("image", "table")
    target_at = F.when(is_target, F.col("pos"))
    known = F.lit(True)
    for key in [*keys, "pos"]:
        known = known & F.col(key).isNotNull()
    note = F.when(F.col("type").isin(*CAPTION_TYPES) & known, F.nullif(strip("text"), F.lit("")))
    near = F.coalesce(F.last(target_at, True).over(earlier), F.min(target_at).over(whole))
    seen = items.withColumns({"note": note, "__near": near})
    reached = F.col("note").isNotNull() & (F.abs(F.col("__near") - F.col("pos")) <= REACH)
    seen = seen.withColumn("target_pos", F.when(reached, F.col("__near")))
    # A target and its captions lie together.
    seen = seen.withColumn("__at", F.coalesce("target_pos", target_at))
    together = Window.partitionBy(*keys, "__at")
    caption_at = F.when(F.col("target_pos").isNotNull(), F.col("pos"))
    return seen.withColumns(
        {
            "is_last": F.coalesce(caption_at == F.max(caption_at).over(together), F.lit(False)),
            "mounted": F.when(is_target & known, F.max_by("note", caption_at).over(together)),
        }
    ).drop("__near", "__at")


def mount_captions(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Attach captions to the image or table they belong to.

    The nearest target before the caption is taken, the first one after it only
    if none precedes; farther than three positions is an orphan.  The last
    caption of a target stays.  Output: one row per caption with ``target_pos``
    (NULL for an orphan) and ``is_last``.
    """
    keys = keys or ["doc_id"]
    # Only captions need their text, and rows without a key have no neighbours.
    text = F.when(F.col("type").isin(*CAPTION_TYPES), F.col("text")).alias("text")
    found = captioned(items.dropna(subset=keys).select(*keys, "pos", "type", text), keys)
    return found.filter("note IS NOT NULL").select(
        *keys, "target_pos", "pos", F.col("note").alias("caption"), "is_last"
    )


def to_blocks(items: DataFrame) -> DataFrame:
    """Typed blocks from content items, captions mounted, roles annotated.

    Captions that found a target are no blocks; orphans are, of their own type.
    """
    item_text = F.col("text")
    pieces = F.filter(
        F.transform(
            F.coalesce("lines", F.array()),
            lambda ln: strip(F.coalesce(F.nullif(ln["text"], F.lit("")), ln["content"], F.lit(""))),
        ),
        lambda v: v != "",
    )
    lines = F.when(F.col("type").isin(*CAPTION_TYPES), F.array_join(pieces, " ")).otherwise(
        F.array_join(pieces, "\n")
    )
    items = items.withColumn("text", F.coalesce(F.nullif(item_text, F.lit("")), lines, F.lit("")))
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("text"))
    for alias, name in markup.FORMULA_TYPES.items():
        kind = F.when(F.col("type") == alias, F.lit(name)).otherwise(kind)
    found = F.when(
        kind.isin(*FORMULA_BLOCKS),
        markup.formula_latex({k: F.col(k) for k in markup.FORMULA_KEYS}),
    ).otherwise(F.lit(""))
    latex = F.col("__latex")
    page = (F.coalesce(F.expr("try_cast(coalesce(page_idx, '0') AS INT)"))) + 1
    body = (
        F.when(kind.isin(*FORMULA_BLOCKS), F.when(latex != "", F.concat(F.lit("$$"), latex, F.lit("$$"))).otherwise(""))
        .when(
            kind == "table",
            F.coalesce(F.nullif(strip("text"), F.lit("")), markup.html_to_text("html")),
        )
        .otherwise(strip("text"))
    )
    own = ~kind.isin(*CAPTION_TYPES)
    orphan = F.col("note").isNotNull() & F.col("target_pos").isNull()
    label = strip(F.coalesce(F.nullif(F.col("pdf_page_label"), F.lit("")), F.col("page_label"), F.lit("")))
    blocks = captioned(items).filter(own | orphan).withColumn("__latex", found).select(
        "doc_id",
        page.alias("page"),
        F.when(own, F.coalesce(F.col("order"), F.col("pos"))).otherwise(F.col("pos")).alias("ord"),
        "pos",
        F.when(own, kind).otherwise("caption").alias("block_type"),
        body.alias("text"),
        F.when(kind == "title", F.coalesce(F.expr("try_cast(level AS INT)"), F.lit(1))).otherwise(0).alias("level"),
        F.when(own, F.coalesce("html", F.lit(""))).otherwise("").alias("html"),
        latex.alias("latex"),
        F.when(own, F.coalesce("img_path", F.lit(""))).otherwise("").alias("image_path"),
        F.coalesce("mounted", F.lit("")).alias("caption"),
        F.when(own & (F.size("bbox") == 4), F.col("bbox")).alias("bbox"),
        F.when(own, label).otherwise("").alias("pdf_page_label"),
    )
    return annotate(blocks)


def annotate(blocks: DataFrame) -> DataFrame:
    """Add references and the layout role."""
    return blocks.withColumns(
        {
            "textbook_references": markup.textbook_references("text"),
            "content_role": markup.content_role("block_type", "text"),
        }
    )


def block_order() -> list[Column]:
    return [F.asc(F.coalesce("page", F.lit(0))), F.asc("ord"), F.asc("pos")]


def pages_of(blocks: DataFrame) -> DataFrame:
    """Page texts in block order, blank-line joined; unknown page is NULL."""
    texts = blocks.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    key = F.coalesce(F.col("page"), F.lit(0))
    joined = texts.groupBy("doc_id", key.alias("key")).agg(
        F.sort_array(F.collect_list(F.struct("ord", "pos", "text", "pdf_page_label"))).alias("b")
    )
    labels = F.filter(F.transform("b", lambda x: x["pdf_page_label"]), lambda v: v != "")
    return joined.select(
        "doc_id",
        F.nullif(F.col("key"), F.lit(0)).alias("page"),
        F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"),
        F.coalesce(F.get(labels, F.lit(0)), F.lit("")).alias("pdf_page_label"),
    )


def merge_pages(left: DataFrame, right: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Positional merge of two extractions: the longer text, ties to the left."""
    a = left.select(*keys, index, F.col("text").alias("__a"))
    b = right.select(*keys, index, F.col("text").alias("__b"))
    size_a, size_b = F.length(F.coalesce("__a", F.lit(""))), F.length(F.coalesce("__b", F.lit("")))
    keep_left = F.col("__b").isNull() | (F.col("__a").isNotNull() & (size_a >= size_b))
    return (
        a.join(b, [*keys, index], "full_outer")
        .select(
            *keys,
            index,
            F.when(keep_left, F.col("__a")).otherwise(F.col("__b")).alias("text"),
            F.when(keep_left, "left").otherwise("right").alias("side"),
        )
        .filter(squeeze(F.coalesce("text", F.lit(""))) != "")
    )


def parse_quality(pages: DataFrame, expected: Column, blocks: Column) -> DataFrame:
    """Quality of a parsed document from its pages.

    ``pages``: doc_id, page, text; ``expected``: expected physical pages;
    ``blocks``: whether structure was found.  Both are per-document columns.
    """
    dense = F.length(squeeze(F.coalesce("text", F.lit(""))))
    agg = pages.groupBy("doc_id").agg(
        F.sum(dense).alias("chars"),
        F.count_if(dense > 0).alias("parsed_pages"),
        F.count("*").alias("all_pages"),
        F.bool_or((dense > 0) & F.col("page").isNull()).alias("unpaged"),
        F.max(expected).alias("expected_pages"),
        F.bool_or(blocks).alias("has_blocks"),
    )
    known = F.col("expected_pages") > 0
    coverage = F.when(
        known & F.col("unpaged") & (F.col("chars") >= 80), F.lit(1.0)
    ).otherwise(
        F.least(
            F.col("parsed_pages")
            / F.when(known, F.col("expected_pages")).otherwise(F.greatest("all_pages", F.lit(1))),
            F.lit(1.0),
        )
    )
    per_page = F.col("chars") / F.greatest(
        F.when(known, F.col("expected_pages")).otherwise(F.col("parsed_pages")), F.lit(1)
    )
    structure = F.when(F.col("has_blocks"), 1.0).when(F.col("chars") > 0, 0.65).otherwise(0.0)
    return agg.select(
        "doc_id",
        F.round(0.45 * F.least(per_page / 160, F.lit(1.0)) + 0.40 * coverage + 0.15 * structure, 4).alias("score"),
        F.round(coverage, 4).alias("page_coverage"),
        F.round(per_page, 2).alias("chars_per_page"),
        structure.alias("structure_ratio"),
        "expected_pages",
        "parsed_pages",
    )


def page_kind(pages: DataFrame) -> DataFrame:
    """text, mixed or scanned, from the first two, middle and last pages.

    ``pages``: doc_id, index (0-based), n_pages, text.
    """
    n, i = F.col("n_pages"), F.col("index")
    sampled = pages.filter(
        i.isin(0, 1) | (i == F.floor(n / 2).cast("int")) | (i == n - 1)
    )
    dense = F.length(squeeze(F.coalesce("text", F.lit(""))))
    agg = sampled.groupBy("doc_id").agg(F.sum(dense).alias("total"), F.avg(dense).alias("mean"))
    return agg.select(
        "doc_id",
        F.when((F.col("total") < 30) | (F.col("mean") < 30), "scanned")
        .when(F.col("mean") < 200, "mixed")
        .otherwise("text")
        .alias("kind"),
    )


def choose_candidate(candidates: DataFrame, threshold: float = 0.55) -> DataFrame:
    """First candidate at or above the threshold in order, else the best one."""
    from citeloom.operators.joins import first_rows

    good = F.col("score") >= threshold
    return first_rows(
        candidates,
        ["doc_id"],
        [
            F.desc(good),
            F.asc(F.when(good, F.col("attempt"))),
            F.desc("score"),
            F.asc("attempt"),
        ],
        1,
    )


def caption_pages(captions: DataFrame, pages: DataFrame) -> DataFrame:
    """Physical page of a caption: first page with its text, else with its label.

    ``captions``: doc_id, caption_no, caption; ``pages``: doc_id, page, text.
    """
    c = captions.select(
        "doc_id",
        "caption_no",
        markup.page_key("caption").alias("full"),
        markup.page_key(F.regexp_extract("caption", markup.FIGURE_LABEL, 0)).alias("label"),
    )
    p = pages.select("doc_id", "page", markup.page_key("text").alias("body"))
    hit = c.join(p, "doc_id").select(
        "doc_id",
        "caption_no",
        F.when((F.col("full") != "") & F.contains("body", "full"), F.col("page")).alias("by_text"),
        F.when((F.col("label") != "") & F.contains("body", "label"), F.col("page")).alias("by_label"),
    )
    return hit.groupBy("doc_id", "caption_no").agg(
        F.coalesce(F.min("by_text"), F.min("by_label")).alias("page")
    )


def missing_figures(blocks: DataFrame) -> DataFrame:
    """First caption block per page and figure label that no image covers."""
    from citeloom.operators.joins import first_rows

    label = markup.page_key(
        F.regexp_extract(
            F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.col("text")),
            markup.ANY_FIGURE_LABEL, 0,
        )
    )
    have = (
        blocks.filter(F.col("block_type") == "image")
        .select("doc_id", "page", label.alias("label"))
        .filter("label <> ''")
        .distinct()
    )
    found = markup.figure_caption(F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.col("text")))
    named = (
        blocks.filter(F.col("page") > 0)
        .withColumn("found", found)
        .filter("found IS NOT NULL")
        .select(
            "doc_id", "page", "ord", "pos", markup.page_key("found.label").alias("label"),
            F.col("found.caption").alias("caption"),
        )
        .join(have, ["doc_id", "page", "label"], "left_anti")
    )
    return first_rows(named, ["doc_id", "page", "label"], [F.asc("ord"), F.asc("pos")], 1)


def add_formulas(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Recognised formulas not already present, numbered per page.

    ``found``: doc_id, seq, page, latex.  The ordinal counts every recognised
    formula of a page, kept or not.
    """
    from citeloom.operators.joins import first_rows

    key = squeeze("latex")
    have = (
        blocks.filter(F.col("block_type").isin(*FORMULA_BLOCKS))
        .select("doc_id", key.alias("key"))
        .distinct()
    )
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq"))
    numbered = found.withColumn("nth", nth).withColumn("key", key).filter("key <> ''")
    fresh = first_rows(
        numbered.join(have, ["doc_id", "key"], "left_anti"), ["doc_id", "key"], [F.asc("seq")], 1
    )
    rows = fresh.select(
        "doc_id",
        "page",
        (F.coalesce("page", F.lit(0)) * 100000 + F.col("nth")).cast("int").alias("ord"),
        F.lit("formula").alias("block_type"),
        F.concat(F.lit("$$"), "latex", F.lit("$$")).alias("text"),
        "latex",
    )
    return blocks.unionByName(rows, allowMissingColumns=True)


# --- structured chunks --------------------------------------------------------


def around_images(blocks: DataFrame) -> DataFrame:
    """Blocks with ``near``, for images: the nearest body text before and after on
    the same page, at most six blocks away, no title in between."""
    content = (
        (F.col("block_type") == "text")
        & (F.col("content_role") == "content")
        & (F.btrim("text") != "")
    )
    body = F.when(content, F.struct("pos", F.substring(F.btrim("text"), 1, 600).alias("t")))
    stop = F.when(F.col("block_type") == "title", F.col("pos"))
    page = Window.partitionBy("doc_id", "page").orderBy("pos")
    back, ahead = page.rowsBetween(-6, -1), page.rowsBetween(1, 6)
    out = blocks.withColumns(
        {
            "__b": F.last(body, True).over(back),
            "__bs": F.last(stop, True).over(back),
            "__a": F.first(body, True).over(ahead),
            "__as": F.first(stop, True).over(ahead),
        }
    )
    before = F.when(F.col("__bs").isNull() | (F.col("__b.pos") > F.col("__bs")), F.col("__b.t"))
    after = F.when(F.col("__as").isNull() | (F.col("__a.pos") < F.col("__as")), F.col("__a.t"))
    near = F.when(F.col("block_type") == "image", F.concat_ws("\n", before, after))
    return out.withColumn("near", near).drop("__b", "__bs", "__a", "__as")


def image_context(blocks: DataFrame) -> DataFrame:
    """Body text around each image, one row per image."""
    found = around_images(blocks).filter(F.col("block_type") == "image")
    return found.select("doc_id", "pos", F.col("near").alias("context"))


def around_formulas(blocks: DataFrame, max_chars: int = 420) -> DataFrame:
    """Blocks with ``explained``, for formulas: sentences of the same page that
    introduce them, within a budget.

    Blocks are ranked by cue word and distance; of each the cue sentences or,
    without any, the last two are taken, equal ones once, until the budget is used.
    Pages without a formula collect nothing.
    """
    page = Window.partitionBy("doc_id", "page")
    is_formula = F.col("block_type").isin(*FORMULA_BLOCKS)
    skip = is_formula | F.col("block_type").isin("header", "footer") | (F.col("content_role") == "noise")
    out = blocks.withColumn("__wanted", F.bool_or(is_formula).over(page))
    usable = F.col("__wanted") & ~skip & F.col("text").rlike(CJK)
    text = strip(
        F.regexp_replace(F.regexp_replace("text", "[ \t]+", " "), "\n{3,}", "\n\n")
    )
    pieces = F.filter(
        F.transform(F.split("__t", r"(?<=[。！？；：])|\n+"), strip),
        lambda p: (p != "") & p.rlike(CJK),
    )
    cued = F.filter(
        "__pieces", lambda p: p.rlike(FORMULA_CUE) | p.rlike(markup.NUMBERED_SECTION)
    )
    chosen = F.when(F.size("__cued") > 0, F.col("__cued")).otherwise(
        F.slice("__pieces", F.greatest(F.size("__pieces") - 1, F.lit(1)), F.lit(2))
    )
    cue = F.when(F.col("__t").rlike(FORMULA_CUE), 0).otherwise(1)
    side = F.struct(cue.alias("cue"), F.col("pos").alias("other"), chosen.alias("pieces"))
    out = (
        out.withColumn("__t", F.when(usable, text))
        .withColumn("__pieces", pieces)
        .withColumn("__cued", cued)
        .withColumn("__side", F.when(F.col("__t").isNotNull(), side))
        .drop("__wanted", "__t", "__pieces", "__cued")
    )
    sides = F.collect_list("__side").over(page)

    def ranked(s: Column) -> Column:
        dist = F.abs(F.col("pos") - s["other"])
        return F.transform(
            s["pieces"],
            lambda p, n: F.struct(s["cue"].alias("cue"), dist.alias("dist"), s["other"].alias("other"), n.alias("n"), p.alias("p")),
        )

    def take(acc: Column, x: Column) -> Column:
        fresh = (acc["used"] < max_chars) & ~F.array_contains(acc["said"], x["p"])
        more = F.struct(
            F.concat(acc["said"], F.array(x["p"])).alias("said"),
            (acc["used"] + F.length(x["p"]) + 1).alias("used"),
        )
        return F.when(fresh, more).otherwise(acc)

    start = F.struct(F.array().cast("array<string>").alias("said"), F.lit(0).alias("used"))
    said = F.aggregate(F.sort_array(F.flatten(F.transform("__sides", ranked))), start, take)["said"]
    # The budget counts the breaks between pieces, so it ends where the joined text is cut.
    explained = F.substring(F.array_join(said, "\n"), 1, max_chars)
    return (
        out.withColumn("__sides", sides)
        .withColumn("explained", F.when(is_formula, explained))
        .drop("__side", "__sides")
    )


def formula_context(blocks: DataFrame, max_chars: int = 420) -> DataFrame:
    """Introducing sentences of each formula, one row per formula that has any."""
    narrow = blocks.select("doc_id", "page", "pos", "block_type", "content_role", "text")
    found = around_formulas(narrow.dropna(subset=["doc_id"]), max_chars).filter("explained <> ''")
    return found.select("doc_id", "pos", F.col("explained").alias("context"))


#: Heading depths that are columns of the window; deeper ones are collected.
DEPTHS = 16


def section_paths(rows: DataFrame, upto, depths: int = DEPTHS) -> DataFrame:
    """Rows with ``section_path``: a title replaces the headings at its level and below.

    A title lies one deeper than the title before at most, so its depth is the least,
    over the titles up to it, of their level plus the titles since.  The heading of a
    depth is the last title of that depth.  ``upto``: the rows of a document in order,
    up to the current one.
    """
    title = (F.col("kind") == "title") & F.col("doc_id").isNotNull()
    level = F.greatest(F.coalesce(F.col("level").cast("int"), F.lit(1)), F.lit(1))
    rows = rows.withColumn("__nth", F.count(F.when(title, 1)).over(upto))
    low = F.min(F.when(title, level - F.col("__nth"))).over(upto)
    rows = rows.withColumn("__depth", F.col("__nth") + F.least(F.lit(0), low))
    depth = F.col("__depth")
    # Text in a struct, so that a title without text still replaces an earlier one.
    heads = {
        f"__h{k}": F.last(F.when(title & (depth == k), F.struct("text")), True).over(upto)
        for k in range(1, depths + 1)
    }
    deep = F.when(title & (depth > depths), F.struct(F.col("__nth").alias("nth"), depth.alias("depth"), "text"))
    rows = rows.withColumns(
        heads
        | {
            "__deep": F.collect_list(deep).over(upto),
            "__since": F.last(F.when(title & (depth <= depths), F.col("__nth")), True).over(upto),
        }
    )

    def push(stack: Column, t: Column) -> Column:
        above = (t["depth"] - depths - 1).cast("int")
        return F.concat(F.slice(stack, F.lit(1), above), F.array(t["text"]))

    below = F.aggregate(
        F.filter("__deep", lambda t: t["nth"] > F.col("__since")), F.array().cast("array<string>"), push
    )
    shallow = [F.when(depth >= k, F.col(f"__h{k}.text")) for k in range(1, depths + 1)]
    path = F.concat_ws(" / ", *shallow, F.when(depth > depths, below))
    return rows.withColumn("section_path", path).drop("__nth", "__depth", "__deep", "__since", *heads)


def outlined(rows: DataFrame) -> DataFrame:
    """Blocks in order with their section path and group; skipped ones drop out.

    Text blocks of one page share a group; a title opens a group and any other
    block closes it.  All windows lie within the document.
    """
    kept = rows.filter("kind <> 'skip'").withColumns(
        {"p": F.coalesce("page", F.lit(0)), "pos": F.col("pos").cast("int")}
    )
    order = Window.partitionBy("doc_id").orderBy("p", "ord", "pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    was_open = F.coalesce(F.lag("kind").over(order).isin("title", "text"), F.lit(False))
    goes_on = (F.col("kind") == "text") & was_open & F.col("page").eqNullSafe(F.lag("page").over(order))
    placed = kept.withColumns(
        {"seq": F.row_number().over(order), "opens": F.when(goes_on, 0).otherwise(1)}
    ).withColumn("group_no", F.sum("opens").over(upto).cast("int"))
    return section_paths(placed, upto).drop("p", "opens")


def structured_chunks(
    blocks: DataFrame,
    *,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """Chunks with section path, block type and context from layout blocks.

    ``summaries``: doc_id, pos, summary of images a vision model described.

    Every step is a window or a grouping within the document, so blocks are dealt by
    document once at most, and not at all if they already are.
    """
    kind = (
        F.when(
            F.col("block_type").isin("header", "footer") | (F.col("content_role") == "noise"), "skip"
        )
        .when(
            F.col("content_role").isin("annotation", "reference") & (F.col("block_type") != "image"),
            F.col("content_role"),
        )
        .when(F.col("block_type").isin("title", "table", "image"), F.col("block_type"))
        .when(F.col("block_type").isin(*FORMULA_BLOCKS), "formula")
        .otherwise("text")
    )
    nearby = F.when(F.col("doc_id").isNotNull(), F.coalesce("near", "explained"))
    rows = (
        around_formulas(around_images(blocks))
        .withColumn("nearby", F.coalesce(nearby, F.lit("")))
        .withColumn("kind", kind)
        .withColumn("text", strip(F.coalesce("text", F.lit(""))))
    )
    placed = outlined(rows.drop("near", "explained"))
    alone = ~F.col("kind").isin("title", "text")
    if summaries is None:
        placed = placed.withColumn("summary", F.lit(None).cast("string"))
    else:
        given = summaries.select("doc_id", F.col("pos").alias("at"), "summary")
        placed = placed.withColumn("at", F.when(alone, F.col("pos"))).join(given, ["doc_id", "at"], "left").drop("at")

    # Columns of their own, so that what a query leaves out is not computed.
    headers = F.when(F.col("kind") == "table", markup.table_headers("html")).otherwise("")
    of_first = ("kind", "page", "section_path", "nearby", "latex", "caption", "summary", "image_path", "content_role", "headers")
    of_all = ("text", "bbox", "pdf_page_label", "textbook_references")
    groups = placed.withColumn("headers", headers).groupBy("doc_id", "group_no").agg(
        *[F.min_by(c, "seq").alias(c) for c in of_first],
        *[F.sort_array(F.collect_list(F.struct("seq", F.col(c).alias("v")))).alias(c) for c in of_all],
    )

    def values(name: str) -> Column:
        return F.transform(name, lambda x: x["v"])

    is_image, one = F.col("kind") == "image", F.col("text")[0]["v"]
    has_caption, has_summary = F.col("caption") != "", F.coalesce("summary", F.lit("")) != ""
    hint = F.when(F.col("kind") == "formula", markup.section_hint("nearby")).otherwise("")
    path = F.when(F.col("section_path") != "", F.col("section_path")).otherwise(hint)
    label = F.element_at(F.split(path, " / "), -1)
    noted = F.when(
        has_caption,
        F.concat_ws("\n\n", F.nullif(one, F.lit("")), F.concat(F.lit("表格说明："), "caption")),
    ).otherwise(one)
    formula = F.when(one != "", one).when(
        F.col("latex") != "", F.concat(F.lit("$$"), F.btrim("latex"), F.lit("$$"))
    ).otherwise("")
    described = F.concat_ws(
        "\n",
        F.when(F.col("section_path") != "", F.concat(F.lit("§ "), "section_path")),
        F.when(has_caption, F.concat(F.lit("图片说明："), "caption")),
        F.concat(F.lit("视觉摘要："), "summary"),
        F.when(F.col("nearby") != "", F.concat(F.lit("邻近正文（非图中直接读数）："), "nearby")),
    )
    pending = F.concat(
        F.lit("[视觉识别未完成] 图片说明："), F.when(has_caption, F.col("caption")).otherwise("无图注图片")
    )
    explained = F.concat_ws(
        "\n",
        F.when(label != "", F.concat(F.lit("§ "), label)),
        F.when(F.col("nearby") != "", F.concat(F.lit("公式上下文："), "nearby")),
        F.concat(F.lit("公式："), formula),
    )
    parts = F.filter(values("text"), lambda v: v != "")
    text = (
        F.when(~alone, F.array_join(parts, "\n\n"))
        .when(F.col("kind") == "table", noted)
        .when(is_image, F.when(has_summary, described).otherwise(pending))
        .when(F.col("kind") == "formula", F.when(formula != "", explained).otherwise(""))
        .otherwise(one)
    )
    labels = F.filter(values("pdf_page_label"), lambda v: v != "")
    units = groups.select(
        "doc_id", "group_no", "kind", "page", path.alias("section_path"), label.alias("label"),
        markup.bbox_text(values("bbox")).alias("bbox"),
        F.when(alone, F.col("pdf_page_label")[0]["v"]).otherwise(F.coalesce(F.get(labels, F.lit(0)), F.lit(""))).alias("pdf_page_label"),
        join_references(
            F.flatten(F.transform("textbook_references", lambda x: F.coalesce(x["v"], F.array())))
        ).alias("textbook_references"),
        "nearby", "headers", "content_role", "image_path", "caption", has_summary.alias("described"),
        text.alias("text"),
    )
    # Tables, images, formulas and marked blocks are one chunk each.
    pieces = chunk_documents(units, size=size, overlap=overlap, whole=alone).withColumnRenamed("chunk_index", "piece")
    label, page_name = F.col("label"), F.when(F.col("page") > 0, F.concat(F.lit("第"), F.col("page"), F.lit("页"))).otherwise("")
    lead = F.when(label != "", F.concat(F.lit("§ "), label, F.lit("\n"))).otherwise("")
    led = ~alone & (lead != "") & ~F.startswith("text", lead)
    both = pieces.select(
        "doc_id", "group_no", "piece", "page", "section_path", "bbox", "pdf_page_label", "textbook_references",
        F.when(led, F.concat(lead, "text")).otherwise(F.col("text")).alias("text"),
        F.when(~alone, "text").when(is_image & F.col("described"), "image_summary").otherwise(F.col("kind")).alias("block_type"),
        F.when(label != "", label).otherwise(page_name).alias("chapter"),
        F.when(~alone, F.rtrim(lead, F.lit("\n")))
        .otherwise(F.concat_ws("\n", F.nullif(label, F.lit("")), F.nullif(F.col("nearby"), F.lit(""))))
        .alias("context"),
        F.col("headers").alias("table_headers"),
        F.when(~alone, "content").otherwise(F.col("content_role")).alias("content_role"),
        F.when(is_image, F.col("image_path")).otherwise("").alias("image_path"),
        F.when(is_image, F.col("caption")).otherwise("").alias("image_caption"),
    )
    order = Window.partitionBy("doc_id").orderBy("group_no", "piece")
    return both.withColumn("chunk_index", F.row_number().over(order) - 1).drop("group_no", "piece")
