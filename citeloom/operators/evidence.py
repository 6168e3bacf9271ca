"""Evidence metadata: scope and validity predicates, ordering, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import as_col, normalize_scope

# Defaults of the evidence attributes of a chunk.
OPEN_FROM = "0001-01-01"
OPEN_TO = "9999-12-31"
OPEN_FROM_SORT = 10101
OPEN_TO_SORT = 99991231
ALL_SCOPES = "all"
DEFAULT_AUTHORITY = 30
DEFAULT_AUTHORITY_LABEL = "教学材料"
TEXT_DEFAULTS = {
    "chapter": "",
    "block_type": "",
    "section_path": "",
    "table_headers": "",
    "context": "",
    "bbox": "",
    "pdf_page_label": "",
    "textbook_references": "",
    "image_path": "",
    "image_caption": "",
    "parser_name": "",
    "source_version": "",
    "content_role": "content",
    "effective_from": OPEN_FROM,
    "effective_to": OPEN_TO,
    "authority_label": DEFAULT_AUTHORITY_LABEL,
    "applicability_scope": ALL_SCOPES,
    "metadata_source": "auto",
}


def or_default(value: Column | str, default) -> Column:
    """Default for NULL and for the empty string."""
    return F.coalesce(F.nullif(as_col(value), F.lit("")), F.lit(default))


def with_text_defaults(df: DataFrame) -> DataFrame:
    """Fill every text attribute, adding columns that are absent."""
    return df.withColumns(
        {
            name: or_default(name, default) if name in df.columns else F.lit(default)
            for name, default in TEXT_DEFAULTS.items()
        }
    )


def date_sort_key(value: Column | str, default: int) -> Column:
    """``YYYY-MM-DD`` as a sortable integer; anything else is the default."""
    digits = F.regexp_replace(F.coalesce(as_col(value), F.lit("")), r"(?U)\D", "")
    return F.when(F.length(digits) == 8, digits.cast("int")).otherwise(F.lit(default))


def is_applicable(
    scenario: Column,
    as_of: Column,
    scope: Column | str = "applicability_scope",
    start: Column | str = "effective_from",
    end: Column | str = "effective_to",
) -> Column:
    """Closed-interval validity and scope match; NULL or blank arguments are off."""
    scenario = F.nullif(scenario, F.lit(""))
    as_of = F.nullif(as_of, F.lit(""))
    own = or_default(scope, ALL_SCOPES)
    in_scope = (
        scenario.isNull() | (scenario == ALL_SCOPES) | (own == ALL_SCOPES) | (own == scenario)
    )
    valid = as_of.isNull() | (
        (or_default(start, OPEN_FROM) <= as_of) & (as_of <= or_default(end, OPEN_TO))
    )
    return in_scope & valid


def evidence_filter(
    chunks: DataFrame,
    course_id: str,
    *,
    block_type: str | None = None,
    scenario: str | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """Active chunks of one course under optional type, scope and date filters.

    Plain column comparisons with literals, so all of it reaches the scan.
    """
    if not course_id or not course_id.strip():
        raise ValueError("course_id is required")
    out = chunks.filter(F.col("course_id") == course_id)
    if "is_active" in chunks.columns:
        out = out.filter("is_active")
    if block_type:
        out = out.filter(F.col("block_type") == block_type)
    if scenario and scenario != ALL_SCOPES:
        out = out.filter(F.col("applicability_scope").isin(scenario, ALL_SCOPES))
    if as_of:
        out = out.filter((F.col("effective_from") <= as_of) & (F.col("effective_to") >= as_of))
    return out


def maintained_scopes(docs: DataFrame) -> DataFrame:
    """Distinct manual scope keys of active, finished documents."""
    return (
        docs.filter("metadata_source = 'manual' AND status = 'done' AND is_active")
        .select("course_id", normalize_scope("applicability_scope").alias("scope"))
        .filter(F.col("scope") != ALL_SCOPES)
        .distinct()
    )


def authority_order() -> list[Column]:
    """Authority, then start of validity, then score, all descending."""
    return [
        F.desc(F.coalesce(F.col("authority_level"), F.lit(0))),
        F.desc(or_default("effective_from", OPEN_FROM)),
        F.desc(F.coalesce(F.col("score"), F.lit(0.0))),
    ]


def evidence_reason(scenario: Column | None = None, as_of: Column | None = None) -> Column:
    """Human-readable selection reason; absent parts are skipped."""
    parts = []
    if scenario is not None:
        parts.append(
            F.when(
                F.nullif(scenario, F.lit("")).isNotNull(),
                F.concat(F.lit("适用场景="), or_default("applicability_scope", ALL_SCOPES)),
            )
        )
    if as_of is not None:
        parts.append(
            F.when(
                F.nullif(as_of, F.lit("")).isNotNull(),
                F.concat(
                    F.lit("生效期="), or_default("effective_from", "未知"),
                    F.lit("~"), or_default("effective_to", "未知"),
                ),
            )
        )
    level = F.coalesce(F.col("authority_level"), F.lit(0)).cast("string")
    parts += [
        F.concat(F.lit("权威="), or_default("authority_label", "未识别"), F.lit("(L"), level, F.lit(")")),
        F.concat(F.lit("版本="), F.nullif(F.col("source_version"), F.lit(""))),
    ]
    return F.concat_ws("；", *parts)


def citations(
    hits: DataFrame,
    *,
    scenario: Column | None = None,
    as_of: Column | None = None,
    role: str = "retrieval_candidate",
    single_line: bool = True,
    missing_source: str = "未知",
    snippet: int = 200,
) -> DataFrame:
    """Hits to citation rows: snippet, rounded score, evidence attributes."""
    text = F.substring(F.coalesce(F.col("text"), F.lit("")), 1, snippet)
    if single_line:
        text = F.translate(text, "\n", " ")
    filled = with_text_defaults(hits)
    reason = evidence_reason(scenario, as_of)
    keep = [c for c in ("query_id", "position", "rank") if c in hits.columns]
    number = F.coalesce(F.nullif(F.col("authority_level"), F.lit(0)), F.lit(DEFAULT_AUTHORITY))
    return filled.select(
        *keep,
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.coalesce(F.col("source_file"), F.lit(missing_source)).alias("source_file"),
        F.col("page") if "page" in hits.columns else F.lit(None).cast("int").alias("page"),
        text.alias("snippet"),
        F.round(F.coalesce(F.col("score"), F.lit(0.0)), 4).alias("score"),
        F.lit(role).alias("evidence_role"),
        "source_version",
        "effective_from",
        "effective_to",
        number.alias("authority_level"),
        "authority_label",
        "applicability_scope",
        reason.alias("selection_reason"),
        "chapter",
        "section_path",
        "block_type",
        "bbox",
        "pdf_page_label",
        "textbook_references",
        "content_role",
        "parser_name",
        (
            F.coalesce(F.col("parse_quality"), F.lit(0.0))
            if "parse_quality" in hits.columns
            else F.lit(0.0)
        ).alias("parse_quality"),
    )


def distinct_citations(cites: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """First citation per (group, source, page, snippet)."""
    from citeloom.operators.joins import first_rows

    return first_rows(cites, keys, [F.asc(order) if isinstance(order, str) else order], 1)
