"""Retrieval tools as DataFrame functions, dispatched by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.evidence import citations
from citeloom.operators.joins import join_small, row_bound
from citeloom.operators.retrieval import retrieve
from citeloom.operators.selection import SCORE_THRESHOLD, above_threshold
from citeloom.operators.store import read_chunks
from citeloom.operators.vector import vector_topk


def search(chunks: DataFrame, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """Hybrid retrieval without a threshold, then the default threshold."""
    return above_threshold(retrieve(chunks, queries, top_k, score_threshold=0.0), SCORE_THRESHOLD)


def quote_source(chunks: DataFrame, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """Citations of a search, snippets with their line breaks."""
    return citations(search(chunks, queries, top_k), single_line=False, missing_source="")


def read_page(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Text of requested pages, chunks in order joined by blank lines.

    ``pages``: request_id, course_id, doc_id, page.  ``found`` is false for a
    page without chunks.
    """
    asked = pages.select("request_id", "course_id", "doc_id", "page")
    hits = join_small(chunks, asked, ["course_id", "doc_id", "page"], rows=row_bound(asked))
    text = hits.groupBy("request_id").agg(
        F.array_join(
            F.transform(
                F.filter(
                    F.sort_array(F.collect_list(F.struct("chunk_index", "text"))),
                    lambda r: F.coalesce(r["text"], F.lit("")) != "",
                ),
                lambda r: r["text"],
            ),
            "\n\n",
        ).alias("text")
    )
    return asked.join(text, "request_id", "left").select(
        *asked.columns,
        F.col("text").isNotNull().alias("found"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def scan_tables(chunks: DataFrame, course_id: str, **filters) -> DataFrame:
    """Table chunks of a course under optional document, file and page filters."""
    rows = read_chunks(chunks, course_id, block_type="table", **filters)
    return rows.filter(F.coalesce(F.col("text"), F.lit("")) != "")


def search_tables(chunks: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """Table chunks nearest to the query vectors, above the threshold."""
    n = row_bound(queries)
    found = above_threshold(vector_topk(chunks, queries, top_k, n, block_type="table"))
    keep = ["course_id", "doc_id", "chunk_index", "text", "page", "chapter", "section_path"]
    side = chunks.filter(F.col("block_type") == "table").select(*keep)
    return join_small(side, found, keep[:3], rows=n and n * top_k)


#: Tools a caller may name; the course is never taken from the caller's arguments.
TOOLS = {
    "search_pdf": search,
    "quote_source": quote_source,
    "read_page": read_page,
    "extract_table": search_tables,
}


def run_tool(name: str, chunks: DataFrame, requests: DataFrame, course_id: str, **args) -> DataFrame:
    """Run a whitelisted tool for one course."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name}")
    if not course_id:
        raise ValueError("course_id is required")
    bound = requests.drop("course_id").withColumn("course_id", F.lit(course_id))
    return TOOLS[name](chunks, bound, **args)
