"""Hybrid retrieval: lexical and vector branches, fusion, selection, completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import queries as q
from citeloom.functions.text import is_blank, strip
from citeloom.operators import expansion, selection
from citeloom.operators.fusion import HIT_KEY, renumber, rrf_fuse
from citeloom.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, join_small, row_width
from citeloom.operators.lexical import bm25_topk
from citeloom.operators.rerank import Scorer, rerank
from citeloom.operators.vector import vector_topk
from citeloom.session import settle

TOP_K = 5
CONCEPT_TOP_K = 12
CHAPTER_MAX_CHUNKS = 24
RERANK_CANDIDATES = 20

#: Chunk attributes carried to the answer side.
META = [
    "text", "page", "chapter", "block_type", "section_path", "source_file",
    "authority_level", "authority_label", "effective_from", "effective_to",
    "applicability_scope", "source_version",
]


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Drop blank questions and add the normalised text and query classes."""
    text = strip("query_text")
    out = queries.filter(~is_blank("query_text")).withColumn("question", text)
    out = out.withColumn("query_text", q.search_query("question"))
    return out.withColumns(
        {
            "topic": q.definition_topic("query_text"),
            "is_formula": q.is_formula_query("question"),
            "is_list": q.is_list_query("question"),
        }
    )


def active(chunks: DataFrame) -> DataFrame:
    return chunks.filter("is_active") if "is_active" in chunks.columns else chunks


def fetch(chunks: DataFrame, hits: DataFrame, rows: int | None, meta: list[str] | None = None) -> DataFrame:
    """Attributes of the few ranked hits; ranking itself never carries text."""
    cols = [c for c in (meta or META) if c in chunks.columns]
    return join_small(chunks.select(*HIT_KEY, *cols), hits, HIT_KEY, rows=rows)


def candidates(
    chunks: DataFrame, queries: DataFrame, pool: int, fuse_k: int, rows: int | None
) -> DataFrame:
    """Fused hit keys of both branches for prepared queries."""
    scope = [c for c in ("scenario", "as_of") if c in queries.columns]
    lists = []
    if "embedding" in chunks.columns and "query_vec" in queries.columns:
        # A query the embedding model cannot encode has no vector.
        vec = queries.filter(F.col("query_vec").isNotNull()).select(
            "query_id", "course_id", "query_vec", *scope
        )
        lists.append(vector_topk(chunks, vec, pool, rows))
    lists.append(bm25_topk(chunks, queries, pool))
    return rrf_fuse(lists, fuse_k)


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int = TOP_K,
    *,
    score_threshold: float = selection.SCORE_THRESHOLD,
    scorer: Scorer | None = None,
    rerank_candidates: int = RERANK_CANDIDATES,
    top_n: int = 0,
    expand: bool = True,
) -> DataFrame:
    """Cited evidence for a set of questions, one job for all of them.

    ``chunks``: hit key, text, evidence attributes, optionally ``embedding``.
    ``queries``: query_id, course_id, query_text, optionally query_vec,
    scenario, as_of.  Result: hit key, attributes, score, reason and the 1-based
    ``position``; list and formula completion may exceed ``top_k`` rows.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    for name in ("course_id", "query_id", "query_text"):
        if name not in queries.columns:
            raise ValueError(f"queries need {name}")
    chunks = active(chunks)
    prepared = prepare_queries(queries)
    # One look at the questions: how many, and whether any asks for completion.
    seen = prepared.agg(
        F.count("*").alias("n"),
        F.sum(row_width(prepared)).alias("bytes"),
        F.coalesce(F.bool_or("is_list"), F.lit(False)).alias("lists"),
        F.coalesce(F.bool_or("is_formula"), F.lit(False)).alias("formulas"),
    ).first()
    n = seen["n"] if seen["n"] <= BROADCAST_ROWS and (seen["bytes"] or 0) <= BROADCAST_BYTES else None
    pool = max(rerank_candidates, top_k) if scorer else top_k * 2
    fuse_k = pool if scorer else pool * 2
    fused = candidates(chunks, prepared, pool, fuse_k, n)
    fused = fused if scorer else selection.above_threshold(fused, score_threshold)
    scope = [c for c in ("scenario", "as_of") if c in queries.columns]
    scoped = F.lit(False)
    for c in scope:
        scoped = scoped | (F.coalesce(F.col(c), F.lit("")) != "")
    flags = prepared.select(
        "query_id", "question", "topic", "is_formula", "is_list", scoped.alias("is_scoped")
    )
    hits = join_small(
        fetch(chunks, fused, n and n * fuse_k), flags, "query_id", rows=n
    )
    if scorer:
        ranked = rerank(hits.withColumn("query_text", F.col("question")), top_n or top_k, scorer)
        kept = selection.above_threshold(ranked, score_threshold)
    else:
        kept = selection.select_evidence(hits, F.col("is_scoped")) if scope else hits
        kept = selection.definition_first(kept)
        kept = selection.first_k(selection.distinct_passages(kept), top_k)
    kept = kept.withColumn("reason", F.lit("").cast("string"))
    asked = seen["lists"], seen["formulas"]
    if expand and any(asked) and {"block_type", "page"} <= set(chunks.columns):
        kept = _complete(chunks, kept, prepared, flags, top_k, n, *asked)
    if scope:
        kept = selection.select_evidence(kept, F.col("is_scoped"))
    return kept.drop("question", "topic", "is_formula", "is_list", "is_scoped", "rrf", "query_text")


def _complete(chunks, kept, prepared, flags, top_k, n, lists, formulas) -> DataFrame:
    """List and formula completion for the queries that ask for them."""
    formula = F.coalesce(F.col("block_type"), F.lit("")) == "formula"
    kept = renumber(
        kept.filter(~(F.col("is_list") & ~F.col("is_formula") & formula)), [F.asc("position")]
    )
    kept = settle(kept)
    asked = prepared.withColumn("query_text", F.col("question")).drop("question")
    rows = n and n * top_k
    limit = max(3, min(top_k, 8))
    cols = kept.columns

    def as_hits(found: DataFrame, reason) -> DataFrame:
        full = fetch(chunks, found, n and n * (top_k + 12))
        full = full.withColumn("reason", reason).withColumnRenamed("added", "position")
        return join_small(full, flags, "query_id", rows=n).select(
            *[c if c in full.columns or c in flags.columns else F.lit(None).alias(c) for c in cols]
        )

    if lists:
        found = expansion.expand_lists(
            chunks, kept.filter("is_list"), asked.filter("is_list"), top_k, rows
        )
        kept = expansion.append_missing(kept, as_hits(found, F.lit("list_completion")))
        kept = settle(kept) if formulas else kept
    if not formulas:
        return kept
    asking = kept.filter("is_formula")
    found = expansion.expand_formulas(
        chunks, asking, asked.filter("is_formula"), top_k, n and n * (top_k + 12)
    )
    extra = as_hits(found, F.col("reason"))
    # Body first, then completed formulas, then the formulas already ranked.
    both = asking.withColumn("side", F.when(formula, 2).otherwise(0)).unionByName(
        extra.withColumn("side", F.lit(1))
    )
    both = renumber(both, [F.asc(F.col("side") > 0), F.asc("side"), F.asc("position")])
    body = F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).over(_per_query())
    both = both.withColumn("body", body).filter(
        (F.col("side") == 0) | (F.col("position") - F.col("body") <= limit)
    )
    return kept.filter("NOT is_formula").unionByName(both.drop("side", "body"))


def _per_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id")


def chapter_chunks(
    chunks: DataFrame, requests: DataFrame, cap: int = CHAPTER_MAX_CHUNKS
) -> DataFrame:
    """Chunks of the asked chapter in reading order, score one.

    ``requests``: query_id, course_id, chapter, optionally scenario, as_of.
    """
    from citeloom.operators.joins import first_rows
    from citeloom.operators.rollups import match_chapters

    matched = match_chapters(active(chunks), requests)
    return first_rows(
        matched,
        ["query_id"],
        [F.asc("source_file"), F.asc("chunk_index"), F.asc("doc_id")],
        cap,
        rank="position",
    ).withColumn("score", F.lit(1.0))
