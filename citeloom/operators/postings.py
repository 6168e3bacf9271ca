"""Stored inverted index: BM25 without reading a text.

``build`` writes postings once per ingest.  A row is a block: the chunks of one course
that hold one token and whose documents lie in one range of ``span`` ids, as offsets
from the range's start (which Parquet packs into few bits), with the shortest length
among them.  Rows lie in ``parts`` partitions by course and token, sorted by token, so
a question opens only the partitions and row groups of its tokens.

``topk`` first reads block heads only.  The score of a chunk in a range is at most the
sum, over the question's tokens with a block there, of idf times the length factor of
the block's shortest chunk.  The ranges with the best bounds are scored, which gives a
score the k-th hit has at least; ranges whose bound is lower are never opened.  The
result equals ``lexical.bm25_topk``.

Blocks of a common token are spread over its ranges, so no key gathers in one group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.operators.joins import first_rows, join_small, row_bound, unnest
from citeloom.operators.lexical import B, IDF_UNIT, K1, idf_value, query_tokens, tokenized
from citeloom.session import materialize, release, shared_path

#: Document ids of a range, and partitions of the stored postings.
SPAN, PARTS = 256, 16
#: Tasks that the ranges are dealt to at least, and postings of a task.
TASKS, TASK_POSTINGS = 8, 1 << 19
#: Ranges of each question that are scored first.
SEEDS = 4
#: Bounds and scores are sums of rounded numbers.
SLACK = 1e-9


@dataclass
class Index:
    """``blocks``: part, course_id, token, block, n, min_dl, docs, chunks, dls;
    ``terms``: course_id, token, df; ``courses``: course_id, n, total_dl."""

    blocks: DataFrame
    terms: DataFrame
    courses: DataFrame
    span: int
    parts: int


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("course_id", "token"), F.lit(parts)).cast("int")


def build(
    chunks: DataFrame, path: str | None = None, span: int = SPAN, parts: int = PARTS, task_postings: int = TASK_POSTINGS
) -> Index:
    """Write the index of ``chunks`` below ``path``, by default in the shared folder.

    Chunks whose course or document id is null are found by no question and left out.
    A chunk travels as one row to the task of its range of ids and becomes postings there.
    """
    spark = chunks.sparkSession
    path = path or shared_path(spark, "postings")
    keyed = chunks.filter(F.col("course_id").isNotNull() & F.col("doc_id").isNotNull())
    held = materialize(tokenized(keyed), "postings-tokens")
    held.groupBy("course_id").agg(F.count("*").alias("n"), F.sum("dl").alias("total_dl")).write.parquet(f"{path}/courses")
    total = spark.read.schema("total_dl long").parquet(f"{path}/courses").agg(F.sum("total_dl")).first()[0] or 0
    # Ranges are dealt, not tokens, so the blocks of a common token go to all tasks.
    block = F.floor(F.col("doc_id") / span).cast("long")
    ranges = held.withColumn("block", block).repartition(max(TASKS, -(-total // task_postings)), "block")
    posts = unnest(ranges, "tokens", "token", "course_id", "block", "doc_id", "chunk_index", "dl")
    rows = posts.groupBy("course_id", "token", "block").agg(
        F.count("*").alias("n"),
        F.min("dl").alias("min_dl"),
        F.array_sort(F.collect_list(F.struct("doc_id", "chunk_index", "dl"))).alias("rows"),
    )
    dealt = rows.select(
        "course_id", "token", "block", "n", "min_dl",
        F.transform("rows", lambda r: (r["doc_id"] - F.col("block") * span).cast("int")).alias("docs"),
        F.transform("rows", lambda r: r["chunk_index"]).alias("chunks"),
        F.transform("rows", lambda r: r["dl"]).alias("dls"),
        _part(parts).alias("part"),
    ).sortWithinPartitions("part", "course_id", "token", "block")
    dealt.write.partitionBy("part").parquet(f"{path}/blocks")
    release(held)
    opened = spark.read.schema(dealt.schema).parquet(f"{path}/blocks")
    opened.groupBy("course_id", "token").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")
    types = {c: chunks.schema[c].dataType.simpleString() for c in ("course_id", "chunk_index")}
    return load(spark, path, span, parts, **types)


def load(
    spark: SparkSession, path: str, span: int = SPAN, parts: int = PARTS, course_id: str = "string", chunk_index: str = "int"
) -> Index:
    """An index written before, with the span and parts it was written with, and the
    types of its keys (an index of no chunks has no file to tell them)."""
    blocks, terms, courses = (
        spark.read.schema(f"course_id {course_id}, {columns}").parquet(f"{path}/{name}")
        for name, columns in (
            ("blocks", f"token string, block long, n long, min_dl int, docs array<int>, chunks array<{chunk_index}>, dls array<int>, part int"),
            ("terms", "token string, df long"),
            ("courses", "n long, total_dl long"),
        )
    )
    return Index(blocks, terms, courses, span, parts)


def _factor(dl: Column) -> Column:
    return (K1 + 1) / (1 + K1 * (1 - B + B * dl / F.col("avgdl"))) / IDF_UNIT


def _weights(index: Index, tokens: DataFrame, rows: int | None) -> DataFrame:
    """Fixed-point idf and mean length of each question's tokens that occur."""
    asked = tokens.select("course_id", "token").distinct()
    df = join_small(index.terms, asked, ["course_id", "token"], rows=rows)
    courses = join_small(index.courses, asked.select("course_id").distinct(), ["course_id"], rows=rows)
    idf = join_small(df, courses, ["course_id"], rows=rows).select(
        "course_id", "token", (F.col("total_dl") / F.col("n")).alias("avgdl"),
        F.round(idf_value(F.col("n"), F.col("df")) * IDF_UNIT).cast("long").alias("units"),
    )
    return tokens.join(idf, ["course_id", "token"]).withColumn("part", _part(index.parts))


def _scores(blocks: DataFrame, weights: DataFrame, ranges: DataFrame, span: int, rows: int | None) -> DataFrame:
    """Raw scores of all chunks of the given ranges of each question."""
    opened = join_small(blocks, weights, ["part", "course_id", "token"], rows=rows)
    opened = opened.join(ranges, ["query_id", "course_id", "block"], "left_semi")
    posted = opened.select(
        "query_id", "course_id", "block", "units", "avgdl", F.explode(F.arrays_zip("docs", "chunks", "dls")).alias("p")
    )
    summed = posted.groupBy(
        "query_id", "course_id", (F.col("block") * span + F.col("p.docs")).alias("doc_id"), F.col("p.chunks").alias("chunk_index")
    ).agg(F.sum("units").alias("units"), F.max("p.dls").alias("dl"), F.max("avgdl").alias("avgdl"))
    raw = F.col("units") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) / IDF_UNIT
    return summed.select("query_id", "course_id", "doc_id", "chunk_index", raw.alias("raw")).filter("raw > 0")


def ranked_ranges(index: Index, blocks: DataFrame, weights: DataFrame, rows: int | None) -> DataFrame:
    """``query_id, course_id, block, bound`` from block heads; no posting is read."""
    heads = blocks.select("part", "course_id", "token", "block", "min_dl")
    met = join_small(heads, weights, ["part", "course_id", "token"], rows=rows)
    bound = F.sum(F.col("units") * _factor(F.col("min_dl")))
    return met.groupBy("query_id", "course_id", "block").agg(bound.alias("bound"))


def _order() -> list[Column]:
    return [F.desc("raw"), F.asc("doc_id"), F.asc("chunk_index")]


def open_ranges(index: Index, queries: DataFrame, k: int, seeds: int = SEEDS):
    """Ranges that can hold one of the best ``k``, all ranges, blocks, weights and the
    bound of the weights' rows."""
    tokens = query_tokens(queries).select("query_id", "course_id", "token").distinct()
    rows = row_bound(tokens)
    weights = materialize(_weights(index, tokens, rows), "postings-weights")
    # At most as many numbers as there are partitions.
    parts = [r[0] for r in weights.select("part").distinct().collect()]
    blocks = index.blocks.filter(F.col("part").isin(parts))
    ranges = materialize(ranked_ranges(index, blocks, weights, rows), "postings-ranges")
    first = first_rows(ranges, ["query_id"], [F.desc("bound"), F.asc("block")], seeds)
    seen = _scores(blocks, weights, first, index.span, rows)
    least = first_rows(seen, ["query_id"], _order(), k, rank="rank").filter(F.col("rank") == k)
    least = least.select("query_id", F.col("raw").alias("least"))
    enough = F.col("bound") >= F.coalesce("least", F.lit(0.0)) * (1 - SLACK)
    kept = ranges.join(least, "query_id", "left").filter(enough).select("query_id", "course_id", "block")
    return kept, ranges, blocks, weights, rows


def topk(index: Index, queries: DataFrame, k: int, seeds: int = SEEDS) -> DataFrame:
    """Best ``k`` chunks per question; columns as of ``lexical.bm25_topk``."""
    kept, _, blocks, weights, rows = open_ranges(index, queries, k, seeds)
    scored = _scores(blocks, weights, kept, index.span, rows)
    top = first_rows(scored, ["query_id"], _order(), k, rank="rank")
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return top.withColumn("score", F.col("raw") / best).select(
        "query_id", "course_id", "doc_id", "chunk_index", "raw", "score", "rank"
    )
