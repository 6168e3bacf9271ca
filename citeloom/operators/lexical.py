"""BM25 over course-scoped chunks.

The ranking is built as an inverted-index join.  Two properties of the model
shape the plan:

* tokens of a chunk are distinct, so a query token adds ``idf * g`` where ``g``
  depends only on the chunk length; a score is one sum of idf values times one
  factor;
* scores are divided by the best score of the whole course *before* any scope
  filter, so that maximum must be taken over rows the filter removes.

Idf values are summed as fixed-point integers: the sum is then independent of
the order in which shuffled rows arrive, and equal documents tie exactly.
"""

from __future__ import annotations

from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import tokenize
from citeloom.operators import segmentation
from citeloom.operators.evidence import is_applicable
from citeloom.operators.joins import first_rows, join_small, row_bound, unnest
from citeloom.session import materialize

K1 = 1.5
B = 0.75
#: Fixed-point scale of an idf value.
IDF_UNIT = 10_000_000_000

#: Marker token that carries the per-course totals through the same aggregate.
_TOTAL = ""


def with_tokens(chunks: DataFrame, dictionary: Broadcast | None = None) -> DataFrame:
    """Chunks with their token columns: the index a deployment writes per ingest.

    Everything below uses ``tokens`` and ``dl`` where a table brings them and
    computes them from the text otherwise.  With a dictionary (``segmentation``) the
    tokens of ideographs are its words instead of characters.
    """
    tokens = segmentation.tokenize("text", dictionary) if dictionary else tokenize("text")
    return chunks.withColumn("tokens", tokens).withColumn("dl", F.size("tokens"))


def with_query_tokens(queries: DataFrame, dictionary: Broadcast) -> DataFrame:
    """Questions with the tokens that go with ``with_tokens(chunks, dictionary)``."""
    return queries.withColumn("query_tokens", segmentation.tokenize("query_text", dictionary))


def tokenized(chunks: DataFrame, *keep: str) -> DataFrame:
    """Chunk keys, distinct tokens and their number."""
    keys = ["course_id", "doc_id", "chunk_index", *keep]
    if {"tokens", "dl"} <= set(chunks.columns):
        return chunks.select(*keys, "tokens", "dl")
    return chunks.select(*keys, tokenize("text").alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(chunks: DataFrame) -> DataFrame:
    """Inverted index rows; the table a deployment writes once per ingest."""
    return unnest(
        tokenized(chunks), "tokens", "token", "course_id", "doc_id", "chunk_index", "dl"
    )


def course_stats(chunks: DataFrame) -> DataFrame:
    """Number of chunks and mean distinct-token count per course."""
    return (
        tokenized(chunks)
        .groupBy("course_id")
        .agg(F.count("*").alias("n"), F.sum("dl").alias("total_dl"))
        .withColumn("avgdl", F.col("total_dl") / F.col("n"))
    )


def idf_value(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_statistics(chunks: DataFrame) -> DataFrame:
    """Document frequency and idf of every token of every course."""
    df = postings(chunks).groupBy("course_id", "token").agg(F.count("*").alias("df"))
    stats = course_stats(chunks).select("course_id", "n")
    return df.join(stats, "course_id").withColumn("idf", idf_value(F.col("n"), F.col("df")))


def query_tokens(queries: DataFrame) -> DataFrame:
    tokens = F.col("query_tokens") if "query_tokens" in queries.columns else tokenize("query_text")
    return unnest(queries, tokens, "token", "query_id", "course_id")


def course_hits(chunks: DataFrame, tokens: DataFrame, rows: int | None, *keep: str) -> DataFrame:
    """Chunks of the asked courses with those of their tokens that a question has.

    Courses nobody asks about drop out before any text is tokenised, and tokens
    nobody asks for before they become rows.  The result is narrow and read twice,
    so it is written once.  Without a bound on the questions all tokens stay.
    """
    courses = tokens.select("course_id").distinct()
    if rows is None:
        asked = tokenized(join_small(chunks, courses, ["course_id"], "left_semi"), *keep)
        return asked.withColumnRenamed("tokens", "hits")
    vocabulary = tokens.groupBy("course_id").agg(F.collect_set("token").alias("vocabulary"))
    asked = tokenized(join_small(chunks, vocabulary, ["course_id"], rows=rows), "vocabulary", *keep)
    hits = F.array_intersect("tokens", "vocabulary").alias("hits")
    return materialize(
        asked.select("course_id", "doc_id", "chunk_index", *keep, "dl", hits), "bm25-hits"
    )


def _query_weights(hits: DataFrame, tokens: DataFrame, rows: int | None) -> DataFrame:
    """(query, token) -> fixed-point idf and course mean length.

    One pass over the hits yields document frequencies of the query vocabulary
    and, under the marker token, the course totals.
    """
    vocab = tokens.select("course_id", "token").union(
        tokens.select("course_id", F.lit(_TOTAL).alias("token"))
    ).distinct()
    marks = unnest(hits, F.concat("hits", F.array(F.lit(_TOTAL))), "token", "course_id", "dl")
    counted = (
        join_small(marks, vocab, ["course_id", "token"], "left_semi", rows=rows and 2 * rows)
        .groupBy("course_id", "token")
        .agg(F.count("*").alias("df"), F.sum("dl").alias("total_dl"))
    )
    # The window sees vocabulary rows of queries, never corpus rows.
    course = Window.partitionBy("course_id")
    total = F.col("token") == _TOTAL
    idf = (
        counted.withColumn("n", F.max(F.when(total, F.col("df"))).over(course))
        .withColumn("avgdl", F.max(F.when(total, F.col("total_dl"))).over(course) / F.col("n"))
        .filter(~total)
        .select(
            "course_id",
            "token",
            "avgdl",
            F.round(idf_value(F.col("n"), F.col("df")) * IDF_UNIT).cast("long").alias("idf_units"),
        )
    )
    return tokens.join(idf, ["course_id", "token"])


def bm25_scores(chunks: DataFrame, queries: DataFrame, rows: int | None = None) -> DataFrame:
    """Raw BM25 score of every chunk that shares a token with a query.

    ``queries``: query_id, course_id, query_text and optionally scenario, as_of.
    Output: query_id, course_id, doc_id, chunk_index, raw, in_scope.
    """
    tokens = query_tokens(queries)
    if rows is None:
        rows = row_bound(tokens)
    scope = [c for c in ("scenario", "as_of") if c in queries.columns]
    meta = ("applicability_scope", "effective_from", "effective_to") if scope else ()
    hits = course_hits(chunks, tokens, rows, *meta)
    weights = _query_weights(hits, tokens, rows)
    if scope:
        weights = weights.join(queries.select("query_id", *scope), "query_id")
    terms = unnest(hits, "hits", "token", "course_id", "doc_id", "chunk_index", "dl", *meta)
    matched = join_small(terms, weights, ["course_id", "token"], rows=rows)
    in_scope = (
        is_applicable(
            F.col("scenario") if "scenario" in scope else F.lit(None).cast("string"),
            F.col("as_of") if "as_of" in scope else F.lit(None).cast("string"),
        )
        if scope
        else F.lit(True)
    )
    # Only fixed-width buffers, so this stays a hash aggregate; the tokens of a
    # chunk come from one input row, so the partial step already merges them.
    return (
        matched.select(
            "query_id", "course_id", "doc_id", "chunk_index", "dl", "avgdl", "idf_units",
            in_scope.alias("in_scope"),
        )
        .groupBy("query_id", "course_id", "doc_id", "chunk_index")
        .agg(
            F.sum("idf_units").alias("units"),
            F.max("dl").alias("dl"),
            F.max("avgdl").alias("avgdl"),
            F.bool_and("in_scope").alias("in_scope"),
        )
        .select(
            "query_id",
            "course_id",
            "doc_id",
            "chunk_index",
            (
                F.col("units")
                * (K1 + 1)
                / (1 + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
                / IDF_UNIT
            ).alias("raw"),
            "in_scope",
        )
    )


def bm25_topk(
    chunks: DataFrame, queries: DataFrame, k: int, rows: int | None = None
) -> DataFrame:
    """Best ``k`` in-scope chunks per query, normalised by the course maximum.

    Ranking in-scope and out-of-scope rows apart keeps at most ``2k`` rows per
    query, and the larger of the two first rows is the maximum over the whole
    course: no second pass and no window over all matches.
    """
    scored = bm25_scores(chunks, queries, rows).filter(F.col("raw") > 0)
    kept = first_rows(
        scored,
        ["query_id", "in_scope"],
        [F.desc("raw"), F.asc("doc_id"), F.asc("chunk_index")],
        k,
        rank="rank",
    )
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return (
        kept.withColumn("score", F.col("raw") / best)
        .filter("in_scope")
        .select("query_id", "course_id", "doc_id", "chunk_index", "raw", "score", "rank")
    )
