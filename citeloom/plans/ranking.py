"""Lexical, vector and fused ranking over the whole document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions.text import tokenize
from citeloom.operators import fusion, lexical, selection, vector
from citeloom.operators.evidence import evidence_filter, is_applicable
from citeloom.operators.joins import first_rows, join_small, row_bound
from citeloom.operators.rerank import overlap_logit, rerank
from citeloom.operators.retrieval import retrieve
from citeloom.sources import tables as t

TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9ıſ]+'))"

# Shared SQL: token lists, course statistics and scored matches.
INDEX_SQL = t.CHUNKS_SQL + f""",
docs AS (
  SELECT *, len(tokens) AS dl FROM (
    SELECT course_id, doc_id, chunk_index, applicability_scope, effective_from, effective_to,
      {TOKENS.format('text')} AS tokens FROM chunks)),
stats AS (
  SELECT course_id, count(*) AS n, sum(dl) / count(*) AS avgdl FROM docs GROUP BY course_id),
post AS (
  SELECT course_id, doc_id, chunk_index, dl, applicability_scope, effective_from, effective_to,
    unnest(tokens) AS token FROM docs),
freq AS (SELECT course_id, token, count(*) AS df FROM post GROUP BY course_id, token)
"""
SCORE_SQL = f""",
qt AS (
  SELECT query_id, course_id, unnest({TOKENS.format('query_text')}) AS token FROM queries),
scored AS (
  SELECT query_id, course_id, doc_id, chunk_index, applicability_scope, effective_from,
    effective_to,
    sum(CAST(round(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * 10000000000) AS BIGINT)) * 2.5e0
      / (1 + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)) / 10000000000 AS raw
  FROM qt JOIN post USING (course_id, token) JOIN freq USING (course_id, token)
    JOIN stats USING (course_id)
  GROUP BY ALL_KEYS)
""".replace(
    "ALL_KEYS",
    "query_id, course_id, doc_id, chunk_index, applicability_scope, effective_from, "
    "effective_to, dl, avgdl",
)
COSINE = (
    "greatest(0, list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])))"
)
LEXICAL_SQL = """,
lexical AS (
  SELECT query_id, course_id, doc_id, chunk_index, raw / max_raw AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id, chunk_index) AS rank
  FROM (SELECT *, max(raw) OVER (PARTITION BY query_id) AS max_raw FROM scored WHERE raw > 0) s
  QUALIFY rank <= {k})
"""
SEMANTIC_SQL = """,
semantic AS (
  SELECT q.query_id, c.course_id, c.doc_id, c.chunk_index, round({cos}, 9) AS score,
    row_number() OVER (PARTITION BY q.query_id
      ORDER BY {cos} DESC, c.doc_id, c.chunk_index) AS rank
  FROM queries q
    JOIN embeddings qe ON qe.vec_id = q.query_id
    JOIN chunks c ON c.course_id = q.course_id
    JOIN embeddings ce ON ce.vec_id = c.doc_id
  QUALIFY rank <= {k})
"""
FUSED_SQL = """,
merged AS (
  SELECT *, 0 AS list_no FROM semantic UNION ALL SELECT *, 1 AS list_no FROM lexical),
fused AS (
  SELECT query_id, course_id, doc_id, chunk_index, max(score) AS score,
    coalesce(max(1e0 / (60 + rank)) FILTER (WHERE list_no = 0), 0e0)
      + coalesce(max(1e0 / (60 + rank)) FILTER (WHERE list_no = 1), 0e0) AS rrf,
    min(list_no * 1000 + rank) AS first_seen
  FROM merged GROUP BY query_id, course_id, doc_id, chunk_index),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first_seen) AS position
  FROM fused QUALIFY position <= {fuse})
"""


def _hybrid_sql(queries: str, k: int) -> str:
    cos = COSINE.format("ce.embedding", "qe.embedding")
    return (
        "WITH " + INDEX_SQL + "," + queries + SCORE_SQL
        + LEXICAL_SQL.format(k=2 * k)
        + SEMANTIC_SQL.format(cos=cos, k=2 * k)
        + FUSED_SQL.format(fuse=4 * k)
    )


def vector_queries(spark, sf):
    """Benchmark questions with the stored vector of the same key."""
    e = t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
    )
    q = t.benchmark_queries(spark, sf)
    return q.join(e, "query_id", "left")


def add(reg) -> None:
    @reg.add(
        "tokenize_distinct",
        f"""SELECT doc_id, len(toks) AS n_tokens, list_aggregate(list_sort(toks), 'string_agg', ' ')
            AS tokens FROM (SELECT doc_id, {TOKENS.format('text')} AS toks FROM documents)""",
    )
    def tokenize_distinct(spark, sf):
        d = t.table(spark, sf, "documents")
        d = d.select("doc_id", tokenize("text").alias("toks"))
        return d.select(
            "doc_id",
            F.size("toks").cast("long").alias("n_tokens"),
            F.nullif(F.array_join(F.sort_array("toks"), " "), F.lit("")).alias("tokens"),
        )

    @reg.add(
        "bm25_course_stats",
        "WITH " + INDEX_SQL + """
        SELECT course_id, n, CAST(sum(dl) AS BIGINT) AS total_dl, round(max(avgdl), 6) AS avgdl
        FROM docs JOIN stats USING (course_id) GROUP BY course_id, n""",
    )
    def bm25_course_stats(spark, sf):
        return lexical.course_stats(t.document_chunks(spark, sf)).select(
            "course_id", "n", "total_dl", F.round("avgdl", 6).alias("avgdl")
        )

    @reg.add(
        "bm25_idf",
        "WITH " + INDEX_SQL + """
        SELECT course_id, token, df, round(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)), 6) AS idf
        FROM freq JOIN stats USING (course_id)""",
    )
    def bm25_idf(spark, sf):
        return lexical.term_statistics(t.document_chunks(spark, sf)).select(
            "course_id", "token", "df", F.round("idf", 6).alias("idf")
        )

    @reg.add(
        "bm25_topk",
        "WITH " + INDEX_SQL + "," + t.QUERIES_SQL + SCORE_SQL + LEXICAL_SQL.format(k=10) + """
        SELECT query_id, course_id, doc_id, rank, round(score, 6) AS score FROM lexical""",
    )
    def bm25_topk(spark, sf):
        out = lexical.bm25_topk(t.document_chunks(spark, sf), t.benchmark_queries(spark, sf), 10)
        return out.select(
            "query_id", "course_id", "doc_id", F.col("rank").cast("long").alias("rank"),
            F.round("score", 6).alias("score"),
        )

    @reg.add(
        "bm25_scoped_topk",
        "WITH " + INDEX_SQL + "," + t.SCOPED_SQL + SCORE_SQL + """
        SELECT query_id, doc_id, round(raw / max_raw, 6) AS score,
          row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank
        FROM (SELECT *, max(raw) OVER (PARTITION BY query_id) AS max_raw FROM scored) s
          JOIN queries USING (query_id)
        WHERE (scenario IN ('', 'all') OR applicability_scope IN ('all', scenario))
          AND (as_of = '' OR as_of BETWEEN effective_from AND effective_to)
        QUALIFY rank <= 10""",
    )
    def bm25_scoped_topk(spark, sf):
        out = lexical.bm25_topk(t.document_chunks(spark, sf), t.scoped_queries(spark, sf), 10)
        return out.select(
            "query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
            F.round("score", 6).alias("score"),
        )

    @reg.add(
        "vector_topk_cosine",
        f"""SELECT e.vec_id AS doc_id,
              round({COSINE.format('e.embedding', 'q.embedding')}, 6) AS score,
              row_number() OVER (ORDER BY {COSINE.format('e.embedding', 'q.embedding')} DESC,
                e.vec_id) AS rank
            FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q
            QUALIFY rank <= 20""",
    )
    def vector_topk_cosine(spark, sf):
        e = t.table(spark, sf, "embeddings")
        # The single query vector is found once and becomes a literal.
        vec = e.agg(F.min_by("embedding", "vec_id")).first()[0] or []
        q = F.array(*[F.lit(float(x)) for x in vec])
        scored = e.select(
            F.lit(0).alias("query_id"), F.col("vec_id").alias("doc_id"),
            vector.cosine_score(F.col("embedding"), q).alias("score"),
        )
        top = first_rows(
            scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], 20, rank="rank"
        )
        return top.select(
            "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
        )

    by_tenant = f"""
        WITH q AS (SELECT label, min(vec_id) AS query_id, arg_min(embedding, vec_id) AS query_vec
                   FROM embeddings GROUP BY label)
        SELECT query_id, CAST(e.label AS VARCHAR) AS course_id, vec_id AS doc_id,
          round(round({COSINE.format('embedding', 'query_vec')}, 9), 6) AS score,
          row_number() OVER (PARTITION BY query_id
            ORDER BY {COSINE.format('embedding', 'query_vec')} DESC, vec_id) AS rank
        FROM embeddings e JOIN q ON q.label = e.label {{where}} QUALIFY rank <= 10"""

    @reg.add("vector_topk_by_tenant", by_tenant.format(where=""))
    def vector_topk_by_tenant(spark, sf):
        q = t.course_vectors(spark, sf)
        return _vector_out(vector.vector_topk(t.vector_chunks(spark, sf), q, 10, row_bound(q)))

    @reg.add(
        "vector_filtered_validity",
        by_tenant.format(
            where="WHERE vec_id % 3 IN (0, 1) AND "
            "'2021-06-01' BETWEEN (2018 + vec_id % 6) || '-01-01' "
            "AND (2020 + vec_id % 6) || '-12-31'"
        ),
    )
    def vector_filtered_validity(spark, sf):
        q = t.course_vectors(spark, sf).withColumns(
            {"scenario": F.lit("exam"), "as_of": F.lit("2021-06-01")}
        )
        return _vector_out(vector.vector_topk(t.vector_chunks(spark, sf), q, 10, row_bound(q)))

    def _vector_out(df):
        return df.select(
            "query_id", "course_id", "doc_id", F.round("score", 6).alias("score"),
            F.col("rank").cast("long").alias("rank"),
        )

    @reg.add(
        "rrf_fuse",
        _hybrid_sql(t.QUERIES_SQL, 5) + """
        SELECT query_id, doc_id, round(score, 6) AS score, round(rrf, 9) AS rrf, position
        FROM ordered""",
    )
    def rrf_fuse(spark, sf):
        from citeloom.operators.retrieval import candidates

        q = vector_queries(spark, sf)
        out = candidates(t.embedded_chunks(spark, sf), q, 10, 20, row_bound(q))
        return out.select(
            "query_id", "doc_id", F.round("score", 6).alias("score"),
            F.round("rrf", 9).alias("rrf"), F.col("position").cast("long").alias("position"),
        )

    @reg.add(
        "hybrid_threshold",
        _hybrid_sql(t.QUERIES_SQL, 5) + """
        SELECT query_id, count(*) AS kept, round(min(score), 6) AS lowest, round(max(score), 6)
          AS highest FROM ordered WHERE score >= 0.5 GROUP BY query_id""",
    )
    def hybrid_threshold(spark, sf):
        from citeloom.operators.retrieval import candidates

        q = vector_queries(spark, sf)
        fused = candidates(t.embedded_chunks(spark, sf), q, 10, 20, row_bound(q))
        return selection.above_threshold(fused, 0.5).groupBy("query_id").agg(
            F.count("*").alias("kept"),
            F.round(F.min("score"), 6).alias("lowest"),
            F.round(F.max("score"), 6).alias("highest"),
        )

    final = """,
    kept AS (
      SELECT o.*, c.text, c.source_file, c.authority_level,
        regexp_replace(trim(regexp_replace(c.text, '\\s+', ' ', 'g')), '^$', CAST(o.doc_id AS VARCHAR))
          AS passage
      FROM ordered o JOIN chunks c USING (course_id, doc_id, chunk_index) WHERE score >= 0.25),
    firsts AS (
      SELECT * FROM kept
      QUALIFY row_number() OVER (PARTITION BY query_id, passage ORDER BY position) = 1)
    """
    hybrid = _hybrid_sql(t.QUERIES_SQL, 5) + final

    @reg.add(
        "hybrid_retrieve",
        hybrid + """
        SELECT query_id, course_id, doc_id, source_file, authority_level, round(score, 6) AS score,
          row_number() OVER (PARTITION BY query_id ORDER BY position) AS position
        FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 5""",
    )
    def hybrid_retrieve(spark, sf):
        hits = retrieve(
            t.embedded_chunks(spark, sf), vector_queries(spark, sf), 5, expand=False
        )
        return hits.select(
            "query_id", "course_id", "doc_id", "source_file", "authority_level",
            F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"),
        )

    @reg.add(
        "hybrid_refusal",
        _hybrid_sql(t.QUERIES_SQL, 5) + """
        SELECT q.query_id, count(o.doc_id) AS kept, count(o.doc_id) = 0 AS refused
        FROM queries q LEFT JOIN ordered o ON o.query_id = q.query_id AND o.score >= 0.25
        GROUP BY q.query_id""",
    )
    def hybrid_refusal(spark, sf):
        from citeloom.operators.retrieval import candidates

        q = vector_queries(spark, sf)
        fused = candidates(t.embedded_chunks(spark, sf), q, 10, 20, row_bound(q))
        return selection.refusals(q, selection.above_threshold(fused))

    @reg.add(
        "hybrid_scoped_retrieve",
        _hybrid_sql(t.SCOPED_SQL, 5)
        .replace("FROM scored WHERE raw > 0) s", "FROM scored WHERE raw > 0) s\n  JOIN queries USING (query_id, course_id)\n  WHERE " + t_scope("applicability_scope", "effective_from", "effective_to"))
        .replace("JOIN embeddings ce ON ce.vec_id = c.doc_id", "JOIN embeddings ce ON ce.vec_id = c.doc_id\n  WHERE " + t_scope("c.applicability_scope", "c.effective_from", "c.effective_to"))
        + final + """,
        chosen AS (
          SELECT f.*, q.scenario, q.as_of, c.effective_from, q.scenario <> '' OR q.as_of <> '' AS scoped
          FROM kept f JOIN queries q ON q.query_id = f.query_id JOIN chunks c ON c.doc_id = f.doc_id),
        resorted AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
            CASE WHEN scoped THEN authority_level END DESC NULLS LAST,
            CASE WHEN scoped THEN effective_from END DESC NULLS LAST,
            CASE WHEN scoped THEN score END DESC NULLS LAST, position) AS place FROM chosen)
        SELECT query_id, doc_id, round(score, 6) AS score,
          row_number() OVER (PARTITION BY query_id ORDER BY place) AS position
        FROM (SELECT * FROM resorted
              QUALIFY row_number() OVER (PARTITION BY query_id, passage ORDER BY place) = 1)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 5""",
    )
    def hybrid_scoped_retrieve(spark, sf):
        e = t.table(spark, sf, "embeddings").select(
            F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
        )
        q = t.scoped_queries(spark, sf).join(e, "query_id", "left")
        hits = retrieve(t.embedded_chunks(spark, sf), q, 5, expand=False)
        return hits.select(
            "query_id", "doc_id", F.round("score", 6).alias("score"),
            F.col("position").cast("long").alias("position"),
        )

    @reg.add(
        "embed_and_search",
        "WITH " + t.CHUNKS_SQL + "," + t.QUERIES_SQL
        + SEMANTIC_SQL.format(cos=COSINE.format("ce.embedding", "qe.embedding"), k=5)
        + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM semantic",
    )
    def embed_and_search(spark, sf):
        # The stored vectors stand for the embedding model, on both sides.
        chunks = t.embedded_chunks(spark, sf).filter("embedding IS NOT NULL")
        q = vector_queries(spark, sf).filter("query_vec IS NOT NULL")
        return vector.vector_topk(chunks, q, 5, row_bound(q)).select(
            "query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
        )

    @reg.add(
        "rerank_overlap",
        "WITH " + INDEX_SQL + "," + t.QUERIES_SQL + SCORE_SQL + LEXICAL_SQL.format(k=20) + f""",
        logit AS (
          SELECT l.*, len(list_intersect({TOKENS.format('q.query_text')}, {TOKENS.format('c.text')}))
            / greatest(len({TOKENS.format('q.query_text')}), 1) * 8e0 - 4e0 AS z
          FROM lexical l JOIN queries q USING (query_id)
            JOIN chunks c ON c.doc_id = l.doc_id)
        SELECT query_id, doc_id, round(1 / (1 + exp(-z)), 6) AS score,
          row_number() OVER (PARTITION BY query_id ORDER BY 1 / (1 + exp(-z)) DESC, rank) AS position
        FROM logit QUALIFY position <= 5""",
    )
    def rerank_overlap(spark, sf):
        chunks, q = t.document_chunks(spark, sf), t.benchmark_queries(spark, sf)
        n = row_bound(q)
        pool = lexical.bm25_topk(chunks, q, 20)
        texts = chunks.select("course_id", "doc_id", "chunk_index", "text")
        hits = join_small(texts, pool, fusion.HIT_KEY, rows=n and n * 20).withColumnRenamed(
            "rank", "position"
        )
        hits = join_small(hits, q.select("query_id", "query_text"), "query_id", rows=n)
        out = rerank(hits, 5, overlap_logit)
        return out.select(
            "query_id", "doc_id", F.round("score", 6).alias("score"),
            F.col("position").cast("long").alias("position"),
        )

    @reg.add(
        "retrieve_rerank",
        "WITH " + INDEX_SQL + "," + t.QUERIES_SQL + SCORE_SQL + LEXICAL_SQL.format(k=20)
        + SEMANTIC_SQL.format(cos=COSINE.format("ce.embedding", "qe.embedding"), k=20)
        + FUSED_SQL.format(fuse=20) + f""",
        logit AS (
          SELECT o.query_id, o.doc_id, o.position AS before,
            1 / (1 + exp(-(len(list_intersect({TOKENS.format('q.query_text')}, {TOKENS.format('c.text')}))
              / greatest(len({TOKENS.format('q.query_text')}), 1) * 8e0 - 4e0))) AS s
          FROM ordered o JOIN queries q USING (query_id) JOIN chunks c ON c.doc_id = o.doc_id),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, before) AS position FROM logit
          QUALIFY position <= 5)
        SELECT query_id, doc_id, round(s, 6) AS score, position FROM ranked WHERE s >= 0.25""",
    )
    def retrieve_rerank(spark, sf):
        hits = retrieve(
            t.embedded_chunks(spark, sf), vector_queries(spark, sf), 5, scorer=overlap_logit, expand=False
        )
        return hits.select(
            "query_id", "doc_id", F.round("score", 6).alias("score"),
            F.col("position").cast("long").alias("position"),
        )

    @reg.add(
        "validity_as_of",
        "WITH " + t.CHUNKS_SQL + """
        SELECT course_id, applicability_scope, count(*) AS chunks, min(effective_from) AS first_from
        FROM chunks WHERE applicability_scope IN ('lab', 'all')
          AND '2021-06-01' BETWEEN effective_from AND effective_to
        GROUP BY course_id, applicability_scope""",
    )
    def validity_as_of(spark, sf):
        rows = t.document_chunks(spark, sf).filter(
            is_applicable(F.lit("lab"), F.lit("2021-06-01"))
        )
        return rows.groupBy("course_id", "applicability_scope").agg(
            F.count("*").alias("chunks"), F.min("effective_from").alias("first_from")
        )

    @reg.add(
        "scope_or_all",
        "WITH " + t.CHUNKS_SQL + "," + t.SCOPED_SQL + """
        SELECT query_id, count(*) AS usable, min(doc_id) AS first_doc, max(authority_level) AS top_level
        FROM queries JOIN chunks USING (course_id)
        WHERE scenario IN ('', 'all') OR applicability_scope IN ('all', scenario)
        GROUP BY query_id""",
    )
    def scope_or_all(spark, sf):
        q = t.scoped_queries(spark, sf).select("query_id", "course_id", "scenario")
        c = (
            t.document_chunks(spark, sf)
            .groupBy("course_id", "applicability_scope")
            .agg(
                F.count("*").alias("n"), F.min("doc_id").alias("d"),
                F.max("authority_level").alias("a"),
            )
        )
        # Counted per scope first, so a question meets a few rows per course.
        pairs = q.join(c, "course_id").filter(
            is_applicable(
                F.col("scenario"), F.lit(None).cast("string"),
                start=F.lit(None).cast("string"), end=F.lit(None).cast("string"),
            )
        )
        return pairs.groupBy("query_id").agg(
            F.sum("n").alias("usable"), F.min("d").alias("first_doc"), F.max("a").alias("top_level")
        )

    @reg.add(
        "course_evidence_scan",
        "WITH " + t.CHUNKS_SQL + """
        SELECT doc_id, chunk_index, page, chapter FROM chunks
        WHERE course_id = 'src3' AND applicability_scope IN ('exam', 'all')
          AND effective_from <= '2022-01-01' AND effective_to >= '2022-01-01'""",
    )
    def course_evidence_scan(spark, sf):
        rows = evidence_filter(
            t.document_chunks(spark, sf), "src3", scenario="exam", as_of="2022-01-01"
        )
        return rows.select("doc_id", "chunk_index", "page", "chapter")



def t_scope(scope: str, start: str, end: str) -> str:
    return (
        f"(scenario IN ('', 'all') OR {scope} IN ('all', scenario))"
        f" AND (as_of = '' OR as_of BETWEEN {start} AND {end})"
    )
