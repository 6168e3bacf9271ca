"""Stored indexes: dictionary words, block postings, vector cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import cells, latent, postings, segmentation, vector
from citeloom.operators.joins import row_bound, unnest
from citeloom.plans.ranking import COSINE, INDEX_SQL, LEXICAL_SQL, SCORE_SQL
from citeloom.sources import tables as t

#: Nearest cells that the approximate search scores.
PROBES = 16

SEGMENT_SQL = r"""
WITH RECURSIVE words AS (
  SELECT word, count(*) AS freq
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang = 'en')
  WHERE length(word) <= 6 GROUP BY word),
total AS (SELECT sum(freq)::BIGINT AS total FROM words),
weights AS (
  SELECT word, CAST(round((ln(freq) - ln(total)) * 1000000000) AS BIGINT) AS weight FROM words, total),
runs AS (
  SELECT DISTINCT run FROM (
    SELECT unnest(regexp_extract_all(lower(regexp_extract(url, '://([^/?#]*)', 1)), '[a-z]+')) AS run FROM pages)),
places AS (SELECT run, unnest(range(1, length(run) + 1)) AS spot FROM runs),
pieces AS (
  SELECT run, spot, size, substr(run, spot, size) AS piece
  FROM (SELECT run, spot, unnest(range(1, 7)) AS size FROM places) WHERE spot + size <= length(run) + 1),
edges AS (
  SELECT run, spot, size, weight FROM pieces JOIN weights ON piece = word
  UNION ALL
  SELECT run, spot, size, CAST(round((ln(1) - ln(total)) * 1000000000) AS BIGINT)
  FROM pieces, total WHERE size = 1 AND piece NOT IN (SELECT word FROM words)),
paths AS (
  SELECT run, 1::BIGINT AS spot, 0::BIGINT AS weight, []::BIGINT[] AS sizes, '' AS words FROM runs
  UNION ALL
  SELECT p.run, p.spot + e.size, p.weight + e.weight, list_append(p.sizes, e.size),
    ltrim(p.words || ' ' || substr(p.run, p.spot, e.size))
  FROM paths p JOIN edges e ON e.run = p.run AND e.spot = p.spot),
best AS (
  SELECT * FROM paths WHERE spot = length(run) + 1
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY weight DESC, sizes DESC) = 1)
SELECT run, weight, words FROM best
"""

CELLS_SQL = f"""
WITH q AS (SELECT label, min(vec_id) AS query_id, arg_min(embedding, vec_id) AS query_vec FROM embeddings GROUP BY label)
SELECT query_id, CAST(e.label AS VARCHAR) AS course_id, vec_id AS doc_id,
  round(round({COSINE.format('embedding', 'query_vec')}, 9), 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY {COSINE.format('embedding', 'query_vec')} DESC, vec_id) AS rank
FROM embeddings e JOIN q ON q.label = e.label QUALIFY rank <= 10
"""


def add(reg) -> None:
    @reg.add("dictionary_segments", SEGMENT_SQL)
    def dictionary_segments(spark, sf):
        """Words inside the names of page hosts, by a dictionary of the English documents."""
        docs = t.table(spark, sf, "documents").filter("lang = 'en'")
        found = unnest(docs, F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), "word")
        words = found.filter(F.length("word") <= 6).groupBy("word").agg(F.count("*").alias("freq"))
        held = segmentation.broadcast(spark, segmentation.trie(words))
        host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
        names = unnest(t.table(spark, sf, "pages"), F.regexp_extract_all(host, F.lit("[a-z]+"), F.lit(0)), "run").distinct()
        return names.select(
            "run",
            segmentation.path_weight(F.col("run"), held).alias("weight"),
            F.array_join(segmentation.segments(F.array("run"), held), " ").alias("words"),
        )

    @reg.add(
        "bm25_topk_indexed",
        "WITH " + INDEX_SQL + "," + t.QUERIES_SQL + SCORE_SQL + LEXICAL_SQL.format(k=10) + """
        SELECT query_id, course_id, doc_id, rank, round(score, 6) AS score FROM lexical""",
    )
    def bm25_topk_indexed(spark, sf):
        """The hits of ``bm25_topk``, from stored postings."""
        index = postings.build(t.document_chunks(spark, sf))
        out = postings.topk(index, t.benchmark_queries(spark, sf), 10)
        return out.select(
            "query_id", "course_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score")
        )

    @reg.add("vector_topk_cells", CELLS_SQL)
    def vector_topk_cells(spark, sf):
        """The hits of ``vector_topk_by_tenant``, from cells whose bound reaches them."""
        out = cells.topk(cells.build(t.vector_chunks(spark, sf)), t.course_vectors(spark, sf), 10)
        return out.select(
            "query_id", "course_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
        )

    @reg.add("vector_cells_recall")
    def vector_cells_recall(spark, sf):
        """Hits of the nearest cells alone against the exact search, for every vector
        whose id is divisible by 20."""
        stored = t.vector_chunks(spark, sf)
        asked = stored.filter(F.col("doc_id") % 20 == 0).select(
            F.col("doc_id").alias("query_id"), "course_id", F.col("embedding").alias("query_vec")
        )
        found = cells.topk(cells.build(stored), asked, 10, probes=PROBES)
        return cells.recall(found, vector.vector_topk(stored, asked, 10, row_bound(asked)))

    @reg.add("latent_search")
    def latent_search(spark, sf):
        """Documents nearest to each benchmark question by vectors trained on the documents."""
        chunks, asked = t.document_chunks(spark, sf), t.benchmark_queries(spark, sf)
        model = latent.fit(chunks)
        stored = latent.with_embedding(chunks, model)
        # A question without a known term skips the vector branch.
        asked = latent.with_embedding(asked, model, "query_text", "query_vec").filter(latent.encodable("query_vec"))
        out = vector.vector_topk(stored, asked, 10, row_bound(asked))
        return out.select("query_id", "course_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))
