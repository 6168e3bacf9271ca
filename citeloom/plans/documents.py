"""Chunking, headings, windows, markup and layout plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import markup
from citeloom.operators import answers, blocks, chunking, expansion, lexical
from citeloom.operators.joins import first_rows, join_small, row_bound
from citeloom.plans.ranking import COSINE, INDEX_SQL, LEXICAL_SQL, SCORE_SQL, TOKENS, vector_queries
from citeloom.sources import tables as t

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

# Greedy packing: every line knows the last line that still fits with it, the
# recursion then only hops from chunk to chunk.
PACK_SQL = r"""
RECURSIVE raw AS (
  SELECT doc_id, text, """ + STRIP.format("text") + r""" AS body FROM documents),
sent AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, s, length(s) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(body, '[^\n]*\n|[^\n]+$')) AS s,
          generate_subscripts(regexp_extract_all(body, '[^\n]*\n|[^\n]+$'), 1) AS i
        FROM raw WHERE length(body) > 800)
  WHERE trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
run AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM sent),
hop AS (
  SELECT a.doc_id, a.i, CASE WHEN any_value(a.n) > 800 THEN a.i ELSE max(b.i) END AS j
  FROM run a JOIN run b ON b.doc_id = a.doc_id AND b.i >= a.i AND (b.i = a.i OR b.c - a.c + a.n <= 800)
  GROUP BY a.doc_id, a.i),
walk AS (
  SELECT doc_id, i, j FROM hop WHERE i = 1
  UNION ALL
  SELECT h.doc_id, h.i, h.j FROM walk w JOIN hop h ON h.doc_id = w.doc_id AND h.i = w.j + 1),
packed AS (
  SELECT w.doc_id, w.i, """ + STRIP.format("string_agg(s.s, '' ORDER BY s.i)") + r""" AS piece, max(s.n) AS n
  FROM walk w JOIN sent s ON s.doc_id = w.doc_id AND s.i BETWEEN w.i AND w.j GROUP BY w.doc_id, w.i),
long AS (
  SELECT p.doc_id, p.i, k.k, """ + STRIP.format("substr(s.s, k.k * 800 + 1, 800)") + r""" AS piece
  FROM packed p JOIN sent s ON s.doc_id = p.doc_id AND s.i = p.i
    CROSS JOIN LATERAL (SELECT unnest(range(0, (s.n + 799) // 800)) AS k) k WHERE p.n > 800),
parts AS (
  SELECT doc_id, 1 AS i, 0 AS k, body AS piece FROM raw WHERE length(body) <= 800 AND body <> ''
  UNION ALL SELECT doc_id, i, 0, piece FROM packed WHERE n <= 800
  UNION ALL SELECT doc_id, i, k, piece FROM long WHERE piece <> ''),
chunks AS (
  SELECT doc_id, row_number() OVER w - 1 AS chunk_index, piece, lag(piece) OVER w AS before
  FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY i, k))
"""


def _docs(spark, sf):
    return t.table(spark, sf, "documents")


def _anchors(spark, sf):
    """Every line as a ranked hit of the question asked about its document."""
    i = F.col("chunk_index")
    return t.line_chunks(spark, sf).withColumns(
        {"query_id": F.col("doc_id"), "score": 0.9 - (i % 7) * 0.01, "position": i + 1}
    )


def add(reg) -> None:
    @reg.add(
        "chunk_fixed_split",
        """SELECT doc_id, k AS piece_no, length(piece) AS chars, md5(piece) AS digest FROM (
          SELECT doc_id, unnest(range(0, (length(text) + 799) // 800)) AS k,
            substr(text, unnest(range(0, (length(text) + 799) // 800)) * 800 + 1, 800) AS piece FROM documents)""",
    )
    def chunk_fixed_split(spark, sf):
        d = _docs(spark, sf).filter("text <> ''")
        # One regular pass instead of a lambda that slices the text per piece.
        parts = d.select(
            "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,800}"), F.lit(0))).alias("k", "p")
        )
        return parts.select(
            "doc_id", F.col("k").cast("long").alias("piece_no"),
            F.length("p").cast("long").alias("chars"), F.md5("p").alias("digest"),
        )

    @reg.add(
        "chunk_line_packing",
        "WITH " + PACK_SQL + "SELECT doc_id, chunk_index, length(piece) AS chars, md5(piece) AS digest FROM chunks",
    )
    def chunk_line_packing(spark, sf):
        c = chunking.chunk_documents(
            _docs(spark, sf).select("doc_id", "text"), overlap=0, plain=True
        )
        return c.select(
            "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
            F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"),
        )

    @reg.add("chunk_formula_text")
    def chunk_formula_text(spark, sf):
        c = chunking.chunk_documents(_docs(spark, sf).select("doc_id", "text"))
        return c.select("doc_id", "chunk_index", F.length("text").alias("chars"))

    @reg.add(
        "chunk_overlap_lag",
        "WITH " + PACK_SQL + """
        SELECT doc_id, chunk_index, md5(CASE WHEN before IS NULL THEN piece
          ELSE right(before, 50) || chr(10) || chr(10) || piece END) AS digest FROM chunks""",
    )
    def chunk_overlap_lag(spark, sf):
        c = chunking.chunk_documents(_docs(spark, sf).select("doc_id", "text"), plain=True)
        return c.select(
            "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("digest")
        )

    @reg.add(
        "chunk_ordinals",
        "WITH " + t.LINES_SQL + """
        SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ordinal
        FROM lines WHERE length(text) > 40""",
    )
    def chunk_ordinals(spark, sf):
        from citeloom.operators.ordered import running_count

        kept = t.document_lines(spark, sf).filter(F.length("text") > 40).select("doc_id", "pos")
        out = running_count(kept, ["doc_id"], "pos", "n")
        return out.select(
            "doc_id", F.col("pos").cast("long").alias("pos"), (F.col("n") - 1).cast("long").alias("ordinal")
        )

    @reg.add(
        "header_asof_chunk",
        "WITH " + t.LINES_SQL + r""",
        h AS (SELECT doc_id, pos,
            nullif(trim(regexp_replace(regexp_extract(text, '(?i)(Chapter\s+\d+[^\n]{0,40})', 1), '\s+', ' ', 'g')), '') AS own,
            nullif(trim(regexp_replace(regexp_extract(text, '^(#{1,3})\s+(.+)$', 2), '\s+', ' ', 'g')), '') AS head
          FROM lines),
        g AS (SELECT *, CASE WHEN own IS NOT NULL THEN coalesce(head, own) END AS chap, coalesce(head, own) AS any_head FROM h)
        SELECT doc_id, pos, coalesce(own,
          last_value(chap IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING),
          last_value(any_head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS chapter
        FROM g""",
    )
    def header_asof_chunk(spark, sf):
        out = chunking.assign_chapters(t.document_lines(spark, sf), ["doc_id"])
        return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "chapter")

    @reg.add(
        "heading_context",
        "WITH " + t.LINES_SQL + r""",
        h AS (SELECT doc_id, pos, text, CASE WHEN regexp_matches(text, '^#{1,3}\s+.+$')
            THEN repeat('§', length(regexp_extract(text, '^(#{1,3})\s+(.+)$', 1))) || ' '
              || trim(regexp_replace(regexp_extract(text, '^(#{1,3})\s+(.+)$', 2), '\s+', ' ', 'g')) || chr(10) END AS own FROM lines)
        SELECT doc_id, pos, md5(coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
          ROWS UNBOUNDED PRECEDING), '') || text) AS digest FROM h""",
    )
    def heading_context(spark, sf):
        out = chunking.with_heading_context(t.document_lines(spark, sf), ["doc_id"])
        return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("text").alias("digest"))

    # --- windows around anchors -------------------------------------------------

    @reg.add(
        "list_window_range",
        "WITH " + t.LINES_SQL + """
        SELECT a.doc_id, a.chunk_index AS anchor_index, count(*) AS in_window,
          min(b.chunk_index) AS first_index, max(b.chunk_index) AS last_index
        FROM line_chunks a JOIN line_chunks b ON a.doc_id = b.doc_id
          AND b.chunk_index BETWEEN a.chunk_index - 2 AND a.chunk_index + 12 AND abs(a.page - b.page) <= 1
        WHERE b.block_type <> 'formula' GROUP BY 1, 2""",
    )
    def list_window_range(spark, sf):
        w = expansion.list_windows(t.line_chunks(spark, sf), _anchors(spark, sf))
        return w.groupBy("doc_id", F.col("anchor_index").cast("long").alias("anchor_index")).agg(
            F.count("*").alias("in_window"),
            F.min("chunk_index").cast("long").alias("first_index"),
            F.max("chunk_index").cast("long").alias("last_index"),
        )

    @reg.add(
        "formula_page_range",
        "WITH " + t.LINES_SQL + """
        SELECT b.doc_id, b.chunk_index, min(abs(a.page - b.page)) AS distance
        FROM line_chunks a JOIN line_chunks b ON a.doc_id = b.doc_id AND abs(a.page - b.page) <= 1
        WHERE a.block_type <> 'formula' AND b.block_type = 'formula' GROUP BY 1, 2""",
    )
    def formula_page_range(spark, sf):
        near = expansion.formula_neighbours(t.line_chunks(spark, sf), _anchors(spark, sf))
        return near.select(
            "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
            F.col("distance").cast("long").alias("distance"),
        )

    @reg.add(
        "formula_completion",
        "WITH " + t.LINES_SQL + f""",
        q AS (SELECT DISTINCT doc_id, {TOKENS.format("'the of and in die der le la ' || lang")} AS qt FROM documents),
        anchor AS (SELECT *, 0.9e0 - (chunk_index % 7) * 0.01e0 AS score FROM line_chunks
          WHERE block_type <> 'formula'),
        top AS (SELECT doc_id, max(score) AS s FROM anchor GROUP BY doc_id),
        near AS (SELECT b.doc_id, b.chunk_index, any_value(b.text) AS text, min(abs(a.page - b.page)) AS distance
          FROM anchor a JOIN line_chunks b ON a.doc_id = b.doc_id AND abs(a.page - b.page) <= 1
          WHERE b.block_type = 'formula' GROUP BY 1, 2)
        SELECT n.doc_id, n.chunk_index, round(greatest(0, s - 0.01e0 * (distance + 1)), 6) AS score,
          row_number() OVER (PARTITION BY n.doc_id ORDER BY
            len(list_intersect(qt, {TOKENS.format("n.text")})) DESC, distance, n.chunk_index) AS added
        FROM near n JOIN q USING (doc_id) JOIN top USING (doc_id) QUALIFY added <= 5""",
    )
    def formula_completion(spark, sf):
        q = _docs(spark, sf).select(
            F.col("doc_id").alias("query_id"),
            F.concat(F.lit("the of and in die der le la "), "lang").alias("query_text"),
        )
        anchors = _anchors(spark, sf).filter("block_type <> 'formula'")
        out = expansion.expand_formulas(t.line_chunks(spark, sf), anchors, q, 5)
        return out.select(
            "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
            F.round("score", 6).alias("score"), F.col("added").cast("long").alias("added"),
        )

    @reg.add("list_completion")
    def list_completion(spark, sf):
        q = _docs(spark, sf).select(
            F.col("doc_id").alias("query_id"), F.lit("包括哪些步骤，共九个步骤").alias("query_text")
        )
        # The hits of a question are the five longest lines of its document.
        anchors = first_rows(
            _anchors(spark, sf).filter("block_type <> 'formula'"),
            ["query_id"], [F.desc(F.length("text")), F.asc("chunk_index")], 5, rank="position",
        )
        return expansion.expand_lists(t.line_chunks(spark, sf), anchors, q, 5)

    cos = COSINE.format("ce.embedding", "qe.embedding")

    @reg.add(
        "visual_hits",
        "WITH " + t.CHUNKS_SQL + "," + t.QUERIES_SQL + f""",
        s AS (SELECT q.query_id, c.doc_id, c.block_type = 'image' AS plain, round({cos}, 9) AS score,
            row_number() OVER (PARTITION BY q.query_id, c.block_type ORDER BY {cos} DESC, c.doc_id) AS rank
          FROM queries q JOIN embeddings qe ON qe.vec_id = q.query_id JOIN chunks c ON c.course_id = q.course_id
            JOIN embeddings ce ON ce.vec_id = c.doc_id
          WHERE c.block_type IN ('image_summary', 'image') QUALIFY rank <= 3)
        SELECT query_id, doc_id, round(score, 6) AS score,
          row_number() OVER (PARTITION BY query_id ORDER BY score DESC, plain, rank) AS position
        FROM s QUALIFY position <= 3""",
    )
    def visual_hits(spark, sf):
        q = vector_queries(spark, sf).filter("query_vec IS NOT NULL")
        chunks = t.embedded_chunks(spark, sf).withColumns(
            {"image_caption": F.lit(""), "image_path": F.lit("")}
        )
        out = expansion.visual_hits(chunks, q, 3, row_bound(q))
        return out.select(
            "query_id", "doc_id", F.round("score", 6).alias("score"),
            F.col("position").cast("long").alias("position"),
        )

    # --- layout blocks ------------------------------------------------------------

    kinds = "(['image','text','text','image_caption','text','table','text'])"
    items_sql = "WITH " + t.LINES_SQL + f""",
        items AS (SELECT doc_id, pos, {kinds}[(pos + doc_id % 3) % 7 + 1] AS type, trim(line) AS text FROM raw_lines),
        seen AS (SELECT *, last_value(CASE WHEN type IN ('image', 'table') THEN pos END IGNORE NULLS)
              OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
            min(pos) FILTER (WHERE type IN ('image', 'table')) OVER (PARTITION BY doc_id) AS after FROM items),
        caps AS (SELECT doc_id, pos, CASE WHEN abs(coalesce(before, after) - pos) <= 3 THEN coalesce(before, after) END AS target_pos
          FROM seen WHERE type = 'image_caption' AND text <> '')"""

    def line_type(pos, doc_id):
        names = ["image", "text", "text", "image_caption", "text", "table", "text"]
        return F.get(F.array(*[F.lit(n) for n in names]), ((pos + doc_id % 3) % 7).cast("int"))

    def line_items(spark, sf):
        plain = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        return plain.withColumn("type", line_type(F.col("pos"), F.col("doc_id"))).withColumn(
            "text", F.trim("text")
        )

    @reg.add(
        "caption_nearest",
        items_sql + """ SELECT doc_id, pos, target_pos, target_pos IS NOT NULL AND
            pos = max(pos) OVER (PARTITION BY doc_id, target_pos) AS is_last FROM caps""",
    )
    def caption_nearest(spark, sf):
        out = blocks.mount_captions(line_items(spark, sf))
        return out.select(
            "doc_id", F.col("pos").cast("long").alias("pos"),
            F.col("target_pos").cast("long").alias("target_pos"), "is_last",
        )

    @reg.add(
        "page_texts",
        "WITH " + t.LINES_SQL + """
        SELECT doc_id, page, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS digest, count(*) AS blocks
        FROM line_chunks GROUP BY doc_id, page""",
    )
    def page_texts(spark, sf):
        c = t.line_chunks(spark, sf).withColumns(
            {"ord": F.col("chunk_index"), "pos": F.col("chunk_index"), "pdf_page_label": F.lit("")}
        )
        sizes = c.groupBy("doc_id", "page").agg(F.count("*").alias("blocks"))
        return blocks.pages_of(c).join(sizes, ["doc_id", "page"]).select(
            "doc_id", F.col("page").cast("long").alias("page"), F.md5("text").alias("digest"), "blocks"
        )

    @reg.add(
        "page_merge_longest",
        """SELECT conv_id, coalesce(a.i, b.i) AS i, CASE WHEN b.text IS NULL OR (a.text IS NOT NULL
            AND length(a.text) >= length(b.text)) THEN 'left' ELSE 'right' END AS side,
          length(CASE WHEN b.text IS NULL OR (a.text IS NOT NULL AND length(a.text) >= length(b.text)) THEN a.text ELSE b.text END) AS chars
        FROM (SELECT conv_id, turn // 2 AS i, text FROM conversations WHERE turn % 2 = 0) a
        FULL JOIN (SELECT conv_id, turn // 2 AS i, text FROM conversations WHERE turn % 2 = 1) b USING (conv_id, i)""".replace(
            "coalesce(a.i, b.i) AS i", "i"
        ),
    )
    def page_merge_longest(spark, sf):
        m = t.table(spark, sf, "conversations").withColumn("i", F.floor(F.col("turn") / 2))
        out = blocks.merge_pages(
            m.filter("turn % 2 = 0").select("conv_id", "i", "text"),
            m.filter("turn % 2 = 1").select("conv_id", "i", "text"),
            ["conv_id"], "i",
        )
        return out.select("conv_id", "i", "side", F.length("text").cast("long").alias("chars"))

    @reg.add(
        "quality_score",
        "WITH " + t.LINES_SQL + r""",
        p AS (SELECT doc_id, page, length(regexp_replace(string_agg(text, ''), '\s', '', 'g')) AS n FROM line_chunks GROUP BY 1, 2),
        a AS (SELECT doc_id, sum(n) AS chars, count(*) FILTER (WHERE n > 0) AS parsed, doc_id % 30 AS expected, doc_id % 2 = 0 AS b, count(*) AS total
          FROM p GROUP BY doc_id)
        SELECT doc_id, parsed AS parsed_pages, round(0.45e0 * least(chars / greatest(CASE WHEN expected > 0 THEN expected ELSE parsed END, 1) / 160e0, 1)
          + 0.40e0 * least(parsed / (CASE WHEN expected > 0 THEN expected ELSE greatest(total, 1) END), 1)
          + 0.15e0 * (CASE WHEN b THEN 1 ELSE 0.65e0 END), 4) AS score FROM a""",
    )
    def quality_score(spark, sf):
        pages = t.line_chunks(spark, sf).groupBy("doc_id", "page").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "").alias("text")
        )
        out = blocks.parse_quality(pages, F.col("doc_id") % 30, F.col("doc_id") % 2 == 0)
        return out.select("doc_id", "parsed_pages", "score")

    @reg.add(
        "page_kind",
        "WITH " + t.LINES_SQL + r""",
        p AS (SELECT doc_id, pos AS i, line, max(pos) OVER (PARTITION BY doc_id) + 1 AS n FROM raw_lines),
        s AS (SELECT doc_id, sum(length(regexp_replace(line, '\s', '', 'g'))) AS total, avg(length(regexp_replace(line, '\s', '', 'g'))) AS mean
          FROM p WHERE i IN (0, 1, n // 2, n - 1) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN total < 30 OR mean < 30 THEN 'scanned' WHEN mean < 200 THEN 'mixed' ELSE 'text' END AS kind FROM s""",
    )
    def page_kind(spark, sf):
        lines = _docs(spark, sf).select("doc_id", F.split("text", "\n").alias("ls"))
        rows = lines.select("doc_id", F.size("ls").alias("n_pages"), F.posexplode("ls").alias("index", "text"))
        return blocks.page_kind(rows)

    @reg.add(
        "tag_text",
        r"""SELECT page_id, length(body) AS chars, md5(body) AS digest FROM (
          SELECT page_id, array_to_string(list_filter(list_transform(str_split(
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<t[dh][^>]*>', ' | ', 'gi'),
              '</tr>', chr(10), 'gi'), '</t[dh]>', '', 'gi'), '<[^>]+>', ' ', 'g'), '&nbsp;?', ' ', 'gi'), chr(10)),
            lambda ln: """ + STRIP.format(r"regexp_replace(ln, '\s*[|]\s*$', '')") + r"""), lambda ln: ln <> ''), chr(10)) AS body FROM pages)""",
    )
    def tag_text(spark, sf):
        p = t.table(spark, sf, "pages")
        out = p.select("page_id", markup.html_to_text("html").alias("body"))
        return out.select("page_id", F.length("body").cast("long").alias("chars"), F.md5("body").alias("digest"))

    @reg.add(
        "tag_elements",
        r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1),
            lambda v: trim(regexp_replace(regexp_replace(v, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda v: v <> ''), ' | ') AS items,
          array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1),
            lambda v: trim(regexp_replace(regexp_replace(v, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda v: v <> ''), ' | ') AS titles
        FROM pages""",
    )
    def tag_elements(spark, sf):
        p = t.table(spark, sf, "pages")
        return p.select(
            "page_id",
            F.array_join(markup.tag_texts("html", "li"), " | ").alias("items"),
            F.array_join(markup.tag_texts("html", "h1"), " | ").alias("titles"),
        )

    @reg.add("block_roles")
    def block_roles(spark, sf):
        k = F.col("pos") % 5
        marked = (
            F.when(k == 0, F.concat(F.lit("注意："), "text")).when(k == 1, F.lit("12:30"))
            .when(k == 2, F.concat(F.lit("P28 Ex2 "), "text")).otherwise(F.col("text"))
        )
        rows = line_items(spark, sf).withColumn("text", marked).withColumn(
            "block_type", F.when(F.col("pos") % 11 == 0, "header").otherwise(F.col("type"))
        )
        return blocks.annotate(rows).groupBy("content_role").agg(
            F.count("*").alias("blocks"), F.sum(F.size("textbook_references")).alias("references")
        )

    @reg.add("structured_chunks")
    def structured_chunks(spark, sf):
        # Texts are dealt by document once, for the payloads; what follows stays there.
        return blocks.structured_chunks(layout_blocks(spark, sf)).select(
            "doc_id", "chunk_index", "page", "block_type", "section_path", "chapter",
            F.length("text").alias("chars"),
        )

    def layout_blocks(spark, sf):
        def item(line, pos):
            kind = F.when(pos % 9 == 0, "title").when(pos % 9 == 5, "equation").otherwise(line_type(pos, F.col("doc_id")))
            return F.struct(
                pos.alias("pos"), kind.alias("type"), F.trim(line).alias("text"),
                F.floor(pos / 6).cast("string").alias("page_idx"),
                (F.floor(pos / 9) % 3 + 1).cast("string").alias("level"),
            )

        texts = _docs(spark, sf).groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
        lines = F.transform("texts", lambda text: F.transform(F.split(text, "\n"), item))
        docs = texts.select("doc_id", F.sort_array(F.flatten(lines)).alias("content_list"))
        payload = docs.select("doc_id", F.to_json(F.struct("content_list")).alias("payload"))
        return blocks.to_blocks(blocks.content_items(payload))

    @reg.add(
        "prompt_context",
        "WITH " + INDEX_SQL + "," + t.QUERIES_SQL + SCORE_SQL + LEXICAL_SQL.format(k=5) + r""",
        b AS (SELECT l.query_id, l.rank, '【证据编号=' || l.rank || ' · ' || regexp_replace(c.source_file, '\.md|\.pdf|\.txt', '', 'g')
            || ' · ' || CASE WHEN length(trim(split_part(c.text, chr(10), 1))) > 40
                 THEN substr(trim(split_part(c.text, chr(10), 1)), 1, 37) || '...' ELSE trim(split_part(c.text, chr(10), 1)) END
            || ' · ' || CASE c.block_type WHEN 'formula' THEN '公式证据' WHEN 'image' THEN '图表证据' WHEN 'image_summary' THEN '图表证据' ELSE '正文证据' END
            || '】' || chr(10) || '证据属性：权威=' || (CASE WHEN authority_label = '' THEN '未识别' ELSE authority_label END)
            || '(L' || authority_level || ')' || (CASE WHEN source_version <> '' THEN '；版本=' || source_version ELSE '' END) || chr(10) || c.text AS block
          FROM lexical l JOIN chunks c USING (course_id, doc_id, chunk_index))
        SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS digest, count(*) AS evidence FROM b GROUP BY query_id""",
    )
    def prompt_context(spark, sf):
        chunks, q = t.document_chunks(spark, sf), t.benchmark_queries(spark, sf)
        n = row_bound(q)
        top = lexical.bm25_topk(chunks, q, 5).withColumnRenamed("rank", "position")
        hits = join_small(chunks, top, ["course_id", "doc_id", "chunk_index"], rows=n and n * 5)
        return answers.format_context(hits).select("query_id", F.md5("context").alias("digest"), "evidence")

    @reg.add(
        "answer_finalise",
        """SELECT conv_id, turn, c <> 2 AS grounded, CASE c WHEN 0 THEN '1,3' WHEN 1 THEN '1,2,3' WHEN 2 THEN '' ELSE '1,2,3' END AS cited,
          CASE c WHEN 0 THEN 'model_selected' ELSE 'retrieval_candidate' END AS evidence_role, length(CASE WHEN c = 2 THEN '资料库中未找到相关内容' ELSE rtrim(text, ' ' || chr(10)) END) AS chars
        FROM (SELECT *, (conv_id + turn) % 4 AS c FROM conversations)""",
    )
    def answer_finalise(spark, sf):
        m = t.table(spark, sf, "conversations")
        c = (F.col("conv_id") + F.col("turn")) % 4
        raw = (
            F.when(c == 0, F.concat("text", F.lit("\n<SOURCES>1, 3,1</SOURCES>")))
            .when(c == 1, F.concat("text", F.lit("\n<SOURCES>1,9</SOURCES>")))
            .when(c == 2, F.concat(F.lit("> **<NO_EVIDENCE>** "), "text"))
            .otherwise(F.col("text"))
        )
        key = F.col("conv_id") * 1000 + F.col("turn")
        ready = m.select(key.alias("query_id"), raw.alias("raw"), F.lit(3).alias("evidence"))
        out = answers.finalize_answers(ready)
        return out.select(
            F.floor(F.col("query_id") / 1000).alias("conv_id"), (F.col("query_id") % 1000).alias("turn"), "grounded",
            F.array_join(F.transform("cited", lambda i: i.cast("string")), ",").alias("cited"), "evidence_role",
            F.length("answer").cast("long").alias("chars"),
        )
