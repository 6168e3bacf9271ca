"""Evidence order, citations, chapters and metadata over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions.evidence import evidence_metadata, iso_date
from citeloom.functions.queries import defines_topic
from citeloom.functions.text import (
    document_type,
    logical_name,
    normalize_scope,
    passage_key,
    section_label,
)
from citeloom.operators import evidence as ev
from citeloom.operators import rollups
from citeloom.operators.joins import first_rows
from citeloom.operators.retrieval import chapter_chunks
from citeloom.sources import tables as t

REASON = """
  (CASE WHEN scenario <> '' THEN '适用场景=' || applicability_scope || '；' ELSE '' END)
  || (CASE WHEN as_of <> '' THEN '生效期=' || effective_from || '~' || effective_to || '；' ELSE '' END)
  || '权威=' || (CASE WHEN authority_label = '' THEN '{label}' ELSE authority_label END)
  || '(L' || authority_level || ')'
  || (CASE WHEN source_version <> '' THEN '；版本=' || source_version ELSE '' END)
"""


def add(reg) -> None:
    @reg.add(
        "evidence_select_authority",
        "WITH " + t.CHUNKS_SQL + """
        SELECT course_id, doc_id, row_number() OVER (PARTITION BY course_id
          ORDER BY authority_level DESC, effective_from DESC, length(text) DESC, doc_id) AS position
        FROM chunks QUALIFY position <= 15""",
    )
    def evidence_select_authority(spark, sf):
        c = t.document_chunks(spark, sf).withColumn("score", F.length("text").cast("double"))
        top = first_rows(
            c, ["course_id"], [*ev.authority_order(), F.asc("doc_id")], 15, rank="position"
        )
        return top.select("course_id", "doc_id", F.col("position").cast("long").alias("position"))

    @reg.add(
        "definition_first",
        r"""WITH d AS (
          SELECT source AS query_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' **哈哈哈**是 ' || lang
            WHEN doc_id % 3 = 1 THEN '哈哈 ' || text ELSE text END AS text FROM documents),
        x AS (SELECT query_id, doc_id, regexp_matches(regexp_replace(text, '[*`]+', '', 'g'),
            '哈哈\s*(是|指|定义为|定义[:：])') AS defines FROM d)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY defines DESC, doc_id) AS position
        FROM x QUALIFY position <= 5""",
    )
    def definition_first(spark, sf):
        d = t.table(spark, sf, "documents")
        k = F.col("doc_id") % 3
        text = (
            F.when(k == 0, F.concat("text", F.lit(" **哈哈哈**是 "), "lang"))
            .when(k == 1, F.concat(F.lit("哈哈 "), "text"))
            .otherwise(F.col("text"))
        )
        # Whole sources are ranked here, so the cut is a group limit.
        hits = d.select(
            F.col("source").alias("query_id"), "doc_id", defines_topic(text, F.lit("哈哈")).alias("defines")
        )
        top = first_rows(
            hits, ["query_id"], [F.desc("defines"), F.asc("doc_id")], 5, rank="position"
        )
        return top.select("query_id", "doc_id", F.col("position").cast("long").alias("position"))

    @reg.add(
        "distinct_passages",
        """SELECT source, min(doc_id) AS doc_id, count(*) AS copies
        FROM (SELECT source, doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS p FROM documents)
        GROUP BY source, CASE WHEN p = '' THEN CAST(doc_id AS VARCHAR) ELSE p END""",
    )
    def distinct_passages(spark, sf):
        d = t.table(spark, sf, "documents")
        # Grouping by a digest keeps the shuffle free of the texts.
        key = F.sha2(passage_key("text", F.col("doc_id")), 256)
        return (
            d.groupBy("source", key.alias("passage"))
            .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
            .drop("passage")
        )

    @reg.add(
        "citation_projection",
        "WITH " + t.CHUNKS_SQL + """
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, source_file, page,
          replace(substr(text, 1, 200), chr(10), ' ') AS snippet,
          round((doc_id % 10007) / 30000e0, 4) AS score, authority_level,
          CASE WHEN authority_label = '' THEN '教学材料' ELSE authority_label END AS authority_label,
          """ + REASON.replace("{label}", "教学材料").replace("scenario", "'exam'").replace("as_of", "'2021-06-01'") + """
          AS selection_reason
        FROM chunks""",
    )
    def citation_projection(spark, sf):
        c = t.document_chunks(spark, sf).withColumn("score", (F.col("doc_id") % 10007) / 30000.0)
        out = ev.citations(c, scenario=F.lit("exam"), as_of=F.lit("2021-06-01"))
        return out.select(
            "doc_id", "source_file", "page", "snippet", "score", "authority_level",
            "authority_label", "selection_reason",
        )

    @reg.add(
        "evidence_reason",
        "WITH " + t.CHUNKS_SQL + "," + t.SCOPED_SQL + ", s AS (SELECT course_id, scenario, as_of FROM queries"
        " QUALIFY row_number() OVER (PARTITION BY course_id ORDER BY query_id) = 1)"
        " SELECT doc_id, " + REASON.replace("{label}", "未识别") + " AS reason FROM chunks JOIN s USING (course_id)",
    )
    def evidence_reason(spark, sf):
        q = t.scoped_queries(spark, sf)
        first = first_rows(q, ["course_id"], [F.asc("query_id")], 1).select(
            "course_id", "scenario", "as_of"
        )
        c = t.document_chunks(spark, sf).join(first, "course_id")
        return c.select(
            "doc_id", ev.evidence_reason(F.col("scenario"), F.col("as_of")).alias("reason")
        )

    @reg.add(
        "metadata_defaults",
        "WITH " + t.CHUNKS_SQL + """
        SELECT doc_id, CASE WHEN authority_label = '' THEN '教学材料' ELSE authority_label END
          AS authority_label, source_version, 'content' AS content_role, 'auto' AS metadata_source
        FROM chunks""",
    )
    def metadata_defaults(spark, sf):
        return ev.with_text_defaults(t.document_chunks(spark, sf)).select(
            "doc_id", "authority_label", "source_version", "content_role", "metadata_source"
        )

    @reg.add(
        "date_sort_key",
        """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 10101 ELSE
          CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) END AS INTEGER) AS sort_key FROM orders""",
    )
    def date_sort_key(spark, sf):
        o = t.table(spark, sf, "orders")
        iso = F.date_format("o_orderdate", "yyyy-MM-dd")
        text = F.when(F.col("o_orderkey") % 5 == 0, F.substring(iso, 1, 7)).otherwise(iso)
        return o.select("o_orderkey", ev.date_sort_key(text, ev.OPEN_FROM_SORT).alias("sort_key"))

    @reg.add(
        "scope_normalise",
        """SELECT p_partkey, CASE WHEN s = '' THEN 'all' ELSE s END AS scope FROM (
          SELECT p_partkey, trim(regexp_replace(lower(trim(
            CASE p_partkey % 4 WHEN 0 THEN ' ' || p_brand || '!' WHEN 1 THEN '期末 ' || p_type
              WHEN 2 THEN '__' ELSE p_name END)), '[^a-z0-9_\\-\\x{4e00}-\\x{9fff}]+', '_', 'g'), '_-') AS s
          FROM part)""",
    )
    def scope_normalise(spark, sf):
        p = t.table(spark, sf, "part")
        k = F.col("p_partkey") % 4
        raw = (
            F.when(k == 0, F.concat(F.lit(" "), "p_brand", F.lit("!")))
            .when(k == 1, F.concat(F.lit("期末 "), "p_type"))
            .when(k == 2, F.lit("__"))
            .otherwise(F.col("p_name"))
        )
        return p.select("p_partkey", normalize_scope(raw).alias("scope"))

    @reg.add(
        "maintained_scopes",
        """SELECT DISTINCT p_type AS course_id, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS scope
        FROM part WHERE p_partkey % 2 = 0 AND p_size > 10""",
    )
    def maintained_scopes(spark, sf):
        p = t.table(spark, sf, "part")
        docs = p.select(
            F.col("p_type").alias("course_id"),
            F.col("p_brand").alias("applicability_scope"),
            F.when(F.col("p_partkey") % 2 == 0, "manual").otherwise("auto").alias("metadata_source"),
            F.when(F.col("p_size") > 10, "done").otherwise("failed").alias("status"),
            F.lit(True).alias("is_active"),
        )
        scopes = ev.maintained_scopes(docs)
        return scopes.select(
            "course_id", F.regexp_replace("scope", "[^a-z0-9]+", "_").alias("scope")
        ).distinct()

    @reg.add(
        "chapter_list",
        "WITH " + t.CHUNKS_SQL + "SELECT DISTINCT course_id, chapter FROM chunks",
    )
    def chapter_list(spark, sf):
        return rollups.chapter_list(t.document_chunks(spark, sf))

    @reg.add(
        "chapter_rollup",
        "WITH " + t.CHUNKS_SQL + """
        SELECT course_id, chapter, count(*) AS chunk_count, count(DISTINCT source_file) AS source_count
        FROM chunks GROUP BY course_id, chapter""",
    )
    def chapter_rollup(spark, sf):
        return rollups.chapter_rollup(t.document_chunks(spark, sf))

    @reg.add(
        "chapter_sources",
        "WITH " + t.CHUNKS_SQL + """
        SELECT course_id, chapter, source_file, count(*) AS chunk_count
        FROM chunks GROUP BY course_id, chapter, source_file""",
    )
    def chapter_sources(spark, sf):
        return rollups.chapter_sources(t.document_chunks(spark, sf))

    @reg.add(
        "chapter_exact_or_fuzzy",
        "WITH " + t.CHUNKS_SQL + """,
        req AS (
          SELECT course_id, CASE WHEN even THEN lo ELSE lower(substr(lo, 1, 9)) END AS wanted
          FROM (SELECT course_id, min(chapter) AS lo,
                  substr(course_id, 4)::INTEGER % 2 = 0 AS even FROM chunks GROUP BY course_id)),
        m AS (SELECT c.*, chapter = wanted AS exact FROM chunks c JOIN req USING (course_id)
              WHERE chapter = wanted OR contains(lower(chapter), lower(wanted))),
        pick AS (SELECT *, max(exact) OVER (PARTITION BY course_id) AS any_exact FROM m)
        SELECT course_id, doc_id, chapter, row_number() OVER (PARTITION BY course_id
          ORDER BY source_file, chunk_index, doc_id) AS position
        FROM pick WHERE exact = any_exact QUALIFY position <= 24""",
    )
    def chapter_exact_or_fuzzy(spark, sf):
        c = t.document_chunks(spark, sf)
        lo = c.groupBy("course_id").agg(F.min("chapter").alias("lo"))
        number = F.substring("course_id", 4, 9).cast("int")
        req = lo.select(
            number.alias("query_id"),
            "course_id",
            F.when(number % 2 == 0, F.col("lo"))
            .otherwise(F.lower(F.substring("lo", 1, 9)))
            .alias("chapter"),
        )
        return chapter_chunks(c, req).select(
            "course_id", "doc_id", "chapter", F.col("position").cast("long").alias("position")
        )

    @reg.add(
        "type_rollup",
        "WITH " + t.CHUNKS_SQL + """
        SELECT course_id, CASE (doc_id % 6) WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'word'
            WHEN 3 THEN 'text' WHEN 4 THEN 'ppt' ELSE 'other' END AS type,
          count(*) AS document_count, CAST(sum(chunk_index) AS BIGINT) AS chunk_count
        FROM chunks GROUP BY 1, 2""",
    )
    def type_rollup(spark, sf):
        docs = t.document_chunks(spark, sf).select(
            "course_id", F.col("source_file").alias("filename"), F.col("chunk_index").alias("chunk_count")
        )
        return rollups.type_rollup(docs).drop("label")

    @reg.add(
        "document_summary",
        """SELECT source AS course_id, count(*) AS document_count,
          CAST(sum(n_chars // 800 + 1) AS BIGINT) AS chunk_count,
          count(*) FILTER (WHERE n_chars < 100) AS failed_count
        FROM documents GROUP BY source""",
    )
    def document_summary(spark, sf):
        docs = t.table(spark, sf, "documents").select(
            F.col("source").alias("course_id"),
            (F.floor(F.col("n_chars") / 800) + 1).alias("chunk_count"),
            F.when(F.col("n_chars") < 100, "failed").otherwise("done").alias("status"),
            F.lit(True).alias("is_active"),
        )
        return rollups.document_summary(docs)

    @reg.add(
        "evidence_metadata",
        "WITH " + t.POLICY_SQL + r""",
        x AS (SELECT doc_id,
          regexp_extract(text, '(?i)(?:版本|版次|version|ver\.?|v)\s*[:：#]?[\s]*([0-9]+(?:\.[0-9]+){0,3})', 1) AS source_version,
          CAST(try_strptime('20' || (doc_id % 20 + 10) || '-' || (doc_id % 13 + 1) || '-' || (doc_id % 31 + 1), '%Y-%m-%d') AS DATE) AS d,
          CASE WHEN doc_id % 5 = 0 THEN '20' || (doc_id % 20 + 30) || '-06-30' ELSE '9999-12-31' END AS effective_to,
          CASE WHEN doc_id % 10 = 9 THEN 30 ELSE ([100,90,80,70,60,50,40,30,10])[doc_id % 9 + 1] END AS authority_level,
          doc_id % 3 = 0 AS scoped
          FROM policies)
        SELECT doc_id, source_version, coalesce(strftime(d, '%Y-%m-%d'), '0001-01-01') AS effective_from,
          effective_to, authority_level,
          round(least(20 + (CASE WHEN source_version <> '' THEN 20 ELSE 0 END)
            + (CASE WHEN d IS NOT NULL THEN 25 ELSE 0 END)
            + (CASE WHEN authority_level <> 30 THEN 25 ELSE 0 END)
            + (CASE WHEN scoped THEN 10 ELSE 0 END), 95) / 100e0, 2) AS metadata_confidence
        FROM x""",
    )
    def evidence_metadata_query(spark, sf):
        p = t.policy_documents(spark, sf).select(
            "doc_id", evidence_metadata("text", "filename").alias("m")
        )
        return p.select(
            "doc_id", "m.source_version", "m.effective_from", "m.effective_to", "m.authority_level",
            F.round("m.metadata_confidence", 2).alias("metadata_confidence"),
        )

    @reg.add(
        "date_extract",
        """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 OR year(o_orderdate) < 2000 THEN NULL
          ELSE strftime(o_orderdate, '%Y-%m-%d') END AS found FROM orders""",
    )
    def date_extract(spark, sf):
        o = t.table(spark, sf, "orders")
        d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
        text = (
            F.when(k == 3, F.concat(F.lit("无日期 "), F.year(d), F.lit("年13月40日")))
            .when(k == 2, F.date_format(d, "yyyy.M.d"))
            .when(k == 1, F.date_format(d, "'自'yyyy/M/d'起'"))
            .otherwise(
                F.concat(
                    F.lit("于"), F.year(d), F.lit("年"), F.month(d), F.lit("月"),
                    F.dayofmonth(d), F.lit("日"),
                )
            )
        )
        return o.select("o_orderkey", iso_date(text).alias("found"))

    @reg.add(
        "logical_name",
        """SELECT page_id, lower(split_part(url, '/', 3)) || ' notes' AS name FROM pages""",
    )
    def logical_name_query(spark, sf):
        p = t.table(spark, sf, "pages")
        k = F.col("page_id")
        host = F.coalesce(F.get(F.split("url", "/"), F.lit(2)), F.lit(""))
        suffix = (
            F.when(k % 5 == 0, F.concat(F.lit("_v"), (k % 90).cast("string")))
            .when(k % 5 == 1, F.concat(F.lit("-修订"), (k % 7).cast("string")))
            .when(k % 5 == 2, F.concat(F.lit(" Version "), (k % 12).cast("string")))
            .when(k % 5 == 3, (k % 100).cast("string"))
            .otherwise(F.lit(""))
        )
        return p.select(
            "page_id", logical_name(F.concat(host, F.lit("  Notes"), suffix, F.lit(".PDF"))).alias("name")
        )

    @reg.add(
        "section_and_type",
        "WITH " + t.CHUNKS_SQL + """
        SELECT split_part(section_path, ' / ', 2) AS section, CASE (doc_id % 6) WHEN 0 THEN 'pdf'
          WHEN 1 THEN 'markdown' WHEN 2 THEN 'word' WHEN 3 THEN 'text' WHEN 4 THEN 'ppt' ELSE 'other' END
          AS type, count(*) AS n FROM chunks GROUP BY 1, 2""",
    )
    def section_and_type(spark, sf):
        c = t.document_chunks(spark, sf)
        return c.groupBy(
            section_label("section_path").alias("section"), document_type("source_file").alias("type")
        ).agg(F.count("*").alias("n"))

