"""Readers for the Parquet tables and the retrieval views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(key, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


# Attributes the tables do not carry are derived from the document key, in the
# same way here and in the SQL below.
SCOPES = ("all", "exam", "lab")
AUTHORITY = (100, 90, 80, 70, 60, 50, 40, 30, 10)
BLOCKS = ("text", "text", "formula", "table", "image_summary", "image")
EXTENSIONS = ("pdf", "md", "docx", "txt", "pptx", "html")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk of the course named by its source."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    year = (F.lit(2018) + k % 6).cast("string")
    return d.select(
        F.col("source").alias("course_id"),
        k,
        (k % 7).cast("int").alias("chunk_index"),
        "text",
        (F.floor(k / 10) % 40).cast("int").alias("page"),
        _pick(k, BLOCKS).alias("block_type"),
        F.concat(F.lit("Chapter "), (F.floor(k / 20) % 12).cast("string"), F.lit(" "), "lang").alias(
            "chapter"
        ),
        F.concat(F.lit("Part "), (k % 4).cast("string"), F.lit(" / "), "lang").alias("section_path"),
        F.concat(
            "lang", F.lit("_notes_v"), (k % 4).cast("string"), F.lit("."), _pick(k, EXTENSIONS)
        ).alias("source_file"),
        _pick(k, AUTHORITY).alias("authority_level"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("L"), (k % 9).cast("string"))).alias(
            "authority_label"
        ),
        F.concat(year, F.lit("-01-01")).alias("effective_from"),
        F.when(k % 4 == 0, "9999-12-31")
        .otherwise(F.concat((F.lit(2018) + k % 6 + 2).cast("string"), F.lit("-12-31")))
        .alias("effective_to"),
        _pick(k, SCOPES).alias("applicability_scope"),
        F.when(k % 3 == 0, "").otherwise(F.concat((k % 4).cast("string"), F.lit(".0"))).alias(
            "source_version"
        ),
        F.lit("").alias("context"),
    )


CHUNKS_SQL = """
chunks AS (
  SELECT source AS course_id, doc_id, CAST(doc_id % 7 AS INTEGER) AS chunk_index, text,
    CAST((doc_id // 10) % 40 AS INTEGER) AS page,
    (['text','text','formula','table','image_summary','image'])[doc_id % 6 + 1] AS block_type,
    'Chapter ' || ((doc_id // 20) % 12) || ' ' || lang AS chapter,
    'Part ' || (doc_id % 4) || ' / ' || lang AS section_path,
    lang || '_notes_v' || (doc_id % 4) || '.' ||
      (['pdf','md','docx','txt','pptx','html'])[doc_id % 6 + 1] AS source_file,
    ([100,90,80,70,60,50,40,30,10])[doc_id % 9 + 1] AS authority_level,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'L' || (doc_id % 9) END AS authority_label,
    (2018 + doc_id % 6) || '-01-01' AS effective_from,
    CASE WHEN doc_id % 4 = 0 THEN '9999-12-31'
         ELSE (2018 + doc_id % 6 + 2) || '-12-31' END AS effective_to,
    (['all','exam','lab'])[doc_id % 3 + 1] AS applicability_scope,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 4) || '.0' END AS source_version
  FROM documents)
"""


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document chunks with the stored vector of the same key where one exists."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return document_chunks(spark, sf_dir).join(e, "doc_id", "left")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as one chunk; its label is the course."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    return e.select(
        F.col("label").cast("string").alias("course_id"),
        k.alias("doc_id"),
        F.lit(0).alias("chunk_index"),
        "embedding",
        _pick(k, SCOPES).alias("applicability_scope"),
        F.concat((F.lit(2018) + k % 6).cast("string"), F.lit("-01-01")).alias("effective_from"),
        F.concat((F.lit(2020) + k % 6).cast("string"), F.lit("-12-31")).alias("effective_to"),
    )


def course_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector query per course: its stored vector with the smallest key."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(
        F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("query_vec")
    ).select("query_id", F.col("label").cast("string").alias("course_id"), "query_vec")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions, dealt out over the twenty courses."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("course_id"),
        F.col("text").alias("query_text"),
    )


QUERIES_SQL = """
queries AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS course_id, text AS query_text
  FROM benchmark)
"""


def scoped_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark questions with a scope and a date each."""
    k = F.col("query_id")
    return benchmark_queries(spark, sf_dir).withColumns(
        {
            "scenario": _pick(k, ("exam", "lab", "all", "")),
            "as_of": _pick(k, ("2021-06-01", "2020-01-01", "")),
        }
    )


SCOPED_SQL = """
queries AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS course_id, text AS query_text,
    (['exam','lab','all',''])[item_id % 4 + 1] AS scenario,
    (['2021-06-01','2020-01-01',''])[item_id % 3 + 1] AS as_of
  FROM benchmark)
"""


# --- lines of documents as ordered chunks, headings and formulas ---------------


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document in order, some of them turned into headings."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        F.col("source").alias("course_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    chapter = F.concat(
        F.lit("# Chapter "), (F.floor(F.col("pos") / 8) + 1).cast("string"), F.lit(" "), "line"
    )
    return rows.select(
        "course_id", "doc_id", "pos",
        F.when(F.col("pos") % 8 == 0, chapter)
        .when(F.col("pos") % 8 == 4, F.concat(F.lit("## "), "line"))
        .otherwise(F.col("line"))
        .alias("text"),
    )


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as retrieval chunks: four lines a page, every fifth a formula."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        F.col("source").alias("course_id"), "doc_id",
        F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"),
    )
    i = F.col("chunk_index")
    return rows.select(
        "course_id", "doc_id", "chunk_index",
        F.concat(F.lit("("), (i % 9 + 1).cast("string"), F.lit(") "), "line").alias("text"),
        (F.floor(i / 4) + 1).cast("int").alias("page"),
        F.when(i % 5 == 3, "formula").otherwise("text").alias("block_type"),
        F.lit("all").alias("applicability_scope"),
        F.lit("0001-01-01").alias("effective_from"),
        F.lit("9999-12-31").alias("effective_to"),
        F.lit("").alias("context"), F.lit("").alias("section_path"),
        F.col("course_id").alias("source_file"), F.lit(30).alias("authority_level"),
        F.lit("").alias("chapter"),
    )


LINES_SQL = """
raw_lines AS (
  SELECT source AS course_id, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT source, doc_id, str_split(text, chr(10)) AS ls FROM documents)),
lines AS (
  SELECT course_id, doc_id, pos,
    CASE WHEN pos % 8 = 0 THEN '# Chapter ' || (pos // 8 + 1) || ' ' || line
         WHEN pos % 8 = 4 THEN '## ' || line ELSE line END AS text FROM raw_lines),
line_chunks AS (
  SELECT course_id, doc_id, pos AS chunk_index, '(' || (pos % 9 + 1) || ') ' || line AS text,
    pos // 4 + 1 AS page, CASE WHEN pos % 5 = 3 THEN 'formula' ELSE 'text' END AS block_type
  FROM raw_lines)
"""


# --- policy headers and questions derived from the rows -----------------------

AGENCIES = ("国务院", "国家标准", "教育部", "行业标准", "某省教学办法", "大学考试规定", "教研室", "讲义", "草案")


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a header with version, validity and issuer."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")

    def s(c):
        return c.cast("string")

    head = F.concat(
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("版本："), s(k % 7), F.lit("."), s(k % 3), F.lit("\n"))),
        F.lit("生效日期：20"), s(k % 20 + 10), F.lit("年"), s(k % 13 + 1), F.lit("月"), s(k % 31 + 1), F.lit("日\n"),
        F.when(k % 5 == 0, F.concat(F.lit("有效期至 20"), s(k % 20 + 30), F.lit("-06-30\n"))).otherwise(""),
        F.when(k % 3 == 0, F.lit("适用范围：全体学生\n")).otherwise(""),
        F.when(k % 10 == 9, F.lit("")).otherwise(F.concat(_pick(k, AGENCIES), F.lit("\n"))),
    )
    return d.select(
        "doc_id",
        F.concat(head, "text").alias("text"),
        F.concat("lang", F.lit("_"), s(k % 3), F.lit(".pdf")).alias("filename"),
    )


POLICY_SQL = """
policies AS (
  SELECT doc_id, lang || '_' || (doc_id % 3) || '.pdf' AS filename,
    (CASE WHEN doc_id % 4 = 0 THEN '' ELSE '版本：' || (doc_id % 7) || '.' || (doc_id % 3) || chr(10) END)
    || '生效日期：20' || (doc_id % 20 + 10) || '年' || (doc_id % 13 + 1) || '月' || (doc_id % 31 + 1) || '日' || chr(10)
    || (CASE WHEN doc_id % 5 = 0 THEN '有效期至 20' || (doc_id % 20 + 30) || '-06-30' || chr(10) ELSE '' END)
    || (CASE WHEN doc_id % 3 = 0 THEN '适用范围：全体学生' || chr(10) ELSE '' END)
    || (CASE WHEN doc_id % 10 = 9 THEN '' ELSE
        (['国务院','国家标准','教育部','行业标准','某省教学办法','大学考试规定','教研室','讲义','草案'])[doc_id % 9 + 1]
        || chr(10) END)
    || text AS text
  FROM documents)
"""

# Question wordings before and after the text of a message.
QUESTIONS = (
    ("什么是", ""),
    ("请问2024年3月5日期末考试的规定是什么 ", ""),
    ("那这个要求呢 ", ""),
    ("第三章概览 ", ""),
    ("", " 新旧版本的区别"),
    ("帮我出5道选择题 ", ""),
    ("那 ", " 呢"),
    ("", ""),
    ("最新规定 ", ""),
    ("谢谢", ""),
)


def asked_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with user texts worded as questions of every routing class."""
    m = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 3 + F.col("turn")
    words = F.when(k % 10 == 9, F.lit("")).otherwise(F.col("text"))
    return m.withColumn(
        "text",
        F.when(
            F.col("role") == "user",
            F.concat(_pick(k, [a for a, _ in QUESTIONS]), words, _pick(k, [b for _, b in QUESTIONS])),
        ).otherwise(F.col("text")),
    )


ASKED_SQL = """
asked AS (
  SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN
    (['什么是','请问2024年3月5日期末考试的规定是什么 ','那这个要求呢 ','第三章概览 ','','帮我出5道选择题 ','那 ','','最新规定 ','谢谢'])[(conv_id * 3 + turn) % 10 + 1]
    || (CASE WHEN (conv_id * 3 + turn) % 10 = 9 THEN '' ELSE text END)
    || (['','','','',' 新旧版本的区别','',' 呢','','',''])[(conv_id * 3 + turn) % 10 + 1]
    ELSE text END AS text
  FROM conversations)
"""


# --- question bank and practice -----------------------------------------------


def bank_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as questions: type is the course, brand the kind, size the level."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("question_id"),
        F.col("p_type").alias("course_id"),
        F.when(F.col("p_partkey") % 3 == 0, "choice").when(F.col("p_partkey") % 3 == 1, "fill_blank")
        .otherwise("short_answer").alias("question_type"),
        F.when(size <= 15, "easy").when(size <= 35, "medium").otherwise("hard").alias("difficulty"),
        F.col("p_name").alias("stem"),
        F.concat(F.lit("ch"), (size % 10).cast("string")).alias("chapter"),
        F.when(F.col("p_partkey") % 4 == 0, "reviewed").otherwise("draft").alias("status"),
        (F.lit(20240000) + F.col("p_partkey") % 365).cast("int").alias("updated_at"),
        "p_brand", "p_retailprice",
    )


BANK_SQL = """
questions AS (
  SELECT p_partkey AS question_id, p_type AS course_id,
    CASE p_partkey % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'fill_blank' ELSE 'short_answer' END AS question_type,
    CASE WHEN p_size <= 15 THEN 'easy' WHEN p_size <= 35 THEN 'medium' ELSE 'hard' END AS difficulty,
    p_name AS stem, 'ch' || (p_size % 10) AS chapter,
    CASE WHEN p_partkey % 4 = 0 THEN 'reviewed' ELSE 'draft' END AS status,
    CAST(20240000 + p_partkey % 365 AS INTEGER) AS updated_at, p_brand, p_retailprice
  FROM part)
"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as practice attempts on the question named by their payload."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    started = kind == "view"
    rows = e.select(
        F.col("event_id").alias("attempt_id"),
        k.alias("question_id"),
        F.when(started, "started").when(kind == "click", "submitted").otherwise("graded").alias("status"),
        F.when(F.col("event_id") % 2 == 0, "objective").otherwise("self").alias("grading_method"),
        F.when(kind == "purchase", F.lit(True)).when(kind == "error", F.lit(False))
        .when(kind == "signup", F.col("value") > 50).alias("correct"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") - 1).alias("previous_attempt_id"),
        (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("created_at"),
        F.when(~started, F.col("ts")).alias("submitted_at"),
        F.concat(F.lit("req"), (F.col("event_id") % 997).cast("string")).alias("request_id"),
    )
    courses = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("question_id"), F.col("p_type").alias("course_id")
    )
    return rows.join(courses, "question_id")


ATTEMPTS_SQL = """
attempts AS (
  SELECT event_id AS attempt_id, p_partkey AS question_id, p_type AS course_id,
    CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'submitted' ELSE 'graded' END AS status,
    CASE WHEN event_id % 2 = 0 THEN 'objective' ELSE 'self' END AS grading_method,
    CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false WHEN 'signup' THEN value > 50 END AS correct,
    CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS previous_attempt_id,
    ts - INTERVAL 1 HOUR AS created_at, CASE WHEN event_type <> 'view' THEN ts END AS submitted_at,
    'req' || (event_id % 997) AS request_id
  FROM events JOIN part ON p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT))
"""
