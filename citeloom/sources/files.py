"""File sources: binary scan, text decoding, document parsing per file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import extension, strip
from citeloom.sources import office

EXTENSIONS = ("pdf", "txt", "md", "doc", "docx", "pptx")
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
PAGE_SCHEMA = "path string, page_no int, page int, text string, parser_name string, error string"


def scan(spark: SparkSession, root: str, *, recursive: bool = True) -> DataFrame:
    """Supported files below a folder with their bytes."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}")
        .load(root)
    )


def fingerprint(files: DataFrame) -> DataFrame:
    """Path, modification seconds and content digest; bytes are dropped."""
    return files.select(
        "path",
        F.unix_micros("modificationTime").cast("double").alias("mtime_us"),
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"),
        "length",
        F.sha2("content", 256).alias("content_hash"),
    ).drop("mtime_us")


def decode_utf8(content: Column | str) -> Column:
    """UTF-8 text without a byte-order mark; NULL when the bytes are not UTF-8."""
    c = F.col(content) if isinstance(content, str) else content
    text = F.decode(c, "UTF-8")
    return F.when(F.is_valid_utf8(c.cast("string")), F.regexp_replace(text, "^\\uFEFF", ""))


def decode_bytes(data: bytes | None) -> str | None:
    """GBK text, else UTF-8 with replacement characters."""
    if data is None:
        return None
    try:
        return data.decode("gbk")
    except UnicodeDecodeError:
        return data.decode("utf-8", errors="replace")


def _decode_other(raw: Column) -> Column:
    def each(values: pd.Series) -> pd.Series:
        return values.map(decode_bytes)

    return F.pandas_udf(each, "string")(raw)


def decode_text(content: str = "content") -> Column:
    """UTF-8 first, then GBK, then UTF-8 with replacement characters.

    Only bytes that are not UTF-8 are handed to the Python fallback.
    """
    utf8 = decode_utf8(content)
    return F.coalesce(utf8, _decode_other(F.when(utf8.isNull(), F.col(content))))


def parse_pages(files: DataFrame) -> DataFrame:
    """Pages of every file: one row per page, or one row with ``error``.

    Plain text stays in the JVM; office formats are read by a small per-file
    helper in the Arrow path; PDF and legacy files need a registered reader and
    otherwise report that.
    """
    kind = extension("path")
    plain = files.filter(kind.isin("txt", "md")).select(
        "path",
        F.lit(0).alias("page_no"),
        F.lit(None).cast("int").alias("page"),
        strip(decode_text()).alias("text"),
        F.when(kind == "md", "markdown").otherwise("text").alias("parser_name"),
    )
    plain = plain.withColumn(
        "error", F.when(F.col("text") == "", F.lit("empty document")).otherwise(F.lit(None).cast("string"))
    )
    rest = files.filter(~kind.isin("txt", "md")).select("path", kind.alias("kind"), "content")
    return plain.unionByName(rest.mapInPandas(_parse_batches, PAGE_SCHEMA))


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, kind, content in zip(batch["path"], batch["kind"], batch["content"]):
            rows += office.pages_of(path, kind, bytes(content))
        yield pd.DataFrame(rows, columns=["path", "page_no", "page", "text", "parser_name", "error"])


def full_text(pages: DataFrame) -> DataFrame:
    """Blank-line joined non-blank pages per file."""
    rows = pages.filter(F.col("error").isNull() & (strip("text") != ""))
    return rows.groupBy("path").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]
            ),
            "\n\n",
        ).alias("text"),
        F.max("parser_name").alias("parser_name"),
    )


def read_cases(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON-lines cases; blank lines are skipped by the reader."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader).json(path)
