"""Continuous ingestion: new files or rows become chunks, exactly once per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.chunking import chunk_documents
from citeloom.session import shared_path
from citeloom.sources import files


#: Files of one micro-batch.
FILES_PER_BATCH = 64


def watch_folder(spark: SparkSession, root: str) -> DataFrame:
    """Stream of new or changed supported files below a folder."""
    return (
        spark.readStream.format("binaryFile")
        .schema(files.BINARY_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(files.EXTENSIONS) + "}")
        .load(root)
    )


def file_chunks(batch: DataFrame, course_id: str) -> DataFrame:
    """Chunks of a batch of files, keyed by path."""
    pages = files.parse_pages(batch).filter("error IS NULL")
    return chunk_documents(pages.withColumn("course_id", F.lit(course_id)))


def run_available(
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
) -> str:
    """Process what is there and stop.  Each micro-batch owns one directory.

    A batch repeated after a failure overwrites its own directory, which makes
    the sink idempotent without a transaction log.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream over a Parquet table, be it one file or a folder of files."""
    # The source takes folders or patterns; this pattern fits the path alone.
    exact = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(exact)


def stream_rows(
    spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append"
) -> DataFrame:
    """Run a streaming transformation over a table and read its output rows."""
    source = table_stream(spark, path)
    out, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        transform(source)
        .writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)
