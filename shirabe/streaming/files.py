"""Incremental runs: new text files as a stream, parsed batch by batch into a table of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.questions import parse_questions, release


def text_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """texts(doc_id, file_name, text), a row a file."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(path)
    return files.select(F.input_file_name().alias("doc_id"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file_name"), F.col("value").alias("text"))


def parse_stream(texts: DataFrame, table_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Records of every new file as Parquet below table_path, a folder a batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        records = parse_questions(batch, **options)
        try:
            records.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        finally:
            release(records)

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
