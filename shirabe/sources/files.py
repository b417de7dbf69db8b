"""File manifest, validation, page assembly and the text fallback chain."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_FILE_BYTES
from ..functions import compat as C
from ..functions.cleaning import clean, quality_issues, text_quality
from .formats import register

#: (doc_id, name, content) -> pages as (page_no, text or None, error or None)
PdfReader = Callable[[bytes], list[tuple[int, str | None, str | None]]]


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents below a folder, by name or type and size, with their place in the order of names and their
    content; the files are chosen and dealt to tasks before any is opened."""
    register(spark)
    return spark.read.format("document_files").load(path)


def is_pdf(name: Column, mime: Column) -> Column:
    """S1."""
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(F.lower(name).rlike(r"\.pdf\z"), F.lit(False))


def is_small_enough(size: Column) -> Column:
    """S2."""
    return size <= MAX_FILE_BYTES


def add_files(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """S3: valid new files behind the known ones, each with an id of its own."""
    ok = new.where(is_pdf(F.col("name"), F.col("mime")) & is_small_enough(F.col("size")))
    return manifest.unionByName(ok.withColumn("id", F.expr("uuid()")), allowMissingColumns=True)


def remove_files(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    return manifest.join(ids.select("id"), "id", "left_anti")


def check_inputs(manifest: DataFrame) -> DataFrame:
    """One row with the number of files, their size, and whether both are acceptable."""
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("valid", (F.col("files") > 0) & (F.col("bytes") <= F.col("files") * MAX_FILE_BYTES))


def read_pages(files: DataFrame, reader: PdfReader) -> DataFrame:
    """Pages of files by a reader that the caller brings (no PDF library is bundled), each with the milliseconds that
    its file took; failures are rows, with the whole error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                began, own = time.perf_counter(), []
                try:
                    own = [(doc_id, n, error is None, text, error) for n, text, error in reader(bytes(content))]
                except Exception as e:  # noqa: BLE001  errors are data here
                    own = [(doc_id, 0, False, None, str(e))]
                took = (time.perf_counter() - began) * 1000
                rows += [(*r, took) for r in own]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "success", "text", "error", "processing_time"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, page_no int, success boolean, text string, error string, processing_time double")


#: content -> (number of pages, encrypted or None, attributes by their name in the document)
MetadataReader = Callable[[bytes], tuple[int, bool | None, dict[str, str | None]]]
#: Attribute -> its name in the document, and its default.
METADATA = {"title": ("Title", ""), "author": ("Author", ""), "subject": ("Subject", ""), "creator": ("Creator", ""), "producer": ("Producer", ""), "creation_date": ("CreationDate", None), "modification_date": ("ModDate", None), "pdf_version": ("pdf:PDFVersion", None)}


def read_metadata(files: DataFrame, reader: MetadataReader) -> DataFrame:
    """doc_id and ten attributes of each file, by a reader that the caller brings. A reader that fails on the attributes
    raises with the number of pages as its first argument, and only that and `encrypted` are set; any other error leaves
    the number of pages null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    n, encrypted, info = reader(bytes(content))
                    rows.append((doc_id, *(info.get(name) or default for name, default in METADATA.values()), n, bool(encrypted)))
                except Exception as e:  # noqa: BLE001  errors are data here
                    n = e.args[0] if e.args and isinstance(e.args[0], int) else None
                    rows.append((doc_id, *[None] * len(METADATA), n, False))
            out = pd.DataFrame(rows, columns=["doc_id", *METADATA, "page_count", "encrypted"])
            yield out.astype({"page_count": "Int64"})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, " + ", ".join(f"{c} string" for c in METADATA) + ", page_count long, encrypted boolean")


def assemble(pages: DataFrame, max_pages: int = 0, normalise: bool = True) -> DataFrame:
    """(doc_id, raw_text, text, page_count): successful pages in order, each followed by a blank line, then cleaned."""
    rows = pages.where(F.col("page_no") <= max_pages) if max_pages else pages
    parts = F.array_sort(F.collect_list(F.when(F.col("success"), F.struct("page_no", "text"))))
    out = rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.lit("\n\n"))), "").alias("raw_text"), F.count("*").alias("page_count"))
    return out.withColumn("text", clean(F.col("raw_text"), normalise))


def file_results(pages: DataFrame, method: str = "simple", max_pages: int = 0, normalise: bool = True) -> DataFrame:
    """One result row a file, with quality; a file without any successful page is a failure row."""
    docs = assemble(pages, max_pages, normalise)
    took = F.max("processing_time") if "processing_time" in pages.columns else F.lit(0.0)
    ok = pages.groupBy("doc_id").agg(F.max("success").alias("success"), F.min("error").alias("error"), took.alias("processing_time"))
    q = text_quality(F.col("text"))
    return docs.join(ok, "doc_id").select("doc_id", "success", F.when(F.col("success"), F.lit(None).cast("string")).otherwise(F.col("error")).alias("error"), "text", "page_count", C.length(F.col("text")).alias("text_length"), q["score"].cast("double").alias("quality"), F.lit(method).alias("method"), "processing_time", quality_issues(q).alias("issues"))


def first_text(*columns: Column) -> Column:
    """The first extractor's text that is not blank; null if all fail."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns))


def in_order(results: DataFrame, index: str = "file_idx") -> DataFrame:
    """Results in the order in which files were given."""
    return results.orderBy(index)
