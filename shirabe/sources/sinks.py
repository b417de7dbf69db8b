"""Exports: CSV with a byte-order mark, XLSX, JSON, logs and options."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CSV_HEADERS, EXPORT_NAME, HIERARCHY_HEADERS
from ..functions.cleaning import escape_csv
from .formats import SHEET_ROWS, register


def csv_rows(questions: DataFrame) -> DataFrame:
    """One text column of CSV lines; only text, question and source fields are quoted, and only if they need it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, F.lit("N/A")).otherwise(F.regexp_replace(F.col("confidence").cast("string"), r"\.0$", ""))
    fields = [text("id"), text("section"), text("year"), text("question_number"), escape_csv(text("question")), text("answer"), text("explanation"), escape_csv(text("source")), F.coalesce("extraction_method", F.lit("unknown")), number, F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit(""))]
    fields[6] = escape_csv(fields[6])
    return questions.select(F.concat_ws(",", *fields).alias("value"))


def write_csv(lines: DataFrame, folder: str, headers: list[str] = CSV_HEADERS, prefix: str = EXPORT_NAME, day: date | None = None) -> None:
    """Lines (value) as one dated file with one byte-order mark and header, also if there are none; in the rows' order
    where they are sorted."""
    register(lines.sparkSession)
    lines.select("value").write.format("single_csv").mode("append").options(prefix=prefix, header=",".join(headers), **_day(day)).save(folder)


def _day(day: date | None) -> dict[str, str]:
    return {"day": day.isoformat()} if day else {}


def hierarchy_csv_rows(rows: DataFrame) -> DataFrame:
    """All nine fields, quoted where they need it."""
    return rows.select(F.concat_ws(",", *(escape_csv(F.coalesce(F.col(c), F.lit(""))) for c in HIERARCHY_HEADERS)).alias("value"))


def write_excel(rows: DataFrame, folder: str, prefix: str = EXPORT_NAME, day: date | None = None, sheet_rows: int = SHEET_ROWS) -> None:
    """Rows as one dated workbook, as many sheets as they need; columns other than numbers and booleans as text."""
    register(rows.sparkSession)
    plain = [F.col(c) if kind in ("string", "boolean", "double", "float", "tinyint", "smallint", "int", "bigint") else F.col(c).cast("string") if not kind.startswith(("array", "struct", "map")) else F.to_json(c) for c, kind in rows.dtypes]
    rows.select(*(v.alias(c) for v, c in zip(plain, rows.columns, strict=True))).write.format("single_xlsx").mode("append").options(prefix=prefix, sheetRows=sheet_rows, **_day(day)).save(folder)


def write_json(questions: DataFrame, path: str, metadata: bool = True) -> None:
    """S15."""
    (questions if metadata else questions.drop("metadata")).write.mode("overwrite").json(path)


def write_log(events: DataFrame, path: str, last: int = 1000) -> None:
    """The last events(ts, level, message) as text."""
    rows = events.orderBy(F.desc("ts")).limit(last).orderBy("ts")
    rows.select(F.format_string("[%s] [%s] %s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.upper("level"), "message").alias("value")).write.mode("overwrite").text(path)


def save_options(spark: SparkSession, options: dict, path: str) -> None:
    """Options as one JSON text in any file system that Spark reaches."""
    spark.createDataFrame([(json.dumps(options, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_options(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path).first()
    except AnalysisException:
        return dict(default or {})
    return {**(default or {}), **json.loads(row["value"])} if row else dict(default or {})
