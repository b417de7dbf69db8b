"""Record-level operators: dedup, order, previews, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PREVIEW_ROWS
from ..functions.compat import first_units


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """O2: the first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def dedup_questions(questions: DataFrame) -> DataFrame:
    """O1: one record a file, number and first 50 UTF-16 units of text; the smallest id stays."""
    return keep_first(questions, ["doc_id", "question_number", first_units(F.col("question"), 50)], ["id"])


def sort_questions(questions: DataFrame) -> DataFrame:
    """O3: by file, number, id."""
    return questions.orderBy("doc_id", F.coalesce("question_number", F.lit(0)), "id")


def preview(questions: DataFrame, n: int = PREVIEW_ROWS, order: tuple[str, ...] = ("doc_id", "id")) -> DataFrame:
    """The first n rows of each section, and how many more there are."""
    w = Window.partitionBy("section")
    top = questions.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= n)
    totals = questions.groupBy("section").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("overflow"))
    return top.join(totals, "section")


def number_gaps(numbers: DataFrame) -> DataFrame:
    """A3, gaps: (doc_id, gap_from, gap_to) between successive numbers; numbers(doc_id, value)."""
    w = Window.partitionBy("doc_id").orderBy("value")
    rows = numbers.withColumn("before", F.lag("value").over(w)).where(F.col("value") > F.col("before") + 1)
    return rows.select("doc_id", (F.col("before") + 1).alias("gap_from"), (F.col("value") - 1).alias("gap_to"))


def limit_rows(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first n rows of a report, log or sample."""
    return df.orderBy(*order).limit(n)
