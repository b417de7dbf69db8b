"""Aggregates over records, files and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ATTENTION_BELOW, ATTENTION_ROWS, EXCERPT, UNKNOWN_ERROR
from ..functions import compat as C
from ..functions.cleaning import format_file_size, truncate
from .records import number_gaps

_YES, _NO = "〇", "×"


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def _buckets(c: Column) -> list[Column]:
    return [_count(c >= 80).alias("high"), _count((c >= 50) & (c < 80)).alias("medium"), _count(c < 50).alias("low")]


def extraction_stats(files: DataFrame) -> DataFrame:
    """A1: files(success, page_count, text_length, processing_time, quality, method, ...) to one row."""
    ok = F.col("success")
    quality = F.when(ok, F.coalesce("quality", F.lit(0.0)))
    return files.agg(
        F.count("*").alias("total_files"),
        _count(ok).alias("successful_files"),
        _count(~ok).alias("failed_files"),
        F.coalesce(F.sum(F.when(ok, F.col("page_count"))), F.lit(0)).alias("total_pages"),
        F.coalesce(F.sum(F.when(ok, F.col("text_length"))), F.lit(0)).alias("total_text_length"),
        F.coalesce(F.sum(F.when(ok, F.col("processing_time"))), F.lit(0.0)).alias("processing_time"),
        F.coalesce(F.avg(quality), F.lit(0.0)).alias("average_quality"),
        *_buckets(quality),
    )


def extraction_issues(files: DataFrame) -> DataFrame:
    """A1, issues: (doc_id, issues) of files whose text has some, and of failures with their error."""
    error = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit(UNKNOWN_ERROR))
    rows = files.select("doc_id", F.when(F.col("success"), F.col("issues")).otherwise(F.array(error)).alias("issues"))
    return rows.where(F.size("issues") > 0)


def histogram(df: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """Rows by key, the long form of a dynamic-key object."""
    return df.groupBy(F.coalesce(key, F.lit(default)).alias(key)).agg(F.count("*").alias("n"))


def parsing_stats(questions: DataFrame) -> DataFrame:
    """A2: one row a document."""
    q = F.col
    return questions.groupBy("doc_id").agg(
        F.count("*").alias("total_questions"),
        F.avg("confidence").alias("average_confidence"),
        *_buckets(q("confidence")),
        _count(q("answer") == _YES).alias("correct"),
        _count(F.coalesce(q("answer") != _YES, F.lit(True))).alias("incorrect"),
        _count(C.length(q("explanation")) > 10).alias("has_explanation"),
        F.avg(C.length(q("question"))).alias("average_question_length"),
    )


def quality_issues(questions: DataFrame) -> DataFrame:
    """A2, issues: (doc_id, question_number, issue), the number and a low confidence named in the text."""
    q = F.col
    head = F.concat(F.lit("問"), F.coalesce(q("question_number").cast("string"), F.lit("null")), F.lit(": "))
    value = F.regexp_replace(q("confidence").cast("double").cast("string"), r"\.0$", "")
    low = F.when(q("confidence") < 50, F.concat(head, F.lit("信頼度が低い ("), value, F.lit("%)")))
    found = F.array_compact(F.array(low, F.when(C.length(q("question")) < 20, F.concat(head, F.lit("問題文が短い"))), F.when(F.coalesce("answer", F.lit("")) == "", F.concat(head, F.lit("答えが不明")))))
    return questions.select("doc_id", "question_number", F.explode(found).alias("issue"))


def number_distribution(numbers: DataFrame) -> DataFrame:
    """A3: numbers(doc_id, value); duplicates break the sequence without a gap."""
    gaps = number_gaps(numbers).groupBy("doc_id").agg(F.count("*").alias("n_gaps"))
    out = numbers.groupBy("doc_id").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count"), F.count_distinct("value").alias("different"))
    span = F.col("max") - F.col("min") + 1
    return out.join(gaps, "doc_id", "left").select("doc_id", "min", "max", span.alias("range"), "count", ((F.col("count") == F.col("different")) & (F.col("count") == span)).alias("sequential"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), (F.col("count") / span).alias("completeness"))


def answer_distribution(answers: DataFrame) -> DataFrame:
    """A4: answers(doc_id, value)."""
    yes, no, n = _count(F.col("value") == _YES), _count(F.col("value") == _NO), F.count("*")
    return answers.groupBy("doc_id").agg(n.alias("total"), yes.alias("correct"), no.alias("incorrect"), (yes / n).alias("correct_ratio"), (no / n).alias("incorrect_ratio"), (F.abs(yes - no) / n < 0.3).alias("balanced"))


def pattern_reliability(raw: DataFrame) -> DataFrame:
    """A5, A6 and A6b on records before finalisation: reliability and the formats found."""
    q = F.col
    out = raw.groupBy("doc_id").agg(F.count("question_number").alias("numbers"), F.count("answer").alias("answers"), _count(F.coalesce("explanation", F.lit("")) != "").alias("explanations"), _count(q("answer") == _YES).alias("yes"), _count(q("answer") == _NO).alias("no"))
    base = F.greatest("numbers", F.lit(1))
    score = F.when(q("numbers") > 0, 0.4).otherwise(0.0) + q("answers") / base * 0.3 + q("explanations") / base * 0.3
    balanced = (q("answers") > 0) & (F.abs(q("yes") - q("no")) / q("answers") < 0.3)
    formats = F.array_compact(F.array(F.when(q("numbers") > 0, F.lit("番号付き問題")), F.when(q("answers") > 0, F.lit("○×問題")), F.when(q("explanations") > 0, F.lit("解説付き")), F.when(balanced, F.lit("バランス型"))))
    return out.select("doc_id", "numbers", "answers", "explanations", score.alias("reliability"), F.array_join(formats, ",").alias("formats"))


def overview(questions: DataFrame) -> DataFrame:
    """Totals, shares, sections, the most frequent section (the one met later on ties), quality buckets.

    Sections are aggregated first, then their partial sums, so that all figures come from one pass."""
    by = questions.groupBy("section").agg(
        F.count("*").alias("n"),
        _count(F.col("answer") == _YES).alias("yes"),
        _count(F.col("answer") == _NO).alias("no"),
        F.sum(F.coalesce("confidence", F.lit(0.0))).alias("c"),
        *_buckets(F.col("confidence")),
        F.min(F.struct("doc_id", "id")).alias("met"),
    )
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = by.agg(
        whole("n").alias("total"),
        whole("yes").alias("correct"),
        whole("no").alias("incorrect"),
        F.count("section").alias("sections"),
        F.coalesce(F.sum("c") / F.sum("n"), F.lit(0.0)).alias("average_confidence"),
        *(whole(c).alias(c) for c in ("high", "medium", "low")),
        F.max(F.struct("n", "met", "section"))["section"].alias("main_section"),
    )
    share = lambda c: F.when(F.col("total") > 0, F.floor(F.col(c) / F.col("total") * 100 + 0.5)).cast("int")
    return out.withColumns({"correct_percent": share("correct"), "incorrect_percent": share("incorrect")})


def section_report(questions: DataFrame) -> DataFrame:
    """Total, correct and rate by section."""
    out = questions.groupBy("section").agg(F.count("*").alias("total"), _count(F.col("answer") == _YES).alias("correct"), F.avg("confidence").alias("average_confidence"))
    return out.withColumn("correct_rate", F.round(F.col("correct") * 100.0 / F.col("total"), 1))


def report_totals(questions: DataFrame, n: int = ATTENTION_ROWS, below: float = ATTENTION_BELOW) -> DataFrame:
    """One row with the report's totals, the records that need attention and how many of those the list leaves out."""
    low = _count(F.col("confidence") < below)
    return questions.agg(
        F.count("*").alias("total"),
        _count(F.col("answer") == _YES).alias("correct"),
        _count(F.col("answer") == _NO).alias("incorrect"),
        F.round(F.sum(F.coalesce("confidence", F.lit(0.0))) / F.count("*"), 1).alias("average_confidence"),
        low.alias("attention"),
        F.greatest(low - n, F.lit(0)).alias("not_listed"),
    )


def attention_list(questions: DataFrame, n: int = ATTENTION_ROWS, below: float = ATTENTION_BELOW) -> DataFrame:
    """The first n records of low confidence, texts cut to EXCERPT characters."""
    rows = questions.where(F.col("confidence") < below).orderBy("doc_id", "id").limit(n)
    return rows.select("doc_id", "id", "question_number", "section", "confidence", truncate(F.col("question"), EXCERPT).alias("excerpt"))


def hierarchy_summary(rows: DataFrame) -> DataFrame:
    """A10: records by first level, without the empty one, with their answers."""
    return rows.where(F.col("大項目") != "").groupBy(F.col("大項目").alias("level1")).agg(F.count("*").alias("total"), _count(F.col("回答") == _YES).alias("correct"), _count(F.col("回答") == _NO).alias("incorrect"))


def extraction_status(stats: DataFrame) -> DataFrame:
    """Error without questions, success without failures, else warning; stats(successful_files, failed_files, questions)."""
    rate = F.when(F.col("successful_files") + F.col("failed_files") > 0, F.col("successful_files") * 100.0 / (F.col("successful_files") + F.col("failed_files"))).otherwise(0.0)
    return stats.withColumns({"success_rate": rate, "status": F.when(F.col("questions") == 0, "error").when(F.col("failed_files") == 0, "success").otherwise("warning")})


def debug_info(files: DataFrame, manifest: DataFrame | None = None, config: dict[str, str] | None = None, to_even: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ten fields of each file's result, name and size (to_even: rounded as SQL does) from manifest(doc_id, name, size),
    and the totals of A1 with the run's configuration."""
    known = files.join(manifest.select("doc_id", "name", "size"), "doc_id", "left") if manifest is not None else files.withColumns({"name": F.col("doc_id").cast("string"), "size": F.lit(None).cast("long")})
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = known.select("name", format_file_size(F.col("size"), to_even).alias("size"), "success", zero("page_count").alias("page_count"), "text_length", F.coalesce("quality", F.lit(0.0)).alias("quality"), "method", F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"), "error")
    return rows, extraction_stats(files).withColumn("config", F.lit(None).cast("map<string,string>") if not config else F.create_map(*(F.lit(str(x)) for kv in config.items() for x in kv)))
