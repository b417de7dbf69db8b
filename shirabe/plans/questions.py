"""The record pipelines: texts(doc_id, file_name, text) to finalised question records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean
from ..functions.compat import where_once
from ..functions.detect import file_year, is_valid, section
from ..functions.scoring import finalize
from ..operators.adaptive import adaptive_questions, answer_anchored
from ..operators.lines import joined_text, merge_short_lines, split_lines
from ..operators.records import dedup_questions
from ..operators.segment import RAW_COLUMNS, emergency_questions, fallback_questions

RESULT_COLUMNS = ["doc_id", "id", "section", "year", "question_number", "question", "answer", "explanation", "source", "extraction_method", "confidence", "choices", "quality", "answer_guessed", "explanation_generated", "pattern", "line_index"]


def raw_questions(texts: DataFrame, normalise: bool = True, answer_aware: bool = False) -> tuple[DataFrame, DataFrame]:
    """P5: raw records, and the files' section, year and source.

    Text is brought to NFC once; the repeated cleaning that the format asks for works on that.
    Documents whose best pattern gives nothing go to the line parser, those that it leaves empty to the last resort;
    each step only reads the documents left over, by anti-joins on doc_id. What several branches read is kept (memory, then
    disk); lost blocks are computed again from the input."""
    cleaned = texts.withColumn("text", clean(F.col("text"), normalise))
    lines = merge_short_lines(split_lines(cleaned, normalise=False)).persist()  # NFC already; three branches read the lines
    joined = joined_text(lines)
    files = cleaned.select("doc_id", section(F.col("text"), F.col("file_name")).alias("section"), file_year(F.col("file_name")).alias("year"), F.col("file_name").alias("source"))
    found = adaptive_questions(joined)
    if answer_aware:
        marked = answer_anchored(joined).withColumns({"explanation": F.lit(""), "pattern": F.lit("回答アンカー形式"), "extraction_method": F.lit(None).cast("string"), "line_index": F.lit(None).cast("int"), "choices": F.array().cast("array<struct<number:string,text:string,format:string>>")})
        found = marked.select(RAW_COLUMNS)
    found = found.persist()
    left = lines.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    # the line parser finalises its records once itself
    by_lines = fallback_questions(left).join(files.select("doc_id", "section"), "doc_id")
    by_lines = finalize(by_lines.withColumns({"answer_guessed": F.lit(False), "explanation_generated": F.lit(False)}), normalise=False).drop("quality", "section").persist()
    rest = left.join(by_lines.select("doc_id").distinct(), "doc_id", "left_anti")
    fresh = lambda df: df.withColumns({"answer_guessed": F.lit(False), "explanation_generated": F.lit(False)})
    columns = [*RAW_COLUMNS, "answer_guessed", "explanation_generated"]
    raw = fresh(found).select(columns).unionByName(by_lines.select(columns)).unionByName(fresh(emergency_questions(rest)).select(columns))
    raw._kept = [lines, found, by_lines]
    return raw, files


def release(records: DataFrame) -> None:
    """Give back what a record pipeline keeps for its branches, once its records are written or gathered."""
    for df in getattr(records, "_kept", []):
        df.unpersist()


def post_process(raw: DataFrame, files: DataFrame, min_confidence: float = 0) -> DataFrame:
    """Finalise, filter, dedup. Rows carry (doc_id, question_number, id) to be sorted by."""
    done = finalize(raw.join(files, "doc_id"), normalise=False)
    valid = where_once(done, lambda r: is_valid(r["question_number"], r["question"], r["confidence"], min_confidence))
    out = dedup_questions(valid).select(RESULT_COLUMNS)
    out._kept = getattr(raw, "_kept", [])
    return out


def parse_questions(texts: DataFrame, min_confidence: float = 0, normalise: bool = True, answer_aware: bool = False) -> DataFrame:
    """Path A from text to records. answer_aware keeps printed marks instead of guessing every answer.

    Lines and raw records stay in memory or on disk for the session's later actions until `release` is called."""
    return post_process(*raw_questions(texts, normalise, answer_aware), min_confidence)
