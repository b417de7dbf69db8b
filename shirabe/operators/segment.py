"""Ordered line machines: the fallback parser and the last-resort extraction, as window islands.

lines(doc_id, line_no, line). No line loop runs anywhere: a line that opens a record starts an island, the first answer
line and the explanation lines of an island are found by windows, and an island's text is one ordered fold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EMERGENCY_PATTERNS
from ..functions import compat as C
from ..functions.detect import answer, explanation, is_ignorable, is_valid_relaxed, question_number

RAW_COLUMNS = ["doc_id", "id", "question_number", "question", "answer", "explanation", "confidence", "choices", "pattern", "extraction_method", "line_index"]
NO_CHOICES = "array<struct<number:string,text:string,format:string>>"


def append_lines(first: Column, lines: Column, open_ends: tuple[str, ...] = ("。", " ")) -> Column:
    """C11: lines, none of them empty, joined to a text; a blank goes between unless what stands there is empty or ends openly.

    What stands before a line ends as the line before it does, so each line finds its separator by itself and all are joined
    at once."""
    closed = lambda before: reduce(lambda a, b: a | b, [before.endswith(e) for e in open_ends], before == "")
    joined = lambda all_: F.array_join(F.transform(all_, lambda x, i: F.when((i == 0) | closed(F.get(all_, i - 1)), x).otherwise(F.concat(F.lit(" "), x))), "")
    return C.let(F.concat(F.array(first), lines), joined)


def line_kinds(line: Column) -> list[Column]:
    """What a line may be for the fallback parser: a number (q), an answer (a), an explanation (e), or text unless ignorable."""
    return [question_number(line).alias("q"), answer(line).alias("a"), explanation(line).alias("e"), is_ignorable(line).alias("ignorable")]


def fallback_questions(lines: DataFrame, min_confidence: float = 0) -> DataFrame:
    """Raw records; every line is, in this order, a number, the record's first answer, an explanation or text."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.select("doc_id", "line_no", (F.row_number().over(order) - 1).alias("line_index"), "line", question_number(F.col("line")).alias("q"))
    rows = rows.withColumn("island", F.sum(F.col("q").isNotNull().cast("int")).over(order)).where("island > 0")
    rows = rows.withColumn("a", F.when(F.col("q").isNull(), answer(F.col("line"))))
    within = Window.partitionBy("doc_id", "island").orderBy("line_no")
    rows = rows.withColumn("is_answer", F.col("a").isNotNull() & (F.sum(F.col("a").isNotNull().cast("int")).over(within) == 1))
    rows = rows.withColumn("e", F.when(F.col("q").isNull() & ~F.col("is_answer"), explanation(F.col("line"))))
    is_text = F.col("q").isNull() & ~F.col("is_answer") & F.col("e").isNull() & ~is_ignorable(F.col("line"))
    made = rows.groupBy("doc_id", F.col("island").alias("id")).agg(
        F.max(F.when(F.col("q").isNotNull(), F.struct("q.number", "q.text", "q.pattern", "line_index"))).alias("q"),
        F.max(F.when(F.col("is_answer"), F.col("a"))).alias("answer"),
        F.max(F.when(F.col("e").isNotNull(), F.struct("line_no", "e"))).alias("e"),
        F.count("e").alias("n_e"),
        F.array_sort(F.collect_list(F.when(is_text, F.struct("line_no", "line")))).alias("parts"),
    )
    return finished(made.withColumns({"e": F.col("e.e"), "parts": F.transform("parts", lambda p: p["line"])}), min_confidence)


def finished(made: DataFrame, min_confidence: float = 0) -> DataFrame:
    """Raw records from what lines gave them: doc_id, id, q(number, text, pattern, line_index), answer, e, n_e, parts."""
    out = made.select(
        "doc_id",
        F.col("id").cast("int"),
        F.col("q.number").alias("question_number"),
        append_lines(F.col("q.text"), F.col("parts")).alias("question"),
        "answer",
        F.coalesce("e", F.lit("")).alias("explanation"),
        (70.0 + F.when(F.col("answer").isNotNull(), 20).otherwise(0) + F.col("n_e") * 10).alias("confidence"),
        F.array().cast(NO_CHOICES).alias("choices"),
        F.col("q.pattern").alias("pattern"),
        F.lit("pattern_match").alias("extraction_method"),
        F.col("q.line_index").cast("int").alias("line_index"),
    )
    return C.where_once(out, lambda r: is_valid_relaxed(r["question_number"], r["question"], r["confidence"], min_confidence))


def emergency_questions(lines: DataFrame) -> DataFrame:
    """A small leading number and up to nine lines after it, to the next number that follows on."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    number = lambda c, p: F.regexp_extract(c, C.to_java(p), 1).try_cast("long")
    line = C.trim(F.col("line"))
    opens = F.coalesce(*(F.when(number(line, p).between(1, 999), F.struct(number(line, p).cast("int").alias("n"), C.trim(F.regexp_replace(line, C.to_java(p), "")).alias("t"))) for p in EMERGENCY_PATTERNS))
    numbers = F.array_compact(F.array(*(number(line, p) for p in EMERGENCY_PATTERNS)))
    skipped = (line == "") | C.matches(line, r"^(答え?|解答|解説|正解)[:：]", "i") | C.matches(line, r"^[〇○×]$") | (C.length(line) >= 200)
    rows = lines.select("doc_id", "line_no", (F.row_number().over(order) - 1).cast("int").alias("line_index"), line.alias("line"), F.when(C.length(line) >= 5, opens).alias("q"), numbers.alias("numbers"), skipped.alias("skipped"))
    rows = rows.withColumn("next", F.array_compact(F.array(*(F.lead(F.struct("line", "numbers", "skipped"), i).over(order) for i in range(1, 10))))).where("q is not null")
    n = F.col("q.n")
    step = lambda acc, x: F.when(acc["done"] | F.exists(x["numbers"], lambda m: (m > n) & (m <= n + 3)), F.struct(acc["t"].alias("t"), F.lit(True).alias("done"))).when(x["skipped"], acc).otherwise(F.struct(F.concat(acc["t"], F.lit(" "), x["line"]).alias("t"), F.lit(False).alias("done")))
    text = F.aggregate("next", F.struct(F.col("q.t").alias("t"), F.lit(False).alias("done")), step)["t"]
    made = rows.select("doc_id", "line_no", "line_index", n.alias("question_number"), text.alias("question")).where(C.length(F.col("question")) >= 10)
    return made.select(
        "doc_id",
        F.row_number().over(order).alias("id"),
        "question_number",
        "question",
        F.lit(None).cast("string").alias("answer"),
        F.lit("").alias("explanation"),
        F.lit(30.0).alias("confidence"),
        F.array().cast(NO_CHOICES).alias("choices"),
        F.lit("emergency_simple").alias("pattern"),
        F.lit("emergency_simple").alias("extraction_method"),
        "line_index",
    )
