"""The hierarchy parser: headings of four levels are filled forward to the questions below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_YEAR, HIERARCHY_HEADERS
from ..functions.cleaning import clean_plain
from ..functions.compat import where_once
from ..functions.detect import hier_answer, hier_question, hierarchy, is_ignorable, line_year
from .segment import append_lines

LEVELS = 4


def line_kinds(line: Column) -> dict[str, Column]:
    """What a trimmed line may be: a heading (h), a question (q0), an answer (a0), a year (y0), text (t) unless ignorable, or an
    explanation (says) with what stands behind the word (own)."""
    ignorable = is_ignorable(line, plain=True)
    rest = F.trim(F.substring(line, F.instr(line, "解説") + 2, F.length(line)))
    return {
        "h": F.when(line != "", hierarchy(line)),
        "q0": hier_question(line),
        "a0": hier_answer(line),
        "y0": line_year(line),
        "ignorable": ignorable,
        "t": F.when(~ignorable & (line != ""), line),
        "says": line.contains("解説"),
        "own": F.when(~rest.isin("", "】", "】："), rest),
    }


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, line), blank ones included, to one row a question.

    A heading consumes its line and clears the levels below it; a question keeps the headings before it. Then a line is
    the question's first year, its first answer, an explanation, or more text. An explanation also takes the lines
    that follow up to the next question, answer or blank line, and these remain text as well."""
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.select("doc_id", "line_no", F.trim("line").alias("line"))
    rows = rows.withColumns(line_kinds(F.col("line")))
    # level by level: the last value since the last heading above it
    rows = rows.withColumn("g0", F.lit(0))
    for k in range(1, LEVELS + 1):
        own = Window.partitionBy("doc_id", f"g{k - 1}").orderBy("line_no")
        rows = rows.withColumn(f"v{k}", F.coalesce(F.last(F.when(F.col("h.level") == k, F.col("h.value")), ignorenulls=True).over(own), F.lit("")))
        rows = rows.withColumn(f"g{k}", F.coalesce(F.sum((F.col("h.level") <= k).cast("int")).over(doc), F.lit(0)))
    # an explanation takes the lines after it up to the next question, answer or blank line, which are its stretch
    stop = (F.col("line") == "") | F.col("q0").isNotNull() | F.col("a0").isNotNull()
    rows = rows.withColumn("stretch", F.sum(stop.cast("int")).over(doc))
    later = Window.partitionBy("doc_id", "stretch").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("e", F.when(F.col("says") & (F.col("own").isNotNull() | (F.count("t").over(later) > 0)), F.struct("line_no", "stretch", "own")))
    rows = rows.withColumn("q", F.when(F.col("h").isNull() & (F.col("line") != ""), F.col("q0")))
    rows = rows.withColumn("island", F.sum(F.col("q").isNotNull().cast("int")).over(doc)).where("island > 0")
    plain = F.col("h").isNull() & (F.col("line") != "")  # headings and blank lines count for explanations only
    within = Window.partitionBy("doc_id", "island").orderBy("line_no")
    first = lambda c: c & (F.sum(c.cast("int")).over(within) == 1)
    rows = rows.withColumn("y", F.when(plain & F.col("q").isNull(), F.col("y0")))
    rows = rows.withColumn("is_year", first(F.col("y").isNotNull()))
    rows = rows.withColumn("a", F.when(plain & F.col("q").isNull() & ~F.col("is_year"), F.col("a0")))
    rows = rows.withColumn("is_answer", first(F.col("a").isNotNull()))
    other = plain & F.col("q").isNull() & ~F.col("is_year") & ~F.col("is_answer") & ~F.col("ignorable")
    made = rows.groupBy("doc_id", "island").agg(
        F.max(F.when(F.col("q").isNotNull(), F.struct("q.number", "q.text", *(f"v{k}" for k in range(1, LEVELS + 1))))).alias("q"),
        F.max(F.when(F.col("is_year"), F.col("y"))).alias("year"),
        F.max(F.when(F.col("is_answer"), F.col("a"))).alias("answer"),
        F.max(F.when(other, F.col("e"))).alias("e"),
        F.collect_list(F.when(F.col("t").isNotNull(), F.struct("line_no", "stretch", "t"))).alias("lines"),
        F.array_sort(F.collect_list(F.when(other & ~F.col("says"), F.struct("line_no", "line")))).alias("parts"),
    )
    # of the island's lines those that the last explanation takes
    taken = F.transform(F.array_sort(F.filter("lines", lambda p: (p["stretch"] == F.col("e.stretch")) & (p["line_no"] > F.col("e.line_no")))), lambda p: p["t"])
    explained = F.when(F.col("e").isNotNull(), F.concat(F.array_compact(F.array("e.own")), taken))
    return finished(made.select("doc_id", F.col("island").cast("int").alias("seq"), "q", "year", "answer", explained.alias("explained"), F.transform("parts", lambda p: p["line"]).alias("parts")))


def finished(made: DataFrame) -> DataFrame:
    """Records from what lines gave them: doc_id, seq, q(number, text, v1 to v4), year, answer, explained, parts."""
    text = append_lines(F.col("q.text"), F.col("parts"), open_ends=("。",))
    explanation = F.coalesce(F.trim(F.array_join("explained", " ")), F.lit(""))
    values = [*(F.col(f"q.v{k}") for k in range(1, LEVELS + 1)), F.col("q.number"), F.coalesce("year", F.lit(DEFAULT_YEAR)), text, explanation, F.coalesce("answer", F.lit("×"))]
    out = made.select("doc_id", "seq", *(v.alias(n) for v, n in zip(values, HIERARCHY_HEADERS, strict=True)))
    return where_once(out, lambda r: r["問題"] != "")


def parse_texts(texts: DataFrame, literal: bool = False) -> DataFrame:
    """Path B over texts(doc_id, text). literal: cleaning joins all lines into one first, as the plain cleaner does."""
    rows = texts.select("doc_id", clean_plain(F.col("text"), keep_newlines=not literal).alias("text"))
    return parse_lines(rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")))
