"""Pattern detection over whole texts and the choice of the best pattern per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ANCHORED, COMPLETE_PATTERN, MAX_NUMBER, MIN_PATTERN_SCORE, QUESTION_PATTERNS
from ..functions import compat as C
from ..functions.detect import choices, is_valid_basic


_MARKS = "×〇○"


def _to_last_mark(text: Column) -> Column:
    """The text up to its last mark; empty if it holds none."""
    back = F.reverse(text)
    ends = [F.nullif(F.position(F.lit(m), back), F.lit(0)) for m in _MARKS]
    return F.coalesce(F.substring(text, F.lit(1), F.length(text) - F.least(*ends) + 1), F.lit(""))


def _found(text: Column, pattern: str, flags: str) -> Column:
    """array<struct(n, t)>: number and trimmed text of every match, in time linear in the text.

    A pattern that is tied to the text's beginning matches once at most. One that needs a mark at its end is sought before
    the last mark only: behind it every number would look for a mark as far as the text goes. Other matches are marked by
    control characters, which cleaned text does not hold, and cut out by them, so that the pattern runs once; where a text
    does hold such, it runs once a group."""
    java = C.to_java(pattern, flags)
    row = lambda n, t: F.struct(n.try_cast("int").alias("n"), C.trim(t).alias("t"))
    if pattern.startswith("^") and "m" not in flags:
        return C.let(F.regexp_extract(text, java, 1), lambda n: F.when(n != "", F.array(row(n, F.regexp_extract(text, java, 2)))).otherwise(F.array().cast("array<struct<n:int,t:string>>")))
    each = lambda s, p: F.arrays_zip(*(F.regexp_extract_all(s, F.lit(p), F.lit(k)).alias(c) for k, c in ((1, "n"), (2, "t"))))

    def pairs(text: Column) -> Column:
        marked = lambda m: each(m, "\x01([^\x02]*)\x02([^\x03]*)\x03")
        return F.when(text.rlike("[\x01-\x03]"), each(text, java)).otherwise(C.let(F.regexp_replace(text, java, "\x01$1\x02$2\x03"), marked))

    found = C.let(_to_last_mark(text), pairs) if pattern.endswith(f"([{_MARKS}])") else pairs(text)
    return F.transform(found, lambda z: row(z["n"], z["t"]))


def candidates(texts: DataFrame) -> DataFrame:
    """(doc_id, pattern_idx, pattern, pattern_confidence, matches, rows, n_valid, score) for every pattern with
    a valid row; rows: array<struct(n, t)>.

    All patterns are expressions of one projection, so a text is scanned once a pattern and never joined."""
    results = []
    for i, (name, confidence, pattern, flags) in enumerate(QUESTION_PATTERNS):
        results.append(F.struct(F.lit(i).alias("pattern_idx"), F.lit(name).alias("pattern"), F.lit(confidence).alias("pattern_confidence"), _found(F.col("text"), pattern, flags).alias("all")))
    one = texts.select("doc_id", C.length(F.col("text")).alias("n_chars"), F.explode(F.array(*results)).alias("r")).select("doc_id", "n_chars", "r.*")
    valid = F.filter("all", lambda r: (r["n"] != 0) & (C.length(r["t"]) > 10) & is_valid_basic(r["n"], r["t"]))
    out = one.select("doc_id", "n_chars", "pattern_idx", "pattern", "pattern_confidence", F.size("all").alias("matches"), valid.alias("rows"))
    out = C.where_once(out, lambda r: F.size(r["rows"]) > 0).withColumn("n_valid", F.size("rows"))
    coverage = F.col("matches") * 50 / F.col("n_chars")
    score = F.col("n_valid") * 0.4 + (F.col("n_valid") / F.col("matches") * 100) * 0.3 + coverage * 0.2 + F.col("pattern_confidence") * 100 * 0.1
    return out.withColumn("score", F.least(score, F.lit(100.0))).drop("n_chars")


def best_pattern(found: DataFrame, threshold: float = MIN_PATTERN_SCORE) -> DataFrame:
    """D3: the highest score of each document, the earlier pattern on ties; none below the threshold."""
    top = found.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("pattern_idx")).alias("k"), "pattern_idx", "pattern", "pattern_confidence", "rows")).alias("b"))
    return top.where(F.col("b.score") >= threshold).select("doc_id", "b.score", "b.pattern_idx", "b.pattern", "b.pattern_confidence", "b.rows")


def adaptive_questions(texts: DataFrame) -> DataFrame:
    """Raw records of each document's best pattern; answers are never captured here."""
    rows = best_pattern(candidates(texts)).select("doc_id", "pattern", "pattern_confidence", F.posexplode("rows").alias("i", "r"))
    return rows.select(
        "doc_id",
        (F.col("i") + 1).alias("id"),
        F.col("r.n").alias("question_number"),
        F.col("r.t").alias("question"),
        F.lit(None).cast("string").alias("answer"),
        F.lit("").alias("explanation"),
        (F.col("pattern_confidence") * 100).alias("confidence"),
        choices(F.col("r.t")).alias("choices"),
        F.col("pattern"),
        F.lit(None).cast("string").alias("extraction_method"),
        F.lit(None).cast("int").alias("line_index"),
    )


def _anchored(text: Column) -> Column:
    """array<struct(n, t, a)>: number, text and mark of printed records."""
    java = F.lit(C.to_java(ANCHORED))
    return C.let(_to_last_mark(text), lambda head: F.arrays_zip(*(F.regexp_extract_all(head, java, F.lit(k)).alias(c) for k, c in ((1, "n"), (2, "t"), (3, "a")))))


def answer_anchored(texts: DataFrame) -> DataFrame:
    """Number, text and the mark that ends it, kept as the answer."""
    rows = texts.select("doc_id", F.posexplode(_anchored(F.col("text"))).alias("i", "r"))
    out = rows.select("doc_id", (F.col("i") + 1).alias("id"), F.col("r.n").try_cast("int").alias("question_number"), C.trim(F.col("r.t")).alias("question"), F.when(F.col("r.a") == "○", F.lit("〇")).otherwise(F.col("r.a")).alias("answer"), F.lit(95.0).alias("confidence"))
    return out.where(F.col("question_number").between(1, MAX_NUMBER) & (C.length(F.col("question")) > 5))


def complete_records(texts: DataFrame) -> DataFrame:
    """Number, year, text and answer, each found inside one number-to-mark segment, so that nothing backtracks
    beyond it."""
    rows = texts.select("doc_id", F.posexplode(_anchored(F.col("text"))).alias("i", "r"))
    year = F.regexp_extract("r.t", r"([RH]?\d{1,2})", 1)
    body = F.expr("substring(r.t, locate(regexp_extract(r.t, '([RH]?[0-9]{1,2})', 1), r.t) + length(regexp_extract(r.t, '([RH]?[0-9]{1,2})', 1)))")
    line = F.regexp_extract(body, r"([^\n]{10,})", 1)
    out = rows.where(year != "").select("doc_id", (F.col("i") + 1).alias("id"), F.col("r.n").try_cast("int").alias("question_number"), year.alias("year"), C.trim(line).alias("question"), F.when(F.col("r.a") == "○", F.lit("〇")).otherwise(F.col("r.a")).alias("answer"), F.lit(COMPLETE_PATTERN[1] * 100).alias("confidence"))
    return out.where(F.col("question_number").between(1, MAX_NUMBER) & (C.length(F.col("question")) > 10))


def estimated_count(text: Column) -> Column:
    """A third of the different numbers from 1 to 100, 1 at least."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.greatest(F.lit(1.0), F.size(F.array_distinct(F.filter(numbers, lambda n: n.between(1, 100)))) / 3)


def volume_score(confidence: Column, coverage: Column, n: Column) -> Column:
    """The older score, confidence x coverage x ln(n + 1)."""
    return confidence * coverage * F.log(n + 1)


def pattern_confidence(base: Column, numbers: Column) -> Column:
    """The pattern's own confidence and 0.05 (any text is long enough), 0.1 more if the numbers are one sequence."""
    distinct = F.array_distinct(numbers)
    sequential = (F.size(distinct) == F.size(numbers)) & (F.array_max(numbers) - F.array_min(numbers) + 1 == F.size(numbers))
    return F.when(F.size(numbers) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), base + F.when(sequential, 0.1).otherwise(0.0) + 0.05))
