"""Answer guess, explanation templates and the weighted quality of a question record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EXPLANATION_HINTS, EXPLANATIONS, NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS, QUALITY_WEIGHTS
from . import compat as C
from .cleaning import clamp, clean_explanation, clean_question


def guess_answer(text: Column) -> Column:
    """Keyword occurrences for and against, with a bonus for questions and one for negation."""
    lower = F.lower(text)
    any_of = lambda *words: reduce(lambda a, b: a | b, [lower.contains(w) for w in words]).cast("int")
    up = sum((C.count(lower, k) for k in POSITIVE_KEYWORDS), any_of("か。", "でしょうか", "ですか"))
    down = sum((C.count(lower, k) for k in NEGATIVE_KEYWORDS), any_of("ない"))
    return F.when(up > down, F.lit("〇")).otherwise(F.lit("×"))


def generate_explanation(text: Column, answer: Column, section: Column) -> Column:
    """A template by section and answer, and one hint by keyword."""
    yes = answer == "〇"
    pick = lambda pair: F.when(yes, F.lit(pair[0])).otherwise(F.lit(pair[1]))
    body = reduce(lambda out, kv: F.when(section == kv[0], pick(kv[1])).otherwise(out), EXPLANATIONS.items(), pick(EXPLANATIONS["税・その他"]))
    hint = reduce(lambda out, kv: F.when(text.contains(kv[0]), F.lit(kv[1])).otherwise(out), reversed(EXPLANATION_HINTS), F.lit(""))
    return F.concat(body, hint)


def _steps(n: Column, steps: list[tuple[int, float]], rest: float) -> Column:
    return C.let(n, lambda n: reduce(lambda out, s: F.when(n < s[0], F.lit(s[1])).otherwise(out), reversed(steps), F.lit(rest)))


def question_length_score(text: Column) -> Column:
    return _steps(C.length(text), [(1, 0.0), (10, 0.1), (20, 0.3), (50, 0.7), (200, 1.0), (500, 0.9)], 0.6)


def choice_count_score(choices: Column) -> Column:
    n = F.size(choices)
    return F.when(n == 0, F.lit(0.5)).when(n.between(2, 5), F.lit(1.0)).when(n == 1, F.lit(0.3)).otherwise(F.lit(0.2))


def choice_quality_score(choices: Column) -> Column:
    one = lambda c: F.when(C.length(c["text"]) > 15, F.lit(0.8)).when(C.length(c["text"]) > 5, F.lit(0.5)).otherwise(F.lit(0.0))
    total = F.aggregate(choices, F.lit(0.0), lambda acc, c: acc + one(c))
    return F.when(F.size(choices) == 0, F.lit(0.5)).otherwise(total / F.size(choices))


def answer_score(answer: Column) -> Column:
    return F.when(F.coalesce(answer, F.lit("")) == "", F.lit(0.0)).when(answer.rlike("^[〇×①②③④⑤1-5アイウエオ]$"), F.lit(1.0)).otherwise(F.lit(0.5))


def explanation_score(text: Column) -> Column:
    return _steps(C.length(text), [(1, 0.0), (10, 0.2), (30, 0.5), (100, 0.8), (300, 1.0)], 0.9)


def format_score(number: Column, choices: Column) -> Column:
    """Choice numbers are characters, so several choices never count as a sequence."""
    return F.when(number.between(1, 100), F.lit(0.3)).otherwise(F.lit(0.0)) + F.when(F.size(choices) > 1, F.lit(0.2)).otherwise(F.lit(0.4))


def quality(number: Column, text: Column, choices: Column, answer: Column, explanation: Column) -> Column:
    """struct(total_score, confidence, details)."""
    parts = {
        "question_length": question_length_score(text),
        "choice_count": choice_count_score(choices),
        "choice_quality": choice_quality_score(choices),
        "answer_presence": answer_score(answer),
        "explanation_quality": explanation_score(explanation),
        "format_consistency": format_score(number, choices),
    }
    total = reduce(lambda acc, k: acc + parts[k] * QUALITY_WEIGHTS[k], parts, F.lit(0.0))
    return F.struct(F.least(total, F.lit(1.0)).alias("total_score"), F.floor(total * 100 + 0.5).cast("int").alias("confidence"), F.struct(*(v.alias(k) for k, v in parts.items())).alias("details"))


def adjust_confidence(base: Column, total: Column) -> Column:
    """E5."""
    return F.least(F.greatest(base * (0.5 + total * 0.5), base * 0.7), base * 1.3)


def finalize(df: DataFrame, normalise: bool = True) -> DataFrame:
    """E3 over columns question_number, question, choices, answer, explanation, section, confidence, answer_guessed,
    explanation_generated; adds quality. Applying it twice multiplies the quality in twice, as the line parser does."""
    missing = F.coalesce("answer", F.lit("")) == ""
    df = df.withColumns({"answer": F.when(missing, guess_answer(F.col("question"))).otherwise(F.col("answer")), "confidence": F.when(missing, F.col("confidence") - 20).otherwise(F.col("confidence")), "answer_guessed": F.col("answer_guessed") | missing})
    bare = F.coalesce("explanation", F.lit("")) == ""
    df = df.withColumns({"explanation": F.when(bare, generate_explanation(F.col("question"), F.col("answer"), F.col("section"))).otherwise(F.col("explanation")), "explanation_generated": F.col("explanation_generated") | bare})
    df = df.withColumns({"question": clean_question(F.col("question"), normalise), "explanation": clean_explanation(F.col("explanation"), normalise)})
    df = df.withColumn("quality", quality(*(F.col(c) for c in ("question_number", "question", "choices", "answer", "explanation"))))
    return df.withColumn("confidence", clamp(adjust_confidence(F.col("confidence"), F.col("quality.total_score")), 0, 95))
