"""Cleaning and formatting scalars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CONTROL, ENCODING_FIXES, HIER_KEEP, JAPANESE_LETTERS, LEADING_EXPLANATION, LEADING_MARKS, LEADING_NOTE, LEADING_NUMBER, NORMALIZATIONS, RUN
from . import compat as C


def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def nfc(c: Column) -> Column:
    """Unicode NFC; Spark has no such function, so this is the one Arrow UDF of the library. Looking for texts that may change
    by a regular expression first takes longer than sending all."""
    return F.pandas_udf(_nfc, "string")(c)


def fix_encoding(c: Column, normalise: bool = True) -> Column:
    """Repair mojibake marks and control characters. normalise=False: the text is NFC already."""
    c = nfc(c) if normalise else c
    for wrong, right in ENCODING_FIXES + NORMALIZATIONS:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    c = F.regexp_replace(c, CONTROL, " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n")
    return F.regexp_replace(c, r"[ \t]{2,}", " ")


def clean(c: Column, normalise: bool = True) -> Column:
    """Repaired text, lines trimmed, empty ones dropped, brackets and digits half-width."""
    c = fix_encoding(c, normalise)
    c = F.regexp_replace(c, "　{2,}", "　")
    c = F.array_join(F.filter(F.transform(F.split(c, "\n"), C.trim), lambda x: x != ""), "\n")
    return C.half_digits(F.translate(c, "～·（）", "〜・()"))


def clean_question(c: Column, normalise: bool = True) -> Column:
    """Without leading numbers and bullets; short lines are glued to the line before, the rest joined by a blank."""
    c = clean(c, normalise)
    c = F.regexp_replace(c, C.to_java(LEADING_NUMBER, "m"), "")
    c = F.regexp_replace(c, C.to_java(LEADING_MARKS, "m"), "")
    def glue(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: C.trim(x) != "")
        parts = F.transform(lines, lambda x, i: F.when((i == 0) | (C.length(x) < 20), x).otherwise(F.concat(F.lit(" "), x)))
        return C.let(parts, lambda p: C.trim(F.when(F.size(p) > 1, F.array_join(p, "")).otherwise(text)))

    return C.let(c, glue)


def clean_explanation(c: Column, normalise: bool = True) -> Column:
    """C4: without the introducing word and one leading mark."""
    c = F.regexp_replace(clean(c, normalise), C.to_java(LEADING_EXPLANATION), "")
    return C.trim(F.regexp_replace(c, C.to_java(LEADING_NOTE), ""))


def text_quality(c: Column) -> Column:
    """struct(score, japanese_ratio, garbled, controls, repeats, n_chars, runs); empty text scores 0."""
    n = C.length(c)
    garbled = F.regexp_count(c, F.lit("[\uFFFD?]"))
    controls = F.regexp_count(c, F.lit(CONTROL))
    ratio = F.coalesce(F.regexp_count(c, F.lit(JAPANESE_LETTERS)) / n, F.lit(0.0))
    runs = F.coalesce(F.regexp_extract_all(c, F.lit(RUN), F.lit(0)), F.array().cast("array<string>"))
    repeats = F.size(runs)
    score = 100 - F.when(n < 10, 30).otherwise(0) - garbled * 5 - controls * 3 - F.when(ratio < 0.3, 20).otherwise(0) - repeats * 10
    empty = F.coalesce(c, F.lit("")) == ""
    zero = lambda x: F.when(empty, F.lit(0)).otherwise(x)
    return F.struct(zero(F.greatest(F.lit(0), F.least(F.lit(100), score))).cast("int").alias("score"), F.when(empty, F.lit(0.0)).otherwise(ratio).alias("japanese_ratio"), zero(garbled).alias("garbled"), zero(controls).alias("controls"), zero(repeats).alias("repeats"), zero(n).alias("n_chars"), runs.alias("runs"))


def quality_issues(q: Column) -> Column:
    """Messages for a text_quality struct."""
    when = F.when
    return F.when(q["n_chars"] == 0, F.array(F.lit("テキストが空"))).otherwise(
        F.array_compact(
            F.array(
                when(q["n_chars"] < 10, F.lit("テキストが短すぎる")),
                when(q["garbled"] > 0, F.concat(F.lit("文字化け文字が"), q["garbled"], F.lit("個"))),
                when(q["controls"] > 0, F.concat(F.lit("制御文字が"), q["controls"], F.lit("個"))),
                when(q["japanese_ratio"] < 0.3, F.lit("日本語文字の比率が低い")),
                when(q["repeats"] > 0, F.concat(F.lit("連続する同じ文字: "), F.array_join(q["runs"], ", "))),
            )
        )
    )


def clean_plain(c: Column, keep_newlines: bool = True) -> Column:
    """Half-width digits, only listed characters, white space collapsed (each line's own if newlines stay)."""
    c = F.regexp_replace(C.half_digits(c), "(?U)" + HIER_KEEP, "")
    if not keep_newlines:
        return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(lines, "\n")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance as a part of the longer text; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def truncate(c: Column, n: int, suffix: str = "…") -> Column:
    """At most n code points, the suffix included."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - len(suffix)), F.lit(suffix)))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_csv(c: Column) -> Column:
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def format_date(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, pattern)


def format_file_size(b: Column, to_even: bool = False) -> Column:
    """1024-based, two decimals at most. What lies halfway between two hundredths goes up, or to the even one, as SQL's
    printf has it."""
    step = sum((F.when(b >= 1024**i, 1).otherwise(0) for i in range(2, 5)), F.when(b >= 1024, 1).otherwise(0))
    unit = F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB", "TB"))), step + 1)
    value = b / F.pow(F.lit(1024.0), step)
    digits = F.regexp_replace(F.format_string("%.2f", F.bround(value, 2) if to_even else value), r"\.?0+$", "")
    return F.when(b == 0, F.lit("0 Bytes")).when(b.isNotNull(), F.concat(digits, F.lit(" "), unit))


def percentage(part: Column, total: Column, precision: int = 1) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / total, precision))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def file_extension(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"\.([^.]+)$", 1)


def chunk_of(index: Column, size: int) -> Column:
    """C20: the fixed-size chunk that a position falls into."""
    return F.floor(index / size).cast("int")


def nested(c: Column, path: str, default: Column | None = None) -> Column:
    """The field at a dotted path, the default where it or anything above it is null."""
    for name in path.split("."):
        c = c.getField(name)
    return c if default is None else F.coalesce(c, default)


def with_nested(c: Column, path: str, value: Column) -> Column:
    """The struct with the field at a dotted path set."""
    return c.withField(path, value)
