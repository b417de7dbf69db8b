"""Detectors of numbers, answers, explanations, choices, sections and years."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ANSWER_PATTERNS, CHOICE_PATTERNS, CIRCLED, DEFAULT_YEAR, EXPLANATION_PATTERNS, HIER_ANSWER_PATTERNS, HIER_IGNORABLE, HIER_QUESTION_PATTERNS, HIER_YEAR_PATTERNS, HIERARCHY_PATTERNS, IGNORABLE, IGNORABLE_BELOW, KATAKANA_NUMBERS, MAX_NUMBER, NEGATIVE_KEYWORDS, OTHER_SECTION, POSITIVE_KEYWORDS, QUESTION_PATTERNS, SECTIONS, SIMPLE_NUMBER_PATTERNS
from . import compat as C

_JAPANESE = r"[\u3040-\u309F\u30A0-\u30FF\u4E00-\u9FAF]"


def question_number(line: Column) -> Column:
    """struct(number, text, pattern) of the first pattern that fits the line's start, else null."""
    patterns = [*((n, C.to_java("^" + p.removeprefix("^"), "i")) for n, _, p, _ in QUESTION_PATTERNS), *(("simple_number", C.to_java(p)) for p in SIMPLE_NUMBER_PATTERNS)]

    def options(x: Column) -> Column:
        found = lambda name, java: C.let(
            C.number(F.nullif(F.regexp_extract(x, java, 1), F.lit(""))),
            lambda n: F.when(n.between(1, MAX_NUMBER), F.struct(n.alias("number"), C.trim(F.regexp_extract(x, java, 2)).alias("text"), F.lit(name).alias("pattern"))),
        )
        return F.coalesce(*(found(*p) for p in patterns))

    return C.let(line, options)


def answer(line: Column) -> Column:
    """The answer mark of a line; configured patterns keep it as written, a mark anywhere counts too."""
    loose = C.group(line, "([〇○×])")
    return F.coalesce(*(C.group(line, p, 1, "i") for _, _, _, p in ANSWER_PATTERNS), F.when(loose == "○", F.lit("〇")).otherwise(loose))


def explanation(line: Column) -> Column:
    """The text behind an introducing word."""
    return F.coalesce(*(F.when(C.matches(line, p, "i"), C.trim(F.regexp_extract(line, C.to_java(p, "i"), 1))) for p in EXPLANATION_PATTERNS))


def choices(text: Column) -> Column:
    """array<struct(number, text, format)> of the first form with two matches and a text longer than three."""
    empty = F.array().cast("array<struct<number:string,text:string,format:string>>")

    def rows(whole: Column, body: Column, name: str) -> Column:
        return F.transform(F.arrays_zip(whole.alias("w"), body.alias("b")), lambda z: F.struct(F.substring(z["w"], 1, 1).alias("number"), C.trim(z["b"]).alias("text"), F.lit(name).alias("format")))

    out = empty
    for name, _, pattern in reversed(CHOICE_PATTERNS[1:]):
        java = F.lit(C.to_java(pattern, "m"))
        whole = F.regexp_extract_all(text, java, F.lit(0))
        # the form in brackets has its digit, not its text, in the first group
        good = F.filter(rows(whole, F.regexp_extract_all(text, java, F.lit(1)), name), lambda r: C.length(r["text"]) > 3)
        out = F.when((F.size(whole) >= 2) & (F.size(good) > 0), good).otherwise(out)
    return F.coalesce(out, empty)


def all_choices(text: Column) -> Column:
    """array<struct(number, symbol, text, pattern, confidence)> of the first form that occurs at all."""
    kind = "array<struct<number:int,symbol:string,text:string,pattern:string,confidence:double>>"
    name, confidence, _ = CHOICE_PATTERNS[0]
    # a circled number opens a choice; later lines of text continue it. Each line says by itself how it goes on, so that one
    # join and one split at the openings give the choices; the characters that mark them are escaped in the lines.
    lines = F.filter(F.transform(F.split(text, "\n"), C.trim), lambda x: x != "")
    start = rf"^([{CIRCLED}])\s*(.+)"
    escape = lambda x: F.replace(F.replace(x, F.lit("\x02"), F.lit("\x02b")), F.lit("\x01"), F.lit("\x02a"))
    clear = lambda x: F.replace(F.replace(x, F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02"))
    opened = lambda x: F.concat(F.lit("\x01"), F.substring(x, 1, 1), F.regexp_extract(x, C.to_java(start), 2))
    joined = F.array_join(F.transform(lines, lambda x: C.let(escape(x), lambda e: F.when(C.matches(e, start), opened(e)).otherwise(F.concat(F.lit(" "), e)))), "")
    pieces = F.split(joined, "\x01")

    def choice(piece: Column) -> Column:
        symbol = F.substring(piece, 1, 1)
        return F.struct(F.position(symbol, F.lit(CIRCLED)).alias("number"), symbol.alias("symbol"), clear(F.substring(piece, F.lit(2), F.length(piece))).alias("text"), F.lit(name).alias("pattern"), F.lit(confidence).alias("confidence"))

    circled = C.let(pieces, lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), choice)).cast(kind)

    def form(name: str, confidence: float, pattern: str, bracket: bool) -> Column:
        java = F.lit(C.to_java(pattern, "m"))

        def row(z: Column) -> Column:
            symbol = F.substring(z["w"], 2 if bracket else 1, 1)
            value = F.coalesce(symbol.try_cast("int"), F.position(symbol, F.lit(KATAKANA_NUMBERS)))
            shown = F.concat(F.lit("("), symbol, F.lit(")")) if bracket else symbol
            return F.struct(value.alias("number"), shown.alias("symbol"), C.trim(z["b"]).alias("text"), F.lit(name).alias("pattern"), F.lit(confidence).alias("confidence"))

        pairs = F.arrays_zip(F.regexp_extract_all(text, java, F.lit(0)).alias("w"), F.regexp_extract_all(text, java, F.lit(2 if bracket else 1)).alias("b"))
        return F.transform(pairs, row).cast(kind)

    forms = [form(n, c, p, i == 2) for i, (n, c, p) in enumerate(CHOICE_PATTERNS[1:])]
    none = F.array().cast(kind)
    either = lambda rest: lambda own: F.when(F.size(own) > 0, own).otherwise(rest)
    return F.coalesce(reduce(lambda rest, f: C.let(f, either(rest)), [circled, *forms][::-1], none), none)


def is_valid_basic(number: Column, text: Column) -> Column:
    """D9."""
    return (number >= 1) & (C.length(text) >= 20) & text.rlike(_JAPANESE)


def is_valid(number: Column, text: Column, confidence: Column, min_confidence: float = 0) -> Column:
    """D10."""
    return F.coalesce((text != "") & number.between(1, MAX_NUMBER) & (confidence >= min_confidence), F.lit(False))


def is_valid_relaxed(number: Column, text: Column, confidence: Column, min_confidence: float = 0) -> Column:
    """D11."""
    return F.coalesce((C.length(C.trim(text)) >= 5) & number.between(1, MAX_NUMBER) & (confidence >= min(min_confidence, 50)), F.lit(False))


def is_ignorable(line: Column, plain: bool = False) -> Column:
    """Too short, digits or glyphs alone, headers and footers; plain: the hierarchy parser's rules."""
    if plain:
        return reduce(lambda a, p: a | line.rlike("(?U)" + p), HIER_IGNORABLE, F.length(line) < IGNORABLE_BELOW)
    return reduce(lambda a, p: a | C.matches(line, p), IGNORABLE, C.length(line) < IGNORABLE_BELOW)


def section_from_file(name: Column) -> Column:
    """By keyword, else by a number range in the name; null if neither."""
    lower = F.lower(name)
    start, end = (F.regexp_extract(name, r"(\d+)[-_～〜](\d+)", k).try_cast("long") for k in (1, 2))
    by_word = [F.when(reduce(lambda a, b: a | b, [lower.contains(k.lower()) for k in words]), F.lit(s)) for s, words, _ in SECTIONS]
    by_range = [F.when((start >= lo) & (end <= hi), F.lit(s)) for s, _, (lo, hi) in SECTIONS]
    return F.coalesce(*by_word, *by_range)


def section_from_text(text: Column) -> Column:
    """Most keyword occurrences, the later section on ties; null if none."""
    counts = [sum((C.count(text, k) for k in words[1:]), C.count(text, words[0])) for _, words, _ in SECTIONS]
    best = F.array_max(F.array(*(F.struct(c.alias("n"), F.lit(i).alias("i")) for i, c in enumerate(counts))))
    return F.when(best["n"] > 0, F.element_at(F.array(*(F.lit(s) for s, _, _ in SECTIONS)), best["i"] + 1))


def section_from_number(average: Column) -> Column:
    """D15 as intended: the section whose range holds the average question number."""
    return F.coalesce(*(F.when(average.between(lo, hi), F.lit(s)) for s, _, (lo, hi) in SECTIONS))


def section(text: Column, name: Column, average: Column | None = None) -> Column:
    """File name, then content, then (as intended only) question numbers."""
    return F.coalesce(section_from_file(name), section_from_text(text), *([section_from_number(average)] if average is not None else []), F.lit(OTHER_SECTION))


def file_year(name: Column, default: str | None = DEFAULT_YEAR) -> Column:
    """Era year of a file name."""
    era = lambda letter, word: F.concat(F.lit(letter), F.coalesce(*(C.number(F.nullif(F.regexp_extract(name, rf"[{letter}{letter.lower()}](\d+)|{word}(\d+)", k), F.lit(""))) for k in (1, 2))).cast("string"))
    west = C.number(F.nullif(F.regexp_extract(name, r"20(\d{2})", 1), F.lit("")))
    return F.coalesce(era("R", "令和"), era("H", "平成"), F.when(west >= 19, F.concat(F.lit("R"), (west - 18).cast("string"))), F.lit(default))


def line_year(line: Column) -> Column:
    """Era year of a line, by the first pattern that gives one."""
    options = []
    for kind, pattern in HIER_YEAR_PATTERNS:
        y = C.number(C.half_digits(F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))))
        text = lambda letter, v: F.concat(F.lit(letter), v.cast("string"))
        options.append({"R": text("R", y), "H": text("H", y), "年": F.when(y.between(1, 6), text("R", y)).when(y.between(1, 31), text("H", y)), "20": F.when(y >= 19, text("R", y - 18)).otherwise(text("H", y + 12))}[kind])
    return F.coalesce(*options)


def hier_question(line: Column) -> Column:
    """struct(number, text) of a line that starts a question numbered 1 to 1000."""
    options = []
    for p in HIER_QUESTION_PATTERNS:
        n = C.half_digits(F.regexp_extract(line, "(?U)" + p, 1))
        options.append(F.when(n.try_cast("int").between(1, 1000), F.struct(n.alias("number"), F.trim(F.regexp_extract(line, "(?U)" + p, 2)).alias("text"))))
    return F.coalesce(*options)


def hier_answer(line: Column) -> Column:
    """〇 or ×."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(line, "(?U)" + p, 1), F.lit("")) for p in HIER_ANSWER_PATTERNS))
    return F.when(found == "○", F.lit("〇")).otherwise(found)


def hierarchy(line: Column) -> Column:
    """struct(level 1 to 4, value) of the first level whose pattern occurs in the line."""
    options = []
    for level, (_, patterns) in enumerate(HIERARCHY_PATTERNS, 1):
        for p in patterns:
            java = "(?iuU)" + p
            value = F.trim(F.regexp_extract(line, java, 1)) if "(" in p else F.trim(line)
            options.append(F.when(line.rlike(java), F.struct(F.lit(level).alias("level"), value.alias("value"))))
    return F.coalesce(*options)


def normalise_answer(mark: Column, kind: Column, n_choices: Column) -> Column:
    """〇 or × for marks, the glyph itself for a choice that exists, else null."""
    number = F.coalesce(F.nullif(F.position(mark, F.lit(CIRCLED[:5])), F.lit(0)), F.nullif(F.position(mark, F.lit(KATAKANA_NUMBERS)), F.lit(0)), F.when(mark.rlike("^[1-5]$"), mark.try_cast("int")))
    return F.when(kind == "correct_incorrect", F.when(mark.isin("〇", "○"), F.lit("〇")).when(mark == "×", mark)).when((kind == "multiple_choice") & (n_choices >= number), mark)


def keyword_answer(line: Column) -> Column:
    """Two kinds of keywords at least and a strict majority."""
    lower = F.lower(line)
    up, down = (sum((lower.contains(k).cast("int") for k in words[1:]), lower.contains(words[0]).cast("int")) for words in (POSITIVE_KEYWORDS, NEGATIVE_KEYWORDS))
    return F.when((up > down) & (up >= 2), F.lit("〇")).when((down > up) & (down >= 2), F.lit("×"))


def best_answer(text: Column, n_choices: Column) -> Column:
    """The first configured pattern whose mark can be normalised, else the keyword vote."""
    return F.coalesce(*(normalise_answer(C.group(text, p, 1, "i"), F.lit(kind), n_choices) for _, _, kind, p in ANSWER_PATTERNS), keyword_answer(text))
