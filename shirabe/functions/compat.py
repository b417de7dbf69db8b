"""String and regular-expression semantics of the record formats' dialect, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FULL_DIGITS, HALF_DIGITS

#: White space of the dialect, for use inside a character class.
SPACES = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def to_java(pattern: str, flags: str = "") -> str:
    """The pattern with the dialect's \\s, $ and flags in Java's notation."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if pattern.startswith(r"[\s\S]", i):
            out.append("(?s:.)")
            i += 6
        elif two == r"\s":
            out.append(SPACES if inside else f"[{SPACES}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            if two[0] == "[" and not inside:
                inside = True
            elif two[0] == "]":
                inside = False
            out.append(r"\z" if two[0] == "$" and not inside and "m" not in flags else two[0])
            i += 1
    own = "".join(f for f in "sim" if f in flags)
    return (f"(?{own}{'u' if 'i' in own else ''})" if own else "") + "".join(out)


def trim(c: Column) -> Column:
    """Without the dialect's white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, rf"^[{SPACES}]+", ""), rf"[{SPACES}]+\z", "")


def is_full(c: Column) -> Column:
    """Whether anything is left once trimmed."""
    return c.rlike(f"[!-~]|[^{SPACES}]")


def length(c: Column) -> Column:
    """UTF-16 code units, as the dialect counts."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def first_units(c: Column, n: int) -> Column:
    """The first n UTF-16 code units, as bytes: a surrogate pair counts two, and half of one at the cut stays a half."""
    return F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n)


def group(c: Column, pattern: str, n: int = 1, flags: str = "") -> Column:
    """Group n of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, to_java(pattern, flags), n), F.lit(""))


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    return c.rlike(to_java(pattern, flags))


def count(c: Column, literal: str) -> Column:
    """How often the literal text occurs, without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def half_digits(c: Column) -> Column:
    return F.translate(c, FULL_DIGITS, HALF_DIGITS)


def number(c: Column) -> Column:
    """An int, null if the digits are too many."""
    return c.try_cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def where_once(df: DataFrame, condition: Callable[[Column], Column]) -> DataFrame:
    """The rows that meet condition(row), a struct of the columns. Unlike a filter it isn't pushed below the projections that
    made the columns, which would compute all of them a second time."""
    rows = F.filter(F.array(F.struct(*df.columns)), condition)
    return df.select(F.inline(rows))
