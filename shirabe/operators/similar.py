"""Texts alike by edit distance, found by shared segments instead of all pairs.

Two texts of which the longer has n characters are alike to p percent if their edit distance is at most
d = (100 - p) * n / 100, rounded down. Cut the shorter one into d + 1 segments: d edits leave one of them whole, and it stands
in the longer text near its own place. So each text lays down its segments, once for every length that a partner may have,
and looks up its own substrings, for every length that a partner may have, at the places where they can stand (earlier
edits move the i-th segment by i - 1 at most, later ones by what is left). Only texts that meet are compared, by a
distance with a bound. Equal texts are one class, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PERCENT = 50


def _edits(length: Column, percent: int) -> Column:
    return F.floor((100 - percent) * length / 100).cast("int")


def _segment(i: Column, length: Column, edits: Column) -> tuple[Column, Column]:
    """Place and length of segment i of edits + 1, the last ones being longer by one where it does not come out even."""
    size = F.floor(length / (edits + 1)).cast("int")
    short = edits + 1 - length % (edits + 1)
    return 1 + (i - 1) * size + F.greatest(i - 1 - short, F.lit(0)), size + (i > short).cast("int")


def segments(text: Column, percent: int) -> Column:
    """array<struct(n, m, i, s)>: as the text of length m, the shorter one of a pair with one of length n, its segment i."""
    m = F.length(text)

    def of(n: Column) -> Column:
        edits = _edits(n, percent)

        def one(i: Column) -> Column:
            place, size = _segment(i, m, edits)
            return F.struct(n.alias("n"), m.alias("m"), i.alias("i"), F.substring(text, place, size).alias("s"))

        return F.transform(F.sequence(F.lit(1), edits + 1), one)

    longer = F.filter(F.sequence(m, F.floor(m * 100 / percent).cast("int")), lambda n: n - _edits(n, percent) <= m)
    return F.flatten(F.transform(longer, of))


def substrings(text: Column, percent: int) -> Column:
    """array<struct(n, m, i, s)>: as the longer text, of length n, its substrings where segment i of a text of length m may stand."""
    n = F.length(text)
    edits = _edits(n, percent)

    def of(m: Column) -> Column:
        def one(i: Column) -> Column:
            place, size = _segment(i, m, edits)
            left, gap = edits + 1 - i, n - m
            low = F.greatest(place - (i - 1), place + gap - left, F.lit(1))
            high = F.least(place + (i - 1), place + gap + left, n - size + 1)
            places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: F.struct(n.alias("n"), m.alias("m"), i.alias("i"), F.substring(text, at, size).alias("s")))

        return F.flatten(F.transform(F.sequence(F.lit(1), edits + 1), one))

    return F.array_distinct(F.flatten(F.transform(F.sequence(n - edits, n), of)))


def candidates(texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): different texts, b not the shorter, that share a segment; texts(text) are all different."""
    if not LEAST_PERCENT < percent <= 100:
        raise ValueError(f"percent must be above {LEAST_PERCENT} and at most 100")
    own = texts.where("text <> ''")
    laid = own.select(F.col("text").alias("a"), F.inline(segments(F.col("text"), percent)))
    sought = own.select(F.col("text").alias("b"), F.inline(substrings(F.col("text"), percent)))
    met = laid.join(sought, ["n", "m", "i", "s"]).where((F.col("n") > F.col("m")) | (F.col("a") < F.col("b")))
    return met.select("a", "b").distinct()


def alike(texts: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b, distance, similarity) of all different texts alike to percent, each pair once; texts(text) are all different.

    Defined results: null and empty texts are like no other; similarity as in C12."""
    longest = F.length("b")
    near = candidates(texts, percent).withColumn("distance", F.levenshtein("a", "b"))
    return near.where(F.col("distance") <= _edits(longest, percent)).withColumn("similarity", 1 - F.col("distance") / longest)


def links(rows: DataFrame, key: str, text: str, percent: int = 80) -> DataFrame:
    """key, class_id (the smallest key with an equal text) and n_links (other rows that are alike) of every row. Rows that repeat
    a key count each; null texts are in no class and linked with nothing."""
    classes = rows.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(key).alias("class_id"), F.count("*").alias("size"))
    pairs = alike(classes.select("text"), percent).select(F.explode(F.array(F.struct(F.col("a").alias("text"), F.col("b").alias("other")), F.struct(F.col("b").alias("text"), F.col("a").alias("other")))).alias("p")).select("p.*")
    sizes = classes.select(F.col("text").alias("other"), F.col("size").alias("others"))
    linked = classes.join(pairs.join(sizes, "other").groupBy("text").agg(F.sum("others").alias("others")), "text", "left")
    linked = linked.select(F.col("text").alias(text), "class_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.select(key, text).join(linked, text, "left").select(key, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
