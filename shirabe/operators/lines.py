"""Documents to ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compat as C
from ..functions.cleaning import clean, nfc

MIN_LINE = 20


def split_lines(docs: DataFrame, normalise: bool = True, cleaned: bool = True) -> DataFrame:
    """C6 without merging: (doc_id, line_no, line) of trimmed, non-empty, cleaned lines."""
    parts = F.filter(F.transform(F.split("text", r"\n+"), C.trim), lambda x: x != "")
    # dealt by document before the lines multiply: what follows by document needs no further shuffle. NFC comes first,
    # on whole texts (a line end composes with nothing), because a Python node would lose the partitioning.
    text = nfc(F.col("text")) if normalise and cleaned else F.col("text")
    rows = docs.select("doc_id", text.alias("text")).repartition("doc_id").select("doc_id", F.posexplode(parts).alias("line_no", "line"))
    return rows.withColumn("line", clean(F.col("line"), normalise=False)) if cleaned else rows


def merge_short_lines(lines: DataFrame, min_length: int = MIN_LINE) -> DataFrame:
    """A short line joins the next line that is long, starts with a number or ends with a mark; order stays.

    Each line that is emitted closes an island; the islands are one running sum per document."""
    keeps = (C.length(F.col("line")) >= min_length) | C.matches(F.col("line"), r"^(\d{4,6})|[×〇○]$")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    islands = lines.withColumn("island", F.coalesce(F.sum(keeps.cast("int")).over(before), F.lit(0)))
    joined = islands.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    # a buffered part is trimmed; the line that closes the island is not
    return joined.select("doc_id", F.col("island").cast("int").alias("line_no"), F.array_join(F.transform("parts", lambda p: p["line"]), " ").alias("line"))


def preprocess(docs: DataFrame, normalise: bool = True, min_length: int = MIN_LINE) -> DataFrame:
    """Cleaned lines with short ones merged."""
    return merge_short_lines(split_lines(docs, normalise), min_length)


def joined_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): each document's lines in order."""
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda p: p["line"]), "\n").alias("text"))
