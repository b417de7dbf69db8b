"""Positioned text items to reading-order text.

items(doc_id, page_no, item_idx, str, x, y, font_size, width, height); one result row a page. Items without text or
geometry are left out. The tolerant order of the improved mode is not a total one for arbitrary input, so it is
defined here: by descending y, items whose gap to the item before is at most the precision form one band; within a band
x decides, then item_idx.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compat as C
from ..functions.cleaning import fix_encoding

PRECISION = 5
LINE_GAP = CHAR_GAP = 0.5
_PAGE = ["doc_id", "page_no"]


def _round(c: Column) -> Column:
    return F.floor(c + 0.5)


def usable(items: DataFrame) -> DataFrame:
    return items.where(F.col("x").isNotNull() & F.col("y").isNotNull() & C.is_full(F.col("str")))


def text_width(text: Column, font: Column) -> Column:
    """Full-width characters take one font size, others half of it."""
    wide = r"[\u3040-\u309F\u30A0-\u30FF\u4E00-\u9FAF\uFF00-\uFFEF]"
    return font * (0.5 * F.length(text) + 0.5 * F.when(text.rlike(wide), F.regexp_count(text, F.lit(wide))).otherwise(0))


def _fixed(text: Column, normalise: bool) -> Column:
    """fix_encoding of a column; letters and signs that it leaves alone make up most items and are told by one look."""
    return F.when(text.rlike(r"^[!->@-~\u00C0-\u024F]*\z"), text).otherwise(fix_encoding(text, normalise))


def text_simple(items: DataFrame, normalise: bool = True) -> DataFrame:
    """L3: cleaned items in stream order, joined by blanks."""
    rows = items.select(*_PAGE, "item_idx", fix_encoding(F.col("str"), normalise).alias("t")).where(C.trim(F.col("t")) != "")
    return rows.groupBy(*_PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_idx", "t"))), lambda p: p["t"]), " ").alias("text"))


def text_structured(items: DataFrame, normalise: bool = True) -> DataFrame:
    """L2: a grid of rounded positions; cells left to right, lines top down."""
    rows = usable(items).select(*_PAGE, "item_idx", (_round(F.col("y") / PRECISION) * PRECISION).alias("gy"), _round(F.col("x")).alias("gx"), fix_encoding(F.col("str"), normalise).alias("t"))
    cells = rows.groupBy(*_PAGE, "gy", "gx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_idx", "t"))), lambda p: p["t"]), "").alias("t"))
    lines = cells.groupBy(*_PAGE, "gy").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gx", "t"))), lambda p: p["t"]), " ").alias("t")).where(C.trim(F.col("t")) != "")
    return lines.groupBy(*_PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("gy")).alias("k"), "t"))), lambda p: p["t"]), "\n").alias("text"))


def _runs(rows: Column, opens: Callable[[Column, Column], Column]) -> Column:
    """The array cut before every element that opens(element before, element) says so of; no element is looked at twice."""
    starts = lambda r: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.coalesce(opens(F.get(r, i - 1), F.get(r, i)), F.lit(True)))
    cut = lambda r: C.let(starts(r), lambda s: F.transform(s, lambda k, j: F.slice(r, k + 1, F.coalesce(F.get(s, j + 1), F.size(r)) - k)))
    return C.let(rows, cut)


def text_improved(items: DataFrame, normalise: bool = True) -> DataFrame:
    """L1: new lines where y jumps by more than half a font, blanks where x does.

    The expected place of the next item counts the width of the one before twice, as the format's readers do; items that
    cleaning empties move y but not x. A page is sorted as one array: windows over the items of pages would hold memory beside
    the sort that follows them, which a sort that is being filled does not give back."""
    font = F.when(F.coalesce("font_size", F.lit(0.0)) == 0, F.lit(12.0)).otherwise(F.col("font_size"))
    rows = usable(items).select(*_PAGE, "y", "x", "item_idx", font.alias("font"), _fixed(F.col("str"), normalise).alias("t"))
    rows = rows.withColumn("t", F.when(C.is_full(F.col("t")), F.col("t")).otherwise(F.lit("")))
    rows = rows.withColumn("end", F.col("x") + 2 * text_width(F.col("t"), F.col("font")))
    item = F.struct("x", "item_idx", "y", "font", "end", "t").alias("item")
    pages = rows.groupBy(*_PAGE).agg(F.collect_list(F.struct("y", (-F.col("item_idx")).alias("back"), item)).alias("items"))
    bands = _runs(F.reverse(F.array_sort("items")), lambda before, r: before["y"] - r["y"] > PRECISION)
    across = F.flatten(F.transform(bands, lambda band: F.array_sort(F.transform(band, lambda r: r["item"]))))
    lines = _runs(across, lambda before, r: F.abs(r["y"] - before["y"]) > before["font"] * LINE_GAP)
    gap = lambda before, r: r["x"] - before["end"] > r["font"] * CHAR_GAP
    spaced = lambda line: F.array_join(F.transform(line, lambda r, i: F.when(gap(F.get(line, i - 1), r), F.concat(F.lit(" "), r["t"])).otherwise(r["t"])), "")
    texts = F.transform(lines, lambda line: C.let(F.filter(line, lambda r: r["t"] != ""), spaced))
    out = pages.select(*_PAGE, F.array_join(F.filter(texts, lambda t: t != ""), "\n").alias("text"))
    return C.where_once(out, lambda r: r["text"] != "")


def complexity(items: DataFrame) -> DataFrame:
    """L4: (doc_id, page_no, n_items, y_variation, fonts, dx_variance, short_ratio, score); items without text don't count."""
    own = lambda c: F.when(F.col("full"), c)
    # items with and without text are windows of their own, so the item before is one with text
    alike = Window.partitionBy(*_PAGE, "full").orderBy("item_idx")
    rows = items.withColumn("full", F.coalesce(C.trim(F.col("str")) != "", F.lit(False)))
    rows = rows.withColumn("dx", own(F.abs(F.col("x") - F.lag("x").over(alike))))
    n = F.count(own(F.lit(1)))
    font = F.when(F.coalesce("font_size", F.lit(0.0)) == 0, F.lit(12.0)).otherwise(F.col("font_size"))
    out = rows.groupBy(*_PAGE).agg(
        n.alias("n_items"),
        F.try_divide(F.count_distinct(own(F.col("y"))), n).alias("y_variation"),
        F.count_distinct(own(font)).alias("fonts"),
        F.var_pop("dx").alias("dx_variance"),
        F.avg(own((C.length(F.col("str")) < 3).cast("int"))).alias("short_ratio"),
    )
    part = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))
    score = part(F.col("y_variation") > 0.1, 0.3) + part(F.col("fonts") > 3, 0.2) + part(F.col("dx_variance") > 1000, 0.3) + part(F.col("short_ratio") > 0.3, 0.2)
    return out.withColumn("score", F.least(score, F.lit(1.0)))


def text_adaptive(items: DataFrame, normalise: bool = True) -> DataFrame:
    """The mode that each page's complexity asks for; each mode reads its own pages only."""
    modes = complexity(items).select(*_PAGE, F.when(F.col("score") > 0.7, "structured").when(F.col("score") > 0.3, "improved").otherwise("simple").alias("mode"))
    own = items.join(modes, _PAGE)
    parts = [f(own.where(F.col("mode") == m), normalise).withColumn("mode", F.lit(m)) for m, f in (("structured", text_structured), ("improved", text_improved), ("simple", text_simple))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def page_text(items: DataFrame, mode: str = "simple", normalise: bool = True) -> DataFrame:
    """A page's text by the chosen mode."""
    return {"simple": text_simple, "structured": text_structured, "improved": text_improved, "adaptive": text_adaptive}[mode](items, normalise).select(*_PAGE, "text")


def blocks(items: DataFrame) -> DataFrame:
    """Runs of items whose rounded y moves by at most 5, with text, bounding box and count.

    Read by descending rounded y in bands of gaps up to 2, then rounded x."""
    page = Window.partitionBy(*_PAGE)
    down = page.orderBy(F.desc("ry"), "item_idx")
    rows = items.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumns({"ry": _round(F.col("y")), "rx": _round(F.col("x"))})
    rows = rows.withColumn("jump", (F.lag("ry").over(down) - F.col("ry") > 2).cast("int"))
    rows = rows.withColumn("band", F.coalesce(F.sum("jump").over(down), F.lit(0)))
    read = page.orderBy("band", "rx", "item_idx")
    rows = rows.withColumn("new", F.coalesce((F.abs(F.col("ry") - F.lag("ry").over(read)) > 5).cast("int"), F.lit(0)))
    rows = rows.withColumns({"block_no": F.sum("new").over(read), "pos": F.row_number().over(read), "t": C.trim(F.coalesce("str", F.lit("")))})
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda p: p["t"])
    return rows.groupBy(*_PAGE, "block_no").agg(
        F.array_join(F.filter(texts, lambda t: t != ""), " ").alias("text"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
        F.count("*").alias("item_count"),
    )
