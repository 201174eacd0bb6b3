"""Layout operators over positioned items and lines.

Order-dependent rules are windows over (doc_id, page_index): a page is a bounded
partition whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_index")


def upper_median(values: Column) -> Column:
    """Middle element, the upper one of an even number."""
    a = F.array_sort(values)
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def blocks(lines: DataFrame) -> DataFrame:
    """Lines with paragraph and block numbers: gaps over 1.6 and 2.5 median heights; a jump up and aside starts a block."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    whole = Window.partitionBy(*PAGE)
    med = upper_median(F.collect_list("height").over(whole))
    width = F.max("right").over(whole) - F.min("left").over(whole)
    gap = F.col("top") - F.lag("bottom").over(w)
    aside = F.abs(F.col("left") - F.lag("left").over(w)) > 0.25 * width
    marked = lines.withColumn("med", med).withColumns({"gap": gap, "aside": aside})
    block = (F.col("gap") > 2.5 * F.col("med")) | ((F.col("gap") < -F.col("med")) & F.col("aside"))
    para = block | (F.col("gap") > 1.6 * F.col("med"))
    number = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumns({"block": number(block), "paragraph": number(para)}).drop("med", "gap", "aside")


def segments(items: DataFrame) -> DataFrame:
    """Items with the number of their segment in the line: split where a gap exceeds max(2.5 median gaps, 0.6 heights)."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("word_no")
    gapped = items.withColumn("gap", F.col("left") - F.lag("right").over(w))
    # one median a line, joined back: a window would sort a line's gaps for each of its words
    med = gapped.groupBy("doc_id", "line_no").agg(upper_median(F.collect_list("gap")).alias("med"))
    wide = F.col("gap") > F.greatest(2.5 * F.col("med"), 0.6 * F.col("height"))
    marked = gapped.join(med, ["doc_id", "line_no"]).withColumn("wide", F.coalesce(wide.cast("int"), F.lit(0)))
    return marked.withColumn("segment", F.sum("wide").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("gap", "med", "wide")


def page_scramble(pages: DataFrame, *keys: str, least: int = 10) -> DataFrame:
    """(keys, n, ratio) of ``pages(keys, items)`` with items (seq, top, bottom, height): share of steps in content order that go up by more than 1.3 median heights; pages stay where they are."""
    mid = F.transform(F.array_sort("items"), lambda i: (i["top"] + i["bottom"]) / 2)
    some = pages.select(*keys, mid.alias("mid"), F.filter(F.transform("items", lambda i: i["height"]), lambda h: h > 0).alias("heights"))
    n = F.size("mid")
    steps = F.zip_with(F.slice("mid", F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice("mid", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    page = some.select(*keys, n.cast("long").alias("n"), F.filter(steps, lambda d: d.isNotNull()).alias("dys"), upper_median(F.col("heights")).alias("med"))
    up = F.size(F.filter("dys", lambda d: d < -1.3 * F.coalesce("med", F.lit(1.0))))
    return page.select(*keys, "n", F.when((F.col("n") < least) | (F.size("dys") == 0), 0.0).otherwise(up / F.size("dys")).alias("ratio"))


def scramble(items: DataFrame, least: int = 10) -> DataFrame:
    """``page_scramble`` of flat ``items(doc_id, page_index, seq, top, bottom, height)``."""
    return page_scramble(items.groupBy(*PAGE).agg(F.collect_list(F.struct("seq", "top", "bottom", "height")).alias("items")), *PAGE, least=least)


def line_style(items: DataFrame) -> DataFrame:
    """Per line: size of the height bucket with most characters (first seen wins ties), and majorities of the flags by characters."""
    n = F.length("text")
    bucket = F.floor(F.col("height") * 2 + 0.5) / 2
    by = items.groupBy("doc_id", "line_no", bucket.alias("bucket")).agg(
        F.sum(n).alias("chars"), F.max("height").alias("size"), F.min("word_no").alias("first"), F.sum(F.when(F.col("bold"), n).otherwise(0)).alias("b"), F.sum(F.when(F.col("italic"), n).otherwise(0)).alias("i")
    )
    total = F.sum("chars")
    return by.groupBy("doc_id", "line_no").agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("font_size"), (2 * F.sum("b") > total).alias("bold"), (2 * F.sum("i") > total).alias("italic"))


def reading_sections(lines: DataFrame, band: float = 0.6) -> DataFrame:
    """Lines with ``section``: a line over ``band`` of the content's width stands alone between sections."""
    whole = Window.partitionBy(*PAGE)
    content = F.greatest(F.lit(1.0), F.max("right").over(whole) - F.min("left").over(whole))
    wide = (F.col("right") - F.col("left")) >= band * content
    w = Window.partitionBy(*PAGE).orderBy("top", "left", "line_no")
    flagged = lines.withColumn("band", wide)
    starts = (F.col("band") | F.coalesce(F.lag("band").over(w), F.lit(True))).cast("int")
    return flagged.withColumn("starts", starts).withColumn("section", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")
