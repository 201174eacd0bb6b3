"""Running heads and feet, and exports without them.

One window over (doc_id, band, key) counts recurrences; documents are the
partition, so one hot document is spread by its bands and keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.sources.layout import PAGE_H

BAND, LEAST = 0.12, 3


def counted(lines: DataFrame) -> DataFrame:
    """Lines with their band (null in the body), key and the key's count in that band of the document."""
    mid = (F.col("top") + F.col("bottom")) / 2
    band = F.when(mid <= BAND * PAGE_H, "top").when(mid >= (1 - BAND) * PAGE_H, "bottom")
    keyed = lines.withColumns({"band": band, "key": T.repeat_key(F.col("text"))})
    return keyed.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "band", "key")))


def marked(lines: DataFrame) -> DataFrame:
    """Lines with ``furniture``: in a band, and a page number or recurring."""
    repeats = (F.col("n") >= LEAST) & (T.trimmed(F.col("text")) != "")
    return counted(lines).withColumn("furniture", F.col("band").isNotNull() & (T.is_page_number(F.col("text")) | repeats))


def _in_order(key: str, value) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(key).alias("k"), value.alias("v"))))), lambda x: x["v"])


def export_text(marked: DataFrame) -> DataFrame:
    """(doc_id, text, stripped): lines joined by line feeds, pages by empty lines."""
    pages = marked.groupBy("doc_id", "page_index").agg(_in_order("line_no", F.when(~F.col("furniture"), F.col("text"))).alias("body"), F.count_if("furniture").alias("s"))
    body = F.when(F.size("body") > 0, F.array_join("body", "\n"))
    return pages.groupBy("doc_id").agg(F.array_join(_in_order("page_index", body), "\n\n").alias("text"), F.sum("s").alias("stripped"))


def export_rtf(lines: DataFrame) -> DataFrame:
    """(doc_id, rtf): one paragraph a line, pages divided."""
    pages = lines.groupBy("doc_id", "page_index").agg(F.array_join(_in_order("line_no", T.escape_rtf(F.col("text"))), "\\par\n").alias("body"))
    joined = F.array_join(_in_order("page_index", F.col("body")), "\\page\n")
    return pages.groupBy("doc_id").agg(F.concat(F.lit("{\\rtf1\\ansi "), joined, F.lit("}")).alias("rtf"))
