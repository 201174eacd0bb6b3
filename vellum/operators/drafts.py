"""What a save draws, and the checks around it: plans of edits, element logs, recognised words, fonts, trims.

Edits carry (doc_id, page_index, edit_seq, kind, style, new_text); elements and
shapes their own keys, as said at each function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import fonts

# Fixed values that results depend on.
EXPORT_CONFIDENCE = 68
SIGNATURE_ZONE = (30, 80)
BACKDROP = 0.5
MODIFY_CONTENTS = 8
LEAST_SHAPE, LEAST_ERASE = 2, 4
OPAQUE, PAD = 12, 8
OVERRIDES = ("family", "size", "bold", "italic", "colour")

EDIT = ("doc_id", "page_index", "edit_seq")


def unembeddable(edits: DataFrame, charset: DataFrame) -> DataFrame:
    """Keys of edits whose text holds a printable character outside ``charset(char)``."""
    chars = edits.select(*EDIT, F.explode(F.array_distinct(F.split(F.coalesce("new_text", F.lit("")), ""))).alias("char"))
    return chars.filter("char > ' '").join(charset, "char", "left_anti").select(*EDIT).distinct()


def undrawable(edits: DataFrame, options: DataFrame, charsets: DataFrame) -> DataFrame:
    """Keys of edits whose text holds a printable character that none of the edit's own faces draws.

    ``options(doc_id, page_index, edit_seq, rank, font, kind)`` are an edit's
    faces, ``charsets(font, ch)`` what embedded ones hold; an edit without faces
    can draw nothing.
    """
    key = F.to_json(F.struct(*EDIT)).alias("edit")
    chars = edits.select(*EDIT, key, F.explode(F.array_distinct(F.split(F.coalesce("new_text", F.lit("")), ""))).alias("ch")).filter("ch > ' '")
    own = options.select(key, "rank", "font", "kind")
    drawn = fonts.drawn_by(chars.select("edit", "ch"), own, charsets, "edit")
    return chars.join(drawn.filter("draws"), ["edit", "ch"], "left_anti").select(*EDIT).distinct()


def tiers(edits: DataFrame, lost: DataFrame) -> DataFrame:
    """Effective edits with ``tier``, as ``draw_list``, where ``lost`` holds the keys of edits that no face draws."""
    flat = lost.select("doc_id").distinct().withColumn("flat", F.lit(True))
    drawn = F.coalesce((F.col("kind") == "image") | (F.col("style") == "signature"), F.lit(False))
    covered = edits.filter(drawn).select("doc_id").distinct().withColumn("drawn", F.lit(True))
    all_ = edits.join(flat, "doc_id", "left").join(covered, "doc_id", "left")
    return all_.withColumn("tier", F.when(F.col("flat"), 3).when(F.col("drawn"), 2).otherwise(1)).drop("drawn", "flat")


def draw_list(edits: DataFrame, charset: DataFrame) -> DataFrame:
    """Effective edits with ``tier``, the way their document is written.

    1 rewrites the text itself; a document with an image or signature edit goes
    to 2, cover and draw again; one with a character that no font can carry goes
    to 3, flat pages.  A document without edits is not in the result: its bytes
    pass unchanged.
    """
    lost = unembeddable(edits, charset).select("doc_id").distinct().withColumn("flat", F.lit(True))
    by = Window.partitionBy("doc_id")
    drawn = F.coalesce((F.col("kind") == "image") | (F.col("style") == "signature"), F.lit(False))
    all_ = edits.withColumn("drawn", F.max(drawn).over(by)).join(lost, "doc_id", "left")
    return all_.withColumn("tier", F.when(F.col("flat"), 3).when(F.col("drawn"), 2).otherwise(1)).drop("drawn", "flat")


def exported(items: DataFrame) -> DataFrame:
    """``items`` without recognised words below the export confidence; native ones and those of unknown confidence stay."""
    doubtful = F.col("ocr") & F.col("conf").isNotNull() & (F.col("conf") < EXPORT_CONFIDENCE)
    return items.filter(~F.coalesce(doubtful, F.lit(False)))


def in_signature_zone(top: Column, page_height: Column) -> Column:
    return (top / page_height * 100).between(*SIGNATURE_ZONE)


def scan_backdrops(images: DataFrame) -> DataFrame:
    """Pages of which one image covers more than half: ``images(doc_id, page_index, x0, y0, x1, y1, page_w, page_h)``."""
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > BACKDROP * F.col("page_w") * F.col("page_h")
    return images.filter((F.col("page_w") * F.col("page_h") > 0) & share).select("doc_id", "page_index").distinct()


def upright(pages: DataFrame) -> DataFrame:
    """Pages that are not turned."""
    return pages.filter(F.pmod(F.coalesce("rotate", F.lit(0)), F.lit(360)) == 0)


def restricted(permissions: Column) -> Column:
    """Whether a list of permission flags forbids changes; no list forbids nothing."""
    return F.coalesce(~F.array_contains(permissions, MODIFY_CONTENTS), F.lit(False))


def drawn_shapes(shapes: DataFrame) -> DataFrame:
    """Shapes that are more than a click: lines always, others from 2 wide or high, erasures from 4 both ways."""
    wide, high = F.coalesce(F.nullif(F.col("width"), F.lit(0)), 2 * F.col("rx"), F.lit(0)), F.coalesce(F.nullif(F.col("height"), F.lit(0)), 2 * F.col("ry"), F.lit(0))
    kept = F.when(F.col("type") == "line", True).when(F.col("type") == "erase", (wide >= LEAST_ERASE) & (high >= LEAST_ERASE)).otherwise((wide >= LEAST_SHAPE) | (high >= LEAST_SHAPE))
    return shapes.filter(kept)


def unsaved(edits: DataFrame, saved: DataFrame) -> DataFrame:
    """Documents whose edits, in order, are not those of ``saved(doc_id, json)``; a document without edits has nothing to lose."""
    now = edits.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("edit_seq", "page_index", "new_text")))).alias("now"))
    return now.join(saved, "doc_id", "left").filter(~F.col("now").eqNullSafe(F.col("json"))).select("doc_id")


def elements(log: DataFrame) -> DataFrame:
    """Text elements that stand after an append-only ``log(doc_id, element_id, op_seq, op, page_index, text, font_size, advance)``.

    An add or update sets what it gives and keeps the rest; a removal ends the
    element, until it is added again.  ``width`` is the text's advance at its size.
    """
    w = Window.partitionBy("doc_id", "element_id").orderBy("op_seq")
    life = F.sum((F.col("op") == "add").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = log.withColumn("life", life).filter("life > 0")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("op_seq"))).alias(c)
    state = own.groupBy("doc_id", "element_id", "life").agg(last("page_index"), last("text"), last("font_size"), last("advance"), F.max(F.col("op") == "remove").alias("gone"), F.max("op_seq").alias("at"))
    newest = state.groupBy("doc_id", "element_id").agg(F.max_by(F.struct("page_index", "text", "font_size", "advance", "gone"), "life").alias("s")).select("doc_id", "element_id", "s.*")
    width = F.length("text") * F.col("advance") * F.col("font_size")
    return newest.filter(~F.col("gone")).withColumn("width", width).drop("gone", "advance")


def elements_of(state: DataFrame, asked: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements of the asked (doc_id, page_index); a page that ``pages(doc_id, n_pages)`` doesn't have gives none."""
    there = asked.join(pages, "doc_id").filter((F.col("page_index") >= 0) & (F.col("page_index") < F.col("n_pages"))).select("doc_id", "page_index").distinct()
    return state.join(there, ["doc_id", "page_index"], "left_semi")


def overridden(spans: DataFrame, override: DataFrame) -> DataFrame:
    """Replacement spans with the sticky style of ``override`` (one row a document; null: not set) in place of their own."""
    set_ = override.select("doc_id", *(F.col(c).alias(f"_{c}") for c in OVERRIDES))
    both = spans.join(set_, "doc_id", "left")
    return both.withColumns({c: F.coalesce(f"_{c}", c) for c in OVERRIDES}).drop(*(f"_{c}" for c in OVERRIDES))


def tree_words(tree: Column, words: Column) -> Column:
    """Words of a recogniser's blocks, paragraphs and lines in order; its flat list where the tree holds none."""
    none = F.array()
    step = lambda c, name: F.flatten(F.transform(c, lambda x: F.coalesce(x[name], none)))
    found = step(step(step(F.coalesce(tree, none), "paragraphs"), "lines"), "words")
    return F.when(F.size(found) > 0, found).otherwise(F.coalesce(words, none))


def match_order(matches: Column) -> Column:
    """Matches (dist, start, stop) best first: by distance, start, and the longest."""
    keyed = F.transform(matches, lambda m: F.struct(m["dist"].alias("a"), m["start"].alias("b"), (m["start"] - m["stop"]).alias("c"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda x: x["m"])


def font_list(fonts: DataFrame, recent: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the font picker for each asked (query_id, q): without a query the recent ones first, then by name.

    A query looks in names and tags of ``fonts(key, name, tag)``; ``recent(key, rank)`` is the user's own order.
    """
    q = F.lower(F.trim("q"))
    hit = asked.join(fonts, (q == "") | F.contains(F.lower("name"), q) | F.contains(F.lower("tag"), q)).select("query_id", F.lit(1).alias("part"), F.lit(0).alias("rank"), "key", "name")
    top = asked.join(recent.join(fonts, "key"), q == "").select("query_id", F.lit(0).alias("part"), "rank", "key", "name")
    w = Window.partitionBy("query_id").orderBy("part", "rank", F.lower("name"), "key")
    return top.union(hit).select("query_id", F.row_number().over(w).alias("pos"), "key")


def line_size(lines: DataFrame) -> DataFrame:
    """Recognised lines with ``size`` and a tight box; needs their page's ``dom_line``, ``dom_font`` and ``page_h``.

    Ordinary heights come near the page's dominant line, none exceeds twice the
    dominant font, those in the margins 1.1 times it.  A box much higher than its
    size is seated anew from its top.
    """
    h, mid = F.col("bottom") - F.col("top"), (F.col("bottom") + F.col("top")) / 2
    size = F.least(F.when((h > 0.55 * F.col("dom_line")) & (h < 1.7 * F.col("dom_line")), F.least("dom_line", h * 1.15)).otherwise(h), F.col("dom_font") * 2)
    margin = (mid < 0.15 * F.col("page_h")) | (mid > 0.82 * F.col("page_h"))
    sized = lines.withColumn("size", F.when(margin, F.least(size, F.col("dom_font") * 1.1)).otherwise(size))
    loose = h > F.col("size") * 1.6
    return sized.withColumns({"tight_bottom": F.when(loose, F.least("bottom", F.col("top") + F.col("size") * 1.35)).otherwise(F.col("bottom")), "tight_base": F.when(loose, F.col("top") + F.col("size") * 0.9).otherwise(F.coalesce("baseline", "bottom"))})


def trimmed(pixels: DataFrame) -> DataFrame:
    """Box of each image's visible pixels, padded and inside the image: ``pixels(image_id, x, y, alpha, w, h)``."""
    seen = pixels.filter(F.col("alpha") > OPAQUE)
    box = seen.groupBy("image_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))), F.max("w").alias("w"), F.max("h").alias("h"))
    low = lambda c: F.greatest(F.lit(0), F.col(f"min_{c}") - PAD)
    high = lambda c, n: F.least(F.col(n) - 1, F.col(f"max_{c}") + PAD)
    return box.select("image_id", low("x").alias("x"), low("y").alias("y"), (high("x", "w") - low("x") + 1).alias("w"), (high("y", "h") - low("y") + 1).alias("h"))


def unreusable(spans: DataFrame, fonts: DataFrame) -> DataFrame:
    """Spans drawn with an embedded face that can't be used again: ``fonts(doc_id, page_index, name, kind)`` of a Type 1 or a subset of TeX's."""
    bare = lambda c: F.lower(F.element_at(F.split(F.coalesce(c, F.lit("")), r"\+"), -1))
    bad = fonts.filter((F.col("kind") == "Type1") | F.col("name").rlike(r"^[A-Z]{6}\+(?:CM|LM|SF)")).select("doc_id", "page_index", bare(F.col("name")).alias("face")).distinct()
    return spans.withColumn("face", bare(F.col("font"))).join(bad, ["doc_id", "page_index", "face"], "left_semi").drop("face")
