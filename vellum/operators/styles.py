"""Styles of lines: runs of words in one style, cleaned run models, styles confirmed by fonts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

#: Colours nearer than this (sum of the three differences) are one.
NEAR = 24
#: Of a line's size: what a superscript is raised at least, how high it is at most, and a gap that stands for a space (of the word's own height).
RAISED, SMALL, GAP = 0.12, 0.85, 0.18
RUN = "run int, text string, bold boolean, italic boolean, underline boolean, font string, colour array<int>, sup_ratio double, sup_raise double"
#: White space as Python has it, and the byte order mark, for patterns of Arrow.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_OWN = ("text", "left", "right", "height", "baseline", "bold", "italic", "underline", "font", "colour")


def _starts(new: np.ndarray, white: np.ndarray, style: np.ndarray, coloured: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """Which words begin a run. A run's colour is its first word's: near colours in a row may lead away from it."""
    out = np.zeros(len(new), bool)
    last = None
    for k, (n, w, s, c, (r, g, b)) in enumerate(zip(*(v.tolist() for v in (new, white, style, coloured, rgb)), strict=True)):
        if n or not w and (s != last or c != had or c and abs(r - r0) + abs(g - g0) + abs(b - b0) >= NEAR):  # noqa: F821 - set by a line's first word
            out[k], last, had, r0, g0, b0 = True, s, c, r, g, b
    return out


def _runs(batch: pa.RecordBatch, keys: tuple[str, ...]) -> pa.RecordBatch:
    """Runs of the batch's lines; lines of one style, or whose runs don't give their text again, have none."""
    lists = batch.column("items")
    item = lists.flatten()
    line = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    filled = pc.greater(pc.binary_length(item.field("text").fill_null("")), 0)
    item, line = item.filter(filled), line[filled.to_numpy(zero_copy_only=False)]
    text, n = item.field("text"), len(line)
    number = lambda c: c.cast(pa.float64()).to_numpy(zero_copy_only=False)  # noqa: E731 - nulls are NaN
    zero = lambda c: np.nan_to_num(number(c))
    flag = lambda c: c.fill_null(False).to_numpy(zero_copy_only=False)
    told = lambda p, c: pc.match_substring_regex(c, p).to_numpy(zero_copy_only=False)
    white, leads, trails = told(f"^{_WHITE}+$", text), told(f"^{_WHITE}", text), told(f"{_WHITE}$", text)
    new = np.r_[True, line[1:] != line[:-1]][:n]
    left, right, high = number(item.field("left")), number(item.field("right")), zero(item.field("height"))
    # a gap stands for a space, at the end of the run before
    gap = np.r_[~new[1:] & ~trails[:-1] & ~leads[1:] & (left[1:] - right[:-1] > high[1:] * GAP), False][:n]
    size, base, ocr = zero(batch.column("line_size"))[line], zero(batch.column("line_baseline"))[line], flag(batch.column("ocr"))[line]
    raised = base - zero(item.field("baseline"))
    sup = (size != 0) & ~ocr & (raised > size * RAISED) & (high < size * SMALL) & ~white
    whole = np.where(size != 0, size, 1.0)
    held = lambda v, low, most: np.floor(np.clip(v / whole, low, most) * 1000 + 0.5) / 1000
    font = pc.if_else(pc.equal(item.field("font"), ""), None, item.field("font"))
    face = font.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    marks = [flag(item.field(c)) & ~white for c in ("bold", "italic", "underline")]
    colour = item.field("colour")
    coloured = colour.is_valid().to_numpy(zero_copy_only=False) & ~white
    rgb = np.zeros((n, 3), np.int64)
    if coloured.any():
        rgb[coloured] = colour.filter(pa.array(coloured)).flatten().cast(pa.int64()).to_numpy(zero_copy_only=False).reshape(-1, 3)
    face = np.where(white, -1, face)
    style = sum(m.astype(np.int64) << k for k, m in enumerate((*marks, sup))) + (face.astype(np.int64) + 1 << 4)
    first = np.flatnonzero(_starts(new, white, style, coloured, rgb))
    own = line[first]
    begin = np.flatnonzero(new)
    top = begin[np.searchsorted(line[begin], own)]
    mixed = np.zeros(len(lists), bool)
    mixed[own[(style[first] != style[top]) | (coloured[first] != coloured[top]) | (rgb[first] >> 3 != rgb[top] >> 3).any(axis=1)]] = True
    pieces = pc.binary_join_element_wise(text, pc.if_else(pa.array(gap), " ", ""), "")
    joined = lambda at: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, n].astype(np.int32)), pieces), "")
    fold = lambda c: pc.utf8_trim(pc.replace_substring_regex(c.fill_null(""), f"{_WHITE}+", " "), " ")
    same = np.zeros(len(lists), bool)
    same[line[begin]] = pc.equal(fold(joined(begin)), fold(batch.column("line_text").take(pa.array(line[begin])))).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero((same & mixed)[own])
    at, own, run = first[keep], own[keep], (np.arange(len(first)) - np.searchsorted(own, own))[keep]
    ratio = lambda v: pa.array(v[at], pa.float64(), mask=~sup[at])
    shades = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * 3, pa.int32()), pa.array(rgb[at].ravel(), pa.int32())).take(pa.array(np.arange(len(at)), mask=~coloured[at]))
    faces = font.take(pa.array(at, mask=white[at]))
    cols = [*(batch.column(c).take(pa.array(own)) for c in keys), pa.array(run.astype(np.int32)), joined(first).take(pa.array(keep)), *(pa.array(m[at]) for m in marks), faces, shades, ratio(held(high, 0.3, 0.9)), ratio(held(raised, 0.05, 0.8))]
    return pa.RecordBatch.from_arrays(cols, names=[*keys, *(c.split()[0] for c in RUN.split(", "))])


def line_style_runs(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, run, text, bold, italic, underline, font, colour, sup_ratio, sup_raise) of lines that mix styles.

    ``lines(keys, line_text, line_size, line_baseline, ocr, items)`` hold their
    items (text, left, right, height, baseline, bold, italic, underline, font,
    colour) in order, so that lines stay where they are.  Words of one style join; a
    colour joins a run that began with one near it; small raised words are
    superscripts, in recognised lines none.  A null colour is a style of its own.
    """
    part = F.transform("items", lambda i: F.struct(*(i[c].alias(c) for c in _OWN[:-1]), i["colour"].cast("array<int>").alias("colour"))) if lines.schema["items"].dataType.elementType.names != list(_OWN) else F.col("items")
    some = lines.select(*keys, "line_text", "line_size", "line_baseline", "ocr", part.alias("items"))
    schema = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in keys) + ", " + RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _runs(batch, keys)

    return some.mapInArrow(run, schema)


def style_runs(items: DataFrame) -> DataFrame:
    """``line_style_runs`` of flat ``items(doc_id, line_no, seq, text, left, right, height, baseline, bold, italic, underline, font, colour, line_text, line_size, line_baseline, ocr)``: a line's own values stand on each of its items, and its rows travel once."""
    own = F.array_sort(F.collect_list(F.struct("seq", *_OWN)))
    lines = items.groupBy("doc_id", "line_no").agg(*(F.first(c).alias(c) for c in ("line_text", "line_size", "line_baseline", "ocr")), own.alias("items"))
    return line_style_runs(lines, "doc_id", "line_no")


def cleaned_runs(runs: Column, size: Column, bold: Column, italic: Column) -> Column:
    """Lines of runs (text, size, bold, italic, underline, link) made fit to draw; null if nothing is left.

    Text is cleaned and empty runs go; a size that is null or 0 is ``size``, all
    are held within 4 to 400; weight and slant that aren't stated are inherited;
    a blank link is none.
    """

    def clean(r: Column) -> Column:
        own = F.when(F.coalesce(r["size"], F.lit(0.0)) == 0, size).otherwise(r["size"])
        link = F.when(T.trimmed(F.coalesce(r["link"], F.lit(""))) != "", r["link"])
        return F.struct(
            T.clean_editable(F.coalesce(r["text"], F.lit(""))).alias("text"), F.greatest(F.lit(4.0), F.least(F.lit(400.0), own)).alias("size"), F.coalesce(r["bold"], bold).alias("bold"),
            F.coalesce(r["italic"], italic).alias("italic"), F.coalesce(r["underline"], F.lit(False)).alias("underline"), link.alias("link"),
        )

    lines = F.transform(runs, lambda line: F.coalesce(F.filter(F.transform(line, clean), lambda r: r["text"] != ""), F.array().cast(_ELEMENT)))
    return F.when(F.exists(lines, lambda line: F.size(line) > 0), lines)


_ELEMENT = "array<struct<text:string,size:double,bold:boolean,italic:boolean,underline:boolean,link:string>>"


def refined(items: DataFrame, fonts: DataFrame) -> DataFrame:
    """(doc_id, line_no, bold, italic) of each line: set where fonts confirm it for all its words, else as it was.

    ``items(doc_id, line_no, text, font, bold, italic, line_bold, line_italic)``;
    ``fonts(font, name, bold, italic)`` are those known, told by flag or by name.
    A word's own style is never cleared; one word of an unknown font leaves the line as it was.
    """
    name = F.lower(F.coalesce(F.col("name"), F.lit("")))
    known = fonts.select(
        "font", F.lit(True).alias("known"), (F.coalesce("bold", F.lit(False)) | name.rlike("bold|black|heavy|semi.?bold|demi.?bold|medium|cmbx")).alias("font_bold"), (F.coalesce("italic", F.lit(False)) | name.rlike("italic|oblique|cmti|cmsl")).alias("font_italic"),
    )
    both = items.filter("trim(text) <> ''").join(known.dropDuplicates(["font"]), "font", "left")
    every = lambda own, of: F.bool_and(F.coalesce(own, F.lit(False)) | F.coalesce(of, F.lit(False)))
    g = both.groupBy("doc_id", "line_no").agg(F.bool_and(F.col("known").isNotNull()).alias("known"), every(F.col("bold"), F.col("font_bold")).alias("b"), every(F.col("italic"), F.col("font_italic")).alias("i"), F.first("line_bold").alias("lb"), F.first("line_italic").alias("li"))
    add = lambda own, of: F.coalesce(F.col(own), F.lit(False)) | (F.col("known") & F.col(of))
    return g.select("doc_id", "line_no", add("lb", "b").alias("bold"), add("li", "i").alias("italic"))


def restyled(runs: Column, start: Column, stop: Column, field: Column, value: Column) -> Column:
    """Runs (text, bold, italic, underline) with one ``field`` set to ``value`` for the characters from ``start`` to ``stop``.

    Runs that the range cuts are split, empty ones go and equal neighbours are
    joined.  A range beyond the text's ends is what of it lies inside.
    """
    kind = "array<struct<text:string,bold:boolean,italic:boolean,underline:boolean>>"
    fields = ("bold", "italic", "underline")

    def placed(acc: Column, r: Column) -> Column:
        n = F.length(r["text"])
        a, b = (F.least(F.greatest(x - acc["at"], F.lit(0)), n) for x in (start, stop))
        b = F.greatest(a, b)
        own = [r[f].alias(f) for f in fields]
        new = [F.when(field == f, value).otherwise(r[f]).alias(f) for f in fields]
        cut = lambda x, y, style: F.struct(F.substring(r["text"], x + 1, y - x).alias("text"), *style)
        parts = F.array(cut(F.lit(0), a, own), cut(a, b, new), cut(b, n, own)).cast(kind)
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.filter(parts, lambda p: p["text"] != "")).alias("out"))

    split = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), placed, lambda a: a["out"])

    def joined(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        same = F.coalesce(F.struct(*(last[f] for f in fields)) == F.struct(*(r[f] for f in fields)), F.lit(False))
        one = F.struct(F.concat(last["text"], r["text"]).alias("text"), *(r[f].alias(f) for f in fields))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(one).cast(kind))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(split, F.array().cast(kind), joined)
