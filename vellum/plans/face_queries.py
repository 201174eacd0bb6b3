"""Faces for edited text: wishes, options and the choice for each character, with oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vellum.functions.text import WINANSI
from vellum.operators import fonts as N
from vellum.plans.registry import query
from vellum.sources.layout import table

FAMILIES = (("arial", "sans"), ("times", "serif"), ("courier", "mono"), ("georgia", "serif"))
SPANS = (None, "Helvetica-Bold", "ABCDEF+CMBX10", "Times-Roman", "GHIJKL+Roboto-Bold", "Courier", "MNOPQR+Tinos-Italic", "Unknown")
FACES = ("GHIJKL+Roboto-Bold", "ABCDEF+CMBX10", "MNOPQR+Tinos-Italic", "Helvetica-Bold", "STUVWX+Charter")

SQL_FACES = f"""span_names AS (SELECT * FROM (VALUES {", ".join(f"({k}, {'NULL' if v is None else repr(v)})" for k, v in enumerate(SPANS))}) AS t(k, span_font)), family_names AS (SELECT * FROM (VALUES {", ".join(map(str, FAMILIES))}) AS t(family, generic)),
face_names AS (SELECT * FROM (VALUES {", ".join(str((k, v)) for k, v in enumerate(FACES))}) AS t(pos, name)),
faces AS (SELECT doc_id, page_index, pos, name, CASE WHEN (doc_id + pos) % 4 = 0 THEN 'Type1' ELSE 'TrueType' END AS kind FROM (SELECT DISTINCT conv_id AS doc_id, (turn % 3)::INT AS page_index FROM conversations), face_names WHERE (doc_id + pos + page_index) % 3 > 0),
edits AS (SELECT conv_id AS doc_id, (turn % 3)::INT AS page_index, turn AS edit_seq, CASE (conv_id + turn) % 6 WHEN 1 THEN 'Georgia' WHEN 3 THEN 'COURIER' WHEN 5 THEN 'odd' END AS family, turn % 5 AS font_size, turn % 4 = 1 AS size_override, conv_id % 3 = 1 AS serif, turn % 2 = 1 AS bold, conv_id % 5 = 2 AS italic, span_font,
CASE WHEN span_font IS NOT NULL THEN 9 + turn % 3 END AS span_size, conv_id % 11 = 3 AS span_mono, turn % 7 = 2 AS line_serif, conv_id % 7 = 1 AS line_bold, turn % 3 = 2 AS line_italic, CASE WHEN turn % 6 = 4 THEN conv_id % 2 = 0 END AS run_bold, CASE WHEN turn % 6 = 4 THEN conv_id % 3 = 0 END AS run_italic FROM conversations JOIN span_names ON k = (conv_id * 3 + turn) % 8),
named AS (SELECT e.*, generic, lower(span_font) AS nm, lower(string_split(span_font, '+')[-1]) AS own FROM edits e LEFT JOIN family_names f ON f.family = lower(e.family)),
flags AS (SELECT *, span_font IS NOT NULL AND family IS NULL AS told, CASE WHEN regexp_matches(own, '^(helvetica|arial)') THEN 'sans' WHEN regexp_matches(own, '^times') THEN 'serif' WHEN starts_with(own, 'courier') THEN 'mono' END AS std FROM named),
wished AS (SELECT *, coalesce(generic = 'mono', false) OR (told AND (regexp_matches(nm, '{"|".join(N.MONO)}') OR span_mono OR coalesce(std = 'mono', false))) AS want_mono,
(CASE WHEN told AND regexp_matches(nm, '{"|".join(N.SANS)}') THEN false WHEN told AND regexp_matches(nm, '{"|".join(N.SERIF)}') THEN true ELSE serif OR coalesce(generic = 'serif', false) END) OR (run_bold IS NULL AND line_serif) AS serif0,
coalesce(run_bold, bold OR line_bold) AS want_bold, coalesce(run_italic, italic OR line_italic) AS want_italic, (CASE WHEN span_size > 0 AND NOT size_override THEN span_size WHEN font_size = 0 THEN 12 ELSE font_size END)::DOUBLE AS size FROM flags)"""


def _edits(spark, sf):
    t, c = F.col("turn"), F.col("conv_id")
    family = F.when((c + t) % 6 == 1, "Georgia").when((c + t) % 6 == 3, "COURIER").when((c + t) % 6 == 5, "odd")
    span = F.get(F.array(*map(F.lit, SPANS)), ((c * 3 + t) % 8).cast("int"))
    run = t % 6 == 4
    cols = {
        "doc_id": c, "page_index": (t % 3).cast("int"), "edit_seq": t, "family": family, "font_size": (t % 5).cast("double"), "size_override": t % 4 == 1, "serif": c % 3 == 1, "bold": t % 2 == 1, "italic": c % 5 == 2, "span_font": span,
        "span_size": F.when(span.isNotNull(), (9 + t % 3).cast("double")), "span_mono": c % 11 == 3, "line_serif": t % 7 == 2, "line_bold": c % 7 == 1, "line_italic": t % 3 == 2, "run_bold": F.when(run, c % 2 == 0), "run_italic": F.when(run, c % 3 == 0),
    }
    edits = table(spark, sf, "conversations").select(*(v.alias(k) for k, v in cols.items()))
    return N.wishes(edits, spark.createDataFrame(FAMILIES, "family string, generic string"))


def _faces(spark, sf):
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") % 3).cast("int").alias("page_index")).distinct()
    rows = pages.select("doc_id", "page_index", F.posexplode(F.array(*map(F.lit, FACES))).alias("pos", "name")).filter((F.col("doc_id") + F.col("pos") + F.col("page_index")) % 3 > 0)
    return rows.withColumn("kind", F.when((F.col("doc_id") + F.col("pos")) % 4 == 0, "Type1").otherwise("TrueType"))


@query(f"WITH {SQL_FACES} SELECT doc_id, edit_seq, size, want_mono, serif0 AND NOT want_mono AS want_serif, want_bold, want_italic FROM wished")
def font_wishes(spark, sf):
    return _edits(spark, sf).select("doc_id", "edit_seq", "size", "want_mono", "want_serif", "want_bold", "want_italic")


@query(f"""WITH {SQL_FACES}, w AS (SELECT *, concat(want_bold::INT, want_italic::INT) AS st, EXISTS (SELECT 1 FROM faces f WHERE f.doc_id = d.doc_id AND f.page_index = d.page_index AND lower(string_split(f.name, '+')[-1]) = d.own) AS held, own = 'cmbx10' AS tex FROM wished d),
o AS (SELECT doc_id, edit_seq, 0 AS level, 0 AS pos, concat(lower(family), '_', st) AS font, 'family' AS kind, true AS style_ok FROM w WHERE generic IS NOT NULL
UNION ALL SELECT doc_id, edit_seq, 0, 0, CASE std WHEN 'sans' THEN ['helv', 'hebo', 'heit', 'hebi'] WHEN 'serif' THEN ['tiro', 'tibo', 'tiit', 'tibi'] ELSE ['cour', 'cobo', 'coit', 'cobi'] END[want_bold::INT + 2 * want_italic::INT + 1], 'winansi', true FROM w WHERE generic IS NULL AND std IS NOT NULL AND NOT held
UNION ALL SELECT w.doc_id, edit_seq, 1, f.pos + CASE WHEN lower(string_split(f.name, '+')[-1]) = own THEN 0 ELSE 1048576 END, f.name, 'embedded', contains(f.name, 'Bold') = want_bold AND contains(f.name, 'Italic') = want_italic FROM w JOIN faces f ON f.doc_id = w.doc_id AND f.page_index = w.page_index WHERE span_font IS NOT NULL AND f.kind <> 'Type1' AND f.name NOT LIKE '%CMBX10'
UNION ALL SELECT doc_id, edit_seq, 2, 0, CASE WHEN tex AND generic IS NULL THEN concat('lx_cm_serif_1', want_italic::INT) ELSE concat('ed_', CASE WHEN want_mono THEN 'm' ELSE serif0::INT::VARCHAR END, st) END, 'any', true FROM w)
SELECT doc_id, edit_seq, row_number() OVER (PARTITION BY doc_id, edit_seq ORDER BY level, pos, font)::INT AS rank, font, kind, style_ok FROM o""")
def font_options(spark, sf):
    """Every face that an edit may be drawn with, in order of preference."""
    return N.font_options(_edits(spark, sf), _faces(spark, sf), "doc_id", "edit_seq")


SQL_WINANSI = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", WINANSI)
SQL_DRAWN = f"""chars AS (SELECT item_id, unnest(range(length(t)))::INT AS i, unnest(string_split(t, '')) AS ch FROM (SELECT item_id, CASE WHEN item_id % 4 = 1 THEN concat(text, chr(8377)) ELSE text END AS t FROM benchmark) WHERE length(t) > 0),
drawn AS (SELECT item_id, i, ch, CASE WHEN ch BETWEEN 'a' AND 'z' AND ascii(ch) % 3 <> item_id % 3 THEN concat('page', item_id % 3) WHEN item_id % 2 = 0 AND NOT regexp_matches(ch, '{SQL_WINANSI}') THEN 'base' WHEN item_id % 2 = 0 OR item_id % 5 <> 0 THEN 'full' ELSE concat('page', item_id % 3) END AS font FROM chars)"""


def _drawn(spark, sf):
    """Each text may use a face with two thirds of the letters, a standard one or not, and one for all or not."""
    k = F.col("item_id")
    rows = table(spark, sf, "benchmark").select(k, F.when(k % 4 == 1, F.concat("text", F.lit("₹"))).otherwise(F.col("text")).alias("t"))
    chars = rows.filter("t <> ''").select(k, F.posexplode(F.split("t", "")).alias("i", "ch"))
    given = lambda rank, font, kind: F.struct(F.lit(rank).alias("rank"), font.alias("font"), F.lit(kind).alias("kind"))
    options = F.array(given(1, F.concat(F.lit("page"), (k % 3).cast("string")), "embedded"), F.when(k % 2 == 0, given(2, F.lit("base"), "winansi")), F.when((k % 2 == 0) | (k % 5 != 0), given(3, F.lit("full"), "any")))
    charsets = spark.range(97, 123).select(F.chr("id").alias("ch"), F.explode(F.array(*map(F.lit, range(3)))).alias("f"), "id").filter("id % 3 <> f").select(F.concat(F.lit("page"), F.col("f").cast("string")).alias("font"), "ch")
    return N.char_fonts(chars, rows.select(k, F.inline(F.filter(options, lambda x: x.isNotNull()))), charsets, "item_id")


@query(f"WITH {SQL_DRAWN} SELECT * FROM drawn")
def char_fonts(spark, sf):
    return _drawn(spark, sf).select("item_id", "i", "ch", "font")


@query(f"""WITH {SQL_DRAWN}, g AS (SELECT *, (font IS DISTINCT FROM lag(font) OVER (PARTITION BY item_id ORDER BY i))::INT AS s FROM drawn), r AS (SELECT *, sum(s) OVER (PARTITION BY item_id ORDER BY i) AS run FROM g) SELECT item_id, run::BIGINT AS run, any_value(font) AS font, string_agg(ch, '' ORDER BY i) AS text FROM r GROUP BY item_id, run""")
def font_runs(spark, sf):
    return N.font_runs(_drawn(spark, sf), "item_id")
