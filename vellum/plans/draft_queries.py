"""Draw lists, element logs, recognised words, fonts and trims over the tables, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import drafts as D
from vellum.plans.registry import query
from vellum.sources.layout import SQL_ITEMS, SQL_LINES, items, lines, table

SQL_DRAFTS = """drafts AS (SELECT conv_id AS doc_id, (turn % 3)::INT AS page_index, turn AS edit_seq, CASE WHEN turn % 7 = 6 THEN 'image' ELSE 'text' END AS kind, CASE WHEN conv_id % 5 = 1 AND turn = 1 THEN 'signature' END AS style, CASE WHEN conv_id % 4 = 2 AND turn = 2 THEN concat(text, chr(8377)) ELSE text END AS new_text FROM conversations)"""
SQL_LOST = """charset AS (SELECT chr(c::INT) AS char FROM range(33, 256) AS t(c)), lost AS (SELECT DISTINCT doc_id, page_index, edit_seq FROM (SELECT doc_id, page_index, edit_seq, unnest(string_split(new_text, '')) AS char FROM drafts) WHERE char > ' ' AND char NOT IN (SELECT char FROM charset))"""


def drafts(spark, sf):
    t, c = F.col("turn"), F.col("conv_id")
    text = F.when((c % 4 == 2) & (t == 2), F.concat("text", F.lit("₹"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select(
        c.alias("doc_id"), (t % 3).cast("int").alias("page_index"), t.alias("edit_seq"), F.when(t % 7 == 6, "image").otherwise("text").alias("kind"), F.when((c % 5 == 1) & (t == 1), "signature").alias("style"), text.alias("new_text")
    )


def charset(spark):
    return spark.range(33, 256).select(F.chr("id").alias("char"))


@query(f"WITH {SQL_DRAFTS}, {SQL_LOST} SELECT * FROM lost")
def unembeddable_edits(spark, sf):
    return D.unembeddable(drafts(spark, sf), charset(spark))


SQL_FACES = """faced AS (SELECT *, concat('face', turn_ % 3) AS font, doc_id % 2 = 0 AS base, doc_id % 3 = 0 AS whole FROM (SELECT *, edit_seq AS turn_ FROM drafts)),
unfaced AS (SELECT DISTINCT doc_id, page_index, edit_seq FROM (SELECT *, unnest(regexp_extract_all(new_text, '(?s).')) AS ch FROM faced) WHERE ch > ' ' AND NOT whole AND NOT (base AND ascii(ch) < 256) AND NOT (ascii(ch) BETWEEN 33 AND 126 AND ascii(ch) % 3 <> turn_ % 3))"""


def _faces(spark, sf):
    """Each edit's faces: one that lacks a third of the printable characters, for every other document a standard one, for every third one for all."""
    d = drafts(spark, sf)
    given = lambda rank, font, kind: F.struct(F.lit(rank).alias("rank"), font.alias("font"), F.lit(kind).alias("kind"))
    own = F.array(given(1, F.concat(F.lit("face"), (F.col("edit_seq") % 3).cast("string")), "embedded"), F.when(F.col("doc_id") % 2 == 0, given(2, F.lit("base"), "winansi")), F.when(F.col("doc_id") % 3 == 0, given(3, F.lit("full"), "any")))
    options = d.select("doc_id", "page_index", "edit_seq", F.inline(F.filter(own, lambda x: x.isNotNull())))
    charsets = spark.range(33, 127).select(F.chr("id").alias("ch"), "id", F.explode(F.array(*map(F.lit, range(3)))).alias("f")).filter("id % 3 <> f").select(F.concat(F.lit("face"), F.col("f").cast("string")).alias("font"), "ch")
    return d, D.undrawable(d, options, charsets)


@query(f"WITH {SQL_DRAFTS}, {SQL_FACES} SELECT * FROM unfaced")
def undrawable_edits(spark, sf):
    """Edits with a character that none of their own faces draws."""
    return _faces(spark, sf)[1]


@query(f"""WITH {SQL_DRAFTS}, {SQL_FACES}, d AS (SELECT doc_id, max(kind = 'image' OR coalesce(style = 'signature', false)) AS drawn FROM drafts GROUP BY 1)
SELECT e.doc_id, e.page_index, e.edit_seq, CASE WHEN e.doc_id IN (SELECT doc_id FROM unfaced) THEN 3 WHEN drawn THEN 2 ELSE 1 END::INT AS tier FROM drafts e JOIN d ON d.doc_id = e.doc_id""")
def edit_tiers(spark, sf):
    """How each edit's document is written, by the faces of its own edits."""
    return D.tiers(*_faces(spark, sf)).select("doc_id", "page_index", "edit_seq", "tier")


@query(f"""WITH {SQL_DRAFTS}, {SQL_LOST}, d AS (SELECT doc_id, max(kind = 'image' OR coalesce(style = 'signature', false)) AS drawn FROM drafts GROUP BY 1)
SELECT e.doc_id, e.page_index, e.edit_seq, CASE WHEN e.doc_id IN (SELECT doc_id FROM lost) THEN 3 WHEN drawn THEN 2 ELSE 1 END::INT AS tier FROM drafts e JOIN d ON d.doc_id = e.doc_id""")
def draw_list(spark, sf):
    """Edits that a save draws, with their document's tier."""
    return D.draw_list(drafts(spark, sf), charset(spark)).select("doc_id", "page_index", "edit_seq", "tier")


@query(f"""WITH {SQL_ITEMS} SELECT doc_id, page_index, count(*)::BIGINT AS n FROM layout_items WHERE word_no % 2 = 0 OR ocr_conf IS NULL OR ocr_conf % 10 = 3 OR ocr_conf >= 68 GROUP BY ALL""")
def export_words(spark, sf):
    """Words that an export keeps, by page: every other one is native, some have no confidence."""
    words = items(spark, sf).withColumns({"ocr": F.col("word_no") % 2 == 1, "conf": F.when(F.col("ocr_conf") % 10 != 3, F.col("ocr_conf"))})
    return D.exported(words).groupBy("doc_id", "page_index").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_LINES} SELECT doc_id, line_no FROM layout_lines WHERE top / 792 * 100 BETWEEN 30 AND 80""")
def signature_zone(spark, sf):
    return lines(spark, sf).filter(D.in_signature_zone(F.col("top"), F.lit(792.0))).select("doc_id", "line_no")


@query(f"""WITH {SQL_LINES} SELECT DISTINCT doc_id, page_index FROM layout_lines WHERE line_no % 3 = 1 AND length(text) * (100 + line_no % 5 * 100) > 0.5 * 612 * 792 / 4""")
def scan_backdrop_pages(spark, sf):
    """Pages that one image covers by more than half; images are as wide as their line is long."""
    images = lines(spark, sf).filter("line_no % 3 = 1").select("doc_id", "page_index", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.length("text").cast("double").alias("x1"), (100.0 + F.col("line_no") % 5 * 100).alias("y1"), F.lit(306.0).alias("page_w"), F.lit(396.0).alias("page_h"))
    return D.scan_backdrops(images)


@query(f"""WITH {SQL_LINES} SELECT DISTINCT doc_id, page_index FROM layout_lines WHERE ((doc_id + page_index) % 5 * 90) % 360 = 0""")
def upright_pages(spark, sf):
    pages = lines(spark, sf).select("doc_id", "page_index").distinct()
    return D.upright(pages.withColumn("rotate", (F.col("doc_id") + F.col("page_index")) % 5 * 90)).select("doc_id", "page_index")


@query("""SELECT p_partkey AS id, coalesce(p_partkey % 3 = 1, false) AS restricted FROM part""")
def edit_restriction(spark, sf):
    """No permissions, permissions without changes, permissions with them."""
    k = F.col("p_partkey") % 3
    flags = F.when(k == 1, F.array(F.lit(4), F.lit(16))).when(k == 2, F.array(F.lit(4), F.lit(8)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), D.restricted(flags).alias("restricted"))


@query("""SELECT p_partkey AS id FROM part WHERE CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN p_size % 7 >= 4 AND p_size % 5 >= 4 WHEN 2 THEN 2 * (p_size % 3) >= 2 OR p_size % 5 >= 2 ELSE p_size % 7 >= 2 OR p_size % 5 >= 2 END""")
def kept_shapes(spark, sf):
    k, s = F.col("p_partkey") % 4, F.col("p_size")
    kinds = F.when(k == 0, "line").when(k == 1, "erase").when(k == 2, "ellipse").otherwise("rect")
    shapes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), kinds.alias("type"), F.when(k != 2, s % 7).alias("width"), (s % 5).alias("height"), F.when(k == 2, s % 3).alias("rx"), F.lit(None).cast("int").alias("ry"))
    return D.drawn_shapes(shapes).select("id")


@query(f"""WITH {SQL_DRAFTS} SELECT DISTINCT doc_id FROM drafts WHERE doc_id % 3 <> 0 OR edit_seq >= 4""")
def unsaved_documents(spark, sf):
    """Every third document was saved after its first four edits."""
    e = drafts(spark, sf)
    saved = e.filter("doc_id % 3 = 0 and edit_seq < 4").groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("edit_seq", "page_index", "new_text")))).alias("json"))
    return D.unsaved(e, saved)


SQL_LOG = """log AS (SELECT conv_id AS doc_id, turn % 2 AS element_id, turn AS op_seq, CASE WHEN turn < 2 OR turn % 9 = 8 THEN 'add' WHEN turn % 5 = 4 THEN 'remove' ELSE 'update' END AS op, CASE WHEN turn % 3 <> 2 THEN (turn % 4)::INT END AS page_index, CASE WHEN turn % 5 <> 4 THEN text END AS text, CASE WHEN turn % 2 = 0 OR turn < 2 THEN 10.0 + turn END AS font_size FROM conversations)"""
SQL_STATE = f"""{SQL_LOG}, lives AS (SELECT *, sum((op = 'add')::INT) OVER (PARTITION BY doc_id, element_id ORDER BY op_seq) AS life FROM log), own AS (SELECT * FROM lives WHERE life > 0 QUALIFY life = max(life) OVER (PARTITION BY doc_id, element_id)),
state AS (SELECT doc_id, element_id, arg_max(page_index, op_seq) FILTER (WHERE page_index IS NOT NULL) AS page_index, arg_max(text, op_seq) FILTER (WHERE text IS NOT NULL) AS text, arg_max(font_size, op_seq) FILTER (WHERE font_size IS NOT NULL) AS font_size FROM own GROUP BY ALL HAVING NOT max(op = 'remove'))"""


def _state(spark, sf):
    t = F.col("turn")
    op = F.when((t < 2) | (t % 9 == 8), "add").when(t % 5 == 4, "remove").otherwise("update")
    log = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), (t % 2).alias("element_id"), t.alias("op_seq"), op.alias("op"), F.when(t % 3 != 2, (t % 4).cast("int")).alias("page_index"), F.when(t % 5 != 4, F.col("text")).alias("text"), F.when((t % 2 == 0) | (t < 2), 10.0 + t).alias("font_size"), F.lit(0.5).alias("advance")
    )
    return D.elements(log)


@query(f"WITH {SQL_STATE} SELECT doc_id, element_id, page_index, text, font_size::DOUBLE AS font_size, (length(text) * 0.5 * font_size)::DOUBLE AS width FROM state")
def text_elements(spark, sf):
    """Elements that stand after their log of adds, updates and removals."""
    return _state(spark, sf)


@query(f"WITH {SQL_STATE} SELECT doc_id, element_id, page_index FROM state WHERE page_index IN (0, 1) AND page_index < doc_id % 3")
def page_elements(spark, sf):
    """Elements of pages 0 and 1 and of two that no document has."""
    docs = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    asked = docs.select("doc_id", F.explode(F.array(*map(F.lit, (0, 1, -1, 99)))).alias("page_index"))
    return D.elements_of(_state(spark, sf), asked, docs.withColumn("n_pages", F.col("doc_id") % 3)).select("doc_id", "element_id", "page_index")


@query(f"""WITH {SQL_DRAFTS} SELECT doc_id, edit_seq, CASE WHEN doc_id % 2 = 0 THEN 'Serif' ELSE 'Sans' END AS family, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 14 ELSE 9 + edit_seq % 4 END::BIGINT AS size, edit_seq % 2 = 0 AS bold, CASE WHEN doc_id % 2 = 0 THEN true ELSE false END AS italic, '#000000' AS colour FROM drafts""")
def style_override(spark, sf):
    """The style set once applies to each replacement of its document."""
    e = drafts(spark, sf).select("doc_id", "edit_seq", F.lit("Sans").alias("family"), (9 + F.col("edit_seq") % 4).alias("size"), (F.col("edit_seq") % 2 == 0).alias("bold"), F.lit(False).alias("italic"), F.lit("#000000").alias("colour"))
    docs = e.select("doc_id").distinct().filter("doc_id % 2 = 0")
    override = docs.select("doc_id", F.lit("Serif").alias("family"), F.when(F.col("doc_id") % 3 == 0, 14).cast("long").alias("size"), F.lit(None).cast("boolean").alias("bold"), F.lit(True).alias("italic"), F.lit(None).cast("string").alias("colour"))
    return D.overridden(e, override).select("doc_id", "edit_seq", "family", "size", "bold", "italic", "colour")


@query(f"""WITH {SQL_LINES} SELECT doc_id, line_no, w AS word, i::INT AS at FROM (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM layout_lines)""")
def recogniser_words(spark, sf):
    """Words of recogniser results: even lines come as a tree, odd ones as a flat list."""
    words = F.split("text", " ")
    half = F.ceil(F.size(words) / 2).cast("int")
    line = lambda w: F.struct(w.alias("words"))
    blocks = F.array(F.struct(F.array(F.struct(F.array(line(F.slice(words, F.lit(1), half)), line(F.slice(words, half + 1, F.size(words)))).alias("lines"))).alias("paragraphs")), F.struct(F.lit(None).cast("array<struct<lines:array<struct<words:array<string>>>>>").alias("paragraphs")))
    even = F.col("line_no") % 2 == 0
    rows = lines(spark, sf).select("doc_id", "line_no", F.posexplode(D.tree_words(F.when(even, blocks), F.when(~even, words))).alias("at", "word"))
    return rows.select("doc_id", "line_no", "word", "at")


@query("""WITH m AS (SELECT conv_id, turn % 3 AS dist, turn * 5 % 7 AS start, turn * 5 % 7 + 1 + turn % 4 AS stop FROM conversations) SELECT conv_id, string_agg(concat(dist, ':', start, ':', stop), ',' ORDER BY dist, start, stop DESC) AS matches FROM m GROUP BY 1""")
def matches_in_order(spark, sf):
    t = F.col("turn")
    m = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct((t % 3).alias("dist"), (t * 5 % 7).alias("start"), (t * 5 % 7 + 1 + t % 4).alias("stop"))).alias("m"))
    return m.select("conv_id", F.array_join(F.transform(D.match_order(F.col("m")), lambda x: F.concat_ws(":", x["dist"].cast("string"), x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("matches"))


@query("""WITH fonts AS (SELECT s_suppkey AS key, s_name AS name, concat('nation', s_nationkey) AS tag FROM supplier), asked AS (SELECT * FROM (VALUES (1, ''), (2, ' 00001 '), (3, 'NATION3'), (4, 'zzz')) AS t(query_id, q)),
r AS (SELECT query_id, 1 AS part, 0 AS rank, key, name FROM asked, fonts WHERE trim(q) = '' OR contains(lower(name), lower(trim(q))) OR contains(tag, lower(trim(q))) UNION ALL SELECT 1, 0, key % 100, key, name FROM fonts WHERE key IN (7, 3, 5))
SELECT query_id::INT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, lower(name), key)::INT AS pos, key FROM r""")
def font_picker(spark, sf):
    fonts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.concat(F.lit("nation"), "s_nationkey").alias("tag"))
    recent = fonts.filter("key in (7, 3, 5)").select("key", (F.col("key") % 100).cast("int").alias("rank"))
    return D.font_list(fonts, recent, spark.createDataFrame([(1, ""), (2, " 00001 "), (3, "NATION3"), (4, "zzz")], "query_id int, q string"))


@query(f"""WITH {SQL_LINES}, l AS (SELECT doc_id, line_no, top, top + 6 + length(text) % 40 AS bottom, 6 + length(text) % 40 AS h FROM layout_lines), s AS (SELECT *, least(CASE WHEN h > 0.55 * 14 AND h < 1.7 * 14 THEN least(14, h * 1.15) ELSE h END, 24) AS s0, (top + bottom) / 2 AS mid FROM l), z AS (SELECT *, CASE WHEN mid < 0.15 * 792 OR mid > 0.82 * 792 THEN least(s0, 12 * 1.1) ELSE s0 END AS size FROM s)
SELECT doc_id, line_no, size::DOUBLE AS size, (CASE WHEN h > size * 1.6 THEN least(bottom, top + size * 1.35) ELSE bottom END)::DOUBLE AS tight_bottom, (CASE WHEN h > size * 1.6 THEN top + size * 0.9 ELSE bottom END)::DOUBLE AS tight_base FROM z""")
def readable_line_size(spark, sf):
    ln = lines(spark, sf).withColumns({"bottom": F.col("top") + 6 + F.length("text") % 40, "dom_line": F.lit(14.0), "dom_font": F.lit(12.0), "page_h": F.lit(792.0), "baseline": F.lit(None).cast("double")})
    return D.line_size(ln).select("doc_id", "line_no", "size", "tight_bottom", "tight_base")


@query(f"""WITH {SQL_LINES}, p AS (SELECT doc_id AS image_id, line_no % 20 AS y, k AS x, (length(text) * 7 + k * 13) % 40 AS alpha FROM layout_lines, unnest(range(30)) AS u(k) WHERE line_no < 20), b AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p WHERE alpha > 12 AND x BETWEEN 9 AND 20 GROUP BY 1)
SELECT image_id, greatest(0, x0 - 8)::INT AS x, greatest(0, y0 - 8)::INT AS y, (least(29, x1 + 8) - greatest(0, x0 - 8) + 1)::INT AS w, (least(19, y1 + 8) - greatest(0, y0 - 8) + 1)::INT AS h FROM b""")
def trimmed_images(spark, sf):
    px = lines(spark, sf).filter("line_no < 20").select(F.col("doc_id").alias("image_id"), (F.col("line_no") % 20).alias("y"), F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("x"))
    alpha = F.when(F.col("x").between(9, 20), (F.col("n") * 7 + F.col("x") * 13) % 40).otherwise(0)
    return D.trimmed(px.withColumns({"alpha": alpha, "w": F.lit(30), "h": F.lit(20)}))


@query(f"""WITH {SQL_LINES}, s AS (SELECT doc_id, page_index, line_no, CASE line_no % 4 WHEN 0 THEN 'ABCDEF+CMR10' WHEN 1 THEN 'Helvetica' WHEN 2 THEN 'xyzabc+Old' ELSE 'cmr10' END AS font FROM layout_lines), f AS (SELECT doc_id, page_index, line_no % 4 AS k FROM layout_lines WHERE line_no % 4 IN (0, 2))
SELECT DISTINCT doc_id, page_index, line_no FROM s WHERE (lower(font) LIKE '%cmr10' AND EXISTS (SELECT 1 FROM f WHERE f.doc_id = s.doc_id AND f.page_index = s.page_index AND k = 0)) OR (font = 'xyzabc+Old' AND EXISTS (SELECT 1 FROM f WHERE f.doc_id = s.doc_id AND f.page_index = s.page_index AND k = 2))""")
def unreusable_spans(spark, sf):
    k = F.col("line_no") % 4
    spans = lines(spark, sf).select("doc_id", "page_index", "line_no", F.when(k == 0, "ABCDEF+CMR10").when(k == 1, "Helvetica").when(k == 2, "xyzabc+Old").otherwise("cmr10").alias("font"))
    fonts = spans.filter("line_no % 2 = 0").select("doc_id", "page_index", F.col("font").alias("name"), F.when(k == 2, "Type1").otherwise("TrueType").alias("kind"))
    return D.unreusable(spans, fonts).select("doc_id", "page_index", "line_no")
