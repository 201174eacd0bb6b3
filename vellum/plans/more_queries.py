"""Further gates, geometry, style models and edit-set operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators import fonts as N
from vellum.operators import pages as P
from vellum.operators import styles as S
from vellum.plans.other_queries import SQL_FONTS, _fonts
from vellum.plans.registry import query
from vellum.sources.layout import SQL_ITEMS, SQL_LINES, items, lines, table

LETTERS, DIGITS = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))", "length(regexp_replace(text, '[^0-9]', '', 'g'))"


def _n(p):
    return F.regexp_count("text", F.lit(p))


@query(f"""WITH {SQL_ITEMS} SELECT doc_id, line_no, word_no FROM layout_items WHERE CASE WHEN row IN (0, 19) THEN ocr_conf >= 55 AND ({DIGITS} >= 1 OR {LETTERS} >= 3) ELSE ocr_conf >= 40 OR ({LETTERS} >= 3 AND {LETTERS} >= length(trim(text)) * 0.5) OR ({DIGITS} >= 3 AND ocr_conf >= 20) OR ({LETTERS} >= 1 AND ocr_conf >= 55) OR ({LETTERS} >= 2 AND ocr_conf >= 30) OR ({DIGITS} >= 1 AND ocr_conf >= 45) OR (regexp_matches(trim(text), '^[Ia]$') AND ocr_conf >= 25) END""")
def ocr_region_words(spark, sf):
    """Words of a region pass: strict in the margin bands, generous in blocks."""
    conf, a, d = F.col("ocr_conf"), _n("[A-Za-z]"), _n("[0-9]")
    margin = (conf >= 55) & ((d >= 1) | (a >= 3))
    block = (conf >= 40) | ((a >= 3) & (a >= F.length(F.trim("text")) * 0.5)) | ((d >= 3) & (conf >= 20)) | ((a >= 1) & (conf >= 55)) | ((a >= 2) & (conf >= 30)) | ((d >= 1) & (conf >= 45)) | (F.trim("text").rlike("^[Ia]$") & (conf >= 25))
    return items(spark, sf).filter(F.when(F.col("row").isin(0, 19), margin).otherwise(block)).select("doc_id", "line_no", "word_no")


@query(f"""WITH {SQL_ITEMS} SELECT doc_id, line_no, word_no FROM layout_items WHERE ({LETTERS} >= 3 AND {LETTERS} >= length(trim(text)) * 0.5 AND ocr_conf >= 55) OR ({DIGITS} >= 3 AND ocr_conf >= 55) OR (regexp_matches(trim(text), '^[0-9.,]{{1,4}}$') AND ocr_conf >= 50)""")
def ocr_leftover_words(spark, sf):
    conf, a, d = F.col("ocr_conf"), _n("[A-Za-z]"), _n("[0-9]")
    keep = ((a >= 3) & (a >= F.length(F.trim("text")) * 0.5) & (conf >= 55)) | ((d >= 3) & (conf >= 55)) | (F.trim("text").rlike("^[0-9.,]{1,4}$") & (conf >= 50))
    return items(spark, sf).filter(keep).select("doc_id", "line_no", "word_no")


@query(f"""WITH {SQL_LINES} SELECT doc_id, line_no FROM layout_lines WHERE (line_no * 13 + doc_id) % 100 < 45 AND (regexp_matches(text, '[A-Za-z]{{3,}}') OR regexp_matches(text, '\\d{{3,}}') OR regexp_matches(trim(text), '^[0-9.,]{{1,4}}$'))""")
def search_only_lines(spark, sf):
    """Lines too weak to draw that are worth finding."""
    worth = F.col("text").rlike("[A-Za-z]{3,}") | F.col("text").rlike(r"\d{3,}") | F.trim("text").rlike("^[0-9.,]{1,4}$")
    return lines(spark, sf).filter(((F.col("line_no") * 13 + F.col("doc_id")) % 100 < 45) & worth).select("doc_id", "line_no")


@query("""SELECT event_id, least(x0, x1) AS "left", greatest(x0, x1) AS "right", least(y0, y1) AS top, greatest(y0, y1) AS bottom FROM (SELECT event_id, event_id * 7 % 600 AS x0, event_id * 13 % 600 AS x1, event_id * 5 % 790 AS y0, event_id * 3 % 790 AS y1 FROM events)""")
def link_rectangles(spark, sf):
    """Annotation rectangles given by any two corners."""
    k = F.col("event_id")
    c = {"x0": k * 7 % 600, "x1": k * 13 % 600, "y0": k * 5 % 790, "y1": k * 3 % 790}
    return table(spark, sf, "events").select("event_id", F.least(c["x0"], c["x1"]).alias("left"), F.greatest(c["x0"], c["x1"]).alias("right"), F.least(c["y0"], c["y1"]).alias("top"), F.greatest(c["y0"], c["y1"]).alias("bottom"))


@query(f"""WITH {SQL_ITEMS}, s AS (SELECT doc_id, line_no, word_no, "left" AS x, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY word_no) AS k FROM layout_items), n AS (SELECT doc_id, line_no, floor(avg(x) * 1)::DOUBLE AS px FROM s GROUP BY ALL)
SELECT n.doc_id, n.line_no, min(abs(x - px))::DOUBLE AS dist, CASE WHEN 10 + arg_min(word_no, abs(x - px) * 100000 + word_no) % 5 > 12.2 THEN (10 + arg_min(word_no, abs(x - px) * 100000 + word_no) % 5)::DOUBLE ELSE 12.0 END AS size FROM n JOIN s USING (doc_id, line_no) GROUP BY n.doc_id, n.line_no""")
def nearest_char_size(spark, sf):
    """The nearest glyph's size, adopted only if clearly above the span's."""
    it = items(spark, sf).select("doc_id", "line_no", "word_no", F.col("left").alias("x"))
    probe = it.groupBy("doc_id", "line_no").agg(F.floor(F.avg("x")).cast("double").alias("px"))
    near = it.join(probe, ["doc_id", "line_no"]).groupBy("doc_id", "line_no").agg(F.min(F.struct(F.abs(F.col("x") - F.col("px")).alias("d"), "word_no")).alias("b"))
    size = (10 + F.col("b.word_no") % 5).cast("double")
    return near.select("doc_id", "line_no", F.col("b.d").alias("dist"), F.when(size > 12.2, size).otherwise(12.0).alias("size"))


@query(f"""WITH {SQL_ITEMS}, m AS (SELECT doc_id, line_no, 5 AS s, 17 AS e FROM layout_lines), j AS (SELECT i.doc_id, i.line_no, "left" + 6 * (greatest(s, o) - o) AS a, "left" + 6 * (least(e, o + length(text)) - o) AS b FROM layout_items i JOIN m USING (doc_id, line_no) WHERE o + length(text) > s AND o < e) SELECT doc_id, line_no, min(a)::DOUBLE AS x0, max(b)::DOUBLE AS x1 FROM j GROUP BY ALL""")
def match_rectangles(spark, sf):
    """Boxes of a match by characters, parts of words in proportion."""
    o, n = F.col("o"), F.length("text")
    w = F.col("right") - F.col("left")
    a = F.col("left") + w * (F.greatest(F.lit(5), o) - o) / n
    b = F.col("left") + w * (F.least(F.lit(17), o + n) - o) / n
    return items(spark, sf).filter((o + n > 5) & (o < 17)).groupBy("doc_id", "line_no").agg(F.round(F.min(a), 6).alias("x0"), F.round(F.max(b), 6).alias("x1"))


@query(f"""WITH {SQL_LINES}, im AS (SELECT DISTINCT doc_id, page_index, 60.0 + doc_id % 100 AS x0, 30.0 + doc_id % 200 AS y0, 160.0 + doc_id % 400 AS x1, 60.0 + doc_id % 500 AS y1 FROM layout_lines)
SELECT l.doc_id, l.line_no FROM layout_lines l JOIN im USING (doc_id, page_index) WHERE x1 > x0 AND y1 > y0 AND x0 < "right" AND x1 > "left" AND y0 < bottom AND y1 > top AND (x1 - x0) * (y1 - y0) < 0.4 * 612 * 792 AND NOT (x0 <= "left" AND y0 <= top AND x1 >= "right" AND y1 >= bottom)""")
def cover_holes(spark, sf):
    """Lines whose cover must leave a hole for an image that meets it."""
    d = F.col("doc_id")
    im = {"x0": 60.0 + d % 100, "y0": 30.0 + d % 200, "x1": 160.0 + d % 400, "y1": 60.0 + d % 500}
    ln = {"x0": F.col("left"), "y0": F.col("top"), "x1": F.col("right"), "y1": F.col("bottom")}
    inside = (im["x0"] <= ln["x0"]) & (im["y0"] <= ln["y0"]) & (im["x1"] >= ln["x1"]) & (im["y1"] >= ln["y1"])
    meets = (im["x1"] > im["x0"]) & (im["y1"] > im["y0"]) & (im["x0"] < ln["x1"]) & (im["x1"] > ln["x0"]) & (im["y0"] < ln["y1"]) & (im["y1"] > ln["y0"])
    return lines(spark, sf).filter(meets & (G.area(im) < 0.4 * 612 * 792) & ~inside).select("doc_id", "line_no")


@query("""WITH r AS (SELECT event_id // 10 AS page, event_type AS lang, avg(value) AS conf FROM events GROUP BY ALL) SELECT page, CASE WHEN arg_max(lang, conf) <> 'click' AND max(conf) >= 55 THEN arg_max(lang, conf) END AS lang FROM r GROUP BY 1""")
def best_language(spark, sf):
    """The reading with most confidence, if good enough and not the default."""
    # a sum of doubles depends on its order: that of the events, however they are dealt; equal readings go by the first event
    values = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("event_id", "value"))))
    r = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 10).alias("page"), F.col("event_type").alias("lang")).agg(values.alias("v"), F.min("event_id").alias("first"))
    r = r.withColumn("conf", F.aggregate("v", F.lit(0.0), lambda s, x: s + x["value"]) / F.nullif(F.size("v"), F.lit(0)))
    b = r.groupBy("page").agg(F.max_by("lang", F.when(F.col("conf").isNotNull(), F.struct("conf", -F.col("first")))).alias("l"), F.max("conf").alias("c"))
    return b.select("page", F.when((F.col("l") != "click") & (F.col("c") >= 55), F.col("l")).alias("lang"))


@query(f"""WITH {SQL_ITEMS}, ink AS (SELECT doc_id // 8 AS page_id, word_no AS x, line_no AS y FROM layout_items WHERE length(text) % 3 = 0), a AS (SELECT page_id, deg, floor(y + x * tan(radians(deg)) + 0.5) AS r, count(*) AS n FROM ink, unnest(range(-10, 11)) AS u(k), (SELECT 0.5 AS step) AS st, LATERAL (SELECT k * step AS deg) AS d GROUP BY ALL),
v AS (SELECT page_id, deg, sum(n * n) AS score FROM a GROUP BY ALL) SELECT page_id, score::BIGINT AS score, deg::DOUBLE AS deg FROM v""")
def skew_scores(spark, sf):
    """Sum of squares of the row projection at each angle; the largest tells the skew."""
    ink = items(spark, sf).filter(F.length("text") % 3 == 0).select(F.floor(F.col("doc_id") / 8).alias("page_id"), F.col("word_no").alias("x"), F.col("line_no").alias("y"))
    a = ink.withColumn("deg", F.explode(F.array(*[F.lit(k * 0.5) for k in range(-10, 11)])))
    n = a.groupBy("page_id", "deg", G.js_round(F.col("y") + F.col("x") * F.tan(F.radians("deg"))).alias("r")).agg(F.count("*").alias("n"))
    return n.groupBy("page_id", "deg").agg(F.sum(F.col("n") * F.col("n")).alias("score"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '₹' || p_size || ' ' || replace(p_name, 'a', '₹') ELSE '`' || p_size || ' ' || replace(p_name, 'a', '`') END AS text FROM part""")
def grave_repair(spark, sf):
    """Graves in texts whose face can't be used again stand for rupees."""
    t = F.concat(F.lit("`"), F.col("p_size").cast("string"), F.lit(" "), F.replace("p_name", F.lit("a"), F.lit("`")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.replace(t, F.lit("`"), F.lit("₹"))).otherwise(t).alias("text"))


@query(f"""WITH {SQL_LINES}, e AS (SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'center' END AS al, "left" AS x, "right" AS r, 6 * (length(text) + line_no % 5)::DOUBLE AS w FROM layout_lines)
SELECT doc_id, line_no, greatest(20.0, CASE al WHEN 'right' THEN r - w WHEN 'center' THEN (x + r) / 2 - w / 2 ELSE x END)::DOUBLE AS x, greatest(20.0, CASE al WHEN 'right' THEN r - w WHEN 'center' THEN (x + r) / 2 - w / 2 ELSE x END) + w AS link_right FROM e""")
def align_anchor(spark, sf):
    """Where a replaced line starts so that its alignment stays, and its link's right edge."""
    k = F.col("line_no") % 3
    w = 6.0 * (F.length("text") + F.col("line_no") % 5)
    x = F.greatest(F.lit(20.0), F.when(k == 1, F.col("right") - w).when(k == 2, (F.col("left") + F.col("right")) / 2 - w / 2).otherwise(F.col("left")))
    return lines(spark, sf).select("doc_id", "line_no", x.alias("x"), (x + w).alias("link_right"))


@query("""WITH c AS (SELECT event_id // 20 AS path, event_id % 20 AS k, event_id * 7 % 300 AS x, event_id * 11 % 200 AS y, event_id * 13 % 300 AS cx, event_id * 17 % 200 AS cy FROM events)
SELECT path, min(least(x, CASE WHEN k % 3 = 2 THEN cx ELSE x END))::BIGINT AS x0, max(greatest(x, CASE WHEN k % 3 = 2 THEN cx ELSE x END))::BIGINT AS x1, min(least(y, CASE WHEN k % 3 = 2 THEN cy ELSE y END))::BIGINT AS y0, max(greatest(y, CASE WHEN k % 3 = 2 THEN cy ELSE y END))::BIGINT AS y1 FROM c GROUP BY 1""")
def path_bounds(spark, sf):
    """Bounds of drawn paths with their control points."""
    e = F.col("event_id")
    curve = e % 20 % 3 == 2
    x, y, cx, cy = e * 7 % 300, e * 11 % 200, F.when(curve, e * 13 % 300), F.when(curve, e * 17 % 200)
    return table(spark, sf, "events").groupBy(F.floor(e / 20).alias("path")).agg(
        F.min(F.least(x, cx)).alias("x0"), F.max(F.greatest(x, cx)).alias("x1"), F.min(F.least(y, cy)).alias("y0"), F.max(F.greatest(y, cy)).alias("y1")
    )


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS id, 1000 + p_partkey % 7 * 900 AS w, 1000 + p_partkey % 5 * 1100 AS h FROM part), g(id, w, h, cols, rws) AS (SELECT id, w, h, greatest(1, floor(sqrt(8.0 * w / h) + 0.5))::INT, greatest(1, ceil(8.0 / greatest(1, floor(sqrt(8.0 * w / h) + 0.5))))::INT FROM s
UNION ALL SELECT id, w, h, CASE WHEN w / cols::DOUBLE >= h / rws::DOUBLE THEN cols + 1 ELSE cols END, CASE WHEN w / cols::DOUBLE >= h / rws::DOUBLE THEN rws ELSE rws + 1 END FROM g WHERE (w / cols::DOUBLE) * (h / rws::DOUBLE) > 1500000)
SELECT id, max(cols)::INT AS cols, max(rws)::INT AS "rows" FROM g GROUP BY id""")
def tile_grid(spark, sf):
    """A grid of about eight tiles, refined along the longer tile side until tiles are small enough."""
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (1000 + F.col("p_partkey") % 7 * 900).alias("w"), (1000 + F.col("p_partkey") % 5 * 1100).alias("h"))
    cols = F.greatest(F.lit(1), G.js_round(F.sqrt(8.0 * F.col("w") / F.col("h"))).cast("int"))
    rows = F.greatest(F.lit(1), F.ceil(8.0 / cols).cast("int"))

    def step(acc, _):
        tw, th = F.col("w") / acc["cols"], F.col("h") / acc["rows"]
        small, wide = tw * th <= 1500000, tw >= th
        return F.struct(F.when(~small & wide, acc["cols"] + 1).otherwise(acc["cols"]).alias("cols"), F.when(~small & ~wide, acc["rows"] + 1).otherwise(acc["rows"]).alias("rows"))

    # each step adds one column or row, so area over the tile limit bounds the steps
    return s.select("id", F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(cols.alias("cols"), rows.alias("rows")), step).alias("g")).select("id", "g.cols", "g.rows")


@query(f"""WITH {SQL_LINES}, e AS (SELECT doc_id, line_no, radians(10 + line_no % 60) AS a, top + 9.6 AS bl, "left" AS x, greatest("right" - "left", 7.2) AS n FROM layout_lines), c AS (SELECT *, [x + 12 * sin(a), x - 4.2 * sin(a), x + n * cos(a) + 12 * sin(a), x + n * cos(a) - 4.2 * sin(a)] AS xs, [bl - 12 * cos(a), bl + 4.2 * cos(a), bl + n * sin(a) - 12 * cos(a), bl + n * sin(a) + 4.2 * cos(a)] AS ys FROM e)
SELECT doc_id, line_no, round(greatest(0, list_min(xs) - 1), 4)::DOUBLE AS x0, round(greatest(0, list_min(ys) - 1), 4)::DOUBLE AS y0, round(least(612, list_max(xs) + 1), 4)::DOUBLE AS x1, round(least(792, list_max(ys) + 1), 4)::DOUBLE AS y1 FROM c""")
def rotated_redaction(spark, sf):
    """Rectangles around rotated lines: their length along the turn, an em box across, clamped to the page."""
    a, bl, x = F.radians(10 + F.col("line_no") % 60), F.col("top") + 9.6, F.col("left")
    n = F.greatest(F.col("right") - F.col("left"), F.lit(7.2))
    xs = F.array(*[x + t * F.cos(a) - s * F.sin(a) for t in (F.lit(0.0), n) for s in (-12.0, 4.2)])
    ys = F.array(*[bl + t * F.sin(a) + s * F.cos(a) for t in (F.lit(0.0), n) for s in (-12.0, 4.2)])
    r = lambda c, k: F.round(c, 4).alias(k)
    return lines(spark, sf).select(
        "doc_id", "line_no", r(F.greatest(F.lit(0.0), F.array_min(xs) - 1), "x0"), r(F.greatest(F.lit(0.0), F.array_min(ys) - 1), "y0"), r(F.least(F.lit(612.0), F.array_max(xs) + 1), "x1"), r(F.least(F.lit(792.0), F.array_max(ys) + 1), "y1")
    )


@query("""SELECT p_partkey, CASE WHEN q >= 1 THEN 18 / q ELSE 18 END::DOUBLE AS w, CASE WHEN q >= 1 THEN 18 ELSE 18 * q END::DOUBLE AS h, greatest(0, least(x - CASE WHEN q >= 1 THEN 18 / q ELSE 18 END / 2, 612 - CASE WHEN q >= 1 THEN 18 / q ELSE 18 END))::DOUBLE AS x FROM (SELECT p_partkey, p_size / 20.0::DOUBLE AS q, (p_partkey * 7 % 640)::DOUBLE AS x FROM part)""")
def mark_fit(spark, sf):
    """Marks in an 18 point box keeping their shape, centred and clamped."""
    q, x = F.col("p_size") / 20.0, (F.col("p_partkey") * 7 % 640).cast("double")
    w = F.when(q >= 1, 18 / q).otherwise(18.0)
    return table(spark, sf, "part").select("p_partkey", w.alias("w"), F.when(q >= 1, 18.0).otherwise(18 * q).alias("h"), F.greatest(F.lit(0.0), F.least(x - w / 2, 612 - w)).alias("x"))


@query(f"""WITH {SQL_LINES}, e AS (SELECT doc_id, line_no, (10 + line_no % 20)::DOUBLE AS v, (10 + line_no % 20) * 0.5 * length(text) AS w FROM layout_lines) SELECT doc_id, line_no, CASE WHEN w > 540 THEN greatest(4, floor(v * 540 / w * 10 + 0.5) / 10) ELSE v END AS size FROM e""")
def size_cap(spark, sf):
    """Sizes cut so that a line still fits the page width."""
    v = (10 + F.col("line_no") % 20).cast("double")
    w = v * 0.5 * F.length("text")
    return lines(spark, sf).select("doc_id", "line_no", F.when(w > 540, F.greatest(F.lit(4.0), G.js_round(v * 540 / w * 10) / 10)).otherwise(v).alias("size"))


@query("""WITH h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, (least(n, 4) - r)::BIGINT AS slot FROM h WHERE r <= 4""")
def annotation_history(spark, sf):
    """History capped at four snapshots: the newest stay, numbered from the oldest kept."""
    w = Window.partitionBy("conv_id")
    h = table(spark, sf, "conversations").withColumns({"r": F.row_number().over(w.orderBy(F.desc("turn"))), "n": F.count("*").over(w)})
    return h.filter("r <= 4").select("conv_id", "turn", (F.least("n", F.lit(4)) - F.col("r")).alias("slot"))


@query("""SELECT p_partkey AS id, u.i AS at, substr(p_name, 1, p_size % 4 * u.i) AS text, CASE WHEN u.i = 1 THEN p_size % 2 = 0 ELSE p_size % 3 = 0 END AS bold, greatest(4, least(400, CASE WHEN u.i = 1 THEN 12 ELSE p_size * p_size END))::DOUBLE AS size FROM part, unnest([1, 2]) AS u(i) WHERE p_size % 4 > 0""")
def run_model_clean(spark, sf):
    """Two runs of each part: those without text go, sizes by default 12 and within 4 to 400, weight inherited."""
    size = F.col("p_size")
    run = lambda i, s, b: F.struct(F.expr(f"substring(p_name, 1, p_size % 4 * {i})").alias("text"), s.cast("double").alias("size"), b.alias("bold"), F.lit(None).cast("boolean").alias("italic"), F.lit(None).cast("boolean").alias("underline"), F.lit(None).cast("string").alias("link"))
    runs = F.array(F.array(run(1, F.lit(None), F.lit(None).cast("boolean")), run(2, size * size, size % 3 == 0)))
    clean = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(S.cleaned_runs(runs, F.lit(12.0), size % 2 == 0, F.lit(False))).alias("line"))
    return clean.select("id", F.posexplode("line").alias("at", "r")).select("id", (F.col("at") + 1).alias("at"), "r.text", "r.bold", "r.size")


@query("""WITH t AS (SELECT conv_id, turn, turn % 2 = 0 AS own FROM conversations), b AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bold, CASE conv_id % 4 WHEN 1 THEN 'http://x' WHEN 2 THEN '' END AS link, count(*) AS n, count(*) FILTER (WHERE own) AS owned FROM t GROUP BY 1)
SELECT conv_id, (CASE WHEN bold IS NULL THEN owned WHEN bold THEN n ELSE 0 END)::INT AS n_bold, nullif(link, '') AS link, coalesce(link = '', false) AS link_removed, bold IS NOT NULL AS bold_set FROM b""")
def style_broadcast(spark, sf):
    """A box's style written into all its runs, the conversation's turns; clearing a link leaves a tombstone."""
    k = F.col("conv_id")
    box = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", (F.col("turn") % 2 == 0).alias("bold"))).alias("runs"))
    box = box.withColumns({"bold": F.when(k % 3 == 0, True).when(k % 3 == 1, False), "link": F.when(k % 4 == 1, "http://x").when(k % 4 == 2, "")})
    runs = F.transform("runs", lambda r: r.withField("bold", F.coalesce(F.col("bold"), r["bold"])))
    return box.select("conv_id", F.size(F.filter(runs, lambda r: r["bold"])).alias("n_bold"), F.nullif("link", F.lit("")).alias("link"), F.coalesce(F.col("link") == "", F.lit(False)).alias("link_removed"), F.col("bold").isNotNull().alias("bold_set"))


@query("""WITH l AS (SELECT conv_id, max(turn) AS last, max(turn) FILTER (WHERE turn % 5 = 4) AS cleared FROM conversations GROUP BY 1) SELECT conv_id, count(*) FILTER (WHERE turn > coalesce(cleared, -1))::BIGINT AS standing FROM conversations JOIN l USING (conv_id) GROUP BY 1""")
def discard_all(spark, sf):
    """Edits that stand after the last clear operation of the log."""
    w = Window.partitionBy("conv_id")
    c = table(spark, sf, "conversations").withColumn("cleared", F.max(F.when(F.col("turn") % 5 == 4, F.col("turn"))).over(w))
    return c.groupBy("conv_id").agg(F.count_if(F.col("turn") > F.coalesce("cleared", F.lit(-1))).alias("standing"))


@query(f"""WITH {SQL_ITEMS}, k AS (SELECT doc_id, line_no, count(*) FILTER (WHERE length(text) > 1) AS known, count(*) AS n, bool_and(bold) AS ab FROM layout_items GROUP BY ALL) SELECT doc_id, line_no, known = n AND ab AS bold FROM k""")
def style_refine(spark, sf):
    """A line is set bold only when every item's font is known and bold."""
    k = items(spark, sf).groupBy("doc_id", "line_no").agg(F.count_if(F.length("text") > 1).alias("known"), F.count("*").alias("n"), F.bool_and("bold").alias("ab"))
    return k.select("doc_id", "line_no", ((F.col("known") == F.col("n")) & F.col("ab")).alias("bold"))


@query(f"""WITH {SQL_FONTS}, a AS (SELECT DISTINCT 'Face' || s_nationkey AS name FROM supplier UNION ALL VALUES ('Tinos'), ('Arial'), ('Georgia')) SELECT b.name, CASE WHEN a.name IS NOT NULL THEN b.name END AS face, CASE WHEN a.name IS NULL THEN (CASE WHEN contains(n, 'mono') OR contains(n, 'courier') THEN 'mono' WHEN contains(n, 'times') OR contains(n, 'roman') THEN 'serif' ELSE 'sans' END) END AS family FROM b LEFT JOIN a ON a.name = b.name""")
def unregistered_faces(spark, sf):
    """Faces of all parts that no supplier registers and that aren't bundled give way to a family."""
    bundled = spark.createDataFrame([("Tinos",), ("Arial",), ("Georgia",)], "face string")
    known = table(spark, sf, "supplier").select(F.concat(F.lit("Face"), F.col("s_nationkey").cast("string")).alias("face")).unionByName(bundled).distinct()
    n = F.lower(F.element_at(F.split("name", r"\+"), -1))
    family = F.when(N.holds(n, ("mono", "courier")), "mono").when(N.holds(n, ("times", "roman")), "serif").otherwise("sans")
    both = _fonts(spark, sf).join(known, F.col("name") == F.col("face"), "left")
    return both.select("name", "face", F.when(F.col("face").isNull(), family).alias("family"))


@query("""WITH c AS (SELECT p_partkey AS id, u.i AS pos, concat('face-', (p_partkey * (u.i + 3)) % 40) AS file FROM part, unnest(range(4)) AS u(i)), a AS (SELECT DISTINCT concat('face-', s_nationkey) AS file FROM supplier) SELECT c.id, coalesce(arg_min(c.file, pos) FILTER (WHERE a.file IS NOT NULL), 'builtin') AS file FROM c LEFT JOIN a ON a.file = c.file GROUP BY 1""")
def font_file_choice(spark, sf):
    """The first of each part's four candidates that is among the suppliers' faces, else the built-in face."""
    face = lambda k: F.concat(F.lit("face-"), k.cast("string"))
    have = table(spark, sf, "supplier").select(face(F.col("s_nationkey")).alias("file"), F.lit(True).alias("have")).distinct()
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).withColumn("file", face(F.col("id") * (F.col("pos") + 3) % 40))
    return c.join(have, "file", "left").groupBy("id").agg(F.coalesce(F.min_by("file", F.when(F.col("have"), F.col("pos"))), F.lit("builtin")).alias("file"))


@query("""SELECT item_id, i::INT AS i, ch, CASE WHEN regexp_matches(ch, '[a-m]') THEN 'page' WHEN regexp_matches(ch, '[a-zA-Z ]') THEN 'bundled' ELSE 'fallback' END AS font FROM (SELECT item_id, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS ch FROM benchmark WHERE length(text) > 0)""")
def char_font_choice(spark, sf):
    """For each character the first font of the preference order that has it."""
    c = table(spark, sf, "benchmark").filter("text <> ''").select("item_id", F.posexplode(F.split("text", "")).alias("i", "ch"))
    options = (("page", "[a-m]"), ("bundled", "[a-zA-Z ]"))
    return c.withColumn("font", reduce(lambda acc, o: F.when(F.col("ch").rlike(o[1]), o[0]).otherwise(acc), reversed(options), F.lit("fallback")))


@query("""WITH c AS (SELECT item_id, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS ch FROM benchmark WHERE length(text) > 0), f AS (SELECT *, CASE WHEN regexp_matches(ch, '[a-m]') THEN 'page' WHEN regexp_matches(ch, '[a-zA-Z ]') THEN 'bundled' ELSE 'fallback' END AS font FROM c), g AS (SELECT *, (font IS DISTINCT FROM lag(font) OVER (PARTITION BY item_id ORDER BY i))::INT AS s FROM f), r AS (SELECT *, sum(s) OVER (PARTITION BY item_id ORDER BY i) AS run FROM g)
SELECT item_id, run::BIGINT AS run, any_value(font) AS font, string_agg(ch, '' ORDER BY i) AS text FROM r GROUP BY item_id, run""")
def font_segments(spark, sf):
    """Neighbouring characters drawn by one font."""
    w = Window.partitionBy("item_id").orderBy("i")
    c = char_font_choice(spark, sf).withColumn("s", (~F.col("font").eqNullSafe(F.lag("font").over(w))).cast("int"))
    c = c.withColumn("run", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chars = F.transform(F.array_sort(F.collect_list(F.struct("i", "ch"))), lambda x: x["ch"])
    return c.groupBy("item_id", "run").agg(F.first("font").alias("font"), F.array_join(chars, "").alias("text"))


@query("""WITH e AS (SELECT conv_id AS doc_id, turn AS edit_seq, (turn % 3)::INT AS page FROM conversations), rot AS (SELECT DISTINCT doc_id, page, 90 * (1 + (doc_id + page) % 3) AS turned FROM e WHERE (doc_id * 7 + page * 3) % 4 = 1) SELECT doc_id, edit_seq, page FROM e WHERE NOT EXISTS (SELECT 1 FROM rot WHERE rot.doc_id = e.doc_id AND rot.page = e.page AND turned % 360 <> 0)""")
def targeted_rotation(spark, sf):
    """Edits that stay after some of each document's pages were turned: those on the turned pages go."""
    e = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("edit_seq"), (F.col("turn") % 3).cast("int").alias("page"))
    pages = e.select("doc_id", "page").distinct().filter((F.col("doc_id") * 7 + F.col("page") * 3) % 4 == 1)
    turned = pages.filter(90 * (1 + (F.col("doc_id") + F.col("page")) % 3) % 360 != 0)
    return e.join(turned, ["doc_id", "page"], "left_anti").select("doc_id", "edit_seq", "page")


@query("""SELECT doc_id, concat(substr(text, 1, position('the ' IN text) - 1), 'THE-', substr(text, position('the ' IN text) + 4)) AS text, (position('the ' IN text) + 3)::INT AS resume FROM documents WHERE position('the ' IN text) > 0""")
def replace_current(spark, sf):
    """Only the current (first) match is replaced; the search goes on behind it."""
    d = table(spark, sf, "documents").withColumn("k", F.locate("the ", F.col("text"))).filter("k > 0")
    text = F.concat(F.substring("text", F.lit(1), F.col("k") - 1), F.lit("THE-"), F.substring("text", F.col("k") + 4, F.length("text")))
    return d.select("doc_id", text.alias("text"), (F.col("k") + 3).alias("resume"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'erase' ELSE 'text' END AS draw, CASE WHEN turn % 5 = 4 THEN NULL ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS text FROM conversations WHERE turn % 5 <> 3""".replace("\\\\", "\\"))
def pending_previews(spark, sf):
    """What is drawn for edits before they are saved: erasures, and replaced text on one line."""
    t = F.col("turn") % 5
    one = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf, "conversations").filter(t != 3).select("conv_id", "turn", F.when(t == 4, "erase").otherwise("text").alias("draw"), F.when(t != 4, one).alias("text"))


@query("""WITH f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), m AS (SELECT *, conv_id % n AS a, conv_id * 7 % n AS b FROM f)
SELECT conv_id, turn, (CASE WHEN pos = a THEN b WHEN pos > a AND pos <= b THEN pos - 1 WHEN pos < a AND pos >= b THEN pos + 1 ELSE pos END)::INT AS pos FROM m""")
def merge_list_reorder(spark, sf):
    """One file of each merge list moved to another place, both its own."""
    f = table(spark, sf, "conversations").withColumn("p", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    k, n = F.col("conv_id"), F.count("*").over(Window.partitionBy("conv_id"))
    return P.moved(f.withColumns({"from": k % n, "to": k * 7 % n}), "p", "from", "to").select("conv_id", "turn", F.col("p").cast("int").alias("pos"))


@query(f"""WITH {SQL_LINES}, g AS (SELECT *, top - lag(bottom) OVER w AS gap FROM layout_lines WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY line_no)) SELECT doc_id, page_index, count(*) FILTER (WHERE coalesce(gap, 0) <= 30)::BIGINT AS joined, count(*) FILTER (WHERE gap > 30)::BIGINT AS apart FROM (SELECT * REPLACE (gap + line_no % 4 * 3 AS gap) FROM g) GROUP BY ALL""")
def region_gaps(spark, sf):
    """Lines that join the region above them, by gaps of 2.5 heights."""
    w = Window.partitionBy("doc_id", "page_index").orderBy("line_no")
    g = lines(spark, sf).withColumn("gap", F.col("top") - F.lag("bottom").over(w) + F.col("line_no") % 4 * 3)
    return g.groupBy("doc_id", "page_index").agg(F.count_if(F.coalesce("gap", F.lit(0.0)) <= 30).alias("joined"), F.count_if(F.col("gap") > 30).alias("apart"))
