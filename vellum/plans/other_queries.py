"""Rate limits, raster, fonts, colours and placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators import fonts as N
from vellum.operators import raster as R
from vellum.plans.registry import query
from vellum.sources.layout import SQL_ITEMS, items, parts, table
from vellum.streaming import rate_limit as L


def requests(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("req_id"), "ts", (F.col("user_id") % 5).alias("client"))


SQL_DECIDED = "SELECT event_id AS req_id, row_number() OVER (PARTITION BY user_id % 5, time_bucket(INTERVAL '{w}', ts) ORDER BY ts, event_id) <= {n} AS allowed FROM events"


@query(SQL_DECIDED.format(w="1 minute", n=2))
def rate_limit_minute(spark, sf):
    """Two requests a minute and client."""
    return L.decided(requests(spark, sf), "1 minute", 2).select("req_id", "allowed")


@query(SQL_DECIDED.format(w="1 hour", n=4))
def rate_limit_hour(spark, sf):
    return L.decided(requests(spark, sf), "1 hour", 4).select("req_id", "allowed")


@query("""SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, (user_id % 5)::BIGINT AS client, count(*)::BIGINT AS n, greatest(count(*) - 4, 0)::BIGINT AS rejected FROM events GROUP BY ALL""")
def rate_limit_counts(spark, sf):
    """The streaming form's transformation on a batch."""
    return L.counted(requests(spark, sf), "1 hour", 4).withColumn("start", F.unix_timestamp("start"))


SQL_PIXELS = f"""{SQL_ITEMS}, pixels AS (SELECT doc_id // 8 AS page_id, (doc_id % 8 * 200 + line_no)::INT AS y, word_no AS x, CASE WHEN length(text) % 3 = 0 THEN 20 + o % 60 ELSE 180 + o % 70 END AS r, CASE WHEN length(text) % 3 = 0 THEN 10 + word_no % 50 ELSE 190 + word_no % 60 END AS g, CASE WHEN length(text) % 3 = 0 THEN 30 ELSE 200 + line_no % 50 END AS b FROM layout_items),
hist AS (SELECT page_id, (77 * r + 150 * g + 29 * b) >> 8 AS bin, count(*) AS n FROM pixels GROUP BY ALL)"""


def pixels(spark, sf, page="floor(doc_id / 8)"):
    dark = F.length("text") % 3 == 0
    return items(spark, sf).select(
        F.expr(page).alias("page_id"), (F.col("doc_id") % 8 * 200 + F.col("line_no")).cast("int").alias("y"), F.col("word_no").alias("x"),
        F.when(dark, 20 + F.col("o") % 60).otherwise(180 + F.col("o") % 70).alias("r"), F.when(dark, 10 + F.col("word_no") % 50).otherwise(190 + F.col("word_no") % 60).alias("g"), F.when(dark, 30).otherwise(200 + F.col("line_no") % 50).alias("b"),
    )


@query(f"WITH {SQL_PIXELS} SELECT page_id, bin::INT AS bin, n::BIGINT AS n FROM hist")
def luminance_histogram(spark, sf):
    return R.histogram(pixels(spark, sf))


SQL_OTSU = f"""{SQL_PIXELS}, s AS (SELECT *, sum(n) OVER p AS total, sum(bin * n) OVER p AS sm, sum(bin * bin * n) OVER p AS sq, sum(n) OVER u AS wb, sum(bin * n) OVER u AS sb FROM hist WINDOW p AS (PARTITION BY page_id), u AS (PARTITION BY page_id ORDER BY bin)),
t AS (SELECT *, sb / wb AS mb, (sm - sb) / (total - wb) AS mf, wb * (total - wb) * (sb / wb - (sm - sb) / (total - wb)) ** 2 AS bt FROM s WHERE wb < total), o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY bt DESC, bin) = 1),
stats AS (SELECT page_id, bin::INT AS threshold, bt / (total * total) / (sq / total - (sm / total) ** 2) AS separability, wb / total AS dark_frac, mb AS fg_mean, mf AS bg_mean FROM o)"""


@query(f"WITH {SQL_OTSU} SELECT page_id, threshold, round(separability, 6)::DOUBLE AS separability, round(dark_frac, 6)::DOUBLE AS dark_frac, round(fg_mean, 4)::DOUBLE AS fg_mean, round(bg_mean, 4)::DOUBLE AS bg_mean, separability >= 0.55 AND dark_frac BETWEEN 0.003 AND 0.35 AND (bg_mean < 232 OR fg_mean > 70) AS binarize FROM stats")
def otsu_threshold(spark, sf):
    o = R.should_binarize(R.otsu(R.histogram(pixels(spark, sf))))
    return o.withColumns({"separability": F.round("separability", 6), "dark_frac": F.round("dark_frac", 6), "fg_mean": F.round("fg_mean", 4), "bg_mean": F.round("bg_mean", 4)})


@query(f"""WITH {SQL_PIXELS}, c AS (SELECT page_id, ((r & 240) << 16) + ((g & 240) << 8) + (b & 240) AS code, count(*) AS n FROM pixels GROUP BY ALL) SELECT page_id, code::INT AS code FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, code) = 1""")
def modal_colour(spark, sf):
    return R.modal_colour(pixels(spark, sf))


@query(f"""WITH {SQL_PIXELS}, d AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS k FROM pixels WHERE (77 * r + 150 * g + 29 * b) >> 8 < 128) SELECT page_id, y, min(x)::INT AS x0, max(x)::INT AS x1 FROM d GROUP BY page_id, y, k HAVING max(x) - min(x) + 1 >= 3""")
def dark_runs(spark, sf):
    return R.dark_runs(pixels(spark, sf), 3, 128, parts(spark, sf))


@query(f"""WITH {SQL_PIXELS} SELECT page_id, list_sort(list((77 * r + 150 * g + 29 * b) >> 8))[floor(count(*) * 0.72)::INT + 1]::INT AS background, greatest(300, least(660, count(*)))::BIGINT AS clamp FROM pixels GROUP BY 1""")
def background_percentile(spark, sf):
    p = R.background(R.histogram(pixels(spark, sf)), 0.72)
    return p.select("page_id", "background", F.greatest(F.lit(300), F.least(F.lit(660), "n")).cast("long").alias("clamp"))


@query(f"""WITH {SQL_PIXELS}, s AS (SELECT page_id, stddev_pop((77 * r + 150 * g + 29 * b) >> 8) AS sd, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM pixels GROUP BY 1) SELECT page_id, sd > 24 OR sqrt((r - 200) ** 2 + (g - 210) ** 2 + (b - 220) ** 2) > 26 AS dirty FROM s""")
def cover_strip_state(spark, sf):
    y = G.luma(F.col("r"), F.col("g"), F.col("b"))
    s = pixels(spark, sf).groupBy("page_id").agg(F.stddev_pop(y).alias("sd"), *[F.avg(c).alias(c) for c in "rgb"])
    far = F.sqrt(F.pow(F.col("r") - 200, 2) + F.pow(F.col("g") - 210, 2) + F.pow(F.col("b") - 220, 2))
    return s.select("page_id", ((F.col("sd") > 24) | (far > 26)).alias("dirty"))


FONTS = ["ABCDEF+Carlito-Bold", "Tinos", "CMR10", "XYZABC+CMBX12", "LMSans10-Regular", "Arial", "HelveticaBold", "Times New Roman Italic", "JetBrains Mono Medium", "NimbusRomNo9L-Medi", "TeXGyreHeros-BoldItalic", "Georgia", "Noto Sans Black", "Courier-Oblique", "lmmono10", "Unknown"]
SQL_FONTS = "f AS (SELECT DISTINCT [" + ", ".join(f"'{n}'" for n in FONTS) + f"][p_partkey % {len(FONTS)} + 1] || CASE WHEN p_size % 3 = 0 THEN '-' || p_size ELSE '' END AS name FROM part), b AS (SELECT name, lower(string_split(name, '+')[-1]) AS n, regexp_replace(lower(string_split(name, '+')[-1]), '[\\s-]', '', 'g') AS t FROM f)"


def _fonts(spark, sf):
    """The fonts of all parts: a name, for some with the part's size after it."""
    name = F.element_at(F.array(*map(F.lit, FONTS)), (F.col("p_partkey") % len(FONTS) + 1).cast("int"))
    return table(spark, sf, "part").select(F.when(F.col("p_size") % 3 == 0, F.concat(name, F.lit("-"), F.col("p_size").cast("string"))).otherwise(name).alias("name")).distinct()


def _any(parts, c="n"):
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"


@query(f"WITH {SQL_FONTS} SELECT name, CASE " + " ".join(f"WHEN contains(lower(name), '{p}') THEN '{k}'" for p, k in N.FAMILY_KEYS) + " ELSE '' END AS key FROM b")
def font_key_lookup(spark, sf):
    return _fonts(spark, sf).select("name", N.family_key(F.col("name")).alias("key"))


@query(f"WITH {SQL_FONTS}, s AS (SELECT *, {_any(N.MONO)} AS mono, {_any(N.SERIF)} OR NOT {_any(N.SANS)} AS serif FROM b) SELECT name, CASE WHEN mono THEN 'mono' WHEN serif THEN 'serif' ELSE 'sans' END AS family, regexp_matches(n, '{N.BOLD}') AS bold, regexp_matches(n, '{N.ITALIC}') AS italic FROM s")
def font_style(spark, sf):
    """Style from the name, with a serif flag in the descriptor."""
    return _fonts(spark, sf).select("name", N.style(F.col("name"), F.lit("serif")).alias("s")).select("name", "s.*")


@query(f"WITH {SQL_FONTS} SELECT name, CASE WHEN regexp_matches(n, '^(helvetica|arial)') THEN 'sans' WHEN regexp_matches(n, '^times|times new roman') THEN 'serif' WHEN starts_with(n, 'courier') THEN 'mono' END AS standard, regexp_matches(n, '{N.LATEX}') AS latex FROM b")
def font_standard(spark, sf):
    return _fonts(spark, sf).select("name", N.standard_family(F.col("name")).alias("standard"), N.strip_subset(F.col("name")).rlike(N.LATEX).alias("latex"))


@query(f"""WITH {SQL_FONTS}, s AS (SELECT *, CASE WHEN {_any(N.TEX_TIMES, 't')} THEN 'times' WHEN {_any(N.TEX_HELVETICA, 't')} THEN 'helvetica' WHEN {_any(N.TEX_COURIER, 't')} THEN 'courier' WHEN regexp_matches(n, '{N.LATEX}') OR regexp_matches(t, 'latinmodern|computermodern|^(lmroman|lmsans|lmmono)') THEN 'cm' END AS shape FROM b)
SELECT name, shape, CASE shape WHEN 'times' THEN 'serif' WHEN 'helvetica' THEN 'sans' WHEN 'courier' THEN 'mono' ELSE CASE WHEN regexp_matches(t, 'cmss|lmsans|lmss') THEN 'sans' WHEN regexp_matches(t, 'cmtt|cmitt|cmsltt|lmmono|lmtt') THEN 'mono' ELSE 'serif' END END AS family, {_any(N.TEX_BOLD, 't')} AS bold, {_any(N.TEX_ITALIC, 't')} AS italic FROM s WHERE shape IS NOT NULL""")
def latex_profile(spark, sf):
    return _fonts(spark, sf).select("name", N.latex_profile(F.col("name")).alias("p")).filter("p is not null").select("name", "p.*")




@query(r"""WITH c AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN format('#{:06x}', p_partkey * 7919 % 16777216) WHEN 1 THEN format('rgb({}, {},{})', p_partkey % 256, p_size, p_partkey * 31 % 256) WHEN 2 THEN format('rgba({},{}, {},0.5)', p_size, p_partkey % 256, p_partkey * 17 % 256) ELSE '#' || substr(p_name, 1, 6) END AS c FROM part), p AS (SELECT c, CASE WHEN regexp_matches(c, '(?i)^#[0-9a-f]{6}$') THEN [concat('0x', substr(c, 2, 2))::INT / 255, concat('0x', substr(c, 4, 2))::INT / 255, concat('0x', substr(c, 6, 2))::INT / 255]
WHEN regexp_matches(c, 'rgba?\(\d+,\s*\d+,\s*\d+') THEN [regexp_extract(c, '(\d+),\s*(\d+),\s*(\d+)', 1)::DOUBLE / 255, regexp_extract(c, '(\d+),\s*(\d+),\s*(\d+)', 2)::DOUBLE / 255, regexp_extract(c, '(\d+),\s*(\d+),\s*(\d+)', 3)::DOUBLE / 255] END AS v FROM c)
SELECT c, round(v[1], 6)::DOUBLE AS r, round(v[2], 6)::DOUBLE AS g, round(v[3], 6)::DOUBLE AS b FROM p""")
def colour_parse(spark, sf):
    """Colours in three notations, and names that are none, of all parts."""
    k, text = F.col("p_partkey"), lambda x: x.cast("string")
    notation = (
        F.when(k % 4 == 0, F.concat(F.lit("#"), F.lpad(F.lower(F.hex(k * 7919 % 16777216)), 6, "0")))
        .when(k % 4 == 1, F.concat(F.lit("rgb("), text(k % 256), F.lit(", "), text(F.col("p_size")), F.lit(","), text(k * 31 % 256), F.lit(")")))
        .when(k % 4 == 2, F.concat(F.lit("rgba("), text(F.col("p_size")), F.lit(","), text(k % 256), F.lit(", "), text(k * 17 % 256), F.lit(",0.5)")))
        .otherwise(F.concat(F.lit("#"), F.substring("p_name", 1, 6)))
    )
    v = table(spark, sf, "part").select(notation.alias("c")).distinct().withColumn("v", G.hex_to_rgb(F.col("c")))
    return v.select("c", *[F.round(F.col("v")[i], 6).alias(n) for i, n in enumerate("rgb")])


@query("""WITH c AS (SELECT p_partkey AS id, p_size / 50.0 AS u, p_partkey % 256 AS w, CASE p_partkey % 5 WHEN 0 THEN []::DOUBLE[] WHEN 1 THEN [p_size / 50.0] WHEN 2 THEN [p_size / 50.0, (p_partkey % 8) / 8.0, 0.25] WHEN 3 THEN [p_size / 50.0, (p_partkey % 8) / 8.0, 0.25, 0.5] ELSE [p_partkey % 256, p_size, 153.0]::DOUBLE[] END AS v FROM part),
n AS (SELECT id, CASE len(v) WHEN 0 THEN [0.0, 0.0, 0.0] WHEN 1 THEN [v[1], v[1], v[1]] WHEN 4 THEN [(1 - v[1]) * (1 - v[4]), (1 - v[2]) * (1 - v[4]), (1 - v[3]) * (1 - v[4])] ELSE v END AS w FROM c)
SELECT id, round(w[1] / CASE WHEN list_max(w) > 1.0001 THEN 255 ELSE 1 END, 6)::DOUBLE AS r, round(w[2] / CASE WHEN list_max(w) > 1.0001 THEN 255 ELSE 1 END, 6)::DOUBLE AS g, round(w[3] / CASE WHEN list_max(w) > 1.0001 THEN 255 ELSE 1 END, 6)::DOUBLE AS b FROM n""")
def colour_normalise(spark, sf):
    """Grey, three and four components, in either scale, of all parts' sizes."""
    k, u = F.col("p_partkey"), F.col("p_size") / 50.0
    eighths = k % 8 / 8.0
    value = F.when(k % 5 == 0, F.array().cast("array<double>")).when(k % 5 == 1, F.array(u)).when(k % 5 == 2, F.array(u, eighths, F.lit(0.25))).when(k % 5 == 3, F.array(u, eighths, F.lit(0.25), F.lit(0.5))).otherwise(F.array((k % 256).cast("double"), F.col("p_size").cast("double"), F.lit(153.0)))
    w = table(spark, sf, "part").select(k.alias("id"), value.alias("v")).withColumn("w", G.unit_colour(G.normal_colour(F.col("v"))))
    return w.select("id", *[F.round(F.col("w")[i], 6).alias(n) for i, n in enumerate("rgb")])


@query("SELECT p_partkey, CASE WHEN 0.299 * (p_partkey % 256) + 0.587 * (p_partkey * 7 % 256) + 0.114 * (p_partkey * 13 % 256) < 140 THEN '#ffffff' ELSE '#000000' END AS colour FROM part")
def contrast_colour(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", G.contrast_text(k % 256, k * 7 % 256, k * 13 % 256).alias("colour"))


@query("SELECT p_partkey, round(abs(p_size * cos(radians(p_partkey % 360))) + abs(20 * sin(radians(p_partkey % 360))), 6) AS w, round(abs(p_size * sin(radians(p_partkey % 360))) + abs(20 * cos(radians(p_partkey % 360))), 6) AS h FROM part")
def rotated_image_box(spark, sf):
    w, h = G.rotated_image_size(F.col("p_size"), F.lit(20), F.col("p_partkey") % 360)
    return table(spark, sf, "part").select("p_partkey", F.round(w, 6).alias("w"), F.round(h, 6).alias("h"))


@query("""WITH t AS (SELECT p_partkey, p_size % 5 + 1 AS rows, p_size % 3 + 1 AS cols FROM part) SELECT p_partkey, 'h' AS kind, i::INT AS i, round(100.0 / rows * i, 6)::DOUBLE AS at FROM t, unnest(range(rows + 1)) AS u(i) UNION ALL SELECT p_partkey, 'v', i::INT, round(200.0 / cols * i, 6)::DOUBLE FROM t, unnest(range(cols + 1)) AS u(i)""".replace(" AS at ", ' AS "at" '))
def grid_lines(spark, sf):
    """Rules of a table annotation: one more than its rows and columns."""
    t = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("rows"), (F.col("p_size") % 3 + 1).alias("cols"))
    rule = lambda kind, n, size: t.select("p_partkey", F.lit(kind).alias("kind"), n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("i")).select("p_partkey", "kind", "i", F.round(F.lit(size) / F.col("n") * F.col("i"), 6).alias("at"))
    return rule("h", F.col("rows"), 100.0).union(rule("v", F.col("cols"), 200.0))


@query("SELECT p_partkey, least(150, p_size * 20 - 40) AS w, round(greatest(0, (p_size * 20 - least(150, p_size * 20 - 40)) / 2.0), 4)::DOUBLE AS x FROM part")
def stamp_placement(spark, sf):
    page = F.col("p_size") * 20
    w = F.least(F.lit(150), page - 40)
    return table(spark, sf, "part").select("p_partkey", w.alias("w"), F.round(F.greatest(F.lit(0), (page - w) / 2), 4).alias("x"))


@query("SELECT p_partkey, (100 + greatest(1, least(95, floor(45000 / (p_size * p_size * 16.0) + 0.5))))::BIGINT AS z FROM part")
def overlap_z_order(spark, sf):
    a = F.col("p_size") * F.col("p_size") * 16.0
    return table(spark, sf, "part").select("p_partkey", (100 + F.greatest(F.lit(1), F.least(F.lit(95), G.js_round(45000 / a)))).alias("z"))


@query("""SELECT l_orderkey, l_linenumber, list_min([0.0, l_quantity * cos(0.5), -l_tax * 100 * sin(0.5), l_quantity * cos(0.5) - l_tax * 100 * sin(0.5)])::DECIMAL(18,4)::DOUBLE AS x0, list_max([0.0, l_quantity * cos(0.5), -l_tax * 100 * sin(0.5), l_quantity * cos(0.5) - l_tax * 100 * sin(0.5)])::DECIMAL(18,4)::DOUBLE AS x1 FROM lineitem""")
def rotated_text_extent(spark, sf):
    w, h = F.col("l_quantity"), F.col("l_tax") * 100
    xs = F.array(F.lit(0.0), w * F.cos(F.lit(0.5)), -h * F.sin(F.lit(0.5)), w * F.cos(F.lit(0.5)) - h * F.sin(F.lit(0.5)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.array_min(xs), 4).alias("x0"), F.round(F.array_max(xs), 4).alias("x1"))
