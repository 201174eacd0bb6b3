"""Text export, cleaning and scalar text functions, with oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import folding
from vellum.operators import furniture as fu
from vellum.plans.registry import query
from vellum.sources.layout import PAGE_H, SQL_LINES, SQL_ROUGH_LINES, lines, lines_of, rough, table

WS = r"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
SQL_KEY = WS.format(c=r"regexp_replace(lower(text), '\d+', '#', 'g')")
SQL_PAGE = r"regexp_matches(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '(?i)^(?:page\s*)?(?:\d{1,4}|[ivxlcdm]{1,7})(?:\s*(?:of|/)\s*\d{1,4})?$')"
SQL_BAND = f"CASE WHEN (top + bottom) / 2 <= 0.12 * {PAGE_H} THEN 'top' WHEN (top + bottom) / 2 >= 0.88 * {PAGE_H} THEN 'bottom' END"
SQL_FURNITURE = f"""{SQL_LINES},
banded AS (SELECT *, {SQL_BAND} AS band, {SQL_KEY} AS key FROM layout_lines),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, band, key) AS n FROM banded),
marked AS (SELECT *, band IS NOT NULL AND ({SQL_PAGE} OR (n >= 3 AND trim(text) <> '')) AS furniture FROM counted)"""


@query(f"WITH {SQL_FURNITURE} SELECT doc_id, line_no, band, key AS repeat_key, n::BIGINT AS n FROM counted WHERE band IS NOT NULL")
def repeat_key_counts(spark, sf):
    return fu.counted(lines(spark, sf)).filter("band is not null").select("doc_id", "line_no", "band", F.col("key").alias("repeat_key"), "n")


@query(f"WITH {SQL_FURNITURE} SELECT doc_id, page_index, line_no, text FROM marked WHERE furniture")
def furniture_strip(spark, sf):
    return fu.marked(lines(spark, sf)).filter("furniture").select("doc_id", "page_index", "line_no", "text")


@query(f"""WITH {SQL_FURNITURE}, pages AS (SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY line_no) FILTER (WHERE NOT furniture) AS body, count_if(furniture) AS s FROM marked GROUP BY ALL)
SELECT doc_id, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY page_index), '') AS text, sum(s)::BIGINT AS stripped FROM pages GROUP BY doc_id""")
def text_export(spark, sf):
    return fu.export_text(fu.marked(lines(spark, sf)))


@query(f"WITH {SQL_FURNITURE} SELECT doc_id, count_if(furniture)::BIGINT AS stripped, count(*)::BIGINT AS n_lines FROM marked GROUP BY doc_id")
def strip_counts(spark, sf):
    return fu.marked(lines(spark, sf)).groupBy("doc_id").agg(F.count_if("furniture").alias("stripped"), F.count("*").alias("n_lines"))


SQL_RTF = r"""CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN list_aggregate(list_transform(string_split(regexp_replace(text, '([\\{}])', '\\\1', 'g'), ''),
 lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE concat('\u', CASE WHEN unicode(c) > 32767 THEN unicode(c) - 65536 ELSE unicode(c) END, '?') END), 'string_agg', '') ELSE regexp_replace(text, '([\\{}])', '\\\1', 'g') END"""


@query(f"""WITH {SQL_LINES}, e AS (SELECT doc_id, page_index, line_no, {SQL_RTF} AS r FROM layout_lines),
p AS (SELECT doc_id, page_index, string_agg(r, '\\par' || chr(10) ORDER BY line_no) AS body FROM e GROUP BY ALL)
SELECT doc_id, concat('{{\\rtf1\\ansi ', string_agg(body, '\\page' || chr(10) ORDER BY page_index), '}}') AS rtf FROM p GROUP BY doc_id""")
def rtf_export(spark, sf):
    return fu.export_rtf(lines(spark, sf))


SQL_TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query(rf"""WITH {SQL_LINES}, t AS (SELECT *, {SQL_TOKENS} AS tk, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM layout_lines)
SELECT doc_id, line_no, NOT (len(list_filter(tk, lambda w: length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 3)) > 0 OR regexp_matches(text, '\d{{3,}}') OR (len(tk) >= 4 AND letters >= len(tk))) AS noise FROM t""")
def noise_lines(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", T.is_noise_line(F.col("text")).alias("noise"))


@query(f"""WITH {SQL_LINES} SELECT doc_id, line_no, coalesce(array_to_string(list_filter({SQL_TOKENS}, lambda w: regexp_matches(w, '[A-Za-z0-9]')), ' '), '') AS cleaned FROM layout_lines""")
def noise_tokens(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", T.clean_noise_tokens(F.col("text")).alias("cleaned"))


@query(f"WITH {SQL_LINES} SELECT doc_id, line_no, {SQL_PAGE} AS is_page_number FROM layout_lines")
def page_number_lines(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", T.is_page_number(F.col("text")).alias("is_page_number"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}]', '', 'g'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g') AS cleaned FROM pages""")
def clean_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_editable(F.col("html")).alias("cleaned"))


@query(r"""SELECT page_id, regexp_replace(html, '[^\x09\x0A\x20-\x7E\x{00A0}-\x{00FF}\x{20AC}\x{201A}\x{0192}\x{201E}\x{2026}\x{2020}\x{2021}\x{02C6}\x{2030}\x{0160}\x{2039}\x{0152}\x{017D}\x{2018}\x{2019}\x{201C}\x{201D}\x{2022}\x{2013}\x{2014}\x{02DC}\x{2122}\x{0161}\x{203A}\x{0153}\x{017E}\x{0178}]', '?', 'g') AS safe FROM pages""")
def winansi_safe(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.winansi_safe(F.col("html")).alias("safe"))


@query(f"""WITH {SQL_LINES} SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(text, '[\\t\\n\\f\\r]+', ' ', 'g'), ' {{25,}}', repeat(' ', 24), 'g'), ' ') AS tidy FROM layout_lines""")
def tidy_lines(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", T.tidy_line(F.col("text")).alias("tidy"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query(r"""WITH u AS (SELECT page_id, url AS raw FROM pages UNION ALL SELECT page_id, regexp_replace(url, '^https?://', '') FROM pages UNION ALL SELECT page_id, concat('user', page_id, '@', split_part(split_part(url, '//', 2), '/', 1)) FROM pages)
SELECT page_id, raw, CASE WHEN trim(raw) = '' THEN '' WHEN regexp_matches(raw, '(?i)^[a-z][a-z0-9+.-]*:') THEN raw WHEN regexp_matches(raw, '^[^\s@/]+@[^\s@/]+\.[^\s@/]+$') THEN 'mailto:' || raw ELSE 'https://' || raw END AS url FROM u""")
def url_normalise(spark, sf):
    p = table(spark, sf, "pages")
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    raw = F.explode(F.array("url", F.regexp_replace("url", "^https?://", ""), F.concat(F.lit("user"), "page_id", F.lit("@"), host)))
    return p.select("page_id", raw.alias("raw")).select("page_id", "raw", T.url(F.col("raw")).alias("url"))


@query("SELECT item_id, concat('FEFF', upper(string_agg(printf('%04X', unicode(c)), '' ORDER BY i))) AS hex FROM (SELECT item_id, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS c FROM benchmark) GROUP BY item_id")
def utf16_actual_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.utf16_hex(F.col("text")).alias("hex"))


@query("SELECT item_id, length(text)::INT AS n, (CASE WHEN length(text) % 12 >= 8 THEN 2 WHEN length(text) % 12 >= 4 THEN 1 ELSE 0 END)::INT AS budget FROM benchmark")
def edit_budget(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.length("text").alias("n"), T.edit_budget(F.length("text") % 12).alias("budget"))


# One row a folded letter: k tells the letters of one character apart; white space has no letter of its own.
SQL_LETTERS = r"""split AS (SELECT doc_id, page_index, line_no, regexp_extract_all(text, '(?s).') AS cs FROM layout_lines),
signs AS (SELECT doc_id, page_index, line_no, unnest(range(len(cs))) AS i, unnest(cs) AS c FROM split),
folds AS (SELECT doc_id, page_index, line_no, i, CASE WHEN c = 'ﬃ' THEN 'ffi' WHEN c = 'ﬁ' THEN 'fi' WHEN c = 'ﬂ' THEN 'fl' WHEN c = 'ﬀ' THEN 'ff' WHEN c = chr(173) THEN '' WHEN c IN (chr(160), chr(8195)) THEN ' ' ELSE lower(translate(c, '①②‘’‚“”„–—−', '12' || repeat(chr(39), 3) || repeat('"', 3) || '---')) END AS f FROM signs),
letters AS (SELECT doc_id, page_index, line_no, i, u.k AS k, substr(f, u.k, 1) AS ch FROM folds, unnest(range(1, length(f) + 1)) AS u(k)),
ranked AS (SELECT *, count(*) FILTER (WHERE NOT regexp_matches(ch, '\s')) OVER (PARTITION BY doc_id, line_no ORDER BY i, k) AS solid FROM letters),
gaps AS (SELECT doc_id, line_no, solid, min(i) AS i FROM ranked WHERE regexp_matches(ch, '\s') AND solid > 0 GROUP BY ALL),
spaced AS (SELECT r.doc_id, r.page_index, r.line_no, r.i, r.k, CASE WHEN g.i IS NULL THEN ch ELSE ' ' || ch END AS ch, CASE WHEN g.i IS NULL THEN [r.i] ELSE [g.i, r.i] END AS places FROM ranked r LEFT JOIN gaps g ON g.doc_id = r.doc_id AND g.line_no = r.line_no AND g.solid = r.solid - 1 WHERE NOT regexp_matches(ch, '\s')),
normed AS (SELECT doc_id, page_index, line_no, string_agg(ch, '' ORDER BY i, k) AS norm, flatten(list(places ORDER BY i, k)) AS places FROM spaced GROUP BY ALL)"""


@query(f"""WITH {SQL_ROUGH_LINES}, {SQL_LETTERS} SELECT l.doc_id, l.line_no, coalesce(norm, '') AS norm, coalesce(list_sum(list_transform(range(1, len(places) + 1), lambda j: j * places[j])), 0)::BIGINT AS places FROM layout_lines l LEFT JOIN normed n ON n.doc_id = l.doc_id AND n.line_no = l.line_no""")
def search_normalise(spark, sf):
    """Folded lines; their places in the original as a weighted sum."""
    f = folding.folded(lines_of(rough(table(spark, sf, "documents"))).select("doc_id", "line_no", "text"))
    # a shift at position p (from 0) moves all later ones: sum over j > p of j, times what it changes
    n = F.length("norm").cast("long")
    every = n * (n + 1) * (n - 1) / 3
    before = lambda i: F.coalesce(F.get(F.col("shifts"), i - 1)["by"], F.lit(0))
    moved = F.transform("shifts", lambda s, i: (s["by"] - before(i)) * (n * (n + 1) / 2 - s["at"].cast("long") * (s["at"] + 1) / 2))
    return f.select("doc_id", "line_no", "norm", (every + F.aggregate(moved, F.lit(0.0), lambda a, x: a + x)).cast("long").alias("places"))


SAMPLES = [(1, "Invoice"), (2, "Invoice हिन्दी"), (3, "שלום"), (4, "परीक्षाQA"), (5, "Привет αβ"), (6, "漢字かな"), (7, "مرحبا abc"), (8, ""), (9, "αβ Прив"), (10, "ไทย 123")]


def _samples(spark, sf):
    """One text a part: a sample, sometimes with the part's name after it."""
    text = F.element_at(F.array(*(F.lit(t) for _, t in SAMPLES)), (F.col("p_partkey") % len(SAMPLES) + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.concat(text, F.lit(" "), F.substring("p_name", 1, 6))).otherwise(text).alias("text"))


SQL_SAMPLES = "samples AS (SELECT p_partkey AS id, [" + ", ".join(f"'{t}'" for _, t in SAMPLES) + f"][p_partkey % {len(SAMPLES)} + 1] || CASE WHEN p_size % 2 = 0 THEN ' ' || substr(p_name, 1, 6) ELSE '' END AS text FROM part)"


def _sql_counts(which: str) -> str:
    cases = " UNION ALL ".join("SELECT id, {} AS prio, '{}' AS script, len(regexp_extract_all(text, '[{}]')) AS n FROM {}".format(i, k, re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", p), which) for i, (k, p) in enumerate(T.SCRIPTS))
    return f"counts AS (SELECT * FROM ({cases}) WHERE n > 0)"


@query(f"""WITH {SQL_SAMPLES}, {_sql_counts('samples')}, best AS (SELECT id, script FROM counts QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, prio) = 1)
SELECT samples.id, coalesce(script, 'latin') AS script, CASE WHEN script IN ('arabic', 'hebrew') THEN 'rtl' ELSE 'ltr' END AS direction FROM samples LEFT JOIN best USING (id)""")
def script_detect(spark, sf):
    return _samples(spark, sf).select("id", T.script_of(F.col("text")).alias("script"), T.direction_of(F.col("text")).alias("direction"))


@query(f"""WITH d AS (SELECT doc_id AS id, text FROM documents), {_sql_counts('d')}, best AS (SELECT id, script FROM counts QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, prio) = 1)
SELECT coalesce(script, 'latin') AS script, count(*)::BIGINT AS n FROM d LEFT JOIN best USING (id) GROUP BY 1""")
def script_of_documents(spark, sf):
    return table(spark, sf, "documents").select(T.script_of(F.col("text")).alias("script")).groupBy("script").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_SAMPLES}, {_sql_counts('samples')} SELECT id, array_to_string(list(script ORDER BY prio), ',') AS scripts FROM counts GROUP BY id")
def scripts_in_text(spark, sf):
    found = F.transform(T.script_counts(F.col("text")), lambda r: r["script"])
    return _samples(spark, sf).select("id", F.array_join(found, ",").alias("scripts")).filter("scripts <> ''")


@query("SELECT p_partkey, lower(p_type || '-' || p_name) AS base FROM part")
def strip_subset_prefix(spark, sf):
    """Names with a subset's tag before them, every third with two."""
    tag = F.concat(F.substring(F.upper(F.md5(F.col("p_partkey").cast("string"))), 1, 6), F.lit("+"))
    name = F.concat("p_type", F.lit("-"), "p_name")
    named = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("AB+"), tag, name)).when(F.col("p_partkey") % 3 == 1, F.concat(tag, name)).otherwise(name)
    return table(spark, sf, "part").select("p_partkey", T.strip_subset(named).alias("base"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) < 1024 THEN concat(octet_length(encode(text)), ' B') WHEN octet_length(encode(text)) < 1048576 THEN concat(floor(octet_length(encode(text)) / 1024 + 0.5)::BIGINT, ' KB') ELSE printf('%.1f MB', octet_length(encode(text)) / 1048576) END AS size FROM documents""")
def human_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.human_size(F.octet_length("text")).alias("size"))


SQL_ORDINAL = r"'^(.*?\d)(st|nd|rd|th)(.*)$'"


@query(f"""WITH v AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'Jan ' || p_size || ['st', 'nd', 'rd', 'th'][p_size % 4 + 1] || ' of ' || p_name END AS t FROM part) SELECT id, regexp_extract(t, {SQL_ORDINAL}, 1) AS head, regexp_extract(t, {SQL_ORDINAL}, 2) AS ordinal, regexp_extract(t, {SQL_ORDINAL}, 3) AS tail FROM v""")
def ordinal_split(spark, sf):
    """Head, ordinal and tail of dates with the parts' sizes and names."""
    ending = F.element_at(F.array(*map(F.lit, ("st", "nd", "rd", "th"))), (F.col("p_size") % 4 + 1).cast("int"))
    t = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit("Jan "), F.col("p_size").cast("string"), ending, F.lit(" of "), "p_name"))
    part = lambda i, n: F.regexp_extract("t", r"^(.*?\d)(st|nd|rd|th)(.*)$", i).alias(n)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), t.alias("t")).select("id", part(1, "head"), part(2, "ordinal"), part(3, "tail"))


@query(r"""SELECT p_partkey AS id, format('<{:02x}> <{}> <{}>', p_size, CASE p_partkey % 3 WHEN 0 THEN '0020' WHEN 1 THEN '002d' ELSE '0041' END, CASE p_partkey % 2 WHEN 0 THEN '0020' ELSE '00a1' END) AS cmap FROM part""")
def tounicode_repair(spark, sf):
    """Character maps of each part's size: no-break spaces and soft hyphens become plain ones, in either case of the digits."""
    k = F.col("p_partkey")
    t = F.concat(F.lit("<"), F.lpad(F.lower(F.hex("p_size")), 2, "0"), F.lit("> <"), F.when(k % 3 == 0, "00A0").when(k % 3 == 1, "00Ad").otherwise("0041"), F.lit("> <"), F.when(k % 2 == 0, "00a0").otherwise("00a1"), F.lit(">"))
    return table(spark, sf, "part").select(k.alias("id"), F.regexp_replace(F.regexp_replace(t, "(?i)<00a0>", "<0020>"), "(?i)<00ad>", "<002d>").alias("cmap"))


@query(f"""WITH {SQL_LINES}, c AS (SELECT doc_id, line_no, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS ch FROM layout_lines WHERE length(text) > 0)
SELECT doc_id, count(DISTINCT ch)::BIGINT AS n, md5(string_agg(DISTINCT ch, '' ORDER BY ch)) AS charset FROM c GROUP BY doc_id""")
def drawn_charset(spark, sf):
    """Characters that each document draws; distinct within a line first, so the shuffle carries few."""
    ch = lines(spark, sf).select("doc_id", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).filter("ch <> ''").distinct()
    joined = F.array_join(F.array_sort(F.collect_list("ch")), "")
    return ch.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(joined).alias("charset"))


@query(f"""WITH {SQL_LINES}, p AS (SELECT doc_id, page_index, count(*) FILTER (WHERE trim(text) <> '') AS n, sum(length(regexp_replace(text, '\\s', '', 'g'))) AS tot, sum(len(regexp_extract_all(text, '[À-ɏ]'))) AS acc, sum(len(regexp_extract_all(text, '[a-zà-ÿ][A-ZÀ-Þ]'))) AS up FROM layout_lines GROUP BY ALL)
SELECT doc_id, page_index, n::BIGINT AS n, acc::BIGINT AS accented, up::BIGINT AS upper_inside, n >= 8 AND tot > 0 AND acc / tot > 0.015 AND up / tot > 0.02 AS legacy FROM p""")
def legacy_page_test(spark, sf):
    """Pages whose text looks like glyph codes of an old font."""
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    p = lines(spark, sf).groupBy("doc_id", "page_index").agg(
        F.count_if(F.trim("text") != "").alias("n"), F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("tot"), n("[À-ɏ]").alias("accented"), n("[a-zà-ÿ][A-ZÀ-Þ]").alias("upper_inside")
    )
    share = lambda c: F.col(c) / F.nullif("tot", F.lit(0))
    return p.select("doc_id", "page_index", "n", "accented", "upper_inside", F.coalesce((F.col("n") >= 8) & (share("accented") > 0.015) & (share("upper_inside") > 0.02), F.lit(False)).alias("legacy"))
