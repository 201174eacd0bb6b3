"""Page algebra, limits and archive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import pages as P
from vellum.plans.registry import query
from vellum.sources import lazy_pages as lazy
from vellum.sources.layout import SQL_LINES, lines, table

SPECS = [(1, "1-5, 8, 11-14", 12), (2, "5-3", 10), (3, "0, 20, x, 2, 2", 10), (4, "0-3", 10), (5, " 2 – 4 ,,1", 3), (6, "", 5), (7, "9-12, 1", 10)]
SQL_PAGES = f"{SQL_LINES}, doc_pages AS (SELECT DISTINCT doc_id, page_index FROM layout_lines)"


def doc_pages(spark, sf):
    return lines(spark, sf).select("doc_id", "page_index").distinct()


@query("""WITH kinds(k, spec, n) AS (VALUES (1,'1-5, 8, 11-14',12),(2,'5-3',10),(3,'0, 20, x, 2, 2',10),(4,'0-3',10),(5,' 2 – 4 ,,1',3),(6,'',5),(7,'9-12, 1',10)),
specs AS (SELECT p_partkey AS id, concat(spec, CASE WHEN p_partkey % 2 = 0 THEN ', ' || p_size || '-' || (p_partkey % 9 + 1) ELSE '' END) AS spec, n + p_size AS n FROM part JOIN kinds ON k = p_partkey % 7 + 1),
t AS (SELECT id, n, unnest(range(len(s))) AS k, trim(unnest(s)) AS tok FROM (SELECT id, n, string_split(spec, ',') AS s FROM specs)),
e AS (SELECT *, try_cast(regexp_extract(tok, '^(\\d+)\\s*(?:[-–—]\\s*(\\d+))?$', 1) AS BIGINT) AS a, try_cast(regexp_extract(tok, '^(\\d+)\\s*(?:[-–—]\\s*(\\d+))?$', 2) AS BIGINT) AS b0 FROM t WHERE tok <> ''),
f AS (SELECT *, least(a, coalesce(b0, a)) AS lo, greatest(a, coalesce(b0, a)) AS hi FROM e),
g AS (SELECT *, coalesce(hi >= 1 AND lo <= n, false) AS fits FROM f),
p AS (SELECT id, k, unnest(range(greatest(lo, 1), least(hi, n) + 1)) - 1 AS page FROM g WHERE fits),
q AS (SELECT id, page, min(k * 100000 + page - 0) AS o, min(k) AS k FROM p GROUP BY ALL)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY k, page)::INT AS pos, page::BIGINT AS page, NULL::VARCHAR AS bad FROM q
UNION ALL SELECT id, row_number() OVER (PARTITION BY id ORDER BY k)::INT, NULL, tok FROM g WHERE NOT fits""".replace("\\\\", "\\"))
def page_ranges(spark, sf):
    """Page ranges as typed, with each part's size in some, for documents of so many pages more."""
    kinds = spark.createDataFrame(SPECS, "k int, spec string, pages long")
    k = F.col("p_partkey")
    more = F.when(k % 2 == 0, F.concat(F.lit(", "), F.col("p_size").cast("string"), F.lit("-"), (k % 9 + 1).cast("string"))).otherwise("")
    rows = table(spark, sf, "part").withColumn("k", (k % 7 + 1).cast("int")).join(F.broadcast(kinds), "k")  # seven rows
    return P.parse_ranges(rows.select(k.alias("id"), F.concat("spec", more).alias("spec"), (F.col("pages") + F.col("p_size")).alias("n")))


@query(f"""WITH {SQL_PAGES}, s AS (SELECT doc_id AS id, page_index AS page FROM doc_pages WHERE (doc_id + page_index) % 3 <> 0), i AS (SELECT *, page - row_number() OVER (PARTITION BY id ORDER BY page) AS g FROM s),
r AS (SELECT id, min(page) AS lo, max(page) AS hi FROM i GROUP BY id, g) SELECT id, string_agg(CASE WHEN lo = hi THEN (lo + 1)::VARCHAR ELSE concat(lo + 1, '-', hi + 1) END, ', ' ORDER BY lo) AS ranges FROM r GROUP BY id""")
def range_compress(spark, sf):
    """Every third page left out, the rest as print ranges."""
    return P.compress_ranges(doc_pages(spark, sf).filter("(doc_id + page_index) % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("page_index").alias("page")))


@query(f"""WITH {SQL_PAGES}, n AS (SELECT doc_id, max(page_index) AS last FROM doc_pages GROUP BY 1)
SELECT doc_id, page_index, (row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page_index = 0 THEN last + 0.5 ELSE page_index END) - 1)::INT AS out_pos FROM doc_pages JOIN n USING (doc_id)""")
def page_reorder(spark, sf):
    """First page moved behind the last."""
    p = doc_pages(spark, sf)
    last = p.groupBy("doc_id").agg(F.max("page_index").alias("last"))
    return P.moved_before(p.join(last, "doc_id"), F.lit(0), F.col("last") + 1).select("doc_id", "page_index", "out_pos")


@query(f"""WITH {SQL_PAGES} SELECT doc_id % 50 AS group_id, doc_id, page_index, (row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id // 50 DESC, doc_id, page_index) - 1)::BIGINT AS out_pos FROM doc_pages""")
def merge_pages(spark, sf):
    """Documents of a group in descending order, one page sequence a group."""
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", (F.col("doc_id") % 50).alias("group_id"), (-F.floor(F.col("doc_id") / 50)).alias("doc_order"))
    return P.merged(d, doc_pages(spark, sf)).select("group_id", "doc_id", "page_index", "out_pos")


@query(f"""WITH {SQL_PAGES}, d AS (SELECT doc_id, octet_length(encode(text)) AS b FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, count(*) AS p FROM doc_pages GROUP BY 1)
SELECT doc_id % 50 AS group_id, count(*)::BIGINT AS files, sum(b)::BIGINT AS bytes, sum(p)::BIGINT AS pages, arg_min(doc_id, doc_id)::BIGINT AS metadata_of FROM d JOIN n USING (doc_id) GROUP BY 1""")
def merge_estimate(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.octet_length("text").alias("b"), F.floor((F.size(F.split("text", "\n")) + 19) / 20).alias("p"))
    return d.groupBy((F.col("doc_id") % 50).alias("group_id")).agg(F.count("*").alias("files"), F.sum("b").cast("long").alias("bytes"), F.sum("p").alias("pages"), F.min("doc_id").alias("metadata_of"))


@query(f"""WITH {SQL_PAGES}, w AS (SELECT doc_id, unnest([2, 0, 1, 7]) AS src, unnest([1, 2, 3, 4]) AS pos FROM (SELECT DISTINCT doc_id FROM doc_pages)) SELECT doc_id, src::INT AS page_index, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS out_pos FROM w JOIN doc_pages USING (doc_id) WHERE page_index = src""")
def extract_pages(spark, sf):
    """Wanted pages 3, 1, 2, 8 as far as there are such."""
    from pyspark.sql import Window

    p = doc_pages(spark, sf)
    want = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate((2, 0, 1, 7)) for x in (s, k)]), F.col("page_index"))
    return p.filter(F.col("page_index").isin(2, 0, 1, 7)).select("doc_id", "page_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy(want)) - 1).cast("int").alias("out_pos"))


@query(f"""WITH {SQL_PAGES}, n AS (SELECT doc_id, count(*) AS c FROM doc_pages GROUP BY 1) SELECT doc_id, page_index, concat('doc-', lpad((page_index + 1)::VARCHAR, length(c::VARCHAR)::INT, '0'), '.pdf') AS name FROM doc_pages JOIN n USING (doc_id)""")
def zip_names(spark, sf):
    from pyspark.sql import Window

    n = F.length(F.count("*").over(Window.partitionBy("doc_id")).cast("string"))
    return doc_pages(spark, sf).select("doc_id", "page_index", F.concat(F.lit("doc-"), F.lpad((F.col("page_index") + 1).cast("string"), n, F.lit("0")), F.lit(".pdf")).alias("name"))


@query("""WITH e AS (SELECT doc_id % 20 AS archive, doc_id AS pos, concat('doc-', doc_id, '.txt') AS name, octet_length(encode(coalesce(text, ''))) AS size FROM documents)
SELECT archive, pos, name, size::BIGINT AS size, coalesce(sum(30 + length(name) + size) OVER (PARTITION BY archive ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM e""")
def zip_offsets(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("archive"), F.col("doc_id").alias("pos"), F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("name"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return P.archive(d).select("archive", "pos", "name", "size", "offset")


@query(None)
def zip_crc(spark, sf):
    """Checksums of the stored entries (DuckDB has no crc32: tests compare with zlib)."""
    return table(spark, sf, "documents").select("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"))


@query(f"""WITH {SQL_PAGES} SELECT doc_id, page_index, ((CASE (doc_id % 4) WHEN 0 THEN 270 WHEN 1 THEN 0 WHEN 2 THEN 90 ELSE 180 END + 180) % 360)::INT AS rotation FROM doc_pages""")
def page_rotation(spark, sf):
    base = F.element_at(F.array(F.lit(270), F.lit(0), F.lit(90), F.lit(180)), (F.col("doc_id") % 4 + 1).cast("int"))
    return doc_pages(spark, sf).select("doc_id", "page_index", P.rotated(base, F.lit(180)).alias("rotation"))


SIZES = "(length(text) * 40000)::BIGINT AS bytes, (length(text) // 3)::INT AS n"


@query(f"""WITH d AS (SELECT doc_id, {SIZES} FROM documents WHERE text IS NOT NULL) SELECT doc_id, bytes <= 209715200 AND n <= 1500 AS editable, CASE WHEN bytes > 524288000 THEN 'too-large' WHEN bytes > 209715200 OR n > 1500 THEN 'view-only' WHEN n > 50 THEN 'lazy' ELSE 'normal' END AS route,
CASE WHEN bytes > 209715200 AND n > 1500 THEN 'both' WHEN bytes > 209715200 THEN 'size' WHEN n > 1500 THEN 'pages' END AS over FROM d""")
def document_routing(spark, sf):
    """Size and page gates of a desktop device."""
    mb = 1024 * 1024
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", (F.length("text").cast("long") * 40000).alias("bytes"), F.floor(F.length("text") / 3).alias("n"))
    big, many = F.col("bytes") > 200 * mb, F.col("n") > 1500
    route = F.when(F.col("bytes") > 500 * mb, "too-large").when(big | many, "view-only").when(F.col("n") > 50, "lazy").otherwise("normal")
    return d.select("doc_id", (~big & ~many).alias("editable"), route.alias("route"), F.when(big & many, "both").when(big, "size").when(many, "pages").alias("over"))


AGENTS = [
    (1, "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Mobile/15E148", True, None), (2, "Mozilla/5.0 (Linux; Android 14) Mobile Safari", True, 8.0), (3, "Mozilla/5.0 (Linux; Android 14; Tablet)", True, 4.0),
    (4, "Mozilla/5.0 (Macintosh; Intel Mac OS X)", True, None), (5, "Mozilla/5.0 (Windows NT 10.0)", False, 2.0), (6, "Mozilla/5.0 (Windows NT 10.0)", False, 16.0), (7, "BlackBerry9000 Opera Mini", True, None),
]


@query("""WITH agents(k, ua, touch, mem) AS (VALUES (1,'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Mobile/15E148',true,NULL),(2,'Mozilla/5.0 (Linux; Android 14) Mobile Safari',true,8.0),(3,'Mozilla/5.0 (Linux; Android 14; Tablet)',true,4.0),(4,'Mozilla/5.0 (Macintosh; Intel Mac OS X)',true,NULL),(5,'Mozilla/5.0 (Windows NT 10.0)',false,2.0),(6,'Mozilla/5.0 (Windows NT 10.0)',false,16.0),(7,'BlackBerry9000 Opera Mini',true,NULL)),
a AS (SELECT event_id AS id, ua, touch, mem FROM events JOIN agents ON k = event_id % 7 + 1),
k AS (SELECT *, touch AND (regexp_matches(ua, '(?i)Android|iPhone|iPad|iPod|Mobile|Silk|Kindle|BlackBerry|Opera Mini|IEMobile') OR regexp_matches(ua, '(?i)Macintosh')) AS mobile, touch AND (regexp_matches(ua, '(?i)iPhone|iPod|Windows Phone|BlackBerry|Opera Mini|IEMobile') OR (regexp_matches(ua, '(?i)Android') AND regexp_matches(ua, '(?i)Mobile'))) AS phone FROM a)
SELECT id, mobile, phone, CASE WHEN phone OR coalesce(mem <= 2, false) THEN 30 ELSE 200 END::INT AS edit_mb, CASE WHEN phone OR coalesce(mem <= 2, false) THEN 150 ELSE 500 END::INT AS cap_mb FROM k""")
def device_limits(spark, sf):
    agents = spark.createDataFrame(AGENTS, "k int, ua string, touch boolean, mem double")
    a = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 7 + 1).cast("int").alias("k")).join(F.broadcast(agents), "k")  # seven rows
    ua = F.col("ua")
    mobile = F.col("touch") & (ua.rlike("(?i)Android|iPhone|iPad|iPod|Mobile|Silk|Kindle|BlackBerry|Opera Mini|IEMobile") | ua.rlike("(?i)Macintosh"))
    phone = F.col("touch") & (ua.rlike("(?i)iPhone|iPod|Windows Phone|BlackBerry|Opera Mini|IEMobile") | (ua.rlike("(?i)Android") & ua.rlike("(?i)Mobile")))
    small = phone | F.coalesce(F.col("mem") <= 2, F.lit(False))
    return a.select("id", mobile.alias("mobile"), phone.alias("phone"), F.when(small, 30).otherwise(200).alias("edit_mb"), F.when(small, 150).otherwise(500).alias("cap_mb"))


@query("""SELECT page_id, CASE WHEN octet_length(encode(html)) > 8000 THEN 'too-large' WHEN position('%PDF-' IN substr(html, 1, 1024)) = 0 AND position('<!DOCTYPE' IN substr(html, 1, 1024)) = 0 THEN 'not-a-document' WHEN NOT regexp_matches(url, '(?i)^https?://') THEN 'bad-name' END AS error FROM pages""")
def intake_errors(spark, sf):
    """Files that are refused, by the first rule that applies; null: accepted."""
    p = table(spark, sf, "pages")
    head = F.substring("html", 1, 1024)
    magic = head.contains("%PDF-") | head.contains("<!DOCTYPE")
    return p.select("page_id", F.when(F.octet_length("html") > 8000, "too-large").when(~magic, "not-a-document").when(~F.col("url").rlike("(?i)^https?://"), "bad-name").alias("error"))


@query("""SELECT doc_id, coalesce(position('%PDF-' IN substr(CASE doc_id % 4 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN 'junk %PDF-' WHEN 2 THEN repeat('x', 1020) || '%PDF-' ELSE '' END || coalesce(text, ''), 1, 1024)) > 0, false) AS is_document FROM documents""")
def magic_check(spark, sf):
    """Whether each document's first bytes hold the mark; some have it first, some after others, some too late."""
    k = F.col("doc_id")
    raw = F.encode(F.concat(F.when(k % 4 == 0, "%PDF-1.7 ").when(k % 4 == 1, "junk %PDF-").when(k % 4 == 2, "x" * 1020 + "%PDF-").otherwise(""), F.coalesce("text", F.lit(""))), "UTF-8")
    return table(spark, sf, "documents").select("doc_id", F.contains(F.substring(raw, 1, 1024), F.encode(F.lit("%PDF-"), "UTF-8")).alias("is_document"))


@query(f"""WITH {SQL_LINES} SELECT doc_id, page_index, count(*)::INT AS n_lines, sum(length(text))::BIGINT AS n_chars FROM layout_lines GROUP BY ALL""")
def lazy_pages(spark, sf):
    """All pages as the lazy source reads them."""
    lazy.register(spark)
    pages = spark.read.format("document_pages").load(f"{sf}/documents.parquet")
    return pages.select("doc_id", "page_index", F.size("lines").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))
