"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from vellum.llm import fill_middle, line_dedup, secret_scan, vector_codes

NEAR_DEDUP = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, g.b FROM r JOIN both_ways g ON g.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id"""

EMBED_DEDUP = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, coalesce(embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95),
r(id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id"""


def _found(name: str, pattern: str, group: int = 0) -> str:
    """Common table expressions: all matches of ``pattern`` with code point positions as ``name``."""
    p = pattern.replace("'", "''")
    return f"""{name}_p AS (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS words FROM d WHERE regexp_matches(t, '{p}')),
{name} AS (SELECT doc_id, words[i] AS word, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, length(hits[i]) AS n FROM {name}_p, unnest(range(1, len(hits) + 1)) AS u(i))"""


def _secrets() -> str:
    w = secret_scan.WINDOW
    parts = [_found("assign", secret_scan.ASSIGN, 2), _found("access", secret_scan.ACCESS), _found("hex", secret_scan.HEX)]
    spans = [
        f"SELECT doc_id, start, 0 AS rank, start + n AS stop, 'assign' AS kind FROM assign WHERE length(word) >= {secret_scan.ASSIGN_VALUE}",
        "SELECT doc_id, start, 1, start + n, 'access' FROM access",
        "SELECT doc_id, start, 2, start + n, 'hex' FROM hex",
    ]
    allow, checksum = secret_scan.ALLOW, secret_scan.CHECKSUM
    for k, (kind, chars, needs, bits) in enumerate(secret_scan.CLASSES, 3):
        parts.append(_found(kind, f"{chars}{{{w},}}"))
        holds = " AND ".join(f"regexp_matches(part, '{x}')" for x in needs)
        parts.append(
            f"""{kind}_s AS (SELECT doc_id, start AS run, string_split_regex(word, '{allow}') AS ps, regexp_extract_all(word, '{allow}', 0) AS hs FROM {kind} WHERE NOT regexp_matches(word, '{checksum}')),
{kind}_t AS (SELECT doc_id, ps[i] AS part, (run + list_sum(list_transform(ps[1:i], lambda x: length(x))) - length(ps[i]) + coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM {kind}_s, unnest(range(1, len(ps) + 1)) AS u(i)),
{kind}_w AS (SELECT doc_id, start, j, string_split(substr(part, j + 1, {w}), '') AS cs FROM {kind}_t, unnest(range(length(part) - {w - 1})) AS u(j) WHERE {holds}),
{kind}_h AS (SELECT doc_id, start, min(j) AS lo, max(j) AS hi FROM {kind}_w WHERE log2({w}) - list_sum(list_transform(list_distinct(cs), lambda c: len(list_filter(cs, lambda x: x = c)) * log2(len(list_filter(cs, lambda x: x = c))))) / {w} >= {bits} GROUP BY doc_id, start)"""
        )
        spans.append(f"SELECT doc_id, start + lo, {k}, start + hi + {w}, '{kind}' FROM {kind}_h")
    shown = "concat(kind, ':', start, ':', stop)"
    order = "',' ORDER BY start, rank, stop"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(parts)}, spans AS ({' UNION ALL '.join(spans)}),
g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS b, count(*) FILTER (WHERE rank = 2) AS c, string_agg({shown}, {order}) FILTER (WHERE rank < 3) AS base, string_agg({shown}, {order}) AS spans FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


_TOKENS = r"regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"
_DRAWN = "('0x' || substr(h, {at}, 8))::BIGINT"

FILL_MIDDLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fill_middle.SEED}:' || doc_id) AS h FROM documents),
k AS (SELECT doc_id, t, {_TOKENS} AS u, {_DRAWN.format(at=1)} AS h1, {_DRAWN.format(at=9)} AS h2, {_DRAWN.format(at=17)} AS h3, {_DRAWN.format(at=25)} AS h4 FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fill_middle.RATE} THEN 'plain' WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

LINE_DEDUP = rf"""WITH l AS (SELECT doc_id, u.i AS i, string_split(coalesce(text, ''), chr(10))[u.i] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= {line_dedup.LEAST} GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
g AS (SELECT k.doc_id, i, line, coalesce(owner <> k.doc_id, false) AS gone FROM k LEFT JOIN o ON o.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id"""

def _vector_codes() -> str:
    v = vector_codes
    size = f"(SELECT max(len(e)) // {v.PARTS} FROM v)"
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, p.i AS part, e[p.i * {size} + 1:(p.i + 1) * {size}] AS w FROM v, unnest(range({v.PARTS})) AS p(i))",
        f"b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, w FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM v) USING (vec_id) WHERE n <= {v.ENTRIES})",
    ]
    apart = "list_sum(list_transform(range(1, len(x.w) + 1), lambda k: (x.w[k] - b.w[k]) * (x.w[k] - b.w[k])))::BIGINT"
    for r in range(v.ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x.part AS part, min({apart} * 256 + entry) AS best FROM x JOIN b{r} b ON b.part = x.part GROUP BY 1, 2)")
        if r < v.ROUNDS:
            steps.append(
                f"""m{r} AS (SELECT part, entry, list(mean ORDER BY k) AS w FROM (SELECT a.part AS part, a.best % 256 AS entry, k.i AS k, floor(sum(x.w[k.i]) / count(*))::BIGINT AS mean FROM a{r} a JOIN x USING (vec_id, part), unnest(range(1, len(x.w) + 1)) AS k(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r + 1} AS MATERIALIZED (SELECT b.part AS part, b.entry AS entry, coalesce(m.w, b.w) AS w FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)"""
            )
    last = v.ROUNDS
    return f"""WITH {', '.join(steps)},
c AS (SELECT vec_id, string_agg(format('{{:02x}}', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a{last} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, entry)) FROM b{last}) AS codebooks_sha256 FROM v JOIN c USING (vec_id)"""


ORACLES = {"op12_vector_codes": _vector_codes(), "op13_line_dedup": LINE_DEDUP, "op11_fill_middle": FILL_MIDDLE, "op3_near_dedup": NEAR_DEDUP, "op9_embed_dedup": EMBED_DEDUP, "op10_secret_scan": _secrets()}
