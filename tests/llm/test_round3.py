"""HTML extraction, fill-in-middle, vector codes and line dedup against plain versions and awkward inputs."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import fill_middle, html_extract, licenses, line_dedup, secret_scan, vector_codes
from vellum.llm.scratch import table

ODD = [
    None, "", " ", "\n\n", "a", "a b c", "  a b  c\n\n d\te ", "É.à, ×.", "x\n.y \x0b\x0c\r", "日本 語。", "a<P>b c", "a <S", "<M", "< P>", "\x1c a\x85 b\xa0c", "word " * 3000, "x" * 50000, " " * 5000, "x y " * 20000, "a😀 b",
]
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """Documents with columns whose names clash with results and helpers."""
    return spark.createDataFrame([(i, t, "k", 1, "w") for i, t in rows], "doc_id long, text string, form string, N_dropped int, _whole string")


# --- 11 --------------------------------------------------------------------


def plain_fim(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_equals_plain(spark):
    rows = [(k * 100 + i, t) for k in range(6) for i, t in enumerate(ODD)] + [(None, "a b c"), (None, None), (7, "twice"), (7, "twice"), (-3, "of minus three")]
    docs = docs_of(spark, rows)
    out = fill_middle.rearrange(docs)
    assert out.columns == ["doc_id", "text", "N_dropped", "_whole", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(((r["doc_id"], r["text"]), (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in out.fillna("", "text").fillna(-99, "doc_id").collect())
    want = sorted(((-99 if i is None else i, t or ""), plain_fim(i, t)) for i, t in rows)
    assert got == want
    back = out.select("text", fill_middle.restore(F.col("output"), F.col("form")).alias("again")).collect()
    assert all((r["text"] or "") == r["again"] for r in back)
    assert {"psm", "spm", "plain"} == {w[1][1] for w in want}
    assert fill_middle.digest(fill_middle.rearrange(docs.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \t\n\x0b\r\x1c\x85é日😀"), max_size=12), max_size=6), st.data())
def test_cuts_of_runs(texts, data):
    raw = [t.encode() for t in texts]
    whole = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    for unit, cut in (("token", TOKEN.findall), ("char", list)):
        runs = fill_middle.encode(whole, offsets, unit)
        assert np.diff(runs.before()).tolist() == [len(cut(t)) for t in texts]
        for d, t in enumerate(texts):
            units = cut(t)
            k = data.draw(st.integers(0, len(units)))
            at = runs.cut(np.array([d]), np.array([k]), offsets[:-1])[0]
            assert at - offsets[d] == len("".join(units[:k]).encode())


def test_stored_runs(spark):
    rows = {r["doc_id"]: r for r in fill_middle.class_runs(docs_of(spark, [(1, " ab  c "), (2, None), (3, "é")])).collect()}
    assert (rows[1]["lengths"], rows[1]["kinds"], rows[1]["units"]) == ([1, 2, 2, 1, 1], [1, 0, 1, 0, 1], [0, 1, 1, 2, 3])
    assert rows[2]["lengths"] == [] and rows[3]["lengths"] == [2]
    char = fill_middle.class_runs(docs_of(spark, [(1, "aé日b")]), unit="char").first()
    assert (char["lengths"], char["kinds"], char["units"]) == ([1, 2, 3, 1], [1, 2, 3, 1], [1, 2, 3, 4])


# --- 12 --------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wide = parts * max(1, -(-max((len(v) for _, _, v in kept), default=0) // parts))
    size = wide // parts
    first = [v for _, _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]]
    pad = lambda v: v + [0] * (wide - len(v))
    books = [[pad(v)[p * size : (p + 1) * size] for v in first] for p in range(parts)]

    def nearest(p, w):
        return min((sum((a - b) ** 2 for a, b in zip(w, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, _, v in kept:
            for p in range(parts):
                w = pad(v)[p * size : (p + 1) * size]
                held[p, nearest(p, w)[1]].append(w)
        for (p, k), ws in held.items():
            books[p][k] = [sum(c) // len(ws) for c in zip(*ws, strict=True)]
    out, by = [], defaultdict(int)
    for i, lab, v in kept:
        found = [nearest(p, pad(v)[p * size : (p + 1) * size]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by[lab] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, by[lab], digest) for i, c, e, lab in out)


KIND = "vec_id long, embedding array<float>, label int, error string, of int"


@pytest.mark.parametrize("case", ["grid", "few", "odd"])
def test_vector_codes_equal_plain(spark, case):
    rng = np.random.default_rng(5)
    if case == "grid":  # many ties
        rows = [(i, [float(x) for x in rng.integers(-2, 3, 32) / 4], int(i % 3) if i % 4 else None) for i in range(300)]
    elif case == "few":
        rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)], None) for i in range(9)]
    else:
        rows = [(i, [float(np.float32(x)) for x in rng.normal(size=20 - i % 3)], 1) for i in range(90)]
        rows += [(100, None, 1), (101, [1.0, None], 1), (102, [float("nan")] * 20, 1), (103, [float("inf")] * 20, 1), (104, [], 2), (105, [0.0] * 20, 2), (3, [0.5] * 20, 1), (None, [0.25] * 20, None), (7, rows[7][1], 1), (106, [-1048575.5] * 20, 9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND).repartition(3)
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.codes(df).collect())
    assert got == plain_codes(rows)


def test_vector_codes_of_nothing_and_too_large(spark):
    assert vector_codes.codes(spark.createDataFrame([], KIND)).count() == 0
    with pytest.raises(Exception, match="magnitude"):
        vector_codes.codes(spark.createDataFrame([(1, [3e30] * 16, 1, "x", 1)], KIND)).count()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 5), st.integers(1, 40), st.integers(0, 1000))
def test_tree_search_is_exact(n, size, spread, seed):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-spread, spread + 1, (n, size)), rng.integers(-spread, spread + 1, (60, size))
    index, best, _ = vector_codes.search(vector_codes.tree(book), book, x)
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_tree_search_leaves_entries_out(spark):
    rng = np.random.default_rng(1)
    book, x = rng.integers(-1000, 1000, (256, 2)), rng.integers(-1000, 1000, (500, 2))
    assert vector_codes.search(vector_codes.tree(book), book, x)[2] < 0.4 * len(x) * len(book)


# --- 13 --------------------------------------------------------------------


def plain_lines(rows):
    """(id, text, lines, dropped) of each row."""
    white = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(white).translate(lower)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add((i is None, i or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(held[key(x)]) == (i is None, i or 0)]
        out.append((str(i), None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LINES = ["a common line of text", "A Common LINE of text\t", "  a common line of text\r", "short", "exactly 10", "日本語日本語日本語日", "日本語日本語日本語", "É common lines", "é common lines", "", " ", "\x1cnot white space here", "not white space here", "only once %d"]


@pytest.mark.parametrize("shipped", [line_dedup.SHIPPED, -1])
def test_line_dedup_equals_plain(spark, shipped):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 60)) - 5 if k % 9 else None, "\n".join((LINES[j] % k if "%" in LINES[j] else LINES[j]) for j in rng.integers(0, len(LINES), rng.integers(0, 9)))) for k in range(150)]
    rows += [(-9, None), (None, None), (200, "a common line of text"), (200, "a common line of text"), (201, "\n".join(f"line number {i} of a long text" for i in range(3000))), (202, "\n".join(f"LINE number {i} of a long text" for i in range(0, 6000, 2)))]
    docs = docs_of(spark, rows).repartition(5)
    index = line_dedup.build(docs, per_shard=100)
    out = line_dedup.drop_repeated(docs, index, shipped=shipped, probes=50)
    assert out.columns == ["doc_id", "text", "form", "_whole", "n_lines", "n_dropped"]
    assert sorted(((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=str) == plain_lines(rows)


@pytest.mark.parametrize("shipped", [line_dedup.SHIPPED, -1])
def test_line_dedup_of_little(spark, shipped):
    for rows in ([], [(1, None)], [(1, ""), (2, "")], [(1, "no line here is repeated"), (2, "at all, in any document")]):
        docs = docs_of(spark, rows)
        assert sorted(((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_repeated(docs, shipped=shipped).collect()), key=str) == plain_lines(rows)


def test_both_ways_agree_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    index = line_dedup.build(docs, per_shard=64)
    a, b = (line_dedup.digest(line_dedup.drop_repeated(docs, index, shipped=s)).collect() for s in (1 << 30, -1))
    assert sorted(map(str, a)) == sorted(map(str, b)) and sum(r["n_dropped"] for r in a) > 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40000])
def test_shards_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-(1 << 62), 1 << 62, (2, n + 500))
    a[: n // 2] = 5  # equal first halves
    s = line_dedup.Shard.load(line_dedup.Shard.build(a[:n], b[:n], np.arange(n), np.full(n, 3, np.uint16)).dump())
    at = s.probe(a, b)
    assert sorted(at[:n].tolist()) == list(range(n)) and (at[n:] == -1).all()
    assert (s.owners[at[:n]] == np.arange(n)).all()
    assert n < 1000 or 8 * s.bits.nbytes / n < 4.5


# --- 4 ---------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>Text before <span class="ad">Buy now</span> after.</p></article>', "Text before after."),
        ('<article><p>One.</p><button>Subscribe</button><p>Two <label>Mail</label> three.</p></article>', "One.\n\nTwo three."),
        ('<article><p>One <a class="share-button" href="/s">Share</a>and <span style="display:none">SECRET</span>two.</p></article>', "One and two."),
        ("<article><p title=don't>First</p><p>Middle</p><p>Second with it's apostrophe</p><p>Third</p></article>", "First\n\nMiddle\n\nSecond with it's apostrophe\n\nThird"),
        ("<article><p title=don't>First</p><p>Third</p></article>", "First\n\nThird"),
        ('<article><p class="notice-of-copyright">Of copyright.</p><div class="search-results"><p>The body.</p></div></article>', "Of copyright.\n\nThe body."),
        ('<article><p title="the class hidden" data-class="ad">Kept</p><p>Text <i class="ad">ad <p>Next</article>', "Kept\n\nText\n\nNext"),
        ('<article><p a="1"b=\'>\'hidden>x</p><p a = ">" >y</p><p =">z</p></article>', "y\n\nz"),
        ('<article><p>One <span class="ad">Buy <span>it</span> <div>now</div></span> two.</p><p>Three</p></article>', "One two.\n\nThree"),
        ("<article><p>One.</p><div><a href=a>Home</a></div><div><a href=b>News</a></div><div><a href=c>Mail</a></div></article>", "One."),
        ("<article><div><a href=a>Home</a></div><p>One.</p><div><a href=c>The source of it</a></div></article>", "Home\n\nOne.\n\nThe source of it"),
        ('<article><div class="site-share-bar">Share</div><div class="share">it</div><div class="x notice y">Cookies</div><div class="post-comments-list">Nice.</div><p>One.</p></article>', "One."),
    ],
)
def test_inline_furniture_and_attributes(page, want):
    assert html_extract.main_text(page) == want


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_random_articles(data):
    """Pages are written from a tree whose text is gathered beside the writing."""
    words = iter(f"w{i}" for i in range(10_000))
    aside = ['<span class="ad">{}</span>', "<button>{}</button>", '<a class="share" href="/s">{}</a>', "<em style='display: none'>{}</em>", "<label for=a'b>{}</label>", "<!-- {} -->", "<script>{}</script>", '<i hidden title="a > b">{}</i>']
    blocks = ['<aside>{}</aside>', '<div class="newsletter-box">{}</div>', "<nav>{}</nav>", "<form><p>{}</p></form>", '<div id="comments"><p>{}</p></div>']

    def inline(depth):
        shown, kept = "", ""
        for _ in range(data.draw(st.integers(1, 4))):
            kind = data.draw(st.integers(0, 3))
            if kind == 0 and depth < 3:
                s, k = inline(depth + 1)
                shown, kept = shown + f"<b title=it's>{s}</b>", kept + k
            elif kind == 1:
                shown += data.draw(st.sampled_from(aside)).format(next(words))
            else:
                w = f" {next(words)}{data.draw(st.sampled_from(['', ' ', chr(10)]))}"
                shown, kept = shown + w, kept + w
        return shown, kept

    def body(depth):
        shown, kept = "", []
        for _ in range(data.draw(st.integers(1, 4))):
            kind = data.draw(st.integers(0, 3))
            if kind == 0 and depth < 3:
                s, k = body(depth + 1)
                shown, kept = shown + f'<div class="search-results x">{s}</div>', kept + k
            elif kind == 1:
                shown += data.draw(st.sampled_from(blocks)).format(next(words))
            else:
                s, k = inline(0)
                shown, kept = shown + f"<p>{s}{data.draw(st.sampled_from(['</p>', '']))}", [*kept, " ".join(k.split())]
        return shown, kept

    shown, kept = body(0)
    page = f"<html><body><header>{next(words)}</header><article>{shown}</article><footer>{next(words)}</footer></body></html>"
    assert html_extract.main_text(page) == "\n\n".join(k for k in kept if k)


# --- 7, 10 -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Released under the Foo License.", []), ("Released under the BSD License.", []), ("Licensed under the Apache License, Version 1.1.", []), ("This work is licensed under the GNU General Public License, version 9.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 2.", []), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-notice"]), ("Licensed under CC BY-NC-ND 4.0.", []),
        ("// SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}", ["GPL-2.0-or-later-SPDX"]), ("SPDX-License-Identifier: Foo-1.0", []), ("Released under the terms of the MIT License.", ["MIT-notice"]),
    ],
)
def test_license_names_and_versions_are_exact(text, names):
    assert [f[0] for f in licenses.scan("Some words before it stand here. " + text)] == names


def test_license_rank_leaves_out_only_what_cannot_be_confirmed():
    rng = np.random.default_rng(2)
    body = [w for w, _, _ in licenses.words(licenses.TEMPLATES["GPL-3.0"])]
    for _ in range(20):
        block = list(rng.permutation(body)[: rng.integers(1, len(body))]) + body[: rng.integers(0, len(body))]
        able = {name for _, name, _ in licenses.rank(block)}
        for name, template in licenses.TEMPLATES.items():
            tw = [w for w, _, _ in licenses.words(template)]
            _, _, same, _, exact = licenses.align(block, tw)
            assert not (exact and same >= licenses.LEAST_WORDS * len(tw)) or name in able or licenses.TELLING[name] - set(block)


def test_licenses_of_odd_tables(spark):
    assert licenses.notices(docs_of(spark, [])).count() == 0
    rows = licenses.notices(docs_of(spark, [(None, "Released under the MIT License."), (1, None), (1, "Released under the MIT License."), (1, "Released under the MIT License.")])).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]


KEY = "q7Rz0Lx2Kc9Vb4Nm8Wd1"


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        (f"deploy/sample-{KEY}x", [("entropy_base64", 13, 35)]), (f"path/example/{KEY}/", [("entropy_base64", 12, 34)]), (f"{KEY[:10]}example{KEY[10:]}", []), (f"sha256-{KEY}{KEY}", []),
        ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", []), ("JBSWY3DPEHPK3PXPQ7TZ2CNV", [("entropy_base32", 0, 24)]), ("k3x9q7mzw1r8tb5vn2cj", [("entropy_lower", 0, 20)]), ("averyveryverylongword2andmore", []), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", []),
    ],
)
def test_allow_list_suppresses_windows(spark, text, spans):
    row = secret_scan.scan(docs_of(spark, [(1, text)])).first()
    assert [(m["kind"], m["start"], m["stop"]) for m in row["entropy_spans"]] == spans
