"""Folding with places and search by grams against plain, one-character-at-a-time versions."""

import random
import time
import unicodedata

import numpy as np
import pytest

from vellum.operators import folding, search
from vellum.operators.folds import folded as in_order

WHITE = set(map(chr, folding.WHITE))
LINE = "doc_id long, page_index int, line_no int, text string"


def plain_fold(s, keep_case=False):
    norm, places, gap = "", [], -1
    for i, raw in enumerate(s or ""):
        if raw == "­":
            continue
        new = unicodedata.normalize("NFKC", folding.SIGNS.get(raw, raw)) if ord(raw) < 0x10000 else raw
        for c in new if keep_case or ord(raw) > 0xFFFF else new.lower():
            if c in WHITE:
                gap = i if norm and gap < 0 else gap
                continue
            if gap >= 0:
                norm, gap = norm + " ", places.append(gap) or -1
            norm += c
            places.append(i)
    return norm, places


def plain_search(text, needle, match_case=False, fuzzy=False):
    """(start, stop, dist), with a table filled cell by cell."""
    norm, places = plain_fold(text, match_case)
    raw = needle or ""
    q = plain_fold(raw, match_case)[0]
    if not q or not norm:
        return []
    n, budget = len(norm), search.budget_of(len(q)) if fuzzy and not match_case else 0
    found = [(0, s, s + len(q)) for s in range(n) if norm.startswith(q, s)]
    if budget:
        row = [(0, j) for j in range(n + 1)]
        for i, c in enumerate(q, 1):
            new = [(i, 0)]
            for j in range(1, n + 1):
                best = (row[j - 1][0] + (c != norm[j - 1]), row[j - 1][1])
                for d, s in (row[j], new[j - 1]):
                    if d + 1 < best[0]:
                        best = (d + 1, s)
                new.append(best)
            row = new
        found += [(row[j][0], row[j][1], j) for j in range(1, n + 1) if 0 < row[j][0] <= budget and (j == n or row[j][0] < row[j + 1][0] or norm[j] == " ")]
    taken = []
    for d, s, e in sorted(found, key=lambda f: (f[0], f[1], f[1] - f[2])):
        if e > s and all(e <= a or s >= b for _, a, b in taken):
            taken.append((d, s, e))
    out = []
    for d, s, e in taken:
        s, e = s + (norm[s] == " "), e - (norm[e - 1] == " ")
        if e <= s or d and (s and norm[s - 1].isalnum() or e < n and norm[e].isalnum()):
            continue
        a, b = places[s], places[e - 1] + 1
        if raw[0] in WHITE and not (a == 0 or text[a - 1] in WHITE) or raw[-1] in WHITE and not (b >= len(text) or text[b] in WHITE):
            continue
        out.append((a, b, d))
    return sorted(out)


def held(spark, texts, needles, **options):
    lines = spark.createDataFrame([(k // 7, 0, k, t) for k, t in enumerate(texts)], LINE).repartition(3)
    got = search.search(lines, spark.createDataFrame(list(enumerate(needles)), "needle_id long, needle string"), **options).collect()
    want = sorted((n, k // 7, 0, k, *m) for n, q in enumerate(needles) for k, t in enumerate(texts) for m in plain_search(t, q, **options))
    assert sorted(tuple(r) for r in got) == want
    return want


SIGNS = "ab  \t­ ﬁﬀ①É“İ¨﻿😀日㎏-—"


@pytest.mark.parametrize("keep_case", [False, True])
def test_folding(spark, keep_case):
    rng = random.Random(1)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(14))) for _ in range(400)] + [None, "", " ", "­", "x" * 3000 + " ﬁ" * 2000]
    rows = folding.folded(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), keep_case=keep_case)
    for r in rows.collect():
        norm, places = plain_fold(texts[r["k"]], keep_case)
        assert r["norm"] == norm
        moved, by, s = [], 0, 0
        for i in range(len(norm)):
            while s < len(r["shifts"]) and r["shifts"][s]["at"] <= i:
                by, s = r["shifts"][s]["by"], s + 1
            moved.append(i + by)
        assert moved == places
        assert len(r["shifts"]) <= len(norm)


def test_original_place(spark):
    from pyspark.sql import functions as F

    r = folding.folded(spark.createDataFrame([("a   b ﬁx",)], "text string")).select("norm", *(folding.original(F.lit(i), F.col("shifts")).alias(f"p{i}") for i in range(7))).first()
    assert tuple(r) == ("a b fix", 0, 1, 4, 5, 6, 6, 7)


def test_exact_search(spark):
    texts = ["the bobcat sat only here, cat sat on", "Cat  sat", "on the mat", "a  b c", "", None, "x cat sat on cat­sat on", "aaaa", "ﬁve ﬁngers", "q\\E b x\\E b", "x" * 5000 + " cat sat on " + "y" * 5000 + " cat", "Straße STRASSE"]
    needles = ["cat sat on", "cat", "on the", "a  b", "", None, "zz top hat", "aa", "fi", "i", "x\\E b", " cat ", "cat ", " cat", "five FINGERS", "ß", "e", "y" * 4990]
    assert len(held(spark, texts, needles)) > 40
    assert held(spark, texts, needles, match_case=True) != held(spark, texts, needles)


def test_fuzzy_search(spark):
    rng = random.Random(4)
    words = ["software", "sofware", "softwares", "soft", "ware", "join", "roin", "groin", "tent", "text", "test", "a", "of", "engineer", "enginer", "ﬁnding", "finding", "naïve", "x1y2", "-", "­", "  ", "(text)"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(120)] + [None, "", "sofware engineer", "tex", "xt", " text"]
    needles = ["software", "join", "text", "of", "engineering", " soft ware", "finding naive", "software engineer", "te-st", "abcdefgh", "x1y2 -", "tent text", None, "soft "]
    want = held(spark, texts, needles, fuzzy=True)
    assert {m[6] for m in want} == {0, 1, 2} and len(want) > 150


def test_a_match_inside_a_word_takes_its_place(spark):
    """The nearest match begins inside a word and isn't shown, but what lies over it isn't a match either."""
    texts = ["hedtion the the the by", "the the the by", "hedtion  the the x the the the"]
    assert held(spark, texts, ["thou the the"], fuzzy=True)


def test_common_parts_give_few_windows(spark, monkeypatch):
    lines = spark.createDataFrame([(1, 0, k, "wand the bird and the tree, or the sea " * 20) for k in range(50)], LINE)
    needles = spark.createDataFrame([(1, "xkcd the quiz"), (2, "the zephyrous")], "needle_id long, needle string")
    seen = spark.sparkContext.accumulator(0)
    verify = search._verify

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield from verify(iter([batch]))

    monkeypatch.setattr(search, "_verify", counted)
    assert search.search(lines, needles, fuzzy=True).count() == 0
    assert seen.value < 50


def test_fuzzy_search_of_random_texts(spark):
    rng = random.Random(9)
    draw = lambda n, signs: "".join(rng.choice(signs) for _ in range(n))
    texts = [draw(rng.randrange(40), "ab c") for _ in range(150)]
    needles = [draw(rng.randrange(1, 14), "abc ") for _ in range(40)]
    assert len(held(spark, texts, needles, fuzzy=True)) > 400


def test_long_lines_are_searched_whole(spark):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(300)]
    text = " ".join(rng.choice(words) for _ in range(2500))
    at = [0, 2030, 2048, 4100, 9000, len(text) - 12]
    for k in at:
        text = text[:k] + " needel stack " + text[k:]
    want = held(spark, [text], ["needle stack", "needel stack"], fuzzy=True)
    assert sum(m[0] == 0 for m in want) == sum(m[0] == 1 for m in want) == len(at)


def test_fallback_by_document(spark):
    rows = [(1, 0, 0, "a text here"), (1, 0, 1, "a tent here"), (2, 0, 0, "a tent here"), (3, 0, 0, "nothing")]
    lines = spark.createDataFrame(rows, LINE)
    needle = spark.createDataFrame([(5, "text")], "needle_id long, needle string")
    assert sorted((r["doc_id"], r["line_no"], r["dist"]) for r in search.search_documents(lines, needle).collect()) == [(1, 0, 0), (2, 0, 1)]
    assert [(r["doc_id"], r["dist"]) for r in search.search_documents(lines, needle, match_case=True).collect()] == [(1, 0)]


def test_fuzzy_queries_equal_the_plain_table(spark):
    from vellum.plans import edit_queries as E

    sf = "/root/testdata/sf0.001"
    needles = [(r["needle_id"], r["needle"]) for r in E.typos(spark, sf).collect()][:12]
    lines = E.rough_lines(spark, sf).select("doc_id", "page_index", "line_no", "text").limit(300)
    words = " ".join(q for _, q in needles)
    rows = [tuple(r) for r in lines.collect()] + [(-1, 0, 0, words), (-1, 0, 1, words.upper().replace(" ", "  "))]
    got = search.search(spark.createDataFrame(rows, LINE), spark.createDataFrame(needles, "needle_id long, needle string"), fuzzy=True).collect()
    short = [r for r in rows if len(r[3]) < 400]
    want = sorted((n, *r[:3], *m) for n, q in needles for r in short for m in plain_search(r[3], q, fuzzy=True))
    keys = {r[:3] for r in short}
    assert sorted(tuple(r) for r in got if (r["doc_id"], r["page_index"], r["line_no"]) in keys) == want and want


def test_a_hundred_thousand_needles(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (20_000, 7))]
    needles = [(k, f"{vocabulary[a]} {vocabulary[b]}") for k, (a, b) in enumerate(rng.integers(0, 20_000, (100_000, 2)).tolist())]
    lines = [(k // 20, 0, k, " ".join(vocabulary[j] for j in rng.integers(0, 20_000, 12))) for k in range(2000)]
    for k in range(100):
        n = needles[k * 7][1]
        lines.append((1000, 0, 5000 + k, f"x {n[:4]}{n[5:]} y"))
    began = time.time()
    got = search.search(spark.createDataFrame(lines, LINE), spark.createDataFrame(needles, "needle_id long, needle string"), fuzzy=True).collect()
    found = {(r["needle_id"], r["line_no"]) for r in got if r["doc_id"] == 1000}
    assert {(7 * k, 5000 + k) for k in range(100)} <= found and time.time() - began < 120


def test_replacement_of_spans(spark):
    lines = spark.createDataFrame([(1, 0, "one two one"), (1, 1, "none"), (2, 0, "😀 one"), (3, 0, "abc")], "doc_id long, line_no int, text string")
    spans = spark.createDataFrame([(1, 0, 8, 11), (1, 0, 0, 3), (1, 0, 2, 5), (1, 0, 0, 3), (2, 0, 2, 99), (3, 0, -5, 1), (3, 0, 3, 3), (9, 0, 0, 1)], "doc_id long, line_no int, start int, stop int")
    got = {(r["doc_id"], r["line_no"]): (r["text"], r["n"]) for r in search.replaced(lines, spans, "<>").collect()}
    assert got == {(1, 0): ("<> two <>", 2), (2, 0): ("😀 <>", 1), (3, 0): ("<>bc<>", 2)}


def test_groups_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(k % 3 if k < 60 else k, k) for k in range(100)], "g int, v int")
        got = in_order(rows, ("g",), ("v",), lambda c: [(c["g"][0], len(c["v"]), sum(c["v"]))], "g int, n int, s int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(g, 20, sum(range(g, 60, 3))) for g in range(3)] + [(k, 1, k) for k in range(60, 100)]
