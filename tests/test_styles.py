"""Style runs, run models, floods and annotations: cases whose edges the tables don't show."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import annotations, raster, styles

ITEM = "doc_id long, line_no int, seq int, text string, left double, right double, height double, baseline double, bold boolean, italic boolean, underline boolean, font string, colour array<int>, line_text string, line_size double, line_baseline double, ocr boolean"


def line(no, words, text, size=12.0, ocr=False):
    """Words are (text, style): dicts of what differs from plain ones; a word begins 3 after the one before it."""
    rows, x = [], 0.0
    for k, (t, style) in enumerate(words):
        s = {"height": 12.0, "baseline": 100.0, "bold": False, "italic": False, "underline": False, "font": "F", "colour": None, "gap": 3.0} | style
        x += s["gap"]
        rows.append((1, no, k, t, x, x + 6 * len(t or ""), s["height"], s["baseline"], s["bold"], s["italic"], s["underline"], s["font"], s["colour"], text, size, 100.0, ocr))
        x += 6 * len(t or "")
    return rows


def red(r):
    return {"colour": [r, 0, 0]}


def test_style_runs(spark):
    sup = {"height": 8.0, "baseline": 95.0, "gap": 0.0}
    rows = [
        *line(1, [("Total", {"bold": True}), ("of", {"bold": True}), ("it", {})], "Total of it"),
        *line(2, [("all", {}), ("plain", {})], "all plain"),
        *line(3, [("a", red(0)), ("b", red(16)), ("c", red(32)), ("d", red(40))], "a b c d"),  # c is near b, but not near a
        *line(4, [("Jan", {}), ("19", {}), ("th", sup), ("x", {})], "Jan 19th x"),
        *line(5, [("Jan", {}), ("th", sup)], "Janth", ocr=True),
        *line(6, [("Total", {"bold": True}), ("it", {})], "Total at it"),  # doesn't give the text
        *line(7, [("a", {"bold": True}), (" ", {"gap": 0.0}), ("", {}), ("b", {"bold": True, "gap": 9.0}), ("c", {"gap": 1.0})], "a bc"),
        *line(8, [(" ", {}), ("a", {"font": "G"}), ("b", red(1))], " a b"),
    ]
    got = {}
    for r in styles.style_runs(spark.createDataFrame(rows, ITEM)).orderBy("line_no", "run").collect():
        got.setdefault(r["line_no"], []).append((r["text"], r["bold"], r["font"], r["colour"], r["sup_ratio"], r["sup_raise"]))
    assert got == {
        1: [("Total of ", True, "F", None, None, None), ("it", False, "F", None, None, None)],
        3: [("a b ", False, "F", [0, 0, 0], None, None), ("c d", False, "F", [32, 0, 0], None, None)],
        4: [("Jan 19", False, "F", None, None, None), ("th ", False, "F", None, 0.667, 0.417), ("x", False, "F", None, None, None)],
        7: [("a b", True, "F", None, None, None), ("c", False, "F", None, None, None)],
        8: [(" ", False, None, None, None, None), ("a ", False, "G", None, None, None), ("b", False, "F", [1, 0, 0], None, None)],
    }


def test_cleaned_runs(spark):
    run = "array<array<struct<text:string,size:double,bold:boolean,italic:boolean,underline:boolean,link:string>>>"
    rows = [(1, [[("a​b", None, None, None, None, " "), ("", 5.0, True, None, None, None)], None, []]), (2, [[("​", None, None, None, None, None)]]), (3, []), (4, None), (5, [[("x", 1000.0, False, True, True, "u"), (None, 1.0, None, None, None, None), ("y", 0.0, None, None, None, None)]])]
    df = spark.createDataFrame(rows, f"id int, runs {run}")
    got = {r["id"]: r["c"] and [[tuple(x) for x in line] for line in r["c"]] for r in df.select("id", styles.cleaned_runs(F.col("runs"), F.lit(11.0), F.lit(True), F.lit(False)).alias("c")).collect()}
    assert got == {1: [[("ab", 11.0, True, False, False, None)], [], []], 2: None, 3: None, 4: None, 5: [[("x", 400.0, False, True, True, "u"), ("y", 11.0, True, False, False, None)]]}


def test_refined(spark):
    items = [(1, k, t, f, b, None, None, True) for k, t, f, b in [(0, "a", "bold", None), (0, " ", "none", None), (1, "a", "bold", None), (1, "b", "none", True), (2, "a", "plain", True), (2, "b", "bold", None), (3, "a", "plain", None)]]
    df = spark.createDataFrame(items, "doc_id long, line_no int, text string, font string, bold boolean, italic boolean, line_bold boolean, line_italic boolean")
    fonts = spark.createDataFrame([("bold", "ABC+Calibri-DemiBold", None, None), ("plain", None, None, False)], "font string, name string, bold boolean, italic boolean")
    got = {r["line_no"]: (r["bold"], r["italic"]) for r in styles.refined(df, fonts).collect()}
    assert got == {0: (True, True), 1: (False, True), 2: (True, True), 3: (False, True)}


@pytest.mark.parametrize("seed", range(3))
def test_flood(spark, seed):
    rng = random.Random(seed)
    rows, want = [], set()
    for image in range(4):
        w, h = rng.randint(1, 14), rng.randint(1, 14)
        dark = {(x, y) for x in range(w) for y in range(h) if rng.random() < 0.45 and (x, y) not in {(0, 0), (w - 1, 0), (0, h - 1), (w - 1, h - 1)}}
        rows += [(image, y, x, *((0, 250, 0) if (x, y) in dark else (250 - rng.randint(0, 20),) * 3)) for x in range(w) for y in range(h)]
        todo = [(x, y) for x in range(w) for y in range(h) if (x in (0, w - 1) or y in (0, h - 1)) and (x, y) not in dark]
        seen = set(todo)
        while todo:
            x, y = todo.pop()
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if 0 <= p[0] < w and 0 <= p[1] < h and p not in dark and p not in seen:
                    seen.add(p)
                    todo.append(p)
        want |= {(image, y, x) for x, y in seen}
    px = spark.createDataFrame(rows, "image int, y int, x int, r int, g int, b int")
    got = raster.flooded(px).collect()
    assert {(r["image"], r["y"], x) for r in got for x in range(r["x0"], r["x1"] + 1)} == want


def test_annotations_that_draw_nothing(spark):
    cols = "doc_id long, page_index int, ann_seq long, kind string, x double, y double, width double, height double, rx double, ry double, x1 double, y1 double, x2 double, y2 double, points array<array<double>>, rows int, cols int, stroke string, fill string, stroke_width double, opacity double, marker boolean"
    blank = [None] * 10
    rows = [(1, 0, 1, "path", *blank, [[1.0, 2.0]], None, None, None, None, None, None, None), (1, 0, 2, "star", *blank, None, None, None, None, None, None, None, None), (1, 5, 3, "rect", *blank, None, None, None, None, None, None, None, None), (1, 0, 4, "path", *blank, None, None, None, None, None, None, None, None)]
    rows += [(1, 0, 5, "path", *blank, [[0.0, 0.0], [5.0], [10.0, 10.0], [20.0, 0.0]], None, None, "#ff0000", None, 0.1, 0.7, True), (1, 0, 6, "table", 10.0, 20.0, 40.0, 30.0, *[None] * 6, None, None, -2, None, None, None, None, None)]
    pages = spark.createDataFrame([(1, 0, 100.0, 100.0, 0)], "doc_id long, page_index int, page_w double, page_h double, rotation int")
    got = annotations.burnt_in(spark.createDataFrame(rows, cols), pages).orderBy("ann_seq", "at").collect()
    shown = [(r["ann_seq"], r["x0"], r["y0"], r["x1"], r["y1"], r["width"], r["opacity"]) for r in got]
    assert shown[:2] == [(5, 0.0, 100.0, 10.0, 90.0, 0.5, 0.7), (5, 10.0, 90.0, 20.0, 100.0, 0.5, 0.7)] and got[0]["colour"] == [1.0, 0.0, 0.0]
    assert [r["ann_seq"] for r in got[2:]] == [6] * 6  # three rows, one column
    assert shown[2] == (6, 10.0, 50.0, 50.0, 50.0, 1.0, 1.0) and shown[-1] == (6, 50.0, 50.0, 50.0, 80.0, 1.0, 1.0)


def test_item_inks(spark):
    px = [(1, 0, x, *c) for x, c in enumerate([(0, 0, 0), (4, 0, 0), (90, 90, 90), (250, 250, 250), (0, 0, 255), (90, 92, 90), (92, 90, 90), (250, 250, 250), (200, 0, 0)])]
    df = spark.createDataFrame(px, "line int, y int, x int, r int, g int, b int")
    items = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 4.0, 7.0), (1, 2, 7.2, 9.0), (1, 3, 3.0, 3.0)], "line int, item int, left double, right double")
    bg = spark.createDataFrame([(1, [255, 255, 255])], "line int, background array<int>")
    got = {r["item"]: r["ink"] for r in raster.item_inks(df, items, bg, "line").collect()}
    # two dark pixels, their grey edge below the band; blue and red are seen once
    assert got == {0: [2, 0, 0], 1: [91, 91, 90], 2: None, 3: None}


@pytest.mark.parametrize("seed", range(2))
def test_restyled_equals_plain(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        runs = [("".join(rng.choice("ab é") for _ in range(rng.randint(0, 5))), *(rng.random() < 0.5 for _ in range(3))) for _ in range(rng.randint(0, 5))]
        rows.append((k, runs, rng.randint(-2, 12), rng.randint(-2, 16), rng.choice(["bold", "italic", "underline"]), rng.random() < 0.5))
    df = spark.createDataFrame(rows, "k int, runs array<struct<text:string,bold:boolean,italic:boolean,underline:boolean>>, a int, b int, field string, v boolean")
    got = {r["k"]: [tuple(x) for x in r["out"]] for r in df.select("k", styles.restyled(F.col("runs"), F.col("a"), F.col("b"), F.col("field"), F.col("v")).alias("out")).collect()}
    for k, runs, a, b, field, v in rows:
        chars = [(ch, list(style)) for t, *style in runs for ch in t]
        for i, (_, style) in enumerate(chars):
            if a <= i < b:
                style[["bold", "italic", "underline"].index(field)] = v
        want = []
        for ch, style in chars:
            if want and want[-1][1] == style:
                want[-1][0] += ch
            else:
                want.append([ch, style])
        assert got[k] == [(t, *s) for t, s in want]


def test_faces_of_edits(spark):
    from vellum.operators import drafts

    edits = spark.createDataFrame([(1, 0, 1, "text", None, "ab é"), (1, 0, 2, "image", None, None), (2, 0, 1, "text", None, "az"), (3, 0, 1, "text", None, "₹"), (4, 1, 9, "text", None, " ")], "doc_id long, page_index int, edit_seq long, kind string, style string, new_text string")
    options = spark.createDataFrame([(1, 0, 1, 1, "f", "embedded"), (1, 0, 1, 2, "base", "winansi"), (2, 0, 1, 1, "f", "embedded"), (3, 0, 1, 1, "full", "any")], "doc_id long, page_index int, edit_seq long, rank int, font string, kind string")
    charsets = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "a")], "font string, ch string")
    lost = drafts.undrawable(edits, options, charsets)
    assert [tuple(r) for r in lost.collect()] == [(2, 0, 1)]
    assert sorted((r["doc_id"], r["edit_seq"], r["tier"]) for r in drafts.tiers(edits, lost).collect()) == [(1, 1, 2), (1, 2, 2), (2, 1, 3), (3, 1, 1), (4, 9, 1)]


def test_long_logs_replay_in_linear_time(spark):
    import time

    from vellum.operators import editlog

    ops = spark.range(200_000).selectExpr("id div 150000 as doc_id", "id as op_seq", "case when id % 3 = 2 then 'undo' when id % 7 = 5 then 'redo' else 'edit' end as op")
    began = time.time()
    got = {r["doc_id"]: r["applied"] for r in editlog.replayed(ops).collect()}
    assert time.time() - began < 60
    for doc, rows in ((0, range(150_000)), (1, range(150_000, 200_000))):
        stack, at = [], 0
        for k in rows:
            if k % 3 == 2:
                at = max(at - 1, 0)
            elif k % 7 == 5:
                at = min(at + 1, len(stack))
            else:
                del stack[at:]
                stack.append(k)
                at += 1
        assert got[doc] == stack[:at]
