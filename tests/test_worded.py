"""Pages with their lines and words as nested rows: what stays where it is isn't shuffled."""

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import pages, raster, spatial
from vellum.plans import registry
from vellum.sources.layout import items_of, worded_lines_of, worded_pages_of


def test_nested_words_are_the_flat_ones(spark):
    texts = ["", None, "a  b\n\n c", "\n".join(f"w{k} x" for k in range(45)), " \n ", "é 😀 z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flat = items_of(docs).select("doc_id", "page_index", "line_no", "word_no", "o", "text")
    lines = worded_pages_of(docs).select("doc_id", "page_index", F.explode("lines").alias("l")).select("doc_id", "page_index", "l.line_no", F.explode("l.words").alias("w"))
    assert sorted(map(tuple, lines.select("doc_id", "page_index", "line_no", "w.*").collect())) == sorted(map(tuple, flat.collect()))
    assert worded_pages_of(docs).filter("doc_id = 3").count() == 3


def test_page_queries_shuffle_nothing(spark, sf_dir):
    for name in ("item_inks", "nested_text_scan", "underlined_items", "item_ink_colour"):
        assert "Exchange" not in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString(), name


def test_inks_of_lines_without_background_pixels_or_width(spark):
    px = [(1, 0, x, 20, 20, 20) for x in (3, 3, 4)] + [(2, 0, x, 20, 20, 20) for x in (3, 3)]
    items = [(1, 7, -5.0, 3.5), (1, 8, 4.0, 4.0), (1, 9, 2.2, 90.0), (1, 10, None, 9.0), (2, 1, 0.0, 9.0), (3, 1, 0.0, 9.0)]
    pixels = spark.createDataFrame(px, "line long, y int, x int, r int, g int, b int")
    ground = spark.createDataFrame([(1, [250, 250, 250]), (3, [250, 250, 250])], "line long, background array<int>")
    got = raster.item_inks(pixels, spark.createDataFrame(items, "line long, item int, left double, right double"), ground, "line").collect()
    ink = [20, 20, 20]
    assert sorted((r["line"], r["item"], r["ink"]) for r in got) == [(1, 7, ink), (1, 8, None), (1, 9, ink), (1, 10, None), (2, 1, None), (3, 1, None)]


def test_rows_of_pixels_are_dealt_over_more_tasks_than_a_shuffle_has(spark, sf_dir):
    for name in ("dark_runs", "vector_rules"):
        assert registry.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 16, name


def test_table_rules_deal_rows_of_pixels_by_number(spark, sf_dir):
    assert registry.QUERIES["table_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2


def test_worded_lines_hold_text_and_words(spark):
    texts = ["", None, "a  b\n\n c", " \n ", "é 😀 z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["doc_id"], r["line_no"], r["text"], [tuple(w) for w in r["words"]]) for r in worded_lines_of(docs).orderBy("doc_id", "line_no").collect()]
    assert got == [(2, 0, "a  b", [(0, 0, "a"), (2, 3, "b")]), (2, 2, " c", [(1, 1, "c")]), (4, 0, "é 😀 z", [(0, 0, "é"), (1, 2, "😀"), (2, 4, "z")])]


def test_line_style_runs_shuffle_nothing(spark, sf_dir):
    assert "Exchange" not in registry.QUERIES["line_style_runs"](spark, sf_dir)._jdf.queryExecution().toString()


def test_nms_dedupe_shuffles_nothing(spark, sf_dir):
    assert "Exchange" not in registry.QUERIES["nms_dedupe"](spark, sf_dir)._jdf.queryExecution().toString()


def test_suppression_beyond_its_rounds(spark):
    words = [(" a", k, 10.0 * k, 10.0 * k + 9, 0.0, 9.0, k) for k in range(40)] + [("a", 100 + k, 10.0 * k + 1, 10.0 * k + 10, 0.0, 9.0, -1) for k in range(40)] + [(None, 300, 0.0, 9.0, 0.0, 9.0, None)]
    pages = spark.createDataFrame([(1, words), (2, []), (3, None)], "page long, words array<struct<text:string,seq:long,left:double,right:double,top:double,bottom:double,conf:int>>")
    assert sorted(r["seq"] for r in spatial.page_suppressed(pages, 0.5, "page").collect()) == [*range(40), 300]


def test_skew_angle_shuffles_nothing(spark, sf_dir):
    assert "Exchange" not in registry.QUERIES["skew_angle"](spark, sf_dir)._jdf.queryExecution().toString()


def test_scramble_queries_shuffle_nothing(spark, sf_dir):
    for name in ("scramble_ratio", "junk_layer_pages"):
        assert "Exchange" not in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString(), name


def test_coverage_queries_shuffle_no_words(spark, sf_dir):
    for name in ("spatial_anti_overlap", "ocr_union"):
        assert "Exchange" not in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString(), name


def test_coverage_compares_dense_boxes_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS", 7)
    box = np.array([[float(k % 9), k % 9 + 10.0, float(k % 5), k % 5 + 10.0] for k in range(40)]).T
    other = np.array([[3.0, 300.0, 2.0, 9.0], [np.nan, 1.0, 0.0, 1.0], [-9.0, 1.0, -9.0, 99.0]]).T
    page, there = np.arange(40) % 2, np.array([0, 0, 1])
    want = [any(p == q and max(0, min(a[1], b[1]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[2], b[2])) > 40 for q, b in zip(there, other.T)) for p, a in zip(page, box.T)]
    assert spatial._covered((page, box), (there, other), 0.4).tolist() == want and 0 < sum(want) < 40


def test_line_colours_and_pipe_repair_shuffle_nothing(spark, sf_dir):
    for name in ("line_colours", "pipe_repair"):
        assert "Exchange" not in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString(), name


def test_bars_of_lines(spark):
    word = lambda k, t, a, b: (k, t, float(a), float(b), 0.0, 12.0)
    lines = [
        (1, [word(0, "|", 0, 2), word(1, "think", 8, 30)]),  # prose follows
        (2, [word(0, "|", 0, 2), word(1, "think", 40, 70)]),  # too far
        (3, [word(1, "|", 40, 42), word(0, "did.", 0, 30)]),  # nothing follows, prose before
        (4, [word(0, "did", 0, 30), word(1, "|", 34, 36), word(2, "9", 40, 45)]),
        (5, [word(0, "|", 34, 36)]),
        (6, []),
        (7, None),
    ]
    df = spark.createDataFrame(lines, "line long, words array<struct<word_no:int,t:string,left:double,right:double,top:double,bottom:double>>")
    assert sorted(map(tuple, spatial.line_bars(df, "line").collect())) == [(1, 0, "I"), (2, 0, "|"), (3, 1, "I"), (4, 1, "|"), (5, 0, "|")]


def test_page_ranges_stay_in_their_row(spark):
    specs = spark.createDataFrame([(1, "3-2, 2, x, 9, 1-3", 3), (2, "0-1", 0), (3, "99999999999999999999", 5), (4, None, 5)], "id int, spec string, n long")
    got = pages.parse_ranges(specs)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 1, None), (1, 2, 2, None), (1, 3, 0, None), (1, 1, None, "x"), (1, 2, None, "9"), (3, 1, None, "99999999999999999999")], key=str)


def test_hits_of_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(1)
    size = 4.0 ** rng.integers(0, 14, (200, 2)) * rng.random((200, 2))
    at = rng.random((200, 2)) * 4000 - 2000 - size / 2
    boxes = [(1, 0, k, float(x), float(x + w), float(y), float(y + h)) for k, ((x, y), (w, h)) in enumerate(zip(at, size))]
    points = [(1, 0, k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((60, 2)) * 4000 - 2000)]
    want = [(1, k, max((b[2] for b in boxes if b[3] <= x <= b[4] and b[5] <= y <= b[6]), default=None)) for _, _, k, x, y in points]
    p = spark.createDataFrame(points, "doc_id int, page_index int, turn int, x double, y double")
    b = spark.createDataFrame(boxes, "doc_id int, page_index int, line_no int, left double, right double, top double, bottom double")
    assert sorted(map(tuple, spatial.hits(p, b, "turn", "line_no").collect())) == want and sum(k is None for _, _, k in want) < 60
