"""Literal cases whose edges the tables cannot show, and invariants."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import editlog, pages
from vellum.sources.layout import table


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("12", True), ("xiv", True), ("Page 12 of 90", True), ("mix", True), ("Figure 3", False)])
def test_page_number(spark, text, want):
    assert one(spark, text, T.is_page_number) is want


@pytest.mark.parametrize(("text", "want"), [("ny", True), ("Ja ~", True), ("03060", False), ("is it to be", False), ("Engineer", False), ("", True)])
def test_noise_line(spark, text, want):
    assert one(spark, text, T.is_noise_line) is want


def test_noise_tokens(spark):
    assert one(spark, "Engineer ~ |", T.clean_noise_tokens) == "Engineer"


def test_repeat_key(spark):
    assert one(spark, "Chapter 4 · 47", T.repeat_key) == one(spark, "Chapter 4 · 48", T.repeat_key) == "chapter # · #"


def test_rtf(spark):
    assert one(spark, "a{b}\\éﬁ", T.escape_rtf) == "a\\{b\\}\\\\\\u233?\\u-1279?"
    assert one(spark, "😀", T.escape_rtf) == "\\u-10179?\\u-8704?"


@pytest.mark.parametrize(("raw", "want"), [("example.com", "https://example.com"), ("a@b.com", "mailto:a@b.com"), ("tel:1", "tel:1"), ("", "")])
def test_url(spark, raw, want):
    assert one(spark, raw, T.url) == want


def test_rotate_box(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 25.0)], "x0 double, y0 double, x1 double, y1 double")
    assert tuple(df.select(G.unrotated(G.box(), F.lit(180), F.lit(100.0), F.lit(50.0)).alias("b")).first()["b"]) == (70.0, 25.0, 90.0, 30.0)


@pytest.mark.parametrize(
    ("spec", "n", "want", "bad"),
    [("1-5, 8, 11-14", 12, [0, 1, 2, 3, 4, 7, 10, 11], []), ("5-3", 10, [2, 3, 4], []), ("0, 20, x, 2, 2", 10, [1], ["0", "20", "x"]), ("0-3", 10, [0, 1, 2], []), ("9-12, 1", 10, [8, 9, 0], [])],
)
def test_ranges(spark, spec, n, want, bad):
    rows = pages.parse_ranges(spark.createDataFrame([(1, spec, n)], "id int, spec string, n long")).orderBy("pos").collect()
    assert [r["page"] for r in rows if r["bad"] is None] == want
    assert [r["bad"] for r in rows if r["bad"] is not None] == bad


@settings(max_examples=5, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1, max_size=30))
def test_ranges_round_trip(spark, wanted):
    text = pages.compress_ranges(spark.createDataFrame([(1, p) for p in wanted], "id int, page int")).first()["ranges"]
    back = pages.parse_ranges(spark.createDataFrame([(1, text, 61)], "id int, spec string, n long")).collect()
    assert {r["page"] for r in back} == wanted


def test_compress(spark):
    assert pages.compress_ranges(spark.createDataFrame([(1, p) for p in (0, 1, 2, 6, 8, 9)], "id int, page int")).first()["ranges"] == "1-3, 7, 9-10"


def test_zip_crc(spark, sf_dir):
    from vellum.plans.registry import QUERIES

    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    assert all(r["crc"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in QUERIES["zip_crc"](spark, sf_dir).collect())


def test_undo_then_redo_after_edit(spark):
    ops = [(1, 1, "edit"), (1, 2, "edit"), (1, 3, "undo"), (1, 4, "edit"), (1, 5, "redo")]
    assert editlog.replayed(spark.createDataFrame(ops, "doc_id long, op_seq long, op string")).first()["applied"] == [1, 4]


def test_upsert_keeps_move(spark):
    rows = [(1, 1, 0, 10.0, 20.0, "a", 5.0, None), (1, 2, 0, 10.2, 20.1, "b", None, None)]
    r = editlog.upserted(spark.createDataFrame(rows, "doc_id long, edit_seq long, page_index int, x double, baseline double, new_text string, dx double, dy double")).collect()
    assert len(r) == 1 and r[0]["new_text"] == "b" and r[0]["dx"] == 5.0


def test_rate_limit_stream(spark, tmp_path):
    """The streaming counts equal the batch counts."""
    from vellum.streaming import rate_limit

    src = str(tmp_path / "in")
    table(spark, "/root/testdata/sf0.001", "events").select(F.col("event_id").alias("req_id"), "ts", (F.col("user_id") % 5).alias("client")).repartition(3).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = rate_limit.counted(spark.readStream.schema(batch.schema).parquet(src), "1 hour", 4, "3650 days")
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    key = lambda r: (r["start"], r["client"], r["n"], r["rejected"])
    assert sorted(map(key, spark.table("rates").collect())) == sorted(map(key, rate_limit.counted(batch, "1 hour", 4).collect()))


def test_clients_are_apart(spark):
    from vellum.streaming import rate_limit

    rows = [(i, f"2024-01-01 00:00:{i:02d}", 1) for i in range(40)] + [(99, "2024-01-01 00:00:59", 2)]
    r = rate_limit.decided(spark.createDataFrame(rows, "req_id int, t string, client int").withColumn("ts", F.to_timestamp("t")), "1 minute", 30).collect()
    assert sum(x["allowed"] for x in r if x["client"] == 1) == 30 and all(x["allowed"] for x in r if x["client"] == 2)


def test_sums_before_cut_into_stretches(spark, monkeypatch):
    """Negative, sparse and repeated places; two groups; stretches of three places."""
    monkeypatch.setattr(pages, "STRETCH", 3)
    rows = [(g, p, f"d{k}", k + 1) for g in (0, 1) for k, p in enumerate((-7, -3, -3, 0, 1, 2, 3, 40))]
    got = pages.sums_before(spark.createDataFrame(rows, "g int, pos long, id string, n long"), "g", ["pos", "id"], F.col("n"))
    want = {(g, i): sum(n2 for g2, p2, i2, n2 in rows if g2 == g and (p2, i2) < (p, i)) for g, p, i, _ in rows}
    assert {(r["g"], r["id"]): r["before"] for r in got.collect()} == want
    assert got.columns == ["g", "pos", "id", "n", "before"]
