"""The progressive index as a stream against its batch form, and sources read page by page."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.datasource import EqualTo, In, StringContains

from vellum.operators import search
from vellum.plans import registry
from vellum.sources import lazy_pages
from vellum.streaming import page_index

PAGE = "doc_id long, generation long, page_index int, pages int, text string"


def stream(spark, tmp_path, chunks):
    """All rows that the index gives for chunks that come one after the other."""
    src = tmp_path / "in"
    for k, rows in enumerate(chunks):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(str(src / f"chunk={k:03d}"))
    spark.conf.set(*page_index.STORE)
    try:
        pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(str(src / "chunk=*"))
        seen = []
        q = page_index.indexed(pages, "cat").writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
        q = q.foreachBatch(lambda df, k: seen.append([tuple(r) for r in df.collect()])).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    finally:
        spark.conf.unset(page_index.STORE[0])
    return seen


def test_stream_equals_batch_for_any_chunking(spark, tmp_path):
    rng = random.Random(6)
    words = ["cat", "C­at", "a", "ﬁt", "concat cat"]
    pages = [(d, 1, p, 6, "\n".join(" ".join(rng.choice(words) for _ in range(4)) for _ in range(3))) for d in range(4) for p in range(6)]
    lines = [(d, p, 10 * p + k, t) for d, _, p, _, text in pages for k, t in enumerate(text.split("\n"))]
    hits = search.search(spark.createDataFrame(lines, "doc_id long, page_index int, line_no int, text string"), spark.createDataFrame([(1, "cat")], "needle_id long, needle string")).groupBy("doc_id").count().collect()
    want = {(r["doc_id"], r["count"]) for r in hits}
    batch = page_index.indexed(spark.createDataFrame(pages, PAGE), "cat").collect()
    assert {(r["doc_id"], r["matches"]) for r in batch} == want and all(r["final"] and r["indexed"] == 6 for r in batch)
    for n in (3, 7):
        shuffled = rng.sample(pages, len(pages))
        seen = [r for rows in stream(spark, tmp_path / str(n), [shuffled[k::n] for k in range(n)]) for r in rows]
        final = [r for r in seen if r[5]]
        assert {(r[0], r[4]) for r in final} == want and len(final) == 4
        for d in range(4):
            grown = [r[2] for r in seen if r[0] == d]
            assert grown == sorted(grown) and grown[-1] == 6


def test_newer_generations_drop_what_was_there(spark, tmp_path):
    chunks = [
        [(1, 1, 0, 2, "cat cat"), (2, 1, 0, 1, "cat")],
        [(1, 2, 0, 2, "cat"), (1, 1, 1, 2, "cat cat cat")],  # the old one's last page comes late
        [(1, 1, 0, 2, "cat cat"), (1, 2, 0, 2, "cat cat cat cat")],  # stale, and a page that is there already
        [(1, 2, 1, 2, "a cat"), (2, 1, 0, 1, "cat")],
        [(1, 2, 1, 2, "a cat")],
    ]
    seen = stream(spark, tmp_path, chunks)
    rows = [r for chunk in seen for r in chunk]
    assert sorted(r for r in rows if r[0] == 2) == [(2, 1, 1, 1, 1, True)]
    assert [r for r in rows if r[0] == 1] == [(1, 1, 1, 2, 2, False), (1, 2, 1, 2, 1, False), (1, 2, 2, 2, 2, True)]


def test_pages_travel_once_and_without_their_text(spark, sf_dir):
    plan = registry.QUERIES["progressive_index"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_a_document_of_many_batches(spark):
    """Older generations, pages that come twice and null texts, in batches of three rows."""
    pages = [(d, g, p, 8, None if p == 5 else "cat C­at\nconcat" if g == 2 else "cat") for d in range(3) for g in (1, 2) for p in range(8) for _ in range(2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = page_index.indexed(spark.createDataFrame(pages, PAGE).coalesce(1), "cat").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(d, 2, 8, 8, 21, True) for d in range(3)]
    assert {r["matches"] for r in page_index.indexed(spark.createDataFrame(pages, PAGE), "").collect()} == {0}


# --- pages read lazily -------------------------------------------------------


@pytest.fixture
def store(tmp_path):
    texts = [None if k == 13 else "\n".join(f"line {i} of {k} " + "xyz" * (k % 5) for i in range(1 + 7 * k % 90)) for k in range(200)]
    ids = [None if k in (50, 51) else k for k in range(200)]
    for part in range(2):
        rows = slice(100 * part, 100 * part + 100)
        pq.write_table(pa.table({"extra": pa.array(ids[rows], pa.int64()), "text": texts[rows], "doc_id": pa.array(ids[rows], pa.int64())}), tmp_path / f"part-{part}.parquet", row_group_size=10)
    pages = [(i, p, t.split("\n")[20 * p : 20 * p + 20]) for i, t in zip(ids, texts, strict=True) if t is not None for p in range(-(-len(t.split("\n")) // 20))]
    return str(tmp_path), pages


@pytest.mark.parametrize(
    ("condition", "keep"),
    [
        ("true", lambda d, p: True), ("doc_id = 7", lambda d, p: d == 7), ("doc_id in (3, 150, 999) and page_index = 1", lambda d, p: d in (3, 150) and p == 1), ("doc_id > 180 and page_index <= 1", lambda d, p: d is not None and d > 180 and p <= 1),
        ("doc_id is null", lambda d, p: d is None), ("doc_id is not null and page_index >= 2 and page_index < 4", lambda d, p: d is not None and 2 <= p < 4), ("doc_id = 7 and doc_id = 8", lambda d, p: False), ("doc_id % 2 = 0 and size(lines) = 20", lambda d, p: d is not None and d % 2 == 0),
    ],
)
def test_lazy_pages(spark, store, condition, keep):
    path, pages = store
    lazy_pages.register(spark)
    df = spark.read.format("document_pages").load(path).filter(condition)
    want = sorted((str(d), p, ls) for d, p, ls in pages if keep(d, p) and ("20" not in condition or len(ls) == 20))
    for _ in range(2):  # a read changes nothing for the next
        assert sorted((str(r["doc_id"]), r["page_index"], r["lines"]) for r in df.collect()) == want


def test_filters_reach_the_reader(spark, store):
    path, _ = store
    lazy_pages.register(spark)
    df = spark.read.format("document_pages").load(path).filter("doc_id = 7 and page_index in (0, 2)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    size = {}
    for name, filters in (("all", []), ("range", [lazy_pages.GreaterThanOrEqual(("doc_id",), 170)]), ("one", [EqualTo(("doc_id",), 7)]), ("two", [In(("doc_id",), (7, 150))])):
        reader = lazy_pages.PageReader(path)
        assert list(reader.pushFilters(filters)) == []
        size[name] = sum(g.size for g in reader.partitions())
    assert 0 < size["one"] < size["two"] < size["range"] < size["all"] / 3
    other = StringContains(("lines",), "x")
    assert list(lazy_pages.PageReader(path).pushFilters([other])) == [other]
