"""The pipeline's stages against what each operator says of the same rows."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import near_dedup
from vellum.llm.scratch import Scratch, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "test")
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.write(stage(spark, docs, SF), name)
        kept[name] = (docs.collect(), out.collect())
        if name != "packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        docs = out
    before, after = kept["near_dedup"]
    want = {r["doc_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect() if r["kept"]}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want)
    before, after = kept["secret_scan"]
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    changed = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == changed[r["doc_id"]] or "[SECRET]" in r["text"] for r in after) and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = kept["mixing"]
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3 and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = kept["packing"]
    used = defaultdict(int)
    for r in after:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048 and Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)


def test_odd_rows(spark):
    rng = random.Random(0)
    long = "qz " * 60_000 + "password=abcdef123 " + "Ab3" * 20_000
    rows = [(i, " ".join(rng.choice(["the", "on", "er"]) for _ in range(9)), "en", "s", 1, "k") for i in range(30)]
    rows += [(50, None, None, None, None, "k"), (51, "", "en", None, 0, "k"), (None, "x y", None, "t", 3, "k"), (None, "x y", None, "t", 3, None), (7, "twice", "en", "s", 5, "k"), (60, long, "en", "s", 1, "k"), (61, long, "en", "s", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string").withColumns({"score": F.lit(1), "h": F.lit("x")})
    scratch = Scratch(spark, "test")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, SF), name)
        out[name] = docs.collect()
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    ids = lambda name: Counter(r["doc_id"] for r in out[name])
    assert ids("toxicity") == Counter(r[0] for r in rows)  # nothing here is toxic
    kept = ids("near_dedup")
    assert kept[None] == 2 and kept[50] == kept[51] == 1 and kept[60] == 1 and 61 not in kept and kept[7] == 2
    assert ids("secret_scan") == kept
    found = {r["doc_id"]: r["text"] for r in out["secret_scan"]}
    assert found[60].startswith("qz qz") and "abcdef123" not in found[60] and found[50] is None and found[51] == ""
    mixed = ids("mixing")
    assert 50 not in mixed and 51 not in mixed and max(mixed.values()) <= 6 and set(mixed) <= set(kept)
    assert Counter(r["doc_id"] for r in out["packing"] if r["piece"] == 0) == mixed


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, SF), name)
    assert docs.count() == 0
