"""Runs of letters without a shuffle, readings whose sums don't depend on how events are dealt, floods without broadcasts."""

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import raster
from vellum.plans import registry


def plan(df):
    return df._jdf.queryExecution().toString()


def test_letter_runs_are_cut_without_a_shuffle(spark):
    texts = {"": [], "12 -": [(None, "12 -")], "1é2a b,É": [("accented", "1é2"), ("latin", "a b,"), ("accented", "É")], "ab": [("latin", "ab")], " 😀x😀à": [("latin", " 😀x😀"), ("accented", "à")], "a\rà": [("latin", "a\r"), ("accented", "à")]}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: [(x["kind"], x["text"]) for x in r["runs"]] for r in rows.select("text", T.letter_runs(F.col("text")).alias("runs")).collect()}
    assert got == texts


def test_script_segments_shuffle_nothing(spark, sf_dir):
    assert "Exchange" not in plan(registry.QUERIES["script_segments"](spark, sf_dir))


def test_best_language_is_the_same_however_events_are_dealt(spark, tmp_path):
    values = [(1, 40.1), (2, 60.2), (3, 64.7), (11, 7.0), (12, 70.0), (13, 70.0), (14, 1.0)]
    kinds = {11: "click", 12: "view", 13: "error", 14: "signup"}
    rows = [(k, kinds.get(k, "view"), v) for k, v in values]
    found = []
    for n, some in enumerate((rows, rows[::-1], rows[1:] + rows[:1], [rows[2], rows[0], rows[1], *rows[:2:-1]])):
        spark.createDataFrame(some, "event_id long, event_type string, value double").repartition(3).write.parquet(str(tmp_path / f"{n}/events.parquet"))
        found.append({r["page"]: r["lang"] for r in registry.QUERIES["best_language"](spark, str(tmp_path / str(n))).collect()})
    assert found == [{0: "view" if (40.1 + 60.2 + 64.7) / 3 >= 55 else None, 1: "view"}] * 4


def test_a_flood_broadcasts_nothing(spark):
    images = spark.range(5).select(F.col("id").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("x"))
    v = F.when((F.col("x") == 2) & (F.col("y") == F.col("image")), 20).otherwise(230)
    out = raster.cut_out(images.select("*", *(v.alias(c) for c in "rgb")))
    assert "Broadcast" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(k, 2, k, 2, k, 1) for k in range(5)]
