"""Connected components of an edge table, without collecting it.

Alternating star steps: each large star hooks a node's larger neighbours to
its smallest one, each small star hooks the smaller side; paths shorten until
every node points at its component's smallest.  Both steps are a partial
aggregate and an equi-join; a hub is split by adaptive skew handling, as no
step needs a node's neighbours together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.scratch import Scratch


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for each node of ``edges(a, b)`` that is not its component's smallest."""
    spark = edges.sparkSession
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    sign = _sign(now)
    while sign[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-m")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large, f"{name}-l")
        least2 = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-s")
        joined = large.join(least2, "a")
        step = scratch.write(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least2.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), name)
        after = _sign(step)
        scratch.drop(now, least, large, least2)
        now, done = step, after == sign
        sign = after
        if done:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
