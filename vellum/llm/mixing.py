"""Operator 8: mix sources to target weights by pivotal dependent rounding.

Each document of a source gets the copy number ``target / source_size``: a
whole part and a fraction.  Fractions are rounded by the pivotal method with
sizes as masses: two documents' fractions meet, words move from one to the
other until one fraction is 0 or 1, with the two directions drawn so that each
document's expected copies stay; the sum of ``fraction * size`` never changes.
Groups of documents of a source are reduced in parallel, each leaves at most
one fractional residual, and residuals are reduced again, level by level,
until each source has one, which goes to the nearer integer.  The words taken
then miss the target by at most half of that one document.

A document that is large beside the rest of its group meets the pool of all
smaller ones at once: they share one fraction, so a common shift of it takes
up the words and keeps every expectation.  Otherwise one long document would
be left over as the residual.

Rows that are equal in key, source and text are counted before they travel: n of
them with fraction f are n * f copies, of which the whole ones are dealt at once
and one fraction is left to be rounded.  So no group grows with repeated rows.

Draws come from a hash of the row and the level, so reruns agree; groups are hashed
(source, row), so a source with a third of all rows is spread like any other.

Defined results: null text has size 0; documents of size 0 are taken 0 times;
a null source is a source (last); repeated rows are documents of their own, and
so are rows that share a key; a null key is a key; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.scratch import Scratch, partitions

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents or residuals that one reduction takes at most, about.
GROUP = 4096
#: Sources whose totals are broadcast; more are joined.
SOURCES = 100_000
#: Equal rows that one row is turned back to in one task.
AGAIN = 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Water filling: sources in code point order (null last) share all sizes by weight, none above ``most`` times its own."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = float(sum(size.values())), set(size), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not over:
            out.update((s, left * weight[s] / total) for s in open_)
            break
        for s in over:
            out[s] = float(most * size[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def pivot(fraction: np.ndarray, mass: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round fractions in the given order; returns them and the index still fractional (-1: none)."""
    p = fraction.astype(float).copy()
    draws = np.random.default_rng(seed).random(len(p))
    a = -1
    for b in range(len(p)):
        if not 0 < p[b] < 1:
            continue
        if a < 0:
            a = b
            continue
        # words that can move from b to a, and from a to b
        to_a = min((1 - p[a]) * mass[a], p[b] * mass[b])
        to_b = min(p[a] * mass[a], (1 - p[b]) * mass[b])
        move = to_a if draws[b] * (to_a + to_b) < to_b else -to_b
        for i, v in ((a, p[a] + move / mass[a]), (b, p[b] - move / mass[b])):
            p[i] = 0.0 if v < 1e-12 else 1.0 if v > 1 - 1e-12 else v
        a = a if 0 < p[a] < 1 else b if 0 < p[b] < 1 else -1
    return p, a


def settle_large(fraction: float, mass: np.ndarray, draws: np.ndarray, share: float = 1 / 256) -> tuple[np.ndarray, float]:
    """Decide leading documents (``mass`` descends, one common fraction) against the pool of those after them.

    Stops at the first that is below ``share`` of the pool or that the pool
    cannot take up.  Returns what was decided and the pool's new fraction.
    """
    out, p, rest = [], fraction, float(mass.sum())
    for m, u in zip(mass, draws, strict=True):
        rest -= m
        if m < share * rest or rest <= 0:
            break
        up, down = p - (1 - p) * m / rest, p + p * m / rest  # the pool's fraction after taking it, or leaving it
        if up < 0 or down > 1:
            break
        out.append(float(u < p))
        p = up if u < p else down
    return np.array(out), p


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def _reduce(level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "row"], ascending=[False, True], kind="stable", ignore_index=True)
        seed, mass, p = _seed(level, *(str(k) for k in key)), rows["size"].to_numpy(), rows["fraction"].to_numpy(dtype=float).copy()
        if not level:  # documents of one source that occur once share one fraction
            live = np.flatnonzero((mass > 0) & (rows["n"].to_numpy() == 1))
            if len(live) and p[live[0]] > 0:
                done, share = settle_large(p[live[0]], mass[live], np.random.default_rng(seed + 1).random(len(live)))
                p[live] = share
                p[live[: len(done)]] = done
        p, left = pivot(p, mass, seed)
        rows["fraction"] = p
        rows["residual"] = np.arange(len(rows)) == left
        return rows

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """Rows (key, source, size, source_size, target, copies, taken) for each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = scratch.write(
        docs.select(F.col(key).alias("key"), F.col("source"), F.xxhash64(F.col("text")).alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "sizes",
    )
    totals = [(r["source"], r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]  # one row a source
    target = targets([(s, n) for s, n, _ in totals], weights, most)
    schema = "source string, source_size long, target double, groups int"
    dim = spark.createDataFrame([(s, n, target[s], -(-rows // group)) for s, n, rows in totals] or [], schema)
    dim = F.broadcast(dim) if len(totals) <= SOURCES else dim  # one row a source
    same = sized.groupBy("key", "source", "h", "size").agg(F.count("*").alias("n"))
    rows = (
        same.withColumnRenamed("source", "own").join(dim, F.col("own").eqNullSafe(F.col("source"))).drop("own")
        .withColumn("copies", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("copies") + F.lit(1e-12)).cast("long"))
        .withColumn("part", F.greatest(F.lit(0.0), F.col("copies") - F.col("whole")) * F.col("n"))
        .withColumn("more", F.floor(F.col("part") + F.lit(1e-12)).cast("long"))
        .withColumn("fraction", F.greatest(F.lit(0.0), F.col("part") - F.col("more")))
        .withColumn("row", F.xxhash64("key", "h", F.lit(8)))
        .withColumn("g", F.pmod("row", F.col("groups")).cast("int"))
        .select("key", "source", "size", "source_size", "target", "whole", "n", "more", "fraction", "row", "g")
    )
    out = "key {k}, source string, size long, source_size long, target double, whole long, n long, more long, fraction double, row long, g int, residual boolean".format(k=docs.schema[key].dataType.simpleString())
    first = scratch.write(rows.groupBy("source", "g").applyInPandas(_reduce(0), out), "level0")
    open_ = first.filter("residual").select("source", F.col("g").alias("id"), "size", "fraction", "row")
    settled = None
    n, level = max([1, *(-(-rows // group) for _, _, rows in totals)]), 0
    while n > 1:  # residuals of residuals: a factor of ``group`` fewer each time
        n, level = -(-n // group), level + 1
        step = open_.withColumn("g", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(n)).cast("int"))
        step = scratch.write(step.groupBy("source", "g").applyInPandas(_reduce(level), "source string, id int, size long, fraction double, row long, g int, residual boolean"), f"level{level}")
        done = step.filter("not residual").select("source", "id", "fraction")
        settled = done if settled is None else settled.union(done)
        open_ = step.filter("residual").select("source", "id", "size", "fraction", "row")
    last = open_.select("source", "id", F.when(F.col("fraction") >= 0.5, 1.0).otherwise(0.0).alias("fraction"))
    settled = (last if settled is None else settled.union(last)).select(F.col("source").alias("s"), "id", F.col("fraction").alias("rounded"))
    # one residual a group: this side is smaller than the documents by the factor ``group``
    res = first.filter("residual").join(settled, F.col("source").eqNullSafe(F.col("s")) & (F.col("g") == F.col("id"))).withColumn("fraction", F.col("rounded"))
    cols = ["key", "source", "size", "source_size", "target", "whole", "n", "more", "fraction"]
    both = first.filter("not residual").select(cols).union(res.select(cols))
    both = both.withColumn("more", F.col("more") + F.col("fraction").cast("long"))
    # one row again for each that was counted; large counts are dealt to many tasks first
    step = F.lit(AGAIN).cast("long")
    often = both.filter(F.col("n") > step).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step))).repartition(partitions(spark), "key", "first")
    each = both.filter(F.col("n") <= step).withColumn("first", F.lit(0).cast("long")).union(often)
    each = each.withColumn("at", F.explode(F.sequence("first", F.least(F.col("first") + step, F.col("n")) - 1)))
    copies = F.col("whole") + (F.col("at") < F.col("more")).cast("long")
    return each.select(F.col("key").alias(key), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
