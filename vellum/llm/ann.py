"""Operator 6: nearest neighbours by inner product, cross-polytope tables and exact reranking.

Bit-equal vectors form a class of which the smallest ids are kept; classes are
indexed.  Each table rotates by fast Hadamard rounds and files a class under the
signed axis nearest to its direction; a query probes its nearest axes in each of
``TABLES`` tables.  Norms don't enter the codes: they would only bring a row and
the query further apart.  Candidates meet queries in blocks of bounded size, are
scored exactly in double precision, and a candidate that several tables give
is emitted by the first only.  A query that finds fewer than it could is
compared with all rows, in blocks.

How many axes to probe is measured: ``SAMPLE`` queries are compared with all
rows, and as many axes are probed as give ``RECALL`` of their true neighbours
(``PROBES`` at least), whatever dimension and norms are.  Where that would read
more rows than there are, all queries are compared with all rows instead.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part; a null vec_id takes no part; an empty table gives no
rows; fewer candidates than ``k`` are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.scratch import Scratch, partitions
from vellum.llm.vectors import axes, matrix, packed, power_of_two, width

K = 20
TABLES = 8
PROBES = 16
#: Recall that the probes must reach on so many queries.
RECALL, SAMPLE = 0.95, 128
CANDIDATES, QUERIES = 2048, 512
#: Copies of one vector are gathered in so many parts first.
SALTS = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(kind: str, dim: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(matrix(batch.column("vec").to_pylist(), kind))
            codes = np.concatenate([t * 2 * dim + axes(x, t, dim, probes) for t in range(TABLES)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vec"), lists], names=["rep", "vec", "codes"])

    return run


def _ranks(kind: str, dim: int, keep: int, reps: list[int], vecs: list[bytes]):
    """Best ``keep`` other rows of each sampled query in a partition, with the least place that a row's axis has among the query's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((len(vecs), dim))
        known = matrix(vecs, kind)
        a[:, : known.shape[1]] = known
        unit = _unit(a)
        place = np.empty((TABLES, len(a), 2 * dim), np.int32)
        for t in range(TABLES):
            np.put_along_axis(place[t], axes(unit, t, dim, 2 * dim), np.arange(2 * dim, dtype=np.int32)[None, :], axis=1)
        own = np.array(reps)
        best: list[list[np.ndarray]] = [[] for _ in vecs]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec").to_pylist(), kind)
            ids = batch.column("rep").to_numpy()
            at = np.stack(batch.column("codes").to_pandas().to_numpy()) - 2 * dim * np.arange(TABLES)
            score = a[:, : x.shape[1]] @ x.T
            score[own[:, None] == ids[None, :]] = -np.inf
            for q in range(len(a)):
                top = np.argpartition(-score[q], keep - 1)[:keep] if keep < len(ids) else np.arange(len(ids))
                least = np.min([place[t, q, at[top, t]] for t in range(TABLES)], axis=0)
                found = np.stack([score[q][top], ids[top].astype(np.float64), least], axis=1)
                found = np.concatenate([*best[q], found[found[:, 0] > -np.inf]])
                best[q] = [found[np.lexsort((found[:, 1], -found[:, 0]))[:keep]]]
        rows = [(q, *r) for q in range(len(a)) for f in best[q] for r in f]
        if rows:
            q, score, _, least = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score, pa.float64()), pa.array([int(p) for p in least], pa.int32())], names=["q", "score", "place"])

    return run


def _probes(filed: DataFrame, ask: DataFrame, kind: str, dim: int, k: int) -> int:
    """Axes to probe in each table for ``RECALL`` on a sample of the queries."""
    sample = ask.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    if not sample:
        return 1
    near = filed.mapInArrow(_ranks(kind, dim, k, [r["rep"] for r in sample], [bytes(r["vec"]) for r in sample]), "q int, score double, place int")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "place")
    counts = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("place").count().orderBy("place").collect()
    total, got = sum(r["count"] for r in counts), 0
    for r in counts:
        got += r["count"]
        if got >= RECALL * total:
            return r["place"] + 1
    return 1


def _score(kind: str, keep: int, dim: int, probes: int):
    """Best ``keep`` candidates of each query in one block; with codes, only those this table gives first."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, c = rows[rows["side"] == 1], rows[rows["side"] == 0]
        out = []
        if len(q) and len(c):
            x = matrix([*q["vec"], *c["vec"]], kind)
            a, b = x[: len(q)], x[len(q) :]
            code = int(rows["code"].iloc[0])
            table = 0 if code < 0 else code // (2 * dim)
            if table:
                unit = _unit(a)
                qc = np.stack([t * 2 * dim + axes(unit, t, dim, probes) for t in range(table)], axis=1)
                cc = np.stack(c["codes"].to_numpy())[:, :table]
            rough = a @ b.T
            ids, owners = c["rep"].to_numpy(), q["rep"].to_numpy()
            n = min(keep, len(c))
            for k in range(len(q)):
                least = np.partition(rough[k], len(c) - n)[len(c) - n]
                best = np.flatnonzero(rough[k] >= least - 1e-9 * max(1.0, abs(least)))  # ties and roundings stay in
                if table:
                    best = best[~(qc[k][None, :, :] == cc[best][:, :, None]).any(axis=(1, 2))]
                exact = (a[k] * b[best]).sum(axis=1)
                out += [(owners[k], i, s) for i, s in zip(ids[best], exact, strict=True)]
        return pd.DataFrame({"rep": np.array([o[0] for o in out], np.int64), "found": np.array([o[1] for o in out], np.int64), "score": np.array([o[2] for o in out], np.float64)})

    return run


def _blocks(cands: DataFrame, queries: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of one code, dealt to a grid of candidate blocks by query blocks."""
    count = lambda df, n: df.groupBy("code").agg(F.count("*").alias(n))
    sizes = scratch.write(count(cands, "nc").join(count(queries, "nq"), "code"), f"{name}-sizes")
    grid = sizes.select("code", F.ceil(F.col("nc") / CANDIDATES).cast("int").alias("nc"), F.ceil(F.col("nq") / QUERIES).cast("int").alias("nq"))
    block = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = cands.join(grid, "code").select("code", "rep", block("nc", 1).alias("i"), every("nq").alias("j"), F.lit(0).alias("side"))
    right = queries.join(grid, "code").select("code", "rep", every("nc").alias("i"), block("nq", 2).alias("j"), F.lit(1).alias("side"))
    return left.union(right)


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest other rows. ``is_query`` is over ``vec_id``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    kind = width(vectors)
    rows = scratch.write(packed(vectors), "packed")
    least = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    part = rows.groupBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(least(F.collect_list("vec_id")).alias("ids"))
    classes = part.groupBy("vec").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("rep", F.col("ids")[0])
    classes = scratch.write(classes, "classes")
    asked = scratch.write(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vec").join(classes.select("vec", "rep"), "vec").select("query_id", "rep"), "asked")
    total = rows.count()

    size = int(kind[-1])
    longest = classes.agg(F.max(F.length("vec"))).first()[0]
    dim = power_of_two((longest or size) // size)
    shape = "rep long, vec binary, codes array<int>"
    filed = scratch.write(classes.select("rep", "vec").mapInArrow(_codes(kind, dim, 1), shape), "filed")
    asking = classes.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vec")
    most = max(1, 2 * dim // TABLES)  # so many read as many rows as there are
    needed = _probes(filed, asking, kind, dim, k)
    probes = max(needed, min(PROBES, most))
    ask = scratch.write(asking.mapInArrow(_codes(kind, dim, min(probes, most)), shape), "ask")

    def search(cands: DataFrame, queries: DataFrame, name: str) -> DataFrame:
        dealt = _blocks(cands, queries, scratch, name)
        both = filed.select("rep", "vec", "codes", F.lit(0).alias("side")).union(ask.select("rep", "vec", F.lit(None).cast("array<int>").alias("codes"), F.lit(1).alias("side")))
        full = dealt.join(both, ["rep", "side"]).repartition(partitions(spark), "code", "i", "j")
        found = full.groupBy("code", "i", "j").applyInPandas(_score(kind, k + 1, dim, probes), "rep long, found long, score double")
        best = Window.partitionBy("rep").orderBy(F.desc("score"), "found")
        return scratch.write(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"), name)

    coded = lambda df: df.select("rep", F.explode("codes").alias("code"))
    one = lambda df: df.select("rep", F.lit(-1).alias("code"))
    found = search(coded(filed), coded(ask), "found") if probes <= most else search(one(filed), one(ask), "found")

    def ranked(found: DataFrame) -> DataFrame:
        ids = found.join(classes.select(F.col("rep").alias("found"), "ids"), "found").select("rep", "score", F.explode("ids").alias("vec_id"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        # k + 1 of a class's list reach, as a query drops no other row than itself
        few = ids.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1).drop("r")
        own = asked.join(few, "rep").filter("query_id <> vec_id")
        return own.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)

    first = scratch.write(ranked(found), "ranked")
    full = min(k, max(0, total - 1))
    short = asked.join(first.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < full)
    short = scratch.write(short.select("query_id", "rep"), "short")
    if short.isEmpty():
        done = first
    else:
        again = ranked(search(one(filed), one(short.select("rep").distinct()), "rest")).join(short.select("query_id"), "query_id", "left_semi")
        done = first.join(short.select("query_id"), "query_id", "left_anti").unionByName(again)
    return done.select("query_id", "rank", "vec_id", "score")
