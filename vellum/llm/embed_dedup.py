"""Operator 9: embedding near-dedup by cross-polytope hashing.

Bit-equal vectors form a class; classes are compared.  Each of ``TABLES``
tables joins ``HASHES`` cross-polytope hashes (nearest signed axis after a
fast Hadamard pseudo-rotation); multiprobe adds, for each hash, the code with
that hash's second axis.  At cosine 0.95 in 64 dimensions one table misses a
pair with probability about 0.45, all tables with about one in ten million.
Tables of more rows join more hashes, so that buckets don't grow with the input.

Candidates are verified in double precision, in three steps:

1. Stars.  In each bucket every member meets one leader only, the one whose
   buckets hold most members; linked ones form star components.
2. Inside.  Rows of one star component are compared with each other once, in
   blocks: a pair that shares many buckets is visited once all the same.
3. Across.  In buckets that hold several components, members outside the main
   one are compared with those of others, a pair at its first shared bucket.

Tasks emit counts of links by row and the edges of local components, never
pairs: a group of m near copies gives O(m) rows for each pair of blocks.

Defined results: vectors that are null, zero or hold null or non-finite
components have no links and are their own component; a null vec_id links with
nothing, its component is null and it is kept; rows that repeat a vec_id are
vectors of their own when links are counted and one node of the graph; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.blocks import dealt, runs
from vellum.llm.graph import components
from vellum.llm.scratch import Scratch, partitions
from vellum.llm.vectors import axes, matrix, packed, power_of_two, valid, width

COSINE = 0.95
TABLES = 20
HASHES = 3
#: Rows of one bucket that hold no near copies, about, before a table joins one more hash; tables added with it.
OCCUPANCY, MORE_TABLES = 500, 10
#: Rows of a block: of one component, and of a bucket's other components.
INSIDE, ACROSS = 1024, 1024


def shape(n: int, dim: int) -> tuple[int, int]:
    """(tables, hashes) for n classes."""
    hashes = max(HASHES, math.ceil(math.log(max(1, n / OCCUPANCY), 2 * dim)))
    return TABLES + MORE_TABLES * (hashes - HASHES), hashes


def _unit(rows: list[bytes], kind: str) -> np.ndarray:
    x = matrix(rows, kind)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(kind: str, dim: int, tables: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("vec").to_pylist(), kind)
            out = []
            for t in range(tables):
                top = [axes(x, t * hashes + h, dim, 2) for h in range(hashes)]
                for probe in range(hashes + 1):  # 0: all nearest; h + 1: the second axis of hash h
                    code = np.full(len(x), t, np.int64)
                    for h in range(hashes):
                        code = code * (2 * dim) + top[h][:, int(probe == h + 1)]
                    out.append(code)
            codes = np.stack(out, axis=1)
            flat = pa.array(codes.ravel())
            offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vec"), batch.column("n"), pa.ListArray.from_arrays(offsets, flat)], names=["rep", "vec", "n", "codes"])

    return run


def _local_roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component in a symmetric link matrix."""
    root = ids.copy()
    while True:
        least = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(root, least)
        if (new == root).all():
            return root
        root = new


def _stars(kind: str):
    """Links of members (side 1) to the leader (side 0) that comes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # the last batch's last leader
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("vec").to_pylist(), kind)
            ids, side = batch.column("rep").to_numpy(), batch.column("side").to_numpy()
            wide = max(x.shape[1], 0 if lead is None else lead.shape[1])
            x, lead = (np.pad(y, ((0, 0), (0, wide - y.shape[1]))) for y in (x, x[:1] if lead is None else lead))
            both = np.concatenate([lead, x])
            # each row's leader: the last row of side 0 so far
            at = np.maximum.accumulate(np.where(side == 0, np.arange(len(ids)), -1)) + 1
            hit = (side == 1) & (np.einsum("ij,ij->i", x, both[at]) >= COSINE)
            lead = both[at[-1:]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(batch.column("leader").to_numpy()[hit])], names=["a", "b"])

    return run


def _links(i: np.ndarray, j: np.ndarray, ids: np.ndarray, mult: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, links, smallest row of its local component) of linked places i, j."""
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, mult[j])
    np.add.at(links, j, mult[i])
    some = np.flatnonzero(links)
    small = np.zeros((len(some), len(some)), bool)
    at_i, at_j = np.searchsorted(some, i), np.searchsorted(some, j)
    small[at_i, at_j] = small[at_j, at_i] = True
    return ids[some], links[some], _local_roots(small, ids[some])


def _inside(kind: str):
    """Links of a component's block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, ("comp", "i", "j")):
            x = _unit(rows.column("vec").to_pylist(), kind)
            ids, mult, side, i, j = (rows.column(c).to_numpy() for c in ("rep", "n", "side", "i", "j"))
            out = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                left, right = (np.arange(s, e),) * 2 if i[s] == j[s] else (s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1))
                hit = x[left] @ x[right].T >= COSINE
                if i[s] == j[s]:
                    np.fill_diagonal(hit, False)
                else:
                    out.append((ids[right], hit.T @ mult[left], ids[right]))
                out.append((ids[left], hit @ mult[right], ids[left]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["rep", "links", "root"])

    return run


def _across(kind: str, tables: int, hashes: int):
    """Links between components of one bucket's block pair: side 0 holds members outside its main component, side 1 any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, ("code", "i", "j")):
            x = _unit(rows.column("vec").to_pylist(), kind)
            ids, mult, key, side, comp, active = (rows.column(c).to_numpy() for c in ("rep", "n", "code", "side", "comp", "active"))
            codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), tables, hashes + 1)
            out = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                left, right = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                hit = (x[left] @ x[right].T >= COSINE) & (comp[left][:, None] != comp[right][None, :])
                hit &= ~(active[right][None, :] & (ids[right][None, :] <= ids[left][:, None]))  # two active ones meet twice
                i, j = np.nonzero(hit)
                i, j = left[i], right[j]
                # a pair counts at the first code it shares
                first = np.ones(len(i), bool)
                for at in range(0, len(i), 4096):
                    p, q = codes[i[at : at + 4096]], codes[j[at : at + 4096]]
                    shared = (p[:, :, :, None] == q[:, :, None, :]).any(axis=3)
                    first[at : at + 4096] = np.where(shared, p, np.iinfo(np.int64).max).reshape(len(p), -1).min(axis=1) == key[s]
                if first.any():
                    # one place for each row: a row may stand on both sides
                    names, place = np.unique(ids[s:e], return_inverse=True)
                    weight = np.zeros(len(names), np.int64)
                    weight[place] = mult[s:e]
                    out.append(_links(place[i[first] - s], place[j[first] - s], names, weight))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rep", "links", "root"])

    return run


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = width(vectors)
    rows = scratch.write(packed(vectors), "packed")
    classes = scratch.write(rows.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    longest = classes.agg(F.max(F.length("vec"))).first()[0] or 8
    dim = power_of_two(longest // int(kind[-1]))
    tables, hashes = shape(classes.count(), dim)
    coded = scratch.write(classes.select("rep", "vec", "n").mapInArrow(_codes(kind, dim, tables, hashes), "rep long, vec binary, n long, codes array<long>"), "codes")
    # multiprobe codes of one row may repeat one another
    keys = coded.select("rep", F.explode(F.array_distinct("codes")).alias("code"))
    sizes = keys.groupBy("code").agg(F.count("*").alias("m")).filter("m > 1")
    members = scratch.write(keys.join(sizes, "code"), "members")
    degree = members.groupBy("rep").agg(F.sum("m").alias("degree"))
    ranked = scratch.write(members.select("code", "rep").join(degree, "rep"), "ranked")
    led = ranked.groupBy("code").agg(F.max_by("rep", F.struct("degree", F.xxhash64("rep"))).alias("leader"))
    own = scratch.write(ranked.select("code", "rep").join(led, "code"), "led")

    # 1
    pairs = scratch.write(own.filter("rep <> leader").select("leader", "rep").distinct(), "pairs")
    blocks = scratch.write(pairs.groupBy("leader").agg(F.ceil(F.count("*") / INSIDE).cast("int").alias("blocks")), "blocks")
    follow = pairs.join(blocks, "leader").select("leader", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int").alias("block"), F.lit(1).alias("side"), "rep")
    lead = blocks.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("leader").alias("rep"))
    met = lead.union(follow).join(coded.select("rep", "vec"), "rep").repartition(partitions(spark), "leader", "block").sortWithinPartitions("leader", "block", "side")
    stars = scratch.write(met.mapInArrow(_stars(kind), "a long, b long"), "stars")
    by = scratch.write(components(stars, scratch, "stars"), "by")

    # 2
    comp = scratch.write(by.union(by.select("component", "component").distinct()).toDF("rep", "comp"), "comp")
    held = dealt(comp, comp.groupBy("comp").agg(F.count("*").alias("n")), "comp", F.col("rep"), INSIDE)
    full = held.join(coded.select("rep", "vec", "n"), "rep").repartition(partitions(spark), "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    inside = scratch.write(full.mapInArrow(_inside(kind), "rep long, links long, root long"), "inside")

    # 3
    own = scratch.write(own.select("code", "rep").join(comp, "rep", "left").select("code", "rep", F.coalesce("comp", "rep").alias("comp")), "own")
    mains = own.groupBy("code", "comp").agg(F.count("*").alias("m")).groupBy("code").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("m"), F.max("m").alias("most"))
    mains = scratch.write(mains.filter("most < m").select("code", "main", F.ceil((F.col("m") - F.col("most")) / ACROSS).cast("int").alias("ka"), F.ceil(F.col("m") / ACROSS).cast("int").alias("k")), "mains")
    open_ = own.join(mains, "code").withColumn("active", F.col("comp") != F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ("code", "rep", "comp", "active")
    some = open_.filter("active").select(*cols, block("ka").alias("i"), every("k").alias("j"), F.lit(0).alias("side"))
    every_one = open_.select(*cols, every("ka").alias("i"), block("k").alias("j"), F.lit(1).alias("side"))
    full = some.union(every_one).join(coded, "rep").repartition(partitions(spark), "code", "i", "j").sortWithinPartitions("code", "i", "j")
    across = scratch.write(full.mapInArrow(_across(kind, tables, hashes), "rep long, links long, root long"), "across")

    found = inside.union(across)
    comps = components(across.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(stars), scratch)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("vec", "rep", "n").join(counts, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    named = scratch.write(named.select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    linked = rows.join(named, "vec").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    alone = ids.filter(F.col("vec_id").isNull() | ~valid(F.col("embedding")))
    return linked.union(alone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id"), F.lit(True)))
