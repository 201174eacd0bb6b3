"""Operator 5: best-fit packing by a grouping genetic algorithm on islands.

A document's ids are cut only when they exceed one sequence: whole sequences
from its end, the remainder first.  Pieces that fill a sequence are done.  The
others are dealt to shards by a hash, about ``SHARD`` pieces each.  For each
shard several islands evolve a population of packings in tasks of their own:

* a packing is a set of bins (groups), scored by the mean squared fill, which
  rewards full bins over even ones;
* crossover injects well-filled bins of one parent into the other, removes the
  other's bins that hold a piece now placed twice, and best-fits the displaced
  pieces again;
* mutation breaks the emptiest bins and some others, rebuilds those that can
  be filled from their pieces (sums that can be reached), best-fits the rest;
* evolution stops at a lower bound of the number of bins: ordinary documents
  are short beside a sequence, and best fit alone is often there already;
* after an epoch each island sends its elite packing to the next island of the
  ring, where it joins the next epoch's population.

The best packing of a shard keeps its well-filled bins; pieces of the other
bins are pooled over all shards and packed once more in fewer shards, so that
dealing costs no more than a bin a final shard.

Only lengths travel; ids are turned to a checksum where they are made.  Every
group has a bounded size whatever the data, as shards are dealt by row hash.

Defined results: null text is empty (one piece, the end id); a null doc_id is
an id like any other; repeated rows and ids are pieces of their own; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.scratch import Scratch
from vellum.llm.tokens import SpaceEncoder, encoder

CAPACITY = 2048
SHARD = 2000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 24
#: An epoch ends after so many generations without a better packing.
PATIENCE = 6
#: Bins of the first round at least so full stay.
KEEP_FILL = 0.995
#: A mutation rebuilds bins at least so full, from pieces in an order shaken by so many places.
FULL, SHAKE = 0.999, 8
END_ID = 0

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
Bins = list[list[int]]


def _cut(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SpaceEncoder, path)
        for batch in batches:
            cols: list[list[int]] = [[] for _ in range(5)]
            texts = (t.as_py() for t in batch.column("text").cast(pa.binary()))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_many(texts), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for c, v in zip(cols, (doc, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])), strict=True):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def load(b: list[int], size: Sequence[int]) -> int:
    return sum([size[x] for x in b])


def best_fit(items: list[int], size: Sequence[int], bins: Bins, capacity: int) -> Bins:
    """Put ``items``, longest first, each where it leaves the least room; opens bins as needed."""
    room = sorted([(capacity - load(b, size), i) for i, b in enumerate(bins)])
    bins = list(bins)
    owned = set()
    for x in sorted(items, key=lambda i: -size[i]):
        n = size[x]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, i = room.pop(at)
            if i not in owned:
                bins[i] = list(bins[i])
                owned.add(i)
            bins[i].append(x)
        else:
            left, i = capacity, len(bins)
            bins.append([x])
            owned.add(i)
        insort(room, (left - n, i))
    return bins


def fitness(bins: Bins, size: Sequence[int], capacity: int) -> float:
    return sum([(load(b, size) / capacity) ** 2 for b in bins]) / len(bins)


def crossover(a: Bins, b: Bins, size: Sequence[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Whole well-filled bins of ``a`` injected into ``b``."""
    fill = np.array([load(g, size) for g in a])
    full = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    injected = [a[i] for i in rng.permutation(full)[: max(1, len(full) // 2)]]
    placed = {x for g in injected for x in g}
    kept, displaced = [], []
    for g in b:
        if placed.isdisjoint(g):
            kept.append(g)
        else:
            displaced += [x for x in g if x not in placed]
    return best_fit(displaced, size, injected + kept, capacity)


def fullest(items: list[int], size: Sequence[int], room: int) -> list[int]:
    """Those of ``items`` that fill ``room`` best: sums that can be reached are the bits of one integer."""
    room = int(room)
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for x in items:
        if size[x] <= room:
            steps.append((x, reach))
            reach = (reach | reach << int(size[x])) & mask
            if reach >> room & 1:
                break
    total, out = reach.bit_length() - 1, []
    for x, before in reversed(steps):
        if not before >> total & 1:
            out.append(x)
            total -= size[x]
    return out


def mutate(a: Bins, size: Sequence[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Break the emptiest bins and some full ones; rebuild as many of them filled as well as their pieces can, best-fit the rest."""
    order = np.argsort([load(g, size) for g in a])
    broken = set(order[: max(2, len(a) // 20)].tolist()) | set(rng.integers(0, len(a), max(2, len(a) // 10)).tolist())
    loose = sorted([x for i in broken for x in a[i]], key=lambda x: -size[x])
    built = []
    while loose:
        first, rest = loose[0], loose[1:]
        shaken = [rest[i] for i in np.argsort(np.arange(len(rest)) + rng.normal(0, SHAKE, len(rest)))]
        some = {first, *fullest(shaken, size, capacity - size[first])}
        if load(list(some), size) < FULL * capacity:
            break
        built.append(sorted(some))
        loose = [x for x in loose if x not in some]
    return best_fit(loose, size, built + [g for i, g in enumerate(a) if i not in broken], capacity)


def least_bins(size: Sequence[int], capacity: int) -> int:
    """A lower bound: pieces over ``capacity - a`` stand alone, those over half take a bin each, the rest from ``a`` on share what is left."""
    v = np.sort(np.asarray(size, dtype=np.int64))
    if not len(v):
        return 0
    total = np.concatenate([[0], np.cumsum(v)])
    half = np.searchsorted(v, capacity // 2, "right")
    a = np.unique(np.concatenate([[0], v[v <= capacity // 2]]))
    alone, low = np.searchsorted(v, capacity - a, "right"), np.searchsorted(v, a, "left")
    room = (alone - half) * capacity - (total[alone] - total[half])
    more = -(-(total[half] - total[low] - room) // capacity)
    return int((len(v) - half + np.maximum(0, more)).max())


def evolve(size: Sequence[int], seeds: list[Bins], capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> Bins:
    """One epoch of one island: the fittest packing found."""
    rng = np.random.default_rng(seed)
    size = [int(n) for n in size]
    items = list(range(len(size)))
    least = least_bins(size, capacity)
    pool = [*seeds, best_fit(items, size, [], capacity)] if min(map(len, seeds), default=least + 1) > least else list(seeds)
    if min(map(len, pool)) <= least:
        return min(pool, key=lambda p: (len(p), -fitness(p, size, capacity)))
    while len(pool) < population:  # first items dealt at random, the rest best-fit
        some = rng.permutation(len(size))[: len(size) // 3].tolist()
        start: Bins = []
        for x in some:
            if start and load(start[-1], size) + size[x] <= capacity:
                start[-1].append(x)
            else:
                start.append([x])
        pool.append(best_fit(list(set(items) - set(some)), size, start, capacity))
    scored = sorted(((len(p), -fitness(p, size, capacity), i, p) for i, p in enumerate(pool)), key=lambda x: x[:3])[:population]
    n, since = len(pool), 0
    for _ in range(generations):
        if scored[0][0] <= least or since > PATIENCE:
            break
        before = scored[0][0]
        i, j = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        child = crossover(scored[i][3], scored[j][3], size, capacity, rng)
        other = mutate(scored[0][3], size, capacity, rng)
        for c in (child, other):
            n += 1
            scored.append((len(c), -fitness(c, size, capacity), n, c))
        scored = sorted(scored, key=lambda x: x[:3])[:population]
        since = 0 if scored[0][0] < before else since + 1
    return scored[0][3]


def _flat(bins: Bins, n: int) -> np.ndarray:
    """Bin number of each item."""
    out = np.empty(n, np.int32)
    for k, g in enumerate(bins):
        out[g] = k
    return out


def _grouped(of: list[int]) -> Bins:
    out: Bins = [[] for _ in range(max(of) + 1)]
    for x, k in enumerate(of):
        out[k].append(x)
    return out


ISLAND_SCHEMA = "shard long, island int, length array<int>, item array<long>, elites array<array<int>>"


def _epoch(number: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elites = []
            for shard, island, size, known in zip(*(batch.column(c).to_pylist() for c in ("shard", "island", "length", "elites")), strict=True):
                best = evolve(size, [_grouped(e) for e in known], capacity, (shard * 1009 + island) * 31 + number)
                elites.append([_flat(best, len(size)).tolist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "island", "length", "item")), pa.array(elites, pa.list_(pa.list_(pa.int32())))], names=["shard", "island", "length", "item", "elites"])

    return run


def _finish(capacity: int):
    """Place each piece by the shard's fewest bins (then the fittest island's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lengths, item, known in zip(*(batch.column(c).to_pylist() for c in ("shard", "length", "item", "elites")), strict=True):
                size = np.array(lengths, dtype=np.int64)
                best = min((_grouped(e) for e in known), key=lambda p: (len(p), -fitness(p, lengths, capacity)))
                bins, offset, fill = _flat(best, len(size)).astype(np.int64), np.empty(len(size), np.int64), np.empty(len(size))
                for g in best:
                    ends = np.cumsum(size[g])
                    offset[g], fill[g] = ends - size[g], ends[-1] / capacity
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(np.full(len(size), shard)), pa.array(bins), pa.array(offset), pa.array(fill)], names=["item", "shard", "bin", "offset", "fill"])

    return run


def _islands(pieces: DataFrame, scratch: Scratch, n: int, capacity: int, name: str) -> DataFrame:
    """(item, shard, bin, offset, fill) of ``pieces(item, length)``.

    ``n`` is their number.  A shard's list has about SHARD entries, whatever the number of pieces.
    """
    shards = max(1, -(-n // SHARD))
    spark = pieces.sparkSession
    lists = pieces.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(shards)), F.lit(shards)).cast("long")).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("x"))
    none = F.array().cast("array<array<int>>")
    state = lists.select("shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.col("x.length").alias("length"), F.col("x.item").alias("item"), none.alias("elites"))
    many = min(shards * ISLANDS, 8 * spark.sparkContext.defaultParallelism)
    for epoch in range(EPOCHS):
        # one task an island where there are enough: evolution costs CPU, its rows are few
        evolved = state.repartition(many, "shard", "island").mapInArrow(_epoch(epoch, capacity), ISLAND_SCHEMA)
        evolved = scratch.write(evolved, f"{name}-epoch{epoch}")
        own = evolved.select("shard", "island", "length", "item", "elites")
        guest = evolved.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("elites").alias("sent"))
        state = own.join(guest, ["shard", "island"]).select("shard", "island", "length", "item", F.concat("elites", "sent").alias("elites"))
    return state.filter("island = 0").mapInArrow(_finish(capacity), "item long, shard long, bin long, offset long, fill double")


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_cut(path, end_id, capacity), PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "pack")
    # numbered as they are written: a piece's number must be drawn once
    cut = scratch.write(cut_pieces(docs, path, capacity).withColumn("item", F.monotonically_increasing_id()), "items")
    some = cut.filter(F.col("length") < capacity).select("item", "length")
    n = some.count()
    first = scratch.write(_islands(some, scratch, n, capacity, "first"), "first")
    loose = scratch.write(some.join(first.filter(F.col("fill") < KEEP_FILL).select("item"), "item", "left_semi"), "loose")
    m = loose.count()
    second = _islands(loose, scratch, m, capacity, "second").select("item", F.col("shard") * 2 + 1, "bin", "offset")
    placed = first.filter(F.col("fill") >= KEEP_FILL).select("item", (F.col("shard") * 2).alias("shard"), "bin", "offset").union(second)
    placed = scratch.write(placed.select("item", (F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset"), "placed")
    out = cut.join(placed, "item", "left")
    full = -1 - F.col("item")  # a piece that is a sequence of its own
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", F.coalesce("sequence_id", full).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
