"""Operator 12: vector code compression with a vantage-point tree over each part's codebook.

Components become integers ``floor(256 * x)``; a vector is cut into ``PARTS``
equal parts and each part position has a codebook, fitted by a few rounds of
assigning parts to their nearest entries and moving entries to the floor of
their parts' mean.  The nearest entry is found in a vantage-point tree over
the codebook: a node holds an entry and splits the others by their distance
from it; a search follows the nearer side first and visits the other one
unless the triangle inequality rules it out.

Exactness: distances are square roots of integers, so radii are widened by
``SLACK`` relative to the numbers compared, sides whose bound equals the best
distance are visited (an entry there may tie with a lower index), and entries
are compared by their integer squared distances, ties to the lower index.

A round is one pass: each task sends sums and counts of its entries, at most
parts x entries rows of a fixed size, and the driver gets one codebook back,
a size that only the parameters set.  Sums by label are added before they are
shuffled and joined back, so no label meets in one task.

Defined results: rows whose vector is null or holds null or non-finite
components are dropped; zero and empty vectors are kept; vectors shorter than
the longest, or than a multiple of ``PARTS``, count as padded with zeros; rows
that share a vec_id, and rows without one (last), stand in the codebook in the
order of their components; fewer rows than entries make a smaller codebook;
null labels are one label; other columns are ignored; an empty table gives no
rows.  Components are exact up to 2**20 in magnitude; larger ones raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.scratch import Scratch

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries of a leaf, which are all compared.
LEAF = 6
#: What a bound may be off, relative to the distances it is made of: far above the rounding of two roots and a sum.
SLACK = 2.0**-40
MOST = SCALE << 20


@dataclass
class Node:
    """A vantage point, the entries not farther from it than ``inner`` and those not nearer than ``outer``; or a leaf."""

    entries: np.ndarray  # of the whole node in a leaf, of the vantage point else
    inner: float = 0.0
    outer: float = 0.0
    near: Node | None = None
    far: Node | None = None


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``y``, exact."""
    out = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - y[None, :, k]
        out += d * d
    return out


def tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """A vantage-point tree over the rows of ``book``."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries)
    between = _distances(book[entries], book[entries])
    spread = np.var(np.sqrt(between.astype(float)), axis=1)
    point = int(np.argmax(spread))  # the entry that tells the others apart best
    others = np.delete(entries, point)
    away = np.delete(between[point], point)
    order = np.argsort(away, kind="stable")
    half = len(order) // 2
    inner, outer = np.sqrt(away[order[half - 1]]), np.sqrt(away[order[half]])
    return Node(entries[[point]], float(inner * (1 + SLACK)), float(outer * (1 - SLACK)), tree(book, others[order[:half]]), tree(book, others[order[half:]]))


def search(root: Node, book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest row of ``book`` for each row of ``x``, and the number of distances computed."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    index = np.full(len(x), len(book), np.int64)
    asked = 0

    def verify(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        nonlocal asked
        asked += len(rows) * len(entries)
        d = _distances(x[rows], book[entries])
        least = d.min(axis=1)
        first = np.where(d == least[:, None], entries[None, :], len(book)).min(axis=1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < index[rows]))
        best[rows[better]], index[rows[better]] = least[better], first[better]
        return d

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        d = verify(rows, node.entries)
        if node.near is None:
            return
        away = np.sqrt(d[:, 0].astype(float))
        inside = away - node.inner <= node.outer - away
        visit(node.near, rows[inside])
        visit(node.far, rows[~inside])
        # the other side: no entry there is nearer than this
        bound = np.where(inside, node.outer - away, away - node.inner) - SLACK * (away + node.outer)
        reach = np.sqrt(best[rows].astype(float)) * (1 + SLACK)
        open_ = bound <= reach
        visit(node.far, rows[inside & open_])
        visit(node.near, rows[~inside & open_])

    visit(root, np.arange(len(x)))
    return index, best, asked


# --- passes ------------------------------------------------------------------


def _integers(wide: int):
    """Packs vectors as little-endian int64, padded to ``wide`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = batch.column("embedding")
            offsets = vec.offsets.to_numpy()
            flat = vec.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
            whole = np.floor(flat * SCALE)
            if len(whole) and np.abs(whole).max() > MOST:
                raise ValueError(f"a component above {MOST // SCALE} in magnitude")
            lengths = np.diff(offsets)
            out = np.zeros((len(vec), wide), "<i8")
            out[np.arange(wide)[None, :] < lengths[:, None]] = whole
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * wide), len(vec), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), rows], names=["vec_id", "label", "vec"])

    return run


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, components of a part) of packed vectors."""
    return np.frombuffer(b"".join(v.as_buffer() for v in column), "<i8").reshape(len(column), parts, -1)


def _sums(books: np.ndarray):
    """(part, entry, n, sums) of what a task's parts add to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, size = books.shape
        trees = [tree(b) for b in books]
        n, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), parts)
            for p in range(parts):
                at, _, _ = search(trees[p], books[p], x[:, p])
                np.add.at(n[p], at, 1)
                np.add.at(sums[p], at, x[:, p])
        p, e = np.nonzero(n)
        if len(p):
            held = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * size + 1, size, dtype=np.int32)), pa.array(sums[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), held], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray):
    """Each row's code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(books)
        trees = [tree(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), parts)
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                at, d, _ = search(trees[p], books[p], x[:, p])
                code[:, p] = at
                error += d
            shown = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([shown[i : i + 2 * parts] for i in range(0, len(shown), 2 * parts)]), pa.array(error)], names=["vec_id", "label", "code", "error"],
            )

    return run


def moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries at the floor of the mean of the parts that are nearest to them; unused ones stay."""
    size = books.shape[2]
    found = vectors.mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(size)]
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # parts x entries rows at most
        out[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(size)]
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", column: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of each kept row, codebooks as (part, entry, component)).

    ``entries`` is 256 at most: a code has two hex digits a part.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    finite = F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = vectors.filter(finite).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("embedding"))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    wide = parts * max(1, -(-longest // parts))
    shape = f"vec_id {vectors.schema[key].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}"
    packed = scratch.write(kept.mapInArrow(_integers(wide), f"{shape}, vec binary"), "integers")
    # ties of ids by components: a stated order, whatever the order of rows is
    numbers = kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("whole"))
    first = numbers.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()
    start = np.zeros((len(first), wide), np.int64)
    for row, r in zip(start, first, strict=True):
        row[: len(r["whole"])] = r["whole"]
    books = np.ascontiguousarray(start.reshape(len(first), parts, wide // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        books = moved(packed, books)
    return packed.mapInArrow(_codes(books), f"{shape}, code string, error long"), books


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def codes(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row."""
    coded, books = compress(vectors, **options)
    coded = Scratch(vectors.sparkSession, "coded").write(coded, "codes")
    by = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return coded.join(by, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
