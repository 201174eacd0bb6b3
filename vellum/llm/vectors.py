"""Shared by the vector operators: valid vectors, copy classes, cross-polytope codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(embedding: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vec = batch.column("embedding")
        wide = not pa.types.is_float32(vec.type.value_type)
        rows = [np.asarray(v.values, dtype="<f8" if wide else "<f4").tobytes() for v in vec]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.binary())], names=["vec_id", "vec"])


def packed(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the valid rows; vec holds the components as little-endian floats of the column's width."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).mapInArrow(_packed, "vec_id long, vec binary")


def width(vectors: DataFrame, column: str = "embedding") -> str:
    return "<f4" if vectors.schema[column].dataType.elementType.typeName() == "float" else "<f8"


def matrix(rows: list[bytes], kind: str) -> np.ndarray:
    """Rows as float64; shorter vectors count as padded with zeros."""
    size = max(map(len, rows))
    if any(len(r) != size for r in rows):
        rows = [r.ljust(size, b"\0") for r in rows]
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: int, dim: int) -> np.ndarray:
    """Pseudo-random rotation: three rounds of random signs and a Hadamard transform, in ``dim`` (a power of two) dimensions."""
    y = np.zeros((len(x), dim))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], dim))
    return y


def axes(x: np.ndarray, seed: int, dim: int, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of each rotated row, nearest first: 0..dim-1 positive, dim.. negative."""
    y = rotated(x, seed, dim)
    both = np.concatenate([y, -y], axis=1)
    top = np.argpartition(-both, count - 1, axis=1)[:, :count] if count < both.shape[1] else np.tile(np.arange(both.shape[1]), (len(x), 1))
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)


def power_of_two(n: int) -> int:
    return 1 << max(1, (n - 1).bit_length())


