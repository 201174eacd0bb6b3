"""Block pairs: compare the rows of a group pairwise in tasks of bounded size.

A group of m rows is dealt to ``k = ceil(m / size)`` blocks by row hash; each
unordered pair of blocks is one task's work, so a row is copied k times and
never more than about ``2 * size`` rows meet in a task, however large the
group.  Tasks emit what they find, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, sizes: DataFrame, key: str, of: Column, size: int) -> DataFrame:
    """``rows`` times their block pairs: columns i <= j, and side (0: of block i, 1: of block j).

    ``sizes`` has (key, n).  Within (key, i, j), side 0 meets side 1; where i = j all rows have side 0.
    """
    with_n = rows.join(sizes, key)
    k = F.ceil(F.col("n") / size).cast("int")
    block = F.pmod(F.xxhash64(of), k.cast("long")).cast("int")
    out = with_n.withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), k - 1)))
    return out.withColumns({"i": F.least("_b", "_o"), "j": F.greatest("_b", "_o"), "side": (F.col("_b") > F.col("_o")).cast("int")}).drop("_b", "_o", "n")


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that come sorted by ``keys``: (rows, bounds), group g being bounds[g] to bounds[g + 1].

    A group that goes on in the next batch is held back; what is held is one batch and one group.
    """
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in keys):
            held.append(batch)  # one group so far
            continue
        t = pa.Table.from_batches([*held, batch]).combine_chunks()
        bounds = cut(t)
        if len(bounds) > 2:
            yield t.slice(0, bounds[-2]), bounds[:-1]
        held = t.slice(bounds[-2]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, cut(t)
