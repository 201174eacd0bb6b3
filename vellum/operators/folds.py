"""Folds over small groups that need their order: groups pass by sorted, many in a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def folded(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fold: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """What ``fold`` makes of each group's columns (lists, in ``order``); a group that a batch cuts waits for its rest. Keys must not be null."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of one group
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for k in keys:
                v = batch[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(new).tolist()]
            if held and any(held[0][k].iat[0] != batch[k].iat[0] for k in keys):
                yield done(pd.concat(held, ignore_index=True), [0, sum(map(len, held))])
                held = []
            if held and len(cuts) > 1:  # the group that went on ends here
                whole = pd.concat([*held, batch.iloc[: cuts[1]]], ignore_index=True)
                yield done(whole, [0, len(whole)])
                cuts, held = cuts[1:], []
            if len(cuts) > 1:
                yield done(batch.iloc[cuts[0] :], [c - cuts[0] for c in cuts])
            held.append(batch.iloc[cuts[-1] :])
        if held:
            yield done(pd.concat(held, ignore_index=True), [0, sum(map(len, held))])

    def done(batch: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        cols = {c: batch[c].tolist() for c in batch.columns}
        return pd.DataFrame([r for a, b in zip(cuts, cuts[1:], strict=False) for r in fold({c: v[a:b] for c, v in cols.items()})], columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
