"""Edit logs: upsert, replay, snapshots and their differences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.geometry import js_round

KEY = ("doc_id", "page_index", "kx", "ky")

#: States that a history keeps.
HISTORY = 60


def keyed(edits: DataFrame) -> DataFrame:
    return edits.withColumns({"kx": js_round(F.col("x")), "ky": js_round(F.col("baseline"))})


def upserted(edits: DataFrame) -> DataFrame:
    """Last edit at each place; a move made earlier is carried on unless the edit has its own.

    One aggregate by key: partial before the shuffle, no window.
    """
    seq = F.col("edit_seq")
    moved = F.coalesce("dx", "dy").isNotNull()
    agg = [F.max_by(c, seq).alias(c) for c in ("new_text",)]
    last_dx = F.max_by(F.col("dx"), F.when(moved, seq)).alias("dx")
    last_dy = F.max_by(F.col("dy"), F.when(moved, seq)).alias("dy")
    return keyed(edits).groupBy(*KEY).agg(F.max("edit_seq").alias("edit_seq"), *agg, last_dx, last_dy)


def replayed(ops: DataFrame) -> DataFrame:
    """(doc_id, applied): ids of the edits that stand after all of ``ops(doc_id, op_seq, op)``.

    Undo moves the cursor back, redo forward, an edit cuts what was undone.  A
    log passes by in order and only its edits are held, each step in constant
    time; logs without a document are left out.
    """
    kind = ops.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, stack, at = None, [], 0
        for batch in batches:
            out = []
            for own, k, op in zip(batch["doc_id"].tolist(), batch["op_seq"].tolist(), batch["op"].tolist(), strict=True):
                if doc != (own,):
                    if doc:
                        out.append((doc[0], stack[:at]))
                    doc, stack, at = (own,), [], 0
                if op == "undo":
                    at = max(at - 1, 0)
                elif op == "redo":
                    at = min(at + 1, len(stack))
                else:
                    del stack[at:]
                    stack.append(k)
                    at += 1
            yield pd.DataFrame(out, columns=["doc_id", "applied"])
        yield pd.DataFrame([(doc[0], stack[:at])] if doc else [], columns=["doc_id", "applied"])

    some = ops.filter("doc_id is not null").select("doc_id", F.col("op_seq").cast("long").alias("op_seq"), "op")
    return some.repartition("doc_id").sortWithinPartitions("doc_id", "op_seq", "op").mapInPandas(run, f"doc_id {kind}, applied array<long>")


def changed_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages whose ordered edits differ between two snapshots (doc_id, page_index, edit_seq, new_text)."""
    shape = lambda df, n: df.groupBy("doc_id", "page_index").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("edit_seq", "new_text")))), 256).alias(n))
    both = shape(before, "a").join(shape(after, "b"), ["doc_id", "page_index"], "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", "page_index")


def recent(rows: DataFrame, key: str, by: str, order: str, keep: int) -> DataFrame:
    """Most recently used distinct keys, newest first."""
    last = rows.groupBy(by, key).agg(F.max(order).alias("at"))
    w = Window.partitionBy(by).orderBy(F.desc("at"), key)
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).drop("at")


def history(ops: DataFrame, cap: int = HISTORY) -> DataFrame:
    """(doc_id, steps, at, shown, can_undo, can_redo) after all of ``ops(doc_id, op_seq, op)``.

    The first change starts a history with the empty state below it; a change
    cuts what was undone and pushes itself, and the oldest state goes beyond
    ``cap`` (2 at least).  ``shown`` is the change whose state is seen, null for the
    empty one.  A log passes by in order and only its states are held, so a log of
    any length fits; logs without a document have no history.
    """
    kind = ops.schema["doc_id"].dataType.simpleString()
    lookup = {"undo": 1, "redo": 2}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, stack, at = None, [], -1
        ended = lambda: (doc[0], len(stack), at, stack[at] if stack else None, at > 0, 0 <= at < len(stack) - 1)
        for batch in batches:
            out = []
            for own, k, op in zip(batch["doc_id"].tolist(), batch["op_seq"].tolist(), batch["op"].map(lookup).fillna(0).tolist(), strict=True):
                if doc != (own,):
                    if doc:
                        out.append(ended())
                    doc, stack, at = (own,), [], -1
                if op == 1:
                    at = at - 1 if at > 0 else at
                elif op == 2:
                    at = min(at + 1, len(stack) - 1)
                else:
                    stack = (stack[: at + 1] or [None])[1 - cap :] + [k]
                    at = len(stack) - 1
            yield _histories(out)
        yield _histories([ended()] if doc else [])

    some = ops.filter("doc_id is not null").select("doc_id", F.col("op_seq").cast("long").alias("op_seq"), "op")
    return some.repartition("doc_id").sortWithinPartitions("doc_id", "op_seq", "op").mapInPandas(run, f"doc_id {kind}, steps int, at int, shown long, can_undo boolean, can_redo boolean")


def _histories(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "steps", "at", "shown", "can_undo", "can_redo"])
    return frame.assign(shown=frame["shown"].astype("Int64"))
