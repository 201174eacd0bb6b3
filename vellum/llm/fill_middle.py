"""Operator 11: fill-in-middle by run-length class encoding.

A text is stored as its maximal runs of one character class (white space or
not), each with its length and the number of units that end in or before it.
A cut after k units is a binary search for the run whose cumulative count
reaches k; the offset inside that run follows from its length and its share of
units, so no list of units is ever built.  In a batch all texts' runs stand in
one set of arrays and all cuts are one search.

Units are tokens (white space with the word after it, or white space at the
end of a text: a word's run holds one unit, a white run none but at the end) or
single characters: there the classes are the widths of characters in UTF-8, so a
run of w-byte characters holds ``length / w`` units and the offset of any of
them is a product.

Defined results: null text is empty; an empty text has no runs and is plain; a
null key draws from the empty string; rows that repeat a key draw alike; other
columns stay as they are, but columns that have the names of the results are
replaced; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.scratch import fresh

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are rearranged, and of 100 of those so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Runs:
    """Runs of all texts of a batch, in bytes of one buffer; ``first[d]`` to ``first[d + 1]`` are those of text d."""

    start: np.ndarray
    length: np.ndarray
    kind: np.ndarray  # tokens: 1 for white space, else 0; characters: their width
    units: np.ndarray  # of the run and all runs before it, in the batch
    first: np.ndarray

    def before(self) -> np.ndarray:
        """Units before each text; one more entry for the end."""
        return np.concatenate([[0], self.units])[self.first]

    def cut(self, text: np.ndarray, k: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place in the buffer after ``k`` units of each text; ``ends`` are the texts' first bytes."""
        goal = self.before()[text] + k
        run = np.minimum(np.searchsorted(self.units, goal, side="left"), max(0, len(self.units) - 1))
        if not len(self.units):
            return ends[text]
        held = np.diff(self.units, prepend=0)[run]
        into = goal - (self.units[run] - held)
        return np.where(k == 0, ends[text], self.start[run] + into * self.length[run] // np.maximum(held, 1))


def encode(data: np.ndarray, offsets: np.ndarray, unit: str = "token") -> Runs:
    """Class runs of texts that stand in the bytes ``data`` (UTF-8) at ``offsets``."""
    kinds = _WHITE[data] if unit == "token" else _widths(data)
    change = np.empty(len(data), bool)
    change[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
    starts = offsets[:-1]
    change[starts[starts < len(data)]] = True
    start = np.flatnonzero(change)
    length = np.diff(start, append=len(data))
    kind = kinds[start].astype(np.int8)
    first = np.searchsorted(start, offsets)
    if unit == "token":
        units = 1 - kind.astype(np.int64)
        last = first[1:][np.diff(offsets) > 0] - 1
        units[last] = 1  # white space at the end of a text is a unit as well
    else:
        units = length // kind
    return Runs(start, length, kind, np.cumsum(units), first)


def _widths(data: np.ndarray) -> np.ndarray:
    """Of each byte, how many bytes its character has."""
    lead = (data & 0xC0) != 0x80
    of = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
    head = data[of]
    return 1 + (head >= 0xC0).astype(np.int8) + (head >= 0xE0) + (head >= 0xF0)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _places(names: tuple[str, ...], text: str, draws: str, unit: str):
    """Adds the number of units and the three parts, cut at the two drawn places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _buffer(batch.column(text))
            runs = encode(data, offsets, unit)
            n = np.diff(runs.before())
            which = np.arange(batch.num_rows)
            d = batch.column(draws).flatten().to_numpy().reshape(-1, 4)
            a, b = d[:, 0] % (n + 1), d[:, 1] % (n + 1)
            lo, hi = (runs.cut(which, k, offsets[:-1]) for k in (np.minimum(a, b), np.maximum(a, b)))
            bounds = np.stack([offsets[:-1], lo, hi, offsets[1:]], axis=1)
            raw = pa.py_buffer(data)
            parts = []
            for p in range(3):
                # neighbouring parts interleave in the buffer: one offset array over all bounds, every third piece
                cuts = pa.LargeStringArray.from_buffers(3 * len(n), pa.py_buffer(np.append(bounds[:, :3].ravel(), offsets[-1]).astype(np.int64)), raw)
                parts.append(cuts.take(pa.array(np.arange(p, 3 * len(n), 3))).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(n), *parts], names=[*batch.schema.names, *names])

    return run


def _runs(text: str, key: str, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _buffer(batch.column(text))
            r = encode(data, offsets, unit)
            lists = pa.array(r.first.astype(np.int32))
            units = r.units - np.repeat(r.before()[:-1], np.diff(r.first))
            columns = [pa.ListArray.from_arrays(lists, pa.array(c)) for c in (r.length.astype(np.int64), r.kind.astype(np.int32), units)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "lengths", "kinds", "units"])

    return run


def class_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "token") -> DataFrame:
    """(key, lengths, kinds, units): the stored encoding, one entry a run; lengths are in UTF-8 bytes, units are cumulative."""
    rows = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(_runs("_text", key, unit), f"`{key}` {kind}, lengths array<bigint>, kinds array<int>, units array<bigint>")


def _draws(key: str, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*(F.lit(8 * i + 1) for i in range(4))), lambda at: F.conv(F.substring(digest, at, F.lit(8)), 16, 10).cast("bigint"))


def rearrange(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = "token") -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, the rearranged text.

    Forms: plain (the text as it is), psm (prefix, suffix, middle) and spm (suffix, prefix, middle).
    """
    out = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c.lower() not in out or c in (text, key)]
    t, d, n = (fresh(docs, x) for x in ("whole", "draws", "units"))
    parts = [fresh(docs, x) for x in ("prefix", "middle", "suffix")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(text), F.lit("")).alias(t), _draws(key, seed).alias(d))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    cut = rows.mapInArrow(_places((n, *parts), t, d, unit), f"{fields}, `{n}` bigint, " + ", ".join(f"`{p}` string" for p in parts))
    prefix, middle, suffix = (F.col(p) for p in parts)
    plain = (F.col(t) == "") | reduce_or(F.contains(F.col(t), F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)) | (F.col(d)[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col(d)[3] % 100 < suffix_first, "spm").otherwise("psm")
    moved = form != "plain"
    output = F.when(plain, F.col(t)).when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    results = [F.col(n).alias("n"), form.alias("form"), F.when(moved, F.length(prefix).cast("bigint")).alias("prefix_chars"), F.when(moved, F.length(middle).cast("bigint")).alias("middle_chars"), output.alias("output")]
    shown = [F.col(f"`{c}`") for c in kept if c.lower() not in out]
    return cut.select(*shown, *results)


def reduce_or(conditions) -> Column:
    first, *rest = conditions
    for c in rest:
        first = first | c
    return first


def restore(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: a text that holds a mark is never rearranged, so marks are where the parts meet."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def digest(rearranged: DataFrame, key: str = "doc_id") -> DataFrame:
    return rearranged.select(
        key, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
