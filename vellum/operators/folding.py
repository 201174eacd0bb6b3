"""Search form of texts with the way back to the original.

Each character of the first plane is folded by itself: a few signs by table,
then NFKC, then lower case; soft hyphens go, runs of white space become one
space, none at the ends.  Every folded character has a *place*: the original
character it came from (a space: the first of its run).  Places differ from
positions by shifts that change only where something was folded to another
length, so a line carries a short list of (at, by), often an empty one.

Texts of a batch are folded together by array kernels.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs that results depend on.
SIGNS = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "−": "-", " ": " "}
SOFT_HYPHEN = 0xAD
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)

#: Folded text, or shifts: what ``folded`` adds.
SHIFTS = "array<struct<at:int,by:int>>"
#: Bytes of text that are folded at once; a longer text is folded alone.
AT_ONCE = 1 << 20


@dataclass
class Folded:
    """Folded characters of several texts, one after the other; text t has those from ``first[t]`` to ``first[t + 1]``."""

    chars: np.ndarray
    place: np.ndarray
    first: np.ndarray

    def texts(self) -> list[str]:
        whole = self.chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a:b] for a, b in zip(self.first, self.first[1:], strict=False)]


@functools.lru_cache(2)
def _table(keep_case: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, characters) of what each character of the first plane is folded to."""
    out, length = [], np.ones(0x10000, np.int64)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            new = chr(cp)
        else:
            new = unicodedata.normalize("NFKC", SIGNS.get(chr(cp), chr(cp)))
            new = "" if cp == SOFT_HYPHEN else new if keep_case else new.lower()
        length[cp] = len(new)
        out += map(ord, new)
    return np.cumsum(length) - length, length, np.array(out, np.uint32)


def white(chars: np.ndarray) -> np.ndarray:
    """Which code points are white space."""
    table = np.zeros(0x10000, bool)
    table[list(WHITE)] = True
    return table[np.minimum(chars, 0xFFFF)] & (chars <= 0xFFFF)


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each begins and the last ends)."""
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), first


def fold(chars: np.ndarray, first: np.ndarray, keep_case: bool = False) -> Folded:
    start, length, to = _table(keep_case)
    low = np.where(chars < 0x10000, chars, 0)
    n = np.where(chars < 0x10000, length[low], 1)
    origin = np.repeat(np.arange(len(chars)), n)
    within = np.arange(len(origin)) - np.repeat(np.cumsum(n) - n, n)
    new = np.where(chars[origin] < 0x10000, to[np.minimum(start[low[origin]] + within, len(to) - 1)], chars[origin])
    text = np.searchsorted(first, origin, side="right") - 1
    solid = np.flatnonzero(~white(new))
    # a space stands where white space lies between two others of one text
    gap = np.zeros(len(solid), bool)
    gap[1:] = (np.diff(solid) > 1) & (np.diff(text[solid]) == 0)
    at = np.arange(len(solid)) + np.cumsum(gap)
    total = len(solid) + int(gap.sum())
    out, place = np.full(total, 0x20, np.uint32), np.zeros(total, np.int64)
    out[at], place[at] = new[solid], origin[solid]
    place[at[gap] - 1] = origin[solid[np.flatnonzero(gap) - 1] + 1]
    owner = text[solid]
    count = np.bincount(owner, minlength=len(first) - 1) + np.bincount(owner[gap], minlength=len(first) - 1)
    bounds = np.concatenate([[0], np.cumsum(count)])
    return Folded(out, place - np.repeat(first[:-1], count), bounds)


def stretches(texts: pa.Array, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Rows of a column in stretches of about ``most`` bytes."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (int(size[lo - 1]) if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _shifts(f: Folded) -> pa.Array:
    by = f.place - (np.arange(len(f.place)) - np.repeat(f.first[:-1], np.diff(f.first)))
    before = np.concatenate([[0], by[:-1]])
    inside = f.first[:-1][np.diff(f.first) > 0]
    before[inside] = 0
    change = np.flatnonzero(by != before)
    owner = np.searchsorted(f.first, change, side="right") - 1
    lists = np.searchsorted(change, f.first)
    rows = pa.StructArray.from_arrays([pa.array((change - f.first[owner]).astype(np.int32)), pa.array(by[change].astype(np.int32))], ["at", "by"])
    return pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), rows)


def folded(rows: DataFrame, text: str = "text", keep_case: bool = False) -> DataFrame:
    """``rows`` with ``norm``, the folded text (null: empty), and ``shifts`` from its positions to original ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            for lo, hi in stretches(texts):
                f = fold(*points([t or "" for t in texts.slice(lo, hi - lo).to_pylist()]), keep_case)
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(f.texts(), pa.string()), _shifts(f)], names=[*batch.schema.names, "norm", "shifts"])

    rows = rows.drop("norm", "shifts")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}norm string, shifts {SHIFTS}")


def original(at: Column, shifts: Column) -> Column:
    """Where in the original text the character at a folded position stands."""
    return at + F.coalesce(F.array_max(F.filter(shifts, lambda s: s["at"] <= at))["by"], F.lit(0))
