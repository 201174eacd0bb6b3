"""Text search as a join: needles and lines meet by hashed grams, matches have offsets of the original text.

A needle with a budget of ``E`` edits is cut into E + 1 parts, one of which every
match must hold untouched (an exact needle is one part).  The first characters
of each part, ``GRAMS`` long, are hashed; lines are folded and hashed at all
positions by array kernels in one pass, a Bloom filter of the needles' hashes
(``BITS``, a fixed size) lets few positions through, and these meet the needles
in an equi-join that the plan broadcasts or shuffles by size.  Common parts
("the ") stand everywhere, so a position and a part also carry the characters on
either side, five bits each: what stands in no place that the edits allow is
counted by bit operations in the join, and few windows are left.  What it gives
is verified on a window of the line that is as wide as the needle and its edits:
by comparison, or by a banded table of edit distances for many windows
at once.  No line is compared with a needle that it shares no part with, no
text is shuffled but the windows' chunks, and no needles are collected.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.folding import fold, points, stretches, white
from vellum.operators.folds import folded as in_order

#: Lengths of grams; a part is known by its longest.
GRAMS = (1, 2, 3, 4, 6, 8, 12, 16, 24)
#: Bits of the filter: it says which positions can't begin a part, whatever the number of needles is.
BITS = 1 << 24
#: Characters on either side of a gram that a line's position carries, and of a part that are compared: the budget shifts them by 2 at most.
NEAR, COMPARED = 12, 10
#: Characters of a line that travel as one chunk, besides a needle's length on either side.
CHUNK = 2048
#: Cells of a table of edit distances that are filled at once.
CELLS = 1 << 22

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PAD = np.uint32(0xFFFFFFFF)


def budget_of(n: int) -> int:
    """Edits that a needle of n characters may differ by."""
    return 2 if n >= 8 else 1 if n >= 4 else 0


# --- hashes ------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hash of any stretch of characters: a difference of two sums of powers."""

    def __init__(self, chars: np.ndarray):
        n = len(chars)
        power = np.ones(n + 1, np.uint64)
        power[1:] = _BASE
        power = np.cumprod(power, dtype=np.uint64)
        self.back = np.ones(n + 1, np.uint64)
        self.back[1:] = _BACK
        self.back = np.cumprod(self.back, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        return _mix((self.sums[at + n] - self.sums[at]) * self.back[at] + np.uint64(n))


# --- what stands on either side ----------------------------------------------

#: The lowest four bits and the highest one of each character's five.
_LOW, _HIGH = (sum(b << 5 * k for k in range(NEAR)) for b in (0b01111, 0b10000))


def _packed(chars: np.ndarray) -> np.ndarray:
    """``NEAR`` characters from each place on, the first lowest, none after the last; one more place than there are characters."""
    one = np.append(chars.astype(np.int64) & 31, 0)
    more = lambda x, y, n: x | np.append(y[n:], np.zeros(min(n, len(y)), np.int64)) << 5 * n
    two = more(one, one, 1)
    four = more(two, two, 2)
    return more(more(four, four, 4), four, 8)


def _sides(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each place, the nearest lowest, and from it on.

    It may be of the next line: a character too many only lets a window pass.
    """
    return _packed(chars[::-1])[::-1], _packed(chars)


def _missing(side: str, seed: str) -> Column:
    """How many characters of one side of a part stand in no place that two edits allow."""

    def unlike(shift: int) -> Column:
        x = F.col(f"{side}_chars").bitwiseXOR(F.shiftleft(seed, 5 * -shift) if shift < 0 else F.shiftright(seed, 5 * shift))
        return (x.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(x).bitwiseAND(F.lit(_HIGH))

    return F.bit_count(functools.reduce(Column.bitwiseAND, map(unlike, range(-2, 3)), F.col(f"{side}_held")))


# --- needles -----------------------------------------------------------------


def _parts(match_case: bool, fuzzy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or "" for t in batch.column("needle").to_pylist()]
            f = fold(*points(raw), match_case)
            hashes, rows = Hashes(f.chars), []
            for k, q in enumerate(f.texts()):
                if not q:
                    continue
                budget = budget_of(len(q)) if fuzzy and not match_case else 0
                ends = white(points([raw[k][0] + raw[k][-1]])[0])
                for p in range(budget + 1):
                    a, b = len(q) * p // (budget + 1), len(q) * (p + 1) // (budget + 1)
                    gram = max(g for g in GRAMS if g <= b - a)
                    h = hashes.of(np.array([f.first[k] + a]), gram).view(np.int64)[0]
                    sides = [points([side])[0] for side in (q[:a][::-1][:COMPARED], q[a + gram :][:COMPARED])]
                    rows.append((k, q, budget, bool(ends[0]), bool(ends[1]), a, b - a, GRAMS.index(gram), int(h), *(x for c in sides for x in (int(_packed(c)[0]), _HIGH & ((1 << 5 * len(c)) - 1)))))
            if rows:
                k, *columns = zip(*rows, strict=True)
                kinds = (pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), *(pa.int64(),) * 5)
                yield pa.RecordBatch.from_arrays([batch.column("needle_id").take(pa.array(k)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=_PARTS.split())

    return run


_PARTS = "needle_id needle budget left_edge right_edge part_at part_len gram hash before_chars before_held after_chars after_held"


def parts(needles: DataFrame, match_case: bool = False, fuzzy: bool = False) -> DataFrame:
    """Parts of ``needles(needle_id, needle)``, folded; white space at an end of a needle asks for a word's edge there."""
    kind = needles.schema["needle_id"].dataType.simpleString()
    shape = f"needle_id {kind}, needle string, budget int, left_edge boolean, right_edge boolean, part_at int, part_len int, gram int, hash long, before_chars long, before_held long, after_chars long, after_held long"
    return needles.select("needle_id", "needle").mapInArrow(_parts(match_case, fuzzy), shape)


def _filter(known: DataFrame) -> tuple[np.ndarray, int, int]:
    """(bits, grams in use as bits, longest needle with its edits): at most BITS / 64 rows come back."""
    low = [F.col("hash").bitwiseAND(F.lit(BITS - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(BITS - 1))]
    spots = known.select(F.explode(F.array(*low)).alias("spot"), "gram", (F.length("needle") + 3 * F.col("budget") + 3).alias("reach"))
    bit = F.expr("shiftleft(1L, cast(spot % 64 as int))")
    words = spots.groupBy(F.floor(F.col("spot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"), F.bit_or(F.expr("shiftleft(1, gram)")).alias("grams"), F.max("reach").alias("reach")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    grams, reach = (words.column(c).to_numpy() for c in ("grams", "reach"))
    return out.view(np.uint64), int(np.bitwise_or.reduce(grams)) if len(grams) else 0, int(reach.max()) if len(reach) else 0


# --- lines -------------------------------------------------------------------


def _seeds(sent, match_case: bool):
    """Chunks of folded lines with the positions that pass the filter."""

    def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h), bool)
        for spot in (h & np.uint64(BITS - 1), (h >> np.uint64(32)) & np.uint64(BITS - 1)):
            hit &= (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, grams, reach = sent.value
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in stretches(texts):
                chars, first = points([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                f = fold(chars, first, match_case)
                hashes, found = Hashes(f.chars), []
                before, after = _sides(f.chars)
                ends = f.first[1:][np.searchsorted(f.first, np.arange(len(f.chars)), side="right") - 1]
                for k, g in enumerate(GRAMS):
                    if grams >> k & 1:
                        at = np.flatnonzero(np.arange(len(f.chars)) + g <= ends)
                        h = hashes.of(at, g)
                        hit = passing(bits, h)
                        found.append((at[hit], h[hit], after[at[hit] + g]))
                at, h, beyond = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
                if not len(at):
                    continue
                line = np.searchsorted(f.first, at, side="right") - 1
                chunk = (at - f.first[line]) // CHUNK
                order = np.lexsort((at, chunk, line))
                at, h, beyond, line, chunk = at[order], h[order], beyond[order], line[order], chunk[order]
                cuts = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(chunk) != 0)]))
                c0 = np.maximum(f.first[line[cuts]], f.first[line[cuts]] + chunk[cuts] * CHUNK - reach)
                c1 = np.minimum(f.first[line[cuts] + 1], f.first[line[cuts]] + (chunk[cuts] + 1) * CHUNK + reach)
                # place of each character, and whether white space or an end of the line stands beside it
                place = f.place
                own = np.repeat(first[:-1], np.diff(f.first)) + place
                end = np.repeat(first[1:], np.diff(f.first))
                blank = np.append(white(chars), True)
                left = (place == 0) | blank[own - 1]
                right = (own + 1 >= end) | blank[np.minimum(own + 1, len(chars))]
                packed = (place << 2 | left.astype(np.int64) << 1 | right).astype("<i4").tobytes()
                whole = f.chars.astype("<u4").tobytes()
                seeds = pa.StructArray.from_arrays([pa.array((at - f.first[line]).astype(np.int32)), *(pa.array(c) for c in (h.view(np.int64), before[at], beyond))], ["at", "hash", "before", "after"])
                rows = pa.array(lo + line[cuts])
                bounds = list(zip(c0.tolist(), c1.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(rows) for c in ("doc_id", "page_index", "line_no")),
                        pa.array((c0 - f.first[line[cuts]]).astype(np.int32)),
                        pa.array((c1 == f.first[line[cuts] + 1])),
                        pa.array([whole[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in bounds], pa.string()),
                        pa.array([packed[4 * a : 4 * b] for a, b in bounds], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.append(cuts, len(at)).astype(np.int32)), seeds),
                    ],
                    names=["doc_id", "page_index", "line_no", "c0", "whole", "chunk", "places", "seeds"],
                )

    return run


# --- verification ------------------------------------------------------------


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def edits(q: np.ndarray, hay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, start) of the best match of each row of ``q`` that ends before each place of the same row of ``hay``.

    The table is filled a query character at a time; a cell's chain of extra
    characters is a running minimum of (value - position), the nearest on ties.
    """
    wide = hay.shape[1]
    pos = np.arange(wide + 1)
    dist, start = np.zeros((len(q), wide + 1), np.int64), np.tile(pos, (len(q), 1))
    for i in range(q.shape[1]):
        sub, skip = dist[:, :-1] + (hay != q[:, i, None]), dist[:, 1:] + 1
        own = np.concatenate([np.full((len(q), 1), i + 1), np.minimum(sub, skip)], axis=1)
        origin = np.concatenate([np.zeros((len(q), 1), np.int64), np.where(skip < sub, start[:, 1:], start[:, :-1])], axis=1)
        order = np.minimum.accumulate((own - pos) * (wide + 2) + (wide + 1 - pos), axis=1)
        source = wide + 1 - order % (wide + 2)
        dist, start = np.take_along_axis(own, source, 1) + pos - source, np.take_along_axis(origin, source, 1)
    return dist, start


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, padded, lengths)."""
    chars, first = points(texts)
    n = np.diff(first)
    out = np.full((len(texts), max(1, int(n.max(initial=0)))), _PAD, np.uint32)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = chars
    return out, n


def _some(budget: int, q: np.ndarray, hay: np.ndarray, n: np.ndarray, a: np.ndarray, size: np.ndarray, at: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, dist, start, stop) in windows of needles of one length and budget, for the part at ``a`` that stands at ``at``."""
    m = q.shape[1]
    rows = np.arange(len(q))
    # the part itself, then the whole needle where it was found by its first part
    same = np.ones(len(q), bool)
    for k in range(int(size.max(initial=0))):
        inside = (k < size) & (at + k < n)
        same &= (k >= size) | inside & (hay[rows, np.minimum(at + k, hay.shape[1] - 1)] == q[rows, np.minimum(a + k, m - 1)])
    out = []
    first = np.flatnonzero(same & (a == 0) & (at + m <= n))
    if len(first):
        hit = first[(np.take_along_axis(hay[first], at[first, None] + np.arange(m), 1) == q[first]).all(axis=1)]
        out.append((hit, np.zeros(len(hit), np.int64), at[hit], at[hit] + m))
    if budget:
        stop = at - a + m
        some = np.flatnonzero(same)
        step = max(1, CELLS // (m * (hay.shape[1] + 1)) * 8)
        for s in range(0, len(some), step):
            r = some[s : s + step]
            dist, start = edits(q[r], hay[r])
            nxt = np.concatenate([dist[:, 2:], np.full((len(r), 1), budget + 1)], axis=1)
            j = np.arange(1, dist.shape[1])
            last = whole[r, None] & (j == n[r, None])
            good = (dist[:, 1:] <= budget) & (dist[:, 1:] > 0) & (j <= n[r, None]) & (np.abs(j - stop[r, None]) <= budget) & ((dist[:, 1:] < nxt) | (hay[r] == 0x20) | last)
            i, j = np.nonzero(good)
            out.append((r[i], dist[i, j + 1], start[i, j + 1], j + 1))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        needle = batch.column("needle").to_pylist()
        col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("budget", "part_at", "part_len", "seed", "base", "ends", "left_edge", "right_edge")}
        kinds = np.array([len(q) for q in needle]) * 4 + col["budget"]
        for kind in np.unique(kinds):
            r = np.flatnonzero(kinds == kind)
            q, _ = _matrix([needle[k] for k in r])
            hay, n = _matrix(batch.column("window").take(pa.array(r)).to_pylist())
            at, base = col["seed"][r].astype(np.int64), col["base"][r].astype(np.int64)
            i, dist, s, e = _some(int(kind) % 4, q, hay, n, col["part_at"][r].astype(np.int64), col["part_len"][r], at - base, col["ends"][r])
            if not len(i):
                continue
            # a match never begins or ends with the space that stands for white space
            s1 = s + ((s < e) & (hay[i, np.minimum(s, hay.shape[1] - 1)] == 0x20))
            e1 = e - ((e > s1) & (hay[i, e - 1] == 0x20))
            keep = (e > s) & (e1 > s1)
            i, dist, s, e, s1, e1 = (x[keep] for x in (i, dist, s, e, s1, e1))
            letters = _letters()
            inner = (s1 > 0) & letters[np.minimum(hay[i, np.maximum(s1 - 1, 0)], 0x10FFFF)] | (e1 < n[i]) & letters[np.minimum(hay[i, np.minimum(e1, hay.shape[1] - 1)], 0x10FFFF)]
            raw = batch.column("places").take(pa.array(r[i])).to_pylist()
            place = [np.frombuffer(p, "<i4")[[x, y - 1]] for p, x, y in zip(raw, s1.tolist(), e1.tolist(), strict=True)]
            a, b = np.array(place, np.int64).reshape(-1, 2).T
            edge = (~col["left_edge"][r[i]] | (a & 2 > 0)) & (~col["right_edge"][r[i]] | (b & 1 > 0))
            own = batch.select(["needle_id", "doc_id", "page_index", "line_no"]).take(pa.array(r[i]))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(dist.astype(np.int32)), pa.array((base[i] + s).astype(np.int32)), pa.array((base[i] + e).astype(np.int32)), pa.array((a >> 2).astype(np.int32)), pa.array(((b >> 2) + 1).astype(np.int32)), pa.array(edge & ~((dist > 0) & inner))],
                names=["needle_id", "doc_id", "page_index", "line_no", "dist", "s", "e", "start", "stop", "shown"],
            )


def _apart(rows: dict[str, list]) -> list[tuple]:
    """Of one needle's candidates in one line, best first, those that lie over none taken before; in text order."""
    begins: list[int] = []
    ends: list[int] = []
    out = []
    for k, (s, e) in enumerate(zip(rows["s"], rows["e"], strict=True)):
        at = bisect_left(begins, e)
        if at and ends[at - 1] > s:
            continue
        begins.insert(at, s)
        ends.insert(at, e)
        if rows["shown"][k]:
            out.append(tuple(rows[c][k] for c in ("needle_id", "doc_id", "page_index", "line_no", "start", "stop", "dist")))
    return sorted(out, key=lambda r: r[4])


def search(lines: DataFrame, needles: DataFrame, match_case: bool = False, fuzzy: bool = False) -> DataFrame:
    """(needle_id, doc_id, page_index, line_no, start, stop, dist) of ``needles(needle_id, needle)`` in ``lines(doc_id, page_index, line_no, text)``.

    Offsets are those of the line's own text.  Exact matches stand anywhere;
    fuzzy ones, of as many edits as the needle's length allows, between word
    edges.  Matches of one needle in one line don't overlap: fewer edits win,
    then the earlier, then the longer one.  With ``match_case`` case counts and
    nothing is fuzzy.  Null and empty lines and needles match nothing.
    """
    known = parts(needles, match_case, fuzzy)
    sent = lines.sparkSession.sparkContext.broadcast(_filter(known))
    kind = {c: lines.schema[c].dataType.simpleString() for c in ("doc_id", "page_index", "line_no")}
    keys = "".join(f"{c} {t}, " for c, t in kind.items())
    chunks = lines.select("doc_id", "page_index", "line_no", "text").mapInArrow(_seeds(sent, match_case), f"{keys}c0 int, whole boolean, chunk string, places binary, seeds array<struct<at:int,hash:bigint,before:bigint,after:bigint>>")
    # never null, so that the join's condition is a few lines of code
    sure = lambda c: F.coalesce(c, F.lit(0))
    spots = chunks.select("doc_id", "page_index", "line_no", "c0", "whole", "chunk", "places", F.explode("seeds").alias("seed"))
    spots = spots.select("*", sure("seed.hash").alias("hash"), sure("seed.before").alias("before"), sure("seed.after").alias("after"))
    parted = known.withColumns({c: sure(c) for c in ("budget", "before_chars", "before_held", "after_chars", "after_held")})
    met = spots.join(parted, (spots["hash"] == parted["hash"]) & (_missing("before", "before") + _missing("after", "after") <= F.col("budget")))
    begin = F.col("seed.at") - F.col("part_at")
    lo = F.greatest(F.col("c0"), begin - 3 * F.col("budget") - 3)
    hi = F.least(F.col("c0") + F.length("chunk"), begin + F.length("needle") + F.col("budget") + 2)
    cut = lo - F.col("c0")
    windows = met.select(
        "needle_id", "doc_id", "page_index", "line_no", "needle", "budget", "left_edge", "right_edge", "part_at", "part_len", F.col("seed.at").alias("seed"), lo.alias("base"),
        (F.col("whole") & (hi == F.col("c0") + F.length("chunk"))).alias("ends"), F.substring("chunk", cut + 1, hi - lo).alias("window"), F.substring("places", 4 * cut + 1, 4 * (hi - lo)).alias("places"),
    )
    needle = f"needle_id {needles.schema['needle_id'].dataType.simpleString()}, "
    found = windows.mapInArrow(_verify, f"{needle}{keys}dist int, s int, e int, start int, stop int, shown boolean")
    return in_order(found.withColumn("back", -F.col("e")), ("needle_id", "doc_id", "line_no"), ("dist", "s", "back"), _apart, f"{needle}{keys}start int, stop int, dist int")


def search_documents(lines: DataFrame, needles: DataFrame, match_case: bool = False) -> DataFrame:
    """As ``search``, exact first: a needle's fuzzy matches count in documents only where it has no exact one; with ``match_case`` there are none."""
    both = search(lines, needles, match_case, fuzzy=not match_case)
    if match_case:
        return both
    exact = both.filter("dist = 0").select("needle_id", "doc_id").distinct()
    return both.filter("dist = 0").unionByName(both.filter("dist > 0").join(exact, ["needle_id", "doc_id"], "left_anti"))


def replaced(lines: DataFrame, matches: DataFrame, new: str | Column) -> DataFrame:
    """``lines`` that hold matches, with ``text`` where each span (start, stop) is ``new``, and ``n``, their number.

    Spans that reach over the text's ends are clamped; of spans that overlap the
    first counts.  A line's spans are gathered, so they are as many as it is long at most.
    """
    new = F.lit(new) if isinstance(new, str) else new
    spans = matches.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    both = lines.join(spans, ["doc_id", "line_no"])
    n = F.length("text")
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc: Column, s: Column) -> Column:
        a, b = F.greatest(s["start"], F.lit(0)), F.least(s["stop"], n)
        fits = (a >= acc["at"]) & (b >= a) & (a <= n)
        return F.when(fits, F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("stop")))).alias("out"))).otherwise(acc)

    good = F.aggregate("spans", F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    begins = lambda g: F.concat(F.array(F.lit(0)), F.transform(g, lambda s: s["stop"]))
    ends = lambda g: F.concat(F.transform(g, lambda s: s["start"]), F.array(n))
    kept = F.transform(F.arrays_zip(begins(F.col("good")).alias("a"), ends(F.col("good")).alias("b")), lambda p: F.substring("text", p["a"] + 1, p["b"] - p["a"]))
    return both.withColumn("good", good).withColumns({"n": F.size("good"), "text": F.call_function("array_join", kept, new)}).drop("spans", "good")


def match_boxes(matches: DataFrame, items: DataFrame) -> DataFrame:
    """``matches(doc_id, line_no, start, stop)`` with the box of their characters: parts of words in proportion.

    ``items(doc_id, line_no, o, text, left, right, top, bottom)`` hold each word's
    place ``o`` in the line's text, which is the text that offsets count.  A match that no word meets has no row.
    """
    o, n, w = F.col("o"), F.length("text"), F.col("right") - F.col("left")
    words = items.filter("trim(text) <> ''").select("doc_id", "line_no", "o", "text", "left", "right", "top", "bottom")
    key = [c for c in matches.columns if c not in ("x0", "x1", "y0", "y1")]
    both = matches.join(words, ["doc_id", "line_no"]).filter((o + n > F.col("start")) & (o < F.col("stop")))
    a = F.col("left") + w * (F.greatest(F.col("start"), o) - o) / n
    b = F.col("left") + w * (F.least(F.col("stop"), o + n) - o) / n
    return both.groupBy(*key).agg(F.min(a).alias("x0"), F.max(b).alias("x1"), F.min("top").alias("y0"), F.max("bottom").alias("y1")).filter("x1 > x0")
