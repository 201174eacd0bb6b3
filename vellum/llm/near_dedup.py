"""Operator 3: near-duplicate documents by HyperMinHash and exact verification.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is
its distinct five-word shingles (the whole sequence as one if it has fewer
words), held as 64-bit hashes.  Documents are linked from similarity 0.75.

1. Copies.  Documents with the same word sequence have the same set; from here
   on each such class has a number of its own and goes by it.
2. Sketch.  Each shingle hash picks one of ``BUCKETS`` registers and a value; a
   register keeps its smallest value as a leading-zero count and ``MANTISSA``
   further bits (HyperMinHash).  Registers that get no shingle are filled by further rounds of
   hashes; the register then is the first hit in (round, value) order, so two
   sets agree in a register with probability equal to their similarity, small
   sets too.
3. Banding.  Bands of ``ROWS`` compressed registers are bucket keys.
4. Stars.  In each bucket every member is paired with one leader only: the one
   whose buckets hold most members, so the centre of a group of near copies.
   Pairs pass a Jaccard estimate corrected for register collisions (a pair must
   fall more than six deviations short to be dropped) and are confirmed on the
   full sets.  A leader's set is sent once for each ``BLOCK`` members, which
   stream past it.
5. The rest.  In buckets whose members are not all connected by then, members
   outside the bucket's main component are compared with all others of other
   components: in bounded block pairs, each pair at its first shared band only,
   by estimate and then on full sets.  A task skips pairs that it has already
   connected and emits links, never candidates.

So a group of thousands of near copies costs edges linear in its size, and no
link is lost to a bucket's size.  Components come from ``graph.components``.

Defined results: null, empty and white-space texts have n_shingles 0 and link
with nothing; a null doc_id links with nothing, its component is null and it
is kept; rows that share a doc_id are documents of their own, each linked by its
own text; ``near_duplicates`` ignores extra columns, ``deduplicate`` keeps them,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.blocks import runs
from vellum.llm.graph import components
from vellum.llm.memory import claim
from vellum.llm.scratch import Scratch, fresh, partitions

WORDS = 5
SIMILARITY = (75, 100)
#: 2**7: a shingle hash's upper seven bits choose its register.
BUCKETS = 128
ROWS = 4
MANTISSA = 10
BLOCK = 256
#: Word hashes that a worker keeps.
WORD_HASHES = 600_000

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > WORD_HASHES:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()
_POWERS = _mix(np.arange(1, WORDS + 1, dtype=_U) * _GOLD) | _U(1)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))
    n = min(WORDS, len(words))
    m = len(words) - n + 1
    s = np.full(m, _U(n))
    for k in range(n):
        s = s + _mix(h[k : k + m] ^ _POWERS[k]) * _POWERS[k]
    return np.unique(_mix(s))


def sketch(s: np.ndarray) -> np.ndarray:
    """Compressed registers: leading zeros in the high bits, mantissa below; the round is mixed in."""
    out = np.zeros(BUCKETS, np.uint32)
    empty = np.ones(BUCKETS, bool)
    at, rounds = 0, 1
    while empty.any():
        # one key sorts by (bucket: 7 bits, round: 8 bits, value: 49 bits)
        r = np.arange(rounds, dtype=_U)
        h = _mix(s[None, :] + ((r + _U(at)) * _GOLD)[:, None])
        key = np.sort(((h >> _U(57) << _U(57)) | (r << _U(49))[:, None] | (h << _U(7) >> _U(15))).ravel())
        bucket = (key >> _U(57)).astype(np.int64)
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]]) & empty[bucket]
        key, bucket = key[first], bucket[first]
        value = (key << _U(15)) | _U(1 << 14)
        zeros = 63 - np.frexp(value.astype(np.float64))[1].astype(np.int64) + 1
        rest = value << zeros.astype(_U)  # the leading one is bit 63
        mantissa = (rest << _U(1)) >> _U(64 - MANTISSA)
        salt = _mix((key >> _U(49) & _U(255)) + _U(at)) & _U(15)  # tells rounds apart
        out[bucket] = ((zeros.astype(_U) << _U(MANTISSA)) | mantissa) ^ (salt << _U(12))
        empty[bucket] = False
        at, rounds = at + rounds, max(1, min(256, 4 * BUCKETS // max(1, len(s))))
    return out.astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows: agreements, less those expected by chance.

    Unrelated registers agree when both their leading-zero counts and their
    mantissas do: the first with probability sum(4**-k) = 1/3, the second with 2**-MANTISSA.
    """
    same = (a == b).mean(axis=-1)
    chance = 2.0**-MANTISSA / 3
    return (same - chance) / (1 - chance)


def _cut() -> float:
    t = SIMILARITY[0] / SIMILARITY[1]
    return t - 6 * (t * (1 - t) / BUCKETS) ** 0.5


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


SKETCHES = "doc_id long, h long, n_shingles long, sequence binary, registers binary"
#: Text that is turned to sets at once, in bytes.
SETS_AT_ONCE = 4 << 20


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    claim("words", _WORDS.clear)
    for batch in batches:
        n, seq, regs = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            words = text.as_py().lower().split()
            s = shingles(words)
            n.append(len(s))
            seq.append(xxh3_128_digest(b" ".join(words)) if words else None)
            regs.append(sketch(s).tobytes() if words else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(seq, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "h", "n_shingles", "sequence", "registers"])


def band_keys(registers: np.ndarray) -> np.ndarray:
    """64-bit bucket keys of register rows, one a band."""
    bands = BUCKETS // ROWS
    salt = _mix(np.arange(1, bands + 1, dtype=_U) * _GOLD)
    packed = (registers.reshape(-1, bands, ROWS).astype(_U) << (np.arange(ROWS, dtype=_U) * _U(16))).sum(axis=2, dtype=_U)
    return _mix(_mix(packed + salt) ^ salt).view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u2"))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), keys.shape[1])), pa.array(keys.ravel())], names=["id", "key"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    claim("words", _WORDS.clear)
    for batch in batches:
        rows: list[tuple[bytes, bytes, bytes]] = []
        size = 0
        for text in [*batch.column("text").cast(pa.binary()), None]:
            if text is not None and (words := text.as_py().lower().split()):
                found = shingles(words)
                rows.append((xxh3_128_digest(b" ".join(words)), found.tobytes(), sketch(found).tobytes()))
                size += len(rows[-1][1])
            if rows and (text is None or size > SETS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=["sequence", "shingles", "registers"])
                rows, size = [], 0


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of members (side 1) to the leader (side 0) that comes before them."""
    cut = _cut()
    lead = None
    for batch in batches:
        out: list[tuple[int, int]] = []
        for key, side, at, found, regs in zip(*(batch.column(c) for c in ("leader", "side", "id", "shingles", "registers")), strict=True):
            if not side.as_py():
                lead, mine, own = key.as_py(), np.frombuffer(found.as_py(), _U), np.frombuffer(regs.as_py(), "<u2")
            elif key.as_py() != lead:
                raise ValueError("a member came before its leader")
            elif estimate(own, np.frombuffer(regs.as_py(), "<u2")) >= cut and linked(mine, np.frombuffer(found.as_py(), _U)):
                out.append((at.as_py(), lead))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components of one bucket's block pair: side 0 holds members outside its main component, side 1 any."""
    cut = _cut()
    for rows, bounds in runs(batches, ("key", "i", "j")):
        regs = np.frombuffer(b"".join(rows.column("registers").to_pylist()), "<u2").reshape(-1, BUCKETS)
        doc, comp, key, side, active = (rows.column(c).to_numpy() for c in ("id", "comp", "key", "side", "active"))
        sets = rows.column("shingles").combine_chunks()
        out: list[tuple[int, int]] = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            left, right = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
            if not len(left) or not len(right):
                continue
            keys = band_keys(regs[right])
            root: dict[int, int] = {}

            def top(c: int, root: dict[int, int] = root) -> int:
                while c in root:
                    c = root[c]
                return c

            for x in left.tolist():
                rough = estimate(regs[x], regs[right])
                own = band_keys(regs[x])[0]
                shared = keys == own
                first = own[shared.argmax(axis=1)] == key[s]
                maybe = (rough >= cut) & (comp[right] != comp[x]) & first & ~(active[right] & (doc[right] <= doc[x]))
                mine = np.frombuffer(sets[x].as_py(), _U) if maybe.any() else None
                for k in np.flatnonzero(maybe)[np.argsort(-rough[maybe], kind="stable")].tolist():
                    y = int(right[k])
                    a, b = top(int(comp[x])), top(int(comp[y]))
                    if a != b and linked(mine, np.frombuffer(sets[y].as_py(), _U)):
                        root[max(a, b)] = min(a, b)
                        out.append((int(doc[x]), int(doc[y])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def _grouped(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h, n_shingles, group, component_id) for each row of ``docs(doc_id, text)``; ``h`` is a hash of the text.

    Rows of one group are linked, directly or not; a row that links with nothing for want of words or of an id has a null group.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = scratch.write(rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(_sketches, SKETCHES), "sketches")
    known = marked.filter("doc_id is not null and sequence is not null")
    # numbered as they are written: a class's number must be drawn once
    classes = known.groupBy("sequence").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers")).withColumn("id", F.monotonically_increasing_id())
    classes = scratch.write(classes, "classes")

    # buckets with more than one class; each member with its bucket's leader
    bands = scratch.write(classes.select("id", "registers").mapInArrow(_bands, "id long, key long").distinct(), "bands")
    sizes = scratch.write(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    shared = scratch.write(bands.join(sizes, "key"), "shared")
    degree = scratch.write(shared.groupBy("id").agg(F.sum("n").alias("degree")), "degree")
    ranked = scratch.write(shared.join(degree, "id").select("key", "id", "degree"), "ranked")
    led = scratch.write(ranked.groupBy("key").agg(F.max_by("id", F.struct("degree", F.xxhash64("id"))).alias("leader")), "led")
    members = scratch.write(ranked.select("key", "id").join(led, "key"), "members")
    scratch.drop(bands, shared, ranked)

    # full sets of those classes only, each from a row of its smallest doc_id
    wanted = scratch.write(classes.select("id", "rep", "sequence").join(members.select("id").distinct(), "id"), "wanted")
    sets = rows.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text").mapInArrow(_sets, "sequence binary, shingles binary, registers binary")
    sets = sets.join(wanted.select("id", "sequence"), "sequence").select("id", "shingles", "registers").dropDuplicates(["id"])
    sets = scratch.write(sets, "sets")

    pairs = scratch.write(members.filter("id <> leader").select("leader", "id").distinct(), "pairs")
    blocks = scratch.write(pairs.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    follow = pairs.join(blocks, "leader").select("leader", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("block"), F.lit(1).alias("side"), "id")
    lead = blocks.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("leader").alias("id"))
    met = lead.union(follow).join(sets, "id").repartition(partitions(spark), "leader", "block").sortWithinPartitions("leader", "block", "side")
    stars = scratch.write(met.mapInArrow(_confirm, "a long, b long"), "stars")
    by = scratch.write(components(stars, scratch, "cc0"), "comps0")

    # the rest: buckets whose members (but for the leader, which met them all) are in several components
    own = members.filter("id <> leader").join(by, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    own = scratch.write(own, "own")
    mains = own.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    mains = scratch.write(mains.filter("most < n").select("key", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("ka"), F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "mains")
    if mains.isEmpty():
        comps = by
    else:
        open_ = own.join(mains, "key").withColumn("active", F.col("comp") != F.col("main"))
        block = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        cols = ("key", "id", "comp", "active")
        some = open_.filter("active").select(*cols, block("ka").alias("i"), every("k").alias("j"), F.lit(0).alias("side"))
        every_one = open_.select(*cols, every("ka").alias("i"), block("k").alias("j"), F.lit(1).alias("side"))
        full = some.union(every_one).join(sets, "id").repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = scratch.write(full.mapInArrow(_rest, "a long, b long"), "more")
        comps = components(stars.union(more), scratch, "cc1")

    # a component is named by the smallest doc_id of its classes
    nodes = scratch.write(comps.union(comps.select("component", "component").distinct()).toDF("id", "group").join(classes.select("id", "rep"), "id"), "nodes")
    least = nodes.groupBy("group").agg(F.min("rep").alias("component_id"))
    found = scratch.write(nodes.select("id", "group").join(least, "group"), "groups")
    named = classes.select("id", "sequence", "rep").join(found, "id", "left").select("sequence", F.coalesce("group", "id").alias("group"), F.coalesce("component_id", "rep").alias("component_id"))
    named = scratch.write(named, "named")
    out = marked.select("doc_id", "h", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("sequence")).alias("sequence")).join(named, "sequence", "left")
    return out.select("doc_id", "h", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``."""
    out = _grouped(docs, Scratch(docs.sparkSession, "near"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: one of the smallest doc_id (of several texts with it, the one with the smallest hash).

    Rows without words or without an id are in no group and stay.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    found = scratch.write(_grouped(docs, scratch).filter("group is not null"), "found")
    best = found.groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("best"))
    # rows of the chosen id and text, and whether there are several
    times = found.groupBy("group", "doc_id", "h").agg(F.count("*").alias("n"))
    kept = times.join(best, "group").filter(F.struct("doc_id", "h") == F.col("best")).select("doc_id", "h", "n")
    kept = scratch.write(kept, "kept")
    d, h = fresh(docs, "doc"), fresh(docs, "hash")
    rows = docs.withColumns({d: F.col("doc_id").cast("long"), h: F.xxhash64(F.coalesce("text", F.lit("")))})
    of = lambda some: rows.join(some.select(F.col("doc_id").alias(d), F.col("h").alias(h)), [d, h], "left_semi")
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    alone = docs.filter(F.col("doc_id").isNull() | ~words)
    # only repeated rows meet in a shuffle of their own
    return of(kept.filter("n = 1")).select(*docs.columns).union(of(kept.filter("n > 1")).dropDuplicates([d, h]).select(*docs.columns)).union(alone)
