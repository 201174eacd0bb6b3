"""Operator 13: line dedup by a sharded minimal perfect hash.

A line's key is the line stripped of white space and lower-cased (A-Z); keys of
``LEAST`` code points or more are hashed to 128 bits.  Hashes are aggregated to
(smallest document, largest document, rows) before and after one shuffle; those
found in two documents or more are dealt to shards by hash and each shard
becomes a minimal perfect hash over its hashes: levels of bit arrays where a
hash that stands alone on its bit is placed, with counts of set bits as ranks.
The rank indexes arrays of fingerprints (64 bits), owners (smallest document)
and counts (rows, up to 65535), about 18 bytes a hash.  The shards are a table
that ``build`` returns and later runs may probe again.

Documents probe the arrays.  A line whose hash isn't indexed lands on some rank
and is told by its fingerprint: shard and rank depend on all 128 bits, so a
wrong answer needs equal second halves by chance, 2**-64 a probe.

* An index of up to ``SHIPPED`` bytes (its exact size is known) goes to every
  executor: one pass over the texts, no shuffle of lines or texts.
* Beyond that, the distinct hashes of each document go to the shards; a shard
  that more than ``PROBES`` of them ask is copied, so that a line in a third of
  all documents is spread over tasks.  What is to be dropped comes back by
  document, only for documents that lose something.

Defined results: null text counts as one empty line and stays null; rows that
share a doc_id are one document (none of them loses a line that only they
hold); rows without a doc_id are one document after all others; repeated rows
are alike; other columns stay as they are, but columns that have the names of
the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.blocks import runs
from vellum.llm.scratch import Scratch, fresh, partitions

LEAST = 10
#: Hashes of one shard, about.
SHARD = 1 << 16
#: Bits a hash not yet placed has on a level.
ROOM = 2
#: Bytes of an index that is sent to every executor.
SHIPPED = 32 << 20
#: Probes that one copy of a shard answers, about.
PROBES = 1 << 20
NOBODY = (1 << 63) - 1
WHITE = b" \t\n\x0b\x0c\r"


def keys_of(text: bytes) -> list[bytes | None]:
    """The key of each line; None for those that are too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(WHITE).lower()  # of bytes: A-Z only
        n = len(key)
        out.append(key if n >= LEAST and (n >= 4 * LEAST or len(key.decode()) >= LEAST) else None)
    return out


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").reshape(-1, 2)
    return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)


# --- minimal perfect hash ----------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer over 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = _mix(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (_mix(a.view(np.uint64) ^ _mix(b.view(np.uint64) + seed)) % np.uint64(size)).astype(np.int64)


class Shard:
    """Bit levels, ranks and arrays of one shard; ``dump`` and ``load`` are its binary form."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray, owners: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.prints, self.owners, self.counts = sizes, bits, prints, owners, counts
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, owners: np.ndarray, counts: np.ndarray) -> Shard:
        """From distinct hashes (a, b)."""
        sizes, levels, left = [], [], np.arange(len(a))
        while len(left):
            size = -(-ROOM * len(left) // 64) * 64
            spot = _spot(a[left], b[left], len(sizes), size)
            alone = np.bincount(spot, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[spot]]
        out = cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64), b, owners, counts)
        at = out.rank(a, b)
        for name, values in (("prints", b), ("owners", owners), ("counts", counts)):
            placed = np.empty_like(values)
            placed[at] = values
            setattr(out, name, placed)
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each hash, a permutation over those the shard was built from; -1 for some others."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            bit = self.starts[level] + _spot(a[left], b[left], level, size)
            word, low = bit >> 6, (bit & 63).astype(np.uint64)
            here = self.bits[word]
            hit = (here >> low) & np.uint64(1) == 1
            below = np.bitwise_count(here & ((np.uint64(1) << low) - np.uint64(1)))
            out[left[hit]] = (self.ranks[word] + below)[hit]
            left = left[~hit]
        return out

    def probe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each hash that the shard holds, -1 for all others."""
        at = self.rank(a, b)
        if not len(self.prints):
            return at
        return np.where((at >= 0) & (self.prints[at] == b), at, -1)

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.bits), len(self.prints)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.sizes, self.bits, self.prints, self.owners, self.counts))

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        levels, words, n = np.frombuffer(raw, np.int64, 3).tolist()
        at, out = 24, []
        for kind, count in ((np.int64, levels), (np.uint64, words), (np.int64, n), (np.int64, n), (np.uint16, n)):
            out.append(np.frombuffer(raw, kind, count, at))
            at += out[-1].nbytes
        return cls(*out)


# --- index -------------------------------------------------------------------


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, a, b): the distinct hashes of each row."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1)
        for lo, hi in _stretches(texts):
            each, keys = [], []
            for r in range(lo, hi):
                own = dict.fromkeys(keys_of(texts[r].as_buffer().to_pybytes()))
                own.pop(None, None)
                keys += own
                each.append(len(own))
            if keys:
                a, b = _halves(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo:hi], each)), pa.array(a), pa.array(b)], names=["id", "a", "b"])


def _stretches(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Rows of a batch in stretches of about ``most`` bytes of text."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(size):
        before = int(size[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + most, side="right")))
        yield lo, hi
        lo = hi


def _shards(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, ("shard",)):
            shard, a, b, owners, counts = (rows.column(c).to_numpy() for c in ("shard", "a", "b", "owner", "n"))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                made = Shard.build(a[s:e], b[s:e], owners[s:e], np.minimum(counts[s:e], 65535).astype(np.uint16)).dump()
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[s])], pa.int32()), pa.array([shards], pa.int32()), pa.array([e - s], pa.int64()), pa.array([made], pa.binary())], names=["shard", "shards", "n", "arrays"])

    return run


def _shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return (a.view(np.uint64) % np.uint64(shards)).astype(np.int32)


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, text): null ids last, null texts empty."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NOBODY)).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def build(docs: DataFrame, text: str = "text", key: str = "doc_id", per_shard: int = SHARD) -> DataFrame:
    """The index of lines that two documents or more hold: (shard, shards, n, arrays), written once."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    lines = _keyed(docs, text, key).mapInArrow(_lines, "id long, a long, b long")
    found = lines.groupBy("a", "b").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("n")).filter("owner < last")
    found = scratch.write(found.select("a", "b", "owner", "n"), "repeated")
    shards = max(1, -(-found.count() // per_shard))
    # the shard by the unsigned first half, as in _shard_of
    high, low = F.shiftrightunsigned("a", 32), F.col("a").bitwiseAND(F.lit((1 << 32) - 1))
    shard = ((high % shards) * F.lit((1 << 32) % shards) + low % shards) % shards
    dealt = found.withColumn("shard", shard.cast("int")).repartition(partitions(spark), "shard").sortWithinPartitions("shard")
    return scratch.write(dealt.mapInArrow(_shards(shards), "shard int, shards int, n long, arrays binary"), "index")


# --- probes ------------------------------------------------------------------


def _without(text: bytes, drop) -> tuple[bytes | None, int, int]:
    """(text without the lines that ``drop(key)`` names or None if all stay, lines, lines dropped)."""
    keys = keys_of(text)
    gone = {k for k in dict.fromkeys(keys) if k is not None and drop(k)}
    if not gone:
        return None, len(keys), 0
    kept = [line for line, k in zip(text.split(b"\n"), keys, strict=True) if k not in gone]
    return b"\n".join(kept), len(keys), len(keys) - len(kept)


def _finish(batch: pa.RecordBatch, text: str, names: list[str], results: list[tuple[bytes | None, int, int]]) -> pa.RecordBatch:
    """The named columns of a batch with new texts and the two counts."""
    old = batch.column(text)
    new, lines, dropped = zip(*results, strict=True)
    if any(t is not None for t in new):
        changed = pa.array([t is not None for t in new])
        texts = pc.if_else(changed, pa.array(new, pa.binary()).cast(pa.string()), old)
    else:
        texts = old
    columns = [texts if c == text else batch.column(c) for c in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])


def _text_bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _here(index, shards: int, text: str, id_: str, names: list[str]):
    """Probe the whole index, which every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: Shard.load(raw) for s, raw in index.value}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(id_).to_numpy(), batch.column(text)
            results = []
            for lo, hi in _stretches(texts.fill_null("")):
                whole = [_text_bytes(texts[r]) for r in range(lo, hi)]
                own = [[k for k in dict.fromkeys(keys_of(t)) if k is not None] for t in whole]
                flat = [k for ks in own for k in ks]
                gone = np.zeros(len(flat), bool)
                if flat:
                    a, b = _halves(flat)
                    owner = np.repeat(ids[lo:hi], [len(ks) for ks in own])
                    shard = _shard_of(a, shards)
                    order = np.argsort(shard, kind="stable")
                    bounds = np.flatnonzero(np.diff(shard[order], prepend=-1, append=shards))
                    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        some = order[s:e]
                        if (one := held.get(int(shard[some[0]]))) is not None:
                            at = one.probe(a[some], b[some])
                            gone[some] = (at >= 0) & (one.owners[at] != owner[some])
                at = 0
                for t, ks in zip(whole, own, strict=True):
                    drop = {k for k, g in zip(ks, gone[at : at + len(ks)].tolist(), strict=True) if g}
                    results.append(_without(t, drop.__contains__) if drop else (None, t.count(b"\n") + 1, 0))
                    at += len(ks)
            yield _finish(batch, text, names, results)

    return run


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k1, k2, a, b, salt): the distinct hashes of each row with the row's key; salts spread them, repeated rows too."""
    done = 0
    for batch in batches:
        ids, texts, k1, k2 = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for lo, hi in _stretches(texts):
            own = [[k for k in dict.fromkeys(keys_of(texts[r].as_buffer().to_pybytes())) if k is not None] for r in range(lo, hi)]
            each = [len(ks) for ks in own]
            if sum(each):
                a, b = _halves([k for ks in own for k in ks])
                salt = np.arange(done, done + len(a))
                done += len(a)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*(np.repeat(x[lo:hi], each) for x in (ids, k1, k2)), a, b, salt)], names=["id", "k1", "k2", "a", "b", "salt"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, b) of hashes that go; rows come by shard and copy, the arrays before what asks them."""
    held, now = None, None
    for batch in batches:
        shard, copy, raw = batch.column("shard").to_numpy(), batch.column("copy").to_numpy(), batch.column("arrays")
        change = np.flatnonzero((np.diff(shard, prepend=shard[:1]) != 0) | (np.diff(copy, prepend=copy[:1]) != 0)) if batch.num_rows else []
        bounds = [0, *change, batch.num_rows]
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if s == e:
                continue
            group = (int(shard[s]), int(copy[s]))
            if group != now:
                held, now = None, group
            if raw[s].is_valid:
                held, s = Shard.load(raw[s].as_py()), s + 1
            if held is None or s == e:
                continue  # a shard without arrays: nothing of it repeats
            part = batch.slice(s, e - s)
            a, b, ids = (part.column(c).to_numpy() for c in ("a", "b", "id"))
            at = held.probe(a, b)
            gone = (at >= 0) & (held.owners[at] != ids) if len(held.prints) else np.zeros(len(a), bool)
            if gone.any():
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(gone)) for c in ("k1", "k2", "b")], names=["k1", "k2", "b"])


def _told(text: str, names: list[str], gone: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, lists = batch.column(text), batch.column(gone)
            results = []
            for r in range(batch.num_rows):
                whole = _text_bytes(texts[r])
                if lists[r].is_valid:
                    drop = set(lists[r].values.to_pylist())
                    results.append(_without(whole, lambda k: int.from_bytes(xxhash.xxh3_128_digest(k)[8:], "big", signed=True) in drop))  # noqa: B023
                else:
                    results.append((None, whole.count(b"\n") + 1, 0))
            yield _finish(batch, text, names, results)

    return run


def drop_repeated(docs: DataFrame, index: DataFrame | None = None, text: str = "text", key: str = "doc_id", shipped: int = SHIPPED, probes: int = PROBES) -> DataFrame:
    """``docs`` with ``text`` without lines that a smaller document holds, ``n_lines`` and ``n_dropped``.

    ``index`` is what ``build`` gave, by default for the same documents.
    """
    spark = docs.sparkSession
    index = build(docs, text, key) if index is None else index
    known = index.agg(F.sum(F.length("arrays")).alias("size"), F.max("shards").alias("shards")).first()
    shards = known["shards"] or 1
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", n_lines long, n_dropped long"
    id_ = fresh(rows, "id")
    owner = F.coalesce(F.col(key).cast("long"), F.lit(NOBODY))
    if (known["size"] or 0) <= shipped:
        sent = spark.sparkContext.broadcast([(r["shard"], bytes(r["arrays"])) for r in index.select("shard", "arrays").collect()])
        return rows.withColumn(id_, owner).mapInArrow(_here(sent, shards, text, id_, names), fields)

    scratch = Scratch(spark, "probes")
    k1, k2, gone = (fresh(rows, c) for c in ("k1", "k2", "gone"))
    keyed = rows.withColumns({k1: F.xxhash64(F.lit(1), key, text), k2: F.xxhash64(F.lit(2), key, text)})
    asks = keyed.select(owner.alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.col(k1).alias("k1"), F.col(k2).alias("k2")).mapInArrow(_asks, "id long, k1 long, k2 long, a long, b long, salt long")
    high, low = F.shiftrightunsigned("a", 32), F.col("a").bitwiseAND(F.lit((1 << 32) - 1))
    asks = scratch.write(asks.withColumn("shard", (((high % shards) * F.lit((1 << 32) % shards) + low % shards) % shards).cast("int")), "asks")
    copies = asks.groupBy("shard").agg(F.ceil(F.count("*") / probes).cast("int").alias("copies"))
    dealt = asks.join(copies, "shard").withColumn("copy", (F.col("salt") % F.col("copies")).cast("int"))
    blobs = index.select("shard", "arrays").join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "arrays")
    none = lambda c: F.lit(None).cast("long").alias(c)
    both = blobs.select("shard", "copy", "arrays", *(none(c) for c in ("id", "k1", "k2", "a", "b"))).union(dealt.select("shard", "copy", F.lit(None).cast("binary"), "id", "k1", "k2", "a", "b"))
    met = both.repartition(partitions(spark), "shard", "copy").sortWithinPartitions("shard", "copy", F.col("arrays").isNull())
    answers = met.mapInArrow(_answers, "k1 long, k2 long, b long").groupBy("k1", "k2").agg(F.collect_set("b").alias(gone)).withColumnsRenamed({"k1": k1, "k2": k2})
    return keyed.join(answers, [k1, k2], "left").mapInArrow(_told(text, names, gone), fields)


def digest(dropped: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return dropped.select(key, "n_lines", "n_dropped", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("kept_sha256"))
