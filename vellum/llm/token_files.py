"""Operator 1: token ids in binary segments with Elias-Fano document boundaries.

A token set is a Parquet dataset whose rows are *segments*.  The container
gives atomic commits (a retried or speculative task leaves no double output)
on any file system Spark reaches; the payload is this module's own format::

    magic "VTF1" | id width (1 byte: 2 or 4) | n_null (u32) | n_docs (u32)
    | n_ids (u64) | doc ids: Elias-Fano | boundaries: Elias-Fano | ids

Boundaries are the documents' end offsets within the segment.  An Elias-Fano
sequence of n values below u keeps ``floor(log2(u/n))`` low bits of each value
packed, and the high parts in unary in about 2n bits; a sampled select
directory (one u32 for every 64 values) finds any boundary without a table of
64-bit offsets.  ``read_tokens`` streams a set; ``lookup`` gives the ids of
stated documents by select alone: a search over the doc ids, two boundaries.

Ranges are cut by (doc_id, hash of the text, row), so documents of one id, null
included, are spread like any others.

Defined results: null text is empty (only the end id); null doc_id sorts
first and comes back as null; repeated doc_ids keep all their rows, ordered by
a hash of the text; an empty table gives an empty set.  Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.scratch import Scratch, partitions
from vellum.llm.tokens import WordEncoder, encoder

MAGIC = b"VTF1"
#: Select directory: one entry for so many values.
SELECT_EVERY = 64
#: A segment is closed when it holds so many ids; a longer document has its own.
SEGMENT_IDS = 2_000_000
END_ID = 1

#: Documents of one ``lookup`` at most: a stated list, sent to each task.
LOOKUP = 100_000

SEGMENT_SCHEMA = "shard int, seg int, shard_start long, n_docs int, n_ids long, first_doc long, last_doc long, payload binary"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of unsigned integers below 2**63."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        top = int(v[-1]) + 1
        low_bits = max(0, (top // n).bit_length() - 1)
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SELECT_EVERY].astype("<u4"))

    def _low(self, first: int, count: int) -> np.ndarray:
        b = self.low_bits
        if not b:
            return np.zeros(count, np.uint64)
        at = first * b
        bits = np.unpackbits(self.low[at // 8 : (at + count * b + 7) // 8], bitorder="little")[at % 8 :][: count * b]
        return (bits.reshape(count, b).astype(np.uint64) << np.arange(b, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i: one directory entry, then at most the bits up to the next."""
        at = int(self.directory[i // SELECT_EVERY])
        end = int(self.directory[i // SELECT_EVERY + 1]) if i // SELECT_EVERY + 1 < len(self.directory) else len(self.high) * 8 - 1
        bits = np.unpackbits(self.high[at // 8 : end // 8 + 1], bitorder="little")[at % 8 :]
        one = at + int(np.flatnonzero(bits)[i % SELECT_EVERY])
        return ((one - i) << self.low_bits) | int(self._low(i, 1)[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(0, self.n)

    def dump(self) -> bytes:
        head = struct.pack("<IBIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.directory))
        return head + self.low.tobytes() + self.high.tobytes() + self.directory.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<IBIII", data, at)
        at += struct.calcsize("<IBIII")
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        directory = np.frombuffer(data, "<u4", c, at + a + b)
        return cls(n, low_bits, low, high, directory), at + a + b + 4 * c


class Segment:
    """One payload; ``doc_ids``/``ids(i)`` give documents without decoding the rest."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        width, self.n_null, self.n_docs, self.n_ids = struct.unpack_from("<BIIQ", payload, 4)
        at = 4 + struct.calcsize("<BIIQ")
        (self._base,) = struct.unpack_from("<q", payload, at)
        self._ids, at = EliasFano.load(payload, at + 8)
        self.ends, at = EliasFano.load(payload, at)
        self._flat = np.frombuffer(payload, f"<u{width}", self.n_ids, at)

    @staticmethod
    def dump(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
        n_null = sum(d is None for d in doc_ids)
        known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
        base = int(known[0]) if len(known) else 0
        ends = np.cumsum([len(x) for x in ids])
        flat = np.concatenate(ids)
        width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
        offsets = known.view(np.uint64) - np.array([base], np.int64).view(np.uint64)
        head = MAGIC + struct.pack("<BIIQ", width, n_null, len(doc_ids), len(flat)) + struct.pack("<q", base)
        return head + EliasFano.build(offsets).dump() + EliasFano.build(ends).dump() + flat.astype(f"<u{width}").tobytes()

    def doc_ids(self) -> list[int | None]:
        known = (self._ids.all() + np.array([self._base], np.int64).view(np.uint64)).view(np.int64)
        return [None] * self.n_null + known.tolist()

    def find(self, doc_id: int) -> list[int]:
        """Places of a document id: binary search by select."""
        n = self._ids.n
        if not n or doc_id < self._base:
            return []
        want, lo, hi = doc_id - self._base, 0, n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self._ids.select(mid) < want else (lo, mid)
        last = lo
        while last < n and self._ids.select(last) == want:
            last += 1
        return [self.n_null + k for k in range(lo, last)]

    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], self.ends.all().astype(np.int64)])

    def ids(self, i: int) -> np.ndarray:
        """Document i's ids, by two selects."""
        return self._flat[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def flat(self) -> np.ndarray:
        return self._flat


def _segments(path: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(WordEncoder, path)
        end = np.array([end_id], dtype="<u4").tobytes()
        shard, seg, done, held = None, 0, 0, 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seg, done, held
            known = [d for d in docs[:1] + docs[-1:] if d is not None] or [None]
            first = next((d for d in docs if d is not None), None)
            row = [[shard], [seg], [done], [len(docs)], [held], [first], [known[-1]], [Segment.dump(docs, ids)]]
            seg, done, held = seg + 1, done + held, 0
            docs.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "seg", "shard_start", "n_docs", "n_ids", "first_doc", "last_doc", "payload"])

        for batch in batches:
            if shard is None and batch.num_rows:
                shard = batch.column("shard")[0].as_py()
            texts = (t.as_py() for t in batch.column("text").cast(pa.binary()))
            for doc, found in zip(batch.column("doc_id").to_pylist(), enc.encode_many(texts), strict=True):
                one = np.frombuffer(found + end, "<u4")
                if docs and held + len(one) > limit:
                    yield close()
                docs.append(doc)
                ids.append(one)
                held += len(one)
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs(doc_id, text)`` with the tokenizer file ``path``; write the set ``out`` in ascending doc_id order.

    One range shuffle of the texts; each range is one shard, written by one task as it encodes.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(n, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text", F.spark_partition_id().alias("shard"))
    ranged.mapInArrow(_segments(path, end_id, segment_ids), SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(out)


def _rows(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, at, payload in zip(batch.column("shard").to_pylist(), batch.column("shard_start").to_pylist(), batch.column("payload"), strict=True):
                s = Segment(payload.as_py())
                bounds, flat = s.bounds(), s.flat().astype("<u4")
                crcs = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids(), pa.int64()), pa.array(base[shard] + at + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """One row a document: doc_id, start (ids before it in the set), n_tokens, ids_crc32.

    The driver gets one number a shard (as many as shuffle partitions).
    """
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(out)
    sizes = dict(files.groupBy("shard").agg(F.sum("n_ids")).collect())
    base, total = {}, 0
    for shard in sorted(sizes):
        base[shard] = total
        total += sizes[shard]
    return files.select("shard", "shard_start", "payload").mapInArrow(_rows(base), ROW_SCHEMA)


def _lookup(wanted: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ids = [], []
            for first, last, payload in zip(batch.column("first_doc").to_pylist(), batch.column("last_doc").to_pylist(), batch.column("payload"), strict=True):
                some = wanted[bisect_left(wanted, first) : bisect_right(wanted, last)]
                s = Segment(payload.as_py()) if some else None
                for doc in some:
                    for i in s.find(doc):
                        docs.append(doc)
                        ids.append(s.ids(i).astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return run


def lookup(spark: SparkSession, out: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a stated list of documents; segments of other ranges are not read."""
    wanted = sorted(set(doc_ids))
    if len(wanted) > LOOKUP:
        raise ValueError(f"at most {LOOKUP} documents at once")
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(out)
    some = files.filter((F.col("last_doc") >= (wanted or [0])[0]) & (F.col("first_doc") <= (wanted or [-1])[-1]))
    return some.select("first_doc", "last_doc", "payload").mapInArrow(_lookup(wanted), "doc_id long, ids array<long>")


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Write a set in the session's shared folder and read it back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    out = scratch.place("set")
    write_tokens(docs, out, path)
    return read_tokens(docs.sparkSession, out)
