"""Pages of documents as a data source that reads only what a query asks for.

Filters on ``doc_id`` and ``page_index`` are pushed into the reader.  Row groups
whose statistics rule them out are no partitions; of the others the ids are read
first, and texts only if some id is wanted; of a text only the wanted pages
become rows.  Nothing is kept between reads, so a page read twice is the same.

    register(spark)
    spark.read.format("document_pages").load(path).filter("doc_id = 7 and page_index = 2")
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from vellum.sources.layout import ROWS

SCHEMA = "doc_id bigint, page_index int, lines array<string>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("page_index", pa.int32()), ("lines", pa.list_(pa.string()))])
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Wanted:
    """A range and, if stated, a set of values."""

    low: int = _LOW
    high: int = _HIGH
    values: set[int] | None = None
    null: bool = True  # whether rows without a value pass, as they do where nothing is asked for

    def add(self, f: Filter) -> bool:
        """Narrow to what ``f`` lets pass; False if it can't be told here."""
        if isinstance(f, EqualTo):
            f = In(f.attribute, (f.value,))
        if isinstance(f, In):
            values = {v for v in f.value if v is not None}
            self.values = values if self.values is None else self.values & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
        elif not isinstance(f, IsNotNull):
            return False
        self.null = False
        return True

    def of(self, x: np.ndarray) -> np.ndarray:
        inside = (x >= self.low) & (x <= self.high)
        return inside if self.values is None else inside & np.isin(x, np.array(sorted(self.values), np.int64))

    def of_column(self, x: pa.Array) -> np.ndarray:
        known = x.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, self.of(x.fill_null(0).to_numpy()), self.null)

    def may(self, least: int, most: int) -> bool:
        """Whether a group of values from ``least`` to ``most`` can hold a wanted one."""
        return least <= self.high and most >= self.low and (self.values is None or any(least <= v <= most for v in self.values))


@dataclass
class Group(InputPartition):
    path: str
    group: int
    size: int  # bytes of the two columns in the file


@dataclass
class PageReader(DataSourceReader):
    path: str
    wanted: dict[str, Wanted] = field(default_factory=lambda: {"doc_id": Wanted(), "page_index": Wanted()})

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name not in self.wanted or not self.wanted[name].add(f):
                yield f

    def partitions(self) -> list[Group]:
        system, root = _place(self.path)
        info = system.get_file_info(root)
        files = [root] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet"))
        found = []
        for path in files:
            meta = pq.read_metadata(path, filesystem=system)
            at = {meta.schema.column(c).path: c for c in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                ids, text = (meta.row_group(g).column(at[c]) for c in ("doc_id", "text"))
                s = ids.statistics
                if s is None or not s.has_min_max or self.wanted["doc_id"].may(s.min, s.max) or self.wanted["doc_id"].null and s.null_count:
                    found.append(Group(path, g, ids.total_compressed_size + text.total_compressed_size))
        return found

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        with pq.ParquetFile(partition.path, filesystem=system) as file:
            ids = file.read_row_group(partition.group, columns=["doc_id"]).column(0).combine_chunks()
            hit = self.wanted["doc_id"].of_column(ids)
            if not hit.any():
                return
            texts = file.read_row_group(partition.group, columns=["text"]).column(0)
        rows, size = [], 0
        for k in np.flatnonzero(hit).tolist():
            text = texts[k].as_py()
            if text is None:
                continue
            lines = text.split("\n")
            pages = np.arange(-(-len(lines) // ROWS))
            for p in pages[self.wanted["page_index"].of(pages)].tolist():
                rows.append((ids[k].as_py(), p, lines[p * ROWS : (p + 1) * ROWS]))
            size += len(text)
            if size > 1 << 22:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class DocumentPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentPages)
