"""Progressive page index: pages of documents arrive in chunks, the search result grows with them.

A document's state holds the generation it is at and what each page gave.  A
page of a newer generation drops the state, pages of older ones are ignored,
and a page that comes again changes nothing.  After each chunk a document tells
how many pages are indexed and how many matches stand on them; once, when all
pages of its generation are there, it gives the final pass.

Matches are counted by array kernels before pages travel to their document, so
texts don't.  State is kept page by page in a map under the document's key, so a
chunk reads and writes only its own pages, whatever the document's size; a
document that is new asks for none.  One transformation for stream and batch; streams need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vellum.operators.folding import fold, points, stretches

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCHEMA = "doc_id long, generation long, indexed int, pages int, matches long, final boolean"


def _counted(query: str):
    """Pages with ``matches``, the non-overlapping ones in their lines, in place of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = fold(*points([query])).texts()[0]
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in stretches(texts):
                found = [0] * (hi - lo)
                if wanted:
                    owner, lines = [], []
                    for k, t in enumerate(texts.slice(lo, hi - lo).to_pylist()):
                        some = (t or "").split("\n")
                        lines += some
                        owner += [k] * len(some)
                    for k, norm in zip(owner, fold(*points(lines)).texts(), strict=True):
                        found[k] += norm.count(wanted)
                rest = batch.slice(lo, hi - lo).select(_PAGE)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.int64())], names=[*_PAGE, "matches"])

    return run


_PAGE = ["doc_id", "generation", "page_index", "pages"]


class _Index(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "generation long, indexed int, matches long, done boolean")
        self.pages = handle.getMapState("pages", "page_index int", "matches long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        stored = self.now.exists()
        held = self.now.get() if stored else (-1, 0, 0, False)
        generation, indexed, matches, done = (int(held[0]), int(held[1]), int(held[2]), bool(held[3]))
        total, new = 0, {}  # pages of this chunk
        for frame in rows:
            given = [frame[c].tolist() for c in ("generation", "page_index", "pages", "matches")]
            newest = max(given[0])
            if newest > generation:
                if stored:
                    self.pages.clear()
                generation, indexed, matches, done, stored, new = newest, 0, 0, False, False, {}
            begun = len(new)
            for g, p, pages, n in zip(*given, strict=True):
                if g == generation and p not in new and not (stored and self.pages.containsKey((int(p),))):
                    total = total if len(new) > begun else int(pages)
                    new[p] = n
        if new:
            indexed, matches = indexed + len(new), matches + sum(new.values())
            for p, n in new.items():
                self.pages.updateValue((int(p),), (int(n),))
            final = not done and indexed >= total
            self.now.update((generation, indexed, matches, done or final))
            yield pd.DataFrame({"doc_id": [key[0]], "generation": [generation], "indexed": [indexed], "pages": [total], "matches": [matches], "final": [final]})

    def close(self) -> None:
        pass


def indexed(pages: DataFrame, query: str) -> DataFrame:
    """(doc_id, generation, indexed, pages, matches, final) after each chunk of ``pages(doc_id, generation, page_index, pages, text)``.

    ``pages`` is how many the document has in that generation, ``text`` a page's lines.
    """
    if not pages.isStreaming:
        pages.sparkSession.streams.active  # noqa: B018 - a batch finds the coordinator of state only after its first use
    kept = "".join(f"{c} {pages.schema[c].dataType.simpleString()}, " for c in _PAGE)
    rows = pages.select(*_PAGE, "text").mapInArrow(_counted(query), f"{kept}matches long")
    return rows.groupBy("doc_id").transformWithStateInPandas(_Index(), SCHEMA, "Update", "None")
