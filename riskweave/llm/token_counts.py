"""Token counts per section by offset-mapped attribution.

Each whole document is encoded once.  The bytes of its tokens, one after another, are the document, so cumulative token
lengths are token spans; they are joined with the spans of the sections by binary search.  A token that crosses a
boundary belongs to the section that holds most of its bytes, the earlier one if two hold as many.  Sections of a
document: its lines, each with its line feed.

Edge rows: null and empty texts have one empty section without tokens; rows that repeat a doc_id are counted one by one;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.packing import list_rows
from riskweave.llm.text import buffers, pieces


def attribute(ends: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) per section: ``ends`` are the tokens' end bytes, ``borders`` the sections' (the last
    included); a token counts where most of its bytes lie, ties go to the earlier section."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(borders, starts, side="right")
    last = np.searchsorted(borders, ends, side="left")
    crossing = np.flatnonzero(first < last)
    for i in crossing.tolist():
        edges = np.concatenate([[starts[i]], borders[first[i] : last[i]], [ends[i]]])
        first[i] += int(np.argmax(np.diff(edges)))
    n = len(borders)
    return np.bincount(first, minlength=n)[:n], np.bincount(first[crossing], minlength=n)[:n]


def section_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, n_crossing): one row per document and section."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as long as the vocabulary
    names = ["start_char", "end_char", "n_tokens", "n_crossing"]
    wire = pa.schema([("doc_id", pa.int64()), *((n, pa.list_(pa.int64())) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        width = np.zeros(max(shared.value.values(), default=0) + 1, np.int64)
        for token, i in shared.value.items():
            width[i] = len(token)
        for batch in pieces(batches, 1, 1 << 20):
            data, offsets = buffers(batch.column(1))
            rows = []
            for i, (one, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                raw = data[offsets[i] : offsets[i + 1]]
                ends = np.cumsum(width[np.array(encoder.encode_ordinary(text or ""), np.int64)])
                borders = np.flatnonzero(raw == 10) + 1
                if not len(borders) or borders[-1] != len(raw):
                    borders = np.append(borders, len(raw))
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[borders]
                n, crossing = attribute(ends, borders)
                rows.append((one, np.concatenate([[0], chars[:-1]]), chars, n, crossing))
            yield from list_rows(wire, rows).to_batches()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, start_char array<bigint>, end_char array<bigint>, n_tokens array<bigint>, n_crossing array<bigint>"
    )
    each = counted.select("doc_id", F.posexplode(F.arrays_zip(*names)).alias("section", "x"))
    return each.select("doc_id", F.col("section").cast("long").alias("section"), *[F.col(f"x.{n}").alias(n) for n in names])
