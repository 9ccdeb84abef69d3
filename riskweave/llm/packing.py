"""Documents dealt into chunks: compressed blocks that several passes of one plan share through one exchange.

``pack`` deals documents to ``chunk`` by a hash of their id, so a chunk holds the same documents in every pass, on any
executor, after any loss.  ``unpack`` sorts them by (id, text), so every pass also sees them in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.text import id_array, ids, pieces

CHUNK = 12 << 20  # bytes of text in a chunk and, likewise, in what a bucket of hashes stands for


def parts(docs: DataFrame, text: str = "text", size: int = CHUNK) -> int:
    """How many chunks (and buckets) the whole texts need: grows with the input."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(-(-int(total) // size), spark.sparkContext.defaultParallelism)


def pack(docs: DataFrame, chunks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, ids, sizes, blob): one row per chunk and Arrow batch; sizes are bytes, -1 for a null text."""
    chunk = F.pmod(F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(chunks))
    dealt = docs.select(chunk.cast("int").alias("chunk"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, 32 << 20):
            press = zstandard.ZstdCompressor(level=6)
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            chunk = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(chunk)]
            rows = {"chunk": [], "ids": [], "sizes": [], "blob": []}
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                texts = [None if t is None else t.encode() for t in batch.column(2).slice(a, b - a).to_pylist()]
                rows["chunk"].append(int(chunk[a]))
                rows["ids"].append(batch.column(1).slice(a, b - a).to_pylist())
                rows["sizes"].append([-1 if t is None else len(t) for t in texts])
                rows["blob"].append(press.compress(b"".join(t for t in texts if t)))
            yield pa.RecordBatch.from_pydict(rows, schema=wire)

    wire = pa.schema([("chunk", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("blob", pa.binary())])
    return dealt.mapInArrow(fill, "chunk int, ids array<bigint>, sizes array<int>, blob binary")


def squeezed(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches with every text of column ``text`` compressed by itself, for a shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in pieces(batches, text):
        cells = pa.array([None if t is None else press.compress(t.encode()) for t in batch.column(text).to_pylist()], pa.binary())
        columns = [cells if i == text else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def restored(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The opposite of ``squeezed``, in batches of about ``limit`` bytes of text."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        at, held, size = 0, [], 0
        for i, cell in enumerate(batch.column(text)):
            held.append(press.decompress(cell.as_py()) if cell.is_valid else None)
            size += len(held[-1] or b"")
            if size >= limit or i + 1 == batch.num_rows:
                columns = [c.slice(at, len(held)) for c in batch.columns]
                columns[text] = pa.array(held, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
                at, held, size = i + 1, [], 0


class Chunk:
    """The documents of one chunk: ``ids`` (``NULL_ID`` for null) and ``texts`` (bytes; null is empty)."""

    def __init__(self, table: pa.Table):
        got = []
        for k, s, blob in zip(table["ids"].to_pylist(), table["sizes"].to_pylist(), table["blob"].to_pylist()):
            raw = zstandard.ZstdDecompressor().decompress(blob)
            at = 0
            for one, size in zip(ids(pa.array(k, pa.int64())).tolist(), s):
                got.append((one, raw[at : at + max(size, 0)]))
                at += max(size, 0)
        got.sort()
        self.ids = np.array([g[0] for g in got], dtype=np.int64)
        self.texts = [g[1] for g in got]

    def id_array(self) -> pa.Array:
        return id_array(self.ids)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All bytes and n + 1 offsets."""
        offsets = np.zeros(len(self.texts) + 1, np.int64)
        np.cumsum([len(t) for t in self.texts], out=offsets[1:])
        return np.frombuffer(b"".join(self.texts), dtype=np.uint8), offsets


def deal(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of uint64 hashes; positions keep their order within a bucket."""
    bucket = (key >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, positions in zip(found.tolist(), np.split(order, first[1:])):
        yield int(b), positions


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin[i] .. begin[i] + size[i] - 1 of all i in a row."""
    edge = np.cumsum(size)
    return np.arange(edge[-1] if len(edge) else 0) + np.repeat(begin - (edge - size), size)


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def pressed(values: np.ndarray) -> bytes:
    """Whole numbers as one compressed cell, in the narrowest type that holds them all; the first byte names it."""
    values = np.asarray(values, np.int64)
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = next(t for t in "bhiq" if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return kind.encode() + zstandard.ZstdCompressor(level=1).compress(values.astype(kind))


def opened(cell: bytes) -> np.ndarray:
    """The opposite of ``pressed``, as 64-bit numbers."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(cell)[1:]), cell[:1].decode()).astype(np.int64)


def list_rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    """A table of rows whose cells are scalars or numpy arrays, without boxing the elements: lists, or ``pressed`` where the
    field is binary."""
    columns = []
    for i, field in enumerate(schema):
        cells = [r[i] for r in rows]
        if pa.types.is_list(field.type):
            offsets = np.zeros(len(cells) + 1, np.int32)
            np.cumsum([len(c) for c in cells], out=offsets[1:])
            values = np.concatenate(cells) if cells else np.zeros(0)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=field.type.value_type)).cast(field.type))
        elif pa.types.is_binary(field.type):
            columns.append(pa.array([pressed(c) if isinstance(c, np.ndarray) else c for c in cells], type=field.type))
        else:
            columns.append(pa.array(cells, type=field.type))
    return pa.Table.from_arrays(columns, schema=schema)


def lists(table: pa.Table, name: str, dtype=np.int64) -> list[np.ndarray]:
    """The list cells of a column as numpy views, the ``pressed`` ones of a binary column opened."""
    if pa.types.is_binary(table[name].type):
        return [opened(c.as_py()).astype(dtype, copy=False) for c in table[name]]
    out = []
    for chunk in table[name].chunks:
        values = np.asarray(chunk.values.to_numpy(zero_copy_only=False), dtype=dtype)
        edge = chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(edge[:-1], edge[1:])]
    return out
