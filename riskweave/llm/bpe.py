"""Byte-level BPE by a global distinct-word shuffle.

Documents travel once, in compressed chunks.  Each chunk is split into pre-tokens with their positions; its distinct
pre-tokens go to buckets, where each distinct word of the whole corpus is encoded exactly once; the ids return to the
chunk and the documents are put together by position.  Decoding joins ids with the token-byte table (as long as the
vocabulary, a fixed size).  Equal to encoding whole texts, as a pre-token's ids don't depend on its surroundings.

Edge rows: a null or empty text has no ids and decodes to nothing; special-token strings are ordinary text; rows that
repeat a doc_id stay separate rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.packing import Chunk, deal, list_rows, lists, pack, parts, spans
from riskweave.llm.text import Hasher, buffers

WORDS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("words", pa.list_(pa.string()))])
CODES = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("n", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


# Fixed value: the usual byte-level pattern, for which ``Splitter`` also has a vectorised form.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Splitter:
    """Cuts texts into pre-tokens.  The pattern must match every character.

    The usual pattern on texts of ASCII and Latin-1 letters is applied to all texts at once by character classes; any
    other text or pattern goes through the regex library.  Both give the same pieces.
    """

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).finditer
        self.plain = pattern == USUAL
        kind = np.full(256, 4, np.uint8)  # 0 space, 1 other white space, 2 letter, 3 digit, 4 other, 5 not handled here
        kind[32], kind[[9, 10, 11, 12, 13]] = 0, 1
        kind[65:91] = kind[97:123] = kind[128:192] = 2
        kind[48:58] = 3
        kind[[*range(9), *range(14, 32), 127]] = 5
        kind[192:] = 5
        kind[0xC3] = 2
        self.kind = kind

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte offsets where the pieces of all texts begin, and the end of the data."""
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        if not len(data):
            return np.zeros(1, np.int64)
        kind = self.kind[data]
        odd = kind == 5
        late = data[1:] & 0xC0 == 0x80  # continuation bytes must follow 0xC3 and be letters
        odd[1:] |= late & ((data[:-1] != 0xC3) | (data[1:] == 0x97) | (data[1:] == 0xB7))
        strange = np.zeros(len(offsets) - 1, bool)
        if self.plain:
            strange[np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)] = True
            self._classes(data, kind, begin)
        else:
            strange[:] = True
        for i in np.flatnonzero(strange).tolist():
            a, b = int(offsets[i]), int(offsets[i + 1])
            begin[a + 1 : b] = False
            text = data[a:b].tobytes().decode()
            at = a
            for m in self.find(text):
                begin[at] = True
                at += len(m[0].encode())
            if at != b:
                raise ValueError("the pattern leaves out characters")
        begin[-1] = True
        return np.flatnonzero(begin)

    @staticmethod
    def _classes(data: np.ndarray, kind: np.ndarray, begin: np.ndarray) -> None:
        first = begin[:-1].copy()  # of each text
        group = np.maximum(kind, 1)
        change = np.empty(len(data), bool)
        change[0] = True
        np.not_equal(group[1:], group[:-1], out=change[1:])
        # a run that isn't white space, after white space of its own text
        after = np.flatnonzero(change[1:] & (group[1:] > 1) & (group[:-1] == 1) & ~first[1:]) + 1
        begin[:-1] |= change
        begin[after - 1] = True  # the last white space stands alone ...
        begin[after[kind[after - 1] == 0]] = False  # ... or, a space, opens the run
        quote = np.flatnonzero((data == 39) & begin[:-1])
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        edge = np.concatenate([first, np.ones(2, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        near = ~edge[quote + 1]
        short = near & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pairs = (one.astype(np.uint16) << 8) | two
        long = near & ~edge[quote + 2] & np.isin(pairs, [ord(x) << 8 | ord(y) for x, y in ("re", "ve", "ll")])
        for hit, size in ((short, 2), (long, 3)):
            q = quote[hit]
            begin[q + 1] = False
            begin[q + size] = True


class Pieces:
    """The pre-tokens of a chunk: ``words`` (distinct, in order of appearance), ``index`` (of each piece), ``first`` (piece
    offsets of the texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, splitter: Splitter):
        cuts = splitter.cuts(data, offsets)
        every = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
        coded = every.dictionary_encode()
        self.words, self.index = coded.dictionary, coded.indices.to_numpy()
        self.first = np.searchsorted(cuts, offsets)

    def buckets(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, positions of its words), in order of the words, which compresses better."""
        data, edge = buffers(self.words)
        order = pc.sort_indices(self.words).to_numpy().astype(np.int64)
        for bucket, p in deal(Hasher().hashes(data, edge[:-1], edge[1:])[order], n):
            yield bucket, order[p]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) per row of ``docs``."""
    n = parts(docs, text)
    packed = pack(docs, n, doc_id, text)
    table_of_ranks = docs.sparkSession.sparkContext.broadcast(ranks)  # as long as the vocabulary

    def split(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = Pieces(*Chunk(table).flat(), Splitter(pattern))
        dealt = list(x.buckets(n))
        edge = np.cumsum([0, *(len(p) for _, p in dealt)]).astype(np.int32)
        words = x.words.take(pa.array(np.concatenate([p for _, p in dealt]) if dealt else np.zeros(0, np.int64))).cast(pa.string())
        cells = pa.ListArray.from_arrays(pa.array(edge), words).cast(WORDS.field("words").type)
        return pa.Table.from_arrays([pa.array([b for b, _ in dealt], pa.int32()), pa.array([key[0].as_py()] * len(dealt), pa.int32()), cells], schema=WORDS)

    def code(table: pa.Table) -> pa.Table:
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_of_ranks.value, special_tokens={})
        cells = [x for c in table["words"].chunks for x in c]
        flat = pa.concat_arrays([c.values for c in cells if c.values is not None]).dictionary_encode()
        coded = [np.array(encoder.encode_ordinary(w), np.int32) for w in flat.dictionary.to_pylist()]  # each distinct word once
        place = flat.indices.to_numpy()
        rows, at = [], 0
        for chunk, bucket, cell in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), cells):
            own = [coded[i] for i in place[at : at + len(cell.values)]]
            at += len(own)
            rows.append((chunk, bucket, np.array([len(x) for x in own], np.int32), np.concatenate(own)))
        return list_rows(CODES, rows)

    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        chunk = Chunk(table)
        x = Pieces(*chunk.flat(), Splitter(pattern))
        said = dict(zip(replies["bucket"].to_pylist(), zip(lists(replies, "n", np.int64), lists(replies, "ids", np.int32))))
        order, size, flat = [], [], []
        for bucket, positions in x.buckets(n):
            if bucket not in said or len(said[bucket][0]) != len(positions):
                raise RuntimeError("words without an answer: the documents changed between two passes")
            order.append(positions)
            size.append(said[bucket][0])
            flat.append(said[bucket][1])
        none = np.zeros(0, np.int64)
        order, size, flat = (np.concatenate([none, *v]) for v in (order, size, flat))
        width, begin = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        width[order], begin[order] = size, np.cumsum(size) - size
        flat = flat.astype(np.int32)
        cells = []
        for a, b in zip(x.first[:-1].tolist(), x.first[1:].tolist()):
            own = x.index[a:b]
            cells.append(flat[spans(begin[own], width[own])])
        return list_rows(out, list(zip(chunk.id_array().to_pylist(), cells)))

    words = packed.groupBy("chunk").applyInArrow(split, "bucket int, chunk int, words array<string>")
    codes = words.groupBy("bucket").applyInArrow(code, "chunk int, bucket int, n array<int>, ids array<int>")
    return packed.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(gather, "doc_id bigint, ids array<int>")


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` (doc_id, ids) with the bytes that the ids stand for; a null list decodes to no bytes."""
    tokens = rows.sparkSession.sparkContext.broadcast(ranks)
    wire = pa.schema([("doc_id", pa.int64()), (ids, pa.list_(pa.int32())), (into, pa.binary())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(tokens.value.values(), default=-1) + 1
        width, begin, every = np.zeros(size, np.int64), np.zeros(size, np.int64), bytearray()
        for token, i in tokens.value.items():
            width[i], begin[i] = len(token), len(every)
            every += token
        every = np.frombuffer(bytes(every), np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                cells = [c.values.to_numpy() if c.is_valid else np.zeros(0, np.int32) for c in part.column(1)]
                decoded = [b"".join(every[spans(begin[x], width[x])].tobytes() for x in np.split(c, range(1 << 18, len(c), 1 << 18))) for c in cells]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(wire.field(1).type), pa.array(decoded, pa.binary())], schema=wire)

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids)).mapInArrow(join, f"doc_id bigint, {ids} array<int>, {into} binary")
