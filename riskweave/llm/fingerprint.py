"""Document fingerprints: MinHash signatures by universal hashing, in vectorised numpy.

A text's words (A-Z folded) form five-word shingles; each of ``PERMUTATIONS`` multiply-add hashes modulo 2**64 keeps its
smallest value, of which 16 mixed bits enter the fingerprint (hex).  The likeness of two fingerprints is the share of equal
places, an estimate of the Jaccard similarity of the shingle sets.  ``similar`` joins bands of the signature in Spark and
confirms candidates on full shingle sets; ``fingerprints_and_classes`` gives both per row.

Edge rows: null is the empty text; a text without words has the empty fingerprint, like (1.0) another such and unlike
(0.0) all others; with fewer than five words the whole sequence is one shingle; rows are ordered by doc_id (null first),
equal doc_ids by text; a table of one row is followed by itself; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.llm.near_dedup import grouped, linked
from riskweave.llm.packing import list_rows, parts, restored, signed, squeezed
from riskweave.llm.text import Hasher, U, buffers, grams, mix, pieces, shingles, stream
from riskweave.session import cut

SHINGLE, PERMUTATIONS = 5, 128
BAND = 4  # places in a band; 32 bands miss a pair at 0.8 with probability 5e-8
HEAD = 64  # characters of a text that Spark sorts by
SLICES = 20_000  # bounds the list of slice borders on the driver; a slice is sorted and streamed, never held


class MinHash:
    def __init__(self, k: int = SHINGLE, n: int = PERMUTATIONS):
        self.k, self.n, self.hasher = k, n, Hasher(lower=True)
        self.a, self.b = stream(21, n) | U(1), stream(22, n)

    def signatures(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows x n) uint16 signatures, and which rows have a shingle."""
        words = self.hasher.words(*buffers(texts))
        counts, first = words.counts, words.first
        size = np.where(counts >= self.k, counts - self.k + 1, (counts > 0).astype(np.int64))
        edge = np.concatenate([[0], np.cumsum(size)])
        values = np.empty(edge[-1], U)
        every = grams(words.hash, self.k)
        long = counts >= self.k
        place = np.repeat(long, size)  # shingles of long texts, in order, are the windows that stay inside their text
        start = np.repeat(first[:-1][long] - edge[:-1][long], size[long]) + np.flatnonzero(place)
        values[place] = every[start] if len(every) else 0
        for i in np.flatnonzero(~long & (counts > 0)).tolist():
            values[edge[i]] = grams(words.hash[first[i] : first[i + 1]], int(counts[i]), salt=1)[0]
        out = np.full((len(size), self.n), 0xFFFF, np.uint16)
        rows = np.flatnonzero(size)
        at = 0
        while at < len(rows):  # blocks of whole texts that stay in cache
            to = max(at + 1, int(np.searchsorted(edge, edge[rows[at]] + (1 << 15), side="right")) - 1)
            block = rows[at : max(at + 1, int(np.searchsorted(rows, to)))]
            low, high = edge[block[0]], edge[block[-1] + 1]
            x, starts = values[low:high], edge[block] - low
            buffer = np.empty_like(x)
            for j in range(self.n):
                np.multiply(x, self.a[j], out=buffer)
                buffer += self.b[j]
                # minima of long texts are small numbers: mixed, their 16 bits differ however long the texts are
                out[block, j] = mix(np.minimum.reduceat(buffer, starts)).astype(np.uint16)
            at += len(block)
        return out, size > 0


def hexes(signatures: np.ndarray, full: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() if ok else "" for row, ok in zip(signatures, full.tolist())]


def likeness(a: np.ndarray, fa: np.ndarray, b: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Share of equal places; 1 for two empty fingerprints, 0 for an empty and a full one."""
    return np.where(fa & fb, (a == b).mean(axis=1), (fa == fb).astype(float))


def set_keys(minhash: MinHash, texts: pa.Array) -> Iterator[tuple[int, bytes | None]]:
    """(number of shingles, digest of the shingle set or None for no shingles) per text."""
    for found in shingles(minhash.hasher.words(*buffers(texts)), minhash.k):
        yield len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def successors(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(slice, ahead, doc_id, text, set_key, component_id, head): slices of consecutive documents, each followed by the first document
    of the next slice (``ahead`` 1), which is there to be read only; after the last comes the first.  The rows of ``classes``
    (doc_id, set_key, component_id), one per known shingle set of a doc_id, come before the documents of their doc_id; they
    alone have no text.

    Slice borders are approximate quantiles; the order itself is exact.  Texts are compressed; rows are sorted by what begins
    their text, ``head``, and ``in_order`` does the rest.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(parts(docs, size=8 << 20), SLICES)
    shares = [i / n for i in range(1, n)] or [0.5]
    found = rows.agg(F.percentile_approx(F.col("doc_id").cast("double"), [float(x) for x in shares], 10_000).alias("q")).first()["q"]
    borders = [-float("inf"), *sorted(set(found or [0.0])), float("inf")]
    cutter = Bucketizer(splits=borders, inputCol="_x", outputCol="_slice")

    def sliced(rows: DataFrame, *columns: str) -> DataFrame:
        found = cutter.transform(rows.withColumn("_x", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7976931348623157e308))))
        return found.select(F.col("_slice").cast("int").alias("slice"), F.lit(0).alias("ahead"), *columns)

    dealt = sliced(rows, "doc_id", "text")
    lowest = F.coalesce(F.min(F.when(F.col("doc_id").isNull(), F.lit(True))), F.lit(False))
    heads = dealt.groupBy("slice").agg(F.when(~lowest, F.min("doc_id")).alias("doc_id"))
    first = dealt.join(F.broadcast(heads), (dealt["slice"] == heads["slice"]) & dealt["doc_id"].eqNullSafe(heads["doc_id"]), "leftsemi")
    first = first.groupBy("slice").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    order = W.orderBy("slice")  # one row per slice
    before = heads.select("slice").withColumn("prev", F.lag("slice").over(order)).withColumn(
        "prev", F.coalesce("prev", F.max("slice").over(W.partitionBy(F.lit(0))))
    )
    ahead = first.join(F.broadcast(before), "slice").select(F.col("prev").alias("slice"), F.lit(1).alias("ahead"), "doc_id", "text")
    none = F.lit(None)
    both = dealt.unionByName(ahead).select("*", none.cast("binary").alias("set_key"), none.cast("bigint").alias("component_id"), F.substring("text", 1, HEAD).alias("head"))
    sent = both.mapInArrow(lambda batches: squeezed(batches, 3), "slice int, ahead int, doc_id bigint, text binary, set_key binary, component_id bigint, head string")
    if classes is not None:
        sent = sent.unionByName(sliced(classes, "doc_id", none.cast("binary").alias("text"), "set_key", "component_id", none.cast("string").alias("head")))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return sent.repartition(width, "slice").sortWithinPartitions("slice", "ahead", "doc_id", "head")


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``successors``, texts restored, sorted by the whole text where doc_id and head are equal."""
    by = [(c, "ascending") for c in ("slice", "ahead", "doc_id", "text")]
    held = []  # rows that the next batch may go on with
    for batch in restored(batches, 3):
        rows = pa.Table.from_batches([*held, batch])
        rows = rows.take(pc.sort_indices(rows, sort_keys=by, null_placement="at_start")).combine_chunks()
        like, at = rows.select(["slice", "ahead", "doc_id", "head"]), rows.num_rows - 1
        while at and like.slice(at - 1, 1).to_pylist() == like.slice(rows.num_rows - 1, 1).to_pylist():
            at -= 1
        yield from rows.slice(0, at).to_batches()
        held = rows.slice(at).to_batches()
    yield from held


def fingerprints(docs: DataFrame, digests: bool = False, classes: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, set_key per row of
    ``docs``; with ``digests`` the edited text's SHA-256, edited_sha256, in place of the text, which then leaves no task; with
    ``classes`` (doc_id, set_key, component_id) the component_id that they name, else null.

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many of the next document.
    """
    edit = "edited_sha256" if digests else "edited_text"
    names = ["doc_id", "n_chars", edit, "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "set_key", "component_id"]
    wire = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.int64()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash()
        kept = None  # the last row waits for its successor
        known, newest = {}, None  # the classes of the newest doc_id and of the row that waits
        for batch in pieces(in_order(batches), 3):
            told = batch.column(3).is_null()
            owners, sets, found = (batch.column(c).filter(told).to_pylist() for c in (2, 4, 5))
            known = {k: c for k, c in known.items() if k[0] == newest or kept and k[0] == kept[1][0]} | dict(zip(zip(owners, sets), found))
            newest = owners[-1] if owners else newest
            batch = batch.filter(pc.invert(told))
            if not batch.num_rows:
                continue
            sig, full = minhash.signatures(batch.column(3))
            ahead = batch.column(1).to_numpy()
            one, texts, sets = batch.column(2).to_pylist(), batch.column(3).to_pylist(), list(set_keys(minhash, batch.column(3)))
            if kept:
                ahead, one, texts = np.r_[kept[0], ahead], [*kept[1], *one], [*kept[2], *texts]
                sig, full, sets = np.concatenate([kept[3], sig]), np.concatenate([kept[4], full]), [*kept[5], *sets]
            kept = (ahead[-1:], one[-1:], texts[-1:], sig[-1:], full[-1:], sets[-1:])
            rows = np.flatnonzero(ahead[:-1] == 0)
            if not len(rows):
                continue
            size = [len(texts[i]) for i in rows]
            edited = [texts[i][: n - n // 2] + texts[i + 1][: n // 2] for i, n in zip(rows.tolist(), size)]
            esig, efull = minhash.signatures(pa.array(edited, pa.string()))
            shown = [hashlib.sha256(t.encode()).hexdigest() for t in edited] if digests else edited
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([one[i] for i in rows], pa.int64()), pa.array(size, pa.int64()), pa.array(shown, pa.string()),
                    pa.array(hexes(sig[rows], full[rows])), pa.array(hexes(esig, efull)),
                    pa.array(likeness(sig[rows], full[rows], esig, efull)), pa.array(likeness(sig[rows], full[rows], sig[rows + 1], full[rows + 1])),
                    pa.array([sets[i][0] for i in rows], pa.int64()), pa.array([sets[i][1] for i in rows], pa.binary()),
                    pa.array([known.get((one[i], sets[i][1])) for i in rows], pa.int64()),
                ],
                schema=wire,
            )

    schema = f"doc_id bigint, n_chars bigint, {edit} string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles bigint, set_key binary, component_id bigint"
    made = successors(docs, classes).mapInArrow(run, schema)
    return made if classes is not None else made.drop("component_id")


def banded(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_key, keys): keys are hashes of the bands of each signature."""
    wire = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash, factors, salts = MinHash(k), stream(23, BAND) | U(1), stream(24, PERMUTATIONS // BAND)
        for batch in pieces(batches, 1):
            sig, full = minhash.signatures(batch.column(1))
            keys = mix((sig.astype(U).reshape(len(sig), -1, BAND) * factors).sum(axis=2, dtype=U) ^ salts)
            rows = []
            for one, (size, digest), key in zip(batch.column(0).to_pylist(), set_keys(minhash, batch.column(1)), keys):
                rows.append((one, size, digest, signed(key) if size else np.zeros(0, np.int64)))
            yield from list_rows(wire, rows).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_key binary, keys array<bigint>"
    )


def similar(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): classes of documents linked at ``percent`` Jaccard similarity of their
    five-word shingles, found through joined signature bands and confirmed on full sets."""
    table = cut(banded(docs))
    return grouped(table.drop("keys"), linked(docs, table, SHINGLE, percent))


def fingerprints_and_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The columns of ``fingerprints`` (the digest edited_sha256 for edited_text, no set_key), and component_id and kept as in
    ``similar``, per row of ``docs``.  The classes go where the texts go, as they are smaller than the fingerprints."""
    table = cut(banded(docs))
    named = table.where("doc_id is not null").select("doc_id", "set_key").distinct()
    classes = cut(named.join(linked(docs, table, SHINGLE, percent).select("set_key", "component_id"), "set_key").select("doc_id", "set_key", "component_id"))
    found = fingerprints(docs, digests=True, classes=classes).drop("set_key")
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return found.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
