"""MinHash near-deduplication: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Every document is hashed once per shingle.  The top bits of a hash choose one of ``BINS`` bins and each bin keeps its
smallest hash; an empty bin borrows from the non-empty bin that comes first in the bin's own fixed permutation.  Bins are
read in bands of ``ROWS``; documents that agree on a band share a bucket.  A bucket never yields all its pairs:

1. every member is compared with one centre only (a star), and confirmed links are contracted.  The centre is the member whose
   buckets are the largest in total: among edits of one text that is the text itself, or the edit nearest to it, and it is
   the centre in nearly all their buckets;
2. where many members are still outside the largest component of their bucket ("strays"), the most central stray becomes the
   centre of a second star;
3. the strays left are compared with all members of other components of their bucket in blocks, on sketches of the 2,048
   lowest hashes: sets of up to that size exactly, larger ones within five standard deviations of the similarity.

So every two documents that share a bucket are compared or already connected, and the pairs that come out are those of the
stars, linear in the members, and likely links.  With 42 bands of 6 bins a pair at
similarity 0.8 shares no bucket with probability 3e-6.  Candidates are confirmed on full shingle sets.  Documents with
equal sets are one node throughout.

Edge rows: null or empty texts have no shingles, link with nothing and form their own component; a text with fewer words
than a shingle is one shingle; rows that repeat a doc_id with other shingles are nodes of their own (nodes are known by a
64-bit hash of their set's digest; a component is named by its smallest doc_id); rows with a null doc_id are returned with
null component and kept true; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.graph import components
from riskweave.llm.packing import list_rows, lists, signed, spans
from riskweave.llm.text import Hasher, U, buffers, mix, pieces, shingles, stream
from riskweave.session import cut

BINS, ROWS = 256, 6
BANDS = BINS // ROWS
SKETCH, MEMBERS, STRAYS = 2048, 2048, 512  # values of a sketch; members and strays in a unit
MOST_BITS = 1 << 29
CROWD = 64  # strays of a bucket from which on it gets a second star


class Sketch:
    """One-permutation signatures of sorted shingle sets and their band keys."""

    def __init__(self):
        self.edges = np.arange(BINS, dtype=U) << U(56)
        self.ranks = np.argsort(stream(7, BINS * BINS).reshape(BINS, BINS), axis=1).argsort(axis=1)
        self.factors = stream(8, ROWS) | U(1)
        self.salts = stream(9, BANDS)

    def keys(self, found: np.ndarray) -> np.ndarray:
        at = np.searchsorted(found, self.edges)
        full = np.empty(BINS, bool)
        full[:-1] = at[:-1] < at[1:]
        full[-1] = at[-1] < len(found)
        bins = np.flatnonzero(full)
        values = np.empty(BINS, U)
        values[bins] = found[at[bins]]
        if len(bins) < BINS:
            empty = np.flatnonzero(~full)
            values[empty] = values[bins[self.ranks[empty][:, bins].argmin(axis=1)]]
        banded = values[: BANDS * ROWS].reshape(BANDS, ROWS) * self.factors
        return mix(banded.sum(axis=1, dtype=U) ^ self.salts)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, keys, mark) per row; set_key identifies the shingle set, null where it is empty, and mark
    the text."""
    wire = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("keys", pa.list_(pa.int64())), ("mark", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = Hasher(lower=True), Sketch()
        for batch in pieces(batches, 1):
            data, offsets = buffers(batch.column(1))
            rows = []
            for one, mark, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingles(hasher.words(data, offsets), k)):
                n = len(found)
                key = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if n else None
                rows.append((one, n, key, signed(sketch.keys(found)) if n else np.zeros(0, np.int64), mark))
            yield from list_rows(wire, rows).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("mark")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_key binary, keys array<bigint>, mark string"
    )


def marked(ids: np.ndarray, bits: int) -> np.ndarray:
    """(2 x n) places of the ids in a bit set."""
    mixed = mix(ids.view(U))
    return np.stack([mixed, mixed >> U(32)]) & U(bits - 1)


def bit_set(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the column ``doc_id``: bytes, and their number of bits.

    Sixteen bits an id, ``MOST_BITS`` at most: what is collected and sent out stays below 64 MB whatever the number of ids; a
    fuller filter only lets more pass.
    """
    bits = min(max(1 << (16 * ids.count()).bit_length(), 64), MOST_BITS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = marked(batch.column(0).to_numpy(), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).astype(np.int64)), pa.array(signed(U(1) << (at & U(63))))], names=["word", "mask"])

    words = ids.mapInArrow(place, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, U)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(U)
    return out, bits


def among(ids: np.ndarray, words: np.ndarray, bits: int) -> pa.Array:
    """Whether each id may be one of the bit set's."""
    at = marked(ids, bits)
    return pa.array(((words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)).all(axis=0))


def shingle_sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(set_key, s): sorted distinct shingle hashes of the rows whose doc_id is in ``wanted``, and of few others: rows are told
    apart by a bit set where they lie, as most documents are not wanted and no text has to travel."""
    wire = pa.schema([("set_key", pa.binary()), ("s", pa.list_(pa.int64()))])
    words, bits = bit_set(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = Hasher(lower=True), shared.value
        for batch in pieces(batches, 1):
            batch = batch.filter(among(batch.column(0).to_numpy(), held, bits))
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column(1))
            found = shingles(hasher.words(data, offsets), k)
            yield from list_rows(wire, [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signed(s)) for s in found]).to_batches()

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(run, "set_key binary, s array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets meet ``100 * intersection >= percent * union``."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
        .where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("t") - F.col("i")))
        .select("a", "b")
    )


def matches(x: np.ndarray, full: bool, sketches: np.ndarray, first: np.ndarray, complete: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets, whose sketches lie one after another from ``first`` on, may meet the similarity with set ``x``.

    A sketch is the ascending lowest hashes of a set, or all of them.  The share of common values up to the lower of the
    two upper ends estimates the similarity; five standard deviations are allowed for, and one step of rounding.
    """
    last = np.append(first[1:], len(sketches)) - 1
    top = np.where(complete, np.uint32(0xFFFFFFFF), sketches[last])
    top = np.minimum(top, np.uint32(0xFFFFFFFF) if full else x[-1])
    low = sketches <= np.repeat(top, last - first + 1)
    hit = low & (x[np.minimum(np.searchsorted(x, sketches), len(x) - 1)] == sketches)
    both = np.add.reduceat(hit.astype(np.int64), first)
    either = np.searchsorted(x, top, side="right") + np.add.reduceat(low.astype(np.int64), first) - both
    share = percent / 100
    slack = np.where(complete & full, 0.0, 5 * np.sqrt(share * (1 - share) / np.maximum(either, 1)))
    return both >= (share - slack) * either - 1


def laid(cells: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of the rows one after another, and where each begins."""
    own = [cells[r].view(np.uint32) for r in rows]
    return np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets in ``left`` with all in ``right``.

    Values of many sets are counted by a matrix product, the others through lists of the sets that hold them, so the cost
    is that of the values which sets really share.
    """
    sizes = np.array([len(x) for x in right])
    values, at, held = np.unique(np.concatenate(right), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(right)), sizes)
    column = np.where(held * 8 >= len(right), np.cumsum(held * 8 >= len(right)) - 1, -1)
    wide = int(column.max()) + 1
    table = np.zeros((len(right), wide), np.float32)
    table[owner[column[at] >= 0], column[at][column[at] >= 0]] = 1
    lists_of = owner[np.argsort(at, kind="stable")]
    begin = np.cumsum(held) - held
    dense = np.zeros((len(left), wide), np.float32)
    out = np.zeros((len(left), len(right)), np.int64)
    for i, x in enumerate(left):
        where = np.minimum(np.searchsorted(values, x), len(values) - 1)
        where = where[values[where] == x]
        dense[i, column[where][column[where] >= 0]] = 1
        rare = where[column[where] < 0]
        if len(rare):
            out[i] = np.bincount(lists_of[spans(begin[rare], held[rare])], minlength=len(right))
    return out + (dense @ table.T).astype(np.int64)


def placed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, doc_id, n, w, comp): ``shared`` with the component of every member so far, itself where it has none."""
    found = shared.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.select("key", "doc_id", "n", "w", F.coalesce("component", "doc_id").alias("comp"))


def largest(now: DataFrame) -> DataFrame:
    """(key, main, m, top): largest component, members and its size, of buckets with more than one component."""
    sizes = now.groupBy("key", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("m"), F.max("size").alias("top"), F.count("*").alias("many"))
    return main.where("many > 1").drop("many")


def star(members: DataFrame, centre: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of each bucket's members with its centre ``c``."""
    pairs = members.join(centre, "key").where("doc_id <> c")
    return pairs.select(F.least("c", "doc_id").alias("a"), F.greatest("c", "doc_id").alias("b")).distinct()


def second_star(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidate pairs of the most central stray with the members of other components, in buckets of many strays."""
    now = placed(shared, labels)
    crowds = cut(now.join(largest(now).where(F.col("m") - F.col("top") >= CROWD), "key"))
    centre = crowds.where("comp <> main").groupBy("key").agg(F.max_by(F.struct(F.col("doc_id").alias("c"), F.col("comp").alias("cc")), F.struct("w", -F.col("doc_id"))).alias("x"))
    return star(crowds.join(centre.select("key", "x.cc"), "key").where("comp <> cc"), centre.select("key", "x.c"))


def strays(shared: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) across components: every member of a bucket that lies outside the bucket's largest component
    against all members of other components, by sketches of ``SKETCH`` values.

    No pair is formed by a join: members and strays of a bucket go in blocks to units of bounded size, are compared there,
    and only likely pairs come out.  Small buckets share a unit.
    """
    now = placed(shared, labels)
    main = largest(now).withColumns({"nb": F.ceil(F.col("m") / MEMBERS), "ns": F.ceil((F.col("m") - F.col("top")) / STRAYS)})
    split = cut(now.join(main, "key").withColumn("stray", F.col("comp") != F.col("main")))
    units = max(split.count() // (4 * MEMBERS), 1)
    sketch = F.transform(F.slice("s", 1, SKETCH), lambda x: F.shiftright(x, 32).cast("int"))
    rows = split.select("key", "doc_id", "n", "comp", "stray", "nb", "ns").join(sets.select("doc_id", sketch.alias("s")), "doc_id")
    place = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    unit = F.concat_ws(":", F.pmod(F.xxhash64("key"), F.lit(units)), F.when(F.col("nb") * F.col("ns") > 1, F.col("key")), "i", "j")
    left = rows.where("stray").withColumn("i", place(1, "ns")).withColumn("j", every("nb")).withColumn("centre", F.lit(True))
    right = rows.withColumn("j", place(2, "nb")).withColumn("i", every("ns")).withColumn("centre", F.lit(False))
    dealt = left.unionByName(right).select(unit.alias("unit"), "key", "doc_id", "n", "comp", "centre", "s")
    wire = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        key, doc, n, comp, centre = (table[c].to_numpy() for c in ("key", "doc_id", "n", "comp", "centre"))
        cells = lists(table, "s", np.int32)
        out = []
        order = np.argsort(key, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            others = rows[~centre[rows]]
            if not len(others):
                continue
            strays = rows[centre[rows]]
            small, large = others[n[others] <= SKETCH], others[n[others] > SKETCH]
            near = strays[n[strays] <= SKETCH]
            if len(small) and len(near):
                both = common([cells[r].view(np.uint32) for r in near], [cells[r].view(np.uint32) for r in small])
                either = n[near][:, None] + n[small][None, :] - both
                ok = (both >= percent / 100 * either - 1) & (comp[near][:, None] != comp[small][None, :])  # one step of rounding
                out += [(min(x, y), max(x, y)) for x, y in zip(doc[near[np.nonzero(ok)[0]]].tolist(), doc[small[np.nonzero(ok)[1]]].tolist())]
            for r in strays.tolist():  # sketches that are not whole sets
                rest = large if n[r] <= SKETCH else others
                rest = rest[(comp[rest] != comp[r]) & (100 * np.minimum(n[rest], n[r]) >= percent * np.maximum(n[rest], n[r]))]
                if len(rest):
                    ok = matches(cells[r].view(np.uint32), n[r] <= SKETCH, *laid(cells, rest), n[rest] <= SKETCH, percent)
                    out += [(min(doc[r], d), max(doc[r], d)) for d in doc[rest[ok]].tolist()]
        out = np.array(sorted(set(out)), np.int64).reshape(-1, 2)
        return pa.table([pa.array(out[:, 0]), pa.array(out[:, 1])], schema=wire)

    return dealt.groupBy("unit").applyInArrow(compare, "a bigint, b bigint").distinct()


def linked(docs: DataFrame, table: DataFrame, k: int, percent: int) -> DataFrame:
    """(set_key, component_id, component) of the shingle sets in ``table`` (doc_id, n_shingles, set_key, keys): documents that
    share a key are compared as described above, on the shingle sets of ``docs`` (doc_id, text).  component_id is the smallest
    doc_id of the component, which unlike ones may share where a doc_id repeats; ``component`` tells them apart."""
    named = table.where("n_shingles > 0 and doc_id is not null")
    node = F.xxhash64("set_key")
    classes = cut(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")).withColumn("node", node))
    reps = named.join(classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "leftsemi")
    members = reps.select(node.alias("doc_id"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))  # from here on doc_id is the node
    buckets = members.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top"), F.count("*").alias("m")).where("low < top")
    shared = cut(members.join(buckets.select("key", "m"), "key").distinct())  # members of buckets with two documents or more
    shared = cut(shared.join(shared.groupBy("doc_id").agg(F.sum("m").alias("w")), "doc_id").select("key", "doc_id", "n", "w"))
    centre = shared.groupBy("key").agg(F.max_by("doc_id", F.struct("w", -F.col("doc_id"))).alias("c"))

    wanted = shared.select("doc_id").distinct()
    named = classes.join(wanted, classes["node"] == wanted["doc_id"], "leftsemi").select(F.col("rep").alias("doc_id"))
    sets = shingle_sets(docs, k, named).select(node.alias("doc_id"), "s").join(wanted, "doc_id", "leftsemi")
    sets = cut(sets.dropDuplicates(["doc_id"]))

    links = cut(confirmed(star(shared, centre), sets, percent))
    labels = components(links)
    again = cut(second_star(shared, labels))
    if not again.isEmpty():
        links = cut(links.union(confirmed(again, sets, percent)))
        labels = components(links)
    more = cut(confirmed(strays(shared, labels, sets, percent), sets, percent))
    if not more.isEmpty():
        labels = components(links.union(more))
    found = cut(classes.join(labels, "node", "left").select("set_key", "rep", F.coalesce("component", "node").alias("component")))
    return found.join(found.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("set_key", "component_id", "component")


def grouped(table: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``table`` (doc_id, set_key and others) with component_id and kept instead of set_key."""
    names = [c for c in table.columns if c != "set_key"]
    return (
        table.join(found.select("set_key", "component_id"), "set_key", "left")
        .select(*names, F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
    )


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text)."""
    table = cut(sketches(docs, k))
    return grouped(table.drop("keys", "mark"), linked(docs, table, k, percent))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: one row for the smallest doc_id of each group (of its rows the one with the smallest
    text digest), all columns kept.  Unlike texts under one doc_id all stay."""
    mark = F.md5(F.coalesce("text", F.lit("")))
    table = cut(sketches(docs, k))
    rows = table.join(linked(docs, table, k, percent).select("set_key", "component"), "set_key", "left")
    # texts without shingles are alike under one doc_id only
    best = rows.where("doc_id is not null").groupBy("component", F.when(F.col("component").isNull(), F.col("doc_id")).alias("alone")).agg(F.min(F.struct("doc_id", "mark")).alias("best"))
    kept = best.select(F.col("best.doc_id").alias("kept_id"), F.col("best.mark").alias("kept_mark"))
    # the row travels as one column, so that its columns may have any names
    named = docs.where("doc_id is not null").select("doc_id", mark.alias("mark"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    first = named.join(kept, (F.col("doc_id") == F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")), "leftsemi")
    return first.dropDuplicates(["doc_id", "mark"]).select("row.*").unionByName(docs.where("doc_id is null"))
