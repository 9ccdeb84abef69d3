"""Scoring by a hierarchical Pitman-Yor language model.

Restaurants: one per context, all sharing one parent, whose base is uniform over the known words and one unknown.  The
context of a token is the word before it (its 64-bit hash), so contexts grow with the corpus.  Customers of a context
restaurant are the training tokens; each of its tables sends one customer to the parent.

Gibbs sampling runs in sweeps.  All tokens of a word lie in one bucket, with the word's customers in every context and in
the parent, so a sweep reseats all customers of a word given the table totals that the sweep before left.  Totals per
context never pass through the driver: every context has a home (by hash), each bucket sends its homes what it has of their
contexts, packed, and gets the sums back in the same order, as written tables.  A customer opens a table with probability
proportional to (strength + discount * tables) * parent probability, as in the Chinese-restaurant process; from the 32nd
customer of a dish on, customers are seated in batches of a sixteenth of those that sit (a binomial draw), so a frequent
word costs logarithmic time.  Seats are drawn from a stream fixed by sweep and bucket and can be drawn again instead of
stored.  Discounts follow from the counts of ones and twos.  Scores use the mean of the predictive probabilities of
``samples`` sweeps after ``burn``; each is a distribution over the known words and one unknown.

Counts of a word in a hot document or a hot word are added up per chunk before they travel.

Edge rows: null and empty texts consist of the end token; a null doc_id counts as the empty text for the split; rows that
repeat a doc_id are separate documents; without training rows every token has probability one over an empty vocabulary;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.packing import CHUNK, Chunk, deal, list_rows, lists, opened, pack, parts, signed, spans
from riskweave.llm.text import NULL_ID, Hasher, U, by_word, stream
from riskweave.session import cut, cut_by

CLASSES = 1 << 16  # homes at most; a home adds up many contexts, each by itself
END, START = int(stream(31, 1)[0]), int(stream(32, 1)[0])
SEED = 20240229
I64, F32 = pa.list_(pa.int64()), pa.list_(pa.float32())
INTS = pa.binary()  # whole numbers, pressed: tables and shuffles copy them as one cell


def held_out(doc_id: int) -> bool:
    return zlib.crc32(b"" if doc_id == NULL_ID else str(doc_id).encode()) % 10 == 0


class Pairs:
    """Distinct (word, context) of a chunk in order of word and context."""

    def __init__(self, chunk: Chunk):
        words = Hasher(lower=True).words(*chunk.flat())
        docs = len(chunk.texts)
        self.first = words.first + np.arange(docs + 1)  # tokens before each document, one end each
        total = int(self.first[-1])
        token = np.empty(total, U)
        ends = self.first[1:] - 1
        is_end = np.zeros(total, bool)
        is_end[ends] = True
        token[ends] = U(END)
        token[~is_end] = words.hash
        before = np.empty(total, U)
        before[1:] = token[:-1]
        before[self.first[:-1]] = U(START)
        order = by_word(token, before)
        w, c = token[order], before[order]
        new = np.ones(total, bool)
        new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(new)
        self.w, self.context = w[at], c[at]
        self.pair_of = np.empty(total, np.int64)  # of each token
        self.pair_of[order] = np.cumsum(new) - 1
        self.held = np.array([held_out(i) for i in chunk.ids.tolist()], bool)
        train = np.repeat(~self.held, np.diff(self.first)).astype(np.int64)
        self.count = np.add.reduceat(train[order], at)
        head = np.ones(len(at), bool)
        head[1:] = self.w[1:] != self.w[:-1]
        self.begin = np.flatnonzero(head)  # of each distinct word
        self.words = self.w[self.begin]
        self.size = np.diff(np.append(self.begin, len(at)))
        self.word_of = np.cumsum(head) - 1  # of each pair

    def buckets(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, its words' positions, their pairs' positions)."""
        for b, p in deal(self.words, n):
            yield b, p, spans(self.begin[p], self.size[p])


def seat(count: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its ``count`` customers sat down; ``mass`` is what a new table weighs."""
    tables = (count > 0).astype(np.int64)
    rows = np.flatnonzero(count > 1)
    seated = 1
    while len(rows):
        step = 1 if seated < 32 else seated // 16
        c, t, a = count[rows], tables[rows], mass[rows]
        p = np.clip(a / (a + seated - discount * t), 0.0, 1.0)
        tables[rows] += rng.random(len(rows)) < p if step == 1 else rng.binomial(np.minimum(step, c - seated), p)
        seated += step
        rows = rows[c > seated]
    return tables


def left_over(tables, customers, parent_tables) -> dict:
    """What a sweep leaves for all: tables per context (of a bucket's contexts), customers and tables of the parent."""
    return {"tables": tables, "customers": customers, "parent_tables": parent_tables}


class Bucket:
    """All counts of a bucket's words: ``k`` (contexts per word), ``context`` (its place in the bucket's list) and ``count``
    per pair."""

    def __init__(self, row: dict):
        self.bucket = int(row["bucket"])
        self.k, self.context, self.count = (np.asarray(row[n], np.int64) for n in ("k", "context", "count"))
        self.word_of = np.repeat(np.arange(len(self.k)), self.k)
        self.first = np.cumsum(self.k) - self.k

    def per_word(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.k) else np.zeros(0, values.dtype)

    def whole(self) -> np.ndarray:
        """What is summed over all buckets: customers, words, ones and twos among the customers of a dish, the same of the parent's,
        and first tables."""
        known = (self.count > 0).astype(np.int64)
        contexts = self.per_word(known)
        return np.array([
            self.count.sum(), (contexts > 0).sum(), (self.count == 1).sum(), (self.count == 2).sum(), (contexts == 1).sum(), (contexts == 2).sum(), known.sum(),
        ])

    def sweep(self, number: int, totals: dict, fixed: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tables per pair, parent customers per word, parent tables per word)."""
        rng = np.random.default_rng([SEED, number, self.bucket])
        d, d0, s, s0, h = (fixed[x] for x in ("d", "d0", "strength", "strength", "base"))
        tables = (self.count > 0).astype(np.int64)
        for _ in range(2):
            customers = self.per_word(tables)
            mass0 = np.full(len(customers), (s0 + d0 * totals["parent_tables"]) * h)
            parent = seat(customers, mass0, d0, rng)
            p0 = parent_probability(customers, parent, totals, fixed)
            tables = seat(self.count, (s + d * totals["tables"][self.context]) * p0[self.word_of], d, rng)
        customers = self.per_word(tables)
        return tables, customers, seat(customers, mass0, d0, rng)


def parent_probability(customers, tables, totals: dict, fixed: dict) -> np.ndarray:
    d0, s0 = fixed["d0"], fixed["strength"]
    n = s0 + totals["customers"]
    return np.maximum(customers - d0 * tables, 0) / n + (s0 + d0 * totals["parent_tables"]) / n * fixed["base"]


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {
                n: opened(c[i].as_py()) if pa.types.is_binary(c.type) else c[i].as_py()
                for n, c in zip(batch.schema.names, batch.columns)
            }


def discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def homed(context: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts of a bucket in order of their homes, and the place of each given one among them."""
    found, place = np.unique(context, return_inverse=True)
    order = np.concatenate([p for _, p in deal(found, homes)]) if len(found) else np.zeros(0, np.int64)
    moved = np.empty(len(found), np.int64)
    moved[order] = np.arange(len(found))
    return found[order], moved[place]


class Said:
    """What the homes reply to a bucket, in order of homes: per ``sweep`` one number per context of the bucket."""

    def __init__(self, replies: pa.Table):
        homes, sweeps = (replies[n].to_numpy() for n in ("home", "sweep"))
        cells = lists(replies, "total")
        order = np.lexsort((homes, sweeps))
        self.homes = np.unique(homes)
        self.totals = {i: np.concatenate([cells[r] for r in order[sweeps[order] == i]]) for i in np.unique(sweeps).tolist()}
        self.sizes = [len(cells[r]) for r in order[: len(self.homes)]]

    def sent(self, schema: pa.Schema, bucket: int, values: np.ndarray, whole: tuple[int, int]) -> pa.Table:
        """(home, bucket, tables) rows; the first one also has what is summed over all buckets."""
        cells = np.split(values, np.cumsum(self.sizes)[:-1])
        return list_rows(schema, [(h, bucket, v, *(whole if i == 0 else (0, 0))) for i, (h, v) in enumerate(zip(self.homes.tolist(), cells))])


def score(docs: DataFrame, burn: int = 1, samples: int = 3, strength: float = 1.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``."""
    n = parts(docs, size=2 * CHUNK // 3)
    buckets = 4 * n
    homes = min(n, CLASSES)
    packed = pack(docs, n)
    sent = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("w", INTS), ("k", INTS), ("context", INTS), ("count", INTS)])

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, chunk = Pairs(Chunk(table)), key[0].as_py()
        return list_rows(sent, [(b, chunk, signed(x.words[p]), x.size[p], signed(x.context[q]), x.count[q]) for b, p, q in x.buckets(buckets)])

    kept = pa.schema([("bucket", pa.int32()), ("k", INTS), ("distinct", INTS), ("context", INTS), ("count", INTS), ("chunk", INTS), ("n", INTS), ("gap", INTS), ("whole", I64)])

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size = lists(table, "k", np.int64)
        words = np.concatenate([np.repeat(w, k) for w, k in zip(lists(table, "w"), size)]).view(U)
        context, number = np.concatenate(lists(table, "context")).view(U), np.concatenate(lists(table, "count"))
        order = by_word(words, context)
        w, c = words[order], context[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(new)
        place = np.empty(len(w), np.int64)
        place[order] = np.cumsum(new) - 1
        head = np.ones(len(at), bool)
        head[1:] = w[at][1:] != w[at][:-1]
        k = np.diff(np.append(np.flatnonzero(head), len(at)))
        distinct, own = homed(c[at], homes)
        sizes = [len(x) for x in lists(table, "context")]
        gap = np.concatenate([np.diff(x, prepend=0) for x in np.split(place, np.cumsum(sizes)[:-1])])
        x = Bucket({"bucket": key[0].as_py(), "k": k, "context": own, "count": np.add.reduceat(number[order], at)})
        return list_rows(kept, [(x.bucket, k, signed(distinct), own, x.count, np.array(table["chunk"].to_pylist()), np.array(sizes), gap, x.whole())])

    pairs = packed.groupBy("chunk").applyInArrow(count, "bucket int, chunk int, w binary, k binary, context binary, count binary")
    merged = pairs.groupBy("bucket").applyInArrow(merge, "bucket int, k binary, distinct binary, context binary, count binary, chunk binary, n binary, gap binary, whole array<bigint>")
    store = cut_by(merged, "bucket", n)
    model = store.select("bucket", "k", "context", "count")

    sums = store.agg(*[F.coalesce(F.sum(F.get("whole", F.lit(i))), F.lit(0)) for i in range(7)]).first()
    train, known, n1, n2, m1, m2, first_tables = (int(v) for v in sums)
    fixed = {"d": discount(n1, n2), "d0": discount(m1, m2), "strength": strength, "base": 1.0 / (known + 1)}

    first = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("context", INTS), ("customers", INTS), ("tables", INTS)])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in bucket_rows(batches):
            x, context = Bucket(row), row["distinct"]
            customers, tables = (np.bincount(x.context, v, len(context)).astype(np.int64) for v in (x.count, x.count > 0))
            rows = [(h, x.bucket, context[p], customers[p], tables[p]) for h, p in deal(context.view(U), homes)]
            yield from list_rows(first, rows).to_batches()

    begun = store.select("bucket", "k", "distinct", "context", "count").mapInArrow(start, "home int, bucket int, context binary, customers binary, tables binary")
    placed = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("place", INTS), ("customers", INTS), ("tables", INTS)])

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cells = lists(table, "context")
        place = np.unique(np.concatenate(cells), return_inverse=True)[1]
        edge = np.cumsum([len(c) for c in cells])[:-1]
        total = [np.split(np.bincount(place, np.concatenate(lists(table, v))).astype(np.int64)[place], edge) for v in ("customers", "tables")]
        return list_rows(placed, [(key[0].as_py(), *row) for row in zip(table["bucket"].to_pylist(), np.split(place, edge), *total)])

    settled = cut_by(begun.groupBy("home").applyInArrow(settle, "home int, bucket int, place binary, customers binary, tables binary"), "home", n)
    layout = settled.select("home", "bucket", "place")
    reply = lambda table, sweep, total: table.select("bucket", "home", F.lit(sweep).alias("sweep"), F.col(total).alias("total"))

    replied = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("tables", INTS)])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table, news: pa.Table) -> pa.Table:
        at = dict(zip(news["bucket"].to_pylist(), lists(news, "tables")))
        rows, cells = table["bucket"].to_pylist(), lists(table, "place")
        place = np.concatenate(cells)
        total = np.bincount(place, np.concatenate([at[b] for b in rows])).astype(np.int64)[place]
        return list_rows(replied, [(key[0].as_py(), b, v) for b, v in zip(rows, np.split(total, np.cumsum([len(c) for c in cells])[:-1]))])

    told = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("tables", INTS), ("customers0", pa.int64()), ("tables0", pa.int64())])
    replies, parent = [reply(settled, 0, "tables")], [(first_tables, known)]  # tables per context; customers and tables of the parent
    for number in range(burn + samples):
        before = parent[-1]

        def sweep(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
            said = Said(answers)
            x = Bucket(next(bucket_rows(table.combine_chunks().to_batches())))
            t, c0, t0 = x.sweep(number, left_over(said.totals[number], *before), fixed)
            tables = np.bincount(x.context, t, sum(said.sizes)).astype(np.int64)
            return said.sent(told, x.bucket, tables, (int(c0.sum()), int(t0.sum())))

        both = model.groupBy("bucket").cogroup(replies[-1].groupBy("bucket"))
        news = cut(both.applyInArrow(sweep, "home int, bucket int, tables binary, customers0 bigint, tables0 bigint"))
        parent.append(tuple(int(v or 0) for v in news.agg(F.sum("customers0"), F.sum("tables0")).first()))
        added = layout.groupBy("home").cogroup(news.select("home", "bucket", "tables").groupBy("home"))
        replies.append(reply(cut(added.applyInArrow(add, "home int, bucket int, tables binary")), number + 1, "tables"))

    answer = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("lp", F32), ("seen", INTS)])

    def predict(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        said = Said(answers)
        row = next(bucket_rows(table.combine_chunks().to_batches()))
        x = Bucket(row)
        p = np.zeros(len(x.count))
        n_context = strength + said.totals[-1][x.context]
        for number in range(burn, burn + samples):
            t, c0, t0 = x.sweep(number, left_over(said.totals[number], *parent[number]), fixed)
            now = left_over(said.totals[number + 1], *parent[number + 1])
            p0 = parent_probability(c0, t0, now, fixed)
            p += (np.maximum(x.count - fixed["d"] * t, 0) + (strength + fixed["d"] * now["tables"][x.context]) * p0[x.word_of]) / n_context
        lp = np.log10(p / samples)
        seen = x.per_word(x.count)
        rows = []
        for chunk, gap in zip(row["chunk"].tolist(), np.split(row["gap"], np.cumsum(row["n"])[:-1])):
            place = np.cumsum(gap)
            word = x.word_of[place]
            rows.append((chunk, x.bucket, lp[place], seen[word[np.flatnonzero(np.diff(word, prepend=-1))]]))
        return list_rows(answer, rows)

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        chunk = Chunk(table)
        x = Pairs(chunk)
        lp, seen = np.full(len(x.w), np.nan), np.zeros(len(x.words), np.int64)
        said = dict(zip(replies["bucket"].to_pylist(), zip(lists(replies, "lp", np.float64), lists(replies, "seen"))))
        for b, p, q in x.buckets(buckets):
            lp[q], seen[p] = said[b]
        word = x.word_of[x.pair_of]
        at = x.first[:-1]
        base = np.log10((seen + 0.1) / (train + 0.1 * (known + 1)))
        columns = [
            chunk.id_array(), pa.array(x.held), pa.array(np.diff(x.first)), pa.array(np.add.reduceat((seen > 0).astype(np.int64)[word], at)),
            pa.array(np.add.reduceat(base[word], at)), pa.array(np.add.reduceat(lp[x.pair_of], at)),
        ]
        return pa.Table.from_arrays(columns, schema=out)

    past = reply(settled, -1, "customers")
    for one in replies[burn:]:
        past = past.unionByName(one)
    whole = store.select("bucket", "k", "context", "count", "chunk", "n", "gap").groupBy("bucket").cogroup(past.groupBy("bucket"))
    answers = whole.applyInArrow(predict, "chunk int, bucket int, lp array<float>, seen binary")
    scored = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(gather, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")
