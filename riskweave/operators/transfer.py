"""Transfer functions: what a slice of an ordered fold does to any state it may be entered with, as a small table.

A hot key's slices are summarised side by side.  Tables of neighbouring slices compose to a table of both, so the state at
every slice's entry follows from a prefix scan over the tables: about log2(slices) passes, each composing all pairs at once,
and no task sees more than two tables.  Only then are the rows run, each slice once, from its true entry.

States are rows of doubles, the empty state is NaN.  Rows reach a table in time order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from riskweave.operators.frames import renamed, same
from riskweave.session import cut as write_table

FAR = np.inf


def heads(batch: pa.RecordBatch, names: list[str]) -> list[tuple]:
    """The named columns row by row, in values that equal themselves (also NaN)."""
    columns = []
    for name in names:
        values = batch.column(name).to_pylist()
        if pa.types.is_floating(batch.column(name).type):
            values = ["nan" if v != v else v for v in values]
        columns.append(values)
    return list(zip(*columns))


def steps(values: np.ndarray) -> np.ndarray:
    """Which rows differ from the row after; the last one always does."""
    flat = values.reshape(len(values), -1) if len(values) else values
    return np.append((flat[1:] != flat[:-1]).any(axis=1), True) if len(flat) else np.zeros(0, bool)


@dataclass(frozen=True)
class Hold:
    """Folds whose state is a time until which rows are refused: the first row at or after it is accepted and sets the next.

    ``rows`` maps the input columns (double arrays, NaN for null) to the times and the ends they would set, of the rows that can
    be accepted.  A table maps the first accepted row to the end that is in force after the slice: for each row its successor,
    the first row at or after its end, is found, and pointer doubling leads every row to the last of its chain.  Rows with the
    same outcome share a piece, known by its last time.  Pieces behind ``bound``, the latest end that earlier slices can hand
    over, are never entered and left out.
    """

    rows: Callable[..., tuple[np.ndarray, np.ndarray]]
    width = 1

    def ends(self, *inputs: np.ndarray) -> float:
        """The latest end the rows can set."""
        return float(self.rows(*inputs)[1].max(initial=-FAR))

    def table(self, bound: float, *inputs: np.ndarray) -> np.ndarray:
        now, until = self.rows(*inputs)
        here = np.arange(len(now))
        after = np.maximum(np.searchsorted(now, until), here + 1)
        last = np.where(after < len(now), after, here)
        while True:
            further = last[last] if len(last) else last
            if (further == last).all():
                break
            last = further
        return self.packed(bound, now, until[last] if len(last) else until)

    def packed(self, bound: float, upper: np.ndarray, exits: np.ndarray) -> np.ndarray:
        keep = steps(exits)
        upper, exits = upper[keep], exits[keep]
        reach = int(np.searchsorted(upper, bound)) + 1
        return np.concatenate([[bound], upper[:reach], exits[:reach]])

    def pieces(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = (len(table) - 1) // 2
        return table[1 : 1 + half], table[1 + half :]

    def apply(self, table: np.ndarray, states: np.ndarray) -> np.ndarray:
        upper, exits = self.pieces(table)
        if not len(upper):
            return states
        until = states[:, 0]
        at = np.where(np.isnan(until), 0, np.searchsorted(upper, until))
        hit = at < len(upper)
        return np.where(hit, exits[np.minimum(at, len(upper) - 1)], until).reshape(-1, 1)

    def compose(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        upper, exits = self.pieces(first)
        more, beyond = self.pieces(second)
        if not len(upper):
            return self.packed(first[0], more, beyond)
        new = more > upper[-1]
        moved = self.apply(second, exits.reshape(-1, 1))[:, 0]
        return self.packed(first[0], np.append(upper, more[new]), np.append(moved, beyond[new]))


@dataclass(frozen=True)
class Bucket:
    """The token bucket: state (tokens left, time of the last allowed row), refills of whole tokens since that time.

    Entered with a token or more, or after a whole refill, a slice allows its first row, and the tokens left then, below the
    capacity, decide all: ``full`` holds an outcome for each number.  Entered empty, it allows the first row a refill after the
    last allowed one; that row is a piece of the phase.  Pieces run over one refill interval, and neighbours with the same
    outcome share one, known by its last time.  A piece keeps three outcomes, for ``base``, ``base`` + 1 and ``base`` + 2 tokens
    refilled: between two rows the refill can only take these values.

    A table is made from its end: with ``v`` tokens left at a row, the next row leaves ``v`` - 1 plus the refill between them,
    so the outcomes of a row are those of the next one, shifted.
    """

    capacity: int
    per_minute: float
    width = 2

    def ends(self, *inputs: np.ndarray) -> float:
        return FAR

    def refill(self, since, now):
        """Tokens between two times; the very expression of the fold."""
        return np.trunc((now - since) / 60 * self.per_minute)

    def table(self, bound: float, now: np.ndarray) -> np.ndarray:
        times = now[~np.isnan(now)]
        n, cap = len(times), self.capacity
        if not n:
            return np.zeros(0)
        gaps = (times[1:] - times[:-1]) / 60 * self.per_minute
        t, gaps = times.tolist(), [0.0, *gaps.tolist()]
        rate = self.per_minute
        outcomes = deque((v, t[-1]) for v in range(cap))
        empty: list = [None] * n  # outcome of being left without tokens at a row
        empty[-1] = (0, t[-1])
        picks: dict[int, list] = {}

        def note(i: int) -> None:
            if gaps[i] > 1 - 1e-6:
                base = max(int(gaps[i]), 1)
                picks[i] = [outcomes[min(cap, q) - 1] for q in (base, base + 1, base + 2)]

        note(n - 1)
        ready = n  # first row a refill after row i
        for i in range(n - 2, -1, -1):
            while ready - 1 > i and int((t[ready - 1] - t[i]) / 60 * rate) >= 1:
                ready -= 1
            if ready == n:
                empty[i] = (0, t[i])
            else:
                q = int((t[ready] - t[i]) / 60 * rate)
                empty[i] = picks[ready][q - max(int(gaps[ready]), 1)] if ready in picks else empty[ready]
            g = int(gaps[i + 1])
            if g:
                top = outcomes[-1]
                for _ in range(min(g, cap - 1)):
                    outcomes.popleft()
                outcomes.extend([top] * (cap - 1 - len(outcomes)))
                while len(outcomes) > cap - 1:
                    outcomes.pop()
            else:
                outcomes.pop()
            outcomes.appendleft(empty[i])
            note(i)
        upper, base, exits = [], [], []
        for j in range(1, n):
            upper.append(t[j])
            base.append(max(int(gaps[j]), 1) if j in picks else 0)
            exits.append(picks.get(j) or [empty[j]] * 3)
            if int((t[j] - t[0]) / 60 * rate) >= 1:
                break
        return self.packed(t[0], t[-1], np.array(outcomes, float), np.array(upper), np.array(base, float), np.array(exits, float).reshape(-1, 3, 2))

    def packed(self, begin: float, end: float, full: np.ndarray, upper: np.ndarray, base: np.ndarray, exits: np.ndarray) -> np.ndarray:
        reach = np.flatnonzero(self.refill(begin, upper) >= 1)
        if len(reach):
            upper, base, exits = (x[: reach[0] + 1] for x in (upper, base, exits))
        # base 0 marks pieces of rows that can only be met with one token; they may share a piece
        keep = steps(np.column_stack([exits.reshape(len(exits), 6), base]))
        keep |= base > 0
        upper, base, exits = upper[keep], base[keep], exits[keep]
        return np.concatenate([[begin, end, len(upper)], full.ravel(), upper, base, exits.ravel()])

    def parts(self, table: np.ndarray):
        begin, end, m = table[0], table[1], int(table[2])
        edge = np.cumsum([3, 2 * self.capacity, m, m])
        full, upper, base, exits = np.split(table, edge)[1:]
        return begin, end, full.reshape(-1, 2), upper, base, exits.reshape(-1, 3, 2)

    def apply(self, table: np.ndarray, states: np.ndarray) -> np.ndarray:
        if not len(table):
            return states
        begin, _, full, upper, base, exits = self.parts(table)
        tokens, last = states[:, 0], states[:, 1]
        fresh = np.isnan(tokens)
        left = np.where(fresh, self.capacity, np.minimum(self.capacity, np.nan_to_num(tokens) + np.nan_to_num(self.refill(last, begin)))) - 1
        out = np.where((left >= 0)[:, None], full[np.clip(left, 0, None).astype(np.int64)], states)
        rest = np.flatnonzero(left < 0)
        if len(rest) and len(upper):
            since = last[rest]
            wait = 60 / self.per_minute if self.per_minute else FAR
            at = np.searchsorted(upper, since + wait)
            ripe = lambda k: self.refill(since, upper[np.clip(k, 0, len(upper) - 1)]) >= 1
            # the sum above may be off by a rounding; the fold's own expression decides
            while (back := (at > 0) & ripe(at - 1)).any():
                at = at - back
            while (on := (at < len(upper)) & ~ripe(at)).any():
                at = at + on
            found = at < len(upper)
            at, rest, since = at[found], rest[found], since[found]
            pick = np.where(base[at] > 0, np.clip(self.refill(since, upper[at]) - base[at], 0, 2), 0).astype(np.int64)
            out[rest] = exits[at, pick]
        return out

    def compose(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not len(first) or not len(second):
            return second if not len(first) else first
        begin, end, full, upper, base, exits = self.parts(first)
        start, stop, whole, more, bases, beyond = self.parts(second)
        gap = (start - end) / 60 * self.per_minute
        step = max(int(gap), 1)
        edge = [whole[min(self.capacity, q) - 1] for q in ((step, step + 1, step + 2) if gap > 1 - 1e-6 else (1, 1, 1))]
        moved = self.apply(second, exits.reshape(-1, 2)).reshape(-1, 3, 2)
        return self.packed(
            begin, stop, self.apply(second, full), np.concatenate([upper, [start], more]),
            np.concatenate([base, [step if gap > 1 - 1e-6 else 0], bases]), np.concatenate([moved, [edge], beyond]),
        )


Transfer = Hold | Bucket


def summaries(lean: DataFrame, group: list[str], order: list[str], inputs: list[str], transfer: Transfer, bounds: DataFrame | None) -> DataFrame:
    """A row per slice of ``group``: ``_end``, the latest end its rows can set, or, given ``bounds``, its ``_table``."""
    bounded = bounds is not None  # workers get the flag, not the frame
    made, kind = ("_table", pa.binary()) if bounded else ("_end", pa.float64())
    schema = T.StructType([lean.schema[c] for c in group] + [T.StructField(made, T.BinaryType() if bounded else T.DoubleType())])

    def done(named: list, blocks: list, bound: float) -> list:
        columns = [np.concatenate(c) for c in zip(*blocks)]
        return [*named, transfer.table(bound, *columns).tobytes() if bounded else transfer.ends(*columns)]

    def batch_of(found: list) -> pa.RecordBatch:
        arrays = [pa.concat_arrays([row[i] for row in found]) for i in range(len(group))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([row[-1] for row in found], kind)], names=[*group, made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, named, blocks, bound = None, [], [], FAR
        for batch in batches:
            names = heads(batch, group)
            values = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in inputs]
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            found = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if names[a] != current:
                    if current is not None:
                        found.append(done(named, blocks, bound))
                    current, named, blocks = names[a], [batch.column(c).slice(a, 1) for c in group], []
                    if bounded:
                        bound = batch.column("_bound")[a].as_py()
                blocks.append([v[a:b] for v in values])
            if found:
                yield batch_of(found)
        if current is not None:
            yield batch_of([done(named, blocks, bound)])

    if bounded:
        lean = lean.join(renamed(bounds, group), same(group)).drop(*[f"_h_{c}" for c in group])
    ready = lean.repartition(*group).sortWithinPartitions(*group, *order)
    columns = [*group, *dict.fromkeys(inputs), *(["_bound"] if bounded else [])]
    return ready.select(*columns).mapInArrow(run, schema)


def entries(lean: DataFrame, key: list[str], order: list[str], inputs: list[str], transfer: Transfer) -> DataFrame:
    """(key, _slice, _entry): the state each slice of ``lean`` is entered with; null for the empty one."""
    group = [*key, "_slice"]
    before = W.partitionBy(*key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    if isinstance(transfer, Hold):
        ends = summaries(lean, group, order, inputs, transfer, None)
        bounds = ends.select(*group, F.coalesce(F.max("_end").over(before), F.lit(-FAR)).alias("_bound"))
    else:
        bounds = lean.select(*group).distinct().withColumn("_bound", F.lit(FAR))
    tables = summaries(lean, group, order, inputs, transfer, write_table(bounds))
    tables = write_table(tables.withColumn("_at", F.row_number().over(W.partitionBy(*key).orderBy("_slice"))))
    count = tables.agg(F.max("_at")).first()[0] or 0

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, earlier in zip(batch.column("_table").to_pylist(), batch.column("_before").to_pylist()):
                out.append(own if earlier is None else transfer.compose(np.frombuffer(earlier), np.frombuffer(own)).tobytes())
            names = [c for c in batch.schema.names if c not in ("_table", "_before")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.binary())], names=[*names, "_table"])

    step, places = 1, [*key, "_at"]
    while step < count:
        earlier = tables.select(*key, (F.col("_at") + step).alias("_at"), F.col("_table").alias("_before"))
        both = tables.join(renamed(earlier, places), same(places), "left").select(*group, "_at", "_table", "_before")
        tables = write_table(both.mapInArrow(composed, T.StructType([tables.schema[c] for c in (*group, "_at", "_table")])))
        step *= 2

    def evaluated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.full((1, transfer.width), np.nan)
        for batch in batches:
            states = [transfer.apply(np.frombuffer(t), nothing)[0].tolist() for t in batch.column("_table").to_pylist()]
            states = [None if s[0] != s[0] else s for s in states]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in group], pa.array(states, pa.list_(pa.float64()))], names=[*group, "_exit"])

    schema = T.StructType([tables.schema[c] for c in group] + [T.StructField("_exit", T.ArrayType(T.DoubleType()))])
    exits = tables.mapInArrow(evaluated, schema)
    return write_table(exits.select(*group, F.lag("_exit").over(W.partitionBy(*key).orderBy("_slice")).alias("_entry")))
