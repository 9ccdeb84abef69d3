"""Ordered per-key frames that stay balanced when one key holds a large share of all rows.

Spark evaluates a window partition inside one task, and a sliding range frame re-reads its rows for every output row.
No operator here slides a range frame; each costs a constant per row or second at every key size.  Those that need a
key's order in one task spread keys of more than ``limit`` rows, whose rows are range-partitioned by key and order into
slices of about ``rows`` rows:

* ``previous``  - frames that look back a fixed number of rows; a slice gets the last rows of the slices before
  it as a halo.
* ``last_seen`` - newest non-null value so far; slices hand their last value on.
* ``running``   - sums and XORs so far; slices hand their totals on.
* ``trailing``  - aggregates over the last *s* seconds, for all keys alike.  They depend on key and second only, so rows
  collapse to one per second first.  Time is cut into panes; a frame is its own pane's prefix, the whole panes in
  between, and the oldest pane's suffix, so that each second costs O(1) however long the frame.  Tasks hold panes, so
  no key needs slices.
* ``distinct``  - distinct items over the last *s* seconds, as a running sum of arrivals and departures.

Whether a key is spread is decided from one count per key (partial aggregation, key columns only).  Results are the
same in both forms.  Rows without a time have no trailing frame: null results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil, gcd, isqrt

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskweave.session import cut as write_table

HOT_ROWS = 50_000  # rows per key from which on the key is cut
SLICE_ROWS = 1_000_000  # rows aimed at per slice
PANE_SECONDS = 600  # longest pane, unless the frame is very long
PANES = 300  # whole panes that a frame adds up


def hot_keys(df: DataFrame, key: list[str], limit: int | None) -> DataFrame:
    """Keys with more than ``limit`` rows; at most ``rows / limit`` of them."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (HOT_ROWS if limit is None else limit))


def same(columns: list[str]) -> Column:
    """Match columns against a helper table that holds them as ``_h_<name>``; a null equals itself."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in columns])


def renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_h_{c}" for c in columns})


@dataclass(frozen=True)
class Split:
    """Ordinary rows, and the hot keys' rows with ``_slice``; slices of a key are numbered in its order."""

    cold: DataFrame
    hot: DataFrame | None


def split(df: DataFrame, key: list[str], order: list[str], limit: int | None, rows: int) -> Split:
    hot = hot_keys(df, key, limit)
    total = hot.agg(F.sum("_n")).first()[0]
    if total is None:
        return Split(df, None)
    # Written once, read by both joins; Spark broadcasts the list only when it measures it small.
    hot = renamed(write_table(hot.drop("_n")), key)
    cold = df.join(hot, same(key), "left_anti")
    drop = [f"_h_{k}" for k in key]
    # Range partitioning splits any crowd, down to rows of one instant.  Writing the slice numbers fixes them.
    ranged = df.join(hot, same(key)).drop(*drop).repartitionByRange(ceil(total / rows), *key, *order)
    return Split(cold, write_table(ranged.withColumn("_slice", F.spark_partition_id())))


@dataclass(frozen=True)
class Op:
    """One step in two forms; ``cut`` gets, and keeps, the column ``_slice``."""

    plain: Callable[[DataFrame], DataFrame]
    cut: Callable[[DataFrame], DataFrame]


def apply(df: DataFrame, key: list[str], order: list[str], ops: list[Op], limit: int | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """Run ``ops`` in turn: the plain forms for ordinary keys, the cut forms for hot ones, which are found once."""
    if all(op.plain is op.cut for op in ops):  # no step needs a key in one task
        return reduce(lambda part, op: op.plain(part), ops, df)
    parts = split(df, key, order, limit, rows)
    cold = reduce(lambda part, op: op.plain(part), ops, parts.cold)
    if parts.hot is None:
        return cold
    hot = parts.hot
    for i, op in enumerate(ops):
        # A cut form reads its input more than once; a table between steps keeps that from multiplying.
        hot = op.cut(write_table(hot) if i else hot)
    return cold.unionByName(hot.drop("_slice"))


def previous(key: list[str], order: list[str], back: int, build: Callable[[WindowSpec], dict[str, Column]]) -> Op:
    """Add the columns ``build`` makes over a window ordered by ``order`` that looks back at most ``back`` rows."""

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumns(build(W.partitionBy(*key).orderBy(*order)))

    def cut(part: DataFrame) -> DataFrame:
        newest = W.partitionBy(*key, "_slice").orderBy(*[F.col(c).desc() for c in order])
        row = F.struct(*order, F.struct(*part.columns).alias("_row"))
        tails = (
            part.withColumn("_r", F.row_number().over(newest))
            .where(F.col("_r") <= back)
            .groupBy(*key, "_slice")
            .agg(F.array_sort(F.collect_list(row)).alias("_tail"))
        )
        # Every slice here has a row, so the ``back`` slices before hold the last ``back`` rows.
        held = F.flatten(F.collect_list("_tail").over(W.partitionBy(*key).orderBy("_slice").rowsBetween(-back, -1)))
        recent = F.slice("_held", F.greatest(F.lit(1), F.size("_held") - back + 1), back)
        halo = (
            tails.select("_slice", held.alias("_held"))
            .select(F.col("_slice").alias("_into"), F.explode(recent).alias("_x"))
            .select("_x._row.*", "_into")
            .withColumns({"_slice": F.col("_into"), "_halo": F.lit(True)})
            .drop("_into")
        )
        both = part.withColumn("_halo", F.lit(False)).unionByName(halo)
        spec = W.partitionBy(*key, "_slice").orderBy(*order)
        return both.withColumns(build(spec)).where(~F.col("_halo")).drop("_halo")

    return Op(plain, cut)


def last_seen(key: list[str], order: list[str], value: str, name: str) -> Op:
    """Add ``name``: the newest non-null ``value`` of the key up to and including the row."""

    def last_over(spec: WindowSpec) -> Column:
        return F.last(value, ignorenulls=True).over(spec.rowsBetween(W.unboundedPreceding, 0))

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumn(name, last_over(W.partitionBy(*key).orderBy(*order)))

    def cut(part: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
        ends = part.groupBy(*key, "_slice").agg(newest.alias("_end"))
        before = W.partitionBy(*key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        carry = ends.select(*key, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
        joined = part.join(renamed(carry, [*key, "_slice"]), same([*key, "_slice"]), "left")
        found = F.coalesce(last_over(W.partitionBy(*key, "_slice").orderBy(*order)), F.col(f"_carry.{value}"))
        return joined.withColumn(name, found).select(*part.columns, name)

    return Op(plain, cut)


def running(key: list[str], order: list[str], made: dict[str, tuple[Column, str]]) -> Op:
    """Add running aggregates up to and including the row: ``made`` maps a new column to (value, ``sum`` or ``bit_xor``)."""
    merge = {"sum": (F.sum, lambda a, b: a + b), "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}

    def up_to(*part: str) -> WindowSpec:
        return W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumns({n: merge[how][0](v).over(up_to(*key)) for n, (v, how) in made.items()})

    def cut(part: DataFrame) -> DataFrame:
        group = [*key, "_slice"]
        totals = part.groupBy(*group).agg(*[merge[how][0](v).alias(f"_c_{n}") for n, (v, how) in made.items()])
        before = W.partitionBy(*key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        carry = totals.select(*group, *[F.coalesce(merge[how][0](f"_c_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n, (_, how) in made.items()])
        joined = part.join(renamed(carry, group), same(group))
        here = {n: merge[how][1](merge[how][0](v).over(up_to(*group)), F.col(f"_c_{n}")) for n, (v, how) in made.items()}
        return joined.withColumns(here).select(*part.columns, *here)

    return Op(plain, cut)


def pane_seconds(lengths: list[int]) -> int | None:
    """The longest common divisor of the lengths up to ``PANE_SECONDS``, if no frame needs more than ``PANES`` of it; for one
    length without such a divisor about its square root or ``PANE_SECONDS``; none for several."""
    unit = reduce(gcd, lengths)
    pane = max(d for d in range(1, min(unit, PANE_SECONDS) + 1) if unit % d == 0)
    if lengths[-1] <= PANES * pane:
        return pane
    return min(max(PANE_SECONDS, isqrt(lengths[0])), lengths[0]) if len(lengths) == 1 else None


def trailing(key: list[str], ts: str, frames: dict[str, tuple[str, str | None, int]]) -> Op:
    """Add aggregates over the last seconds, current second included.

    ``frames`` maps a new column to (aggregate, value column, seconds); the aggregate is ``sum``, ``count``,
    ``avg`` or ``max``, and ``count`` counts rows.
    """

    lengths = sorted({seconds for _, _, seconds in frames.values()})
    values = sorted({value for _, value, _ in frames.values() if value})
    if lengths[0] < 1:
        raise ValueError("a trailing frame is at least one second long")
    pane = pane_seconds(lengths)
    if pane is None:  # lengths without a common pane go one by one
        each = [trailing(key, ts, {n: f for n, f in frames.items() if f[2] == s}) for s in lengths]
        one_by_one = lambda part: reduce(lambda out, op: op.plain(out), each, part).select(*part.columns, *frames)
        return Op(one_by_one, one_by_one)

    # The parts each length adds up: a frame's aggregate asks for its own, and nothing else is carried.
    asked: dict[int, list[str]] = {s: [] for s in lengths}
    for how, value, s in frames.values():
        i = values.index(value) if value else 0
        names = {"count": ["_rows"], "max": [f"_m{i}"]}.get(how, [f"_s{i}", f"_k{i}"])
        asked[s] += [c for c in names if c not in asked[s]]
    parts = sorted({c for names in asked.values() for c in names})

    def run(part: DataFrame) -> DataFrame:
        every = {"_rows": F.count(F.lit(1))}
        for i, value in enumerate(values):
            every |= {f"_s{i}": F.sum(value), f"_k{i}": F.count(value), f"_m{i}": F.max(value)}
        made = {c: every[c] for c in parts}
        combine = {c: (F.max if c.startswith("_m") else F.sum) for c in parts}
        seconds = part.groupBy(*key, F.col(ts).alias("_at")).agg(*[c.alias(n) for n, c in made.items()])
        own = seconds.withColumns({"_pane": F.floor(F.col("_at") / pane), "_len": F.lit(0)})
        # The suffix of the oldest pane: its seconds move on by the frame's length and meet the rows they expire at.
        halo = own.drop("_len").withColumn("_len", F.explode(F.array(*[F.lit(s) for s in lengths])))
        halo = halo.withColumn("_at", F.col("_at") + F.col("_len")).withColumn("_pane", F.floor(F.col("_at") / pane))
        whole = own.groupBy(*key, "_pane").agg(*[combine[c](c).alias(c) for c in parts])
        for s in lengths:
            for name, panes in (("_in", s // pane - 1), ("_on", s // pane)):  # _on: where the frame reaches one pane further
                inner = W.partitionBy(*key).orderBy("_pane").rangeBetween(-panes, -1)
                if name == "_in" or s % pane:
                    whole = whole.withColumns({f"{name}{s}{c}": combine[c](c).over(inner) if panes else F.lit(None) for c in asked[s]})
        whole = renamed(whole.drop(*parts), [*key, "_pane"])

        prefix = W.partitionBy(*key, "_pane").orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
        # Seconds share a suffix by the pane that the frame begins in.
        oldest = {s: F.col("_pane") if s % pane == 0 else F.floor((F.col("_at") - s) / pane) for s in lengths}
        suffix = {s: W.partitionBy(*key, oldest[s]).orderBy(F.col("_at").desc()).rangeBetween(W.unboundedPreceding, 0) for s in lengths}
        ends = {f"_p{c}": combine[c](F.when(F.col("_len") == 0, F.col(c))).over(prefix) for c in parts}
        for s in lengths:
            ends |= {f"_x{s}{c}": combine[c](F.when(F.col("_len") == s, F.col(c))).over(suffix[s]) for c in asked[s]}
        done = own.unionByName(halo).withColumns(ends).where(F.col("_len") == 0)
        done = done.join(whole, same([*key, "_pane"]), "left")

        def total(c: str, s: int) -> Column:
            between = F.col(f"_in{s}{c}")
            if s % pane:
                between = F.when(F.pmod(F.col("_at"), F.lit(pane)) < s % pane, F.col(f"_on{s}{c}")).otherwise(between)
            pieces = [F.col(f"_p{c}"), between, F.col(f"_x{s}{c}")]
            if c.startswith("_m"):
                return F.greatest(*pieces)
            return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in pieces])

        out = {}
        for name, (how, value, s) in frames.items():
            i = values.index(value) if value else 0
            if how == "count":
                out[name] = total("_rows", s)
            elif how == "max":
                out[name] = total(f"_m{i}", s)
            else:
                mean = total(f"_s{i}", s) / total(f"_k{i}", s) if how == "avg" else total(f"_s{i}", s)
                out[name] = F.when(total(f"_k{i}", s) > 0, mean)
        result = renamed(done.select(*key, F.col("_at"), *[c.alias(n) for n, c in out.items()]), key)
        # One result per key and second; AQE splits a crowded second on the row side of this join.
        return part.join(result, same(key) & (F.col(ts) == F.col("_at")), "left").select(*part.columns, *out)

    return Op(run, run)


def distinct(key: list[str], ts: str, item: str, seconds: int, name: str, rows: int = SLICE_ROWS) -> Op:
    """Add ``name``: the number of distinct non-null ``item`` over the last ``seconds``, current second included."""

    def changes(part: DataFrame) -> DataFrame:
        # An item counts from a sighting until `seconds` after it, unless seen again by then: +1 where such a stay
        # begins, -1 just after it ends.  Repeats inside a second collapse before the shuffle, and so do the steps
        # of a second, so a key has at most two rows per second of its time span.
        seen = part.where(F.col(item).isNotNull()).select(*key, item, ts).distinct()
        by_item = W.partitionBy(*key, item).orderBy(ts)
        arrives = F.coalesce(F.col(ts) - F.lag(ts).over(by_item) > seconds, F.lit(True))
        leaves = F.coalesce(F.lead(ts).over(by_item) - F.col(ts) > seconds, F.lit(True))
        stays = seen.select(*key, ts, arrives.cast("bigint").alias("_in"), leaves.cast("bigint").alias("_out"))
        steps = F.array(
            F.struct(F.col(ts).alias("_at"), F.col("_in").alias("_d")),
            F.struct((F.col(ts) + seconds + 1).alias("_at"), (-F.col("_out")).alias("_d")),
        )
        marks = part.select(*key, F.col(ts).alias("_at"), F.lit(0).cast("bigint").alias("_d"))
        moves = stays.select(*key, F.explode(steps).alias("_s")).select(*key, "_s.*").where("_d <> 0").unionByName(marks)
        return moves.groupBy(*key, "_at").agg(F.sum("_d").alias("_d"))

    def found(part: DataFrame, counts: DataFrame) -> DataFrame:
        both = part.join(renamed(counts, key), same(key) & (F.col(ts) == F.col("_at")), "left")
        return both.select(*part.columns, name)

    def plain(part: DataFrame) -> DataFrame:
        within = W.partitionBy(*key).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
        return found(part, changes(part).select(*key, "_at", F.sum("_d").over(within).alias(name)))

    def cut(part: DataFrame) -> DataFrame:
        moves = changes(part)
        parts = max(1, part.select("_slice").agg(F.max("_slice")).first()[0] or 1)
        sliced = write_table(moves.repartitionByRange(parts, *key, "_at").withColumn("_slice", F.spark_partition_id()))
        sums = sliced.groupBy(*key, "_slice").agg(F.sum("_d").alias("_d"))
        before = W.partitionBy(*key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        carry = sums.select(*key, "_slice", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_carry"))
        within = W.partitionBy(*key, "_slice").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
        joined = sliced.join(renamed(carry, [*key, "_slice"]), same([*key, "_slice"]), "left")
        return found(part, joined.select(*key, "_at", (F.col("_carry") + F.sum("_d").over(within)).alias(name)))

    return Op(plain, cut)


def over_previous(df: DataFrame, key: list[str], order: list[str], back: int, build, limit: int | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    return apply(df, key, order, [previous(key, order, back, build)], limit, rows)


def running_last(df: DataFrame, key: list[str], order: list[str], value: str, name: str, limit: int | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    return apply(df, key, order, [last_seen(key, order, value, name)], limit, rows)


def over_trailing(df: DataFrame, key: list[str], ts: str, frames: dict, limit: int | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    return apply(df, key, [ts], [trailing(key, ts, frames)], limit, rows)


def distinct_trailing(df: DataFrame, key: list[str], ts: str, item: str, seconds: int, name: str, limit: int | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    return apply(df, key, [ts], [distinct(key, ts, item, seconds, name)], limit, rows)
