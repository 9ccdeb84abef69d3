"""Ordered folds: a small state per key, updated row by row in time order.

Rows are shuffled by key, sorted inside the task, and streamed through ``mapInArrow`` in batches, so a key is never
held in memory.  Columns that the step doesn't read pass through as they came; keys and inputs reach it as plain Python
values, so a null stays null and a large integer stays exact.  A NaN key equals itself.

A hot key is cut into time slices that run side by side.  Folds with a ``transfer`` function get the entry state of every
slice from a scan over the slices' transfer tables (:mod:`riskweave.operators.transfer`), whether or not they forget their
past.  For the others a slice first runs from the empty state; where the state its
predecessor really ends with differs, that slice runs again.  Folds that forget their past settle in ``ROUNDS`` such
rounds.  A key that has not settled by then is run once more in order, from its first unsettled slice to its end, as one
stream: at most ``ROUNDS`` + 2 passes over the rows, whatever the number of slices.  The result is the sequential one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from riskweave.operators.frames import SLICE_ROWS, renamed, same, split
from riskweave.operators.transfer import Transfer, entries, heads
from riskweave.session import cut as write_table

ROUNDS = 2  # rounds in which all unsettled slices run again side by side

State = list[float] | None
Step = Callable[[State, tuple], tuple[State, tuple]]


def _runner(group: list[str], inputs: list[str], outputs: T.StructType | None, step: Step, carried: int):
    """Rows with ``outputs``, or without them one row per group and its last state.  Groups whose first ``carried`` values
    are those of the group before go on with its state (0: none do)."""
    made = [(f.name, to_arrow_type(f.dataType)) for f in outputs] if outputs is not None else None

    def ends(found: list) -> pa.RecordBatch:
        columns = [pa.concat_arrays([row[i] for row, _ in found]) for i in range(len(group))]
        states = pa.array([state for _, state in found], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*columns, states], names=[*group, "_exit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, named = None, None, None
        for batch in batches:
            results, found = [], []
            rows = zip(*[batch.column(c).to_pylist() for c in inputs])
            for i, (head, row) in enumerate(zip(heads(batch, group), rows)):
                if head != current:
                    if made is None and current is not None:
                        found.append((named, state))
                    if not (carried and current is not None and head[:carried] == current[:carried]):
                        state = batch.column("_entry")[i].as_py()
                    current, named = head, [batch.column(c).slice(i, 1) for c in group]
                state, out = step(state, row)
                results.append(out)
            if made is None:
                if found:
                    yield ends(found)
                continue
            names = [c for c in batch.schema.names if c != "_entry"]
            new = [pa.array([r[j] for r in results], kind) for j, (_, kind) in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *new], names=[*names, *[n for n, _ in made]])
        if made is None and current is not None:
            yield ends([(named, state)])

    return run


def _rows(df: DataFrame, group: list[str], order: list[str], inputs: list[str], outputs: T.StructType, step: Step) -> DataFrame:
    ready = df.repartition(*group).sortWithinPartitions(*group, *order)
    schema = T.StructType([f for f in df.schema if f.name != "_entry"] + list(outputs))
    return ready.mapInArrow(_runner(group, inputs, outputs, step, 0), schema)


def _ends(df: DataFrame, key: list[str], order: list[str], inputs: list[str], step: Step, carry: bool = False) -> DataFrame:
    """(key, _slice, _exit); with ``carry`` a slice goes on from the one before and a key stays in one task."""
    group = [*key, "_slice"]
    ready = df.repartition(*(key if carry else group)).sortWithinPartitions(*group, *order)
    kept = ready.select(*dict.fromkeys([*group, *inputs, "_entry"]))
    schema = T.StructType([df.schema[c] for c in group] + [T.StructField("_exit", T.ArrayType(T.DoubleType()))])
    return kept.mapInArrow(_runner(group, inputs, None, step, len(key) if carry else 0), schema)


def _entered(hot: DataFrame, states: DataFrame, group: list[str], order: list[str], inputs: list[str], outputs: T.StructType, step: Step) -> DataFrame:
    """The rows of all slices, run side by side from their entry ``states``."""
    ready = hot.join(renamed(states, group), same(group)).drop(*[f"_h_{c}" for c in group])
    return _rows(ready, group, order, inputs, outputs, step).drop("_slice")


def ordered_fold(
    df: DataFrame,
    key: list[str],
    order: list[str],
    inputs: list[str],
    outputs: T.StructType,
    step: Step,
    limit: int | None = None,
    rows: int = SLICE_ROWS,
    transfer: Transfer | None = None,
) -> DataFrame:
    """Add ``outputs`` of ``step(state, inputs) -> (state, outputs)``; the state is a list of doubles, null at first."""
    empty = F.lit(None).cast("array<double>")
    parts = split(df, key, order, limit, rows)
    cold = _rows(parts.cold.withColumn("_entry", empty), key, order, inputs, outputs, step)
    if parts.hot is None:
        return cold
    group = [*key, "_slice"]
    lean = parts.hot.select(*dict.fromkeys([*group, *order, *inputs]))
    if transfer is not None:
        return cold.unionByName(_entered(parts.hot, entries(lean, key, order, inputs, transfer), group, order, inputs, outputs, step))
    ends = write_table(_ends(lean.withColumn("_entry", empty), key, order, inputs, step).withColumn("_entry", empty))
    handed = F.lag("_exit").over(W.partitionBy(*key).orderBy("_slice"))
    for number in range(ROUNDS + 1):
        stale = ends.withColumn("_want", handed).where(~F.col("_want").eqNullSafe(F.col("_entry")))
        stale = write_table(stale.select(*group, F.col("_want").alias("_entry")))
        if stale.isEmpty():
            break
        if number < ROUNDS:
            again = lean.join(renamed(stale, group), same(group)).drop(*[f"_h_{c}" for c in group])
            redone = _ends(again, key, order, inputs, step)
        else:
            begin = stale.groupBy(*key).agg(F.min("_slice").alias("_from"), F.min_by("_entry", "_slice").alias("_entry"))
            again = lean.join(renamed(begin, key), same(key)).where(F.col("_slice") >= F.col("_from"))
            redone = _ends(again.drop("_from", *[f"_h_{c}" for c in key]), key, order, inputs, step, carry=True)
        redone = write_table(redone)
        kept = ends.join(renamed(redone.select(*group), group), same(group), "left_anti")
        wanted = renamed(stale, group)
        fresh = redone.join(wanted, same(group), "left").select(*group, "_exit", "_entry")
        ends = write_table(kept.unionByName(fresh))
    settled = ends.select(*group, handed.alias("_entry"))
    return cold.unionByName(_entered(parts.hot, settled, group, order, inputs, outputs, step))
