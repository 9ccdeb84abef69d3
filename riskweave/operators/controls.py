"""Keyed request controls over event tables: expiring deduplication, replay guard, token bucket, breaker, hash chain.

Each control is a step function ``(state, row) -> (state, outputs)``; the batch form folds it with
:func:`riskweave.operators.fold.ordered_fold` and the streaming form runs it in
:mod:`riskweave.streaming.stateful`.  ``now`` is in seconds and may have a fraction.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from riskweave.operators import frames
from riskweave.operators.fold import ordered_fold
from riskweave.operators.transfer import Bucket, Hold, heads
from riskweave.session import cut as write_table

# Defaults of the served controls.
IDEMPOTENCY_TTL = 600
BUCKET_CAPACITY, BUCKET_PER_MINUTE = 100, 50
BREAKER_FAILURES, BREAKER_WINDOW, BREAKER_OPEN = 5, 60, 30
DRIFT_WINDOW, DRIFT_DECAY = 5000, 0.9

ACCEPTED = T.StructType([T.StructField("accepted", T.BooleanType())])
REPLAY = T.StructType([T.StructField("reason", T.StringType())])
BUCKET = T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("tokens", T.LongType())])
BREAKER = T.StructType([T.StructField("state", T.StringType()), T.StructField("tripped", T.BooleanType())])
RUNNING_PSI = T.StructType([T.StructField("psi", T.DoubleType()), T.StructField("alert", T.BooleanType())])


def timeless(now) -> bool:
    """A null or NaN time: such a row gets null outputs and leaves the state as it is."""
    return now is None or now != now


def ttl_step(ttl: float):
    """State: expiry of the last accepted row."""

    def step(state, row):
        (now,) = row
        if timeless(now):
            return state, (None,)
        if state is not None and now < state[0]:
            return state, (False,)
        return [now + ttl], (True,)

    return step


def replay_step():
    """Row: now, expiry of the token itself.  State: until when the token id is remembered."""

    def step(state, row):
        now, exp = row
        if timeless(now):
            return state, (None,)
        if timeless(exp) or exp - now <= 0:
            return state, ("expired",)
        if state is not None and now < state[0]:
            return state, ("replay",)
        return [float(exp)], ("ok",)

    return step


def bucket_step(capacity: int, per_minute: float):
    """State: tokens left and time of the last allowed row; a blocked row leaves both unchanged."""

    def step(state, row):
        (now,) = row
        if timeless(now):
            return state, (None, None)
        if state is None:
            left = capacity - 1
        else:
            left = min(capacity, int(state[0]) + int((now - state[1]) / 60 * per_minute)) - 1
        if left < 0:
            return state, (False, 0)
        return [float(left), now], (True, left)

    return step


def breaker_step(failures: int, window: float, open_for: float):
    """Row: now, failed.  State: open-until, then the times of the recent failures (at most one window's)."""

    def step(state, row):
        now, failed = row
        if timeless(now):
            return state, (None, None)
        until, recent = (state[0], state[1:]) if state else (0.0, [])
        if until > now:
            return state, ("open", False)
        if not failed:
            return [0.0], ("closed", False)
        recent = [t for t in recent if t >= now - window] + [now]
        # Only whether `failures` of them lie inside the window matters, so the newest ones suffice.
        recent = recent[-failures:]
        if len(recent) >= failures:
            return [now + open_for, *recent], ("open", True)
        return [until, *recent], ("closed", False)

    return step


def drift_step(edges: dict[str, list[float]], expected: dict[str, list[float]], window: int = DRIFT_WINDOW, crit: float = 0.3):
    """Row: feature, value.  State: rows seen, then the count of each bin; counts decay once the window is full."""
    import math

    def step(state, row):
        feature, value = row
        bounds, shares = edges[feature], expected[feature]
        seen, counts = (state[0], list(state[1:])) if state else (0, [0.0] * len(shares))
        seen = min(seen + 1, window)
        if value is not None and value == value and value >= bounds[0]:
            at = len(shares) - 1
            for i in range(len(shares)):
                if value < bounds[i + 1]:
                    at = i
                    break
            counts[at] += 1
        total = sum(counts) or 1
        psi = 0.0
        for n, e in zip(counts, shares):
            o, e = max(n / total, 1e-6), max(e, 1e-6)
            psi += (o - e) * math.log(o / e)
        if seen >= window:
            counts, seen = [float(int(n * DRIFT_DECAY)) for n in counts], int(seen * DRIFT_DECAY)
        return [float(seen), *counts], (psi, psi >= crit)

    return step


def dedup_ttl(df: DataFrame, key: list[str], order: list[str], ttl: float = IDEMPOTENCY_TTL, **cut) -> DataFrame:
    """Add ``accepted``: the first row of a key, and again the first one at least ``ttl`` after an accepted one.  Rows are taken
    by ``now``; ``order`` decides among rows of one time."""

    def holds(now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        now = now[~np.isnan(now)]
        return now, now + ttl

    return ordered_fold(df, key, ["now", *order], ["now"], ACCEPTED, ttl_step(ttl), transfer=Hold(holds), **cut)


def replay_guard(df: DataFrame, token: str, order: list[str], exp: str = "exp", **cut) -> DataFrame:
    """Add ``reason`` (``ok``, ``missing_jti``, ``expired``, ``replay``) per token id.  Rows without an id need no state; the others
    are taken by ``now``, and ``order`` decides among rows of one time."""

    def holds(now: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = until - now > 0  # false for NaN
        return now[good], until[good]

    bare = df.where(F.col(token).isNull()).withColumn("reason", F.lit("missing_jti"))
    known = df.where(F.col(token).isNotNull())
    checked = ordered_fold(known, [token], ["now", *order], ["now", exp], REPLAY, replay_step(), transfer=Hold(holds), **cut)
    return checked.unionByName(bare)


def token_bucket(
    df: DataFrame, key: list[str], order: list[str], capacity: int = BUCKET_CAPACITY, per_minute: float = BUCKET_PER_MINUTE, **cut
) -> DataFrame:
    """Add ``allowed`` and ``tokens`` left; refills are whole tokens since the last allowed row.  Rows are taken by ``now``;
    ``order`` decides among rows of one time."""
    transfer = Bucket(capacity, per_minute) if capacity > 0 and per_minute >= 0 else None
    return ordered_fold(df, key, ["now", *order], ["now"], BUCKET, bucket_step(capacity, per_minute), transfer=transfer, **cut)


def breaker(
    df: DataFrame,
    key: list[str],
    order: list[str],
    failures: int = BREAKER_FAILURES,
    window: float = BREAKER_WINDOW,
    open_for: float = BREAKER_OPEN,
    **cut,
) -> DataFrame:
    """Add ``state`` after the row and ``tripped``; rows met by an open breaker are refused and not recorded."""
    return ordered_fold(df, key, order, ["now", "failed"], BREAKER, breaker_step(failures, window, open_for), **cut)


def running_drift(
    df: DataFrame, edges: dict[str, list[float]], expected: dict[str, list[float]], key: list[str], order: list[str],
    window: int = DRIFT_WINDOW, crit: float = 0.3, limit: int | None = None, rows: int = frames.SLICE_ROWS,
) -> DataFrame:
    """Add running ``psi`` and ``alert`` to rows ``feature, value``.

    ``key`` holds ``feature`` and the monitor a row reports to, as every scoring replica watches its own traffic.

    When counts decay follows from a row's number alone: after the first ``window`` rows, then each time the rows kept by the
    decay are filled up again.  So rows are numbered, cut into segments that end with a decay, and counted per segment and
    bin in parallel; only the totals of the segments, one row for hundreds, run in order.  A row's counts are the decayed ones
    its segment starts with plus those of its segment so far; segments have at most ``window`` rows whatever the key's size.
    Results are those of :func:`drift_step`; features without edges have null results.
    """
    step = window - int(window * DRIFT_DECAY)
    width = max(map(len, expected.values()))
    number = frames.running(key, order, {"_rn": (F.lit(1).cast("long"), "sum")})
    numbered = frames.apply(df, key, order, [number], limit, rows)
    segment = F.when(F.col("_rn") <= window, 0).otherwise(F.floor((F.col("_rn") - window - 1) / step) + 1)
    value = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))
    numbered = write_table(numbered.withColumns({"_seg": segment.cast("long"), "_bin": _bin(value, edges)}))

    group = [*key, "_seg"]
    ones = [F.when(F.col("_bin") == i, 1.0).otherwise(0.0) for i in range(width)]
    totals = numbered.groupBy(*group).agg(*[F.sum(one).alias(f"_b{i}") for i, one in enumerate(ones)])

    def decayed(state, row):
        held = state or [0.0] * width
        return [float(int((c + n) * DRIFT_DECAY)) for c, n in zip(held, row)], tuple(held)

    names = [f"_b{i}" for i in range(width)]
    start = T.StructType([T.StructField(f"_h{i}", T.DoubleType()) for i in range(width)])
    bases = ordered_fold(totals, key, ["_seg"], names, start, decayed, limit=sys.maxsize).drop(*names)
    within = W.partitionBy(*group).orderBy("_rn").rowsBetween(W.unboundedPreceding, 0)
    counted = numbered.withColumns({f"_n{i}": F.sum(one).over(within) for i, one in enumerate(ones)})
    joined = counted.join(frames.renamed(bases, group), frames.same(group))
    found = joined.withColumn("psi", _psi([F.col(f"_h{i}") + F.col(f"_n{i}") for i in range(width)], expected))
    return found.select(*df.columns, "psi", (F.col("psi") >= crit).alias("alert"))


def _bin(value: Column, edges: dict[str, list[float]]) -> Column:
    """The bin of a value of the row's feature: the first whose upper edge exceeds it, else the last; null below the first edge."""
    out = F.lit(None).cast("int")
    for name, bounds in edges.items():
        place = F.lit(len(bounds) - 2)
        for i in range(len(bounds) - 3, -1, -1):
            place = F.when(value < bounds[i + 1], i).otherwise(place)
        out = F.when(F.col("feature") == name, F.when(value >= bounds[0], place)).otherwise(out)
    return out


def _psi(counts: list[Column], expected: dict[str, list[float]]) -> Column:
    out = F.lit(None).cast("double")
    for name, shares in expected.items():
        own = counts[: len(shares)]
        total = F.greatest(reduce(lambda a, b: a + b, own), F.lit(0.0))
        total = F.when(total == 0, 1.0).otherwise(total)
        terms = F.lit(0.0)
        for n, e in zip(own, shares):
            o, e = F.greatest(n / total, F.lit(1e-6)), max(e, 1e-6)
            terms = terms + (o - e) * F.log(o / e)
        out = F.when(F.col("feature") == name, terms).otherwise(out)
    return out


def hash_chain(df: DataFrame, key: list[str], order: list[str], payload: str) -> DataFrame:
    """Add ``chain``: SHA-256 of the previous link and the row's payload, per key in ``order``.

    A chain is sequential by definition.  Rows stream through the task in Arrow batches and only the last link
    is kept, so a long chain costs time and no memory.
    """
    ready = df.repartition(*key).sortWithinPartitions(*key, *order)
    schema = T.StructType([*df.schema.fields, T.StructField("chain", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, b""
        for batch in batches:
            links = []
            for head, text in zip(heads(batch, key), batch.column(payload).to_pylist()):
                if head != current:
                    current, last = head, b""
                last = hashlib.sha256(last + (text or "").encode()).digest()
                links.append(last.hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(links, pa.string())], names=[*batch.schema.names, "chain"])

    return ready.mapInArrow(run, schema)


def auth_reason(steps: dict[str, Column]) -> Column:
    """Reason code of the first failing step; null when all pass.  ``steps`` maps reason to its failure condition."""
    out = None
    for reason, failed in steps.items():
        hit = F.coalesce(failed, F.lit(False))
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out
