"""Transfer tables of slices, alone and composed, against the plain fold."""

import math
import random

import numpy as np
import pytest

from riskweave.operators import controls
from riskweave.operators.transfer import FAR, Bucket, Hold


def fold(step, state, rows):
    for row in rows:
        state, _ = step(state, row)
    return state


def as_state(values, width):
    return None if math.isnan(values[0]) else [float(v) for v in values[:width]]


def times(rng, n, shape):
    gaps = {
        "dense": lambda: rng.choice([0, 0.001, 0.25]), "sparse": lambda: rng.choice([0.5, 30, 500]), "even": lambda: 1.0,
        "bursts": lambda: rng.choice([0, 0, 0, 0.1, 3, 61]), "refill": lambda: rng.choice([1.2, 0.6, 2.4, 0]),
    }[shape]
    now, out = rng.choice([0.0, 1.7e9]), []
    for _ in range(n):
        now += gaps()
        out.append(now if rng.random() > 0.05 else float("nan"))
    return out


def sliced(rng, rows):
    cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(6)))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def check(transfer, step, slices, columns, entry, bound):
    """Tables composed from the left, from the right and one by one give the fold's state."""
    tables = [transfer.table(bound, *columns(part)) for part in slices]
    want = fold(step, entry, [r for part in slices for r in part])
    start = np.array([entry if entry else [np.nan] * transfer.width], float)
    one = start
    for table in tables:
        one = transfer.apply(table, one)
    left = tables[0]
    for table in tables[1:]:
        left = transfer.compose(left, table)
    right = tables[-1]
    for table in reversed(tables[:-1]):
        right = transfer.compose(table, right)
    for got in (one, transfer.apply(left, start), transfer.apply(right, start)):
        assert as_state(got[0], transfer.width) == want


@pytest.mark.parametrize("shape", ["dense", "sparse", "even", "bursts", "refill"])
def test_bucket(shape):
    rng = random.Random(shape)
    for _ in range(120):
        capacity, per_minute = rng.choice([1, 2, 3, 100]), rng.choice([0, 0.002, 1, 50, 59, 6000])
        rows = [(t,) for t in times(rng, rng.randrange(1, 120), shape)]
        known = [t for (t,) in rows if t == t]
        first = known[0] if known else 0.0
        entry = rng.choice([None, [float(rng.randrange(capacity)), first - rng.choice([0, 0.3, 1.2, 40, 5000])], [0.0, first]])
        columns = lambda part: [np.array([t for (t,) in part], float)]
        check(Bucket(capacity, per_minute), controls.bucket_step(capacity, per_minute), sliced(rng, rows), columns, entry, FAR)


@pytest.mark.parametrize("shape", ["dense", "sparse", "even", "bursts"])
def test_hold(shape):
    rng = random.Random(shape)
    for _ in range(120):
        ttl = rng.choice([0, 0.3, 2, 60, 600])
        rows = [(t,) for t in times(rng, rng.randrange(1, 120), shape)]
        known = [t for (t,) in rows if t == t]
        entry = rng.choice([None, [(known[0] if known else 0.0) + rng.choice([-5, 0, 0.2, ttl])]])

        def holds(now, ttl=ttl):
            now = now[~np.isnan(now)]
            return now, now + ttl

        bound = FAR if entry is None else entry[0]
        check(Hold(holds), controls.ttl_step(ttl), sliced(rng, rows), lambda part: [np.array([t for (t,) in part], float)], entry, FAR)
        check(Hold(holds), controls.ttl_step(ttl), [rows], lambda part: [np.array([t for (t,) in part], float)], entry, bound)


def test_replay_ends_vary_by_row():
    rng = random.Random(9)
    good = lambda now, exp: (now[exp - now > 0], exp[exp - now > 0])
    for _ in range(200):
        rows = [(t, rng.choice([None, float("nan"), t - 1, t, t + rng.choice([0.1, 5, 300])])) for t in times(rng, 60, rng.choice(["dense", "bursts", "even"]))]
        columns = lambda part: [np.array([t for t, _ in part], float), np.array([np.nan if e is None else e for _, e in part], float)]
        check(Hold(good), controls.replay_step(), sliced(rng, rows), columns, None, FAR)


def test_tables_are_small_where_outcomes_meet():
    now = np.arange(200_000) * 0.01
    table = Bucket(100, 50).table(FAR, now)
    assert len(table) < 3 + 200 + 8 * 130  # one refill interval of 120 rows
    hold = Hold(lambda t: (t, t + 5))
    assert len(hold.table(now[0] + 5, now)) <= 1 + 2 * 502
