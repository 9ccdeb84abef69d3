"""Embedding whitening: float32 eigenvectors of the distributed covariance, refined in higher precision.

Entries ``c`` become whole numbers ``x = floor(1024 * c) + 100000``.  One pass adds up count, exact sums and the scatter of each
partition about its own mean; partial scatters are merged pairwise (Chan's update), in two levels of tasks, so the driver gets
one matrix.  Its eigenvectors are taken in float32 and corrected by Ogita and Aishima's iteration, which is made of matrix
products only, in extended precision (numpy's ``longdouble``).  Where eigenvalues lie closer together than the iteration can
tell apart, their vectors are rotated by the eigenvectors of the small projected matrix (a sub-solve) and refined on.

Bounds: a task holds a few matrices of dimension squared, the driver one in extended precision; both grow with the dimension
only, never with the rows.

Edge rows: null vectors, vectors with null or non-finite entries or with entries beyond 2**21, and vectors whose length is not
the commonest one (ties: the longest) are left out; repeated rows and null ids count each; no rows left means an empty
result; a component whose eigenvalue vanishes within rounding has null ``whitened`` and no part in ``identity_error``;
``deviation`` is null where it exceeds a long; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import cut

SCALE, SHIFT, LIMIT = 1024, 100_000, 2.0**21
CELLS = 1 << 20  # entries worked on at once
WIDE = np.longdouble


def usable(column: pa.ListArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and entries (double) of the vectors that count."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False))
    rows = np.flatnonzero(size == dimension)
    flat = column.take(pa.array(rows)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dimension)
    with np.errstate(invalid="ignore"):
        good = (np.abs(values) <= LIMIT).all(axis=1)  # false for null, NaN and infinite entries too
    return rows[good], values[good]


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


@dataclass
class Moments:
    """Count, sums (Python integers or doubles) and scatter about the mean."""

    n: int
    sums: list
    scatter: np.ndarray

    def mean_from(self, pivot: list) -> np.ndarray:
        """Mean minus ``pivot``; the subtraction is exact for whole numbers."""
        return np.array([(s - self.n * p) / self.n for s, p in zip(self.sums, pivot)])

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        pivot = [s // self.n if isinstance(s, int) else s / self.n for s in self.sums]
        gap = other.mean_from(pivot) - self.mean_from(pivot)
        n = self.n + other.n
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * (other.n / n))
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], scatter)


def of_block(x: np.ndarray) -> Moments:
    """Moments of the rows of ``x`` (long or double)."""
    exact = x.dtype.kind == "i"
    sums = [int(s) if exact else float(s) for s in x.sum(axis=0)]
    if exact:
        pivot = [s // len(x) for s in sums]
        centred = (x - np.array(pivot)).astype(np.float64) - [(s - len(x) * p) / len(x) for s, p in zip(sums, pivot)]
    else:
        centred = x - x.mean(axis=0)
    return Moments(len(x), sums, centred.T @ centred)


WIRE = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("scatter", pa.list_(pa.float64()))])
KIND = "n bigint, sums array<string>, scatter array<double>"


def to_row(m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"n": [m.n], "sums": [[repr(s) for s in m.sums]], "scatter": [m.scatter.ravel()]}, schema=WIRE)


def from_rows(batch: pa.RecordBatch, dimension: int) -> Iterator[Moments]:
    for n, sums, scatter in zip(*(batch.column(c).to_pylist() for c in WIRE.names)):
        yield Moments(n, [float(s) if any(c in s for c in ".en") else int(s) for s in sums], np.array(scatter).reshape(dimension, dimension))


def total(partial: DataFrame, dimension: int) -> Moments:
    """One sum of the partial moments: about sqrt(partitions) tasks add up as many rows each, one more task adds those."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for one in from_rows(batch, dimension):
                held = one if held is None else held.merged(one)
        if held is not None:
            yield to_row(held)

    wide = max(1, isqrt(partial.rdd.getNumPartitions()))
    rows = partial.repartition(wide).mapInArrow(add, KIND).repartition(1).mapInArrow(add, KIND).collect()
    if not rows:
        return Moments(0, [0] * dimension, np.zeros((dimension, dimension)))
    row = rows[0]
    return next(from_rows(pa.RecordBatch.from_pydict({c: [row[c]] for c in WIRE.names}, schema=WIRE), dimension))


def vector_moments(vectors: DataFrame, dimension: int) -> Moments:
    """Moments of the whole-number vectors in the only column of ``vectors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                _, values = usable(batch.column(0).slice(at, step), dimension)
                if len(values):
                    one = of_block(whole(values))
                    held = one if held is None else held.merged(one)
        if held is not None:
            yield to_row(held)

    step = max(1, CELLS // dimension)
    return total(vectors.mapInArrow(run, KIND), dimension)


def commonest_length(vectors: DataFrame, column: str) -> int | None:
    sizes = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return row and row["d"]


def refine(a: np.ndarray, x: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: (vectors, eigenvalues, the distance below which eigenvalues are not told apart)."""
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ a @ x
    # rounding must leave both symmetric, or small gaps would turn its odd part into lost orthogonality
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    near = 2 * (np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, float(near)


def clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of eigenvalues whose neighbours lie within ``near``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def eigen(v: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of the symmetric matrix ``v`` to double precision; the largest
    entry of a vector is positive."""
    size = np.abs(v).max() if v.size else 0.0
    if not size:
        return np.zeros(len(v)), np.eye(len(v))
    a = (v / size).astype(WIDE)
    a = (a + a.T) / 2
    values, x = np.linalg.eigh((v / size).astype(np.float32))
    x, last = x.astype(WIDE), np.inf
    for _ in range(rounds):
        x, values, near = refine(a, x, values)
        for run in clusters(values, near):
            # sub-solve: inside a cluster the projected, shifted matrix is small and well scaled
            part, _ = np.linalg.qr(x[:, run].astype(np.float64))
            part = part.astype(WIDE)
            middle = values[run].mean()
            small = part.T @ (a @ part - middle * part)
            scale = np.abs(small).max()
            if scale:
                _, turn = np.linalg.eigh(((small + small.T) / (2 * scale)).astype(np.float64))
                x[:, run] = part @ turn.astype(WIDE)
        if near < 1e-17 * len(a) or near >= last / 2 and near < 1e-13:
            break
        last = near
    order = np.argsort(-values, kind="stable")
    x = x[:, order].astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=0))
    x *= np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1.0, 1.0)
    return (values[order] * size).astype(np.float64), x


@dataclass(frozen=True)
class Whitening:
    """A fitted model: count, exact sums, eigenvalues and vectors of the first components, and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray  # dimension x components
    trace: float

    @property
    def positive(self) -> np.ndarray:
        return self.values > np.finfo(float).eps * len(self.sums) * max(self.trace, 0.0)

    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.values]


def fit(vectors: DataFrame, column: str = "embedding", components: int = 8) -> Whitening | None:
    """The whitening of all usable vectors; none where there are no such vectors."""
    dimension = commonest_length(vectors, column)
    found = vector_moments(vectors.select(column), dimension) if dimension else None
    if not found or not found.n:
        return None
    v = found.scatter / found.n
    values, x = eigen(v)
    k = min(components, dimension)
    return Whitening(found.n, tuple(found.sums), values[:k], x[:, :k], float(np.trace(v)))


def transform(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened array) of every usable vector."""
    wire = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])
    dimension = len(model.sums)
    mean = [s // model.n for s in model.sums]
    rest = np.array([(s - model.n * m) / model.n for s, m in zip(model.sums, mean)])
    carry = np.array([model.n * m - s for s, m in zip(model.sums, mean)], dtype=object)  # n * mean - S, exact
    with np.errstate(invalid="ignore", divide="ignore"):
        scaled = np.where(model.positive, model.vectors / np.sqrt(np.maximum(model.values, 0)), 0.0)

    def deviation(y: np.ndarray) -> list:
        reach = int(np.abs(y).max(initial=0) + 1) * model.n
        if reach * reach * dimension < 1 << 63:
            return ((y * model.n + carry.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((y.astype(object) * model.n + carry) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, values = usable(part.column(1), dimension)
                y = whole(values) - np.array(mean, np.int64)
                w = (y - rest) @ scaled
                cells = [[float(c) if ok else None for c, ok in zip(line, model.positive)] for line in w]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)).cast(pa.int64()), pa.array(deviation(y), pa.int64()), pa.array(cells, wire.field("whitened").type)], schema=wire
                )

    step = max(1, CELLS // dimension)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), column).mapInArrow(run, "vec_id bigint, deviation bigint, whitened array<double>")


def identity_error(done: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of ``whitened``, measured over all its rows, minus the identity."""
    keep = np.flatnonzero(model.positive)
    if not len(keep):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                one = of_block(flat[:, keep])
                held = one if held is None else held.merged(one)
        if held is not None:
            yield to_row(held)

    found = total(done.select("whitened").mapInArrow(run, KIND), len(keep))
    return float(np.abs(found.scatter / found.n - np.eye(len(keep))).max())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component."""
    model = fit(vectors, column, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    done = cut(transform(vectors, model, vec_id, column))
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained()])
    error = F.lit(identity_error(done, model)).cast("double")
    rows = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), error.alias("identity_error"),
    )
