"""Whitening of vectors: principal components of a distributed covariance, to double precision.

Entries become integers, so counts and sums are exact and deviations from the mean are taken before multiplying. The
covariance is d by d and its eigenvectors are found on the driver: first in float32, then corrected by rounds of matrix
products in extended precision (each about squares the error). A round can't tell eigenvalues apart that are as close as
its own error; the vectors of such a cluster are turned by the eigenvectors of the matrix seen from their span, a small
problem of its own, scaled to the cluster's width.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entries c become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64.0, 1_000_000
#: Components returned, values worked on at once in a task, tasks that add up partial sums.
COMPONENTS, CELLS, FAN = 32, 1 << 20, 16
#: Rounds of correction tried; type in which corrections are computed.
ROUNDS, WIDE = 30, np.longdouble
#: Largest entry taken as it is: larger ones would leave the range of 64-bit integers.
LARGEST = float(2**62)


def fitting(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, x`` of the rows with a vector of finite entries; other rows are left out."""
    x = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col(f"`{key}`").alias("key"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0) & ~bad)


def common_width(rows: DataFrame) -> int | None:
    """The most frequent width of the vectors (the least of equally frequent ones); none without rows."""
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return found and found["d"]


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The integers of a batch, one row each."""
    c = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(SCALE * c) + SHIFT, -LARGEST, LARGEST).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, CELLS // d)
    for batch in batches:
        for at in range(0, len(batch), step):
            some = batch.slice(at, step)
            yield some, _matrix(some, d)


def _summed(rows: DataFrame, part: Callable[[Iterator[np.ndarray]], np.ndarray], d: int) -> np.ndarray:
    """The sum of ``part`` over all tasks: ``FAN`` tasks add up what the others found, and the driver their results.

    Arrays of Python integers stay exact; arrays of floats are added in extended precision.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield one(part(x for _, x in _blocks(batches, d)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for piece in batch.column("sum"):
                value = pickle.loads(piece.as_py())
                total = value if total is None else total + value
        if total is not None:
            yield one(total)

    def one(value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.binary())], names=["sum"])

    sums = rows.select("x").mapInArrow(partial, "sum binary").repartition(FAN).mapInArrow(add, "sum binary")
    return sum(pickle.loads(r["sum"]) for r in sums.toLocalIterator())


def exact_sums(rows: DataFrame, d: int) -> np.ndarray:
    """Row count, then the sum of every dimension, as Python integers."""

    def part(blocks: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros(d + 1, object)
        for x in blocks:
            # Halves of 32 bits: no sum of a block leaves 64 bits.
            high, low = x >> 32, x & 0xFFFFFFFF
            total[0] += len(x)
            total[1:] += high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)
        return total

    return _summed(rows, part, d)


def _centred(x: np.ndarray, middle: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``x`` less the mean, which is a whole number and a rest below one: no digits are lost to the mean's size."""
    return (x - middle).astype(np.float64) - rest


def covariance(rows: DataFrame, d: int, middle: np.ndarray, rest: np.ndarray, n: int,
               turn: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) in extended precision; of the rows times ``turn``, if given."""
    width = d if turn is None else turn.shape[1]

    def part(blocks: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((width + 1, width), WIDE)
        for x in blocks:
            y = _centred(x, middle, rest)
            y = y if turn is None else y @ turn
            total[:-1] += y.T @ y
            total[-1] += y.sum(axis=0)
        return total

    total = _summed(rows, part, d)
    mean = total[-1] / n  # what rounding left of it
    return total[:-1] / n - np.outer(mean, mean)


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Groups of two or more values, in which neighbours are at most ``gap`` apart."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One round: corrected vectors, their values, the width below which values count as one cluster, the correction."""
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    # Of one pair, both corrections must come from the same numbers, or their rounding errors bend the right angle.
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    # Frobenius norms: an upper bound of the spectral ones.
    gap = 2 * (np.sqrt((off**2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((r**2).sum()))
    between = values[None, :] - values[:, None]
    far = np.abs(between) > gap
    e = np.where(far, (s + values[None, :] * r) / np.where(far, between, 1), r / 2)
    return x + x @ e, values, float(gap), float(np.abs(e).max())


def turned(a: np.ndarray, x: np.ndarray, values: np.ndarray, gap: float) -> bool:
    """Turn the vectors of each cluster by the eigenvectors of the matrix within their span; whether any needed it."""
    any_turned = False
    for group in clusters(values, gap):
        own = x[:, group]
        inner = own.T @ (a @ own) - values[group].mean() * (own.T @ own)
        off = np.abs(inner - np.diag(np.diag(inner))).max()
        if off > len(a) * np.finfo(WIDE).eps:
            # In the cluster's own measure; float32 will do, the next rounds correct the rest.
            small = (inner + inner.T) / (2 * np.abs(inner).max())
            w = np.linalg.eigh(small.astype(np.float32))[1].astype(WIDE)
            for _ in range(2):
                w = w @ (3 * np.eye(len(w), dtype=WIDE) - w.T @ w) / 2  # orthogonal again in the wider type
            x[:, group] = own @ w
            any_turned = True
    return any_turned


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    scale = np.abs(v).max() if v.size else WIDE(0)
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    a = np.asarray(v, WIDE) / scale
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    before = np.inf
    for _ in range(ROUNDS):
        x, values, gap, change = refined(a, x)
        # Close values leave a rest that rounding alone decides: it no longer shrinks.
        if not turned(a, x, values, gap) and (change < np.finfo(np.float64).eps / 16 or change > before / 2):
            break
        before = change
    x /= np.sqrt((x**2).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values)
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


class Whitening:
    """What is learnt of all rows: mean, components, their eigenvalues, and how white the result is."""

    def __init__(self, rows: DataFrame, d: int, components: int = COMPONENTS):
        sums = exact_sums(rows, d)
        self.d, self.n, self.sums = d, int(sums[0]), [int(s) for s in sums[1:]]
        self.middle = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s - int(m) * self.n) / self.n for s, m in zip(self.sums, self.middle)])
        v = covariance(rows, d, self.middle, self.rest, self.n)
        values, vectors = eigen(v)
        # A component without spread can't be scaled to one.
        known = values > values.max(initial=0) * len(values) * np.finfo(float).eps
        k = min(components, int(known.sum()))
        self.turn = vectors[:, :k] / np.sqrt(values[:k])
        self.explained = values[:k] / float(np.trace(v)) if k else np.zeros(0)
        again = covariance(rows, d, self.middle, self.rest, self.n, self.turn) if k else np.zeros((0, 0))
        self.error = float(np.abs(again - np.eye(k)).max()) if k else 0.0

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; none where it needs more than 64 bits."""
        # n x - S = n (x - middle) - (S - n middle): both parts are small, so 64 bits often do.
        y = x - self.middle
        part = np.array([s - int(m) * self.n for s, m in zip(self.sums, self.middle)], object)
        most = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if most**2 * self.d < 2**63:
            return ((y * self.n - part.astype(np.int64)) ** 2).sum(axis=1).tolist()
        wide = ((y.astype(object) * self.n - part) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in wide.tolist()]


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every row and component.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, as are vectors of another width
    than the most frequent one. Components without spread (constant or dependent dimensions) are left out; there are
    at most ``components``. Rows that repeat are rows like others; keys may be null and are not looked at. A deviation
    that needs more than 64 bits is null. Entries above 2^62 count as 2^62. An empty table gives no rows. The driver
    holds matrices as wide as the vectors, whatever the number of rows.
    """
    rows = fitting(vectors, key, vector)
    d = common_width(rows)
    kind = rows.schema["key"].dataType.simpleString()
    if d is None:
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, {OUT}")
    rows = rows.where(F.size("x") == d)
    model = Whitening(rows, d, components)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d values for each component

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = m.turn.shape[1]
        for batch, x in _blocks(batches, m.d):
            if not k or not len(batch):
                continue
            y, each = _centred(x, m.middle, m.rest) @ m.turn, np.arange(len(batch))
            columns = [
                batch.column("key").take(pa.array(np.repeat(each, k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))),
                pa.array(np.full(len(batch) * k, m.n)),
                pa.array(m.deviations(x), pa.int64()).take(pa.array(np.repeat(each, k))),
                pa.array(y.ravel()),
                pa.array(np.tile(m.explained, len(batch))),
                pa.array(np.full(len(batch) * k, m.error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *[c.split()[0] for c in OUT.split(", ")]])

    return rows.mapInArrow(apply, f"`{key}` {kind}, {OUT}")
