"""Embedding whitening by a bidiagonal qd solver.

Tasks reduce their centred rows to triangles by blockwise QR, and triangles are stacked and reduced
again until one is left. Householder reflections make it bidiagonal, dqds finds the squares of its
singular values, and twisted factorisations give the vectors that belong to them. Only sums and
triangles, whose size depends on the number of dimensions alone, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .embedding_dedup import commonest_length, finite_rows

COMPONENTS = 32
#: Rows that are stacked on a triangle at a time, and triangles that one task, or the driver, stacks.
STACK, FAN = 4096, 32
SCALE, SHIFT = 64, 1_000_000
#: Larger entries are taken as this one, so that they stay in a long.
_MOST = float(1 << 61)
_TINY = (100 * np.finfo(float).eps) ** 2


# --- the dense solver --------------------------------------------------------------------

def triangle(*stacked: np.ndarray) -> np.ndarray:
    """The upper triangle of the QR factorisation of matrices on top of each other."""
    whole = np.concatenate(stacked)
    r = np.linalg.qr(whole, mode="r")
    return r if len(r) == whole.shape[1] else np.concatenate([r, np.zeros((whole.shape[1] - len(r), whole.shape[1]))])


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """v of length 1 with (I - 2 v v') x along the first axis; None where x has that direction already."""
    if not x[1:].any():
        return None
    v = x.copy()
    v[0] += math.copysign(np.linalg.norm(x), x[0])
    return v / np.linalg.norm(v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right transformation V of a square matrix r = U B V'."""
    b, d = r.copy(), len(r)
    right = np.eye(d)
    for k in range(d):
        if (v := _reflector(b[k:, k])) is not None:
            b[k:, k:] -= 2 * np.outer(v, v @ b[k:, k:])
        if k < d - 2 and (v := _reflector(b[k, k + 1 :])) is not None:
            b[k:, k + 1 :] -= 2 * np.outer(b[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(b).copy(), np.diag(b, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One dqds transform: new q and e, the least d, and whether only the last d may be negative."""
    out_q, out_e, d, least = [], [], q[0] - shift, math.inf
    for i in range(len(e)):
        least = min(least, d)
        if d < 0:
            return out_q, out_e, d, False
        top = d + e[i]
        if top == 0:
            ratio = 0.0
        else:
            ratio = q[i + 1] / top
        out_q.append(top)
        out_e.append(e[i] * ratio)
        d = d * ratio - shift
    out_q.append(d)
    return out_q, out_e, min(least, d), True


def _shift(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows, no smaller than the least one of all."""
    a = q[-2] + (e[-2] if len(e) > 1 else 0.0)
    b, off = q[-1] + e[-1], q[-2] * e[-1]
    mean, half = (a + b) / 2, (a - b) / 2
    root = math.hypot(half, math.sqrt(off))
    return max(0.0, (a * b - off) / (mean + root)) if mean + root else 0.0


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling.

    Differential quotient-difference transforms with shifts: they take no differences but those of
    the shift, so small values keep their relative accuracy. A shift that makes a pivot negative is
    given up for a smaller one; at zero shift a step always succeeds.
    """
    found: list[float] = []
    parts = [((diagonal**2).tolist(), (upper**2).tolist(), 0.0)]
    while parts:
        q, e, moved = parts.pop()
        while q:
            if len(q) == 1:
                found.append(moved + q.pop())
                break
            if e[-1] <= _TINY * (moved + q[-1]):
                found.append(moved + q.pop())
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 1) if e[i] <= _TINY * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            shift = _shift(q, e)
            for attempt in range(4):
                new_q, new_e, least, last = _sweep(q, e, shift)
                if least >= 0:
                    break
                # where only the last pivot fell below zero, it tells how much too large the shift was
                shift = max(0.0, shift + least) if last and attempt == 0 else shift / 4 if attempt < 2 else 0.0
            new_q = [max(0.0, x) for x in new_q]
            q, e, moved = new_q, new_e, moved + shift
    return np.sort(np.array(found))[::-1]


def _twisted(d: np.ndarray, l: np.ndarray, value: float) -> Iterator[np.ndarray]:
    """Vectors of L D L' for an eigenvalue, that of the smallest twist first.

    The stationary transform factors from the top, the progressive one from the bottom; glued at the
    row where the pivot is smallest they give the vector by products alone.
    """
    n, tiny = len(d), np.finfo(float).eps ** 2 * d.max()
    down, s = np.zeros(n - 1), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i] or tiny
        down[i] = d[i] * l[i] / pivot
        s[i + 1] = down[i] * l[i] * s[i] - value
    up, p = np.zeros(n - 1), np.zeros(n)
    p[-1] = d[-1] - value
    gamma = s + d
    for i in range(n - 2, -1, -1):
        if not (pivot := d[i] * l[i] ** 2 + p[i + 1]):
            pivot = p[i + 1] = tiny
        ratio = d[i] / pivot
        up[i] = l[i] * ratio
        p[i] = p[i + 1] * ratio - value
        gamma[i] = s[i] + ratio * p[i + 1]
    for k in np.argsort(np.abs(gamma), kind="stable"):
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -up[i] * z[i]
        if np.isfinite(z).all() and np.isfinite(norm := np.linalg.norm(z)):
            yield z / norm


def _clean(z: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, float]:
    """z without its part in the span of `before`, length 1, and the length that was left."""
    rest = z - before @ (before.T @ z)
    left = np.linalg.norm(rest)
    if left > 0:
        rest = rest / left
        rest -= before @ (before.T @ rest)
        rest /= np.linalg.norm(rest)
    return rest, left


def vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of an upper bidiagonal matrix for the largest `values`, as columns.

    Vectors of values that are near each other are made orthogonal; where one has too little of its
    own, the next best twist is taken.
    """
    scale = max(np.abs(diagonal).max(), np.abs(upper).max(initial=0.0))
    safe = np.where(np.abs(diagonal) < np.finfo(float).eps * scale, np.finfo(float).eps * scale, diagonal)
    d, l = safe**2, upper / safe[:-1]
    found = np.zeros((len(d), len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * value:
            first = k
        best, most = None, -1.0
        for tries, z in enumerate(_twisted(d, l, value)):
            z, left = _clean(z, found[:, first:k])
            if left > most:
                best, most = z, left
            if most > 0.1 or tries == 2 * (k - first) + 8:
                break
        found[:, k] = best
    return found


def principal(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues of r'r, their unit vectors as columns, and the trace.

    Values that are zero to double precision are left out: nothing can be scaled by them.
    """
    scale = np.abs(r).max()
    if not scale:
        return np.empty(0), np.empty((len(r), 0)), 0.0
    diagonal, upper, right = bidiagonal(r / scale)
    values = dqds(diagonal, upper)
    trace = float(values.sum()) * scale**2
    values = values[:count]
    values = values[values > values[0] * (len(r) * np.finfo(float).eps) ** 2]
    inner = vectors(diagonal, upper, values)
    return values * scale**2, right @ inner, trace


# --- Spark -------------------------------------------------------------------------------

def quantised(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and x = floor(64 c) + 1000000 of the usable vectors."""
    at, c = finite_rows(column, dimensions)
    return at, np.floor(SCALE * np.clip(c, -_MOST / SCALE, _MOST / SCALE)).astype(np.int64) + SHIFT


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: 64-bit integers where they suffice, else Python's."""
    if len(x) and int(np.abs(x).max()) * n + max(map(abs, sums.tolist())) >= 1 << 62:
        return x.astype(object) * n - sums.astype(object)
    return x * np.int64(n) - sums.astype(np.int64)


def squares(deviation: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; None where one does not fit a long."""
    if deviation.dtype != object and len(deviation) and int(np.abs(deviation).max()) ** 2 * deviation.shape[1] < 1 << 63:
        return (deviation * deviation).sum(1).tolist()
    found = [sum(v * v for v in row) for row in deviation.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def _once(df: DataFrame, start, step, end, schema: str) -> DataFrame:
    """A row of `end(state)` for each task with rows, after `step(state, batch)` over its batches."""
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, state, any_ = to_arrow_schema(fields), start(), False
        for batch in batches:
            if batch.num_rows:
                state, any_ = step(state, batch), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for f, v in zip(target, end(state))], schema=target)

    return df.mapInArrow(run, schema)


def _totals(parts: DataFrame) -> list:
    """Sums of the numbers `v` of all rows, by position; their count depends on the dimensions alone."""
    placed = parts.select(F.posexplode("v").alias("at", "v"))
    return [r.v for r in placed.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()]


class Whitening:
    """What was learned from a table: n, sums, components and their variances."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, axes: np.ndarray, trace: float):
        self.n, self.sums = n, np.array(sums, object)
        self.values, self.axes, self.trace = values / max(n, 1), axes, trace / max(n, 1)
        self.identity_error = 0.0

    def __call__(self, deviation: np.ndarray) -> np.ndarray:
        """Whitened coordinates from n x - S."""
        return (deviation.astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values)


def fit(table: DataFrame, count: int = COMPONENTS, vector: str = "embedding", scratch: Scratch | None = None) -> tuple[Whitening, int]:
    """The whitening of all usable vectors of `table`, and their number of dimensions."""
    own = scratch or Scratch(table.sparkSession)
    dimensions = commonest_length(table, vector)
    column = table.select(F.col(vector).alias("v"))
    if not dimensions:
        return Whitening(0, [], np.empty(0), np.empty((0, 0)), 0.0), 0

    def add(state, batch):
        at, x = quantised(batch.column("v"), dimensions)
        state[0] += len(at)
        for i, s in enumerate(x.astype(object).sum(0) if len(x) and int(np.abs(x).max()) * len(x) >= 1 << 62 else x.sum(0)):
            state[i + 1] += int(s)
        return state

    # decimals, so that no sum of longs overflows
    sums = _totals(_once(column, lambda: [0] * (dimensions + 1), add, lambda s: [[[str(v) for v in s]]], "v array<string>").select(F.col("v").cast("array<decimal(38,0)>").alias("v")))
    if not sums or not sums[0]:
        return Whitening(0, [], np.empty(0), np.empty((dimensions, 0)), 0.0), dimensions
    n, sums = int(sums[0]), [int(s) for s in sums[1:]]
    means = np.array(sums, object)

    def stack(r, batch):
        _, x = quantised(batch.column("v"), dimensions)
        for start in range(0, len(x), STACK):
            r = triangle(r, deviations(x[start : start + STACK], n, means).astype(np.float64) / n)
        return r

    def join(r, batch):
        return triangle(r, *[np.frombuffer(b, np.float64).reshape(-1, dimensions) for b in batch.column("r").to_pylist()])

    empty = lambda: np.zeros((0, dimensions))
    triangles = own.table(_once(column, empty, stack, lambda r: [[r.tobytes()]], "r binary"))
    while (left := triangles.count()) > FAN:
        triangles = own.table(_once(triangles.repartition(-(-left // FAN)), empty, join, lambda r: [[r.tobytes()]], "r binary"))
    r = triangle(empty(), *[np.frombuffer(t.r, np.float64).reshape(-1, dimensions) for t in triangles.collect()])
    out = Whitening(n, sums, *principal(r, count))
    k = len(out.values)

    def gram(state, batch):
        w = out(deviations(quantised(batch.column("v"), dimensions)[1], n, means))
        return state + np.concatenate([w.sum(0), (w.T @ w).ravel()])

    if k:
        both = np.array(_totals(_once(column, lambda: np.zeros(k + k * k), gram, lambda s: [[s]], "v array<double>"))) / n
        out.identity_error = float(np.abs(both[k:].reshape(k, k) - np.outer(both[:k], both[:k]) - np.eye(k)).max())
    return out, dimensions


def whiten(table: DataFrame, count: int = COMPONENTS, vector: str = "embedding", name: str = "vec_id") -> DataFrame:
    """Per usable row and component: `vec_id, component, n, deviation, whitened, explained, identity_error`.

    Rows whose vector is null, empty, of another length than the commonest one, or holds null or
    non-finite entries are dropped; a row with a null id stays. Repeated rows count each. Components
    whose variance is zero to double precision are not given, so equal vectors alone give no row, nor
    does an empty table. A `deviation` that does not fit a long is null; entries beyond 2^61 / 64 are
    taken as that bound.
    """
    learned, dimensions = fit(table, count, vector)
    k = len(learned.values)
    explained = learned.values / learned.trace if k else learned.values
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fields = table.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        for batch in batches:
            at, x = quantised(batch.column("v"), dimensions) if k else ([], np.empty((0, 0)))
            if not len(at):
                continue
            moved = deviations(x, learned.n, learned.sums)
            rows = len(at) * k
            values = [
                batch.column("vec_id").take(pa.array(np.repeat(at, k))), np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)), np.full(rows, learned.n),
                [s for s in squares(moved) for _ in range(k)], learned(moved).ravel(), np.tile(explained, len(at)), np.full(rows, learned.identity_error),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for f, v in zip(target, values)], schema=target)

    return table.select(F.col(name).cast("long").alias("vec_id"), F.col(vector).alias("v")).mapInArrow(run, schema)
