"""K x K algebra on factor tables.

The cells stay in the JVM; only factor rows (one per word or document) pass
through Arrow, in batches, for small dense algebra with a K x K matrix.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.operators.factors import TINY

# Ship the functions below with each job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _arrays(matrix: np.ndarray) -> pa.ListArray:
    rows, k = matrix.shape
    offsets = pa.array(np.arange(0, (rows + 1) * k, k, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def gram(factor: DataFrame, name: str, k: int) -> np.ndarray:
    """``F^T F`` of a factor column: K x K numbers, summed per partition first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch, name)
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([_arrays(total.reshape(1, -1))], ["g"])

    sums = (
        factor.select(name)
        .mapInArrow(partial, "g array<double>")
        .select(F.posexplode("g").alias("at", "g"))
        .groupBy("at")
        .agg(F.sum("g").alias("g"))
        .collect()  # K * K rows
    )
    flat = np.zeros(k * k)
    for row in sums:
        flat[row["at"]] = row["g"]
    return flat.reshape(k, k)


def map_rows(
    rows: DataFrame, key: str, names: list[str], fn: Callable[..., np.ndarray], out: str
) -> DataFrame:
    """Apply ``fn(matrix, ...) -> matrix`` to batches of array columns."""
    key_type = rows.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                result = fn(*[_matrix(batch, n) for n in names])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), _arrays(result)], [key, out]
                )

    schema = f"{key} {key_type}, {out} array<double>"
    return rows.select(key, *names).mapInArrow(apply, schema)


# Each step below solves min |X - W H| for one side, row by row: ``rows`` are the
# factor rows to renew, ``target`` the products with X, ``g`` the other Gram matrix.


def multiplicative_step(rows: np.ndarray, target: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.maximum(rows * target / np.maximum(rows @ g, TINY), TINY)


def hals_step(rows: np.ndarray, target: np.ndarray, g: np.ndarray) -> np.ndarray:
    new = rows.copy()
    for z in range(g.shape[0]):
        change = (target[:, z] - new @ g[:, z]) / max(g[z, z], TINY)
        new[:, z] = np.maximum(new[:, z] + change, TINY)
    return new


# Non-negative least squares. Each problem is brought to a Gram matrix with a unit diagonal and
# targets of at most 1, so that all tolerances are relative: nothing depends on the scale of X.


class _Scaled:
    def __init__(self, target: np.ndarray, g: np.ndarray) -> None:
        root = np.sqrt(np.maximum(np.diag(g), 0.0))
        unit = np.where(root > 0, 1.0 / np.where(root > 0, root, 1.0), 0.0)
        self.g = g * unit[:, None] * unit
        scaled = target * unit
        size = np.abs(scaled).max(axis=1, keepdims=True, initial=0.0)
        size[size == 0] = 1.0
        self.target = scaled / size
        self.back = size * unit  # a topic without mass stays at 0

    def slack(self, x: np.ndarray) -> np.ndarray:
        """What rounding may leave of a gradient, per row."""
        eps = np.finfo(float).eps
        return 64 * len(self.g) * eps * (1.0 + np.abs(x).sum(axis=1, keepdims=True))

    def solved(self, passive: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Least squares of each row on its passive set; rows that share a set are solved
        together. A set of dependent topics gets the solution of smallest norm."""
        out = np.zeros_like(target)
        sets, member = np.unique(passive, axis=0, return_inverse=True)
        order = np.argsort(member.ravel(), kind="stable")
        starts = np.searchsorted(member.ravel()[order], np.arange(len(sets) + 1))
        for i, chosen in enumerate(sets):
            if chosen.any():
                at = order[starts[i] : starts[i + 1]]
                inverse = np.linalg.pinv(self.g[np.ix_(chosen, chosen)], rcond=1e-13, hermitian=True)
                out[np.ix_(at, np.flatnonzero(chosen))] = target[np.ix_(at, np.flatnonzero(chosen))] @ inverse
        return out


def _inward(
    problem: _Scaled, x: np.ndarray, passive: np.ndarray, target: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """From feasible ``x`` towards the solutions on the passive sets. Where one leaves the
    feasible region, the walk stops at the border and the set loses what became zero; every
    turn takes a topic from each unfinished row, so there are at most K turns."""
    x, passive = x.copy(), passive.copy()
    rows = np.arange(len(x))
    while len(rows):
        held = passive[rows]
        goal = problem.solved(held, target[rows])
        out = held & (goal <= 0)
        done = ~out.any(axis=1)
        x[rows[done]] = goal[done]
        rows, goal, out = rows[~done], goal[~done], out[~done]
        gap = np.where(out, x[rows] - goal, 1.0)
        share = np.where(out, x[rows] / np.where(gap > 0, gap, 1.0), np.inf)
        least = share.min(axis=1, keepdims=True, initial=np.inf)
        gone = out & (share <= least)
        x[rows] = np.where(gone | ~passive[rows], 0.0, np.maximum(x[rows] + least * (goal - x[rows]), 0.0))
        passive[rows] &= ~gone
    return x, passive


def active_set(target: np.ndarray, g: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Exact non-negative least squares by active sets, row by row, all rows at once.

    The topic with the steepest descent enters a row's passive set, then the row walks to the
    solution on it. A topic that doesn't lower the row's value is barred until another one
    does. Values fall strictly from one passive set to the next, so no set returns and the
    search ends, also for dependent topics.
    """
    problem = _Scaled(target, g)
    t = problem.target
    x = np.zeros_like(t)
    passive = np.zeros(t.shape, dtype=bool)
    if start is not None:
        x = np.where(problem.back > 0, np.maximum(start, 0.0) / np.where(problem.back > 0, problem.back, 1.0), 0.0)
        x, passive = _inward(problem, x, x > 0, t)
    barred = np.zeros(t.shape, dtype=bool)
    rows = np.arange(len(t))
    while len(rows):
        descent = t[rows] - x[rows] @ problem.g
        value = -0.5 * (x[rows] * (t[rows] + descent)).sum(axis=1)
        steep = np.where(passive[rows] | barred[rows], -np.inf, descent)
        pick = steep.argmax(axis=1)
        inside = steep[np.arange(len(rows)), pick] > problem.slack(x[rows])[:, 0]
        rows, pick, value = rows[inside], pick[inside], value[inside]
        if not len(rows):
            break
        trial = passive[rows]
        trial[np.arange(len(rows)), pick] = True
        new, held = _inward(problem, x[rows], trial, t[rows])
        lower = -0.5 * (new * (2 * t[rows] - new @ problem.g)).sum(axis=1) < value
        x[rows[lower]], passive[rows[lower]] = new[lower], held[lower]
        barred[rows[lower]] = False
        barred[rows[~lower], pick[~lower]] = True
    return x * problem.back


def active_set_step(rows: np.ndarray, target: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.maximum(active_set(target, g), TINY)


def warm_set_step(rows: np.ndarray, target: np.ndarray, g: np.ndarray) -> np.ndarray:
    """:func:`active_set` from the sets of the rows as they are."""
    return np.maximum(active_set(target, g, np.where(rows > TINY, rows, 0.0)), TINY)


def nnls_step(rows: np.ndarray, target: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Exact non-negative least squares by block principal pivoting.

    Rows that share a passive set are solved together. After three exchanges without progress
    a row changes only its last wrong variable. That ends unless rounding or dependent topics
    stand in the way; rows still open after ``5 K + 20`` exchanges go to :func:`active_set`.
    """
    problem = _Scaled(target, g)
    t = problem.target
    n, k = t.shape
    passive = np.zeros((n, k), dtype=bool)
    x = np.zeros((n, k))
    tries = np.full(n, 3)
    best = np.full(n, k + 1)
    rows_left = np.arange(n)
    for _ in range(5 * k + 20):
        own, held = x[rows_left], passive[rows_left]
        gradient = own @ problem.g - t[rows_left]
        slack = problem.slack(own)
        wrong = np.where(held, own < -slack, gradient < -slack)
        count = wrong.sum(axis=1)
        going = count > 0
        rows_left, wrong, count = rows_left[going], wrong[going], count[going]
        if not len(rows_left):
            return np.maximum(x * problem.back, TINY)
        better = count < best[rows_left]
        best[rows_left] = np.where(better, count, best[rows_left])
        tries[rows_left] = np.where(better, 3, tries[rows_left] - 1)
        single = tries[rows_left] < 0
        last = k - 1 - np.argmax(wrong[:, ::-1], axis=1)
        only_last = np.zeros_like(wrong)
        only_last[np.arange(len(last)), last] = True
        passive[rows_left] ^= np.where(single[:, None], only_last, wrong)
        x[rows_left] = problem.solved(passive[rows_left], t[rows_left])
    x = x * problem.back
    x[rows_left] = active_set(target[rows_left], g)
    return np.maximum(x, TINY)
