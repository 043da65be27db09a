"""Projected gradient with a line search: one non-negative least-squares side of a factorisation.

The step length is shared by all rows of a factor, so its test is a sum over all of them. One
aggregate per turn gives, for every step length the search may try, the slope and curvature
along the projected step; the search itself then runs on those few numbers. Rows are not
rewritten between turns: the accepted steps are replayed, each a K x K product per row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.operators.factors import TINY
from topicweave.operators.gram import _arrays, _matrix, map_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Turns of a side, step lengths tried per turn, factor between two step lengths,
# share of the slope a step must gain.
TURNS = 10
TRIALS = 10
BETA = 10.0
ENOUGH = 0.01


def _gradient(f: np.ndarray, s: np.ndarray, g: np.ndarray) -> np.ndarray:
    return f @ g - s


def replayed(f: np.ndarray, s: np.ndarray, g: np.ndarray, steps: list[float]) -> np.ndarray:
    """Rows after the accepted steps."""
    for step in steps:
        f = np.maximum(f - step * _gradient(f, s, g), TINY)
    return f


def trial_sums(f: np.ndarray, s: np.ndarray, g: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Sums over rows: squares of the gradient, of the projected gradient, then per step length
    slope, curvature and how many values differ from those of the next shorter step."""
    grad = _gradient(f, s, g)
    free = np.where((grad < 0) | (f > TINY), grad, 0.0)
    sums = [(grad * grad).sum(), (free * free).sum()]
    shorter = None
    for step in steps:  # ascending
        new = np.maximum(f - step * grad, TINY)
        d = new - f
        moved = np.count_nonzero(new != (f if shorter is None else shorter))
        sums += [(grad * d).sum(), ((d @ g) * d).sum(), float(moved)]
        shorter = new
    return np.array(sums)


def searched(alpha: float, sums: np.ndarray) -> tuple[float, float]:
    """(accepted step, next alpha) from the trial sums of :func:`lengths`.

    If the first length suffices, longer ones are tried until one fails or changes nothing,
    and the last that sufficed is taken; else shorter ones until one suffices. Without any the
    rows stay.
    """
    by_length = sums[2:].reshape(-1, 3)
    enough = [(1 - ENOUGH) * slope + 0.5 * bend < 0 for slope, bend, _ in by_length]
    first = TRIALS - 1  # place of alpha itself
    if enough[first]:
        for n in range(1, TRIALS):
            if not enough[first + n] or by_length[first + n][2] == 0:
                return alpha * BETA ** (n - 1), alpha * BETA**n
        return alpha * BETA ** (TRIALS - 1), alpha * BETA**TRIALS
    for n in range(1, TRIALS):
        if enough[first - n]:
            return alpha / BETA**n, alpha / BETA**n
    return 0.0, alpha / BETA**TRIALS


def lengths(alpha: float) -> np.ndarray:
    """All step lengths a turn may try, ascending."""
    down = [alpha / BETA**n for n in range(TRIALS - 1, 0, -1)]
    return np.array([*down, *[alpha * BETA**n for n in range(TRIALS)]])


def _summed(rows: DataFrame, g: np.ndarray, done: list[float], steps: np.ndarray) -> np.ndarray:
    """:func:`trial_sums` over all rows ``(f, s)`` after the steps done."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 3 * len(steps))
        for batch in batches:
            if batch.num_rows:
                f, s = _matrix(batch, "f"), _matrix(batch, "s")
                total += trial_sums(replayed(f, s, g, done), s, g, steps)
        yield pa.RecordBatch.from_arrays([_arrays(total.reshape(1, -1))], ["t"])

    parts = rows.select("f", "s").mapInArrow(partial, "t array<double>")
    width = 2 + 3 * len(steps)
    sums = parts.agg(*[F.sum(F.col("t")[i]).alias(f"t{i}") for i in range(width)]).first()
    return np.array([x or 0.0 for x in sums])


@dataclass
class Progress:
    """What the sides tell each other: tolerances and the last projected gradients."""

    tolerance: float = 1e-5
    start: float = 0.0  # norm of the gradient of both sides at the start
    limits: dict[str, float] = field(default_factory=dict)
    squares: dict[str, float] = field(default_factory=dict)

    def begin(self, squares: dict[str, float]) -> None:
        self.start = float(np.sqrt(sum(squares.values())))
        self.limits = {side: max(1e-3, self.tolerance) * self.start for side in squares}

    @property
    def settled(self) -> bool:
        """The projected gradient of both sides fell below the tolerance."""
        if len(self.squares) < 2:
            return False
        return float(np.sqrt(sum(self.squares.values()))) < self.tolerance * self.start


def gradient_square(rows: DataFrame, g: np.ndarray) -> float:
    """Sum of squares of the gradient of rows ``(f, s)``."""
    return float(_summed(rows, g, [], np.array([]))[0])


def descended(rows: DataFrame, key: str, g: np.ndarray, side: str, progress: Progress) -> DataFrame:
    """The rows ``(key, f)`` after at most ``TURNS`` searched steps. ``rows`` must be written."""
    alpha, done = 1.0, []
    limit = progress.limits[side]
    turns = 0
    for _ in range(TURNS):
        sums = _summed(rows, g, done, lengths(alpha))
        progress.squares[side] = float(sums[1])
        if np.sqrt(sums[1]) < limit:
            break
        turns += 1
        step, alpha = searched(alpha, sums)
        if step:
            done.append(step)
    if not turns:  # nothing to do for this limit
        progress.limits[side] = limit / 10
    steps = list(done)
    return map_rows(rows, key, ["f", "s"], lambda f, s: replayed(f, s, g, steps), "f")


def step_rows(mine: DataFrame, sums: DataFrame, key: str, k: int) -> DataFrame:
    """Factor rows with their products; rows without a cell have products of zero."""
    zeros = F.array(*[F.lit(0.0)] * k)
    return mine.join(sums, key, "left").select(key, "f", F.coalesce("s", zeros).alias("s"))
