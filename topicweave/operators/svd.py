"""Truncated singular value decomposition by block Lanczos with a residual bound.

Uses the same cell sums as the models: ``X V`` is a sum per document, ``X' U`` a sum per word.
The basis lives in the rows of the shorter side, documents or words, one array each; only matrices
of the basis' width reach the driver. Every singular triple comes with a bound on its error, and the turns end when all wanted
bounds are small enough.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.operators.cells import CellBlocks
from topicweave.operators.factors import seed_vector
from topicweave.operators.gram import gram, map_rows
from topicweave.operators.projected import step_rows
from topicweave.session import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOLERANCE = 1e-8
MAX_TURNS = 60
#: Widths the basis may grow to before it is pressed together.
BASIS_WIDTHS = 6


@dataclass(frozen=True)
class Decomposition:
    """``X ~ U diag(sigma) V'``: words ``(word, f)`` hold V, docs ``(doc_id, f)`` hold U.

    ``bounds`` has, per value, the norm of ``X'X v - sigma^2 v`` (``X X'u - sigma^2 u`` where the
    basis lives in the documents) relative to the largest ``sigma^2``: some square of a true singular value lies at most so far away.
    """

    words: DataFrame
    docs: DataFrame
    sigma: list[float]
    bounds: list[float]
    turns: int
    tolerance: float

    @property
    def converged(self) -> bool:
        return all(b <= self.tolerance for b in self.bounds)

    @property
    def spectrum(self) -> DataFrame:
        one = self.words.sparkSession.range(1)
        values = F.array(*[F.lit(s) for s in self.sigma])
        return one.select(F.posexplode(values).alias("i", "sigma"))


def _whitening(g: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """``T, S`` with ``(F T)'(F T) = I`` and ``F = F T S`` for ``F'F = g``. Directions whose
    square is below ``floor``, or lost to rounding, are left out."""
    values, vectors = np.linalg.eigh(g)
    keep = values > max(floor, values.max(initial=0.0) * 1e-14)
    root = np.sqrt(values[keep])
    return vectors[:, keep] / root, root[:, None] * vectors[:, keep].T


class _Basis:
    """Orthonormal columns V over the words, and ``T = V' X'X V`` in units of counts; or the same of
    X' over the documents.
    """

    def __init__(self, blocks: CellBlocks, width: int, scratch: Scratch) -> None:
        self.blocks, self.scratch = blocks, scratch
        self.turn = 0
        if blocks.n_docs < blocks.n_words:
            self.key, self.other = "doc_id", "word"
            rows = blocks.cells.select("doc_id").where("doc_id is not null").distinct()
        else:
            self.key, self.other = "word", "doc_id"
            rows = blocks.words.select("word")
        seeds = seed_vector("v", F.col(self.key), width)
        rows = rows.select(self.key, F.transform(seeds, lambda u: u - 0.5).alias("f"))
        rows = scratch.write(rows, "v-start")
        for _ in range(2):  # the second time against rounding
            t, _ = _whitening(gram(rows, "f", rows.select(F.size("f")).first()[0]))
            rows = scratch.slot(map_rows(rows, self.key, ["f"], lambda f, t=t: f @ t, "f"), "v", self._next())
        self.rows = rows
        self.size = self.last = t.shape[1]
        self.t = np.zeros((self.size, self.size))

    def _next(self) -> int:
        self.turn += 1
        return self.turn

    def _sums(self, factor: DataFrame, width: int, key: str) -> DataFrame:
        """``(key, s)``: the cells' sums with a factor ``f`` of the other side."""
        return self.blocks.product_sums(factor.withColumnRenamed("f", "b" if key == "word" else "a"), width, key)

    def product(self, columns: np.ndarray) -> DataFrame:
        """``(other key, f)``: X (or X') times the combinations of basis vectors."""
        v = map_rows(self.rows, self.key, ["f"], lambda f: f @ columns, "f")
        return self._sums(v, columns.shape[1], self.other).withColumnRenamed("s", "f")

    def images(self, columns: np.ndarray) -> DataFrame:
        """``(key, s)``: X'X (or X X') times the combinations of basis vectors."""
        if self.key == "doc_id":
            v = map_rows(self.rows, self.key, ["f"], lambda f: f @ columns, "b")
            found = self.blocks.square_sums(v, columns.shape[1])
            if found is not None:
                return found
        others = self.scratch.slot(self.product(columns), "u", self._next())
        return self._sums(others, columns.shape[1], self.key)

    def grow(self) -> np.ndarray:
        """Add the next block. Returns S with ``X'X V_last = V C + V_new S``."""
        m, b = self.size, self.last
        images = self.images(np.eye(m)[:, m - b :])
        both = self.scratch.slot(step_rows(self.rows, images, self.key, b), "both", self._next())

        def crossed(c: np.ndarray, t: np.ndarray) -> np.ndarray:
            """Gram matrix of the basis and ``(W - V c) t``."""
            x = map_rows(
                both, self.key, ["f", "s"], lambda f, s: np.hstack([f, (s - f @ c) @ t]), "x"
            )
            return gram(x, "x", m + t.shape[1])

        t, s = np.eye(b), np.eye(b)
        c = crossed(np.zeros((m, b)), t)[:m, m:]
        scale = np.linalg.norm(c)
        for _ in range(2):  # orthogonal to the basis, then among themselves, then both again
            g = crossed(c, t)
            more, inner = g[:m, m:], g[m:, m:]
            c = c + more @ s
            new, back = _whitening(inner - more.T @ more, (1e-15 * scale) ** 2 if t.shape[1] == b else 0.0)
            t, s = t @ new, back @ s
            if not t.shape[1]:
                break
        self.t[:, m - b :] = c
        self.t[m - b :, :] = c.T
        self.pending = both, c, t
        return s

    def ritz(self) -> tuple[np.ndarray, np.ndarray]:
        values, vectors = np.linalg.eigh((self.t + self.t.T) / 2)
        return values[::-1], vectors[:, ::-1]

    def extend(self, s: np.ndarray, keep: np.ndarray | None) -> None:
        """Take the new block in; with ``keep`` the old basis is replaced by these combinations."""
        both, c, t = self.pending
        m, b, new = self.size, self.last, t.shape[1]
        old = np.eye(m) if keep is None else keep
        rows = map_rows(
            both, self.key, ["f", "s"], lambda f, s: np.hstack([f @ old, (s - f @ c) @ t]), "f"
        )
        self.rows = self.scratch.slot(rows, "v", self._next())
        inner, link = old.T @ self.t @ old, s @ old[m - b :]
        self.t = np.block([[inner, link.T], [link, np.zeros((new, new))]])
        self.size, self.last = old.shape[1] + new, new


def truncated_svd(
    blocks: CellBlocks,
    k: int,
    max_turns: int = MAX_TURNS,
    extra: int = 5,
    scratch: Scratch | None = None,
    tolerance: float = TOLERANCE,
) -> Decomposition:
    """Largest k singular values and vectors of ``X = n / total``.

    A turn reads the cells twice. The basis is orthogonalised against all of itself, so no
    value appears twice; when it gets too wide it is replaced by its best combinations.
    """
    scratch = scratch or Scratch(blocks.cells.sparkSession, "svd")
    width = min(k + extra, blocks.n_words, blocks.n_docs)
    basis = _Basis(blocks, width, scratch)
    for turn in range(1, max_turns + 1):
        s = basis.grow()
        values, vectors = basis.ritz()
        errors = np.linalg.norm(s @ vectors[basis.size - basis.last :], axis=0) if len(s) else np.zeros(basis.size)
        bounds = errors / max(values[0], 1e-300)
        wanted = min(k, basis.size)
        if turn == max_turns or not len(s) or (bounds[:wanted] <= tolerance).all():
            break
        pressed = basis.size + len(s) > BASIS_WIDTHS * width
        basis.extend(s, vectors[:, :width] if pressed else None)
    top = vectors[:, :wanted]
    norm = np.sqrt(np.maximum(values[:wanted], 0.0))
    safe = np.where(norm > norm[0] * 1e-12, norm, 1.0)
    others = scratch.write(basis.product(top), "u-last")
    sides = {
        basis.key: map_rows(basis.rows, basis.key, ["f"], lambda f: f @ top, "f"),
        basis.other: map_rows(others, basis.other, ["f"], lambda f: f / safe, "f"),
    }
    return Decomposition(
        words=sides["word"],
        docs=sides["doc_id"],
        sigma=[float(x) / blocks.total for x in norm],
        bounds=[float(x) for x in bounds[:wanted]],
        turns=turn,
        tolerance=tolerance,
    )
