"""One pass over the cells of a block: the sums of its words and documents.

A block comes as a stream of rows ``mark, key, d, n, f`` in the order of the mark: its
documents (mark 0) with their factor rows first, then its words (mark 1), each with its factor row
and its cells as arrays (documents ``d``, counts ``n``). Memory holds the documents' rows and one
batch of words, whatever the block's size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql.types import DataType

from topicweave.functions.vectors import UNROLL, slabs
from topicweave.operators.gram import _arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUMS = "key string, slab int, s array<double>"
# Keys of the rows that hold what the fit measures of all cells are made of, in the first place.
MEASURES = ("mlog_part", "mx", "msquare")
# Key of the row that holds the sum of all words' sums.
MASS = "mmass"
# Numbers of cells x topics that are worked on at once.
CELL_VALUES = 2_000_000
# Numbers and bytes of words of a batch that leaves.
PIECE_VALUES = 250_000
PIECE_BYTES = 16_000_000

# Cells that are put together at once.
PACKED_CELLS = 2_000_000

Stream = Iterator[pa.RecordBatch]
Rows = Callable[[pa.Array], np.ndarray]  # keys -> factor rows


def packed_schema(doc_id: DataType) -> str:
    kind = doc_id.simpleString()
    return f"block int, mark int, key string, d array<{kind}>, n array<double>"


def packed_cells(batches: Stream) -> Stream:
    """Cells ``block, mark, key, d, n`` of the same block and key in one row with arrays."""

    def together(held: list[pa.RecordBatch]) -> Stream:
        if held:
            found = pa.Table.from_batches(held).group_by(["block", "mark", "key"], use_threads=False)
            rows = found.aggregate([("d", "list"), ("n", "list")])
            rows = rows.rename_columns({"d_list": "d", "n_list": "n"})
            yield from rows.select(["block", "mark", "key", "d", "n"]).to_batches(max_chunksize=10_000)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACKED_CELLS:
            yield from together(held)
            held, size = [], 0
    yield from together(held)


def _factor(rows: pa.RecordBatch, k: int) -> np.ndarray:
    """The factor rows, a topic per row."""
    values = rows.column("f").flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values.reshape(-1, k).T)


def _has_factor(rows: pa.RecordBatch) -> pa.Array:
    """Rows without a factor row have an empty array."""
    return pc.greater(pc.fill_null(pc.list_value_length(rows.column("f")), 0), 0)


def _output(keys: pa.Array, sums: np.ndarray, count: int, width: int) -> pa.RecordBatch:
    """Rows of sums, a row per slab of topics."""
    wide = np.zeros((sums.shape[1], count * width))
    wide[:, : len(sums)] = sums.T
    at = np.arange(len(keys))
    return pa.RecordBatch.from_arrays(
        [
            keys.take(pa.array(np.repeat(at, count))),
            pa.array(np.tile(np.arange(count, dtype=np.int32), len(keys))),
            _arrays(wide.reshape(-1, width)),
        ],
        ["key", "slab", "s"],
    )


def _taken(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``rows[:, at]`` with each row's values side by side; the index alone would leave each
    place's values side by side, which sums along a row pay for.
    """
    return np.take(rows, at, axis=1, mode="clip")


def _add_by(place: np.ndarray, values: np.ndarray, total: np.ndarray) -> None:
    """``total[:, place] += values`` where places repeat."""
    if len(place) >= total.shape[1]:
        for z in range(len(total)):
            total[z] += np.bincount(place, values[z], total.shape[1])
        return
    order = np.argsort(place, kind="stable")
    ordered = place[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    total[:, ordered[first]] += np.add.reduceat(_taken(values, order), first, axis=1)


def _word_batches(
    batches: Stream, word_factor: bool, doc_factor: bool
) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """A block's documents with each batch of its words, and the words' cells: the row of the word,
    the place of the document and the count. Words and documents lacking a factor row that is
    needed are left out.
    """
    held: list[pa.RecordBatch] = []
    table = ids = None
    for batch in batches:
        mark = batch.column("mark")
        docs = batch.filter(pc.equal(mark, 0))
        if doc_factor:
            docs = docs.filter(_has_factor(docs))
        if docs.num_rows:
            if table is not None:
                raise RuntimeError("A document's row came after a word's.")
            held.append(docs)
        words = batch.filter(pc.equal(mark, 1))
        if word_factor:
            words = words.filter(_has_factor(words))
        if not words.num_rows or not held:
            continue
        if table is None:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = table.column("d").flatten()
        row = np.repeat(np.arange(words.num_rows), np.asarray(words.column("d").value_lengths()))
        place = pc.fill_null(pc.index_in(words.column("d").flatten(), value_set=ids), -1)
        place = place.to_numpy(zero_copy_only=False)
        n = words.column("n").flatten().to_numpy(zero_copy_only=False)
        if (place < 0).any():
            known = place >= 0
            row, place, n = row[known], place[known], n[known]
        yield table, words, row, place, n


def cell_values(k: int, shares: bool) -> Callable[[Stream], Stream]:
    """Rows ``word, doc_id, p`` of a block's cells: ``a . b``, or with ``shares`` the array
    ``a b / (a . b)``.
    """

    def run(batches: Stream) -> Stream:
        b = None
        for docs, words, row, place, _ in _word_batches(batches, True, True):
            if b is None:
                ids, b = docs.column("d").flatten(), _factor(docs, k)
            a = _factor(words, k)
            named = pc.utf8_slice_codeunits(words.column("key"), start=1)
            # a batch has few values, and few bytes where words are long
            sizes = np.asarray(pc.binary_length(named))[row]
            piece = np.arange(len(row)) // max(1, PIECE_VALUES // k) + np.cumsum(sizes) // PIECE_BYTES
            cuts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True]) if len(row) else []
            for at, end in zip(cuts[:-1], cuts[1:]):
                r, i = row[at:end], place[at:end]
                values = _taken(a, r) * _taken(b, i)
                model = values.sum(axis=0)
                p = _arrays((values / model).T) if shares else pa.array(model)
                yield pa.RecordBatch.from_arrays([named.take(pa.array(r)), ids.take(pa.array(i)), p], ["word", "doc_id", "p"])

    return run


def block_sums(
    k: int, by_words: bool, by_docs: bool, shared: bool, mass: float | None = None, totals: bool = False
) -> Callable[[Stream], Stream]:
    """The sums of words and documents of a block's stream, as rows of ``SUMS``.

    ``shared``: ``n a b / (a . b)`` per cell; else ``n b`` for the words or ``n a`` for the
    documents. A cell whose word or document lacks a factor row that is needed is left out.

    ``mass`` (with ``shared``): the fit of ``x = n / mass``. With ``t = x / (a . b)`` the sums are
    ``t b`` for words and ``t a`` for documents; rows of ``MEASURES`` hold the sums of
    ``x ln t``, ``x`` and ``x x - 2 x (a . b)``.

    ``totals``: the sums of words don't leave, but what they add up to, as a row of the key ``MASS``.
    """
    word_factor, doc_factor = shared or by_docs, shared or by_words
    shape = slabs(k) if k > UNROLL else (1, k)

    def run(batches: Stream) -> Stream:
        ids = None
        measures = np.zeros(len(MEASURES))
        masses = np.zeros((k, 1))
        step = max(1, CELL_VALUES // k)
        for docs, words, row, place, n in _word_batches(batches, word_factor, doc_factor):
            if ids is None:
                ids, keys = docs.column("d").flatten(), docs.column("key")
                b = _factor(docs, k) if doc_factor else None
                doc_sums = np.zeros((k, len(ids)))
                met = np.zeros(len(ids), dtype=bool)
            a = _factor(words, k) if word_factor else None
            word_sums = np.zeros((k, words.num_rows))
            for at in range(0, len(row), step):
                r, i = row[at : at + step], place[at : at + step]
                values = _taken(a, r) if word_factor else _taken(b, i)
                of_words = values
                if mass is not None:
                    x, of_words = n[at : at + step] / mass, _taken(b, i)
                    model = (values * of_words).sum(axis=0)
                    t = x / model
                    logs = np.log(t, out=np.zeros_like(t), where=t > 0)
                    measures += [x @ logs, x.sum(), x @ (x - 2 * model)]
                    values *= t
                    of_words *= t
                elif shared:
                    values *= _taken(b, i)
                    values *= n[at : at + step] / values.sum(axis=0)
                else:
                    values *= n[at : at + step]
                if by_words:
                    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    word_sums[:, r[first]] += np.add.reduceat(of_words, first, axis=1)
                if by_docs:
                    _add_by(i, values, doc_sums)
                    met[i] = True
            if by_words and totals:
                masses[:, 0] += word_sums.sum(axis=1)
            elif by_words:
                has = np.bincount(row, minlength=words.num_rows) > 0
                named, sums = words.column("key").filter(pa.array(has)), word_sums[:, has]
                if len(named):  # rows of a word lie side by side
                    other = pc.not_equal(named.slice(1), named.slice(0, len(named) - 1))
                    first = np.flatnonzero(np.r_[True, other.to_numpy(zero_copy_only=False)])
                    yield _output(named.take(pa.array(first)), np.add.reduceat(sums, first, axis=1), *shape)
        if ids is not None and totals:
            yield _output(pa.array([MASS]), masses, *shape)
        if ids is not None and mass is not None:
            wide = np.zeros((k, len(MEASURES)))
            wide[0] = measures
            yield _output(pa.array(MEASURES), wide, *shape)
        if ids is not None and by_docs:
            for at in range(0, len(ids), 10_000):
                part = met[at : at + 10_000]
                own = keys.slice(at, 10_000).filter(pa.array(part))
                yield _output(own, doc_sums[:, at : at + 10_000][:, part], *shape)

    return run


def squares(k: int) -> Callable[[Stream], Stream]:
    """``X' X b`` for the documents' factor rows b (X has a row per word), as rows of ``SUMS``. All
    cells of a word lie in its one row.
    """

    def run(batches: Stream) -> Stream:
        ids = None
        step = max(1, CELL_VALUES // k)
        for docs, words, row, place, n in _word_batches(batches, False, True):
            if ids is None:
                ids, keys, b = docs.column("d").flatten(), docs.column("key"), _factor(docs, k)
                doc_sums = np.zeros((k, len(ids)))
            word_sums = np.zeros((k, words.num_rows))
            pieces = [slice(at, at + step) for at in range(0, len(row), step)]
            for piece in pieces:
                r = row[piece]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                values = _taken(b, place[piece]) * n[piece]
                word_sums[:, r[first]] += np.add.reduceat(values, first, axis=1)
            for piece in pieces:
                _add_by(place[piece], _taken(word_sums, row[piece]) * n[piece], doc_sums)
        if ids is not None:
            for at in range(0, len(ids), 10_000):
                yield _output(keys.slice(at, 10_000), doc_sums[:, at : at + 10_000], 1, k)

    return run


def from_keys(words: Rows, docs: Rows, run: Callable[[Stream], Stream]) -> Callable[[Stream], Stream]:
    """``run`` on packed rows whose factor rows follow from the words and document ids themselves."""

    def filled(batches: Stream) -> Stream:
        for batch in batches:
            if not batch.num_rows:
                continue
            mark, names = batch.column("mark"), pc.utf8_slice_codeunits(batch.column("key"), start=1)
            sides = [(rows, np.flatnonzero(mark.to_numpy() == m)) for m, rows in enumerate((docs, words))]
            sides = [(at, rows(names.take(pa.array(at)))) for rows, at in sides if len(at)]
            f = np.empty((batch.num_rows, sides[0][1].shape[1]))
            for at, values in sides:
                f[at] = values
            yield pa.RecordBatch.from_arrays([*batch.columns, _arrays(f)], [*batch.schema.names, "f"])

    return lambda batches: run(filled(batches))
