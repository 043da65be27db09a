"""Best-fit packing of token sequences by the sum-of-squares rule.

A document's ids end with id 0. Only documents longer than a sequence are cut, into full
pieces and a shorter last one. Pieces are dealt evenly to tasks. A task places its long pieces
(a third of a sequence or more) from the longest down and then the others in a hashed order,
for which the rule is made: a piece goes to the open sequence, or a new one, for which the sum
of the squared counts of open sequences per residual gap becomes smallest. A task packs
independently, so what is lost against packing all at once is at most the sequences a task
leaves open, against ``per_task`` pieces.

A null text is empty: one piece, the id 0. Every row is packed, repeated rows and ids too.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.hashing import mixed
from topicweave.llm.tokens import default_path, tokenizer
from topicweave.session import Scratch

CAPACITY = 2048


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document. Moves no rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        step = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, start, piece = b"", 0, 0
                parts = [*encode(text.as_py() or ""), b"\0\0\0\0"]
                for i, part in enumerate(parts):
                    held += part
                    last = i == len(parts) - 1
                    at = 0
                    while len(held) - at > step or (last and at < len(held)):
                        own = held[at : at + step]
                        rows.append((doc_id, piece, start, len(own) // 4, zlib.crc32(own)))
                        piece, start, at = piece + 1, start + len(own) // 4, at + step
                    held = held[at:]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, taken in the given order."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences per gap
    leaves = np.full(capacity + 1, 1 << 60, dtype=np.int64)  # -count where there are any
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    used = 0
    for i, size in enumerate(map(int, lengths)):
        if size < capacity:
            # From gap g to gap g - size the sum changes by 2 (count[g - size] - count[g]) + 2,
            # by one less if the sequence is then full; a new sequence adds 2 count + 1.
            change = leaves[size:capacity] + count[: capacity - size]
            best = int(change.argmin())
            at, gain = size + best, 2 * int(change[best]) + 2
            exact = 2 * int(leaves[size]) + 1
            if exact <= gain:
                at, gain = size, exact
            if gain > 2 * int(count[capacity - size]) + 1:
                at = capacity
        else:
            at = capacity
        if at == capacity:
            own, used = used, used + 1
        else:
            own = open_at[at].pop()
            count[at] -= 1
            leaves[at] = -count[at] if count[at] else 1 << 60
        sequence[i], offset[i] = own, capacity - at
        rest = at - size
        if rest:
            open_at[rest].append(own)
            count[rest] += 1
            leaves[rest] = -count[rest]
    return sequence, offset


def placing_order(lengths: np.ndarray, at: np.ndarray, capacity: int) -> np.ndarray:
    """Long pieces from the longest down, then the others by a hash of their number ``at``."""
    with np.errstate(over="ignore"):
        drawn = mixed(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    size = np.where(3 * lengths >= capacity, lengths, 0)
    return np.lexsort((at, drawn, -size))


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, per_task: int = 50_000
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    scratch = Scratch(docs.sparkSession, "pack")
    cut = pieces(docs, path or default_path(), capacity)
    held = scratch.write(cut.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    tasks = max(1, -(-held.count() // per_task))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        table = table.take(placing_order(table["length"].to_numpy(), table["_at"].to_numpy(), capacity))
        sequence, offset = sum_of_squares(table["length"].to_numpy(), capacity)
        sequence += TaskContext.get().partitionId() << 36
        table = table.drop_columns(["_at"])
        table = table.append_column("sequence_id", pa.array(sequence))
        yield from table.append_column("offset", pa.array(offset)).to_batches(10_000)

    return held.repartition(tasks, "_at").mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long,"
        " sequence_id long, offset long",
    )
