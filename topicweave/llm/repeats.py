"""Removal of long repeated byte strings by a distributed suffix sort.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in the
corpus. Such a string holds an anchor: a position whose 64-byte gram has the smallest hash among
the grams of some string of that length. Anchors depend on the string alone, so equal strings
share theirs at equal places, and only anchors are moved (about one byte in seventy).

1. Anchors whose gram occurs once are dropped.
2. An anchor's context is all that a string through it can reach. Contexts that occur twice
   are repeated as a whole, whatever their number.
3. The distinct contexts of a gram that are left are suffix-sorted: the parts to the right of
   the anchor, and those to the left read backwards, each by a merge sort that compares two
   suffixes by binary search over prefix polynomial hashes for their common extension. Neighbours'
   extensions are verified on the bytes. Contexts in one run of both orders, at depths that
   add up to ``length``, share a string. All the strings of a context pass through its anchor, so
   what is repeated is one stretch.
4. A gram with more contexts than a task should sort is settled by counting string hashes
   instead, one row per string, so no group has to fit a task.

A null text is empty. Shorter texts than ``length`` lose nothing. Rows with equal id and text are
separate documents that repeat each other. An empty table gives no rows. Extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm import hashing
from topicweave.llm.common import partitions_for, shuffle_partitions
from topicweave.session import Scratch

GRAM = 64
#: Bytes handled at a time; longer texts come in stretches that overlap.
STRETCH = 1 << 18
#: Contexts of one gram that a task sorts; above, strings are counted by hash.
SORTED = 20_000
NO_ID = -(1 << 63)


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``size`` values in a row."""
    width, out = 1, values
    while 2 * width <= size:
        out = pick(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, starts: np.ndarray, length: int):
    """Anchors of texts laid end to end: position, gram hash, context hash.

    ``starts`` holds the texts' beginnings and the end of the last.
    """
    n, window = len(data), length - GRAM + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none.astype(np.uint64), none.astype(np.uint64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    with np.errstate(over="ignore"):
        up, down = hashing.powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[:n], out=sums[1:])
        grams = hashing.mixed((sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1])
        least = _sliding(grams, window, np.minimum)
        inside = text[: n - length + 1] == text[length - 1 :]
        least = np.where(inside, least, np.uint64(0))
        edge = np.zeros(window - 1, dtype=np.uint64)
        most = _sliding(np.concatenate([edge, least, edge]), window, np.maximum)
        at = np.flatnonzero((most == grams) & (grams != 0))
        own = text[at]
        low = np.maximum(starts[own], at - (length - GRAM))
        high = np.minimum(starts[own + 1], at + length)
        context = (sums[high] - sums[low]) * down[low] + (at - low).astype(np.uint64)
        return at, grams[at], hashing.mixed(hashing.mixed(context) + (high - low).astype(np.uint64))


def stretches(bodies: list[np.ndarray], length: int):
    """Groups of whole texts, or stretches of a long one: bytes, starts, text numbers, offset
    of the first byte, and the range of positions that count."""
    held, numbers, size = [], [], 0
    margin = 2 * length
    for k, body in enumerate(bodies):
        if len(body) < length:
            continue
        if len(body) > STRETCH:
            for s in range(0, len(body), STRETCH):
                low, high = max(0, s - margin), min(len(body), s + STRETCH + margin)
                own = body[low:high]
                yield own, np.array([0, len(own)]), [k], low, s - low, min(s + STRETCH, len(body)) - low
            continue
        held.append(body)
        numbers.append(k)
        size += len(body)
        if size >= STRETCH:
            yield np.concatenate(held), np.cumsum([0, *map(len, held)]), numbers, 0, 0, size
            held, numbers, size = [], [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0, *map(len, held)]), numbers, 0, 0, size


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc, mark, body``: id and 32 bits of the text's hash tell rows apart."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("mark"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"),
    )


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """``gram, context, doc, mark, pos`` of every anchor. Moves no rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy() for i in (0, 1))
            bodies = list(hashing.texts(batch.column(2)))
            for data, starts, numbers, offset, low, high in stretches(bodies, length):
                at, gram, context = anchors(data, starts, length)
                keep = (at >= low) & (at < high)
                at, gram, context = at[keep], gram[keep], context[keep]
                which = np.searchsorted(starts, at, side="right") - 1
                own = np.array(numbers)[which]
                pos = at - starts[which] + offset
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids[own]),
                     pa.array(marks[own]), pa.array(pos)],
                    names=["gram", "context", "doc", "mark", "pos"],
                )

    return _keyed(docs).mapInArrow(work, "gram long, context long, doc long, mark int, pos long")


class Suffixes:
    """Suffixes of equal-width rows of bytes, compared inside their groups."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> None:
        self.rows, self.sizes, self.group = rows, sizes, group
        n, width = rows.shape
        with np.errstate(over="ignore"):
            up, _ = hashing.powers(width)
            values = (rows.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[:width]
            self.sums = np.zeros((n, width + 1), dtype=np.uint64)
            np.cumsum(values, axis=1, out=self.sums[:, 1:])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common beginnings of pairs of suffixes, by binary search."""
        low = np.zeros(len(a), dtype=np.int64)
        high = np.minimum(self.sizes[a], self.sizes[b])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.sums[a, middle] == self.sums[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` sorts before ``b`` (equal ones by row number)."""
        common = self.extension(a, b)
        end_a, end_b = common >= self.sizes[a], common >= self.sizes[b]
        last = self.rows.shape[1] - 1
        at = np.minimum(common, last)
        byte_a = np.where(end_a, -1, self.rows[a, at].astype(np.int64))
        byte_b = np.where(end_b, -1, self.rows[b, at].astype(np.int64))
        less = np.where(byte_a == byte_b, a < b, byte_a < byte_b)
        return np.where(self.group[a] == self.group[b], less, self.group[a] < self.group[b])

    def order(self) -> np.ndarray:
        """Merge sort, all merges of a level at once."""
        n, width = len(self.group), 1
        out = np.arange(n)
        while width < n:
            out = self._merged(out, width)
            width *= 2
        return out

    def _merged(self, out: np.ndarray, width: int) -> np.ndarray:
        n = len(out)
        place = np.arange(n)
        run = place // width
        partner = run ^ 1
        base = np.minimum(run, partner) * width
        low = partner * width
        high = np.minimum(low + width, n)
        first = np.minimum(low, n)
        low, high = first.copy(), np.maximum(high, first)
        while (low < high).any():
            open_ = low < high
            middle = (low + high) // 2
            other = out[np.minimum(middle, n - 1)]
            # Elements of the partner run that come before this one.
            earlier = self.before(other, out)
            low, high = (
                np.where(open_ & earlier, middle + 1, low),
                np.where(open_ & ~earlier, middle, high),
            )
        merged = np.empty_like(out)
        merged[base + (place - run * width) + (low - first)] = out
        return merged

    def neighbours(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order and the common beginnings of each suffix with the one before it, verified
        on the bytes; -1 at the first of a group. Sorts by bytes if a hash has lied."""
        a, b = order[:-1], order[1:]
        common = self.extension(a, b)
        width = self.rows.shape[1]
        differ = self.rows[a] != self.rows[b]
        real = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        real = np.minimum(real, np.minimum(self.sizes[a], self.sizes[b]))
        alike = self.group[a] == self.group[b]
        if (alike & (real != common)).any():
            columns = [self.sizes, *self.rows.T[::-1], self.group]
            order = np.lexsort(columns)
            a, b = order[:-1], order[1:]
            differ = self.rows[a] != self.rows[b]
            real = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            real = np.minimum(real, np.minimum(self.sizes[a], self.sizes[b]))
            alike = self.group[a] == self.group[b]
        return order, np.concatenate([[-1], np.where(alike, real, -1)])


def shared_stretch(
    left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray,
    group: np.ndarray, length: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Bytes to the left and to the right of each anchor that strings shared inside its group
    cover (-1: none). ``left`` is read backwards from the anchor."""
    n = len(group)
    runs = []
    for rows, sizes in ((left, left_size), (right, right_size)):
        suffixes = Suffixes(rows, sizes, group)
        runs.append(suffixes.neighbours(suffixes.order()))

    def classes(side: int, depth: int) -> np.ndarray:
        order, common = runs[side]
        out = np.empty(n, dtype=np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    to_left, to_right = np.full(n, -1), np.full(n, -1)
    for back in range(length - GRAM + 1):
        able = np.flatnonzero((left_size >= back) & (right_size >= length - back))
        if len(able) < 2:
            continue
        key = classes(0, back)[able] * (n + 1) + classes(1, length - back)[able]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        hit = able[counts[inverse] > 1]
        to_left[hit] = np.maximum(to_left[hit], back)
        to_right[hit] = np.maximum(to_right[hit], length - back)
    return to_left, to_right


def _padded(parts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    rows = np.zeros((len(parts), width), dtype=np.uint8)
    rows[np.arange(width) < sizes[:, None]] = np.concatenate(parts) if parts else 0
    return rows, sizes


SPAN = "doc long, mark int, low long, high long"


def sort_contexts(snippets: DataFrame, length: int) -> DataFrame:
    """Stretches found by suffix-sorting the contexts of each gram; rows come by gram."""

    def settle(grams: list, docs: list, marks: list, places: list, backs: list, bytes_: list):
        _, group = np.unique(np.array(grams), return_inverse=True)
        order = np.argsort(group, kind="stable")
        own = [np.frombuffer(bytes_[i], dtype=np.uint8) for i in order]
        cut = [backs[i] for i in order]
        left, left_size = _padded([b[:c][::-1] for b, c in zip(own, cut, strict=True)], length - GRAM)
        right, right_size = _padded([b[c:] for b, c in zip(own, cut, strict=True)], length)
        to_left, to_right = shared_stretch(left, left_size, right, right_size, group[order], length)
        hit = np.flatnonzero(to_left >= 0)
        at = np.array([places[order[i]] for i in hit], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([docs[order[i]] for i in hit], pa.int64()),
             pa.array([marks[order[i]] for i in hit], pa.int32()),
             pa.array(at - to_left[hit]), pa.array(at + to_right[hit])],
            names=["doc", "mark", "low", "high"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if len(held[0]) >= 4096 and row[0] != held[0][-1]:
                    yield settle(*held)
                    held = [[] for _ in range(6)]
                for store, value in zip(held, row, strict=True):
                    store.append(value)
        if held[0]:
            yield settle(*held)

    return snippets.select("gram", "doc", "mark", "pos", "back", "snippet").mapInArrow(work, SPAN)


def count_strings(snippets: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """The same stretches by counting the hashes of all strings through an anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, doc, mark, pos, back, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = np.frombuffer(raw, dtype=np.uint8)
                n = len(data) - length + 1
                if n <= 0:
                    continue
                # Strings must pass through the anchor's gram: they start from its left, up to it.
                start = np.arange(0, min(n, back + 1))
                with np.errstate(over="ignore"):
                    up, down = hashing.powers(len(data))
                    sums = np.zeros(len(data) + 1, dtype=np.uint64)
                    np.cumsum((data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[: len(data)], out=sums[1:])
                    raw_hash = (sums[start + length] - sums[start]) * down[start]
                    back_of = (back - start).astype(np.uint64)
                    one = hashing.mixed(raw_hash + back_of * np.uint64(0xD6E8FEB86659FD93))
                    two = hashing.mixed((raw_hash ^ np.uint64(gram & ((1 << 64) - 1))) * np.uint64(0xD6E8FEB86659FD93))
                size = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([doc] * size, pa.int64()),
                     pa.array([mark] * size, pa.int32()), pa.array([pos] * size, pa.int64()),
                     pa.array(start - back + pos)],
                    names=["one", "two", "doc", "mark", "pos", "low"],
                )

    rows = snippets.select("gram", "doc", "mark", "pos", "back", "snippet").mapInArrow(
        work, "one long, two long, doc long, mark int, pos long, low long"
    )
    twice = rows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    twice = scratch.write(twice, "strings")
    return (
        rows.join(twice, ["one", "two"])
        .groupBy("doc", "mark", "pos")
        .agg(F.min("low").alias("low"), (F.max("low") + length).alias("high"))
        .select("doc", "mark", "low", "high")
    )


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every document."""
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    parts = partitions_for(docs, 64)

    # Counts are written before each join: a join of two plain exchanges can be split where one
    # gram has a great share of the rows; a join on top of the count could not.
    grams = anchor_rows(docs, length).groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    grams = scratch.write(grams.where("times > 1").drop("times"), "grams")
    found = scratch.write(anchor_rows(docs, length).join(grams, "gram"), "found")
    contexts = scratch.write(
        found.groupBy("gram", "context").agg(
            F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "mark", "pos")).alias("row")
        ),
        "contexts",
    )
    whole = found.join(contexts.where("times > 1").select("gram", "context"), ["gram", "context"]).select(
        "doc", "mark", (F.col("pos") - (length - GRAM)).alias("low"), (F.col("pos") + length).alias("high")
    )
    groups = contexts.groupBy("gram").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("times").alias("fewest")
    ).where("kinds > 1 AND fewest = 1").select("gram", "kinds")
    groups = scratch.write(groups, "groups")
    wanted = contexts.join(groups, "gram").select("gram", "kinds", "row.*")

    # The texts move once: both joins below read the same exchange.
    bodies = _keyed(docs).repartition(parts, "doc", "mark")
    back = F.least(F.col("pos"), F.lit(length - GRAM)).cast("int")
    snippets = bodies.join(wanted, ["doc", "mark"]).select(
        "gram", "kinds", "doc", "mark", "pos", back.alias("back"),
        F.substring(F.col("body"), (F.col("pos") - back + 1).cast("int"), back + length).alias("snippet"),
    )
    snippets = scratch.write(snippets, "snippets")
    few = snippets.where(F.col("kinds") <= SORTED).repartition(
        shuffle_partitions(spark), "gram"
    ).sortWithinPartitions("gram")
    parts_found = [whole, sort_contexts(few, length)]
    many = snippets.where(F.col("kinds") > SORTED)
    if not many.isEmpty():
        parts_found.append(count_strings(many, length, scratch))
    spans = parts_found[0]
    for other in parts_found[1:]:
        spans = spans.unionByName(other)
    lists = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    joined = bodies.join(lists, ["doc", "mark"], "left").select("doc", "body", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data, found_spans in zip(
                batch.column(0).to_pylist(), hashing.texts(batch.column(1)), batch.column(2), strict=True
            ):
                rows.append((None if doc == NO_ID else doc, *_cut(data, found_spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT
            )

    return joined.mapInArrow(
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
        " spans array<struct<low:bigint,high:bigint>>",
    )


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
    ]
)


def _cut(data: np.ndarray, found: pa.ListScalar) -> tuple:
    n = len(data)
    raw = data.tobytes()
    if not found.is_valid or not len(found):
        return n, 0, 0, hashlib.sha256(raw).hexdigest(), []
    values = found.values
    low = np.clip(values.field("low").to_numpy(), 0, n)
    high = np.clip(values.field("high").to_numpy(), 0, n)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    opens = np.concatenate([[True], low[1:] > high[:-1]])
    first = low[opens]
    last = high[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(low) - 1]])]
    digest, at = hashlib.sha256(), 0
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        digest.update(raw[at:a])
        at = b
    digest.update(raw[at:])
    spans = [{"low": a, "high": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return n, int((last - first).sum()), len(first), digest.hexdigest(), spans
