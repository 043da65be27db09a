"""Document fingerprints from prefix polynomial hashes.

A text is its code points c[0..n). Two modular prefix arrays (two bases, two 31-bit primes)
hold h[i] = sum of (c[j] + 1) * base**j for j < i. The hash of any span is a difference of two
entries, so two spans are compared in constant time (the shorter offset is raised by the power
of the offsets' difference) and the longest common extension at two places is found by binary
search. The fingerprint is the length and the closing entries: equal texts have equal ones.

Likeness of two fingerprints (0 to 1): the code points of spans common to both over the length
of the longer. The spans are the common prefix, the common suffix and, between them, all of
``WINDOW`` code points or more, in any order; what they cover is counted in both texts and the
smaller count taken. Two empty texts have likeness 1.

A null text is empty. Documents follow one another by ascending ``doc_id``, nulls last, equal
ids by text hash; after the last comes the first, so a single document follows itself. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.common import partitions_for

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1380512911)
#: Shortest span that counts between the common prefix and suffix.
WINDOW = 24

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64) for _ in PRIMES]


def powers(n: int) -> list[np.ndarray]:
    """Powers 0..n of the bases; the tables double as longer texts come."""
    for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
        table = _powers[k]
        while len(table) <= n:
            step = np.uint64(pow(b, len(table), p))
            table = np.concatenate([table, table * step % np.uint64(p)])
        _powers[k] = table
    return _powers


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.n = n
        self.points = points
        values = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for p, table in zip(PRIMES, powers(n), strict=True):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(values * table[:n] % np.uint64(p), out=sums[1:])
            self.sums.append(sums)

    def span(self, k: int, start: int, length: int) -> int:
        sums = self.sums[k]
        return (int(sums[start + length]) - int(sums[start])) % PRIMES[k]

    def fingerprint(self) -> str:
        closing = "".join(f"{self.span(k, 0, self.n):08x}" for k in range(len(PRIMES)))
        return f"{self.n:x}-{closing}"


def equal_spans(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    low, high, shift = (a.span, b.span, j - i) if i <= j else (b.span, a.span, i - j)
    at_low, at_high = (i, j) if i <= j else (j, i)
    for k, p in enumerate(PRIMES):
        if low(k, at_low, length) * int(_powers[k][shift]) % p != high(k, at_high, length):
            return False
    return True


def extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Longest common extension to the right of ``a[i:]`` and ``b[j:]``."""
    low, high = 0, min(a.n - i, b.n - j)
    step = 1
    while low < high and step <= high and equal_spans(a, i, b, j, step):
        low, step = step, 2 * step
    high = min(high, step - 1) if low < high else high
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def extension_left(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Longest common extension to the left of ``a[:i]`` and ``b[:j]``."""
    low, high = 0, min(i, j)
    step = 1
    while low < high and step <= high and equal_spans(a, i - step, b, j - step, step):
        low, step = step, 2 * step
    high = min(high, step - 1) if low < high else high
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, i - middle, b, j - middle, middle):
            low = middle
        else:
            high = middle - 1
    return low


def window_hashes(a: Prefixes, k: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows that start at ``at``, moved to a common place, by the k-th base."""
    p = np.uint64(PRIMES[k])
    raw = (a.sums[k][at + WINDOW] - a.sums[k][at]) % p
    # base**(-i) brings position i to position 0
    return raw * _inverse_powers(k, a.n)[at] % p


_inverse: list[np.ndarray] = [np.ones(1, dtype=np.uint64) for _ in PRIMES]


def _inverse_powers(k: int, n: int) -> np.ndarray:
    p, table = PRIMES[k], _inverse[k]
    back = pow(BASES[k], -1, p)
    while len(table) <= n:
        table = np.concatenate([table, table * np.uint64(pow(back, len(table), p)) % np.uint64(p)])
    _inverse[k] = table
    return table


def covered(at: np.ndarray) -> int:
    """Code points under the windows that start at the ascending positions ``at``."""
    return int(np.minimum(np.diff(at), WINDOW).sum()) + WINDOW if len(at) else 0


def common_between(a: Prefixes, b: Prefixes, start: int, last: int) -> int:
    """Code points of spans of ``WINDOW`` or more common to both texts without their first
    ``start`` and last ``last``, wherever they stand; of the two sides' counts the smaller.

    Such a span is a run of equal windows, so all windows are compared. A table of the first
    base's hashes leaves those that may be equal; the hashes of both bases settle these.
    """
    ends = [t.n - last - WINDOW + 1 for t in (a, b)]
    if min(ends) <= start:
        return 0
    at = [np.arange(start, end) for end in ends]
    one = [window_hashes(t, 0, own) for t, own in zip((a, b), at, strict=True)]
    mask = np.uint64((1 << (8 * max(map(len, at))).bit_length()) - 1)
    slots = [(h & mask).astype(np.int64) for h in one]
    for own, other in ((0, 1), (1, 0)):
        seen = np.zeros(int(mask) + 1, dtype=bool)
        seen[slots[other]] = True
        maybe = seen[slots[own]]
        at[own], one[own], slots[own] = at[own][maybe], one[own][maybe], slots[own][maybe]
    if not len(at[0]) or not len(at[1]):
        return 0
    both = [
        h << np.uint64(31) | window_hashes(t, 1, own)
        for t, own, h in zip((a, b), at, one, strict=True)
    ]
    kinds = [np.unique(h) for h in both]
    equal = np.intersect1d(*kinds, assume_unique=True)
    if not len(equal):
        return 0
    counts = []
    for own, h in zip(at, both, strict=True):
        place = np.minimum(np.searchsorted(equal, h), len(equal) - 1)
        counts.append(covered(own[equal[place] == h]))
    return min(counts)


def likeness(a: Prefixes, b: Prefixes) -> float:
    longest, shortest = max(a.n, b.n), min(a.n, b.n)
    if not longest:
        return 1.0
    if not shortest:
        return 0.0
    first = extension(a, 0, b, 0)
    last = min(extension_left(a, a.n, b, b.n), shortest - first)
    common = first + last
    if common < shortest:
        common += common_between(a, b, first, last)
    return common / longest


def edited_points(own: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(own) // 2
    return np.concatenate([own[: len(own) - half], following[:half]])


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``part, ahead, doc_id, text`` with every document in the part of its id, in order, and
    the first documents of the next part once more at the end of a part (``ahead``).

    Ids alone are read to find the bounds of the parts; texts are moved once. A part's
    successor is known from one id per part.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    fractions = [i / parts for i in range(1, parts)] or [0.5]
    found = ids.agg(F.percentile_approx("doc_id", fractions, 10_000)).first()[0] or []
    bounds = np.unique(np.array(found, dtype=np.int64))

    def places(values: pd.Series, missing: pd.Series) -> np.ndarray:
        out = np.searchsorted(bounds, values.to_numpy(), side="left")
        out[missing.to_numpy()] = len(bounds)
        return out

    id_and_null = [F.coalesce("doc_id", F.lit(0)).cast("long"), F.col("doc_id").isNull()]

    @F.pandas_udf("int")
    def part_of(values: pd.Series, missing: pd.Series) -> pd.Series:
        return pd.Series(places(values, missing).astype("int32"))

    own_part = part_of(*id_and_null).alias("part")
    heads = {
        r["part"]: r["head"]
        for r in ids.groupBy(own_part).agg(F.min("doc_id").alias("head")).collect()
    }
    held = sorted(heads)
    before = {heads[p]: held[i - 1] for i, p in enumerate(held)}  # the first follows the last

    @F.pandas_udf("array<int>")
    def parts_of(values: pd.Series, missing: pd.Series) -> pd.Series:
        out = []
        for value, place, null in zip(values, places(values, missing), missing, strict=True):
            ahead = before.get(None if null else int(value))
            out.append([int(place)] if ahead is None else [int(place), -1 - int(ahead)])
        return pd.Series(out)

    dealt = docs.select("doc_id", "text", F.explode(parts_of(*id_and_null)).alias("_to")).select(
        F.when(F.col("_to") < 0, -1 - F.col("_to")).otherwise(F.col("_to")).alias("part"),
        (F.col("_to") < 0).alias("ahead"),
        "doc_id",
        "text",
    )
    order = ["part", "ahead", F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(*order)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, closed = None, None, False
        for batch in batches:
            rows = []
            columns = [batch.column(i) for i in range(3)]
            texts = batch.column(3)
            for r in range(batch.num_rows):
                here, ahead, doc_id = (c[r].as_py() for c in columns)
                if here != part:
                    part, last, closed = here, None, False
                if closed:
                    continue
                text = texts[r].as_py() or ""
                own = Prefixes(codes(text))
                if last is not None:
                    rows.append(_row(*last, own))
                last, closed = (doc_id, own), ahead
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(rows, columns=[f.name for f in SCHEMA]), schema=SCHEMA, preserve_index=False
            )

    return with_next(docs.select("doc_id", "text"), partitions_for(docs, 64)).mapInArrow(
        work,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double",
    )


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _row(doc_id: int | None, own: Prefixes, following: Prefixes) -> tuple:
    points = edited_points(own.points, following.points)
    edited = Prefixes(points)
    digest = hashlib.sha256(
        points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    ).hexdigest()
    return (
        doc_id, own.n, digest, own.fingerprint(), edited.fingerprint(),
        likeness(own, edited), likeness(own, following),
    )
