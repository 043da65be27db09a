"""Phrases whose words stand together more often than apart, counted in HAT-tries.

A text's A-Z are lower-cased; it is split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those into words
``[^\\x20\\x09]+``. Counts are per language (null: ``und``). Phrases of 2 to 3 words that occur
``least`` times or more are candidates. Cutting one after its first words into parts that occur
l and r times gives ``floor(1000000 a a / (l r))``; the lowest cut is the score. A candidate goes
if a longer one that holds it occurs at least half as often.

Counting takes one pass over the texts per phrase length. A task gives each word a number and
keeps its counts in a shallow trie over word numbers: below the root, a hash container per first
word holds the counts by the remaining words, and bursts into one container per next word when
it grows too large. When the trie passes its limit the largest subtrees are spilled whole, each
as a run sorted by its words. Runs meet in prefix partitions (first word, and for frequent first
words several by second word), where they are merged by sum.

A phrase is as frequent as its rarest part at most, so words, then pairs, below ``least`` can't
be part of a candidate. Which ones reach it is sent to the tasks as a bit table of fixed size,
by hash: a false hit costs room in the trie, never a result. All counts are exact.

Null and empty texts have no words. Rows count as often as they stand there. Empty tables give
no rows; other columns are not read. Word counts of any size are summed as longs, scores in
decimals of 38 digits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.common import partitions_for
from topicweave.llm.hashing import mixed
from topicweave.operators.ranking import top_per_group
from topicweave.session import Scratch

LEAST = 10
LONGEST = 3
#: Up to so many languages their totals are sent to the results.
SENT_LANGUAGES = 10_000


@dataclass(frozen=True)
class Limits:
    """What a task holds at once; no result depends on it."""

    #: Distinct words or phrases before it spills.
    words: int = 1_000_000
    phrases: int = 1_500_000
    #: Entries at which a hash container bursts.
    burst: int = 4096
    #: Bytes of text turned into word numbers at once.
    stretch: int = 1 << 22
    #: Bits of the table of frequent words or phrases (8 MB), a power of two.
    filter_bits: int = 1 << 26
    #: Prefix partitions a first word's phrases may be spread over.
    spread: int = 64


_BITS = 21  # of a word's number in a packed phrase
_MASK = (1 << _BITS) - 1
_BREAK = b"\xff"  # not a byte of UTF-8: stands for the end of a piece
_TABLE = bytearray(range(256))
_TABLE[65:91] = _TABLE[97:123]
_TABLE[9] = 32
for _byte in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_byte] = _BREAK[0]
_P = np.uint64(0x9E3779B97F4A7C15)


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode())


def _repeated(lang: str, n: int) -> pa.Array:
    return pa.array([lang], pa.string()).take(pa.array(np.zeros(n, dtype=np.int32)))


def stretches(batches: Iterable[pa.RecordBatch], size_of: int) -> Iterator[tuple[str, bytes]]:
    """Lower-cased texts by language: (language, bytes) of about a stretch, cut at white space.

    The end of a piece is a byte of its own. Texts of a language are joined by it; a longer text
    goes on in the next stretch of its language.
    """
    held: dict[str, list[bytes]] = {}
    size: Counter[str] = Counter()
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            raw = text.as_buffer() if text.is_valid else None
            if raw is None or not raw.size:
                continue
            lang = "und" if lang is None else lang
            data, at = raw.to_pybytes().translate(bytes(_TABLE)), 0
            while at < len(data):
                end = len(data)
                if end - at > size_of:
                    cut = data.find(b" ", at + size_of)
                    end = cut if cut >= 0 else end
                whole = end == len(data)
                held.setdefault(lang, []).append(data[at:end])
                held[lang].append(_BREAK if whole else b" ")
                size[lang] += end - at
                at = end
                if size[lang] >= size_of:
                    yield lang, b"".join(held.pop(lang))
                    size[lang] = 0
    for lang, parts in held.items():
        yield lang, b"".join(parts)


def _counted_words(limits: Limits):
    """``lang, word, n``; the word is null for all words of the language."""

    def emitted(counts: dict[str, Counter[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            words = pa.array(list(own), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [_repeated(lang, len(own)), words, pa.array(list(own.values()), pa.int64())],
                ["lang", "word", "n"],
            )
        counts.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}
        totals: Counter[str] = Counter()
        for lang, data in stretches(batches, limits.stretch):
            words = data.replace(_BREAK, b" ").split()
            totals[lang] += len(words)
            counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > limits.words:
                yield from emitted(counts)
        yield from emitted(counts)
        for lang, n in totals.items():
            yield pa.RecordBatch.from_arrays(
                [_repeated(lang, 1), pa.nulls(1, pa.string()), pa.array([n])], ["lang", "word", "n"]
            )

    return count


class Leaf(dict):
    """A hash container: counts by the packed rest of a phrase."""


class Inner(dict):
    """A trie node: children by the number of the next word."""


class HatTrie:
    """Counts of phrases of one length, packed word numbers, under their first words."""

    def __init__(self, size: int, burst: int) -> None:
        self.size, self.burst = size, burst
        self.root = Inner()
        self.entries = 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self._into(self.root, *np.unique(keys, return_counts=True), self.size)

    def _into(self, node: Inner, keys: np.ndarray, counts: np.ndarray, rest: int) -> None:
        """Add sorted phrases of ``rest`` words below a node."""
        shift = _BITS * (rest - 1)
        heads, tails = keys >> shift, (keys & ((1 << shift) - 1)).tolist()
        starts = np.flatnonzero(np.diff(heads, prepend=-1))
        ends = np.append(starts[1:], len(keys)).tolist()
        number = counts.tolist()
        for head, a, b in zip(heads[starts].tolist(), starts.tolist(), ends, strict=True):
            child = node.get(head)
            if isinstance(child, Inner):
                self._into(child, keys[a:b] & ((1 << shift) - 1), counts[a:b], rest - 1)
                continue
            if child is None:
                child = node[head] = Leaf(zip(tails[a:b], number[a:b], strict=True))
                self.entries += b - a
            else:
                before, get = len(child), child.get
                for key, n in zip(tails[a:b], number[a:b], strict=True):
                    child[key] = get(key, 0) + n
                self.entries += len(child) - before
            if rest > 2 and len(child) > self.burst:
                node[head] = self._opened(child, shift - _BITS)

    @staticmethod
    def _opened(leaf: Leaf, shift: int) -> Inner:
        inner = Inner()
        for key, n in leaf.items():
            head = key >> shift
            if head not in inner:
                inner[head] = Leaf()
            inner[head][key & ((1 << shift) - 1)] = n
        return inner

    def _leaves(self, node: Inner | Leaf, prefix: int, rest: int) -> Iterator[tuple[Leaf, int, int]]:
        """Containers below a node, with the words above them and the number of those below."""
        if isinstance(node, Leaf):
            yield node, prefix, rest
        else:
            for head, child in node.items():
                yield from self._leaves(child, (prefix << _BITS) + head, rest - 1)

    def _entries_of(self, node: Inner | Leaf) -> int:
        return len(node) if isinstance(node, Leaf) else sum(map(self._entries_of, node.values()))

    def spill(self, left: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and counts of whole subtrees, the largest first, until ``left`` entries stay."""
        sizes = {head: self._entries_of(child) for head, child in self.root.items()}
        leaves: list[tuple[Leaf, int, int]] = []
        for head in sorted(sizes, key=sizes.__getitem__, reverse=True) if left else list(sizes):
            if self.entries <= left:
                break
            leaves += self._leaves(self.root.pop(head), head, self.size - 1)
            self.entries -= sizes[head]
        lengths = np.array([len(leaf) for leaf, _, _ in leaves], dtype=np.int64)
        n = int(lengths.sum())
        above = np.array([prefix << (_BITS * rest) for _, prefix, rest in leaves], dtype=np.int64)
        tails = np.fromiter(chain.from_iterable(leaf for leaf, _, _ in leaves), np.int64, n)
        counts = np.fromiter(chain.from_iterable(leaf.values() for leaf, _, _ in leaves), np.int64, n)
        return np.repeat(above, lengths) + tails, counts


class Filter:
    """Which words or phrases are frequent, by hash: never a false no."""

    def __init__(self, bits: bytes) -> None:
        self.bits = np.frombuffer(bits, dtype=np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _joined(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the hashes of their words."""
    with np.errstate(over="ignore"):
        return reduce(lambda a, b: mixed(a * _P + b), hashes)


class Numbers:
    """Numbers of a language's frequent words; other words, and ends of pieces, are 0."""

    def __init__(self, lang: str, frequent: Filter) -> None:
        self.seed, self.frequent = _seed(lang), frequent
        self.clear()

    def clear(self) -> None:
        self.of: dict[bytes, int] = {_BREAK: 0}
        self.words: list[bytes] = [b""]
        self.hashes = np.zeros(1, dtype=np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.of))
        if new:
            own = np.array([xxhash.xxh3_64_intdigest(w, self.seed) for w in new], dtype=np.uint64)
            known = self.frequent.has(own)
            for word, yes in zip(new, known.tolist(), strict=True):
                self.of[word] = len(self.words) if yes else 0
                if yes:
                    self.words.append(word)
            self.hashes = np.concatenate([self.hashes, own[known]])
        return np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))


class Counted:
    """One language in a task: numbers, trie and the words at the edge of a stretch."""

    def __init__(self, lang: str, size: int, words: Filter, parts: Filter | None, limits: Limits) -> None:
        self.lang, self.size, self.parts, self.spread = lang, size, parts, limits.spread
        self.numbers = Numbers(lang, words)
        self.trie = HatTrie(size, limits.burst)
        self.edge: list[bytes] = []

    def add(self, data: bytes) -> None:
        words = self.edge + data.replace(_BREAK, b" \xff ").split()
        self.edge = words[1 - self.size :]
        x, n = self.numbers(words), len(words) - self.size + 1
        if n <= 0:
            return
        columns = [x[k : k + n] for k in range(self.size)]
        held = reduce(lambda a, b: a & b, [c > 0 for c in columns])
        columns = [c[held] for c in columns]
        if self.parts is not None:
            own = [self.numbers.hashes[c] for c in columns]
            frequent = self.parts.has(_joined(own[:-1])) & self.parts.has(_joined(own[1:]))
            columns = [c[frequent] for c in columns]
        self.trie.add(reduce(lambda a, b: (a << _BITS) + b, columns))

    def spill(self, left: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs ``lang, prefix, phrase, n`` of the subtrees that go."""
        keys, counts = self.trie.spill(left)
        if not len(keys):
            return
        columns = [(keys >> (_BITS * k)) & _MASK for k in reversed(range(self.size))]
        words = pa.array(self.numbers.words, pa.binary())
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.asarray(pc.sort_indices(words))] = np.arange(len(words))
        order = np.lexsort([rank[c] for c in reversed(columns)])
        columns, counts = [c[order] for c in columns], counts[order]
        first, second = self.numbers.hashes[columns[0]], self.numbers.hashes[columns[1]]
        with np.errstate(over="ignore"):
            prefix = mixed(first + (second % np.uint64(self.spread)) * _P) >> np.uint64(33)
        for at in range(0, len(counts), 100_000):
            own = slice(at, at + 100_000)
            phrase = pc.binary_join_element_wise(*[words.take(pa.array(c[own])) for c in columns], b" ")
            yield pa.RecordBatch.from_arrays(
                [_repeated(self.lang, len(phrase)), pa.array(prefix[own].astype(np.int32)), phrase.cast(pa.string()), pa.array(counts[own])],
                names=["lang", "prefix", "phrase", "n"],
            )


def _runs(size: int, words: Broadcast, parts: Broadcast | None, limits: Limits):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Filter(words.value), Filter(parts.value) if parts is not None else None
        held: dict[str, Counted] = {}
        for lang, data in stretches(batches, limits.stretch):
            own = held.get(lang)
            if own is None:
                own = held[lang] = Counted(lang, size, *frequent, limits)
            own.add(data)
            if sum(c.trie.entries for c in held.values()) > limits.phrases:
                largest = max(held.values(), key=lambda c: c.trie.entries)
                yield from largest.spill(largest.trie.entries // 2)
            if sum(len(c.numbers.of) for c in held.values()) > limits.words:
                for c in held.values():
                    yield from c.spill(0)
                    c.numbers.clear()
        for c in held.values():
            yield from c.spill(0)

    return count


def _filter(table: DataFrame, column: str, size: int) -> Broadcast:
    """Bit table of the rows' words or phrases: ``size`` bits, whatever the rows."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            split = [[xxhash.xxh3_64_intdigest(w, _seed(lang)) for w in text.encode().split(b" ")] for lang, text in rows]
            if split:
                own = _joined(list(np.array(split, dtype=np.uint64).T))
                at = (own & np.uint64(size - 1)).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([pa.array(at)], ["at"])

    placed = table.select("lang", column).mapInArrow(places, "at long")
    buckets = placed.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    )
    bits = bytearray(max(4096, size // 8))
    for row in buckets.collect():  # size / 32768 rows at most
        own = bytes(row["bits"])
        bits[(row["bucket"] - 1) * 4096 : (row["bucket"] - 1) * 4096 + len(own)] = own
    return table.sparkSession.sparkContext.broadcast(bytes(bits[: size // 8]))


def phrase_counts(
    docs: DataFrame, least: int, longest: int, scratch: Scratch, limits: Limits
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of words and phrases that occur ``least`` times or more, and
    ``lang, n`` of all words."""
    if not 2 <= longest <= 3:
        raise ValueError("Phrases have 2 to 3 words.")
    texts = docs.select("text", "lang")
    parts = partitions_for(texts)
    counted = texts.mapInArrow(_counted_words(limits), "lang string, word string, n long")
    summed = counted.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = scratch.write(summed.where(F.col("word").isNull() | (F.col("f") >= least)), "words")
    totals = words.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    frequent = words.where(F.col("word").isNotNull() & (F.col("f") >= least))
    tables = [frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")]
    word_bits, part_bits = _filter(frequent, "word", limits.filter_bits), None
    for size in range(2, longest + 1):
        runs = texts.mapInArrow(
            _runs(size, word_bits, part_bits, limits), "lang string, prefix int, phrase string, n long"
        )
        merged = runs.repartition(parts, "prefix").groupBy("prefix", "lang", "phrase").agg(F.sum("n").alias("f"))
        merged = merged.where(F.col("f") >= least)
        found = merged.select("lang", "phrase", F.lit(size).alias("size"), "f")
        tables.append(scratch.write(found, f"phrases-{size}"))
        if size < longest:
            part_bits = _filter(tables[-1], "phrase", limits.filter_bits)
    return reduce(DataFrame.unionByName, tables), totals


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = 2000,
    limits: Limits | None = None,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases."""
    scratch = Scratch(docs.sparkSession, "collocations")
    counts, totals = phrase_counts(docs, least, longest, scratch, limits or Limits())
    candidates = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cuts = (
        candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .withColumn("left", F.array_join(F.slice(words, 1, F.col("k")), " "))
        .withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " "))
    )
    known = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    for side, name in (("left", "l"), ("right", "r")):
        on = (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))
        cuts = cuts.join(known, on).withColumnRenamed("_f", name).drop("_lang", "_part", side)
    decimal = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", *[v.alias(f"_{c}") for c, v in decimal.items()])
    score = F.expr("cast((_a * _a) * 1000000 div (_l * _r) as long)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    # every phrase of two words or more inside a longer candidate, with that one's count
    inside = (
        candidates.where("size > 2")
        .withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
        .withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_n") + 1)))
        .select(F.col("lang").alias("_lang"), F.array_join(F.slice(words, F.col("_at"), F.col("_n")), " ").alias("_part"), "a")
        .groupBy("_lang", "_part")
        .agg(F.max("a").alias("longer"))
    )
    on = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part"))
    kept = scored.join(inside, on, "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 50)
    )
    # a language may hold most candidates: a salted round leaves few of them for the last ranking
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    ranked = top_per_group(kept, ["lang"], order, top)
    totals = totals.select(F.col("lang").alias("_of"), "n")
    if totals.count() <= SENT_LANGUAGES:
        totals = F.broadcast(totals)
    return ranked.join(totals, F.col("lang") == F.col("_of")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
