"""Alignment of two tokenizations of the same texts, and how often their tokens meet.

Tokenizer A (byte-level BPE, a ``tokenizers`` file) reads space + text, tokenizer B (a
sentencepiece model, which adds the space itself) the text. The byte offsets at which tokens end
are two ascending lists. The shorter drives a galloping intersection: from a finger in the longer
one the step doubles until the offset is passed, then a binary search goes between the last two
steps. Offsets in both lists cut the tokens into groups; differences of the ranks of neighbouring
common offsets say how many tokens of either side a group has. All A-B pairs of a group are linked.

A pair of ids counts the documents that hold it linked. Documents are taken in blocks of bounded
size: a task writes each document's distinct pairs with their occurrences, packed, and per block
the distinct pairs with their document counts. Only these block rows are summed by pair; the
counts return to each block by an equi-join, and a block's documents are scored from them. The
tables never move per occurrence, and no vocabulary-sized table is sent to tasks.

Null and empty texts, and texts whose joined token bytes differ from space + text on either side
(a literal U+2581, say), have no tokens: zeros and an empty digest; they count in no pair.
Repeated rows are documents of their own, as are rows with equal or null ids. Texts are cut where
a single space stands between other characters, where tokens of both sides end, so long texts
take bounded memory but for their distinct pairs. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.session import Scratch

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
#: Distinct units of B kept in a worker, none longer than so many characters.
KEPT_UNITS = 400_000
KEPT_LENGTH = 64
#: A run of so many characters without a border goes to the library that A's file is made for.
LONG_RUN = 512
#: Characters aligned at once; longer texts are cut into stretches of about so many.
STRETCH = 1 << 19
#: Pairs and documents of a block.
BLOCK_PAIRS = 2_000_000
BLOCK_DOCS = 50_000
#: A group with more links is counted by its distinct ids.
LARGE_GROUP = 4096

#: Units of B: no piece holds a space after another character.
_UNITS = re.compile(r" +[^ ]*")
_LONG_GAP = re.compile(rf"\s{{{LONG_RUN}}}")
# A's splitting pattern, and ranges of code points whose class no version of
# Unicode has changed, so that both libraries split them alike.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STABLE = [
    (0x00, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3CE), (0x400, 0x45F), (0x2000, 0x2063),
    (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x1F300, 0x1F320),
    (0x1F600, 0x1F640),
]
_PLAIN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _STABLE) + "]*")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letter_bytes() -> dict[str, int]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for code
    points from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A: a byte-level BPE file; special tokens' strings are plain text.

    Its merges are in the order of the ids, so that a faster library finds the same tokens from
    the ids alone; texts the two might split differently go to the file's own library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        letters = _letter_bytes()
        special = {t["content"] for t in held["added_tokens"]}
        model = {t: i for t, i in held["model"]["vocab"].items() if t not in special}
        ranks = {bytes(letters[c] for c in token): i for token, i in model.items()}
        _checked_size(len(held["model"]["vocab"]) + len(special))
        self.lengths = np.zeros(1 << 16, dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        plain = held["normalizer"] is None and held["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }
        self.fast = None
        if plain and [model.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))):
            import tiktoken

            self.fast = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text that starts with a space."""
        long_word = max(map(len, text.split()), default=0) > LONG_RUN
        if self.fast is not None and not long_word and _PLAIN.fullmatch(text) and not _LONG_GAP.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint16)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint16)


class Pieces:
    """B: a sentencepiece model that adds a space in front and falls back to bytes.

    Texts are taken by units (spaces and what follows up to the next space); each distinct
    unit is encoded once.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model, space = self.model, "\u2581"
        names = [model.id_to_piece(i) for i in range(_checked_size(model.get_piece_size()))]
        id_bytes = [
            b"" if model.is_control(i) or model.is_unknown(i)
            else bytes([int(name[3:5], 16)]) if model.is_byte(i)
            else name.replace(space, " ").encode()
            for i, name in enumerate(names)
        ]
        self.id_bytes = np.array(id_bytes, dtype=object)
        self.lengths = np.array([len(b) for b in id_bytes], dtype=np.int64)
        self.alone = [model.piece_to_id(space)]
        # a piece with a space after another character would cross the borders of units
        self.by_units = not any(space in n.lstrip(space) for n in names)
        self.known: dict[str, bytes] = {}

    def _encoded(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        # the model puts the first space itself, but none before nothing
        for unit, ids in zip(units, self.model.encode([u[1:] for u in units], num_threads=1), strict=True):
            yield unit, array("H", ids if len(unit) > 1 else self.alone).tobytes()

    def _joined(self, text: str) -> bytes:
        units, known = _UNITS.findall(text) if self.by_units else [text], self.known
        try:
            return b"".join([known[u] for u in units])
        except KeyError:
            new = list(set(units).difference(known))
        known.update(self._encoded(new))
        found = b"".join([known[u] for u in units])
        for unit in new:
            if len(unit) > KEPT_LENGTH:
                del known[unit]
        if len(known) > KEPT_UNITS:
            known.clear()
        return found

    def ids(self, text: str, raw: bytes) -> np.ndarray | None:
        """Ids of a text that starts with a space; None if their bytes aren't the text's."""
        ids = np.frombuffer(self._joined(text), dtype=np.uint16)
        return ids if b"".join(self.id_bytes[ids].tolist()) == raw else None


def _checked_size(size: int) -> int:
    if size > 1 << 16:
        raise ValueError("Token ids must fit 16 bits.")
    return size


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, once per worker process."""
    return ByteLevel(a_path), Pieces(b_path)


def gallop(driver: np.ndarray, target: np.ndarray, finger: np.ndarray) -> np.ndarray:
    """Place in ``target`` of the first value not below each of ``driver``, all at once.

    From its finger each search doubles its step, to the right or to the left, until the value
    is passed; the binary search between the last two places follows.
    """
    n = len(target)
    right = target[finger] < driver
    low = np.where(right, finger, finger - 1)
    high = np.where(right, finger + 1, finger)
    step = 1
    going = np.flatnonzero(right)
    while len(going):
        at = high[going]
        going = going[(at < n) & (target[np.minimum(at, n - 1)] < driver[going])]
        low[going] = high[going]
        step *= 2
        high[going] += step
    step = 1
    going = np.flatnonzero(~right)
    while len(going):
        at = low[going]
        going = going[(at >= 0) & (target[np.maximum(at, 0)] >= driver[going])]
        high[going] = low[going]
        step *= 2
        low[going] -= step
    low, high = np.maximum(low, -1), np.minimum(high, n)
    going = np.flatnonzero(high - low > 1)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        less = target[middle] < driver[going]
        low[going[less]] = middle[less]
        high[going[~less]] = middle[~less]
        going = going[high[going] - low[going] > 1]
    return high


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def common_ends(
    ends_a: np.ndarray, ends_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (in A, in B) of the ends that both lists have. ``n_a`` and ``n_b`` are the numbers
    of tokens of each text; in each the side with fewer drives."""
    found = []
    for fewer in (n_a <= n_b, n_a > n_b):
        of_a = np.flatnonzero(np.repeat(fewer, n_a))
        of_b = np.flatnonzero(np.repeat(fewer, n_b))
        if not len(of_a):
            continue
        a_drives = n_a[fewer][0] <= n_b[fewer][0]
        drive, search = (of_a, of_b) if a_drives else (of_b, of_a)
        driver, target = (ends_a[of_a], ends_b[of_b]) if a_drives else (ends_b[of_b], ends_a[of_a])
        short, long = (n_a[fewer], n_b[fewer]) if a_drives else (n_b[fewer], n_a[fewer])
        rank = np.arange(len(driver)) - np.repeat(_firsts(short), short)
        finger = np.repeat(_firsts(long), short) + rank * np.repeat(long, short) // np.repeat(short, short)
        place = gallop(driver, target, finger)
        hit = np.flatnonzero(target[np.minimum(place, len(target) - 1)] == driver)
        both = drive[hit], search[place[hit]]
        found.append(both if a_drives else both[::-1])
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(a)
    return a[order], b[order]


def _links(
    ids_a: np.ndarray, ids_b: np.ndarray, text: np.ndarray, size_a: np.ndarray, size_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, A id, B id), packed and ascending, with their links; ``text`` is each
    group's, the sizes its tokens."""
    first_a, first_b = _firsts(size_a), _firsts(size_b)
    links = size_a * size_b
    small = np.flatnonzero(links <= LARGE_GROUP)
    group = np.repeat(small, links[small])
    within = np.arange(len(group)) - np.repeat(_firsts(links[small]), links[small])
    wide = size_b[group]
    a, b = first_a[group] + within // wide, first_b[group] + within % wide
    keys = (text[group] << 32) | (ids_a[a].astype(np.int64) << 16) | ids_b[b]
    large = np.flatnonzero(links > LARGE_GROUP)
    if not len(large):
        return np.unique(keys, return_counts=True)
    found, times = [keys], [np.ones(len(keys), dtype=np.int64)]
    for g in large:
        own_a, n_a = np.unique(ids_a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        own_b, n_b = np.unique(ids_b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        pair = (own_a.astype(np.int64)[:, None] << 16) | own_b.astype(np.int64)
        found.append(((int(text[g]) << 32) | pair).ravel())
        times.append(np.multiply.outer(n_a, n_b).ravel())
    return summed(np.concatenate(found), np.concatenate(times))


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(times, starts) if len(starts) else times


@lru_cache(maxsize=1)
def _decimals() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id in decimal, followed by each of the separators."""
    return tuple(np.array([b"%d%c" % (i, c) for i in range(1 << 16)], dtype=object) for c in b",|;")


class Aligned:
    """Stretches of texts, aligned together."""

    def __init__(self, a: ByteLevel, b: Pieces, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.n_a = np.array([len(x) for x, _ in texts])
        self.n_b = np.array([len(y) for _, y in texts])
        ids_a = np.concatenate([x for x, _ in texts])
        ids_b = np.concatenate([y for _, y in texts])
        # both sides have the same bytes, so their offsets agree from text to text
        last_a, last_b = common_ends(
            np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]), self.n_a, self.n_b
        )
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        text = np.repeat(np.arange(len(texts)), self.n_a)[last_a]
        self.n_groups = np.bincount(text, minlength=len(texts))
        self.n_links = np.zeros(len(texts), dtype=np.int64)
        np.add.at(self.n_links, text, size_a * size_b)
        keys, self.times = _links(ids_a, ids_b, text, size_a, size_b)
        self.keys = (keys & 0xFFFFFFFF).astype(np.uint32)
        self.edges = np.searchsorted(keys >> 32, np.arange(len(texts) + 1))
        self.digits = self._written(ids_a, ids_b, last_a, last_b, size_a, size_b)

    @staticmethod
    def _written(ids_a, ids_b, last_a, last_b, size_a, size_b) -> np.ndarray:
        comma, bar, semicolon = _decimals()
        out = np.empty(len(ids_a) + len(ids_b), dtype=object)
        of_a, of_b = comma[ids_a], comma[ids_b]
        of_a[last_a], of_b[last_b] = bar[ids_a[last_a]], semicolon[ids_b[last_b]]
        # a group's A ids stand behind the B ids of the groups before, its B ids behind its A ids
        out[np.arange(len(ids_a)) + np.repeat(_firsts(size_b), size_a)] = of_a
        out[np.arange(len(ids_b)) + np.repeat(last_a + 1, size_b)] = of_b
        return out

    def parts(self) -> Iterator[tuple]:
        """Of each text: numbers of A, B, groups and links, groups in decimal, pairs, times."""
        at = 0
        for i in range(len(self.n_a)):
            end = at + int(self.n_a[i] + self.n_b[i])
            own = slice(self.edges[i], self.edges[i + 1])
            numbers = np.array([self.n_a[i], self.n_b[i], self.n_groups[i], self.n_links[i]])
            yield numbers, b"".join(self.digits[at:end].tolist())[:-1], self.keys[own], self.times[own]
            at = end


def stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > STRETCH:
        cut = _CUT.search(text, at + STRETCH)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Document:
    """What is known of a document after the stretches so far."""

    def __init__(self, doc_id: int | None) -> None:
        self.doc_id = doc_id
        self.numbers = np.zeros(4, dtype=np.int64)
        self.digest = None
        self.fits = True
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, numbers: np.ndarray, digits: bytes, keys: np.ndarray, times: np.ndarray) -> None:
        if self.digest is None:
            self.digest = hashlib.sha256(digits)
        else:
            self.digest.update(b";" + digits)
        self.numbers += numbers
        self.pairs.append((keys, times))
        if len(self.pairs) > 8:
            self.pairs = [self.links()]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) == 1:
            return self.pairs[0]
        keys, times = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        keys, times = summed(keys.astype(np.int64), times)
        return keys.astype(np.uint32), times


_HELD = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " links binary, keys array<long>, docs array<long>"
)
_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
    " groups_sha256 string"
)


class Blocks:
    """Finished documents as rows, and a row of pair counts at the end of each block."""

    names = [c.split()[0] for c in _HELD.split(", ")]
    types = [*[pa.int64()] * 6, pa.string(), pa.binary(), *[pa.list_(pa.int64())] * 2]

    def __init__(self) -> None:
        self.block = TaskContext.get().partitionId() << 32
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.n_pairs = self.n_docs = 0

    def add(self, doc: Document) -> None:
        numbers, digest, links = np.zeros(4, dtype=np.int64), "", None
        if doc.fits and doc.digest is not None:
            numbers, digest = doc.numbers, doc.digest.hexdigest()
            keys, times = doc.links()
            steps = np.diff(keys.astype(np.int64), prepend=0).astype("<u4")
            links = self.pack(steps.tobytes() + times.astype("<u4").tobytes())
            self.pairs.append(keys)
            self.n_pairs += len(keys)
        self.rows.append((self.block, doc.doc_id, *numbers.tolist(), digest, links, None, None))
        self.n_docs += 1
        if self.n_pairs > BLOCK_PAIRS or self.n_docs >= BLOCK_DOCS:
            self.close()

    def close(self) -> None:
        if self.pairs:
            keys, docs = np.unique(np.concatenate(self.pairs), return_counts=True)
            self.rows.append((self.block, *[None] * 7, keys.astype(np.int64), docs))
        self.block += 1
        self.pairs, self.n_pairs, self.n_docs = [], 0, 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, self.types, strict=True)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(arrays, names=self.names)


def _aligned(a_path: str, b_path: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        blocks = Blocks()
        docs: list[Document] = []
        texts: list[tuple[np.ndarray, np.ndarray]] = []
        owners: list[Document] = []
        size = 0

        def settle() -> None:
            if texts:
                for doc, part in zip(owners, Aligned(a, b, texts).parts(), strict=True):
                    if doc.fits:
                        doc.add(*part)
                texts.clear()
                owners.clear()

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc = Document(doc_id)
                docs.append(doc)
                text = value.as_py()
                if not text:
                    continue
                for part in stretches(" " + text):
                    raw = part.encode()
                    own = a.ids(part), b.ids(part, raw)
                    if own[1] is None or a.lengths[own[0]].sum() != len(raw):
                        doc.fits = False
                        break
                    texts.append(own)
                    owners.append(doc)
                    size += len(part)
                    if size >= STRETCH:
                        settle()
                        size = 0
                if not texts:
                    for done in docs:
                        blocks.add(done)
                    docs.clear()
                    yield from blocks.batches()
        settle()
        for done in docs:
            blocks.add(done)
        blocks.close()
        yield from blocks.batches()

    return align


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums of a block's documents over their links, from the counts of its pairs."""
    keys, count = counts["key"].to_numpy(), counts["count"].to_numpy()
    best = counts["best"].to_numpy()
    order = np.argsort(keys)
    keys, count, best = keys[order], count[order], best[order]
    unpack = zstandard.ZstdDecompressor().decompress
    n_best, count_sum = [], []
    for links in docs["links"].to_pylist():
        if links is None:
            n_best.append(0)
            count_sum.append(0)
            continue
        held = np.frombuffer(unpack(links), dtype="<u4").astype(np.int64)
        own, times = np.cumsum(held[: len(held) // 2]), held[len(held) // 2 :]
        at = np.searchsorted(keys, own)
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * count[at]).sum()))
    named = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    sums = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table({**named, **sums, "groups_sha256": docs["groups_sha256"]})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``key, count, best`` of each id pair; best: no pair of its A id is in more documents."""
    counts = blocks.groupBy("key").agg(F.sum("docs").alias("count"))
    counts = counts.withColumn("a", F.shiftright("key", 16))
    highest = counts.groupBy(F.col("a").alias("_a")).agg(F.max("count").alias("highest"))
    joined = counts.join(highest, F.col("a") == F.col("_a"))
    return joined.select("key", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document: tokens, groups, links, and the sums of pair counts over its links."""
    scratch = Scratch(docs.sparkSession, "alignment")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(_aligned(a_path or path_of(A_FILE), b_path or path_of(B_FILE)), _HELD)
    held = scratch.write(found, "blocks")
    blocks = held.where(F.col("keys").isNotNull()).select(
        "block", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("docs").alias("docs")))
    )
    counts = scratch.write(pair_counts(blocks), "counts")
    known = blocks.select(F.col("block"), "key").join(counts, "key").select("block", "key", "count", "best")
    rows = held.where(F.col("keys").isNull()).withColumn("home", F.col("block") + 0).drop("block", "keys", "docs")
    return rows.groupBy("home").cogroup(known.groupBy("block")).applyInArrow(_scored, _RESULT)
