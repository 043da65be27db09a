"""Cleaned and counted words of whole texts, with every distinct word cleaned once per task.

The rules of :mod:`text` look at one white-space word only, and most words of a corpus were seen
before. So texts are split into white-space words by Arrow, each distinct one of a piece goes
through the rules if it is new, and its tokens are counted as numbers. A text with a character whose class or small letter depends on the version of Unicode gets
null here; :func:`counted_words` leaves it to the Column expressions.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from topicweave.functions.text import MERGED_WORDS, SHORT_LINK_PREFIX, TOKEN_RULES, clean_text
from topicweave.functions.wordlists import EMOTICONS, PUNCTUATION, cleaning_stop_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STOP_WORDS = frozenset(cleaning_stop_words())
#: Words whose counted tokens a task remembers, at most about, and their bytes.
KNOWN_WORDS = 1_000_000
KNOWN_BYTES = 64_000_000
#: Bytes of the texts that are split and counted at once (or one text).
PIECE_BYTES = 8_000_000
# Letters and marks of the usual case, the same in all versions of Unicode.
COMMON = "[\x21-\x7e\xa1-\u012f\u0131-\u0220\u2010-\u2027\u2030-\u2046]+"


def _python_rule(pattern: str, replacement: str) -> tuple[str, int, str]:
    """The same rule for Python's ``re``: its ``\\w`` is ``[\\p{L}\\p{N}_]``."""
    flags = 0
    if pattern.startswith("(?i)"):
        pattern, flags = pattern[4:], re.IGNORECASE | re.ASCII
    return pattern.replace(r"\p{L}\p{N}_", r"\w"), flags, re.sub(r"\$(\d)", r"\\g<\1>", replacement)


def _settled(word: str) -> bool:
    """Whether all versions of Unicode agree on what each character is."""
    if word.isascii():
        return True
    for c in word:
        now, before = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
        if now == "Cn" or (now[0] in "LN") != (before[0] in "LN") or c in "\u0130\u03a3":
            return False
    return True


class _Known:
    """Words with the number of their tokens (-1: the word isn't settled), where these begin in
    ``places``, and there each one's place among ``tokens``."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.words = self.tokens = pa.array([], pa.string())
        self.sizes = self.first = self.places = np.zeros(0, dtype=np.int64)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.tokens.nbytes

    def add(self, words: pa.Array, tokens: pa.Array, sizes: list[int], places: list[int]) -> None:
        new = np.array(sizes, dtype=np.int64)
        own = np.maximum(new, 0)
        self.words = pa.concat_arrays([self.words, words.cast(pa.string())])
        self.tokens = pa.concat_arrays([self.tokens, tokens])
        self.sizes = np.append(self.sizes, new)
        self.first = np.append(self.first, len(self.places) + np.cumsum(own) - own)
        self.places = np.append(self.places, np.array(places, dtype=np.int64))


def _counter():
    """A function from an array of texts to lists of ``(word, n)``; it remembers words between batches."""
    rules = [(re.compile(p, f), r) for p, f, r in (_python_rule(*rule) for rule in TOKEN_RULES)]
    stop, merged, emoticons = STOP_WORDS, set(MERGED_WORDS), set(EMOTICONS)
    whole = {w for w in stop if w.isalpha() and w not in merged}
    plain, counted, common = re.compile(r"\w+"), re.compile(r"\w{2,}"), re.compile(COMMON)
    known, named = _Known(), {}

    def kept(part: str) -> bool:
        return not (
            part.lower() in stop or part in emoticons or part in PUNCTUATION or part.startswith(SHORT_LINK_PREFIX)
        )

    def tokens(word: str) -> tuple[str, ...] | None:
        """A word's counted tokens, or None if the word isn't settled."""
        # a closing comma or full stop alone goes away
        stem = word[:-1] if word[-1] in ".," else word
        small = stem.lower()
        if stem.isascii() and stem.isalnum() and small not in merged:
            return (small,) if len(small) > 1 and kept(stem) else ()
        if not common.fullmatch(word) and not _settled(word):
            return None
        if word.lower() in whole:
            return ()
        if plain.fullmatch(stem) and small not in merged:
            return (small,) if len(small) > 1 and kept(stem) else ()
        padded = f" {word} "
        for pattern, replacement in rules:
            padded = pattern.sub(replacement, padded)
        parts = [p for p in padded.split(" ") if p and kept(p)]
        return tuple(t for p in parts for t in counted.findall(p.lower()))

    def learnt(words: pa.Array) -> None:
        sizes, places, before = [], [], len(named)
        for word in words.to_pylist():
            parts = tokens(word) if word else ()
            sizes.append(-1 if parts is None else len(parts))
            places.extend([named.setdefault(part, len(named)) for part in parts or ()])
        new = list(named)[before:] if len(named) > before else []
        known.add(words, pa.array(new, pa.string()), sizes, places)

    def count_some(texts: pa.Array) -> pa.Array:
        split = pc.utf8_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        word = found.indices.to_numpy()
        row = np.repeat(np.arange(len(texts)), np.asarray(split.value_lengths()))
        if len(known.words) > KNOWN_WORDS or known.nbytes > KNOWN_BYTES:
            known.clear()
            named.clear()
        at = pc.index_in(found.dictionary, value_set=known.words)
        if at.null_count:
            learnt(found.dictionary.filter(at.is_null()))
            at = pc.index_in(found.dictionary, value_set=known.words)
        word = at.to_numpy()[word]
        times = known.sizes[word]
        left = np.zeros(len(texts), dtype=bool)
        left[row[times < 0]] = True
        usual = (times > 0) & ~left[row]
        row, word, times = row[usual], word[usual], times[usual]
        if times.max(initial=1) > 1:  # the tokens of every occurrence, one after the other
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, first = np.repeat(row, times), np.repeat(known.first[word], times) + within
        else:
            first = known.first[word]
        width = max(1, len(known.tokens))
        pairs, n = np.unique(row * width + known.places[first], return_counts=True)
        row, token = np.divmod(pairs, width)
        cells = pa.StructArray.from_arrays(
            [known.tokens.take(pa.array(token)), pa.array(n.astype(np.float64))], ["word", "n"]
        )
        ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(left, False)), cells)

    def count(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return count_some(pa.array([], pa.string()))
        texts = pc.fill_null(texts, "")
        piece = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64) // PIECE_BYTES
        cuts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True])
        return pa.concat_arrays([count_some(texts.slice(at, end - at)) for at, end in zip(cuts[:-1], cuts[1:])])

    return count


def counted_words(text: Column) -> Column:
    """Array of ``(word, n)`` of a text once it is cleaned: ``word_counts(clean_text(text))``."""
    from topicweave.operators.counts import word_counts

    state: list = []

    def count(texts: pa.Array) -> pa.Array:
        if not state:
            state.append(_counter())
        return state[0](texts)

    fast = F.arrow_udf(count, "array<struct<word:string,n:double>>")
    return F.coalesce(fast(text), word_counts(clean_text(text)))
