"""Token ids by the public word-end BPE, with each distinct word encoded once per worker.

White space only separates words for this tokenizer, so the ids of a text are the ids of its
white-space separated chunks in order. A text of printable ASCII and Latin-1 letters is split
into lower-cased pieces (words, digits, runs of signs), which go straight to the BPE model. Any
other text is taken by chunks, and those with other characters go through the whole tokenizer.
Files with other settings encode each text whole.
A worker keeps the ids of short pieces and chunks, so many at most: its store is bounded in bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

DEFAULT_FILE = "word_bpe_49k.json"
#: Distinct pieces, and chunks, kept by a worker; a full store is emptied and fills again.
KEPT_WORDS = 400_000
#: Longer ones are not kept.
KEPT_LENGTH = 64
#: Texts are split at white space into stretches of about so many characters.
STRETCH = 1 << 20

# The settings of the file that the shortcuts are made for.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# The characters the shortcut handles, and the file's own splitting pattern.
_PLAIN = re.compile(r"[ \t\n\r!-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\ra-z0-9ß-öø-ÿ]+")
_GAP = re.compile(r"[ \t\n\r]")
_ODD = re.compile(r"[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _byte_letters() -> dict[int, str]:
    """How the byte-level alphabet writes the Latin-1 letters: bytes that print stand for
    themselves, the others for code points from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printing]
    letter = {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {
        c: "".join(letter[b] for b in chr(c).encode("utf-8")) for c in range(0xC0, 0x100)
    }


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings are ordinary text
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        # other files' texts go through the tokenizer whole
        self.shortcut = held["normalizer"] == _NORMALIZER and held["pre_tokenizer"] == _SPLITTER
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(letters)])

    def _plain(self, text: str) -> bytes:
        return self._joined(_PIECES.findall(text.lower()), self.pieces, self._piece)

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            return self._plain(chunk)
        return _packed(self.whole.encode(chunk, add_special_tokens=False).ids)

    @staticmethod
    def _joined(words: list[str], known: dict[str, bytes], ids_of: Callable[[str], bytes]) -> bytes:
        """Ids of all words in order; those that are not known yet are encoded once."""
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            new = set(words).difference(known)
        known.update((w, ids_of(w)) for w in new)
        found = b"".join([known[w] for w in words])
        for w in new:
            if len(w) > KEPT_LENGTH:
                del known[w]
        if len(known) > KEPT_WORDS:
            known.clear()
        return found

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of the stretches of a text, as little-endian 32-bit numbers."""
        if not self.shortcut:
            yield _packed(self.whole.encode(text, add_special_tokens=False).ids)
            return
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > STRETCH:
                gap = _GAP.search(text, at + STRETCH)
                end = gap.start() if gap else end
            part = text[at:end] if at or end < len(text) else text
            if _PLAIN.fullmatch(part):
                yield self._plain(part)
            else:
                chunks = [c for c in _GAP.split(part) if c] if _ODD.search(part) else part.split()
                yield self._joined(chunks, self.chunks, self._chunk)
            at = end


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process."""
    return WordTokenizer(path)
