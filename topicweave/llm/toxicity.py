"""Toxicity by compression distance.

Two zstandard dictionaries are learned, on toxic and on ordinary labelled text. A text's
windows of ``WINDOW_WORDS`` words are compressed with either one; a window is toxic to the
degree that the toxic dictionary makes it shorter. Both dictionaries end with the same ordinary
content (from zstandard's trainer), so windows of ordinary words cost the same with either; in
front of it stand, of the same length, toxic segments (all that are found) or more ordinary ones. They
are chosen as a cover trainer does, by the character grams they cover, grams weighing as much
as they are commoner in toxic documents. Thresholds are calibrated on labelled rows that the
dictionaries have not seen: a logistic fit over the largest gain of a window, the share and
the number of windows that gain.

Learning uses a bounded sample: at most ``SAMPLE`` labels of a class, those whose ids hash
lowest, and of their rows (ids may repeat) at most four times as many, with texts up to
``SAMPLE_CHARS``; these teach whole. Scoring takes whole texts; a stretch without white space
is cut into windows of ``LONGEST`` characters.

A null or empty text scores as a text without gains. A label that is null or belongs to no
document teaches nothing. If a class has no row in the sample, all scores are the share of
toxic rows (0 without any). Repeated rows score alike; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 2500
SAMPLE_CHARS = 20_000
WINDOW_WORDS = 10
LONGEST = 512
GRAM = 5
#: A gram counts as toxic if it is so many times commoner in toxic rows than in ordinary rows,
#: and its likelihood ratio against what these let expect is at least so much (Poisson). Wrong
#: labels give toxic words a background among ordinary rows.
GRAM_LIFT, GRAM_RATIO = 4.0, 30.0
COMMON_BYTES = 4096
CUT = 0.7


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    if any(len(w) > LONGEST for w in words):
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return [
        (" " + " ".join(words[i : i + WINDOW_WORDS]) + " ").encode("utf-8", "surrogatepass")
        for i in range(0, len(words), WINDOW_WORDS)
    ]


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


def _gram_rows(texts: list[str]) -> Counter:
    rows: Counter = Counter()
    for text in texts:
        rows.update({g for w in set(text.lower().split()) for g in _grams(w)})
    return rows


def toxic_grams(toxic: list[str], ordinary: list[str]) -> tuple[set[str], Counter]:
    """Grams significantly commoner in toxic rows, and the toxic rows that hold each gram."""
    in_toxic, in_ordinary = _gram_rows(toxic), _gram_rows(ordinary)
    marks = set()
    for gram, n in in_toxic.items():
        expected = len(toxic) * (in_ordinary[gram] + 1) / max(1, len(ordinary))
        ratio = 2 * (n * np.log(n / expected) - n + expected)
        if n >= GRAM_LIFT * expected and ratio >= GRAM_RATIO:
            marks.add(gram)
    return marks, in_toxic


def toxic_segments(toxic: list[str], marks: set[str], in_toxic: Counter) -> bytes:
    """Segments of toxic text, the commonest last, each covering a toxic gram anew; all of them."""
    segments: Counter = Counter()
    for text in toxic:
        found = set()
        for word in set(text.lower().split()):
            padded, hit = f" {word} ", [False] * (len(word) + 2)
            for i, g in enumerate(_grams(word)):
                if g in marks:
                    hit[i : i + GRAM] = [True] * GRAM
            found.update(
                s for s in "".join(c if h else "\0" for c, h in zip(padded, hit, strict=True)).split("\0") if s
            )
        segments.update(found)
    chosen, covered = [], set()
    for segment, _ in sorted(segments.items(), key=lambda s: (-s[1], s[0])):
        own = [segment[i : i + GRAM] for i in range(len(segment) - GRAM + 1)]
        best = max(own, key=lambda g: (in_toxic[g], g))
        if best in covered:
            continue
        chosen.append(segment.encode("utf-8", "surrogatepass"))
        covered.update(own)
    return b"".join(reversed(chosen))


def _trained(samples: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:  # too few samples to train on: the samples themselves
        return b"".join(samples)[-size:]


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    prior: float
    weights: tuple[float, ...] | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    @cached_property
    def compressors(self) -> list:
        import zstandard

        parameters = zstandard.ZstdCompressionParameters.from_level(
            6, source_size=64, dict_size=len(self.toxic), min_match=4,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        return [
            zstandard.ZstdCompressor(
                compression_params=parameters,
                dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for d in (self.toxic, self.ordinary)
        ]

    def gains(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves against the ordinary one, per window."""
        toxic, ordinary = (c.compress for c in self.compressors)
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], dtype=float)

    def features(self, text: str) -> np.ndarray:
        gains = self.gains(text)
        if not len(gains):
            return np.zeros(5)
        top = np.sort(gains)[-2:]
        many = (gains >= 3).sum()
        return np.array(
            [min(gains.max(), 12.0), top.mean() if len(top) > 1 else top[0] / 2,
             (gains >= 3).mean(), np.log1p(many), np.log1p(len(gains))]
        )

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.prior
        x = np.append(self.features(text), 1.0) @ np.array(self.weights)
        return float(1.0 / (1.0 + np.exp(-np.clip(x, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps of a ridge logistic fit; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def fit(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    prior = len(toxic) / max(1, len(toxic) + len(ordinary))
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", prior)
    # Odd rows calibrate, even rows teach; a class of one row does both.
    teach = [texts[::2] for texts in (toxic, ordinary)]
    check = [texts[1::2] or texts for texts in (toxic, ordinary)]
    marks, in_toxic = toxic_grams(*teach)
    front = toxic_segments(teach[0], marks, in_toxic)
    # Toxic words of wrongly labelled rows must not enter what both dictionaries share.
    clean = [
        " ".join(w for w in text.lower().split() if marks.isdisjoint(_grams(w))) for text in teach[1]
    ]
    lines = [w for text in clean for w in windows(text)] or [b" "]
    common = _trained(lines[::2], COMMON_BYTES)
    # b" " keeps both dictionaries long enough for the library to take them
    pad = b" " * 16
    rest = _trained(lines[1::2] or lines, max(256, len(front)))[: len(front)].ljust(len(front))
    model = ToxicityModel(pad + front + common, pad + rest + common, prior)
    x = np.array([model.features(t) for texts in check for t in texts])
    y = np.repeat([1.0, 0.0], [len(c) for c in check])
    model.weights = tuple(logistic(x, y))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn from labelled rows that are not held out."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").alias("_label_id"), "toxic", F.xxhash64("doc_id").alias("_order")
    )
    drawn = [
        usable.where(F.col("toxic") == k).orderBy("_order", "_label_id").limit(sample) for k in (1, 0)
    ]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 x sample rows at most
    rows = (
        docs.select("doc_id", "text")
        .where(F.length("text").between(1, SAMPLE_CHARS))
        .join(ids, F.col("doc_id") == F.col("_label_id"))
        .select("_order", "doc_id", "toxic", "text")
        .orderBy("_order", "doc_id", "text")
        .limit(4 * sample)
        .collect()
    )
    return fit([r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document. Moves no rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"
    )
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= CUT).cast("int")
    )
