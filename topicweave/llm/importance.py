"""Quality by importance resampling over hashed n-grams.

Words and word pairs of a text fall into ``BUCKETS`` buckets by hash. Two generative models
give each bucket a probability: one from target text (documents labelled of good quality), one
from the raw corpus (all documents). The log importance weight of a text is the sum over its
n-grams of log p(target) - log p(raw). Documents are drawn without replacement by the Gumbel
top-k trick: the k largest values of tempered weight plus Gumbel noise. The noise is hashed from the
text, so a rerun draws the same documents and equal texts share their fate.

k is what the corpus supports: the number of documents whose mean weight reaches the level
that separates good from bad labelled rows best. Raw counts and k come from all documents. Labels enter as a bounded
sample: at most ``SAMPLE`` rows of either quality, those whose ids hash lowest.

A null text, or one without words, has no n-grams and is never drawn. Without labels of good
quality the target equals the raw model; without labels of bad quality all documents with words
are drawn. Repeated rows are drawn together; ties at the k-th place are all drawn. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.llm import hashing
from topicweave.llm.common import numbered, sealed
from topicweave.session import Scratch

BUCKETS = 10_000
SAMPLE = 20_000
#: Smoothing: n-grams added to each bucket of either model.
ADDED = 1.0
#: A weight counts as a mean over the text's n-grams and so many neutral ones, so that long
#: texts aren't judged by their length nor short ones by a few words; the sharpness (inverse
#: temperature) sets it against the Gumbel noise.
NEUTRAL, SHARPNESS = 50.0, 500.0


def features(data: np.ndarray) -> np.ndarray:
    """Buckets of the words and word pairs of one text, given as UTF-8 bytes; A-Z lower-cased."""
    own = hashing.words(data)
    pairs = hashing.runs(own, 2) if len(own) > 1 else own[:0]
    return (np.concatenate([own, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class ImportanceModel:
    ratios: np.ndarray  # log p(target) - log p(raw) per bucket
    level: float  # mean weight that separates good from bad labelled rows


def _counts(docs: DataFrame, flags: list[str]) -> pd.DataFrame:
    """Sums over documents of n-grams per bucket: for all documents and for each flag.

    A task sends its sums once, so 10,000 rows per task are added up, whatever the input.
    """
    names = ["raw", *flags]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(names), BUCKETS), dtype=np.int64)
        for batch in batches:
            marks = [batch.column(i + 1).to_pylist() for i in range(len(flags))]
            for r, data in enumerate(hashing.texts(batch.column(0))):
                own = np.bincount(features(data), minlength=BUCKETS)
                held[0] += own
                for i, mark in enumerate(marks):
                    if mark[r]:
                        held[i + 1] += own
        buckets = np.flatnonzero(held[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets), *[pa.array(h[buckets]) for h in held]], names=["bucket", *names]
        )

    schema = "bucket long, " + ", ".join(f"{n} long" for n in names)
    body = docs.select(F.col("text").cast("binary").alias("text"), *flags)
    sums = body.mapInArrow(work, schema).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    return sums.toPandas().set_index("bucket").reindex(range(BUCKETS), fill_value=0)


def _weights(docs: DataFrame, ratios: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``n_grams`` and ``log_weight``. Moves no rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, w = [], []
            for data in hashing.texts(batch.column(len(keep))):
                own = features(data)
                n.append(len(own))
                w.append(float(np.round(ratios[own].sum(), 9)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(w, pa.float64())],
                names=[*keep, "n_grams", "log_weight"],
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keep], "n_grams long", "log_weight double"])
    return docs.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(work, schema)


def best_level(good: np.ndarray, bad: np.ndarray) -> float:
    """The level with the fewest errors, a lost good row counting five times a kept bad one."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.concatenate([good, bad])
    cost = np.concatenate([np.full(len(good), 5.0), np.full(len(bad), -1.0)])
    order = np.argsort(values)
    # Rows below the level are rejected: good ones cost, bad ones gain.
    total = np.concatenate([[0.0], np.cumsum(cost[order])])
    at = int(total.argmin())
    levels = np.concatenate([[-np.inf], (values[order][1:] + values[order][:-1]) / 2, [np.inf]])
    return float(levels[at])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ImportanceModel:
    usable = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.max("quality").alias("_quality")
    )
    order = F.xxhash64("doc_id")
    drawn = [
        usable.where(F.col("_quality") == k).orderBy(order, "doc_id").limit(sample) for k in (1, 0)
    ]
    chosen = drawn[0].unionByName(drawn[1]).withColumnRenamed("doc_id", "_label_id")
    ids = F.broadcast(chosen)  # 2 x sample rows at most
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_label_id"), "left")
    counts = _counts(marked.withColumn("target", F.coalesce(F.col("_quality") == 1, F.lit(False))), ["target"])
    raw, target = (counts[n].to_numpy() + ADDED for n in ("raw", "target"))
    if not counts["target"].any():
        target = raw
    ratios = np.log(target / target.sum()) - np.log(raw / raw.sum())
    labelled = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_label_id"))
    seen = _weights(labelled.select("_quality", "text"), ratios, ["_quality"]).where("n_grams > 0")
    rows = seen.select("_quality", mean_weight(F.col("log_weight"), F.col("n_grams")).alias("w")).toPandas()
    good, bad = (rows.loc[rows["_quality"] == k, "w"].to_numpy() for k in (1, 0))
    return ImportanceModel(ratios, best_level(good, bad))


def mean_weight(log_weight: Column, n_grams: Column) -> Column:
    return log_weight / (n_grams + F.lit(NEUTRAL))


def gumbel(text_hash: Column) -> Column:
    """Standard Gumbel noise from 53 bits of a hash."""
    u = (F.shiftrightunsigned(text_hash, 11).cast("double") + 0.5) / F.lit(2.0**53)
    return -F.log(-F.log(u))


def _key(log_weight: str, n_grams: str, text_hash: Column) -> Column:
    return mean_weight(F.col(log_weight), F.col(n_grams)) * SHARPNESS + gumbel(text_hash)


def draw(docs: DataFrame, model: ImportanceModel, seed: int = 11) -> tuple[DataFrame, float, int]:
    """``doc_id, n_grams, log_weight, key, drawn`` of every document, the key of the k-th
    place, and k."""
    scratch = Scratch(docs.sparkSession, "importance")
    rows = docs.select("doc_id", F.xxhash64(F.lit(seed), F.col("text")).alias("_hash"), "text")
    scored = _weights(rows, model.ratios, ["doc_id", "_hash"])
    scored = scratch.write(scored.withColumn("key", _key("log_weight", "n_grams", F.col("_hash"))), "keys")
    able = scored.where("n_grams > 0")
    k = able.where(
        mean_weight(F.col("log_weight"), F.col("n_grams")) >= F.lit(float(model.level))
    ).count()
    last = float("inf")
    if k:
        placed = numbered(able.select("key", "doc_id"), [F.col("key").desc(), F.col("doc_id")], scratch, "order")
        last = placed.where(F.col("row") == k - 1).first()["key"]
    drawn = scored.select(
        "doc_id", "n_grams", "log_weight", "key",
        ((F.col("n_grams") > 0) & (F.col("key") >= F.lit(last))).alias("drawn"),
    )
    return drawn, last, k


def keep_drawn(docs: DataFrame, model: ImportanceModel, last: float, seed: int = 11) -> DataFrame:
    """Rows of ``docs`` whose key reaches the k-th: scores anew instead of joining texts."""
    ratios = model.ratios

    @F.pandas_udf("n_grams long, log_weight double")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        own = [features(np.frombuffer(t or b"", dtype=np.uint8)) for t in texts]
        return pd.DataFrame(
            {"n_grams": [len(o) for o in own],
             "log_weight": [float(np.round(ratios[o].sum(), 9)) for o in own]}
        )

    docs, names, columns = sealed(docs, ["text"])
    weighed = docs.withColumn("_w", weigh(F.col("text").cast("binary")))
    key = _key("_w.log_weight", "_w.n_grams", F.xxhash64(F.lit(seed), F.col("text")))
    return weighed.where((F.col("_w.n_grams") > 0) & (key >= F.lit(last))).select(*names).toDF(*columns)
