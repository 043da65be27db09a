"""Factor tables: start values, column sums, normalisation and floors."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions.vectors import UNROLL, build

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: float32 machine epsilon, the floor of P(w|z) and P(d|z).
EPSILON = 1.1920928955078125e-07
# Fixed value: floor of query topics and of NMF factors.
TINY = 1e-12


def seed_vector(prefix: str, key: Column, k: int) -> Column:
    """K reproducible uniform values in (0, 1] for a key, from its MD5 digest.

    One digest gives four values: eight hexadecimal digits each. A null key has null values.
    Beyond one digest (an eighth of ``UNROLL``) numbers are read from it as bytes, in batches:
    ``conv`` costs more than the digest.
    """
    if k > UNROLL // 8:
        return _seeds(prefix, k)(key.cast("string"))
    digests = [
        F.md5(F.concat(F.lit(prefix), key.cast("string"), F.lit(f":{g}")))
        for g in range((k + 3) // 4)
    ]
    values = [
        (F.conv(F.substring(digests[z // 4], 1 + 8 * (z % 4), 8), 16, 10).cast("double") + 1)
        / 4294967296.0
        for z in range(k)
    ]
    return F.array(*values)


def seed_rows(prefix: str, k: int) -> Callable[[pa.Array], np.ndarray]:
    """A function from keys (strings) to the values of :func:`seed_vector`, a row per key: each
    digest is taken once."""
    start = prefix.encode()
    groups = [f":{g}".encode() for g in range((k + 3) // 4)]

    def seeds(keys: pa.Array) -> np.ndarray:
        rows = []
        for key in keys.to_pylist():
            own = start + (key or "").encode()
            rows.append(b"".join([md5(own + g, usedforsecurity=False).digest() for g in groups]))
        values = np.frombuffer(b"".join(rows), dtype=">u4").reshape(len(rows), 4 * len(groups))[:, :k]
        return (values + 1.0) / 4294967296.0

    return seeds


def _seeds(prefix: str, k: int):
    """:func:`seed_vector` on batches of keys."""
    rows_of = seed_rows(prefix, k)

    def seeds(keys: pa.Array) -> pa.Array:
        missing = np.repeat(np.asarray(keys.is_null()), k) if keys.null_count else None
        flat = pa.array(rows_of(keys).ravel(), mask=missing)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * k), flat)

    return F.arrow_udf(seeds, "array<double>")


def seed_mass(rows: DataFrame, key: str, prefix: str, k: int) -> list[float]:
    """The column sums of the seeds of all keys; the seeds go nowhere."""
    rows_of = seed_rows(prefix, k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += rows_of(batch.column(0).drop_null()).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["t"])

    parts = rows.select(F.col(key).cast("string")).mapInArrow(partial, "t array<double>")
    sums = parts.select(F.posexplode("t").alias("z", "t")).groupBy("z").agg(F.sum("t").alias("t")).collect()
    return [r["t"] for r in sorted(sums, key=lambda r: r["z"])]  # K rows


def shares(mass: list[float], floor: float) -> Callable[[np.ndarray], np.ndarray]:
    """:func:`normalised` on a matrix of rows."""
    by = np.array(mass)

    def run(s: np.ndarray) -> np.ndarray:
        return np.maximum(np.divide(s, by, out=np.zeros_like(s), where=by > 0), floor)

    return run


def seed_topics(spark, k: int, prefix: str = "z") -> list[float]:
    """Normalised start values of P(z)."""
    row = spark.range(1).select(seed_vector(prefix, F.lit(""), k).alias("u")).first()
    return [u / sum(row["u"]) for u in row["u"]]


def normalised(
    factor: DataFrame, key: str, mass: Column, k: int, floor: float, out: str = "p"
) -> DataFrame:
    """``max(s[z] / mass[z], floor)``; a topic without mass stays at the floor."""
    shares = build(
        k, lambda z: f"greatest(IF(m[{z}] > 0, s[{z}] / m[{z}], 0D), {floor!r}D)"
    )
    return factor.withColumn("m", mass).select(key, shares.alias(out))


def as_long(factor: DataFrame, key: str) -> DataFrame:
    """``(key, z, p)``: one row per topic."""
    return factor.select(key, F.posexplode("p").alias("z", "p"))


def as_arrays(long: DataFrame, key: str) -> DataFrame:
    """Inverse of :func:`as_long`; K values per key."""
    pairs = F.array_sort(F.collect_list(F.struct("z", "p")))
    return long.groupBy(key).agg(F.transform(pairs, lambda x: x["p"]).alias("p"))
