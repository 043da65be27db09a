"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Row numbers 0..N-1 (ascending ``doc_id``, nulls last, equal ids by text hash) go through
a keyed Feistel network over the smallest even number of bits that holds N. A result of N
or more goes through it again (cycle walking), which keeps the map a permutation of 0..N-1.
Position p lies in shard ``p mod shards`` at slot ``p div shards``: shard sizes differ by
one row at most, slots have no gaps, and both follow from the row number alone.

Null text: size 8 and the checksum of no bytes. Rows that agree in id and text are
interchangeable. An empty table has no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.common import numbered
from topicweave.session import Scratch

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _keys(seed: int) -> list[int]:
    rng = np.random.default_rng(seed)
    return [int(k) for k in rng.integers(0, 1 << 63, ROUNDS)]


def permute(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Positions of row numbers in the shuffled order of ``n`` rows, or the way back."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = rows.astype(np.uint64)
    todo = np.arange(len(out))
    keys = _keys(seed)
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> bits, out[todo] & mask
            for key in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (_mix(left, key) & mask), left
                else:
                    left, right = right, left ^ (_mix(right, key) & mask)
            out[todo] = (left << bits) | right
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def shard(docs: DataFrame, shards: int = 24, seed: int = 20240229) -> DataFrame:
    """``doc_id, size, text_crc32, row, n_rows, shard, slot`` of every document."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64("text").alias("_tie"),
    )
    scratch = Scratch(docs.sparkSession, "shard")
    narrow = scratch.write(narrow, "narrow")
    n = narrow.count()

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    rows = numbered(narrow, [F.col("doc_id").asc_nulls_last(), F.col("_tie").asc()], scratch, "rows")
    placed = rows.withColumn("position", position("row"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "row",
        F.lit(n).cast("long").alias("n_rows"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
    )


def locate(row: int, n_rows: int, shards: int = 24, seed: int = 20240229) -> tuple[int, int]:
    """Shard and slot of a row number, without any data."""
    at = int(permute(np.array([row]), n_rows, seed)[0])
    return at % shards, at // shards


def row_at(shard_no: int, slot: int, n_rows: int, shards: int = 24, seed: int = 20240229) -> int:
    """The row number at a shard's slot."""
    return int(permute(np.array([slot * shards + shard_no]), n_rows, seed, inverse=True)[0])
