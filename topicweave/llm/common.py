"""Helpers the corpus operators share: row keys, gapless numbering, partition counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as a character class of Java and of RE2.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, mb_each: int = 128) -> int:
    """Partitions for moving ``df`` whole: the session's number, or more where the
    input files are so large that a partition would pass ``mb_each``. Rows that come from
    no file have no size that Spark knows (it then assumes the largest number).
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = estimate if estimate < 1 << 60 else 0
    return max(shuffle_partitions(df.sparkSession), min(100_000, known // (mb_each << 20)))


def sealed(docs: DataFrame, used: Sequence[str], results: Sequence[str] = ()):
    """``docs`` with columns other than ``used`` under names no step uses, those names, and
    the names to give back. A column named like a result is left out: the result takes its place.
    """
    docs = docs.drop(*results)
    names = [c if c in used else f"_extra{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names, docs.columns


def row_key(*columns: str | Column) -> list[Column]:
    """Two hashes of the whole row. Rows that agree in every column share the key."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return [
        F.xxhash64(*cols).alias("_key_a"),
        F.xxhash64(F.lit(1), *cols).alias("_key_b"),
    ]


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equality of columns, nulls being equal."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def numbered(
    narrow: DataFrame, order: Sequence[Column], scratch, name: str, within: Sequence[str] = ()
) -> DataFrame:
    """Add ``row``: the place of each row in the given order, gapless from 0, counted
    per group of ``within``.

    ``narrow`` is dealt out by ranges of (group, order), so a group of any size is spread
    over many tasks; a row's place in its partition comes from the sorted partition itself
    and the partitions' counts (one row per group and partition) give the starts. The
    placed rows are written first: a lost executor can't shuffle the numbers anew.
    """
    spark = narrow.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in within] + list(order)
    placed = scratch.write(
        narrow.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        name,
    ).withColumn("_part", F.shiftright("_at", 33))
    groups = [*within, "_part"]
    so_far = Window.partitionBy(*within).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        placed.groupBy(*groups)
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(so_far), F.lit(0)))
        .select(*[F.col(c).alias(f"_s{c}") for c in groups], "_first", "_before")
    )
    if not within:
        starts = F.broadcast(starts)  # one row per partition
    on = reduce(
        lambda a, b: a & b, [placed[c].eqNullSafe(starts[f"_s{c}"]) for c in groups]
    )
    return (
        placed.join(starts, on)
        .withColumn("row", F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_at", "_part", "_first", "_before", *[f"_s{c}" for c in groups])
    )
