"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share a
budget of words; a target stops at ``cap`` times its source's words, and what is above is
shared again by weight until none is above. Every document of a source expects
``rate = target / source_size`` copies. Within its source the documents are put in order of
size, the expected copies are summed up in that order, one random offset in [0, 1) is added,
and a document is emitted once per integer boundary its stretch crosses. In order of size
the words taken stray from the target by one document at most.

Null or empty text: size 0, it takes no words. A source without words has target 0 and rate
0. Rows that agree in every column are separate documents and interchangeable. An empty
table gives no rows. Extra columns are carried by :func:`emit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.llm.common import WORD, numbered, row_key
from topicweave.session import Scratch

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, scratch: Scratch, weights: tuple[int, ...], budget: float, cap: float
) -> DataFrame:
    """``source, source_rank, source_size, target`` from ``source, source_size``.

    The level of the shares is raised until no source is newly above its cap; each step is
    one sum over the table of sources and sends three numbers to the driver.
    """
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], scratch, "sources")
    cases = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("row") % len(weights) + 1).cast("int")
    )
    table = ranked.select(
        "source",
        F.col("row").alias("source_rank"),
        "source_size",
        cases.cast("double").alias("weight"),
        (F.col("source_size") * cap).alias("most"),
    )
    table = scratch.write(table, "weighted")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    left, rest, seen = budget * total, None, -1
    while True:
        # Before the first step nothing is capped.
        above = F.lit(False) if rest is None else (F.col("most") < left * F.col("weight") / rest)
        n, capped, shared = table.agg(
            F.count(F.when(above, 1)),
            F.sum(F.when(above, F.col("most"))),
            F.sum(F.when(~above, F.col("weight"))),
        ).first()
        if n == seen or not shared:
            break
        left, rest, seen = budget * total - (capped or 0.0), shared, n
    share = F.lit(left) * F.col("weight") / F.lit(rest or 1.0)
    return table.select(
        "source",
        "source_rank",
        "source_size",
        F.when(F.col("most") < share, F.col("most")).otherwise(share).alias("target"),
    )


def whole_row(docs: DataFrame) -> list[Column]:
    return row_key(*[F.col(f"`{c}`") for c in docs.columns])


def plan_copies(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` and the row key, per document."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *whole_row(docs)),
        "sizes",
    )
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch.write(source_targets(sources, scratch, weights, budget, cap), "targets")
    order = [
        F.col("size").asc(), F.col("doc_id").asc_nulls_last(), F.col("_key_a"), F.col("_key_b"),
    ]
    placed = numbered(sizes, order, scratch, "placed", within=["source"])
    offset = (
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source_rank"))), 1, 8), 16, 10)
        .cast("double") / F.lit(2.0**32)
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.select(
        F.col("source").alias("_source"), "source_size", "target",
        offset.alias("_u"), F.floor(rate).alias("_whole"), (rate - F.floor(rate)).alias("_part"),
    )
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["_source"]))
    crossed = F.floor(F.col("_part") * (F.col("row") + 1) + F.col("_u")) - F.floor(
        F.col("_part") * F.col("row") + F.col("_u")
    )
    return joined.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_whole") + crossed).cast("long").alias("copies"), "_key_a", "_key_b",
    )


def emit(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the plan made from it says."""
    columns = docs.columns
    names = [f"_extra{i}" for i in range(len(columns))]
    times = (
        plan.groupBy("_key_a", "_key_b")
        .agg(F.sum("copies").alias("_times"))
        .where("_times > 0")
    )
    keyed = docs.toDF(*names).select(*names, *row_key(*names)).dropDuplicates(["_key_a", "_key_b"])
    return (
        keyed.join(times, ["_key_a", "_key_b"])
        .withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(*names)
        .toDF(*columns)
    )
