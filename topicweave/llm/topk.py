"""Exact top-k search by integer inner product: exhaustive, one term at a time.

A vector component becomes the integer ``floor(scale * x)``; a component's place is a term, its
integer a weight, zeros are absent. Candidates are taken in blocks: a block's postings list, per
term, the rows that hold it with their weights. A query is a sparse row of (term, weight); each
of its terms scatters ``query weight x posting weight`` into a dense array of scores, one per
candidate of the block. The k best are found by partition selection and merged: over the blocks
of a task, then over tasks by Spark. Nothing is skipped and nothing estimated.

Queries travel to the candidates in passes of a bounded number of bytes; every pass reads all
candidates once, and its result is written before the next. The work is queries x candidates by
nature, candidates never move for it.

Vectors that are null, or hold null, NaN or infinite components, take no part, neither as query
nor as candidate. An empty vector scores 0 everywhere; of two vectors of different length the
shorter ends in zeros. A query's own row is left out; another row with the same id, or the same
vector, is a candidate like any other, and repeated query rows are answered each. Ties go to
the smaller id; a null id comes last and is never a query by ``id % n``. Components beyond 64
bits count as the nearest long, and so do scores, which are summed exactly first. Empty tables give no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.llm.common import numbered, shuffle_partitions
from topicweave.session import Scratch

SCALE = 1024
#: Bytes of query components sent to the candidates at once.
PASS_BYTES = 16 << 20
#: Candidates of a block, and queries whose scores are held for it at once.
BLOCK = 2048
GROUP = 128
#: Multiplications that make a task worth starting.
TASK_WORK = 4_000_000_000
_LONG = np.iinfo(np.int64)
_FOUND = "query_row long, query_id long, vec_id long, score long"


def weighted(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, weights`` of the vectors that take part."""
    whole = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    weights = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(whole).select(F.col("vec_id").cast("long"), weights.alias("weights"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of each component that is not zero."""
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    weight = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    held = weight != 0
    return row[held], term[held], weight[held]


def postings(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple]:
    """(rows, weights) of each term, rows ascending."""
    order = np.argsort(term, kind="stable")
    names, starts = np.unique(term[order], return_index=True)
    parts = zip(np.split(row[order], starts[1:]), np.split(weight[order], starts[1:]), strict=True)
    return {int(t): p for t, p in zip(names, parts, strict=False)}


def _largest(weight: np.ndarray) -> float:
    return float(np.abs(weight.astype(np.float64)).max(initial=0.0))


def accumulate(asked: dict[int, tuple], n_asked: int, held: dict[int, tuple], n: int, kind) -> np.ndarray:
    """Scores of ``n_asked`` queries over ``n`` candidates, term at a time."""
    scores = np.zeros((n_asked, n), dtype=kind)
    for term, (members, own) in asked.items():
        if term not in held:
            continue
        rows, weights = held[term]
        own, weights = own.astype(kind), weights.astype(kind)
        if 2 * len(rows) >= n:  # a posting that most rows share is added as a whole column
            column = np.zeros(n, dtype=kind)
            column[rows] = weights
            if len(members) == n_asked:
                scores += np.multiply.outer(own, column)
            else:
                scores[members] += np.multiply.outer(own, column)
        else:
            scores[np.ix_(members, rows)] += np.multiply.outer(own, weights)
    return scores


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.found: list[tuple | None] = [None] * n

    def add(self, query: int, score: np.ndarray, vec_id: np.ndarray, absent: np.ndarray) -> None:
        own = self.found[query]
        if own is not None:
            score, vec_id, absent = (np.concatenate(x) for x in zip(own, (score, vec_id, absent), strict=True))
        order = np.lexsort((vec_id, absent, -score))[: self.k]
        self.found[query] = score[order], vec_id[order], absent[order]


class Pass:
    """The queries of one pass, sparse, grouped for the blocks."""

    def __init__(self, table: pa.Table, block: int, group: int) -> None:
        self.block = block
        self.rows = table["row"].to_numpy()
        self.ids = table["vec_id"].to_numpy()
        weights = table["weights"].combine_chunks()
        self.largest, self.groups = 0.0, []
        for at in range(0, len(self.rows), group):
            row, term, weight = _flat(weights.slice(at, group))
            self.largest = max(self.largest, _largest(weight))
            self.groups.append((at, min(group, len(self.rows) - at), postings(row, term, weight)))
        self.order = np.argsort(self.rows)

    def search(self, batch: pa.RecordBatch, best: Best) -> None:
        """Score a block of candidates and keep the best."""
        batch = batch.sort_by([("vec_id", "ascending")])  # nulls come last
        n = batch.num_rows
        absent = np.asarray(batch.column("vec_id").is_null())
        vec_id = np.asarray(batch.column("vec_id").fill_null(0))
        row, term, weight = _flat(batch.column("weights"))
        terms = int(term.max(initial=0)) + 1
        narrow = self.largest * _largest(weight) * terms < 2.0**62
        kind, least = np.int64 if narrow else object, _LONG.min
        held = postings(row, term, weight)
        # places of the queries' own rows in this block
        mine = np.asarray(batch.column("row"))
        at = np.searchsorted(self.rows, mine, sorter=self.order)
        same = self.order[np.minimum(at, len(self.rows) - 1)]
        inside = np.flatnonzero(self.rows[same] == mine)
        k = min(best.k, n)
        for first, size, asked in self.groups:
            scores = accumulate(asked, size, held, n, kind)
            if not narrow:
                scores = np.clip(scores, least + 1, _LONG.max).astype(np.int64)
            for place in inside:
                if first <= same[place] < first + size:
                    scores[same[place] - first, place] = least
            edge = np.partition(scores, n - k, axis=1)[:, n - k]
            for q in range(size):
                over = np.flatnonzero(scores[q] > edge[q])
                ties = np.flatnonzero(scores[q] == edge[q])[: k - len(over)]  # smaller ids first
                chosen = np.concatenate([over, ties])
                chosen = chosen[scores[q][chosen] > least]
                best.add(first + q, scores[q][chosen], vec_id[chosen], absent[chosen])


def _merged(queries: Pass, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.rows), k)
        for batch in batches:
            for at in range(0, batch.num_rows, queries.block):
                queries.search(batch.slice(at, queries.block), best)
        for q, found in enumerate(best.found):
            if found is not None:
                score, vec_id, absent = found
                n = len(score)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, queries.rows[q])),
                        pa.array(np.full(n, queries.ids[q])),
                        pa.array(vec_id, mask=absent),
                        pa.array(score),
                    ],
                    names=["query_row", "query_id", "vec_id", "score"],
                )

    return find


def top_k(
    vectors: DataFrame,
    asked: Column,
    k: int = 10,
    scale: int = SCALE,
    pass_bytes: int = PASS_BYTES,
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows for which ``asked`` (over ``vec_id``) holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    held = weighted(vectors, scale).withColumn("row", F.monotonically_increasing_id())
    held = scratch.write(held, "rows")
    queries = held.where(asked & F.col("vec_id").isNotNull())
    size = queries.agg(
        F.count("*").alias("n"), F.max(F.size("weights")).alias("most"), F.sum(F.size("weights")).alias("all")
    ).first()
    per_pass = max(1, pass_bytes // (8 * max(1, size["most"] or 0)))
    passes = -(-size["n"] // per_pass)
    if passes > 1:
        placed = numbered(queries.select(F.col("row").alias("at")), [F.asc("at")], scratch, "order")
        placed = placed.select("at", (F.col("row") / per_pass).cast("long").alias("pass"))
        queries = scratch.write(queries.join(placed, F.col("row") == F.col("at")).drop("at"), "asked")
    work = held.count() * (size["all"] or 0)
    tasks = max(shuffle_partitions(spark), min(100_000, work // TASK_WORK))
    candidates = scratch.write(held.repartition(tasks, "row"), "dealt") if passes else held
    found = spark.createDataFrame([], _FOUND)
    for turn in range(passes):
        own = queries.where(F.col("pass") == turn) if passes > 1 else queries
        # at most per_pass queries: pass_bytes of components
        sent = Pass(own.select("row", "vec_id", "weights").toArrow(), block, group)
        scratch.write(candidates.mapInArrow(_merged(sent, k), _FOUND), f"found/pass={turn}")
    if passes:
        found = spark.read.schema(_FOUND).parquet(f"{scratch.path}/found")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
