"""Free-text search: fold queries into the topic space, then score documents."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions.text import query_terms
from topicweave.functions.vectors import dot, grouped_sums, literal
from topicweave.model import TopicModel
from topicweave.operators.cells import BROADCAST_BYTES
from topicweave.operators.factors import TINY
from topicweave.operators.gram import _arrays, _matrix
from topicweave.operators.ranking import top_per_group
from topicweave.operators.report import with_documents
from topicweave.session import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Iterations of a search, hits shown, score a hit must exceed.
SEARCH_ITERATIONS = 70
TOP_HITS = 5
THRESHOLD = 1e-2
# Numbers of a block of queries that go to every word, and of words x queries worked on at once
# (they stay in a core's cache).
STATE_VALUES = 250_000
SMOOTH_VALUES = 125_000
PACKED_WORDS = "a binary, times binary, row binary, place binary"


def terms_of(queries: DataFrame) -> DataFrame:
    """``(query_id, word)``: distinct search words of ``(query_id, query)``."""
    words = F.array_distinct(query_terms(F.col("query")))
    return queries.select("query_id", F.explode(words).alias("word"))


def _folded(rows: np.ndarray, sizes: np.ndarray, n_iter: int) -> np.ndarray:
    """P(z|q) of many queries from the rows ``P(z) P(w|z)`` of their words, one query's rows
    after the other's; uniform start."""
    starts = np.cumsum(sizes) - sizes
    q = np.full((len(sizes), rows.shape[1]), 1.0 / rows.shape[1])
    for _ in range(n_iter):
        share = rows * np.repeat(q, sizes, axis=0)
        mass = np.add.reduceat(share / share.sum(axis=1, keepdims=True), starts, axis=0)
        q = np.maximum(mass / mass.sum(axis=1, keepdims=True), TINY)
    return q


def fold_in(model: TopicModel, queries: DataFrame, n_iter: int = SEARCH_ITERATIONS) -> DataFrame:
    """``(query_id, matched, q)``: topic shares of every query with a known word.

    Words the model does not know carry no weight. The rows gathered per query are
    its distinct known words, so a group is never larger than one query text.
    """
    k = model.k
    known = terms_of(queries).join(model.floored_words(TINY), "word")
    grouped = known.groupBy("query_id").agg(
        F.count("*").cast("int").alias("matched"), F.flatten(F.collect_list("a")).alias("a")
    )
    key = grouped.schema["query_id"].dataType.simpleString()

    def fold_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                rows = np.concatenate(list(frame["a"])).reshape(-1, k)
                folded = list(_folded(rows, frame["matched"].to_numpy(), n_iter))
                yield pd.DataFrame(
                    {"query_id": frame["query_id"], "matched": frame["matched"], "q": folded}
                )

    return grouped.mapInPandas(fold_all, f"query_id {key}, matched int, q array<double>")


def _packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``a, who, times`` of a batch as bytes in one row: turns read them without a look at each."""
    for batch in batches:
        if batch.num_rows:
            who = batch.column("who")
            sizes = np.asarray(who.value_lengths().fill_null(0))
            columns = {
                "a": _matrix(batch, "a"),
                "times": batch.column("times").to_numpy().astype(np.float64),
                "row": np.repeat(np.arange(batch.num_rows), sizes).astype(np.int32),
                "place": who.flatten().to_numpy(zero_copy_only=False).astype(np.int32),
            }
            held = [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns.values()]
            yield pa.RecordBatch.from_arrays(held, list(columns))


def _smooth_sums(asked: DataFrame, q: np.ndarray) -> DataFrame:
    """``(place, s)``: for each query the sum over all words of ``n a[z] / (a . q)``, where n is
    1 for each time the word is asked for, else 1e-12. Rows are those of :func:`_packed_words`:
    words with the places of the queries that ask for them, each standing for ``times`` words."""
    n_queries, k = q.shape
    step = max(1, SMOOTH_VALUES // n_queries)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_queries, k))
        for held in (row for batch in batches for row in batch.to_pylist()):
            every, times = np.frombuffer(held["a"]).reshape(-1, k), np.frombuffer(held["times"])
            asking = np.frombuffer(held["row"], np.int32)
            asked_by = np.frombuffer(held["place"], np.int32)
            for at in range(0, len(every), step):
                a, n = every[at : at + step], times[at : at + step, None]
                shares = a @ q.T
                np.reciprocal(shares, out=shares)
                total += shares.T @ (a * (n * TINY))
                # a query's own words weigh what they are asked for instead
                first, last = np.searchsorted(asking, [at, at + step])
                pairs = (asking[first:last] - at).astype(np.int64) * n_queries + asked_by[first:last]
                pairs, asked_for = np.unique(pairs, return_counts=True)
                row, place = pairs // n_queries, pairs % n_queries
                more = (asked_for - TINY) * shares[row, place]
                np.add.at(total, place, more[:, None] * n[row] * a[row])
        places = pa.array(np.arange(n_queries, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([places, _arrays(total)], ["place", "s"])

    rows = asked.mapInArrow(partial, "place int, s array<double>")
    return grouped_sums(rows, ["place"], k, lambda z: f"s[{z}]")


def fold_in_smooth(
    model: TopicModel,
    queries: DataFrame,
    n_iter: int = SEARCH_ITERATIONS,
    state_values: int = STATE_VALUES,
) -> DataFrame:
    """``(query_id, matched, q)``: topic shares of every query over the whole vocabulary.

    Words outside a query weigh 1e-12, so a query without a known word has an answer too. A
    turn is one pass over the words for all queries of a block: the shares of a block's
    queries (about ``state_values`` numbers) go to the words, and their sums come back.
    Words with the same row that the same queries ask for add the same, so they are one row
    with their number: rare words lie at the floor of a fit, and fewer than ``1 / floor`` words
    of a topic can lie above it, however large the vocabulary.
    """
    spark, k = queries.sparkSession, model.k
    scratch = Scratch(spark, "fold-in")
    key = queries.schema["query_id"].dataType.simpleString()
    ids = scratch.write(queries.select("query_id").distinct(), "ids")
    blocks = max(1, -(-ids.count() * k // state_values))
    words = scratch.write(model.floored_words(TINY), "words")
    terms = scratch.write(terms_of(queries), "terms")
    schema = f"query_id {key}, matched int, q array<double>"
    for block in range(blocks):
        own = ids.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        names = [r["query_id"] for r in own.collect()]  # state_values / k of them on average
        if not names:
            continue
        places = spark.createDataFrame(list(enumerate(names)), f"place int, query_id {key}")
        asking = terms.join(F.broadcast(places), "query_id").groupBy("word")
        asking = asking.agg(F.array_sort(F.collect_list("place")).alias("who"))
        alike = words.join(asking, "word", "left").groupBy("a", "who")
        asked = scratch.write(alike.agg(F.count("*").alias("times")), f"asked-{block}")
        counts = asked.select(F.explode("who").alias("place"), "times").groupBy("place")
        counts = counts.agg(F.sum("times").alias("count"))
        matched = {r["place"]: r["count"] for r in counts.collect()}  # a row per query
        packed = asked.select("a", "who", "times").mapInArrow(_packed_words, PACKED_WORDS)
        packed = scratch.write(packed, f"packed-{block}")
        q = np.full((len(names), k), 1.0 / k)
        for _ in range(n_iter):
            mass = np.zeros_like(q)
            for row in _smooth_sums(packed, q).collect():  # a row per query
                mass[row["place"]] = row["s"]
            mass *= q
            q = np.maximum(mass / mass.sum(axis=1, keepdims=True), TINY)
        rows = [(n, matched.get(i, 0), q[i].tolist()) for i, n in enumerate(names)]
        scratch.write(spark.createDataFrame(rows, schema), f"folded/block={block}")
    if ids.isEmpty():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{scratch.path}/folded").select("query_id", "matched", "q")


def fold_in_all_words(
    model: TopicModel, query: str, n_iter: int = SEARCH_ITERATIONS
) -> list[float]:
    """P(z|q) of one query by :func:`fold_in_smooth`."""
    one = model.words.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    return list(fold_in_smooth(model, one, n_iter).first()["q"])


def _ranked(hits: DataFrame, corpus: DataFrame, at_most: int) -> DataFrame:
    return with_documents(hits, corpus, at_most).select(
        "query_id", "rank", "doc_id", "score", "screen_name", "full_text"
    )


def search(
    model: TopicModel,
    corpus: DataFrame,
    query: str,
    top: int = TOP_HITS,
    threshold: float = THRESHOLD,
    n_iter: int = SEARCH_ITERATIONS,
    allow_oov: bool = False,
    smooth: bool = False,
) -> DataFrame:
    """Best documents of one query: at most ``top``, score above ``threshold``.

    ``smooth`` lets all other words weigh 1e-12; ``allow_oov`` does so only when no
    word is known (otherwise such a query has no hits).
    """
    if not query:
        raise ValueError("An empty query has nothing to search for.")
    spark = model.words.sparkSession
    one = spark.createDataFrame([(0, query)], "query_id int, query string")
    folded = None if smooth else fold_in(model, one, n_iter).first()
    if folded is not None:
        q = list(folded["q"])
    elif smooth or allow_oov:
        q = fold_in_all_words(model, query, n_iter)
    else:
        q = None
    scored = model.docs
    if q is None:
        scored = scored.where(F.lit(False))
        q = [0.0] * model.k
    scored = scored.withColumn("q", literal(q))
    score = F.expr(dot("q", "p", model.k))
    best = (
        scored.where(score > threshold)
        .select(F.lit(0).alias("query_id"), "doc_id", F.round(score, 9).alias("score"))
        .orderBy(F.desc("score"), "doc_id")
        .limit(top)
    )
    hits = top_per_group(best, ["query_id"], [F.desc("score"), F.asc("doc_id")], top)
    return _ranked(hits, corpus, top)


def search_batch(
    model: TopicModel,
    corpus: DataFrame,
    queries: DataFrame,
    top: int = TOP_HITS,
    threshold: float = THRESHOLD,
    n_iter: int = SEARCH_ITERATIONS,
    allow_oov: bool = False,
    smooth: bool = False,
) -> DataFrame:
    """:func:`search` for a table ``(query_id, query)``, without pairing all with all.

    ``score = sum_z q[z] p[z] > t`` needs a topic with ``q[z] p[z] > t / K``. So a
    document is listed under its topics with ``p[z] > t / K``, by power-of-two level
    of p[z]; a query looks only into the levels its q[z] can lift above ``t / K``.
    P(d|z) sums to one over the documents, so topic z holds fewer than ``K q[z] / t``
    documents above that bound and a query meets at most about ``2 K / t`` of them,
    however large the corpus. A pair is scored where ``q[z] p[z]`` is largest.

    ``allow_oov`` also answers queries without a known word: all words then weigh the
    same, so these queries share one answer, folded in once over the vocabulary. ``smooth``
    folds every query that is not empty over the whole vocabulary.
    """
    if threshold <= 0:
        raise ValueError("A batch search needs a positive threshold.")
    k = model.k
    bound = threshold / k * (1 - 1e-9)
    if smooth:
        folded = fold_in_smooth(model, queries.where("query <> ''"), n_iter)
    else:
        folded = fold_in(model, queries, n_iter)
    if allow_oov and not smooth:
        strangers = queries.where("query <> ''").select("query_id").distinct()
        strangers = strangers.join(folded, "query_id", "left_anti")
        shares = literal(fold_in_all_words(model, "", n_iter)).alias("q")
        folded = folded.unionByName(strangers.select("query_id", F.lit(0).alias("matched"), shares))
    level = F.floor(F.log2("p_z")).cast("int")
    listed = (
        model.docs.select("doc_id", "p", F.posexplode("p").alias("z", "p_z"))
        .where(F.col("p_z") > bound)
        .select("doc_id", "p", "z", "p_z", level.alias("level"))
    )
    # level L holds p in [2^L, 2^(L+1)); P(d|z) never exceeds 1, which is level 0
    lowest = F.floor(F.log2(F.lit(bound) / F.col("q_z"))).cast("int")
    asking = (
        folded.select("query_id", "q", F.posexplode("q").alias("z", "q_z"))
        .where(F.col("q_z") > bound)
        .withColumn("level", F.explode(F.sequence(F.least(lowest, F.lit(0)), F.lit(0))))
    )
    best_topic = F.expr(
        "array_position(zip_with(p, q, (x, y) -> x * y),"
        " array_max(zip_with(p, q, (x, y) -> x * y))) - 1"
    )
    # every topic lists fewer than K / t documents, K rows of K values at most
    if k * k / bound * (8 * k + 96) <= BROADCAST_BYTES:
        met = asking.join(F.broadcast(listed), ["z", "level"])
    else:
        # few distinct (z, level): spread the queries, repeat the documents
        salts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        met = asking.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
        met = met.join(listed.withColumn("salt", every), ["z", "level", "salt"])
    pairs = (
        met.where(F.col("q_z") * F.col("p_z") > bound)
        .where(F.col("z") == best_topic)
    )
    scored = pairs.select("query_id", "doc_id", F.expr(dot("q", "p", k)).alias("score"))
    scored = scored.where(F.col("score") > threshold)
    scored = scored.withColumn("score", F.round("score", 9))
    hits = top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], top)
    wanted = corpus.select("doc_id", "screen_name", "full_text")
    return hits.join(wanted, "doc_id").select(
        "query_id", "rank", "doc_id", "score", "screen_name", "full_text"
    )
