"""The registered queries: every operator on the whole driver tables.

Model queries fit on the words of all ``documents``. Placed cells and the fitted
model are kept per session and data folder, as an analyst would fit once and then
report many times; :func:`forget` drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.functions import text as tx
from topicweave.functions.vectors import rounded
from topicweave.model import TopicModel
from topicweave.operators import counts, report
from topicweave.operators.cells import CellBlocks, place_cells, place_corpus
from topicweave.operators.factors import seed_vector
from topicweave.operators.metrics import residuals
from topicweave.operators.nmf import (
    Factors,
    compare_methods,
    fit_nmf,
    nmf_to_plsa,
    start_factors,
)
from topicweave.operators.plsa import fit_em, posterior, start_values
from topicweave.operators.search import fold_in, fold_in_smooth, search, search_batch, terms_of
from topicweave.operators.sentences import abbreviations
from topicweave.operators.svd import truncated_svd
from topicweave.session import Scratch
from topicweave.sources import corpus as src
from topicweave.streaming.counting import CountStore
from topicweave.streaming.ingest import land_statuses, start_ingest, stream_statuses
from topicweave.streaming.newest import newest, read_status_stream
from topicweave.streaming.newest import newest_stream as newest_of_stream

Query = Callable[[SparkSession, str], DataFrame]

K = 5
EM_ITERATIONS = 3
MANY_TOPICS = 40
EXAMPLE_TOPICS = 200
NMF_ITERATIONS = 2
ACCOUNTS = ["src0", "src7", "src13"]
NEWEST = 20
STRANGER = "qqzzqq xxyyxx"
SEARCH_TEXT = "tion of the inea Edonre"

_blocks: dict[tuple[str, str], CellBlocks] = {}
_models: dict[tuple[str, str], TopicModel] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(
        "doc_id", F.col("text").alias("full_text"), F.col("source").alias("screen_name")
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return table.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.col("text").alias("full_text"),
        F.col("role").alias("screen_name"),
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return table.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def blocks_of(spark: SparkSession, sf_dir: str) -> CellBlocks:
    key = _key(spark, sf_dir)
    if key not in _blocks:
        _blocks[key] = place_corpus(documents(spark, sf_dir))
    return _blocks[key]


def model_of(spark: SparkSession, sf_dir: str) -> TopicModel:
    key = _key(spark, sf_dir)
    if key not in _models:
        corpus = documents(spark, sf_dir)
        _models[key] = fit_em(blocks_of(spark, sf_dir), K, EM_ITERATIONS, corpus=corpus)
    return _models[key]


def forget() -> None:
    """Drop the kept cells and models."""
    for blocks in _blocks.values():
        blocks.release()
    _blocks.clear()
    _models.clear()


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(spark, sf_dir).cells.select("word", "doc_id", "n")


def _long(factor: DataFrame, key: str, name: str = "p") -> DataFrame:
    return factor.select(key, F.posexplode(name).alias("z", "p")).select(
        key, "z", rounded(F.col("p"), 10).alias("p")
    )


def _stacked(model: TopicModel) -> DataFrame:
    """Words and documents of a model in one table ``(side, item, z, p)``."""
    words = _long(model.words, "word").select(
        F.lit("word").alias("side"), F.col("word").alias("item"), "z", "p"
    )
    docs = _long(model.docs, "doc_id").select(
        F.lit("doc").alias("side"), F.col("doc_id").cast("string").alias("item"), "z", "p"
    )
    return words.unionByName(docs)


# --- corpus -------------------------------------------------------------------


def corpus_projection(spark, sf_dir):
    docs = documents(spark, sf_dir)
    statuses = docs.select(
        F.col("doc_id").alias("id"),
        F.lit(None).cast("string").alias("created_at"),
        "full_text",
        F.struct("screen_name").alias("user"),
    )
    return src.statuses_to_corpus(statuses).select("doc_id", "full_text", "screen_name")


def account_filter(spark, sf_dir):
    return src.keep_accounts(documents(spark, sf_dir), ACCOUNTS)


def account_table_filter(spark, sf_dir):
    """Accounts from a table: the sources that have a document labelled toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1")
    docs = documents(spark, sf_dir)
    accounts = docs.join(labels, "doc_id", "left_semi").select("screen_name").distinct()
    return src.keep_accounts(docs, accounts).select("doc_id", "full_text", "screen_name")


def latest_per_account(spark, sf_dir):
    return src.latest_per_account(documents(spark, sf_dir), NEWEST)


def corpus_union(spark, sf_dir):
    return src.union_statuses([documents(spark, sf_dir), conversations(spark, sf_dir)])


def status_dedup(spark, sf_dir):
    pages = [documents(spark, sf_dir), documents(spark, sf_dir)]
    return src.union_statuses(pages).dropDuplicates(["doc_id"])


def generated_corpus(spark, sf_dir):
    """Accounts -> newest -> cleaned, from status records with repeated ids."""
    docs = documents(spark, sf_dir)
    statuses = docs.select(
        F.col("doc_id").alias("id"),
        F.lit(None).cast("string").alias("created_at"),
        "full_text",
        F.struct("screen_name").alias("user"),
    )
    made = src.generate_corpus(statuses.unionByName(statuses), ACCOUNTS, NEWEST)
    return made.select("doc_id", "full_text", "screen_name", "edited_text")


def _written(docs: DataFrame, path: str) -> None:
    """A corpus folder whose files are in the order of the ids; the id stands in created_at."""
    rows = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(
        F.col("doc_id").cast("string").alias("created_at"),
        "full_text",
        "screen_name",
        F.lit("").alias("edited_text"),
    )
    src.write_corpus(rows, path)


def corpus_files(spark, sf_dir):
    """A corpus read from delimited files, then again with more files: the first keep their ids."""
    scratch = Scratch(spark, "files")
    docs = documents(spark, sf_dir)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    docs = docs.join(table, "doc_id")
    later = F.coalesce(F.col("lang") != "en", F.lit(True))
    files, manifest = f"{scratch.path}/corpus", f"{scratch.path}/manifest"
    _written(docs.where(~later), f"{files}/z-first")
    src.read_corpus(spark, f"{files}/*", scratch=scratch, manifest=manifest)
    _written(docs.where(later), f"{files}/a-later")
    read = src.read_corpus(spark, f"{files}/*", scratch=Scratch(spark, "again"), manifest=manifest)
    return read.select(
        "doc_id",
        F.col("created_at").cast("long").alias("source_id"),
        F.coalesce("full_text", F.lit("")).alias("full_text"),
        "screen_name",
    )


def stream_ingest(spark, sf_dir):
    """Documents land twice as JSON dumps; the stream stores each id once, cleaned."""
    scratch = Scratch(spark, "ingest")
    landed = documents(spark, sf_dir).withColumn("created_at", F.lit(None).cast("string"))
    for _ in range(2):
        land_statuses(landed, f"{scratch.path}/landing")
    stream = stream_statuses(spark, f"{scratch.path}/landing")
    query = start_ingest(stream, f"{scratch.path}/corpus", f"{scratch.path}/progress")
    query.awaitTermination()
    stored = spark.read.parquet(f"{scratch.path}/corpus")
    return stored.select("doc_id", "full_text", "screen_name", "edited_text")


def newest_stream(spark, sf_dir):
    """The newest documents of every account from a stream; every page lands twice."""
    scratch = Scratch(spark, "newest")
    landing, target = f"{scratch.path}/landing", f"{scratch.path}/newest"
    landed = documents(spark, sf_dir).withColumn("created_at", F.lit(None).cast("string"))
    for _ in range(2):
        land_statuses(landed, landing)
        stream = newest_of_stream(read_status_stream(spark, landing), NEWEST)
        start_ingest(stream, target, f"{scratch.path}/progress").awaitTermination()
    return newest(spark, target, NEWEST).select("doc_id", "full_text", "screen_name", "edited_text")


def growing_counts(spark, sf_dir):
    """Words with their sums from three pages in turn; each page holds the one before."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = CountStore(spark, Scratch(spark, "store").path)
    for page, languages in enumerate((["en"], ["en", "de"])):
        held = table.where(F.col("lang").isin(languages)).select("doc_id")
        store.add(src.spread(documents(spark, sf_dir).join(held, "doc_id", "left_semi")), page)
    store.add(src.spread(documents(spark, sf_dir)), 2)
    return store.vocabulary().join(store.words(), "word").select("word_id", "word", "n", "docs")


# --- text ---------------------------------------------------------------------


def clean_text(spark, sf_dir):
    corpus = src.with_edited_text(src.spread(documents(spark, sf_dir)))
    return src.text_column(corpus)


def clean_conversations(spark, sf_dir):
    corpus = src.with_edited_text(src.spread(conversations(spark, sf_dir)))
    return src.text_column(corpus)


def _kept(corpus: DataFrame, drop) -> DataFrame:
    kept = F.filter(tx.word_tokens(F.col("full_text")), lambda t: ~drop(t))
    return src.spread(corpus).select("doc_id", F.array_join(kept, " ").alias("kept"))


def abbreviation_scores(spark, sf_dir):
    """Abbreviations among the words of all documents."""
    found = abbreviations(src.spread(documents(spark, sf_dir)))
    return found.select("word", "stops", "plain", F.round("score", 6).alias("score"))


def emoticon_filter(spark, sf_dir):
    return _kept(documents(spark, sf_dir), tx.is_emoticon)


def stopword_filter(spark, sf_dir):
    return _kept(documents(spark, sf_dir), tx.is_stop_word)


def punctuation_filter(spark, sf_dir):
    return _kept(documents(spark, sf_dir), lambda t: tx.is_punctuation(t) | tx.is_short_link(t))


def _normalised(spark, sf_dir, fn):
    corpus = documents(spark, sf_dir)
    return corpus.select("doc_id", fn(F.col("full_text")).alias("text"))


def normalize_colon(spark, sf_dir):
    return _normalised(spark, sf_dir, tx.delete_colons)


def normalize_mojibake(spark, sf_dir):
    return _normalised(spark, sf_dir, tx.delete_mojibake)


def normalize_ascii(spark, sf_dir):
    return _normalised(spark, sf_dir, tx.blank_non_ascii)


def strip_emoji(spark, sf_dir):
    return _normalised(spark, sf_dir, tx.delete_emoji)


# --- counts -------------------------------------------------------------------


def term_counts(spark, sf_dir):
    corpus = src.with_edited_text(src.spread(documents(spark, sf_dir)))
    return counts.term_counts(corpus)


def joint_distribution(spark, sf_dir):
    joint = counts.joint_distribution(_cells(spark, sf_dir))
    return joint.select("word", "doc_id", F.round("x", 12).alias("x"))


def vocabulary(spark, sf_dir):
    return counts.vocabulary(_cells(spark, sf_dir))


def query_membership(spark, sf_dir):
    vocab = counts.vocabulary(_cells(spark, sf_dir))
    return counts.query_membership(vocab, terms_of(benchmark(spark, sf_dir)))


# --- PLSA by EM ---------------------------------------------------------------


def seed_factors(spark, sf_dir):
    start = start_values(
        blocks_of(spark, sf_dir), documents(spark, sf_dir), K, Scratch(spark, "seed")
    )
    return _stacked(start)


def plsa_posterior(spark, sf_dir):
    start = start_values(
        blocks_of(spark, sf_dir), documents(spark, sf_dir), K, Scratch(spark, "seed")
    )
    shares = posterior(blocks_of(spark, sf_dir), start)
    wide = [rounded(F.col("p")[z], 10).alias(f"p{z}") for z in range(K)]
    return shares.select("word", "doc_id", *wide)


def plsa_word_topics(spark, sf_dir):
    return _long(model_of(spark, sf_dir).words, "word")


def plsa_doc_topics(spark, sf_dir):
    return _long(model_of(spark, sf_dir).docs, "doc_id")


def plsa_topic_prior(spark, sf_dir):
    return model_of(spark, sf_dir).topics.select("z", F.round("p", 10).alias("p"))


def plsa_many_topics(spark, sf_dir):
    """More topics than one unrolled slab holds; one iteration."""
    model = fit_em(blocks_of(spark, sf_dir), MANY_TOPICS, 1, corpus=documents(spark, sf_dir))
    return _long(model.words, "word")


def plsa_example_topics(spark, sf_dir):
    """As many topics as the example of the library's users: 200; one iteration."""
    corpus = documents(spark, sf_dir)
    model = fit_em(blocks_of(spark, sf_dir), EXAMPLE_TOPICS, 1, corpus=corpus)
    return model.topics.select("z", F.round("p", 9).alias("p"))


def plsa_defaults(spark, sf_dir):
    """The default model: 10 topics, 20 iterations."""
    model = fit_em(blocks_of(spark, sf_dir), 10, 20, corpus=documents(spark, sf_dir))
    return model.topics.select("z", F.round("p", 9).alias("p"))


def _hashed_start(spark, sf_dir) -> Factors:
    """A custom start (W, H): uniform values from another seed."""
    blocks = blocks_of(spark, sf_dir)
    docs = documents(spark, sf_dir).select("doc_id")
    return Factors(
        blocks.words.select("word", seed_vector("W", F.col("word"), K).alias("f")),
        docs.select("doc_id", seed_vector("H", F.col("doc_id"), K).alias("f")),
        K,
    )


def plsa_warm_start(spark, sf_dir):
    start = nmf_to_plsa(_hashed_start(spark, sf_dir))
    corpus = documents(spark, sf_dir)
    model = fit_em(blocks_of(spark, sf_dir), K, EM_ITERATIONS, start, corpus)
    return _stacked(model)


def plsa_weighted(spark, sf_dir):
    """EM on alternative weights: every cell counts once."""
    cells = _cells(spark, sf_dir).withColumn("n", F.lit(1.0))
    placed = place_cells(cells)
    model = fit_em(placed, K, EM_ITERATIONS, corpus=documents(spark, sf_dir))
    placed.release()
    return _stacked(model)


def plsa_reconstruct(spark, sf_dir):
    values = model_of(spark, sf_dir).reconstruct(blocks_of(spark, sf_dir))
    return values.select("word", "doc_id", rounded(F.col("p"), 12).alias("p"))


def _rounded_history(history: DataFrame) -> DataFrame:
    return history.select(
        "method",
        "iter",
        F.round("kl", 8).alias("kl"),
        F.round("frobenius", 8).alias("frobenius"),
        F.round("kkt_w", 4).alias("kkt_w"),
        F.round("kkt_h", 4).alias("kkt_h"),
    )


def plsa_history(spark, sf_dir):
    corpus = documents(spark, sf_dir)
    blocks = blocks_of(spark, sf_dir)
    model = fit_em(blocks, K, EM_ITERATIONS, corpus=corpus, keep_history=True)
    return _rounded_history(model.history)


def model_residuals(spark, sf_dir):
    model = model_of(spark, sf_dir)
    h = model.docs.select("doc_id", F.col("p").alias("b"))
    row = residuals(blocks_of(spark, sf_dir), model.weighted_words, h, K)
    named = row.select(F.lit("EM").alias("method"), F.lit(EM_ITERATIONS).alias("iter"), "*")
    return _rounded_history(named)


# --- reports ------------------------------------------------------------------


def top_words(spark, sf_dir):
    return report.top_words(model_of(spark, sf_dir).words, 10)


def topic_summary(spark, sf_dir):
    return report.topic_summary(model_of(spark, sf_dir).words, 10)


def top_docs(spark, sf_dir):
    return report.top_docs(model_of(spark, sf_dir), documents(spark, sf_dir), n_topic=0)


def topic_top_docs(spark, sf_dir):
    return report.top_docs(model_of(spark, sf_dir), documents(spark, sf_dir))


def dominant_topic(spark, sf_dir):
    return report.dominant_topic(model_of(spark, sf_dir).docs)


def best_doc_per_topic(spark, sf_dir):
    return report.best_doc_per_topic(model_of(spark, sf_dir), documents(spark, sf_dir))


# --- factorisation ------------------------------------------------------------


def _factorised(method: str, metric: str = "kullback-leibler") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        blocks, corpus = blocks_of(spark, sf_dir), documents(spark, sf_dir)
        factors = fit_nmf(blocks, K, NMF_ITERATIONS, method, metric, corpus=corpus)
        return _stacked(nmf_to_plsa(factors))

    query.__name__ = f"nmf_{method}"
    return query


def nmf_custom_start(spark, sf_dir):
    blocks, corpus = blocks_of(spark, sf_dir), documents(spark, sf_dir)
    start = _hashed_start(spark, sf_dir)
    factors = fit_nmf(blocks, K, NMF_ITERATIONS, "sklearn", start=start, corpus=corpus)
    return _stacked(nmf_to_plsa(factors))


def nmf_to_plsa_query(spark, sf_dir):
    blocks, corpus = blocks_of(spark, sf_dir), documents(spark, sf_dir)
    return _stacked(nmf_to_plsa(start_factors(blocks, corpus, K, Scratch(spark, "start"))))


def nmf_compare(spark, sf_dir):
    blocks, corpus = blocks_of(spark, sf_dir), documents(spark, sf_dir)
    table = compare_methods(blocks, K, NMF_ITERATIONS, ["EM", "sklearn", "simple_MU"], corpus)
    return _rounded_history(table)


def svd_spectrum(spark, sf_dir):
    spectrum = truncated_svd(blocks_of(spark, sf_dir), K).spectrum
    return spectrum.select("i", F.round("sigma", 12).alias("sigma"))


# --- search -------------------------------------------------------------------


def query_terms(spark, sf_dir):
    return terms_of(benchmark(spark, sf_dir))


def _long_shares(folded: DataFrame) -> DataFrame:
    return folded.select("query_id", "matched", F.posexplode("q").alias("z", "q")).select(
        "query_id", "matched", "z", F.round("q", 8).alias("q")
    )


def fold_in_query(spark, sf_dir):
    return _long_shares(fold_in(model_of(spark, sf_dir), benchmark(spark, sf_dir)))


def fold_in_smooth_query(spark, sf_dir):
    """Every query over the whole vocabulary."""
    return _long_shares(fold_in_smooth(model_of(spark, sf_dir), benchmark(spark, sf_dir)))


def search_smooth(spark, sf_dir):
    model, corpus = model_of(spark, sf_dir), documents(spark, sf_dir)
    return search_batch(model, corpus, benchmark(spark, sf_dir), threshold=1e-3, smooth=True)


def search_query(spark, sf_dir):
    return search(model_of(spark, sf_dir), documents(spark, sf_dir), SEARCH_TEXT, threshold=1e-3)


def search_batch_query(spark, sf_dir):
    model, corpus = model_of(spark, sf_dir), documents(spark, sf_dir)
    return search_batch(model, corpus, benchmark(spark, sf_dir), threshold=1e-3)


def search_oov(spark, sf_dir):
    """Batch search where one more query has no word of the vocabulary."""
    model, corpus = model_of(spark, sf_dir), documents(spark, sf_dir)
    stranger = spark.range(1).select((F.col("id") - 1).alias("query_id"), F.lit(STRANGER).alias("query"))
    asked = benchmark(spark, sf_dir).unionByName(stranger)
    return search_batch(model, corpus, asked, threshold=1e-3, allow_oov=True)


def registry() -> dict[str, Query]:
    return {
        "corpus_projection": corpus_projection,
        "account_filter": account_filter,
        "account_table_filter": account_table_filter,
        "latest_per_account": latest_per_account,
        "corpus_union": corpus_union,
        "status_dedup": status_dedup,
        "generated_corpus": generated_corpus,
        "corpus_files": corpus_files,
        "stream_ingest": stream_ingest,
        "newest_stream": newest_stream,
        "growing_counts": growing_counts,
        "clean_text": clean_text,
        "clean_conversations": clean_conversations,
        "abbreviations": abbreviation_scores,
        "emoticon_filter": emoticon_filter,
        "stopword_filter": stopword_filter,
        "punctuation_filter": punctuation_filter,
        "normalize_colon": normalize_colon,
        "normalize_mojibake": normalize_mojibake,
        "normalize_ascii": normalize_ascii,
        "strip_emoji": strip_emoji,
        "term_counts": term_counts,
        "joint_distribution": joint_distribution,
        "vocabulary": vocabulary,
        "query_membership": query_membership,
        "seed_factors": seed_factors,
        "plsa_posterior": plsa_posterior,
        "plsa_word_topics": plsa_word_topics,
        "plsa_doc_topics": plsa_doc_topics,
        "plsa_topic_prior": plsa_topic_prior,
        "plsa_many_topics": plsa_many_topics,
        "plsa_example_topics": plsa_example_topics,
        "plsa_defaults": plsa_defaults,
        "plsa_warm_start": plsa_warm_start,
        "plsa_weighted": plsa_weighted,
        "plsa_reconstruct": plsa_reconstruct,
        "plsa_history": plsa_history,
        "model_residuals": model_residuals,
        "top_words": top_words,
        "topic_summary": topic_summary,
        "top_docs": top_docs,
        "topic_top_docs": topic_top_docs,
        "dominant_topic": dominant_topic,
        "best_doc_per_topic": best_doc_per_topic,
        "nmf_kl": _factorised("sklearn"),
        "nmf_divergence": _factorised("nimfa_MU"),
        "nmf_kl_frobenius": _factorised("sklearn", "frobenius"),
        "nmf_frobenius": _factorised("simple_MU"),
        "nmf_hals": _factorised("HALS"),
        "nmf_pg": _factorised("Lin_PG"),
        "nmf_anls": _factorised("ANLS_BLOCKPIVOT"),
        "nmf_anls_active": _factorised("ANLS_AS_NUMPY"),
        "nmf_anls_grouped": _factorised("ANLS_AS_GROUP"),
        "nmf_custom_start": nmf_custom_start,
        "nmf_to_plsa": nmf_to_plsa_query,
        "nmf_compare": nmf_compare,
        "svd_spectrum": svd_spectrum,
        "query_terms": query_terms,
        "fold_in": fold_in_query,
        "fold_in_smooth": fold_in_smooth_query,
        "search": search_query,
        "search_batch": search_batch_query,
        "search_oov": search_oov,
        "search_smooth": search_smooth,
    }
