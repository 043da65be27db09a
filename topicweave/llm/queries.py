"""The registered queries of the corpus operators, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm import alignment, collocations, fingerprint, importance, linededup, minhash, mixing, oracle, packing, repeats, rules, sharding, topk, toxicity
from topicweave.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_copies(documents(spark, sf_dir, "doc_id", "text", "source"))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir, "doc_id", "text"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir, "doc_id", "text")).drop("spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return kept.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.array_join("kept_lines", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows, _, _ = importance.draw(docs, importance.fit(docs, labels))
    return rows.withColumnRenamed("drawn", "kept")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(documents(spark, sf_dir, "doc_id", "text", "lang"), carry=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir, "doc_id", "text"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(documents(spark, sf_dir, "doc_id", "text")).drop("ta", "tb", "root")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir, "doc_id", "text"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir, "text", "lang"))


def registry() -> dict[str, Query]:
    own = [
        op1_mix, op2_fingerprint, op3_repeats, op4_toxicity, op5_line_dedup, op6_importance,
        op7_rules, op8_shard, op9_pack, op10_minhash, op11_topk,
        op12_alignment, op13_collocations,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def statements() -> dict[str, str]:
    found = {
        "op1_mix": oracle.MIX,
        "op5_line_dedup": oracle.LINES,
        "op7_rules": oracle.rules_sql(),
        "op10_minhash": oracle.NEAR,
        "op11_topk": oracle.TOPK,
        "op13_collocations": oracle.PHRASES,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
