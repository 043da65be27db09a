"""From raw documents to packed token sequences, one written table after another.

Each stage takes the documents its predecessor kept and returns documents; the last returns
pieces of sequences. Rows that agree in id and text are one document from the near-duplicate
stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicweave.llm import importance, linededup, minhash, mixing, packing
from topicweave.llm.common import sealed
from topicweave.session import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = importance.fit(docs, labels)
    _, last, _ = importance.draw(docs, model)
    return importance.keep_drawn(docs, model, last)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others hold; a document without lines keeps its row."""
    docs, names, columns = sealed(docs, ["doc_id", "text", "n_chars"])
    marked = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.array_join("kept_lines", "\n")).otherwise(F.col("text"))
    marked = marked.withColumn("text", text)
    if "n_chars" in columns:
        length = F.length("text").cast("long")
        marked = marked.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return marked.select(*names).toDF(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, nulls last, then by
    the hashes of the text. Documents without words are linked with nothing and all stay."""
    docs, names, columns = sealed(docs, ["doc_id", "text"])
    linked = minhash.link(docs).select("root", "doc_id", "ta", "tb")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "ta", "tb")).alias("first")
    chosen = linked.where("root is not null").groupBy("root").agg(first).select("first.doc_id", "first.ta", "first.tb")
    wordless = linked.where("root is null").select("doc_id", "ta", "tb").distinct()
    kept = chosen.unionByName(wordless).toDF("_doc", "_ta", "_tb")
    keyed = docs.withColumns(
        {"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(1), F.col("text"))}
    )
    on = (
        keyed["doc_id"].eqNullSafe(kept["_doc"])
        & (keyed["_a"] == kept["_ta"])
        & (keyed["_b"] == kept["_tb"])
    )
    once = Window.partitionBy("doc_id", "_a", "_b").orderBy("_b")
    one = keyed.join(kept, on, "left_semi").withColumn("_nth", F.row_number().over(once))
    return one.where("_nth = 1").select(*names).toDF(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target asks."""
    return mixing.emit(docs, mixing.plan_copies(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: Tokens, models and sketches are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
