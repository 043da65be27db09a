"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Spark then drops the shuffle files of a finished write.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_scratch: str | None = None


def build_session(
    app_name: str = "topicweave",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings this library is tested under."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without one: it gets a temporary folder.
    """
    global _own_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
    if _own_scratch is None:
        _own_scratch = tempfile.mkdtemp(prefix="topicweave-")
    return _own_scratch


class Scratch:
    """Tables of one job, each in its own folder under the shared scratch folder.

    Writing a table cuts the lineage and outlives lost executors. ``slot`` tables
    alternate between two folders, so a loop keeps two copies however long it runs.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{scratch_root(spark)}/topicweave/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        where = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        # a loop's shuffle files would stay until the driver happens to collect its garbage
        before = self.spark.conf.get(FILE_CLEANUP, None)
        self.spark.conf.set(FILE_CLEANUP, "true")
        try:
            writer.parquet(where)
        finally:
            self.spark.conf.unset(FILE_CLEANUP) if before is None else self.spark.conf.set(FILE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(where)

    def settled(self, df: DataFrame, name: str, when: bool) -> DataFrame:
        """The same rows, written first if asked: later steps then read plain columns
        instead of repeating the expressions behind them per element.
        """
        return self.write(df, name) if when else df

    def slot(
        self, df: DataFrame, name: str, turn: int, partition_by: str | None = None
    ) -> DataFrame:
        return self.write(df, f"{name}-{turn % 2}", partition_by)
