"""Top rows per group without one huge group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this many rows per group Spark itself cuts each map task's groups before
# the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
BUILT_IN_LIMIT = 1000
SALTS = 64


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group as ``rank`` 1..n.

    Beyond the built-in cut, a salted first round leaves at most ``SALTS * n`` rows
    of a group for the final ranking, so a hot group is never sorted in one task.
    """
    if n > BUILT_IN_LIMIT:
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
            .withColumn("_rank", F.row_number().over(salted))
            .where(F.col("_rank") <= n)
            .drop("_salt", "_rank")
        )
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= n)
