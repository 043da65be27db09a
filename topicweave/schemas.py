"""Column names and types shared by the whole library."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS_FILE = T.StructType(
    [
        T.StructField("created_at", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("screen_name", T.StringType()),
        T.StructField("edited_text", T.StringType()),
    ]
)

STATUS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("user", T.StructType([T.StructField("screen_name", T.StringType())])),
    ]
)

CORPUS_COLUMNS = ["doc_id", "created_at", "full_text", "screen_name", "edited_text"]

# Weekday is skipped: the parser does not read it back.
CREATED_AT_FORMAT = "MMM dd HH:mm:ss Z yyyy"
