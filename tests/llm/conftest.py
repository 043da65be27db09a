import random

import pytest

# Extra columns carry names that operators use for their own results.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " size long, kept string, row long, node long, `a.b` string, _at long, copies long"
)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def _rows():
    rng = random.Random(5)
    base = words(rng, 120)
    shared = words(rng, 60)
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "  ", 1)), (4, None), (5, ""), (6, " \t\n"),
        (7, "one two"), (8, "one two"), (9, "One TWO three"), (10, f"{words(rng, 30)} {shared}"),
        (11, f"{shared} {words(rng, 200)}"), (12, "é" * 700 + "\n" + "z" * 700), (13, words(rng, 40_000)),
        (14, "same long line for all of them\n" * 4), (15, "Same long line for all of them \nother"),
        (16, "  same LONG line for all of them\n\nend"), (17, "a-b ### $$$ 12345 !!! " * 30),
        (18, "x" * 5000), (19, base + " tail"), (None, "no id at all here today"), (20, words(rng, 80)),
        (20, words(rng, 80)), (21, "twice the same row"), (21, "twice the same row"),
        (22, "𝄞 astral " * 40), (23, "á é ß İ Σας ﬁ x\x1cy <|endoftext|> it's 42 ümlaut"),
    ]
    for k in range(24, 60):
        own = words(rng, rng.randrange(5, 150))
        texts.append((k, own))
    sources = ["s1", "s2", None, "S3"]
    return [
        (i, t, ["en", "de", None, "fr", "es"][k % 5], sources[k % 4], None if t is None else len(t),
         k, "x", k, -k, "p", 7, 3)
        for k, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id < -5")


@pytest.fixture(scope="session")
def labels(spark):
    from pyspark.sql import functions as F

    rows = [(k, k % 2, int(k % 5 == 0)) for k in range(1, 60)] + [(None, 1, 1), (9999, 0, 1), (30, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("label"))
