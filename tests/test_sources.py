import json

import pytest
from pyspark.sql import functions as F

from topicweave.engine import TopicEngine
from topicweave.operators import report
from topicweave.sources import corpus as src
from topicweave.streaming.ingest import start_ingest, stream_statuses

ROWS = [
    "created_at\tfull_text\tscreen_name\tedited_text",
    "Sun May 19 16:22:00 +0000 2019\t\"She said \"\"hello there\"\" today\"\tacc_a\thello today",
    "Sun May 19 16:20:00 +0000 2019\t\"first line\nsecond line\"\tacc_b\tfirst line second",
    "Sun May 19 16:18:00 +0000 2019\tRT @x: niño \U0001f600 “cita” https://t.co/abc\tacc_a\tniño",
    "bad date\t\tacc_b\t",
]


def statuses(n):
    return [
        {
            "id": 100 + i,
            "created_at": f"Sun May 19 16:{i:02d}:00 +0000 2019",
            "full_text": f"text number {i} engine",
            "user": {"screen_name": "acc_a" if i % 3 else "acc_b"},
        }
        for i in range(n)
    ]


def test_read_corpus(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_bytes("\r\n".join(ROWS).encode() + b"\r\n")
    got = src.read_corpus(spark, str(path))
    rows = got.orderBy("doc_id").collect()
    assert len(rows) == 4 and len({r.doc_id for r in rows}) == 4
    assert rows[0].full_text == 'She said "hello there" today'
    assert rows[1].full_text == "first line\nsecond line"
    assert rows[2].edited_text == "niño"
    assert src.text_column(got).where("edited_text is null").count() == 0
    stamps = [r.created_ts for r in src.with_timestamp(got).orderBy("doc_id").collect()]
    assert stamps[0].hour == 16 and stamps[3] is None


def test_write_then_read_corpus(spark, corpus, tmp_path):
    path = str(tmp_path / "out")
    df = corpus.withColumn("created_at", F.lit("x"))
    quirky = df.withColumn("full_text", F.concat(F.lit('say "hi"\nthen\t'), "full_text"))
    src.write_corpus(quirky, path)
    back = src.read_corpus(spark, path)
    assert sorted(r.full_text for r in back.collect()) == sorted(
        r.full_text for r in quirky.collect()
    )


def _file(folder, name, texts):
    folder.mkdir(exist_ok=True)
    lines = ["created_at\tfull_text\tscreen_name\tedited_text", *[f"d\t{t}\ta\t" for t in texts]]
    (folder / name).write_text("\n".join(lines) + "\n")


def _ids(corpus):
    return {r.full_text: r.doc_id for r in corpus.collect()}


@pytest.mark.parametrize("multi_line", [True, False])
def test_ids_follow_files_and_places(spark, tmp_path, multi_line, monkeypatch):
    """Also where Spark packs small files into tasks by size, or cuts a large one."""
    folder = tmp_path / "in"
    sizes = {"c.csv": 3, "a.csv": 700, "b.csv": 40, "d.csv": 0, "e.csv": 1}
    for name, n in sizes.items():
        _file(folder, name, [f"{name} {i}" for i in range(n)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = _ids(src.read_corpus(spark, str(folder), multi_line=multi_line))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"{name} {i}" for name in sorted(sizes) for i in range(sizes[name])]
    assert got == {t: i for i, t in enumerate(want)}
    monkeypatch.setattr(src, "SENT_BLOCKS", 0)
    assert _ids(src.read_corpus(spark, str(folder), multi_line=multi_line)) == got


def test_added_files_keep_the_other_ids(spark, tmp_path):
    folder, manifest = tmp_path / "in", str(tmp_path / "files")
    read = lambda: _ids(src.read_corpus(spark, str(folder), manifest=manifest))
    _file(folder, "m.csv", ["m0", "m1"])
    _file(folder, "p.csv", ["p0"])
    first = read()
    assert first == {"m0": 0, "m1": 1, "p0": 2} and read() == first
    _file(folder, "a.csv", ["a0", "a1"])
    _file(folder, "z.csv", ["z0"])
    assert read() == first | {"a0": 3, "a1": 4, "z0": 5}
    (folder / "p.csv").unlink()
    _file(folder, "b.csv", ["b0"])
    assert read() == {"m0": 0, "m1": 1, "a0": 3, "a1": 4, "z0": 5, "b0": 6}
    _file(folder, "m.csv", ["m0", "m1", "m2"])
    with pytest.raises(ValueError):
        read()


def test_generate_corpus(spark, tmp_path):
    pages = [statuses(30)[:20], statuses(30)[19:]]
    for i, page in enumerate(pages):
        (tmp_path / f"p{i}.json").write_text("\n".join(json.dumps(s) for s in page))
    raw = src.read_statuses(spark, str(tmp_path))
    assert raw.count() == 30
    engine = TopicEngine(spark)
    engine.generate_corpus(raw.unionByName(raw), ["acc_a"], 5, str(tmp_path / "saved"))
    rows = engine.get_corpus().orderBy(F.desc("doc_id")).collect()
    assert [r.doc_id for r in rows] == [129, 128, 126, 125, 123]
    assert rows[0].edited_text == "text number 29 engine"
    assert src.read_corpus(spark, str(tmp_path / "saved")).count() == 5


def test_accounts_as_a_table(spark, corpus):
    wanted = spark.createDataFrame([("a",), ("a",), ("zz",)], "screen_name string")
    assert {r.doc_id for r in src.keep_accounts(corpus, wanted).collect()} == {1, 2, 3}


@pytest.mark.parametrize("late_by", [None, "1 day"])
def test_stream_stores_every_status_once(spark, tmp_path, late_by):
    landing = tmp_path / "landing"
    landing.mkdir()
    where = [str(tmp_path / "corpus"), str(tmp_path / "progress")]
    for i, page in enumerate([statuses(30)[:20], statuses(30)[15:]]):
        (landing / f"p{i}.json").write_text("\n".join(json.dumps(s) for s in page))
        start_ingest(stream_statuses(spark, str(landing), late_by), *where).awaitTermination()
    stored = spark.read.parquet(where[0])
    assert sorted(r.doc_id for r in stored.collect()) == list(range(100, 130))
    assert stored.where("edited_text = 'text number 7 engine'").count() == 1


def test_summary_file_holds_all_topics(spark, tmp_path):
    words = spark.createDataFrame([("a", [0.7, 0.1]), ("b", [0.3, 0.9])], "word string, p array<double>")
    path = str(tmp_path / "summary")
    src.write_summary(report.topic_summary(words, 2), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ["Topic #0: a b", "Topic #1: b a"]
    with pytest.raises(ValueError):
        src.write_summary(report.topic_summary(words, 2), 5)
