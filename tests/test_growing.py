"""Streams and stores that grow page by page against one batch over everything."""

import json

import pytest
from pyspark.sql import functions as F

from topicweave.operators.counts import term_counts, vocabulary
from topicweave.sources import corpus as src
from topicweave.streaming import newest as nw
from topicweave.streaming.counting import FAN, CountStore, start_counting
from topicweave.streaming.ingest import start_ingest


def status(i, account, day=1):
    stamp = f"Sun May {day:02d} 16:00:00 +0000 2019"
    return {"id": i, "created_at": stamp, "full_text": f"text {i} of {account}", "user": {"screen_name": account}}


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def run(spark, landing, target, progress, **options):
    stream = nw.newest_stream(nw.read_status_stream(spark, str(landing), 1), **options)
    start_ingest(stream, str(target), str(progress)).awaitTermination()


def wanted(pages, n):
    best = {}
    for row in {r["id"]: r for page in pages for r in page}.values():
        best.setdefault(row["user"]["screen_name"], []).append(row["id"])
    return {a: sorted(ids, reverse=True)[:n] for a, ids in best.items()}


def got(spark, target, n):
    found = {}
    for r in nw.newest(spark, str(target), n).orderBy(F.desc("doc_id")).collect():
        found.setdefault(r.screen_name, []).append(r.doc_id)
        assert r.full_text == f"text {r.doc_id} of {r.screen_name}"
    return found


PAGES = [
    [status(i, "ab"[i % 2]) for i in range(100, 130)],
    [status(i, "ab"[i % 2]) for i in range(120, 150)],  # overlaps
    [status(i, "c") for i in range(5)] + [status(i, "ab"[i % 2]) for i in range(40, 60)],  # late
    [status(i, "ab"[i % 2]) for i in range(100, 130)],  # replayed
    [status(i, "a") for i in range(300, 340)],  # a busy account
]


@pytest.mark.parametrize("parts", [1, 4])
def test_newest_of_pages_in_any_order(spark, tmp_path, parts):
    n = 6
    landing, target, progress = tmp_path / "in", tmp_path / "out", tmp_path / "progress"
    for i, page in enumerate(PAGES):
        land(landing, f"p{i}.json", page)
        run(spark, landing, target, progress, n=n, parts=parts)
        assert got(spark, target, n) == wanted(PAGES[: i + 1], n)
    rows = spark.read.parquet(str(target))
    assert rows.count() == rows.select("doc_id").distinct().count()  # each status comes once
    # what a replayed or late page can't change is not written
    assert rows.where("doc_id between 40 and 59").count() == 0 if parts == 1 else True
    state = spark.read.format("statestore").load(str(progress))
    sizes = [r[0] for r in state.select(F.size("value.groupState.ids")).collect()]
    assert max(sizes) <= n and len(sizes) <= 3 * parts


def test_state_of_quiet_accounts_goes(spark, tmp_path):
    landing, target, progress = tmp_path / "in", tmp_path / "out", tmp_path / "progress"
    pages = [[status(1, "quiet", 1)], [status(2, "busy", 10)], [status(3, "busy", 20)], [status(4, "busy", 21)]]
    for i, page in enumerate(pages):
        land(landing, f"p{i}.json", page)
        run(spark, landing, target, progress, n=3, parts=1, keep_days=2)
    state = spark.read.format("statestore").load(str(progress))
    assert [r[0] for r in state.select("key.screen_name").collect()] == ["busy"]
    land(landing, "late.json", pages[0])  # comes again after its state has gone
    run(spark, landing, target, progress, n=3, parts=1, keep_days=2)
    assert got(spark, target, 3) == wanted(pages, 3)


def same_counts(store, corpus):
    cells = term_counts(corpus)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.cells) == rows(cells)
    sums = cells.groupBy("word").agg(F.sum("n"), F.count("*"))
    assert rows(store.words()) == rows(sums)
    assert rows(store.vocabulary()) == rows(vocabulary(cells))
    total = store.totals().first()
    assert (total.n, total.cells, total.docs) == (cells.agg(F.sum("n")).first()[0] or 0, cells.count(), corpus.count())
    joint = store.joint_distribution().agg(F.sum("x")).first()[0]
    assert joint == pytest.approx(1.0)


def test_pages_in_turn_equal_one_recount(spark, corpus, tmp_path):
    store = CountStore(spark, str(tmp_path / "store"))
    spans = [(1, 3), (2, 5), (4, 8)]  # documents that come again count once
    for page, (a, b) in enumerate(spans):
        store.add(corpus.where(F.col("doc_id").between(a, b)), page)
        same_counts(store, corpus.where(F.col("doc_id") <= b))
    store.add(corpus.limit(0), 3)
    store.add(corpus, 1)  # a complete page stays as it is
    same_counts(store, corpus)


def test_broken_page_is_counted_again(spark, corpus, tmp_path, monkeypatch):
    store = CountStore(spark, str(tmp_path / "store"))
    store.add(corpus.where("doc_id <= 3"), 0)
    write = CountStore._write

    def failing(self, rows, table, *parts):
        if table == "totals":
            raise RuntimeError("lost")
        write(self, rows, table, *parts)

    monkeypatch.setattr(CountStore, "_write", failing)
    with pytest.raises(RuntimeError):
        store.add(corpus.where("doc_id > 2"), 1)
    monkeypatch.setattr(CountStore, "_write", write)
    same_counts(store, corpus.where("doc_id <= 3"))
    store.add(corpus.where("doc_id > 2"), 1)
    same_counts(store, corpus)


def test_words_are_merged_in_levels(spark, tmp_path):
    store = CountStore(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([(i, f"word{i % 3} other") for i in range(FAN + 1)], "doc_id long, edited_text string")
    for i in range(FAN + 1):
        store.add(docs.where(F.col("doc_id") == i), i)
    assert store._live() == [(1, 0, FAN - 1), (0, FAN, FAN)]
    same_counts(store, docs)


def test_counting_stream(spark, tmp_path):
    landing = tmp_path / "in"
    store = CountStore(spark, str(tmp_path / "store"))
    for i, page in enumerate(PAGES[:2]):
        land(landing, f"p{i}.json", page)
    statuses = nw.read_status_stream(spark, str(landing), 1)
    stream = src.statuses_to_corpus(statuses)
    start_counting(stream, store, str(tmp_path / "progress")).awaitTermination()
    assert store.pages == [0, 1]
    rows = [r for page in PAGES[:2] for r in page]
    whole = spark.createDataFrame([(r["id"], r["full_text"]) for r in rows], "doc_id long, full_text string")
    same_counts(store, src.with_edited_text(whole.dropDuplicates(["doc_id"])))
