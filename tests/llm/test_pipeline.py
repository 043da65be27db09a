import corpus_pipeline


def test_stages(docs, labels, tmp_path, spark):
    folder = str(tmp_path)
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    held = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, held, folder).write.parquet(f"{folder}/{name}")
        held = spark.read.parquet(f"{folder}/{name}")
        assert held.columns == docs.columns, name
        assert held.count() > 10
        if name == "near_dedup":
            texts = [r.text for r in held.collect()]
            shared = [t for t in texts if t and len(t.split()) > 0]
            assert len(shared) == len(set(shared))
    packed = corpus_pipeline.STAGES[-1][1](spark, held, folder)
    assert packed.where("piece = 0").count() == held.count()
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_one_document_of_each_group(spark, tmp_path):
    """Also where ids repeat or are absent; brute force over all pairs."""
    import random

    rng = random.Random(2)
    base = [f"t{rng.randrange(900)}" for _ in range(80)]
    near = lambda k: " ".join(base[:k] + ["other"] + base[k + 1 :])
    far = [" ".join(f"f{rng.randrange(900)}" for _ in range(40)) for _ in range(3)]
    rows = [
        (1, near(40)), (1, near(41)), (5, near(42)), (None, near(43)),  # one group, one id twice
        (None, far[0]), (None, far[0] + " tail"), (None, far[1]), (None, far[1]),  # groups without ids
        (7, far[2]), (7, far[2]), (7, "quite another text of six words"),
        (8, None), (9, ""), (None, " "), (8, None),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")
    out = corpus_pipeline.near_dedup(spark, docs.repartition(3), str(tmp_path))
    assert out.columns == ["doc_id", "text", "root"]

    def grams(t):
        w = (t or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = grams(rows[a][1]), grams(rows[b][1])
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    got = [(r.doc_id, r.text) for r in out.collect()]
    worded = [r for r in got if grams(r[1])]
    of = {r: group[k] for k, r in enumerate(rows)}
    assert sorted(of[r] for r in worded) == sorted({g for g, r in zip(group, rows) if grams(r[1])})
    for doc_id, text in worded:
        ids = [r[0] for g, r in zip(group, rows) if g == of[doc_id, text] and r[0] is not None]
        assert doc_id == min(ids, default=None)
    assert sorted(map(str, (r for r in got if not grams(r[1])))) == ["(8, None)", "(9, '')", "(None, ' ')"]


def test_empty(nothing, labels, tmp_path, spark):
    folder = str(tmp_path)
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{folder}/labels.parquet")
    held = nothing
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, folder)
        assert held.count() == 0


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
