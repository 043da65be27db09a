import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from topicweave.llm import linededup, rules

WHITE = " \t\n\x0b\x0c\r"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def test_lines(docs, rows, nothing):
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(-1 if i is None else i)
    expected = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [
            x for x in lines
            if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != (-1 if i is None else i))
        ]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        expected.append((str(i), len(lines), len(lines) - len(kept), digest))
    found = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    out = found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.array_join("kept_lines", "\n").cast("binary"), 256).alias("h"))
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in out.collect()) == sorted(expected)
    assert sum(e[2] for e in expected) >= 5
    assert set(docs.columns) < set(found.columns)
    empty = linededup.keep_bitmaps(nothing)
    assert empty.count() == 0 and linededup.apply_bitmaps(nothing, empty).count() == 0


def test_bitmaps_of_many_lines(spark):
    lines = [f"line number {k} is repeated everywhere" for k in range(200)]
    texts = [(1, "\n".join(lines)), (2, "\n".join(lines[::2])), (3, "\n".join(lines[1::3])), (4, "\n".join(lines[::6]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs)).orderBy("doc_id").collect()
    count, last = Counter(), {}
    for i, t in texts:
        for x in t.split("\n"):
            count[x] += 1
            last[x] = i
    for r, (i, t) in zip(out, texts):
        assert r.kept_lines == [x for x in t.split("\n") if count[x] < 3 or last[x] == i]


def base(t):
    w = [x for x in GAP.split(t) if x]
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(runs)
    covered = {i + k for i, x in enumerate(runs) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.strip(WHITE)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_rules(docs, rows, nothing):
    judged = rules.judge(docs)
    assert judged.columns == [c for c in docs.columns if c not in rules.RESULTS] + rules.RESULTS
    out = judged.collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == sorted((str(i), *base(t or "")) for i, t, *_ in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules.judge(nothing).count() == 0


def test_strays_go_and_clean_stay(spark):
    clean = "the house of the man is in a town and it was built by him for this family that " * 1
    rows = [(i, " ".join(f"{clean} n{i}w{k}" for k in range(12)), "en") for i in range(20)]
    junk = " ".join(f"Q{k}#$%&*#$%" for k in range(120))
    rows.append((99, junk, "en"))
    rows.append((100, junk[:60], "en"))
    own = rules.Rules(max_repeat_percent=1000)
    out = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), own).collect()}
    assert all(out[i].kept for i in range(20)) and not out[99].kept and not out[99].base_failed
    p = [0.5, 0.5, 0.0]
    d = spark.range(1).select(rules.distance(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), p)).first()[0]
    # JS of (1,0,0) and (.5,.5,0): m = (.75,.25,0)
    import math

    js = 0.5 * math.log2(1 / 0.75) + 0.5 * (0.5 * math.log2(0.5 / 0.75) + 0.5 * math.log2(0.5 / 0.25))
    assert d == pytest.approx(math.sqrt(js))


def test_no_common_words(spark):
    import random

    draw = random.Random(3)
    invent = lambda: "".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(2, 4)))
    common = rules.COMMON_WORDS["en"]
    clean = lambda n: " ".join(draw.choice(common) if draw.random() < 0.21 else invent() for _ in range(n))
    rows = [(i, clean(300), "en") for i in range(40)]
    rows += [(50, " ".join(invent() for _ in range(300)), "en"), (51, " ".join(invent() for _ in range(99)), "en")]
    judged = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in judged.collect()}
    assert all(out[i].kept for i in range(40))
    assert not out[50].kept and not out[50].base_failed and out[50].class_distance < 0.25
    assert out[51].kept  # below the guard, distances decide nothing
