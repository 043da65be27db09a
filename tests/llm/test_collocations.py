import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from topicweave.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            longer = [q for q in cand if len(q) > len(p) and p in (q[:2], q[1:]) and 100 * cand[q] >= 50 * a]
            if longer:
                continue
            cut = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-cut[0], -a, " ".join(p).encode(), own[p[: cut[1]]], own[p[cut[1] :]]))
        for r, (s, a, p, x, y) in enumerate(sorted(found)[:top]):
            out.append((lang, r + 1, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def texts(rng, n=120):
    common = ["The old town", "new york city", "a b", "straße Über ƒoo", "x\x00y z\x1cq", "of the", "\t\ttab gap", "of"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            parts.append(rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(40)}")
            parts.append(rng.choice([" ", " ", " ", "  ", ", ", "\n", " . ", "\r\n", "!", "\t"]))
        rows.append(("".join(parts), rng.choice(["en", "en", "en", None, "und", "de"])))
    return rows + [(None, "en"), ("", "en"), (" \t\n", None), ("of the " * 3000, "en"), rows[0], rows[0], ("solo", "fr")]


def answer(spark, rows, **options):
    frame = spark.createDataFrame([(t, g, 1, "x", 2) for t, g in rows], "text string, lang string, n long, phrase string, rank int")
    out = collocations.collocations(frame.repartition(3), **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("held,burst,stretch", [(1_500_000, 4096, 1 << 20), (60, 3, 90)])
def test_equals_brute_force(spark, held, burst, stretch):
    """Also with a trie that bursts and spills all the time and texts cut into short stretches."""
    own = collocations.Limits(words=held, phrases=held, burst=burst, stretch=stretch, spread=2)
    rows = texts(random.Random(4))
    want = brute(rows)
    assert len(want) > 20 and any(len(r[2].split(" ")) == 3 for r in want)
    assert answer(spark, rows, limits=own) == want
    assert answer(spark, rows, top=5) == brute(rows, top=5)


def test_false_hits_of_the_filter_change_nothing(spark):
    own = collocations.Limits(filter_bits=64)
    rows = texts(random.Random(5), 60)
    assert answer(spark, rows, least=4, limits=own) == brute(rows, 4)


def test_empty(spark):
    assert answer(spark, []) == []
    assert answer(spark, [(None, None), ("", "en")]) == []
    assert answer(spark, [("a b " * 9, "en")]) == []


def test_trie_counts():
    rng = np.random.default_rng(3)
    trie, want = collocations.HatTrie(3, 4), Counter()
    for _ in range(20):
        ids = rng.integers(1, 9, (200, 3))
        keys = (ids[:, 0] << 42) + (ids[:, 1] << 21) + ids[:, 2]
        trie.add(keys)
        want.update(keys.tolist())
    assert trie.entries == len(want)
    assert any(isinstance(c, collocations.Inner) for c in trie.root.values())
    first = trie.spill(trie.entries // 2)
    assert 0 < trie.entries <= len(want) // 2
    assert not {k >> 42 for k in first[0].tolist()} & set(trie.root)  # whole subtrees
    got = Counter()
    for keys, counts in [first, trie.spill(0)]:
        got.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert got == want and trie.entries == 0
