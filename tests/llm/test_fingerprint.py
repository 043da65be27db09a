import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from topicweave.llm import fingerprint as fp


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.integers(0, 59), st.integers(0, 59))
def test_extensions(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    x, y = fp.Prefixes(fp.codes(a)), fp.Prefixes(fp.codes(b))
    right = 0
    while i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
        right += 1
    left = 0
    while left < min(i, j) and a[i - left - 1] == b[j - left - 1]:
        left += 1
    assert fp.extension(x, i, y, j) == right
    assert fp.extension_left(x, i, y, j) == left


def test_likeness():
    of = lambda t: fp.Prefixes(fp.codes(t))
    rng = np.random.default_rng(1)
    text = "".join(chr(c) for c in rng.integers(97, 123, 4000))
    assert fp.likeness(of(""), of("")) == 1 and fp.likeness(of("a"), of("")) == 0
    assert fp.likeness(of(text), of(text)) == 1
    period = text[:40] * 100
    for t in (text, period):
        edited = list(t)
        for i in rng.integers(0, 4000, 8):
            edited[i] = "#"
        assert fp.likeness(of(t), of("".join(edited))) > 0.9
    assert fp.likeness(of(text), of("".join(rng.permutation(list("".join(map(chr, range(300, 3300)))))))) == 0


def _of(text):
    return fp.Prefixes(fp.codes(text))


def test_likeness_of_moved_spans():
    rng = np.random.default_rng(2)
    parts = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in (100, 3000, 900)]
    a = "".join(parts)
    for order in ((1, 2, 0), (2, 1, 0), (0, 2, 1), (1, 0, 2)):
        b = "".join(parts[k] for k in order)
        assert fp.likeness(_of(a), _of(b)) == 1
    line = "".join(chr(c) for c in rng.integers(97, 123, 80))
    x, y = (line + a + "!" * 80), ("?" * 80 + a + line)
    assert fp.likeness(_of(x), _of(y)) == (len(a) + 80) / len(x)


def test_likeness_of_short_runs():
    rng = np.random.default_rng(3)
    runs = ["".join(chr(c) for c in rng.integers(97, 123, 40)) for _ in range(60)]
    for n in (3, 60):
        a, b = "#####".join(runs[:n]), "$$$$$".join(runs[:n])
        assert fp.likeness(_of(a), _of(b)) == 40 * n / len(a)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=8), st.lists(st.integers(0, 5), max_size=8), st.integers(0, 9))
def test_likeness_counts_all_windows(first, second, seed):
    rng = np.random.default_rng(seed)
    parts = ["".join(chr(c) for c in rng.integers(97, 99, n)) for n in (1, 20, 24, 30, 47, 60)]
    a, b = ("".join(parts[k] for k in own) for own in (first, second))
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    last = 0
    while last < min(len(a), len(b)) - start and a[-1 - last] == b[-1 - last]:
        last += 1
    middles = [t[start : len(t) - last] for t in (a, b)]
    grams = [{t[i : i + fp.WINDOW] for i in range(len(t) - fp.WINDOW + 1)} for t in middles]
    counts = []
    for t in middles:
        hit = set()
        for i in range(len(t) - fp.WINDOW + 1):
            if t[i : i + fp.WINDOW] in grams[0] & grams[1]:
                hit.update(range(i, i + fp.WINDOW))
        counts.append(len(hit))
    expected = (start + last + min(counts)) / max(len(a), len(b)) if a or b else 1
    assert fp.likeness(_of(a), _of(b)) == expected == fp.likeness(_of(b), _of(a))


def test_documents(docs, rows, nothing):
    out = fp.fingerprints(docs).collect()
    assert len(out) == len(rows)
    # Ids once: neighbours are known; ids 20, 21 repeat and are checked as sets.
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    texts = [r[1] or "" for r in ordered]
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    for k, (doc_id, *_) in enumerate(ordered):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        assert len(text) in {r.n_chars for r in got[doc_id]}
        if doc_id in (19, 20, 21):
            continue
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        (r,) = got[doc_id]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        assert 0 <= r.near_next <= 1 and r.near_edited >= 0.5 - 1e-9
    same = {}
    for i, t, *_ in rows:
        if i not in (20,):
            same.setdefault(t or "", set()).update(r.fingerprint for r in got[i])
    assert all(len(v) == 1 for v in same.values())
    assert len({next(iter(v)) for v in same.values()}) == len(same)
    assert fp.fingerprints(nothing).count() == 0
    one = docs.where("doc_id = 7")
    assert fp.fingerprints(one).first().near_next == 1
    assert fp.fingerprints(docs.where("doc_id is null")).count() == 1
