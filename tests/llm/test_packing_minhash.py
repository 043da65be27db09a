import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from topicweave.llm import minhash, packing, tokens

CAPACITY = 128


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t


def test_tokens_equal_the_library(rows, whole, monkeypatch):
    own = tokens.WordTokenizer(tokens.default_path())
    monkeypatch.setattr(tokens, "STRETCH", 50)
    odd = ["don't DON'T we'll", "ÀÉß ßa aß", "x\x1cy\x1dz a", "it's 1234 5,6", "漢字 テスト é é ǅ ΟΔΟΣ", "a_b-c--d", "\x00\x7f​", "  "]
    for text in [r[1] for r in rows if r[1] and len(r[1]) < 20_000] + odd:
        got = np.frombuffer(b"".join(own.encode(text)), dtype="<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids, text[:80]


def test_other_tokenizer_files(rows):
    """A file with other settings is used as its library does."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = tokens.WordTokenizer(path), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    assert tokens.WordTokenizer(tokens.default_path()).shortcut and not own.shortcut
    for text in [r[1] for r in rows if r[1] and len(r[1]) < 2_000]:
        got = np.frombuffer(b"".join(own.encode(text)), dtype="<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(docs, rows, whole, nothing):
    out = packing.pack(docs, capacity=CAPACITY, per_task=40).collect()
    expected = []
    for i, t, *_ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), CAPACITY)):
            piece = np.array(ids[start : start + CAPACITY], dtype="<u4")
            expected.append((str(i), k, start, len(piece), zlib.crc32(piece.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(expected)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert packing.pack(nothing).count() == 0


def test_sum_of_squares_rule():
    """Each place against all choices written out."""
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 21, 300))[::-1]
    sequence, offset = packing.sum_of_squares(lengths, 20)
    gaps = {}
    for size, own, at in zip(map(int, lengths), sequence, offset):
        def total(g):
            counts = defaultdict(int)
            for x in g.values():
                if x:
                    counts[x] += 1
            return sum(c * c for c in counts.values())

        choices = {total({**gaps, k: g - size}) for k, g in gaps.items() if g >= size}
        choices.add(total({**gaps, "new": 20 - size}))
        assert gaps.get(own, 20) == 20 - at
        gaps[own] = gaps.get(own, 20) - size
        assert total(gaps) == min(choices)
    assert sequence.max() + 1 <= 1.1 * lengths.sum() / 20


@pytest.mark.parametrize("per_task", [20_000, 5_000])
def test_few_sequences(per_task):
    """Close to the least number that the sizes allow, in one task and in several."""
    rng = np.random.default_rng(6)
    lengths = np.concatenate([rng.integers(1, 2049, 6_000), rng.geometric(1 / 250, 14_000).clip(1, 2048)])
    rng.shuffle(lengths)
    used = 0
    for first in range(0, len(lengths), per_task):
        own = lengths[first : first + per_task]
        order = packing.placing_order(own, np.arange(len(own)) + first, 2048)
        assert sorted(order) == list(range(len(own)))
        used += packing.sum_of_squares(own[order], 2048)[0].max() + 1
    assert used <= 1.005 * -(-lengths.sum() // 2048)
    again = packing.placing_order(lengths[:50], np.arange(50), 2048)
    assert (again == packing.placing_order(lengths[:50], np.arange(50), 2048)).all()


def sets(rows):
    out = []
    for i, t, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        n = min(5, len(w))
        out.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    return out


def brute(rows):
    own = sets(rows)
    parent = list(range(len(own)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(own):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(s), str(least.get(find(k)) if s else i)) for k, (i, s) in enumerate(own))


def got(out):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out)


def test_near_duplicates(docs, rows, nothing):
    out = minhash.link(docs).collect()
    assert got(out) == brute(rows)
    assert all(r.kept == (r.component_id == r.doc_id) for r in out)
    assert minhash.link(nothing).count() == 0


@pytest.mark.parametrize("small", [64, 3])
def test_families_with_open_buckets(spark, small, monkeypatch):
    """Copies with growing edits, so that families hold near and not quite near pairs; also
    with buckets in several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", small)
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        base = [f"t{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 150]))]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 18))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    out = minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert got(out) == brute(rows)


@pytest.mark.parametrize("order", ["rising", "random", "star"])
def test_components_take_few_turns(spark, order):
    """Chains in the worst order, and in any, end after a logarithmic number of turns."""
    from topicweave.session import Scratch

    n = 400
    path = [*range(2, n + 1), 1]
    if order == "random":
        random.Random(3).shuffle(path)
    pairs = list(zip(path, path[1:])) if order != "star" else [(k, n) for k in range(1, n)]
    pairs += [(1000 + k, 1001 + k) for k in range(0, 60, 2)]  # and some other components
    scratch, turns = Scratch(spark, "turns"), []
    write = scratch.slot
    scratch.slot = lambda df, name, turn: turns.append(turn) or write(df, name, turn)
    found = minhash.components(spark.createDataFrame(pairs, "a long, b long"), scratch, "t").collect()
    roots = {r.node: r.root for r in found}
    assert all(roots[k] == 1 for k in range(1, n + 1))
    assert all(roots[1000 + k] == 1000 + k - k % 2 for k in range(60))
    assert max(turns) <= 2 * np.log2(n) + 4


def test_estimate():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        found = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            k = int(1000 * share)
            a, b = both[: k + (1000 - k) // 2], np.concatenate([both[:k], both[k + (1000 - k) // 2 :]])
            r = [minhash.registers(x)[None, :] for x in (a, b)]
            found.append(minhash.estimate(*r, np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(found) - share) < 0.03
