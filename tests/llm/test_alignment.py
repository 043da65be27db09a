import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from topicweave.llm import alignment


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.path_of(alignment.A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.path_of(alignment.B_FILE))


def letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 0
    for byte in range(256):
        if byte in own:
            table[chr(byte)] = byte
        else:
            table[chr(256 + extra)] = byte
            extra += 1
    return table


def token_bytes(both, text):
    a, b = both
    table = letters()
    e = a.encode(" " + text, add_special_tokens=False)
    x = [(i, bytes(table[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    y = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        y.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
        return [], []
    return x, y


def brute(both, rows):
    docs = []
    for _, text, *_ in rows:
        x, y = token_bytes(both, text) if text else ([], [])
        groups, i, j, at_a, at_b, own = [], 0, 0, 0, 0, ([], [])
        while i < len(x) or j < len(y):
            if at_a <= at_b:
                own[0].append(x[i][0])
                at_a += len(x[i][1])
                i += 1
            else:
                own[1].append(y[j][0])
                at_b += len(y[j][1])
                j += 1
            if at_a == at_b:
                groups.append(own)
                own = ([], [])
        docs.append((len(x), len(y), groups, [(p, q) for g in groups for p in g[0] for q in g[1]]))
    count = Counter(pair for d in docs for pair in set(d[3]))
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for (doc_id, *_), (n_a, n_b, groups, links) in zip(rows, docs, strict=True):
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((
            str(doc_id), n_a, n_b, len(groups), len(links), sum(count[k] == best[k[0]] for k in links),
            sum(count[k] for k in links), digest,
        ))
    return sorted(out)


def answer(frame):
    out = alignment.align(frame)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def test_documents(both, docs, rows, nothing):
    assert answer(docs) == brute(both, rows)
    assert answer(nothing) == []


ODD = [
    "a  b", "a\n b", "a\n  b", " lead", "trail ", "trail  ", "  ", " ", "\n", "\n\n", "x\n\n\ny z", "tab\t\ttab \t x",
    "a\xa0b", "a\n\n\xa0b c", "a　 b", "▁", "a ▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "'s 't don't I'll 've",
    "漢字 テスト é 😀😀 ​‍", "\x00\x01 \x1c x\x85y", "naïve café ﬁ Å İ", "1234 5,678.90 --- !!!", "a\r\nb\x0b\x0cc",
    "x" * 300, "ab" * 200 + " " + "q" * 70, "   many    spaces     here", "\U0001f468‍\U0001f469", "a" * 5 + "́" * 9,
]


def test_odd_texts(spark, both):
    rows = [(i, t) for i, t in enumerate(ODD * 2)]
    rows.append((None, " ".join(ODD)))
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, block long, keys string")
    assert answer(frame.repartition(3)) == brute(both, rows)


def test_units_and_stretches(both, monkeypatch):
    """Ids by units and by stretches are those of the whole text."""
    monkeypatch.setattr(alignment, "STRETCH", 40)
    monkeypatch.setattr(alignment, "KEPT_UNITS", 30)
    a, b = alignment.ByteLevel(alignment.path_of(alignment.A_FILE)), alignment.Pieces(alignment.path_of(alignment.B_FILE))
    assert a.fast is not None and b.by_units
    rng = random.Random(6)
    own = ["a", "The", "of", " ", " ", "  ", "\n", "\t", "é", "'s", ".", "12", "漢", "straße", "\r\n", "\xa0", "\x1c", "ԱՅ", "😀", "a" * 600]
    for _ in range(400):
        text = "".join(rng.choice(own) for _ in range(rng.randrange(1, 90)))
        x, y = token_bytes(both, text)
        parts = list(alignment.stretches(" " + text))
        assert "".join(parts) == " " + text
        got = [[i for p in parts for i in a.ids(p).tolist()], [i for p in parts for i in b.ids(p, p.encode()).tolist()]]
        assert got == [[i for i, _ in x], [i for i, _ in y]]


def test_long_documents_merge(both, monkeypatch):
    """Many stretches of one document, and large groups, against one piece."""
    a, b = alignment.sides(alignment.path_of(alignment.A_FILE), alignment.path_of(alignment.B_FILE))
    rng = random.Random(7)
    text = " " + " ".join(rng.choice(["the", "xyzzyqq", "漢字漢字", "naïve", "x" * 40]) for _ in range(400))

    def found(stretch, large):
        monkeypatch.setattr(alignment, "STRETCH", stretch)
        monkeypatch.setattr(alignment, "LARGE_GROUP", large)
        doc = alignment.Document(1)
        texts = [(a.ids(p), b.ids(p, p.encode())) for p in alignment.stretches(text)]
        for part in alignment.Aligned(a, b, texts).parts():
            doc.add(*part)
        keys, times = doc.links()
        return doc.numbers.tolist(), doc.digest.hexdigest(), keys.tolist(), times.tolist()

    whole = found(1 << 20, 4096)
    assert found(50, 4096) == whole and found(50, 1) == whole and found(1 << 20, 0) == whole


def test_gallop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        target = np.unique(rng.integers(0, 300, rng.integers(1, 80)))
        driver = np.unique(rng.integers(0, 300, rng.integers(1, 60)))
        finger = rng.integers(0, len(target), len(driver))
        assert alignment.gallop(driver, target, finger).tolist() == np.searchsorted(target, driver).tolist()
