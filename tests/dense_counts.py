"""Brute-force counts and dense matrices that the tests compare with."""

import re

import numpy as np


def dense(corpus):
    """Brute-force counts: (words, doc ids, matrix)."""
    rows = corpus.select("doc_id", "edited_text").orderBy("doc_id").collect()
    tokens = {r.doc_id: re.findall(r"\w{2,}", r.edited_text.lower()) for r in rows}
    words = sorted({w for t in tokens.values() for w in t})
    docs = [r.doc_id for r in rows]
    x = np.array([[tokens[d].count(w) for d in docs] for w in words], dtype=float)
    return words, docs, x


def matrix(factor, key, names, column="p"):
    held = {r[key]: r[column] for r in factor.collect()}
    return np.array([held[n] for n in names])
