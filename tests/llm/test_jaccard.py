import re

import numpy as np
import pytest

from attesta.llm import jaccard


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, k, percent):
    """doc_id -> (size, component), by all pairs."""
    sets = [(d, shingles(t, k)) for d, t in docs if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets}


def corpus(seed=3, n=160):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 60))
    docs, base = [], None
    for i in range(n):
        if i % 8 == 0 or base is None:
            base = list(rng.choice(words, rng.integers(3, 90)))
        w = list(base)
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(len(w))] = rng.choice(words)
        text = " ".join(w)
        if i % 5 == 0:
            text += "\n" + passage
        docs.append((i, text.upper() if i % 7 == 0 else text))
    hot = list(rng.choice(words, 120))
    for i in range(120):  # a chain of near copies: neighbours link, ends do not
        hot[i] = f"x{i}"
        docs.append((1000 + i, " ".join(hot)))
    return docs


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_matches_all_pairs(spark, k, percent):
    docs = corpus()
    rows = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(docs, k, percent)


def test_without_star_rounds_the_matrix_finds_all(spark):
    docs = corpus(9, 80)
    rows = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85, stars=0).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(docs, 4, 85)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_words_that_a_polynomial_confuses(spark):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2**64, and nothing in common here."""
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    docs = [(1, x), (2, y), (3, " ".join([x] * 9)), (4, " ".join([y] * 9)), (5, x.upper())]
    rows = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(docs, 4, 85)


def test_exact_where_hashes_lie(monkeypatch):
    """With a word hash of two bits all sets are still exact."""
    real = jaccard.word_hashes

    def poor(data, offsets):
        h, row, start, end = real(data, offsets)
        return h & np.uint64(3), row, start, end

    monkeypatch.setattr(jaccard, "word_hashes", poor)
    texts = [t.encode() for _, t in corpus(5, 40)] + [b"", b"A b", b"a B"]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    row, key = jaccard.exact_sets(np.frombuffer(b"".join(texts), np.uint8), offsets, 4)
    mine = [set(key[row == i].tolist()) for i in range(len(texts))]
    want = [shingles(t.decode(), 4) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(mine[i] & mine[j]) == len(want[i] & want[j])


def test_odd(spark, odd, none):
    rows = jaccard.jaccard_components(odd, 4, 85).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None) == [
        (1, 5, 1), (2, 5, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (5, 1, 5), (7, 4, 7), (8, 4, 8),
    ]
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert jaccard.jaccard_components(none, 4, 85).count() == 0
