import hashlib
import random

import numpy as np
import pytest

from attesta.llm import suffix


def covered(texts, length):
    """Per text the mask of bytes in strings of ``length`` bytes that start more than once."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m)
    return out


def expected(docs, length):
    raw = [(t or "").encode() for _, t in docs]
    rows = []
    for (d, _), t, m in zip(docs, raw, covered(raw, length), strict=True):
        rows.append((d, len(t), int(m.sum()), len(suffix.runs(m)), hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(rows, key=str)


def got(spark, docs, length=200):
    df = docs if hasattr(docs, "columns") else spark.createDataFrame(docs, "doc_id long, text string")
    rows = suffix.remove_repeats(df, length).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in rows), key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_matches_brute_force(spark):
    rng = random.Random(4)
    shared = [words(rng, n) for n in (30, 33, 60, 120, 300)]
    docs = [(i, " ".join(words(rng, rng.randint(1, 60)) if rng.random() < 0.6 else rng.choice(shared)[rng.randint(0, 40) :] for _ in range(4))) for i in range(120)]
    docs += [(500, docs[0][1]), (501, "la " * 400), (502, "la " * 90), (503, "x" * 199), (504, "x" * 200), (505, "y" * 201)]
    assert got(spark, docs) == expected(docs, 200)


@pytest.mark.parametrize("kinds", [8, 1])
def test_very_many_kinds_of_one_anchor(spark, monkeypatch, kinds):
    """With 1 every anchor is split until its parts are single windows."""
    monkeypatch.setattr(suffix, "KINDS", kinds)
    rng = random.Random(6)
    passage = words(rng, 90)
    docs = [(i, words(rng, 12) + " " + passage + " " + words(rng, 12)) for i in range(60)]
    assert got(spark, docs) == expected(docs, 200)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 500)
    rng = random.Random(8)
    base = words(rng, 200)
    docs = [(i, base[: 100 * i + 150] + words(rng, 30)) for i in range(14)]
    assert got(spark, docs) == expected(docs, 200)


def test_text_above_16_mib(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    one, two, three = letters(1000), letters(700), letters(400)
    at_edge = letters((1 << 22) - 300)
    long = at_edge + "1" + one + "2" + letters((17 << 20) - len(at_edge)) + "3" + two + "4" + three + "5"
    docs = [(1, long), (2, "6" + one + "7" + letters(50)), (3, letters(50) + "8" + two + "9"), (4, "A" + three + "B")]
    removed = {d: (n, k) for d, _, n, k, _ in got(spark, docs)}
    assert removed == {1: (2100, 3), 2: (1000, 1), 3: (700, 1), 4: (400, 1)}


def test_parts_hold_each_window_once_and_equal_windows_together():
    rng = random.Random(9)
    passage = words(rng, 120).encode()
    texts = [words(rng, 15).encode() + passage[rng.randint(0, 300) :] for _ in range(40)]
    row, start, many, anchor, _ = suffix.segments(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]), 200)
    cuts = [texts[r][s : s + m + 199] for r, s, m in zip(row.tolist(), start.tolist(), many.tolist(), strict=True)]
    data, offsets = np.frombuffer(b"".join(cuts), np.uint8), np.cumsum([0] + [len(c) for c in cuts])
    for width in (169, 85, 11, 2, 1):
        seg, first, size, group = suffix.parts(data, offsets, many, 200, width)
        windows = [(s, i) for s, f, n in zip(seg.tolist(), first.tolist(), size.tolist(), strict=True) for i in range(f, f + n)]
        assert len(set(windows)) == len(windows) == many.sum() and size.max() <= width
        places = {}
        for (s, i), g in zip(windows, np.repeat(group, size).tolist(), strict=True):
            places.setdefault(cuts[s][i : i + 200], set()).add((anchor[s], g))
        assert all(len(v) == 1 for v in places.values())


def test_long_runs(spark):
    """Runs of one byte and of short periods are one entry each, and their ranges are joined before they are collected."""
    rng = random.Random(10)
    docs = [(1, words(rng, 40) + "x" * 10_000_000 + words(rng, 40)), (2, "x" * 150), (3, "abc" * 1_000_000), (4, "y" * 200 + "bca" * 70), (5, "lorem ipsum " * 50_000)]
    out = {d: (n, removed, spans) for d, n, removed, spans, _ in got(spark, docs)}
    assert out == {1: (len(docs[0][1].encode()), 10_000_000, 1), 2: (150, 0, 0), 3: (3_000_000, 3_000_000, 1), 4: (410, 210, 1), 5: (600_000, 600_000, 1)}
    rows = suffix.removed_ranges(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows.count() < 2000


def test_runs_match_brute_force(spark):
    rng = random.Random(11)
    docs = [(i, words(rng, 20) + rng.choice(["z", "ab", "abc", "12345 "]) * rng.randint(30, 400) + words(rng, 20)) for i in range(30)]
    assert got(spark, docs) == expected(docs, 200)


def test_pieces_give_each_window_once(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(5))
    offsets = np.cumsum([0, 10, 900, 0, 199, 200, 2500, 201])
    data = rng.integers(97, 99, offsets[-1]).astype(np.uint8)

    def windows():
        row, start, many, anchor, _ = suffix.segments(data, offsets, 200)
        return sorted((r, i, a) for r, s, k, a in zip(row.tolist(), start.tolist(), many.tolist(), anchor.tolist(), strict=True) for i in range(s, s + k))

    whole = windows()
    assert len(whole) == 701 + 1 + 2301 + 2
    for size in (1, 77, 1000):
        monkeypatch.setattr(suffix, "PIECE", size)
        assert windows() == whole


def test_interval_expansion_alone():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.choice([2, 3, 5, 9])
        segs = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 8))]
        x = np.frombuffer(b"".join(s + b"\xff" for s in segs), np.uint8)
        seen = {}
        for i in range(len(x) - length + 1):
            w = x[i : i + length].tobytes()
            if b"\xff" not in w:
                seen.setdefault(w, []).append(i)
        want = np.zeros(len(x), bool)
        for v in seen.values():
            if len(v) > 1:
                want[v] = True
        assert (suffix.repeated_starts(x, length) == want).all()


def test_odd(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(40, "same " * 50), (40, "same " * 50)]
    df = odd.unionByName(spark.createDataFrame(docs[-2:], "doc_id long, text string"), allowMissingColumns=True)
    assert got(spark, df) == expected(docs, 200)
    assert suffix.remove_repeats(none).count() == 0


def test_strings_that_a_polynomial_confuses(spark):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2**64; no string of 200 bytes of theirs repeats
    across the two documents beyond what brute force finds."""
    word = lambda a, b, n: "".join((a, b)[bin(i).count("1") & 1] for i in range(n))
    docs = [(1, "x" * 40 + word("a", "b", 2048)), (2, "y" * 40 + word("b", "a", 2048)), (3, word("c", "d", 1024))]
    assert got(spark, docs) == expected(docs, 200)
