import math
import random
import tracemalloc

import numpy as np
import pytest

from attesta.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows):
    """Whole numbers of Python, all pairs."""
    use = []
    for i, v, l in rows:
        if i is None or l is None or v is None or not v or any(x is None or not math.isfinite(x) or abs(x) >= 2.0**128 for x in v):
            continue
        use.append((i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]))
    dim = max((len(v) for _, _, v in use), key=lambda d: (sum(len(v) == d for _, _, v in use), -d), default=0)
    use = [u for u in use if len(u[2]) == dim]
    out = []
    for n, (i, l, v) in enumerate(use):
        if i % 50:
            continue
        scored = [(-s, j, m) for k, (j, m, w) in enumerate(use) if k != n and abs(s := sum(x * y for x, y in zip(v, w, strict=True))) < 2**63 * (1 - 2**-40)]
        for ps, pid, _ in sorted(s for s in scored if s[2] == l)[:5]:
            inside = sorted(s for s in scored if s[2] != l and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:3]
            out += [(i, pid, r + 1, j, -ps, -s) for r, (s, j, _) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, **kw):
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), **kw).collect())


def clusters(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(10, dim)) + 0.8
    return [(i, (scale * (centre[i % 10] + 0.8 * rng.normal(size=dim))).tolist(), int(rng.integers(10)) if rng.random() < 0.3 else i % 10) for i in range(n)]


@pytest.mark.parametrize("blocks", [1 << 19, 256 * 8])
def test_against_all_pairs(spark, blocks):
    rows = clusters(600, 8, 1)
    got = run(spark, rows, block_values=blocks)
    assert len(got) > 50 and got == plain(rows)


def test_ties_and_copies(spark):
    """Few different vectors, a third of all rows equal, ids that repeat."""
    rng = random.Random(3)
    few = [[rng.randrange(-1, 4) / 4 for _ in range(3)] for _ in range(6)]
    rows = [(i % 130, few[0] if i % 3 else rng.choice(few), rng.randrange(2)) for i in range(260)]
    assert run(spark, rows, block_values=3 * 256) == plain(rows)


def test_odd_rows(spark):
    rows = clusters(120, 4, 7) + [(None, [1.0] * 4, 1), (150, None, 1), (151, [1.0, None, 1.0, 1.0], 1), (152, [math.nan] * 4, 1), (153, [math.inf, 0.0, 0.0, 0.0], 1)]
    rows += [(200, [1.0] * 4, None), (201, [], 1), (202, [1.0] * 3, 1), (250, [0.0] * 4, 3), (251, [0.0] * 4, 3), (252, [0.0] * 4, 4), (-50, [0.5] * 4, -3), (-51, [0.6] * 4, -3)]
    got = run(spark, rows)
    assert got == plain(rows) and sum(g[0] == 250 and g[4:] == (0, 0) for g in got) == 15
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", v string, rid int, score int")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in negatives.hard_negatives(df).collect()) == got
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_components(spark):
    """Any finite float: components of 1e6 in each row, and of 1e22 in some, whose scores mostly leave 64 bits."""
    rows = clusters(200, 4, 9, 1e6)
    assert run(spark, rows) == plain(rows) != []
    rows = [(i, [x * 1e22 if i % 25 == 0 and k == 3 else x for k, x in enumerate(v)] if i % 10 else v, l) for i, v, l in clusters(300, 4, 11)]
    rows = [(i, [0.0 if k == 3 and i % 50 == 0 else x for k, x in enumerate(v)], l) for i, v, l in rows]
    rows += [(55 + i, [0.0, 0.0, 0.0, 1e22 * (-1) ** i], i) for i in range(4)]
    got = run(spark, rows)
    assert got == plain(rows) != []


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for top, dim in ((1, 3), (127, 2000), (2**20, 64), (2**28, 100)):
        a, b = rng.integers(-top, top + 1, (7, dim)), rng.integers(-top, top + 1, (9, dim))
        exact, fits = negatives.scores(a.astype(float), b.astype(float))
        assert fits.all() and (exact == a @ b.T).all()
    big = np.array([[2.0**100, 3.0, -(2.0**100)], [2.0**62, 1.0, 0.0]])
    exact, fits = negatives.scores(big, np.array([[1.0, 5.0, 1.0], [2.0, 0.0, 0.0], [1.0, -7.0, 0.0]]))
    assert exact[fits].tolist() == [15, 2**62 + 5, 2**62 - 7] and fits.tolist() == [[True, False, False], [True, False, True]]
    assert (negatives.moduli(np.array([65536.0])) <= 3).all()


def test_a_task_holds_few_products():
    """Blocks of 4,096 anchors and 8,192 rows: 34 million products, of which a task holds a few at a time."""
    rng = np.random.default_rng(17)
    a, b = (np.floor(256 * rng.normal(size=(n, 8))) for n in (4096, 8192))
    tracemalloc.start()
    for first, exact, fits in negatives.strips(a, b):
        assert fits.all() and (exact[:, :50] == a[first : first + len(exact)] @ b[:50].T).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first + len(exact) == 4096 and peak < 64 << 20


@pytest.mark.parametrize("terms", [1, 130, 1024])
def test_residues_of_sums_are_centred(terms):
    top = terms * 127 * 127
    r = np.unique(np.concatenate([np.linspace(-top, top, 50_001).astype(np.int64), np.arange(top - 1500, top + 1), np.arange(-top, -top + 1500)]))
    for p in negatives.PRIMES:
        got = negatives._centre(r.astype(np.float32), p, terms).astype(np.int64)
        assert (abs(got) <= (p - 1) // 2).all() and ((r - got) % p == 0).all()
