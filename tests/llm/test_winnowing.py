import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.llm import winnowing

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(docs, items, window=10):
    """All windows of all items against all places of all documents."""
    low = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = low(t)
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[s : s + m]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, who = low(t), set(), set()
        for m in {len(x) for x in wins}:
            for s in range(len(w) - m + 1):
                if (x := tuple(w[s : s + m])) in wins:
                    hit |= set(range(s, s + m))
                    who |= wins[x]
        out.append((d, len(w), len(hit), sorted(str(x) for x in who if x is not None), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = winnowing.contaminated_words(d, b, **kw).collect()
    assert all(r["n_items"] == len(r["items"]) for r in rows)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in rows), key=repr)


@pytest.mark.parametrize("words", [3, 200])
def test_against_every_window(spark, words):
    """With three words nearly all windows are full of ties and repeats."""
    rng = random.Random(words)
    text = lambda n: " ".join(rng.choice("Aa É ß b2 漢字 c'd".split()) if words == 3 else f"w{rng.randrange(words)}" for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 6, 9, 10, 11, 30]) if words == 200 else rng.choice([7, 10, 14]))) for i in range(12)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(30)]
    for i in range(20):  # spans of 8 to 14 words, so that some are too short
        w = (items[i % 12][1] or "").split()
        at, n = rng.randrange(max(1, len(w) - 8)), rng.randrange(8, 15)
        docs.append((100 + i, text(rng.randrange(5)) + ", " + "; ".join(w[at : at + n]).upper() + ". " + text(rng.randrange(5))))
    assert run(spark, docs, items) == plain(docs, items)


def test_odd_rows(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (1, "one"), (2, "one"), (None, "two three"), (3, None), (4, ""), (5, "...")]
    docs = [(1, "ONE!"), (1, "ONE!"), (2, None), (3, ""), (None, "two, three four"), (4, "beta gamma delta epsilon zeta eta theta iota kappa lambda " * 3000), (5, "beta gamma delta epsilon zeta eta theta iota kappa")]
    got = run(spark, docs, items)
    assert got == plain(docs, items)
    assert (1, 1, 1, ["1", "2"], True) in got and (None, 3, 2, [], True) in got and (5, 9, 0, [], False) in got


def test_empty_tables_and_clashing_columns(spark, odd, none):
    items = spark.createDataFrame([(8, "a b c d e f g h")], "item_id long, text string").withColumns({c: F.lit("clash") for c in ("words", "f", "length", "window", "f8", "_key")})
    rows = winnowing.contaminated_words(odd.withColumns({c: F.lit("x") for c in ("words", "f10", "_hits", "items")}), items).collect()
    assert len(rows) == 9 and {r["doc_id"] for r in rows if r["contaminated"]} == {1, 2}
    assert winnowing.contaminated_words(none, items.select("item_id", "text")).count() == 0
    bare = winnowing.contaminated_words(odd, items.select("item_id", "text").limit(0))
    assert bare.where("contaminated or n_hit > 0 or size(items) > 0").count() == 0 and bare.count() == 9


def test_windows_of_other_sizes(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(9)}" for _ in range(n))
    items, docs = [(i, text(20)) for i in range(4)], [(i, text(40)) for i in range(12)]
    for window, gram in ((3, 5), (6, 2), (4, 4)):
        assert run(spark, docs, items, window=window, gram=gram) == plain(docs, items, window)


def test_digest_of_the_query(spark, data):
    from attesta.llm.queries import op13_winnowing

    rows = op13_winnowing(spark, data).collect()
    assert len(rows) == 1000 and any(r["contaminated"] for r in rows)
    assert {r["items_sha256"] for r in rows if not r["contaminated"]} == {hashlib.sha256(b"").hexdigest()}
