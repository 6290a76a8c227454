import math
import random
import re
import zlib

import numpy as np

from attesta.llm import queries as q
from attesta.llm import quality


def test_held_out_accuracy(spark, data):
    rows = q.op9_quality(spark, data).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) > 0.95


def plain_features(text):
    """The figures of a text by plain Python over its words, one at a time."""
    b = (text or "").encode()
    if not b:
        return [0.0] * len(quality.FEATURES)
    words = re.findall(rb"[^\x09-\x0d ]+", b)
    n, size = max(len(words), 1), len(b)
    count = lambda chars: sum(x in chars for x in b)
    upper = count(range(65, 91))
    letters = max(upper + count(range(97, 123)), 1)
    capital = lambda x: 65 <= x <= 90
    ends = set(range(33, 48)) | set(range(58, 65)) | {123, 124, 125, 126}
    return [
        math.log(1 + len(words)), sum(map(len, words)) / n, upper / letters, count(b"0123456789") / size, sum(x > 127 for x in b) / size, count(b".,;:?") / n,
        count(b"\"'()[]{}<>/\\-_=+~^`@") / n, b.count(b"!") / n, b.count(b"|") / n, count(b"#$%&*") / n, sum(x == y for x, y in zip(words, words[1:])) / n, len(set(words)) / n,
        min(len(words) / (b.count(b"\n") + 1), 200) / 200, sum(len(w) > 1 and capital(w[0]) and capital(w[1]) for w in words) / n, sum(w[-1] in ends for w in words) / n, b.count(b" ") / size,
        sum((x < 32 and x not in (9, 10, 11, 12, 13)) or x == 127 for x in b) / size, sum(len(w) == 1 for w in words) / n,
    ]


def test_scores_equal_a_plain_recomputation(spark, data):
    """Features word by word, the learned weights at the least loss of all preference pairs drawn, the cut by counting, and
    every score of the query from these."""
    docs = {r["doc_id"]: plain_features(r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    docs = {i: [float(np.float32(v)) for v in x] for i, x in docs.items()}  # features are stored as floats
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    ids = sorted(i for i in docs if labels.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2)
    x, y = np.array([docs[i] for i in ids]), np.array([labels[i] for i in ids])
    m = quality.fit(x, y)
    mean = [sum(c) / len(ids) for c in zip(*x.tolist())]
    std = [math.sqrt(sum((v - a) ** 2 for v in c) / len(ids)) for c, a in zip(zip(*x.tolist()), mean)]
    std = [s if s >= 1e-9 else 1.0 for s in std]
    z = lambda f: np.array([min(8, max(-8, (v - a) / s)) for v, a, s in zip(f, mean, std)])
    rng = np.random.default_rng(11)
    won, lost = rng.choice(np.flatnonzero(y == 1), 200_000), rng.choice(np.flatnonzero(y == 0), 200_000)
    zs = np.array([z(f) for f in x])
    d = zs[won] - zs[lost]
    loss = lambda w: np.logaddexp(0, -(d @ w)).mean() + 0.5e-3 * w @ w
    least = loss(m.weights)
    for k in range(len(m.weights)):  # the loss is convex: no step along any axis makes it less
        for step in (-1e-3, 1e-3):
            assert loss(m.weights + step * np.eye(len(m.weights))[k]) > least
    raw = sorted(float(f @ m.weights) for f in zs)
    bad = int((y == 0).sum())
    cut = (raw[bad - 1] + raw[bad]) / 2
    spread = math.sqrt(sum((v - sum(raw) / len(raw)) ** 2 for v in raw) / len(raw))
    score = lambda f: 1 / (1 + math.exp(-(2 / spread * (float(z(f) @ m.weights) - cut) + math.log(0.7 / 0.3))))
    rows = q.op9_quality(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    worst = max(abs(r["score"] - score(docs[r["doc_id"]])) for r in rows)
    assert worst < 1e-6, worst


def test_plain_features_of_odd_texts():
    from attesta.llm.common import buffers
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice("aaB C!|\n\té.7\x01\x7f#'") for _ in range(rng.randrange(80))) for _ in range(300)] + ["", " ", "\n", "x", "é"]
    assert np.allclose(quality.text_features(*buffers(pa.array(texts))), [plain_features(t) for t in texts])


def test_preferences_are_learned():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    w = rng.normal(size=x.shape[1])
    y = (x @ w + rng.logistic(size=600) * 0.2 > -1).astype(int)
    m = quality.fit(x, y, pairs=20_000)
    s = m.score(x)
    assert np.corrcoef(m.weights, w)[0, 1] > 0.95
    assert abs((s < 0.7).sum() - (y == 0).sum()) <= 1  # the cut is a quantile
    assert ((s >= 0.7) == y).mean() > 0.93


def test_held_rows_are_not_learned_from(spark, odd):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    feats = spark.createDataFrame([(i, [0.0] * len(quality.FEATURES)) for i in range(400)], "doc_id long, features array<float>")
    x, y = quality.training_rows(feats, labels)
    assert len(y) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(400))


def test_a_repeated_id_is_learned_from_once(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    feats = spark.createDataFrame([(1, [float(k)] * len(quality.FEATURES)) for k in range(50)] + [(4, [1.0] * len(quality.FEATURES))], "doc_id long, features array<float>")
    x, y = quality.training_rows(feats, labels)
    assert len(y) == len(x) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (1, 4)) and (x[y == 1] == 0).all()


def test_features_see_only_their_text():
    from attesta.llm.common import buffers
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab C!|\n é") for _ in range(rng.randrange(60))) for _ in range(50)] + ["", "x"]
    whole = quality.text_features(*buffers(pa.array(texts)))
    alone = np.concatenate([quality.text_features(*buffers(pa.array([t]))) for t in texts])
    assert np.allclose(whole, alone)


def test_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 0, 0), (2, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(odd, labels).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    assert len(quality.score_documents(odd, labels.limit(0)).collect()) == 9
    assert quality.score_documents(none, labels).count() == 0
