import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import vectors


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in e] if e is not None else None, "clash") for i, e in rows], "vec_id long, embedding array<float>, score string")


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    rows = list(enumerate(x)) + [(5000 + i, x[7]) for i in range(15)]
    df = frame(spark, rows)
    got = vectors.nearest(df, df.where("vec_id % 100 = 0"), k=10, sample=1500).collect()
    ids, m = np.array([i for i, _ in rows]), np.stack([e for _, e in rows]).astype(float)
    hit = total = 0
    for q in (i for i in ids if i % 100 == 0):
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        assert all(abs(s - d[ids == v][0]) < 1e-9 for _, v, s in mine)
        hit, total = hit + len({v for _, v, _ in mine} & set(want)), total + 10
    assert hit / total >= 0.9


def test_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 16))
    b = vectors.train(x, stages=4, words=32)
    loss = lambda beam: ((x - b.decode(b.encode(x, beam))) ** 2).sum()
    assert loss(8) < loss(1) < (x**2).sum()


ODD = [(0, [1, 0]), (100, [1, 0]), (1, [0.999, 0.01]), (2, None), (3, [0, 0]), (4, [float("nan"), 1]), (5, [float("inf"), 1]), (6, [1, 2, 3]), (None, [1, 0]), (200, [-1, 0])]


def test_search_odd(spark):
    df = frame(spark, ODD)
    got = vectors.nearest(df, df.where("vec_id % 100 = 0")).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [100, 1, 200]
    assert vectors.nearest(df.limit(0), df.limit(0)).count() == 0


def test_search_by_row(spark):
    """Repeated ids, repeated rows and ties, against brute force over rows: 3 lists, so some of them are looked into."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(700, 6)), 1).astype(np.float32)  # coarse values: many equal distances
    rows = [(i % 300, e) for i, e in enumerate(x)] + [(100, x[4])] * 2 + [(200, x[0])] + [(100, x[100])] + [(600 + i, x[5]) for i in range(40)]
    df = frame(spark, rows)
    got = {}
    for r in vectors.nearest(df, df.where("vec_id % 100 = 0"), k=10, rerank=400, recall=1.0, list_rows=250).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    want, m, ids = {}, np.stack([e for _, e in rows]).astype(float), np.array([i for i, _ in rows])
    for at in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((m - m[at]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != at][:10]
        want.setdefault(int(ids[at]), []).extend((r + 1, int(ids[j]), round(float(d[j]), 9)) for r, j in enumerate(order))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def links(rows, cosine):
    ok = [(i, np.array(e, float)) for i, e in rows if i is not None and e is not None and len(e) == len(rows[0][1]) and np.isfinite(e).all() and np.any(e)]
    u = np.stack([e / np.sqrt((e * e).sum()) for _, e in ok])
    near = u @ u.T >= cosine
    ids = [i for i, _ in ok]
    n = dict(zip(ids, near.sum(1) - 1, strict=True))
    comp = {i: i for i in ids}
    for _ in ids:
        comp = {i: min(comp[j] for j, yes in zip(ids, near[k], strict=True) if yes) for k, i in enumerate(ids)}
    return n, comp


def test_graph_links_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([rng.normal(size=(500, 16)), np.repeat(base, 12, 0) + 0.16 * rng.normal(size=(480, 16)), np.tile(base[0], (60, 1)), base[1] + 0.02 * rng.normal(size=(150, 16))])
    rows = list(enumerate(x.astype(np.float32)))
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame(spark, rows), 0.95, shards=4, query_block=300).collect()}
    n, comp = links(rows, 0.95)
    assert {i: got[i]["n_links"] for i in got} == n
    assert {i: got[i]["component_id"] for i in got} == comp
    assert all(got[i]["kept"] == (comp[i] == i) for i in got)


def test_graph_by_row(spark):
    """Repeated ids with equal and with other vectors: links and components are those of rows."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 8))
    x = np.concatenate([b + s * rng.normal(size=(25, 8)) for b, s in zip(base, (0, 0.01, 0.05, 0.1, 0.2, 0.4), strict=True)]).astype(np.float32)
    ids = [i % 60 for i in range(len(x))]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(frame(spark, zip(ids, x, strict=True)), 0.95, shards=3, query_block=40).collect())
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    near = u @ u.T >= 0.95
    low = list(ids)
    for _ in x:
        low = [min(low[j] for j in np.flatnonzero(near[i])) for i in range(len(x))]
    assert got == sorted((ids[i], int(near[i].sum()) - 1, low[i], ids[i] == low[i]) for i in range(len(x)))


def test_wide_vectors_in_shards_by_bytes(spark, monkeypatch):
    """1,024 dimensions: shards and blocks of queries shrink with the bytes of a vector, and the links stay those of all pairs."""
    rng = np.random.default_rng(7)
    x = np.concatenate([b + s * rng.normal(size=(30, 1024)) for b, s in zip(rng.normal(size=(6, 1024)), (0.05, 0.1, 0.2, 0.22, 0.3, 0.4), strict=True)]).astype(np.float32)
    rows, built = list(enumerate(x)), []
    staged = vectors.staged
    monkeypatch.setattr(vectors, "staged", lambda df, name: built.append((name, staged(df, name))) or built[-1][1])
    monkeypatch.setattr(vectors, "discard", lambda *t: None)
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame(spark, rows), 0.95, shards=1, shard_bytes=1 << 19).collect()}
    n, comp = links(rows, 0.95)
    assert {i: got[i]["n_links"] for i in got} == n
    assert {i: got[i]["component_id"] for i in got} == comp
    sizes = [sum(map(len, r["parts"])) for r in dict(built)["graphs"].collect()]
    assert len(sizes) == 5 and max(sizes) < 1 << 20


def test_links_of_any_finite_scale(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([b + 0.1 * rng.normal(size=(20, 16)) for b in rng.normal(size=(5, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x * np.where(np.arange(100) % 3, 1e200, 1e-200)[:, None])]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, shards=2).collect()}
    n, comp = links(list(enumerate(x)), 0.95)
    assert {i: got[i]["n_links"] for i in got} == n
    assert {i: got[i]["component_id"] for i in got} == comp


def test_graph_odd(spark):
    got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(frame(spark, ODD)).collect() if r["vec_id"] is not None)
    assert got == [(0, 2, 0, True), (1, 2, 0, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (100, 2, 0, False), (200, 0, 200, True)]
    assert vectors.near_vectors(frame(spark, ODD).limit(0)).count() == 0


def _recall(rows, got, k=10):
    ids, m = np.array([i for i, _ in rows]), np.stack([e for _, e in rows]).astype(float)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:k]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, k + 1))
        assert all(np.isclose(s, d[ids == v][0], rtol=1e-12) for _, v, s in mine)
        hit, total = hit + len({v for _, v, _ in mine} & set(want)), total + k
    return hit / total


def test_search_of_any_finite_scale(spark):
    """Components of 1e22 and of 1e-22 among the candidates, among the queries, and in half of all rows."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 16))
    far = np.arange(1500) % 25 == 3
    for scale in (np.where(far, 1e22, 1), np.where(np.arange(1500) % 100 == 0, 1e22, 1), np.where(far, 1e-22, 1), np.where(np.arange(1500) % 2, 1e15, 1)):
        rows = list(enumerate((x * scale[:, None]).astype(np.float32)))
        df = frame(spark, rows)
        assert _recall(rows, vectors.nearest(df, df.where("vec_id % 100 = 0")).collect()) >= 0.9


def test_recall_of_the_search_is_enforced(spark, monkeypatch):
    """An audit that asks for far too little is made up for."""
    rng = np.random.default_rng(13)
    rows = list(enumerate(rng.normal(size=(1500, 16)).astype(np.float32)))
    df, audit = frame(spark, rows), vectors.probe_and_depth
    monkeypatch.setattr(vectors, "probe_and_depth", lambda *a: (1, 1, audit(*a)[2]))
    assert _recall(rows, vectors.nearest(df, df.where("vec_id % 100 = 0"), rerank=2, list_rows=200).collect()) >= 0.85


def test_search_audit_is_not_of_copies_alone(spark):
    """A vector of 90 copies, which the audit's hash puts first, in a cluster of its own: the other queries still find their nearest."""
    rng = np.random.default_rng(23)
    rows = list(enumerate(rng.normal(size=(6000, 24)).astype(np.float32)))
    made = frame(spark, rows).where("vec_id % 100 <> 0").withColumn("c1", F.xxhash64(F.col("embedding").cast("array<double>")))
    copied = dict(rows)[made.orderBy(F.xxhash64(F.lit("audit"), "c1")).first()["vec_id"]]
    rows += [(10_001 + i, e) for i, e in enumerate(copied + (1e-3 * rng.normal(size=(60, 24))).astype(np.float32))]
    rows += [(20_000 + 100 * i, copied) for i in range(90)]
    df = frame(spark, rows)
    got, m, hit = vectors.nearest(df, df.where("vec_id % 100 = 0"), rerank=10, list_rows=400).collect(), np.stack([e for _, e in rows]).astype(float), 0
    for q in range(0, 6000, 100):
        want = {rows[i][0] for i in np.argsort(((m - m[q]) ** 2).sum(1), kind="stable")[1:11]}
        hit += len(want & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit / 600 >= 0.9


def test_search_finds_copies_among_many_of_one_code(spark):
    """300 near vectors that share a code, each there twice: the copy of a query is its nearest, whatever the codes tell apart."""
    rng = np.random.default_rng(29)
    x = np.concatenate([rng.normal(size=(1500, 8)), 1 + 1e-6 * rng.normal(size=(300, 8))]).astype(np.float32)
    rows = [(i, e) for i, e in enumerate(x)] + [(5001 + i, e) for i, e in enumerate(x[1500:])]
    df = frame(spark, rows)
    got = vectors.nearest(df, df.where("vec_id % 100 = 0"), rerank=12, recall=0.5, least=0.0).collect()
    same = {r["query_id"] for r in got if r["score"] == 0}
    assert same >= {1500, 1600, 1700}


def test_rows_of_a_graph_are_bounded(spark, monkeypatch):
    """A shard of 2 MiB of vectors is rows of 1 MiB at most, and its links stay those of all pairs."""
    rng = np.random.default_rng(31)
    x = np.concatenate([b + s * rng.normal(size=(30, 1024)) for b, s in zip(rng.normal(size=(9, 1024)), np.linspace(0.05, 0.4, 9), strict=True)]).astype(np.float32)
    rows, built = list(enumerate(x)), []
    staged = vectors.staged
    monkeypatch.setattr(vectors, "staged", lambda df, name: built.append((name, staged(df, name))) or built[-1][1])
    monkeypatch.setattr(vectors, "discard", lambda *t: None)
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame(spark, rows), 0.95, shards=1, query_block=100).collect()}
    n, comp = links(rows, 0.95)
    assert {i: got[i]["n_links"] for i in got} == n
    assert {i: got[i]["component_id"] for i in got} == comp
    sizes = [sum(map(len, r["parts"])) for r in dict(built)["graphs"].collect()]
    assert sum(sizes) > 270 * 1024 * 8 and max(sizes) <= 1 << 20


def test_a_packed_graph_is_the_same():
    x = np.random.default_rng(33).normal(size=(4000, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    g = vectors.Graph(x)
    h = vectors.Graph.unpack([np.frombuffer(p, np.uint8) for p in g.pack()], x)
    assert len(g.layers) > 1 and all((a == b).all() for a, b in zip(g.layers, h.layers, strict=True))
    assert (g.search(x[:50], 20)[0] == h.search(x[:50], 20)[0]).all()


def test_wide_beams_hold_little_at_a_time():
    """500 vectors near one another that lead themselves: each query walks with a beam of all nodes and links with all."""
    rng = np.random.default_rng(37)
    x = rng.normal(size=16) + 0.02 * rng.normal(size=(500, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    g = vectors.Graph(x)
    balls = vectors.Balls(g, x, np.ones(500, np.int64))
    tracemalloc.start()
    counts, a, b = vectors.linked_balls(g, balls, x, np.arange(500), 0.95, held=1 << 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    low = vectors._forest(a, b)
    assert (counts == 500).all() and set(low[1].tolist()) == {0} and len(low[0]) == 999
    assert peak < 30 << 20
