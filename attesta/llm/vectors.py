"""Operators 5 and 7: nearest neighbours by additive quantisation, and near-duplicate vectors by HNSW graphs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, discard, literal_rows, mix, staged


def usable(c: Column) -> Column:
    """A vector that is not null, holds no null or non-finite component and is not zero."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def common_length(vectors: DataFrame) -> int:
    """The most frequent length of the usable vectors (the smaller one on a tie); others take no part."""
    sizes = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return sizes["d"] if sizes else 0


def matrix(array, dim: int, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    return np.asarray(array.flatten(), dtype).reshape(-1, dim)


# --- operator 5 -------------------------------------------------------------------------------------------------------


@dataclass
class Codebooks:
    """Full-dimensional codebooks, (stages, words, dim); a vector is the sum of one word of each."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = 8) -> np.ndarray:
        """The best of ``beam`` partial sums kept from stage to stage, as codes (rows, stages)."""
        n = len(x)
        left = x[:, None, :].astype(np.float32)
        codes = np.zeros((n, 1, 0), np.uint8)
        for words in self.words:
            w = words.astype(np.float32)
            err = (left**2).sum(2)[:, :, None] - 2 * left @ w.T + (w**2).sum(1)
            flat = err.reshape(n, -1)
            k = min(beam, flat.shape[1])
            best = np.argpartition(flat, k - 1, axis=1)[:, :k]
            rows, (src, word) = np.arange(n)[:, None], np.divmod(best, len(w))
            left = left[rows, src] - w[word]
            codes = np.concatenate([codes[rows, src], word[:, :, None].astype(np.uint8)], axis=2)
        return codes[np.arange(n), (left**2).sum(2).argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(w[codes[:, m]] for m, w in enumerate(self.words))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Dot products of each query with each word, (queries, stages, words)."""
        return np.einsum("qd,mkd->qmk", queries, self.words, optimize=True).astype(np.float32)


def train(x: np.ndarray, stages: int = 24, words: int = 256, rounds: int = 6, seed: int = 7) -> Codebooks:
    """Residual k-means for a start, then each codebook in turn by least squares, the others and the beam-searched codes held."""
    rng = np.random.default_rng(seed)
    k, left, books = min(words, len(x)), x.copy(), []
    for _ in range(stages):
        c = left[rng.permutation(len(x))[:k]]
        for _ in range(rounds):
            own = ((c**2).sum(1) - 2 * left @ c.T).argmin(1)
            count = np.bincount(own, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, own, left)
            c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], left[rng.integers(len(x), size=k)])
        own = ((c**2).sum(1) - 2 * left @ c.T).argmin(1)
        left = left - c[own]
        books.append(c)
    books = Codebooks(np.stack(books))
    if len(x) > 4 * k:
        codes = np.concatenate([books.encode(p) for p in np.array_split(x, len(x) // 1024 + 1)])
        w, rest = books.words.copy(), x - books.decode(codes)
        for _ in range(4):
            for m in range(stages):
                own = codes[:, m].astype(int)
                rest += w[m][own]
                sums = np.zeros_like(w[m])
                np.add.at(sums, own, rest)
                count = np.bincount(own, minlength=k)[:, None]
                w[m] = np.where(count > 0, sums / np.maximum(count, 1), w[m])
                rest -= w[m][own]
        books = Codebooks(w)
    return books


def coarse(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """``lists`` centroids of ``x`` by k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(rounds if len(c) > 1 else 0):
        own = np.concatenate([((c**2).sum(1) - 2 * p @ c.T).argmin(1) for p in np.array_split(x, len(x) // 4096 + 1)])
        count, sums = np.bincount(own, minlength=len(c)), np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=len(c))])
    return c


def list_order(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The lists in the order of their centroid's distance to each row of ``x``."""
    return np.argsort((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1, kind="stable")


def probe_and_depth(classes: DataFrame, codes: DataFrame, queries: DataFrame, books: Codebooks, centroids: np.ndarray, dim: int, k: int, recall: float, audit: int) -> tuple[int, int, list[dict]]:
    """How many lists to look into, and how many of the best by looked-up distance there to measure, so that ``recall`` of
    the true ``k`` nearest classes are found; by brute force.

    At most ``audit`` queries (by hash, one of each vector: copies would take all the places) are compared with every class; then the codes with a smaller looked-up distance
    than each true neighbour's are counted in the lists looked into. Only audit * k rows reach the driver; they are returned
    too, as rows of qid and cid, so that what is found in the end can be held against them.
    """
    one = queries.groupBy("c1", "c2").agg(F.min_by(F.struct("qid", "own", "embedding"), F.struct("query_id", "qid")).alias("one")).select("c1", "c2", "one.*")
    asked = one.orderBy(F.xxhash64(F.lit("audit"), "c1"), "c2").limit(audit).toPandas()
    if not len(asked):
        return 1, k, []
    own, x = asked["own"].fillna(-1).to_numpy(), np.array(asked["embedding"].tolist())

    def exact(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cid, ids, y = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), dim)
            d = ((x**2).sum(1)[:, None] - 2 * x @ y.T) + (y**2).sum(1)
            d[own[:, None] == cid] = np.inf
            edge = np.partition(d, min(4 * k, len(cid)) - 1, axis=1)[:, min(4 * k, len(cid)) - 1]
            found: tuple[list, ...] = ([], [], [], [])
            for i in range(len(x)):  # the products cancel between near vectors: the order is that of the differences, ties by id
                at = np.flatnonzero((d[i] <= edge[i]) & (cid != own[i]))
                near = ((x[i] - y[at]) ** 2).sum(1)
                top = np.lexsort((cid[at], ids[at], near))[:k]
                for column, value in zip(found, (np.full(len(top), i), cid[at][top], ids[at][top], near[top]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(column)) for column in found], ["q", "cid", "id", "d"])

    best = Window.partitionBy("q").orderBy("d", "id", "cid")
    true = classes.select("cid", "id", "embedding").mapInArrow(exact, "q long, cid long, id long, d double").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    true = true.join(codes, "cid").select("q", "cid", "code", "norm", "list").toPandas()
    if not len(true):
        return 1, k, []
    share = 1 - (1 - recall) / 2
    place = np.argsort(list_order(x, centroids), axis=1)  # (query, list) -> how many lists are nearer
    tables, q = books.tables(x), true["q"].to_numpy()
    probes = int(np.quantile(place[q, true["list"].to_numpy()], share, method="higher")) + 1
    near = lambda t, c, norm: norm - 2 * sum(t[..., m, c[:, m]] for m in range(c.shape[1]))
    code = np.frombuffer(b"".join(true["code"]), np.uint8).reshape(len(true), -1)
    edge = true["norm"].to_numpy() - 2 * sum(tables[q, m, code[:, m]] for m in range(code.shape[1]))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(len(edge), np.int64)
        for batch in batches:
            c = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            d = np.where(place[:, batch.column(2).to_numpy()] < probes, near(tables, c, batch.column(1).to_numpy()), np.inf)
            d = np.sort(d, axis=1)
            total += np.array([np.searchsorted(d[i], e - 1e-6) for i, e in zip(q, edge, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(edge))), pa.array(total)], ["i", "n"])

    depths = codes.select("code", "norm", "list").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()["n"]
    known = [{"qid": int(asked["qid"][i]), "cid": int(c)} for i, c in zip(true["q"], true["cid"], strict=True)]
    return probes, (int(np.quantile(depths, share, method="higher")) + 1 if len(depths) else k), known


def _measured(queries: DataFrame, classes: DataFrame, n_queries: int, n_classes: int, dim: int, k: int, query_block: int = 2048, class_values: int = 1 << 21) -> DataFrame:
    """(qid, cid) of the k + 1 classes truly nearest to each query, in double precision, ties by id; block by block."""
    qbs, cbs = max(1, -(-n_queries // query_block)), -(-n_classes * dim // class_values)
    block = lambda c, m: F.pmod(F.xxhash64(F.lit("block"), c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    qs = queries.select("qid", F.col("embedding").alias("x"), block("qid", qbs).alias("qb")).withColumn("cb", every(cbs))
    cs = classes.select("cid", "id", F.col("embedding").alias("y"), block("cid", cbs).alias("cb")).withColumn("qb", every(qbs))

    def scan(queries_, classes_):
        import pyarrow as pa

        found: tuple[list, ...] = ([], [], [], [])
        if queries_.num_rows and classes_.num_rows:
            cid, ids, y = classes_.column("cid").to_numpy(), classes_.column("id").to_numpy(), matrix(classes_.column("y").combine_chunks(), dim)
            for qid, x in zip(queries_.column("qid").to_pylist(), matrix(queries_.column("x").combine_chunks(), dim), strict=True):
                with np.errstate(over="ignore"):
                    d = np.sqrt(((x - y) ** 2).sum(1))
                at = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
                at = at[np.lexsort((cid[at], ids[at], d[at]))][: k + 1]
                for column, value in zip(found, ([qid] * len(at), cid[at].tolist(), ids[at].tolist(), d[at].tolist()), strict=True):
                    column += value
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.float64())], ["qid", "cid", "id", "score"])

    best = Window.partitionBy("qid").orderBy("score", "id", "cid")
    out = qs.groupBy("qb", "cb").cogroup(cs.groupBy("qb", "cb")).applyInArrow(scan, "qid long, cid long, id long, score double")
    return out.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("qid", "cid")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, rerank: int = 128, recall: float = 0.97, audit: int = 256, sample: int = 16_384, stages: int = 24,
    list_rows: int = 8192, max_lists: int = 4096, query_block: int = 2048, code_block: int = 65_536, least: float = 0.9, scale_bits: int = 12,
) -> DataFrame:
    """The ``k`` nearest of the rows of ``vectors`` to each row of ``queries`` by Euclidean distance, its own row left out.

    Both have vec_id and embedding; returns query_id, rank (from 1), vec_id, score. Equal vectors form a class with one
    code. Codebooks and the centroids of coarse lists (one for about ``list_rows`` classes, at most ``max_lists``) are
    learned from at most ``sample`` and 16 * ``max_lists`` classes by hash; every class is encoded and put into the list of
    the nearest centroid. A query looks its distances up in the nearest lists, those of many rows block by block, and its
    best there are measured exactly, in double precision. How many lists and how many of the best is found by an audit
    against brute force (``probe_and_depth``), with ``rerank`` the least; a query goes on to further lists until they hold
    that many classes. What is found for the audited queries is held against the truth: where their mean recall, less two
    standard errors if there are other queries, is below ``least``, lists and depth are doubled, in the end up to all; so the
    recall that comes out is measured and not only aimed at. The query's own class is always among what is measured.

    Codes are for vectors whose largest component lies within 2 ** ``scale_bits`` of the median one, either way, and are worked
    out on the vectors divided by it. Others are off the scale: they are measured exactly against all queries, and queries
    off the scale against all classes, in blocks. That share of the table is brute force.

    Every row is a candidate of its own, whether or not it shares its id or its vector with others; only one row with the
    query's id and vector is left out, the query itself. Ties go to the smaller id. Equal query rows give equal answers,
    each its own; different query rows that share an id are ranked apart. Vectors that are null, zero, not finite or of
    another length than most, and rows without id, take no part.
    """
    spark = vectors.sparkSession
    vec = F.col("embedding").cast("array<double>")
    good = lambda t: t.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumns({"c1": F.xxhash64("embedding"), "c2": F.xxhash64(F.lit("v"), "embedding")})
    v, q = good(vectors), good(queries)
    dim = common_length(v)
    v, q = v.where(F.size("embedding") == dim), q.where(F.size("embedding") == dim)
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    middle = v.agg(F.percentile_approx(largest, 0.5)).first()[0]
    unit = 2.0 ** np.floor(np.log2(middle)) if middle else 1.0  # a power of two, so that dividing by it is exact
    odd = (largest > middle * 2.0**scale_bits) | (largest < middle / 2.0**scale_bits) if middle else F.lit(False)
    classes = v.groupBy("c1", "c2").agg(F.min("vec_id").alias("id"), F.first("embedding").alias("embedding"))
    classes = staged(classes.withColumns({"cid": F.monotonically_increasing_id(), "odd": odd}), "vector-classes")
    kinds = {r["odd"]: r["count"] for r in classes.groupBy("odd").count().collect()}
    n, n_odd = kinds.get(False, 0), kinds.get(True, 0)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # no answer needs more than the k + 1 smallest ids of a class
    first = Window.partitionBy("c1", "c2").orderBy("vec_id")
    members = v.select("c1", "c2", "vec_id").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    members = staged(members.join(classes.select("c1", "c2", "cid"), ["c1", "c2"]).select("cid", "vec_id", F.col("_r").alias("place")), "class-members")
    q = q.groupBy("vec_id", "c1", "c2").agg(F.count(F.lit(1)).alias("times"), F.first("embedding").alias("embedding")).withColumnRenamed("vec_id", "query_id")
    q = q.join(classes.select("c1", "c2", F.col("cid").alias("own")), ["c1", "c2"], "left").withColumns({"qid": F.monotonically_increasing_id(), "odd": odd})
    q = staged(q, "queries")
    every_class, every_query, on_scale = classes, q, F.transform("embedding", lambda x: x / F.lit(float(unit)))
    classes, q = (t.where("not odd").withColumn("embedding", on_scale) for t in (classes, q))

    lists = min(max_lists, -(-n // list_rows))
    size = max(sample, 16 * lists)
    share = min(1.0, 0.95 * size / n)
    picked = classes.where(F.pmod(F.xxhash64(F.lit("fit"), "c1", "c2"), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000))).orderBy(F.xxhash64(F.lit("order"), "c1"), "c2").limit(size).select("embedding").toPandas()
    x = np.array((picked if len(picked) else classes.limit(1).select("embedding").toPandas())["embedding"].tolist())
    fitted = spark.sparkContext.broadcast((train(x[:sample], stages), coarse(x, lists)))

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        books, centroids = fitted.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                y = matrix(part.column(1), dim)
                codes = books.encode(y)
                norms = (books.decode(codes) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list_order(y, centroids)[:, 0].astype(np.int32)), pa.array([c.tobytes() for c in codes]), pa.array(norms)], ["cid", "list", "code", "norm"])

    codes = staged(classes.select("cid", "embedding").mapInArrow(encode, "cid long, list int, code binary, norm double"), "codes")
    sizes = np.zeros(len(fitted.value[1]), np.int64)
    for r in codes.groupBy("list").count().collect():  # a row per list, ``max_lists`` at most
        sizes[r["list"]] = r["count"]
    probes, depth, known = probe_and_depth(classes, codes, q, *fitted.value, dim, k, recall, audit)
    depth = max(rerank, depth)
    others = q.select("c1", "c2").distinct().count() if known else 0
    wanted = Counter(r["qid"] for r in known)
    known = literal_rows(spark, known, "qid long, cid long") if known else None

    def missed(near: DataFrame) -> bool:
        """Whether the recall of the audited queries leaves it open that all of them together are below ``least``."""
        found = {r["qid"]: r["count"] for r in near.join(known, ["qid", "cid"], "left_semi").groupBy("qid").count().collect()}  # ``audit`` rows
        got = np.array([found.get(i, 0) / n for i, n in wanted.items()])
        return got.mean() - 2 * got.std() * np.sqrt(max(0.0, 1 - len(got) / others) / len(got)) < least

    def search(probes: int, depth: int) -> DataFrame:
        """(qid, cid) of the ``depth`` classes nearest by code to each query in its ``probes`` nearest lists."""

        def probe(batches: Iterator) -> Iterator:
            import pyarrow as pa

            centroids = fitted.value[1]
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    order = list_order(matrix(part.column(1), dim), centroids)
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    r, c = np.nonzero(((np.arange(len(sizes)) < probes) | (before <= depth)) & (sizes[order] > 0))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(order[r, c].astype(np.int32))], ["qid", "list"])

        asked = staged(q.select("qid", "embedding").mapInArrow(probe, "qid long, list int"), "probes")
        blocks = [{"list": r["list"], "cbs": int(-(-sizes[r["list"]] // code_block)), "qbs": int(-(-r["count"] // query_block))} for r in asked.groupBy("list").count().collect()]
        blocks = F.broadcast(literal_rows(spark, blocks, "list int, cbs int, qbs int"))
        block = lambda c, m: F.pmod(F.xxhash64(F.lit("block"), c), F.col(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        qs = asked.join(blocks, "list").join(q.select("qid", "embedding"), "qid").withColumn("qb", block("qid", "qbs")).withColumn("cb", every("cbs")).drop("cbs", "qbs")
        cs = codes.join(blocks, "list").withColumn("cb", block("cid", "cbs")).withColumn("qb", every("qbs")).drop("cbs", "qbs")

        def scan(queries_, codes_):
            import pyarrow as pa

            ids, qid = codes_.column("cid").to_numpy(), queries_.column("qid").to_numpy()
            found = ([], [], [])
            if len(ids) and len(qid):
                order = np.argsort(ids, kind="stable")
                ids, c = ids[order], np.frombuffer(b"".join(codes_.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
                norm = codes_.column("norm").to_numpy()[order].astype(np.float32)
                x = matrix(queries_.column("embedding").combine_chunks(), dim)
                keep = min(depth, len(ids))
                step = max(1, min(64, (1 << 22) // len(ids)))
                for i in range(0, len(x), step):
                    t = fitted.value[0].tables(x[i : i + step])
                    d = np.broadcast_to(norm, (len(t), len(ids))).copy()
                    for m in range(c.shape[1]):
                        d -= 2 * t[:, m, c[:, m]]
                    top = np.partition(d, keep - 1, axis=1)[:, keep - 1]
                    for r in range(len(t)):
                        at = np.flatnonzero(d[r] <= top[r])  # in order of id, with all ties at the edge
                        at = at[np.argsort(d[r][at], kind="stable")][:keep]
                        found[0].append(np.full(len(at), qid[i + r]))
                        found[1].append(ids[at])
                        found[2].append(d[r][at])
            flat = [np.concatenate(f) if f else np.zeros(0) for f in found]
            return pa.table([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.float32())], ["qid", "cid", "near"])

        near = qs.groupBy("list", "qb", "cb").cogroup(cs.groupBy("list", "qb", "cb")).applyInArrow(scan, "qid long, cid long, near float")
        per_query = Window.partitionBy("qid").orderBy("near", "cid")
        near = staged(near.withColumn("_r", F.row_number().over(per_query)).where(F.col("_r") <= depth).select("qid", "cid"), "near")
        discard(asked)
        return near

    near = search(probes, depth)
    while known is not None and (probes < lists or depth < n) and missed(near):
        discard(near)
        probes, depth = min(lists, 2 * probes), min(n, 2 * depth)
        near = search(probes, depth)
    discard(codes)
    # its own class holds the copies of a query, at no distance, and may tie in code with more than ``depth`` others
    near = near.unionByName(q.where("own is not null").select("qid", F.col("own").alias("cid")).join(near, ["qid", "cid"], "left_anti"))
    classes, q = every_class, every_query
    # the queries off the scale against all classes, the other queries against the classes off the scale
    n_far = q.where("odd").count()
    if n_far:
        near = near.unionByName(_measured(q.where("odd"), classes, n_far, n + n_odd, dim, k))
    if n_odd:
        near = near.unionByName(_measured(q.where("not odd"), classes.where("odd"), q.where("not odd").count(), n_odd, dim, k))

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            d = np.sqrt(((matrix(batch.column(3), dim) - matrix(batch.column(4), dim)) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(d)], ["qid", "cid", "id", "score"])

    full = near.join(classes.select("cid", "id", F.col("embedding").alias("y")), "cid").join(q.select("qid", F.col("embedding").alias("x")), "qid")
    exact = full.select("qid", "cid", "id", "x", "y").mapInArrow(measure, "qid long, cid long, id long, score double")
    close = Window.partitionBy("qid").orderBy("score", "id", "cid")
    exact = exact.withColumn("_r", F.row_number().over(close)).where(F.col("_r") <= k + 1)
    rows = exact.join(members, "cid").join(q.select("qid", "query_id", "own", "times"), "qid")
    same = Window.partitionBy("qid", "cid", "vec_id").orderBy("place")
    rows = rows.withColumn("_nth", F.row_number().over(same)).where(~(F.col("cid").eqNullSafe(F.col("own")) & (F.col("vec_id") == F.col("query_id")) & (F.col("_nth") == 1)))
    best = Window.partitionBy("qid").orderBy("score", "vec_id", "cid", "place")
    out = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")


# --- operator 7 -------------------------------------------------------------------------------------------------------

HELD = 1 << 22  # numbers that a step over many vectors holds at a time


class Graph:
    """A hierarchical navigable small world over unit vectors: all queries of a call walk it together, in blocks.

    A vector as near to one in the graph as ``near`` is not inserted: that one leads it (``lead``; a leader leads itself).
    So a crowd of near vectors is a few nodes with balls around them.
    """

    def __init__(self, x: np.ndarray, links: int = 12, ef: int = 40, near: float = 2.0):
        """``links`` per node and layer, twice that at the bottom; ``ef`` is the beam while building."""
        self.x, self.m, self.ef = x.astype(np.float32), links, ef
        n = len(x)
        u = (mix(np.arange(n, dtype=np.uint64)) >> np.uint64(11)).astype(float) / 2**53
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(links)).astype(int), 6)
        self.level = level
        self.layers = [np.full((n, links * (1 if k else 2)), -1, np.int32) for k in range(level.max(initial=0) + 1)]
        self.order = np.argsort(-level, kind="stable")  # the top node first: it is the entry
        self.lead = np.arange(n)
        done, size = 1, 1
        while done < n:
            batch = self.order[done : done + size]
            done += len(batch)
            self._insert(self._leaders(batch, near) if near <= 1 else batch)
            size = min(512, done)

    def _leaders(self, batch: np.ndarray, near: float) -> np.ndarray:
        """Those of the batch that no leader found, nor an earlier one among themselves, is near to."""
        q = self.x[batch]
        ids, sims = self.search(q, 8)
        covered = sims[:, 0] >= near
        self.lead[batch[covered]] = ids[covered, 0]
        batch, q = batch[~covered], q[~covered]
        own = np.tril(q @ q.T, -1) >= near
        led = np.zeros(len(batch), bool)
        for i in np.flatnonzero(own.any(1)):
            by = np.flatnonzero(own[i] & ~led)
            if len(by):
                led[i], self.lead[batch[i]] = True, batch[by[0]]
        return batch[~led]

    def _insert(self, batch: np.ndarray) -> None:
        if not len(batch):
            return
        q = self.x[batch]
        at = np.full((len(batch), 1), self.order[0])
        for k in range(len(self.layers) - 1, -1, -1):
            here = self.level[batch] >= k
            if k > 0 and not here.any():
                at, _ = self._walk(k, q, at, 1)
                continue
            ids, sims = self._walk(k, q, at, self.ef)
            at = ids[:, :1]
            rows = np.flatnonzero(here)
            peers = batch[rows]
            own = q[rows] @ q[rows].T
            np.fill_diagonal(own, -np.inf)
            own[np.triu_indices(len(rows))] = -np.inf  # earlier ones of the batch
            cand = np.concatenate([ids[rows], np.broadcast_to(peers, own.shape)], axis=1)
            sim = np.concatenate([sims[rows], own], axis=1)
            width = min(sim.shape[1], self.ef)
            best = np.argsort(-sim, axis=1, kind="stable")[:, :width]
            cand, sim = np.take_along_axis(cand, best, 1), np.take_along_axis(sim, best, 1)
            chosen = self._diverse(cand, sim, self.m)
            adj = self.layers[k]
            adj[peers, : chosen.shape[1]] = chosen
            self._back(k, peers, chosen)

    def _diverse(self, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
        """Of each row's candidates, best first, those nearer to the node than to any already taken, then the best rest."""
        vec = self.x[np.maximum(cand, 0)]
        between = np.einsum("and,amd->anm", vec, vec, optimize=True)
        valid = (cand >= 0) & (sim > -np.inf)
        taken = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            blocked = (taken & (between[:, j] > sim[:, j, None])).any(1)
            taken[:, j] = valid[:, j] & ~blocked & (taken.sum(1) < m)
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        first = np.argsort(rank, axis=1)[:, :m]
        return np.where(np.take_along_axis(valid, first, 1), np.take_along_axis(cand, first, 1), -1)

    def _back(self, k: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Links in the other direction; a full node keeps a diverse choice."""
        adj = self.layers[k]
        src, dst = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        who, start, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(count.max())
        new = np.full((len(who), width), -1, np.int32)
        col = np.arange(len(dst)) - np.repeat(start, count)
        new[np.repeat(np.arange(len(who)), count), col] = src
        step = max(1, HELD // ((adj.shape[1] + width) * self.x.shape[1]))
        for i in range(0, len(who), step):
            node = who[i : i + step]
            cand = np.concatenate([adj[node], new[i : i + step]], axis=1)
            sim = np.einsum("ad,amd->am", self.x[node], self.x[np.maximum(cand, 0)], optimize=True)
            sim[cand < 0] = -np.inf
            best = np.argsort(-sim, axis=1, kind="stable")[:, : 3 * adj.shape[1]]
            cand, sim = np.take_along_axis(cand, best, 1), np.take_along_axis(sim, best, 1)
            full = (cand >= 0).sum(1) > adj.shape[1]
            plain = cand[:, : adj.shape[1]]
            adj[node, : plain.shape[1]] = plain
            if full.any():
                kept = self._diverse(cand[full], sim[full], adj.shape[1])
                adj[node[full], : kept.shape[1]] = kept

    def _walk(self, k: int, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best nodes of a layer that a beam from ``entry`` finds: (ids, similarities), best first."""
        n, adj = len(q), self.layers[k]
        ids = np.full((n, ef), -1, np.int32)
        sims = np.full((n, ef), -np.inf, np.float32)
        e = entry[:, :ef]
        ids[:, : e.shape[1]] = e
        sims[:, : e.shape[1]] = np.where(e >= 0, np.einsum("ad,amd->am", q, self.x[np.maximum(e, 0)]), -np.inf)
        seen = np.zeros((n, len(self.x) + 1), bool)
        seen[np.arange(n)[:, None], e] = True
        done = ids < 0
        active = np.arange(n)
        while len(active):
            open_ = np.where(done[active], -np.inf, sims[active])
            w = min(wide, ef)
            pick = np.argpartition(-open_, w - 1, axis=1)[:, :w]
            ok = np.take_along_axis(open_, pick, 1) > -np.inf
            live = ok.any(1)
            active, pick, ok = active[live], pick[live], ok[live]
            if not len(active):
                break
            rows = active[:, None]
            node = np.where(ok, ids[rows, pick], 0)
            done[rows, pick] = True
            near = np.where(ok[:, :, None], adj[node], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[rows, near]] = -1
            seen[rows, near] = True  # -1 is the spare column
            cols = (near >= 0).any(0)
            near = near[:, cols]
            if not near.shape[1]:
                continue
            s = np.einsum("ad,amd->am", q[active], self.x[np.maximum(near, 0)], optimize=True)
            s[near < 0] = -np.inf
            all_s = np.concatenate([sims[active], s], axis=1)
            all_i = np.concatenate([ids[active], near], axis=1)
            all_d = np.concatenate([done[active], near < 0], axis=1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            sims[active], ids[active], done[active] = (np.take_along_axis(z, top, 1) for z in (all_s, all_i, all_d))
        best = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        q = q.astype(np.float32)
        step = max(1, min(1024, (1 << 26) // (len(self.x) + 1), 2 * HELD // (8 * self.m * self.x.shape[1])))
        parts = []
        for i in range(0, len(q), step):
            at = np.full((len(q[i : i + step]), 1), self.order[0])
            for k in range(len(self.layers) - 1, 0, -1):
                at = self._walk(k, q[i : i + step], at, 8)[0]
            parts.append(self._walk(0, q[i : i + step], at, ef))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def pack(self) -> list[bytes]:
        """All but the vectors; of a layer above the bottom, the links of its own nodes, which ``order`` has first."""
        top = [a[self.order[: int((self.level >= k).sum())]] if k else a for k, a in enumerate(self.layers)]
        return [a.tobytes() for a in (self.level.astype(np.int32), self.order.astype(np.int32), self.lead.astype(np.int32), *top)]

    @classmethod
    def unpack(cls, parts: list[np.ndarray], x: np.ndarray, links: int = 12) -> Graph:
        g = cls.__new__(cls)
        g.m, g.x = links, x.astype(np.float32)
        g.level, g.order, g.lead = (p.view(np.int32) for p in parts[:3])
        g.layers = [parts[3].view(np.int32).reshape(len(g.x), -1)]
        for p in parts[4:]:
            own = p.view(np.int32).reshape(-1, links)
            layer = np.full((len(g.x), links), -1, np.int32)
            layer[g.order[: len(own)]] = own
            g.layers.append(layer)
        return g


def pieces(parts: list[bytes], size: int = 1 << 20) -> list[bytes]:
    """Byte strings as one, cut into pieces of ``size``: a row of a table holds one piece, however large they are together."""
    whole = b"".join([np.array([len(parts), *map(len, parts)], np.int64).tobytes(), *parts])
    return [whole[i : i + size] for i in range(0, len(whole), size)]


def joined(place, parts) -> list[np.ndarray]:
    """The byte strings of ``pieces`` from Arrow columns in any order, as arrays on one buffer."""
    at = np.argsort(place.to_numpy(), kind="stable")
    raw = [np.frombuffer(v.as_buffer(), np.uint8) for c in parts.chunks for v in c.flatten()]  # one piece a row
    whole = np.concatenate([raw[i] for i in at])
    n = int(whole[:8].view(np.int64)[0])
    ends = np.cumsum(np.concatenate(([8 * (n + 1)], whole[8 : 8 * (n + 1)].view(np.int64))))
    return [whole[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


class Balls:
    """The balls of a graph: each leader's members by their angle to it, with the weights of members added up."""

    def __init__(self, graph: Graph, unit: np.ndarray, weight: np.ndarray):
        self.unit, self.lead, self.weight = unit, graph.lead.astype(np.int64), weight
        cos = (unit * unit[self.lead]).sum(1)
        self.angle = np.where(self.lead == np.arange(len(unit)), 0.0, np.arccos(np.clip(cos, -1, 1)))
        self.order = np.lexsort((self.angle, self.lead))
        self.key = 4.0 * self.lead[self.order] + self.angle[self.order]  # an angle is below 4
        self.sums = np.concatenate(([0], np.cumsum(weight[self.order])))
        n = len(unit)
        self.lo = np.searchsorted(self.lead[self.order], np.arange(n), "left")
        self.hi = np.searchsorted(self.lead[self.order], np.arange(n), "right")
        self.radius = np.zeros(n)
        some = self.hi > self.lo
        self.radius[some] = self.angle[self.order[self.hi[some] - 1]]

    def links(self, uq: np.ndarray, rows: np.ndarray, leads: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """For each (query row, leader): the weight of the ball's members within the threshold, and whether there are any.

        By the triangle inequality of angles the members next to the leader are within it and those far off are not; the
        ones between are compared, in blocks.
        """
        eps, most = 1e-6, np.arccos(np.clip(cosine, -1, 1))
        beta = np.arccos(np.clip((uq[rows] * self.unit[leads]).sum(1), -1, 1))
        lo, hi = self.lo[leads], self.hi[leads]
        at = lambda limit: np.clip(np.searchsorted(self.key, 4.0 * leads + np.clip(limit, -1, 3.9)), lo, hi)
        sure = np.where(beta + eps < most, at(most - beta - eps), lo)
        start = np.maximum(sure, at(beta - most - eps))
        end = np.maximum(at(beta + most + eps), start)
        total = (self.sums[sure] - self.sums[lo]).astype(np.int64)
        many = end - start
        for i, j in _spans(np.concatenate(([0], np.cumsum(many))), 1 << 16):
            pair = np.repeat(np.arange(i, j), many[i:j])
            place = np.arange(len(pair)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j]) + start[pair]
            for k in range(0, len(pair), 1 << 16):
                p, m = pair[k : k + (1 << 16)], self.order[place[k : k + (1 << 16)]]
                good = (uq[rows[p]] * self.unit[m]).sum(1) >= cosine
                np.add.at(total, p[good], self.weight[m[good]])
        return total, total > 0


def _spans(offsets: np.ndarray, size: int):
    """Ranges of rows with about ``size`` entries each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def linked_balls(graph: Graph, balls: Balls, uq: np.ndarray, own: np.ndarray, cosine: float, ef: int = 64, audit: int = 128, held: int = HELD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's weight linked, and links (a, b) that span the same components as all its links: a leader is its node, a
    query the number of nodes and its row. ``own`` is a query's node here, or -1.

    Queries go in strips of about ``held`` places of a beam, and the pairs of a strip are given up for its counts and links.
    A query with near nodes in half of its beam walks again with a beam twice as wide. Then up to ``audit`` evenly chosen queries, half
    of them among those with links, are compared with all nodes; if the graph missed any of their links, every query walks
    with a wider beam, until the audit passes or the beam holds all nodes.
    """
    n = len(balls.unit)
    edge = np.cos(min(np.pi, np.arccos(np.clip(cosine, -1, 1)) + balls.radius.max(initial=0.0))) - 1e-5  # single precision walks, double decides
    while True:
        counts, a, b = np.zeros(len(uq), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        todo, width = np.arange(len(uq)), min(ef, n)
        while len(todo):
            again, step = [], max(1, held // width)
            for i in range(0, len(todo), step):
                part = todo[i : i + step]
                ids, sims = graph.search(uq[part], width)
                full = (sims[:, width // 2] >= edge) & (width < n)
                again.append(part[full])
                r, c = np.nonzero((sims >= edge) & (ids >= 0) & ~full[:, None])
                home = part[~full & (own[part] >= 0)]
                pairs = np.unique(np.concatenate([home * n + balls.lead[own[home]], part[r] * n + ids[r, c]]))
                rows, nodes = pairs // n, pairs % n
                total, some = balls.links(uq, rows, nodes, cosine)
                np.add.at(counts, rows, total)
                a, b = np.concatenate([a, n + rows[some]]), np.concatenate([b, nodes[some]])
                if len(a) > held:
                    a, b = _forest(a, b)
            todo, width = np.concatenate(again), min(2 * width, n)
        if ef >= n:
            return counts, a, b
        linked = np.flatnonzero(counts)
        asked = np.unique(np.concatenate([np.linspace(0, len(uq) - 1, min(audit // 2, len(uq))).astype(int), linked[np.linspace(0, len(linked) - 1, min(audit // 2, len(linked))).astype(int)]]))
        got = counts[asked]
        want = np.concatenate([(uq[asked[i : i + 8]] @ balls.unit.T >= cosine + 1e-12) @ balls.weight for i in range(0, len(asked), 8)]) if len(asked) else got
        if (got >= want).all():
            return counts, a, b
        ef *= 2


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of any ids as links of the same components: each id with the least of its component, once."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        least = np.minimum(low[x], low[y])
        for end in (x, y):
            np.minimum.at(new, end, least)
            np.minimum.at(new, low[end], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    more = low != np.arange(len(ids))
    return ids[more], ids[low[more]]


def near_vectors(vectors: DataFrame, cosine: float = 0.95, shards: int = 8, shard_rows: int = 200_000, query_block: int | None = None, shard_bytes: int = 1 << 27) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Equal vectors form a class; classes are dealt to shards by hash, each shard builds a graph, and every class queries
    every shard. In a shard, vectors within a quarter of the threshold's angle of one in the graph are its ball and no
    nodes; links with the members of a ball are counted from angles to its leader, and only members that these leave open
    are compared. A task returns each query's number of links and a spanning forest of its links, never the pairs. The
    number of shards is ``shards``, or more where a shard would pass ``shard_rows`` or its graph ``shard_bytes``, which a task
    holds a few times; a graph is rows of 1 MiB each, so that no row grows with it;
    queries come in blocks of ``query_block`` (a sixteenth of all, from 16,384 to 131,072), or less where their vectors would
    pass ``shard_bytes``. Links have a cosine of ``cosine`` or more on the original
    vectors. Vectors that are null, zero, not finite or of another length than most link with nothing: 0 links, own
    component. A row without id has a null component and is not kept. Of rows that share an id, each has its own links and
    its own component, and counts as another vector; equal rows have equal results.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    dim = common_length(good)
    good = good.where(F.size("embedding") == dim).withColumns({"c1": F.xxhash64("embedding"), "c2": F.xxhash64(F.lit("v"), "embedding")})
    classes = good.groupBy("c1", "c2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("embedding").alias("embedding"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    # a node holds its vector in double and single precision, 24 links at the bottom, 12 in every layer above, and ids
    shard_rows = max(1, min(shard_rows, shard_bytes // (12 * dim + 512)))
    query_block = max(1, min(query_block or min(131_072, max(16_384, n // 16)), shard_bytes // (8 * dim + 8)))
    n_shards, n_q = max(min(shards, n), -(-n // shard_rows), 1), -(-n // query_block) or 1
    part = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "c1", "c2"), F.lit(m)).cast("int")
    members = classes.select("cid", "w", "embedding", part("shard", n_shards).alias("shard"))
    ball = float(np.cos(np.arccos(np.clip(cosine, -1, 1)) / 4))

    def unit(x):
        """Rows of length 1; a power of two first brings their largest components near 1, so no square leaves the range."""
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
        return x / np.sqrt((x * x).sum(1))[:, None]

    def build(table):
        import pyarrow as pa

        order = np.argsort(table.column("cid").to_numpy(), kind="stable")
        x = matrix(table.column("embedding").combine_chunks(), dim)[order]
        g = Graph(unit(x), near=ball)
        cut = pieces([table.column("cid").to_numpy()[order].tobytes(), table.column("w").to_numpy()[order].tobytes(), x.tobytes(), *g.pack()])
        shard = [table.column("shard")[0].as_py()] * len(cut)
        return pa.table([pa.array(shard, pa.int32()), pa.array(range(len(cut)), pa.int32()), pa.array([[c] for c in cut], pa.list_(pa.binary()))], ["shard", "place", "parts"])

    graphs = staged(members.groupBy("shard").applyInArrow(build, "shard int, place int, parts array<binary>"), "graphs")

    def ask(queries, graph):
        import pyarrow as pa

        a = b = many = np.zeros(0, np.int64)
        if queries.num_rows and graph.num_rows:
            parts = joined(graph.column("place"), graph.column("parts"))
            ids, weight, u = parts[0].view(np.int64), parts[1].view(np.int64), unit(parts[2].view(np.float64).reshape(-1, dim))
            g = Graph.unpack(parts[3:], u)
            balls = Balls(g, u, weight)
            qid = queries.column("cid").to_numpy()
            own = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
            own = np.where(ids[own] == qid, own, -1)
            counts, r, c = linked_balls(g, balls, unit(matrix(queries.column("embedding").combine_chunks(), dim)), own, cosine)
            led = np.flatnonzero(balls.lead != np.arange(len(ids))) if graph.column("qb")[0].as_py() == 0 else a
            name = np.concatenate([ids, qid])
            a, b = _forest(np.concatenate([name[r], ids[led]]), np.concatenate([name[c], ids[balls.lead[led]]]))
            some = np.flatnonzero(counts)
            a, b, many = np.concatenate([a, qid[some]]), np.concatenate([b, np.full(len(some), -1)]), np.concatenate([np.zeros(len(a), np.int64), counts[some]])
        return pa.table([pa.array(a), pa.array(b), pa.array(many)], ["a", "b", "many"])

    qs = classes.select("cid", "embedding", part("block", n_q).alias("qb")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    gs = graphs.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    found = staged(qs.groupBy("shard", "qb").cogroup(gs.groupBy("shard", "qb")).applyInArrow(ask, "a long, b long, many long"), "vector-links")
    discard(graphs)

    counts = found.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("many").alias("many"))
    comp = components(found.where("b >= 0").select("a", "b").distinct()).withColumnRenamed("node", "cid")
    known = classes.select("c1", "c2", "cid", "id", "w").join(counts, "cid", "left").join(comp, "cid", "left")
    known = known.select("c1", "c2", "id", (F.greatest(F.coalesce("many", "w"), "w") - 1).alias("links"), F.coalesce("component", "cid").alias("comp"))
    known = staged(known, "vector-classes")
    low = known.groupBy("comp").agg(F.min("id").alias("low"))
    known = staged(known.join(low, "comp").select("c1", "c2", "links", F.col("low").alias("comp")), "vector-components")
    discard(classes, found)

    ok = usable(F.col("embedding")) & (F.size("embedding") == dim) & F.col("vec_id").isNotNull()
    tagged = rows.withColumn("ok", ok).select("vec_id", F.when(F.col("ok"), F.xxhash64("embedding")).alias("c1"), F.when(F.col("ok"), F.xxhash64(F.lit("v"), "embedding")).alias("c2"))
    out = tagged.join(known, ["c1", "c2"], "left")
    component = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
