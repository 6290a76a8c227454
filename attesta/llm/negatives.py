"""Operator 12: hard negatives by exact integer scores, multiplied in a residue number system."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

LIMIT = 2.0**128  # components at least as large take no part; a float column has none


def _primes(below: int = 256) -> list[int]:
    """Odd primes under ``below``, largest first; a centred residue of one is at most 127."""
    return [p for p in range(below - 1, 2, -1) if all(p % q for q in range(2, int(p**0.5) + 1))]


PRIMES = _primes()
_LOG = np.cumsum(np.log2(np.array(PRIMES, float)))
DEPTH = 1024  # products of centred residues that add up exactly in float32: 1024 * 127 * 127 < 2**24
HELD = 1 << 18  # products that a task holds at a time, some 50 bytes each with the work on them


def moduli(bound: np.ndarray) -> np.ndarray:
    """How many of ``PRIMES`` tell all integers in [-bound, bound] apart."""
    return np.searchsorted(_LOG, np.log2(np.maximum(bound, 1.0)) + 1.01) + 1


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Integers (as doubles of any size) modulo ``p``, centred around 0; exact, for fmod is."""
    r = np.fmod(x, p)
    half = (p - 1) // 2
    return np.where(r > half, r - p, np.where(r < -half, r + p, r)).astype(np.float32)


def multiply(ra: list[np.ndarray], rb: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exact inner products of the rows of two matrices, given as their ``residues`` by the first moduli.

    Each modulus takes one float32 matrix product of centred residues. Chinese remaindering turns the residues into balanced
    mixed-radix digits, whose weighted sum is the signed product itself. Returns it as int64, and where it fits into one.
    """
    digits: list[np.ndarray] = []
    n, m, count = len(ra[0]), len(rb[0]), len(ra)
    for i, p in enumerate(PRIMES[:count]):
        dim = ra[i].shape[1]
        r = ra[i][:, :DEPTH] @ rb[i][:, :DEPTH].T
        for k in range(DEPTH, dim, DEPTH):
            r = _centre(r, p, DEPTH) + _centre(ra[i][:, k : k + DEPTH] @ rb[i][:, k : k + DEPTH].T, p, DEPTH)
        if i:
            r = _centre(r, p, DEPTH) if dim + i > DEPTH else r
            weight = 1
            for d, q in zip(digits, PRIMES[:i], strict=True):  # what the digits so far stand for goes, and the rest is divided by their weight, all modulo p
                r -= d * np.float32(weight if 2 * weight < p else weight - p)
                weight = weight * q % p
            weight = pow(weight, -1, p)
            r = _centre(r, p, min(dim, DEPTH) + i)
            r *= np.float32(weight if 2 * weight < p else weight - p)
        digits.append(_centre(r, p, min(dim, DEPTH) + 1))
    small = _LOG[count - 1] < 52
    exact, near = None if small else np.zeros((n, m), np.int64), np.zeros((n, m))
    with np.errstate(over="ignore"):
        for d, p in zip(digits[::-1], PRIMES[count - 1 :: -1], strict=True):
            near *= p
            near += d
            if not small:
                exact *= np.int64(p)  # modulo 2**64, which does no harm where the end fits
                exact += d.astype(np.int64)
    return (near.astype(np.int64), np.ones((n, m), bool)) if small else (exact, np.abs(near) < 2.0**63 * (1 - 2.0**-40))


def _centre(r: np.ndarray, p: int, terms: int) -> np.ndarray:
    """Sums of ``terms`` (up to about ``DEPTH``) products of residues, held exactly in float32, modulo ``p`` and centred around 0, in place.

    Of 2**21 and more, a quotient may be rounded to the wrong side: a second step mends that.
    """
    for _ in range(1 if terms * 127 * 127 < 2**21 else 2):
        whole = r * np.float32(1 / p)
        np.rint(whole, out=whole)
        whole *= np.float32(p)
        r -= whole
    return r


def strips(a: np.ndarray, b: np.ndarray, held: int = HELD):
    """(first row, products, where they fit) of the rows of ``a`` with all of ``b``, a few rows at a time: about ``held`` products.

    ``multiply`` takes as many moduli as the norms need: rows of ``b`` that need more are multiplied by themselves.
    """
    norm = lambda x: np.abs(x).max(1, initial=0.0) * np.sqrt(x.shape[1])  # noqa: E731  at least the length of each row
    need = moduli(norm(a).max(initial=0.0) * norm(b))
    groups = [(own := np.flatnonzero(need == count), [residues(b[own], p) for p in PRIMES[:count]]) for count in np.unique(need)]
    step = max(1, held // max(1, len(b)))
    for i in range(0, len(a), step):
        ra = [residues(a[i : i + step], p) for p in PRIMES[: need.max(initial=0)]]
        if len(groups) == 1:
            exact, fits = multiply(ra, groups[0][1])
        else:
            exact, fits = np.zeros((len(a[i : i + step]), len(b)), np.int64), np.zeros((len(a[i : i + step]), len(b)), bool)
            for own, rb in groups:
                exact[:, own], fits[:, own] = multiply(ra[: len(rb)], rb)
        yield i, exact, fits


def scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All products of ``strips`` at once: for few rows."""
    parts = [(exact, fits) for _, exact, fits in strips(a, b)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _first(mask: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of one row of scores, the places of its ``k`` highest under ``mask``, ties by smaller id."""
    at = np.flatnonzero(mask)
    if len(at) > k:
        edge = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= edge]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _rows(array, dim: int) -> np.ndarray:
    return np.asarray(array.flatten(), np.float64).reshape(-1, dim)


def scaled(vectors: DataFrame, relabel_every: int, labels: int, scale: int) -> DataFrame:
    """Rows that take part: rid, vec_id, label (moved on by one where vec_id is a multiple) and integer components ``v``."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: _floor(x * F.lit(float(scale))))
    own = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % relabel_every == 0, (own + 1) % labels).otherwise(own) if relabel_every else own
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT * scale))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def _floor(x: Column) -> Column:
    """The floor of a double as a double of any size; those from 2**52 on are whole."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def hard_negatives(
    vectors: DataFrame, anchor_every: int = 50, relabel_every: int = 7, labels: int = 10, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    block_values: int = 1 << 19,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels
    whose score lies within [low, high] percent of the positive's.

    ``vectors`` has vec_id, embedding and label; anchors are the rows whose vec_id is a multiple of ``anchor_every``. A
    component x counts as floor(scale * x), a score is the integer inner product, ties go to the smaller vec_id; where vec_id
    is a multiple of ``relabel_every`` the label moves on by one modulo ``labels`` first. Returns anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    Anchors and rows meet in blocks of about ``block_values`` components (anchors first with the rows of their own label, then
    with those of the others), each multiplied by ``strips``, so a task holds the rows of two blocks and ``HELD`` products; a
    block returns its few best, and a window over the blocks of an anchor keeps the best of all. A label with a third of all
    rows is many blocks.

    Rows with a null id, label, vector or component, a component that is not finite or at least 2**128, or of another length
    than most take no part. Zero vectors do. A score that does not fit into 64 bits takes no part either. Rows that share an
    id, or are equal, are rows of their own: as anchors each has its rows, and each is a candidate for all but itself. Other
    columns are dropped; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, relabel_every, labels, scale)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not sizes:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim = sizes["d"]
    rows = staged(rows.where(F.size("v") == dim).withColumn("rid", F.monotonically_increasing_id()), "scaled")
    per_block = max(256, block_values // dim)
    others = rows.select(*(F.col(x).alias(x) for x in rows.columns))  # columns of their own, as the two sides of a cogroup need
    is_anchor = F.col("vec_id") % anchor_every == 0
    anchor = rows.where(is_anchor)
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(is_anchor.cast("long")).alias("m"))
    counts = counts.select("label", F.ceil(F.col("n") / per_block).cast("int").alias("nb"), F.greatest(F.lit(1), F.ceil(F.col("m") / per_block)).cast("int").alias("mb"))
    block = lambda n: F.pmod(F.xxhash64(F.lit("block"), "rid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    # --- positives: an anchor meets the blocks of its own label
    a = anchor.join(counts, "label").withColumn("ab", block(F.col("mb"))).withColumn("cb", every(F.col("nb"))).drop("nb", "mb")
    c = others.join(counts, "label").withColumn("cb", block(F.col("nb"))).withColumn("ab", every(F.col("mb"))).drop("nb", "mb")

    def near(left, right):
        import pyarrow as pa

        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            rid, ids = right.column("rid").to_numpy(), right.column("vec_id").to_numpy()
            own = left.column("rid").to_numpy()
            for first, exact, fits in strips(_rows(left.column("v").combine_chunks(), dim), _rows(right.column("v").combine_chunks(), dim)):
                for i, r in enumerate(own[first : first + len(exact)]):
                    at = _first(fits[i] & (rid != r), exact[i], ids, positives)
                    out[0] += [r] * len(at)
                    out[1] += ids[at].tolist()
                    out[2] += exact[i][at].tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], ["arid", "positive_id", "positive_score"])

    best = Window.partitionBy("arid").orderBy(F.desc("positive_score"), "positive_id")
    found = a.groupBy("label", "ab", "cb").cogroup(c.groupBy("label", "ab", "cb")).applyInArrow(near, "arid long, positive_id long, positive_score long")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    chosen = found.groupBy("arid").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    asked = staged(anchor.join(chosen.withColumnRenamed("arid", "rid"), "rid").select("rid", "vec_id", "label", "v", "p"), "anchors")

    # --- negatives: every anchor meets every block, and looks into its windows
    n, m = rows.count(), asked.count()
    nb, mb = -(-n // per_block), max(1, -(-m // per_block))
    a = asked.withColumn("ab", block(F.lit(mb))).withColumn("cb", every(F.lit(nb)))
    c = others.withColumn("cb", block(F.lit(nb))).withColumn("ab", every(F.lit(mb)))

    def windows(left, right):
        import pyarrow as pa

        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, own = right.column("vec_id").to_numpy(), right.column("label").to_numpy()
            rids, marks, asks = left.column("rid").to_pylist(), left.column("label").to_pylist(), left.column("p").to_pylist()
            for first, exact, fits in strips(_rows(left.column("v").combine_chunks(), dim), _rows(right.column("v").combine_chunks(), dim)):
                for i in range(len(exact)):
                    r, label, ps = rids[first + i], marks[first + i], asks[first + i]
                    other = np.flatnonzero(fits[i] & (own != label))
                    score, oid = exact[i][other], ids[other]
                    for p in ps:  # low * s <= 100 * t <= high * s, in whole numbers that never overflow
                        at = _first((score >= -(-low * p["positive_score"] // 100)) & (score <= high * p["positive_score"] // 100), score, oid, negatives)
                        out[0] += [r] * len(at)
                        out[1] += [p["place"]] * len(at)
                        out[2] += oid[at].tolist()
                        out[3] += score[at].tolist()
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["rid", "place", "negative_id", "negative_score"])

    hits = a.groupBy("ab", "cb").cogroup(c.groupBy("ab", "cb")).applyInArrow(windows, "rid long, place int, negative_id long, negative_score long")
    best = Window.partitionBy("rid", "place").orderBy(F.desc("negative_score"), "negative_id")
    hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    pairs = asked.select("rid", F.col("vec_id").alias("anchor_id"), F.explode("p").alias("p")).select("rid", "anchor_id", "p.*")
    return hits.join(pairs, ["rid", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: For unique vec_id, as the table has them.
ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label AS label, cast(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a, e b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, cast(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 3
"""
