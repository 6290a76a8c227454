"""Joins, aggregations, windows, top-k and set operations of the engine, each DataFrame to DataFrame."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import columns as fn
from attesta.sources import io

# --- filters (FLT) ----------------------------------------------------------------------------------------------------


def filter_eq(df: DataFrame, **wanted) -> DataFrame:
    """Equality on each column given; a None is no filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in wanted.items() if v is not None), df)


def coerce_vocab(value: str, vocabulary: list[str]) -> str:
    """The canonical spelling of a value, or an error that lists the vocabulary."""
    found = {v.upper(): v for v in vocabulary}.get(value.strip().upper())
    if found is None:
        raise ValueError(f"{value!r} is none of {', '.join(vocabulary)}")
    return found


def ranked_only(df: DataFrame, include_unranked: bool = False) -> DataFrame:
    return df if include_unranked else df.where(F.col("rank").isNotNull())


def filter_in(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    return df.where(F.upper(col).isin([v.upper() for v in values]))


def as_of(df: DataFrame, day: Column | None, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Intervals [start, end) that hold on a day, an open end being null; without a day, those that are open."""
    if day is None:
        return df.where(F.col(end).isNull())
    return df.where((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) > day)))


# --- joins (JN) -------------------------------------------------------------------------------------------------------


def with_optional(df: DataFrame, dim: DataFrame, key: str | list[str]) -> DataFrame:
    """``df`` with the columns of ``dim`` where it has the key; of a key that ``dim`` repeats, the first by its other columns."""
    return df.join(one_per_key(dim, [key] if isinstance(key, str) else key), key, "left")


def with_default(df: DataFrame, dim: DataFrame, key: str, col: str, default) -> DataFrame:
    """A lookup column with a default. Spark broadcasts the dimension where its size is below the session's threshold."""
    return df.join(dim.select(key, col), key, "left").withColumn(col, F.coalesce(col, F.lit(default)))


def having_match(df: DataFrame, other: DataFrame, key: str, predicate: Column | None = None) -> DataFrame:
    return df.join(other if predicate is None else other.where(predicate), key, "left_semi")


def heads(decisions: DataFrame, id_col: str = "decision_id", parent: str = "supersedes_decision_id") -> DataFrame:
    """Rows that no row supersedes."""
    later = decisions.where(F.col(parent).isNotNull()).select(F.col(parent).alias(id_col)).distinct()
    return decisions.join(later, id_col, "left_anti")


def pending(candidates: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    return candidates.join(reviews.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def pairs_within(df: DataFrame, group: str, order: str, differs: str) -> DataFrame:
    """Unordered pairs of a group whose ``differs`` columns are not equal.

    For groups of a bounded size, such as the versions of one record: the pairs of a group grow with its square. Copies of a
    text have no such bound; ``plans.research.mirrors`` keeps representatives instead.
    """
    d = df.select(group, order, differs).distinct()
    a, b = d.select(group, F.col(order).alias("left"), F.col(differs).alias("_da")), d.select(group, F.col(order).alias("right"), F.col(differs).alias("_db"))
    return a.join(b, group).where((F.col("left") < F.col("right")) & (F.col("_da") != F.col("_db"))).drop("_da", "_db")


#: Left texts that one block holds in ``fuzzy_join``, right ones are twice as many; the most common trigrams, which are bits there.
_MEET, _BITS = 16384, 128


def _best_of_block(left, right, threshold: float, k: int):
    """Of two blocks of texts (Arrow: lt, codes; rt, codes, low), the best ``k`` right texts of each left one, ties to the lower ``low``.

    What two texts share of the rarer trigrams is counted by the right texts' lists. Only pairs that all common trigrams of
    the one that has fewer could lift above the threshold are looked at, and common trigrams are counted as bits.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def codes(table):
        c = table.column("codes").combine_chunks()
        sizes = np.diff(np.asarray(c.offsets))
        values = np.asarray(c.flatten())
        row = np.repeat(np.arange(len(sizes)), sizes)
        bit = values < _BITS
        bits = np.zeros((len(sizes), _BITS // 64), np.uint64)
        np.bitwise_or.at(bits, (row[bit], values[bit] >> 6), np.uint64(1) << (values[bit] & 63).astype(np.uint64))
        return sizes, np.bincount(row[bit], minlength=len(sizes)), bits, row[~bit], values[~bit]

    out: list[list] = [[], [], []]
    if left.num_rows and right.num_rows:
        right = right.take(pc.sort_indices(right.column("low"), null_placement="at_start"))
        lt, rt = left.column("lt").to_numpy(), right.column("rt").to_numpy()
        size, common, bits, row, rare = codes(left)
        rsize, rcommon, rbits, rrow, rrare = codes(right)
        order = np.argsort(rrare, kind="stable")
        rrow, rrare = rrow[order], rrare[order]
        start, end = (np.searchsorted(rrare, rare, side).tolist() for side in ("left", "right"))
        ends = np.searchsorted(row, np.arange(len(lt) + 1)).tolist()
        share = threshold / (1 + threshold)  # of both sizes: what texts on the threshold share
        lacks, last = np.zeros(0), None
        for i in np.lexsort((common, size)).tolist():
            if (key := (size[i], common[i])) != last:
                lacks, last = np.floor(share * (size[i] + rsize) - 1e-6).astype(np.int64) - np.minimum(common[i], rcommon), key
            lists = [rrow[start[j] : end[j]] for j in range(ends[i], ends[i + 1])]
            count = np.bincount(np.concatenate(lists), minlength=len(rt)) if lists else np.zeros(len(rt), np.int64)
            at = np.flatnonzero(count > lacks)
            if len(at):
                both = count[at] + np.bitwise_count(rbits[at] & bits[i]).sum(1)
                alike = both / (size[i] + rsize[at] - both)
                at, alike = at[alike > threshold], alike[alike > threshold]
                best = np.argsort(-alike, kind="stable")[:k]
                out[0].append(np.full(len(best), lt[i]))
                out[1].append(rt[at[best]])
                out[2].append(alike[best])
    flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
    return pa.table([pa.array(x, t) for x, t in zip(flat, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["lt", "rt", "similarity"])


def fuzzy_join(left: DataFrame, right: DataFrame, lid: str, ltext: str, rid: str, rtext: str, threshold: float = 0.55, k: int = 25) -> DataFrame:
    """(lid, rid, similarity): trigram similarity above the threshold, the best ``k`` per left row, ties to the lower id.

    Equal texts are joined once. Texts are short and their trigrams common, so nearly all pairs share a rare one of theirs:
    left and right texts are dealt to blocks, each two blocks meet in a task, and every pair is counted there, some 9 ns each. A task returns no more than ``k`` texts for each left text, and no pair is shuffled before.
    Of a right text no more than its ``k`` lowest ids can be among a left row's best, and only ``k`` texts by their lowest id;
    the best are chosen per left text before they are given to its rows, so a common text multiplies nothing.
    """
    lt, rt = (io.staged(d.select(F.col(t).alias("text")).distinct().withColumn("grams", fn.trigrams("text")).where(F.size("grams") > 0).withColumn("id", F.monotonically_increasing_id()), "texts") for d, t in ((left, ltext), (right, rtext)))
    freq = lt.select(F.explode("grams").alias("g")).union(rt.select(F.explode("grams").alias("g"))).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # letters and digits have at most 37 * 37 * 37 trigrams: a numbering in one window is bounded
    codes = F.broadcast(io.staged(freq.select("g", (F.row_number().over(Window.orderBy(F.desc("n"), "g")) - 1).alias("code")), "gram-codes"))
    coded = lambda d, of: d.select(F.col("id").alias(of), F.explode("grams").alias("g")).join(codes, "g").groupBy(of).agg(F.collect_list("code").alias("codes"))
    name = lambda d, of: d.select(F.col("text").alias("_text"), F.col("id").alias(of))
    low = Window.partitionBy("rt").orderBy("_r")
    ids = right.select(F.col(rtext).alias("_text"), F.col(rid).alias("_r")).join(name(rt, "rt"), "_text").select("rt", "_r").withColumn("_n", F.row_number().over(low)).where(F.col("_n") <= k)
    ids = io.staged(ids, "lowest-ids")

    n, m = lt.count(), rt.count()
    blocks, others = max(1, -(-n // min(_MEET, max(512, n // 32)))), max(1, -(-m // (2 * _MEET)))
    dealt = lambda of, count: F.pmod(F.xxhash64(of), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    tasks = min(blocks * others, 2048)
    lb = coded(lt, "lt").withColumn("lb", dealt("lt", blocks)).withColumn("rb", each(others)).repartition(tasks, "lb", "rb")
    rb = coded(rt, "rt").join(ids.where("_n = 1").select("rt", F.col("_r").alias("low")), "rt").withColumn("rb", dealt("rt", others)).withColumn("lb", each(blocks)).repartition(tasks, "lb", "rb")
    met = lb.groupBy("lb", "rb").cogroup(rb.groupBy("lb", "rb")).applyInArrow(lambda x, y: _best_of_block(x, y, threshold, k), "lt long, rt long, similarity double")
    best = Window.partitionBy("lt").orderBy(F.desc("similarity"), "_r")
    top = io.staged(met.join(ids.where("_n = 1"), "rt").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("lt", "rt", "similarity"), "best-texts")
    top = top.join(ids.drop("_n"), "rt").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("lt", "_r", "similarity").join(name(lt, "lt"), "lt")
    return left.select(F.col(lid).alias(lid), F.col(ltext).alias("_text")).join(top, "_text").select(lid, F.col("_r").alias(rid), "similarity")


def compare(a: DataFrame, b: DataFrame, key: str, score: str = "score", rank: str = "rank") -> DataFrame:
    """Rows of two runs that have a score in both: key, delta and whether the rank moved."""
    x, y = a.select(key, F.col(score).alias("_sa"), F.col(rank).alias("_ra")), b.select(key, F.col(score).alias("_sb"), F.col(rank).alias("_rb"))
    j = x.join(y, key).where("_sa is not null and _sb is not null")
    return j.select(key, F.round(F.abs(F.col("_sa") - F.col("_sb")), 6).alias("delta"), (~F.col("_ra").eqNullSafe(F.col("_rb"))).alias("rank_moved"))


def chain(decisions: DataFrame, id_col: str = "decision_id", parent: str = "supersedes_decision_id") -> DataFrame:
    """(id, root, depth) by pointer doubling: the number of joins is the logarithm of the longest chain.

    Rounds go on until every pointer stands on a root, and each is staged. A row whose pointer is known to stand on a
    root takes part no more, so a long chain does not gather at its root. A parent that is no row is a root. A cycle is
    an error.
    """
    cur = decisions.select(F.col(id_col).alias("id"), F.coalesce(parent, id_col).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"), F.col(parent).isNull().alias("top"))
    cur = io.staged(cur, "chain")
    rows, hop = cur.count(), 1
    while not cur.where("not top").isEmpty():
        if hop > rows:
            raise ValueError(f"{parent} runs in a cycle")
        up = cur.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("top").alias("top2"))
        moved = cur.where("not top").join(up, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("top2", F.lit(True)).alias("top"))
        old, cur = cur, io.staged(cur.where("top").unionByName(moved), "chain")
        io.discard(old)
        hop *= 2
    return cur.select(F.col("id").alias(id_col), F.col("up").alias("root"), "depth")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of an undirected edge list: the smallest node reachable, by large-star and small-star rounds."""
    cur = io.staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, cur = cur, io.staged(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        io.discard(old)
        # every node points at one node, which points nowhere
        loose = cur.join(cur.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if loose.isEmpty() and cur.groupBy("u").count().where("count > 1").isEmpty():
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())


def parts(df: DataFrame, share: int = 32) -> int:
    """``share`` parts for each split of a scan, so that a part's rows do not grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), share * df.rdd.getNumPartitions())


def spread(df: DataFrame, *keys: str, share: int = 32) -> DataFrame:
    """``df`` dealt by key into ``share`` parts for each split of its scan."""
    return df.repartition(parts(df, share), *keys)


def provenance_violations(walk: DataFrame, evidence: str, owner: str) -> DataFrame:
    """Evidence that a provenance walk leads to no owner or to several."""
    return walk.groupBy(evidence).agg(F.countDistinct(owner).alias("owners")).where("owners <> 1")


def edges_of(rel: DataFrame, node, source: str = "from_id", target: str = "to_id") -> DataFrame:
    """Edges from or to a node, as two equi-filters."""
    return rel.where(F.col(source) == node).union(rel.where((F.col(target) == node) & (F.col(source) != node)))


def edges_of_each(rel: DataFrame, nodes: DataFrame, node: str, source: str = "from_id", target: str = "to_id") -> DataFrame:
    """The edges from or to each of many nodes, with the node and ``outward``: two equi-joins, an edge to itself once."""
    n = nodes.select(node).where(F.col(node).isNotNull()).distinct()
    out = rel.withColumn(node, F.col(source)).join(n, node).withColumn("outward", F.lit(True))
    return out.unionByName(rel.where(~F.col(source).eqNullSafe(F.col(target))).withColumn(node, F.col(target)).join(n, node).withColumn("outward", F.lit(False)))


# --- aggregations (AG) ------------------------------------------------------------------------------------------------


def coverage_score(components: DataFrame, by: list[str], earned: str = "earned", weight: str = "weight", confidence: str | None = None) -> DataFrame:
    """Score renormalised over covered weight, coverage, and mean confidence times coverage. Null earned is uncovered.

    A billionth is added before rounding, so that decimal ties go up in whatever order a sum was taken.
    """
    covered = F.when(F.col(earned).isNotNull(), F.col(weight))
    out = {
        "score": F.round(F.sum(earned) / F.nullif(F.sum(covered), F.lit(0.0)) * 100 + 1e-9, 6),
        "coverage": F.coalesce(F.sum(covered), F.lit(0.0)) / F.sum(weight),
    }
    if confidence:
        mean = F.sum(F.when(F.col(earned).isNotNull(), F.col(confidence) * F.col(weight))) / F.nullif(F.sum(covered), F.lit(0.0))
        out["confidence"] = F.round(fn.clamp(F.coalesce(mean * out["coverage"], F.lit(0.0)) + 1e-9), 4)
    return components.groupBy(*by).agg(*[c.alias(n) for n, c in out.items()])


def envelope(df: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(low).alias("min"), F.max(high).alias("max"))


def set_envelope(df: DataFrame, by: list[str], values: str) -> DataFrame:
    """The union of arrays, sorted."""
    return df.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(values)))).alias("values"))


def scalar_envelope(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("values"))


def winners(df: DataFrame, by: list[str], precedence: list[Column], value: str, ties: int) -> DataFrame:
    """Per key the first row in order of precedence, with ``conflict``: rows equal to it in the first ``ties`` keys hold another value."""
    w = Window.partitionBy(*by)
    d = df.withColumns({"_n": F.row_number().over(w.orderBy(*precedence)), "_k": F.rank().over(w.orderBy(*precedence[:ties]))})
    top = d.where("_k = 1").groupBy(*by).agg((F.countDistinct(value) > 1).alias("conflict"))
    return d.where("_n = 1").drop("_n", "_k").join(top, by)


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def product_of(terms: DataFrame, by: list[str], value: str) -> DataFrame:
    """The product of a key's terms; a key with a null term is left out."""
    g = terms.groupBy(*by).agg(F.product(value).alias("product"), F.sum(F.col(value).isNull().cast("int")).alias("_null"))
    return g.where("_null = 0").drop("_null")


def content_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table whatever its order: count, xor and sum of the first 32 bits of each row's MD5. A row is its
    columns as text, in order of name."""
    row = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x01")) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", F.count(F.lit(1)), F.bit_xor("h"), F.sum("h")).alias("digest"))


def every(df: DataFrame, by: list[str], predicate: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.bool_and(predicate).alias("all"), F.count(F.lit(1)).alias("n"))


# --- windows (WN) -----------------------------------------------------------------------------------------------------


def _part(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def positions(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, below, total): how many rows of a key hold a value, how many a smaller one, and how many any.

    For keys of any size, or none: values are counted, dealt by range, added up within each part, and put on the sums of
    the parts before; no window holds more than a part, or more rows than there are parts. Nulls take no part.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    parts = io.staged(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "positions")
    sums = parts.groupBy(*by, "_part").agg(F.sum("n").alias("_s"))
    past = lambda w, order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(past(_part(by), "_part")), F.lit(0)), "total": F.sum("_s").over(_part(by))}).drop("_s")
    out = parts.withColumn("_c", F.coalesce(F.sum("n").over(past(Window.partitionBy(*by, "_part"), value)), F.lit(0))).join(sums, [*by, "_part"])
    return out.select(*by, value, "n", (F.col("_before") + F.col("_c")).alias("below"), "total")


def competition_rank(df: DataFrame, score: str, by: list[str], out: str = "rank") -> DataFrame:
    """1 for the best score of a key; equal scores share a rank, and the next one counts them. A null score has no rank."""
    p = positions(df, by, score).select(*by, score, (F.col("total") - F.col("below") - F.col("n") + 1).cast("int").alias(out))
    return _with_positions(df, p, by, score, out)


def with_percentile(df: DataFrame, value: str, by: list[str], out: str, declared: int | None = None) -> DataFrame:
    """``df`` with the mid-rank percentile of a value in its key, as ``percentile`` has it, for keys of any size."""
    rest = F.lit(declared) if declared else F.col("total")
    p = positions(df, by, value).select(*by, value, ((F.col("below") + (F.col("n") - 1) / 2) / F.nullif(rest - 1, F.lit(0))).alias(out))
    return _with_positions(df, p, by, value, out)


def _with_positions(df: DataFrame, p: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Rows with the position of their value. Rows without a value match nothing: they stay spread as they lie."""
    d = df.withColumn("_spread", F.when(F.col(value).isNull(), F.spark_partition_id()).otherwise(-1))
    return d.join(p.withColumn("_spread", F.lit(-1)), [*by, value, "_spread"], "left").select(*df.columns, out)


def percentile(value: str, by: list[str], method: str = "midrank", declared: int | None = None) -> Column:
    """Percentile of a non-null value among the non-null values of its key, by one of the named methods. A window per key:
    for keys that fit into a task; ``with_percentile`` has no such bound."""
    w = _part(by)
    v = F.col(value)
    below = F.rank().over(w.orderBy(F.asc_nulls_last(value))) - 1
    equal = F.count(v).over(_part([*by, value]))
    n = F.lit(declared) if declared else F.count(v).over(w)
    out = {
        "midrank": lambda: (below + (equal - 1) / 2) / F.nullif(n - 1, F.lit(0)),
        "strict_below": lambda: below / n,
        "weak_below": lambda: (below + equal) / n,
        "midpoint": lambda: (below + 0.5 * equal) / n,
        "percentrank_inc": lambda: below / F.nullif(n - 1, F.lit(0)),
    }[method]()
    return F.when(v.isNotNull(), out)


PERCENTILE_METHODS = ["midrank", "strict_below", "weak_below", "midpoint", "percentrank_inc"]


def gated_rank(df: DataFrame, by: list[str], score: str = "score", coverage: str = "coverage", home: str = "is_home_market", minimum: float | Column = 0.5) -> DataFrame:
    """Rank of the rows that may be ranked, with the reason for those that may not; the others leave no gap."""
    minimum = minimum if isinstance(minimum, Column) else F.lit(minimum)
    reason = F.when(F.coalesce(F.col(home), F.lit(False)), "HOME_MARKET").when(F.col(score).isNull(), "NO_SCORE").when(F.col(coverage) < minimum, "LOW_COVERAGE")
    d = df.withColumn("unranked_reason", reason)
    return competition_rank(d.withColumn("_eligible", F.when(F.col("unranked_reason").isNull(), F.col(score))), "_eligible", by).drop("_eligible")


def first_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: latest status, latest fetch, operative decision, single owner, freshest verdict."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def one_per_key(df: DataFrame, by: list[str]) -> DataFrame:
    """One row of each key, the first by its other columns in turn, so that the order of rows decides nothing."""
    rest = [F.col(f"`{c}`") for c, kind in df.dtypes if c not in by and not any(x in kind for x in ("map<", "variant"))]
    return first_per_key(df, by, rest or [F.lit(0)])


def mark_operative(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("operative", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)


def number_in_group(df: DataFrame, by: list[str], order: list[Column], id_col: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"number": F.row_number().over(w), "supersedes": F.lag(id_col).over(w)})


def single_owner(df: DataFrame, key: str, order: str, role: str = "role") -> DataFrame:
    """Of the rows with role IDENTITY for a key, only the lowest keeps it; the others become GROUP."""
    identity = F.col(role) == "IDENTITY"
    n = F.row_number().over(Window.partitionBy(key, identity).orderBy(order))
    return df.withColumn(role, F.when(identity & (n > 1), "GROUP").otherwise(F.col(role)))


def primary_flag(df: DataFrame, by: list[str], key: str) -> DataFrame:
    return df.withColumn("is_primary", F.min(key).over(Window.partitionBy(*by)) == F.col(key))


def last_end(df: DataFrame, by: list[str], end: str, order: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(end, F.when(F.col(end).isNotNull(), F.col(order))).alias(end))


# --- top-k (TK) and sets (SO) -----------------------------------------------------------------------------------------


def ranking_page(df: DataFrame, limit: int, offset: int = 0, key: str = "market_key") -> DataFrame:
    return df.orderBy(F.asc_nulls_last("rank"), F.desc_nulls_last("score"), key).offset(offset).limit(limit)


def top_deltas(deltas: DataFrame, n: int = 10, key: str = "market_key") -> DataFrame:
    return deltas.orderBy(F.desc("delta"), key).limit(n)


def frontier(df: DataFrame, by: str, budget: int, hint: str = "hint", locator: str = "locator") -> DataFrame:
    """The budget of each key: best hint first; ``fetched`` tells who is within it."""
    return df.withColumn("fetched", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(hint), locator)) <= budget)


def relationships_bidirectional(rel: DataFrame, inverse: dict[str, str]) -> DataFrame:
    there = rel.select("from_id", "to_id", "edge_type", F.lit(False).alias("derived"))
    back = rel.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])[F.col("edge_type")].alias("edge_type"), F.lit(True).alias("derived"))
    return there.unionByName(back.where("edge_type is not null"))


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def rebuild_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two builds holds; none when they are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))
