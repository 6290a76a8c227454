"""Independent witnesses: a greatest matching of publishers to documents, as rounds of joins, with its proof.

All groups go through the rounds together, and no group or connected component is ever held by one task: a round is a few
joins and aggregations on (group, publisher) or (group, document). Only counts of rows reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.sources import io

_EDGE = ["g", "p", "d"]


def _edges(edges: DataFrame, by: list[str], publisher: str, document: str) -> DataFrame:
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("g")
    e = edges.select(key, F.col(publisher).cast("string").alias("p"), F.col(document).cast("string").alias("d"))
    return io.staged(e.where("p is not null and d is not null").distinct(), "witness-edges")


def _forced(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(edges left, matched pairs): a publisher with a document that no other has takes one; a publisher that has no other
    document takes it. Some greatest matching has these pairs. Rounds go on while they take a quarter of the edges."""
    cur, pairs, left = edges, [], edges.count()
    while left:
        own = cur.groupBy("g", "d").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p")).where("n = 1").groupBy("g", "p").agg(F.min("d").alias("d"))
        own = io.staged(own.select(*_EDGE), "witness-pairs")
        rest = cur.join(own.select("g", "p"), ["g", "p"], "left_anti")
        lone = rest.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d")).where("n = 1").groupBy("g", "d").agg(F.min("p").alias("p"))
        lone = io.staged(lone.select(*_EDGE), "witness-pairs")
        pairs += [own, lone]
        nxt = rest.join(lone.select("g", "d"), ["g", "d"], "left_anti").join(lone.select("g", "p"), ["g", "p"], "left_anti")
        old, cur = cur, io.staged(nxt, "witness-edges")
        if old is not edges:
            io.discard(old)
        before, left = left, cur.count()
        if left > 0.75 * before:
            break
    return cur, pairs


def _layers(edges: DataFrame, pairs: DataFrame, own: io.Owner) -> tuple[list[DataFrame], DataFrame | None, DataFrame]:
    """Breadth first along alternating paths from all free publishers at once: (publishers new in each layer, documents
    without a publisher in the last layer that the first such layer leads to or None, all documents reached)."""
    layers = [own.staged(edges.select("g", "p").distinct().join(pairs.select("g", "p"), ["g", "p"], "left_anti"), "witness-layer")]
    seen_p, seen_d = layers[0], None
    while True:
        docs = layers[-1].join(edges, ["g", "p"]).select("g", "d").distinct()
        docs = docs if seen_d is None else docs.join(seen_d, ["g", "d"], "left_anti")
        docs = own.staged(docs, "witness-layer")
        seen_d = docs if seen_d is None else seen_d.unionByName(docs)
        free = own.staged(docs.join(pairs.select("g", "d"), ["g", "d"], "left_anti"), "witness-layer")
        if not free.isEmpty():
            return layers, free, seen_d
        nxt = own.staged(docs.join(pairs, ["g", "d"]).select("g", "p").join(seen_p, ["g", "p"], "left_anti"), "witness-layer")
        if nxt.isEmpty():
            return layers, None, seen_d
        layers.append(nxt)
        seen_p = seen_p.unionByName(nxt)


def _paths(edges: DataFrame, pairs: DataFrame, layers: list[DataFrame], free: DataFrame, own: io.Owner) -> DataFrame:
    """Disjoint shortest augmenting paths, traced back from free documents: (g, p, d, old) gives publisher p the document d in
    place of old. Where paths meet at a publisher, one goes on; at least one reaches a free publisher."""
    head = free.select("g", F.col("d").alias("path"), "d")
    steps = []
    for layer in layers[::-1]:
        spread = F.xxhash64("path", "p")
        step = head.join(edges.join(layer, ["g", "p"]), ["g", "d"]).groupBy("g", "path", "d").agg(F.min_by("p", F.struct(spread, "p")).alias("p"))
        step = step.groupBy("g", "p").agg(F.min_by(F.struct("path", "d"), F.struct(spread, "path")).alias("x")).select("g", "p", "x.path", "x.d")
        step = own.staged(step.join(pairs.withColumnRenamed("d", "old"), ["g", "p"], "left"), "witness-steps")
        steps.append(step)
        head = step.select("g", "path", F.col("old").alias("d"))
    whole = steps[-1].select("g", "path")  # what has come to a free publisher
    return reduce(DataFrame.unionByName, steps).join(whole, ["g", "path"]).select("g", "p", "d", "old")


def witness_pairs(edges: DataFrame, by: list[str], publisher: str = "publisher", document: str = "document") -> tuple[DataFrame, DataFrame]:
    """(matched pairs, edges), both as (g, p, d) with g the group's columns as JSON.

    Forced pairs first; then phases of breadth-first layers and disjoint augmenting paths, until no path is left: then the
    matching is greatest. Each phase makes the shortest path of each group longer or takes paths of that length away.
    """
    every = _edges(edges, by, publisher, document)
    left, forced = _forced(every)
    pairs = io.staged(left.limit(0).select(*_EDGE), "witness-matching")
    while not left.isEmpty():
        phase = io.Owner()
        layers, free, _ = _layers(left, pairs, phase)
        if free is None:
            phase.release()
            break
        change = phase.staged(_paths(left, pairs, layers, free, phase), "witness-change")
        kept = pairs.join(change.select("g", "p"), ["g", "p"], "left_anti")
        phase.tables.append(pairs)
        pairs = io.staged(kept.unionByName(change.select(*_EDGE)), "witness-matching")
        phase.release()
    return reduce(DataFrame.unionByName, [*forced, pairs]), every


def independent_witnesses(edges: DataFrame, by: list[str], publisher: str = "publisher", document: str = "document") -> DataFrame:
    """(by, witnesses): the greatest number of publishers each with a document of its own, per group. A pair without publisher
    or document counts for nothing, and a group of such pairs alone has no row."""
    pairs, _ = witness_pairs(edges, by, publisher, document)
    kinds = ", ".join(f"{b} {dict(edges.dtypes)[b]}" for b in by)
    counts = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("witnesses"))
    return counts.select(F.from_json("g", kinds).alias("k"), "witnesses").select("k.*", "witnesses")


def witness_cover(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """A least vertex cover (g, side, node) by König's theorem: the publishers that no alternating path from a free publisher
    reaches, and the documents that one does. It has as many nodes as the matching has pairs and touches every edge, which
    proves the matching greatest."""
    pairs = io.staged(pairs, "witness-matching")
    layers, free, docs = _layers(edges, pairs, io.Owner())
    if free is not None:
        raise ValueError("the matching is not greatest: an augmenting path is left")
    reached = reduce(DataFrame.unionByName, layers)
    outside = edges.select("g", "p").distinct().join(reached, ["g", "p"], "left_anti")
    return outside.select("g", F.lit("publisher").alias("side"), F.col("p").alias("node")).unionByName(docs.select("g", F.lit("document").alias("side"), F.col("d").alias("node")))
