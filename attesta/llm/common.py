"""Helpers that several operators share: staged tables, gapless numbering, components, text buffers."""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. In local mode a temporary one stands in."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Folders of staged tables, in order of time. Operators delete what later tables have been staged from (``discard``); what a
#: lazy result still reads stays until its owner calls ``release`` with the folders that came since ``mark``.
STAGED: list[str] = []


def mark() -> int:
    return len(STAGED)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: it cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/attesta/{name}-{uuid.uuid4().hex}"
    STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    forget_shuffles(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs: its cleaner acts when the driver's JVM has dropped their handles,
    which else waits for ``spark.cleaner.periodicGC.interval``. Without a JVM at hand (Spark Connect) that is all."""
    jvm = getattr(getattr(spark, "sparkContext", None), "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete staged tables from which every later table has been staged."""
    release(tables[0].sparkSession, [t._staged_at for t in tables if t._staged_at in STAGED])


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that no frame needs any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        STAGED.remove(path)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small frame of bounded size from driver values, built inside the JVM."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def dense_index(df: DataFrame, cell: Column, order: list[Column], name: str, n_cells: int) -> DataFrame:
    """Number the rows 0, 1, 2 … in the order of (cell, order), without a global sort.

    ``cell`` is an int in [0, n_cells); only the ``n_cells`` counts reach the driver. ``df`` is read twice, so stage it
    first where it is costly.
    """
    spark = df.sparkSession
    df = df.withColumn("_cell", cell)
    counts = {r["_cell"]: r["n"] for r in df.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, rows = 0, []
    for c in sorted(counts):
        rows.append({"_cell": c, "_start": start})
        start += counts[c]
    starts = literal_rows(spark, rows, "_cell int, _start long")
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1)
    return ranked.join(F.broadcast(starts), "_cell").withColumn(name, F.col("_start") + F.col("_rank")).drop("_cell", "_rank", "_start")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list by alternating large-star and small-star steps.

    Returns (node, component) for each node of an edge; component is the smallest node reachable. Each round is two
    joins on the node key, staged in the shared folder; only the change check reaches the driver.
    """
    cur = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    while True:
        old = cur
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staged(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # every node points at a node that points nowhere, so nothing can change any more
        loose = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        many = new.groupBy("u").count().where("count > 1")
        done = loose.isEmpty() and many.isEmpty()
        cur = new
        discard(old)
        if done:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# --- text buffers inside tasks: whole Arrow batches as one byte array -------------------------------------------------

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64)
_POWER: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a whole array."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWER[0]) < n:
        size = max(n, 1 << 18)
        inverse = pow(_BASE, -1, 2**64)
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWER[k] = np.cumprod(p, dtype=np.uint64)
    return _POWER[0][:n], _POWER[1][:n]


def rolling(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Prefix sums h with (h[e] - h[s]) * base**-s a hash of data[s:e]; see ``span_hash``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64) * _GOLD)


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 64 bits of BLAKE2b of each span."""
    from hashlib import blake2b

    view = memoryview(raw)
    return np.frombuffer(b"".join([blake2b(view[s:e], digest_size=8).digest() for s, e in zip(start.tolist(), end.tolist(), strict=True)]), np.uint64)


def buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as (bytes, offsets), nulls as empty; offsets has one more entry than rows."""
    import pyarrow as pa

    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = 1 << 21):
    """Ranges [i, j) of rows with about ``size`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words ``[^\\x20\\x09-\\x0D]+`` of each row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


_PLACE = np.random.Generator(np.random.PCG64(20240301)).integers(0, 2**64, (64, 256), dtype=np.uint64).ravel()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word, with A-Z lower-cased.

    A hash adds up a random number for each byte at its place in the word, so no pattern of bytes cancels out.
    """
    start, end, row = word_spans(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), row, start, end
    size = end - start
    first = np.cumsum(size) - size
    shift = np.repeat(start - first, size)
    place = np.arange(len(shift))
    byte = _LOWER[data[place + shift]]
    place -= np.repeat(first, size)
    value = _PLACE[(place & 63) << 8 | byte]
    long = np.flatnonzero(place >= 64)
    if len(long):
        value[long] = mix(value[long] + (place[long] >> 6).astype(np.uint64) * _GOLD)
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _GOLD), row, start, end


def true_to_bytes(data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
    """Whether equal hashes are equal words, byte for byte with A-Z lower-cased."""
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    a, b = order[same], order[same + 1]
    size = end[a] - start[a]
    if not (size == end[b] - start[b]).all():
        return False
    for i, j in slices(np.concatenate(([0], np.cumsum(size)))):
        n = size[i:j]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not (_LOWER[data[np.repeat(start[a[i:j]], n) + step]] == _LOWER[data[np.repeat(start[b[i:j]], n) + step]]).all():
            return False
    return True
