"""Operator 1: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import literal_rows


def ring_points(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % cells
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(total: int, shards: int, slack: float, demand: dict[int, int]) -> dict[int, int]:
    """With no slack, counts differ by one at most and the shards with most keys of their own get the extra ones."""
    if slack > 0:
        return dict.fromkeys(range(shards), -int(-(1 + slack) * total // shards))
    low, extra = divmod(total, shards)
    first = sorted(range(shards), key=lambda s: (-demand.get(s, 0), s))[:extra]
    return {s: low + (s in first) for s in range(shards)}


def place(counts: dict[int, int], shards: int, vnodes: int, cells: int, slack: float) -> list[dict]:
    """Ranges [lo, hi) of ranks within each cell, with the shard that takes them and their first slot there.

    Every cell's keys belong to the next virtual node clockwise. A shard takes what arrives, in clockwise order, up to
    its capacity; the rest goes on to the next virtual node of a shard that has room, hop by hop. The work depends on
    the number of cells and virtual nodes alone.
    """
    points = ring_points(shards, vnodes, cells)
    arriving: list[tuple[int, int, int, int]] = []  # (point, cell, lo, hi)
    p = 0
    for cell in sorted(counts):
        while p < len(points) and points[p][0] < cell:
            p += 1
        arriving.append((p % len(points), cell, 0, counts[cell]))
    demand: dict[int, int] = {}
    for p, _, lo, hi in arriving:
        demand[points[p][1]] = demand.get(points[p][1], 0) + hi - lo
    room = capacities(sum(counts.values()), shards, slack, demand)
    taken: list[tuple[int, int, int, int]] = []
    while arriving:
        over = []
        for p, cell, lo, hi in sorted(arriving):
            shard = points[p][1]
            cut = min(hi, lo + room[shard])
            if cut > lo:
                taken.append((shard, cell, lo, cut))
                room[shard] -= cut - lo
            if cut < hi:
                over.append((p, cell, cut, hi))
        arriving = []
        for p, cell, lo, hi in over:
            q = (p + 1) % len(points)
            while room[points[q][1]] == 0:
                q = (q + 1) % len(points)
            arriving.append((q, cell, lo, hi))
    rows, start = [], dict.fromkeys(range(shards), 0)
    for shard, cell, lo, hi in sorted(taken):
        rows.append({"_cell": cell, "_lo": lo, "_hi": hi, "_shard": shard, "_start": start[shard]})
        start[shard] += hi - lo
    return rows


def ring_shards(df: DataFrame, key: list[str], shards: int, vnodes: int = 64, cells: int = 1 << 14, slack: float = 0.0) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) to every row.

    ``key`` names the columns that are hashed to the ring, so that equal keys start at one place. The ring has ``cells``
    cells; rows are counted by cell (the only figures that reach the driver: ``cells`` at most), the counts flow
    clockwise (``place``), and each row finds its range by its rank in its cell. With ``slack`` 0 shard sizes differ by
    one at most; else none exceeds (1 + slack) times the mean. Null keys hash like any value, repeated rows stay apart,
    columns already named shard or slot are replaced, and an empty table stays empty.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot").withColumn("_pos", F.xxhash64(F.lit("ring"), *key)).withColumn("_cell", F.pmod("_pos", F.lit(cells)).cast("int"))
    counts = {r["_cell"]: r["n"] for r in df.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = literal_rows(spark, place(counts, shards, vnodes, cells, slack), "_cell int, _lo long, _hi long, _shard int, _start long")
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_pos", *key)) - 1)
    r, d = F.broadcast(ranges.withColumnRenamed("_cell", "_c")), ranked
    out = d.join(r, (F.col("_cell") == F.col("_c")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    out = out.withColumns({"shard": F.col("_shard"), "slot": F.col("_start") + F.col("_rank") - F.col("_lo")})
    return out.drop("_pos", "_cell", "_c", "_rank", "_lo", "_hi", "_shard", "_start")
