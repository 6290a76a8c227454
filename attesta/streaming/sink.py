"""A keyed Parquet sink for streams: exactly once per batch id, at most one row per key, and only touched buckets are read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources.io import append_absent


class BucketedSink:
    """A folder with rows under ``data/batch=<id>/bucket=<n>`` and a manifest per committed batch.

    A batch is written, then committed by a manifest that appears in one rename. A batch whose manifest is there is skipped, so
    a replay adds nothing; rows of a batch that was written but never committed are not read, and its replay puts them anew.
    Keys are dealt to ``buckets`` by hash: a batch is compared with the committed rows of its own buckets alone. ``compact``
    puts the rows of all batches into one, so that the number of files follows the data and not the number of batches.

    One writer at a time, as Structured Streaming gives one. ``schema`` is a DDL string. Null keys are keys like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64, order: list[Column] | None = None):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.order = spark, path.rstrip("/"), schema, keys, buckets, order
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._path("manifests").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifests

    def manifests(self) -> dict[str, dict]:
        """Of each committed batch: its rows, its buckets and the batches that it replaces. They are small and one per batch."""
        if not self._fs.exists(self._path("manifests")):
            return {}
        lines = self.spark.read.text(f"{self.path}/manifests/*.json").collect()
        return {m["batch"]: m for m in (json.loads(r["value"]) for r in lines)}

    def live(self) -> list[str]:
        """Batches to read: committed and not replaced by a later one."""
        found = self.manifests()
        gone = {b for m in found.values() for b in m["replaces"]}
        return sorted(b for b in found if b not in gone)

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"manifests/{batch}.json"))

    def commit(self, batch: str, rows: int, buckets: list[int], replaces: list[str]) -> None:
        """The manifest is written under another name and renamed, so that it is there whole or not at all."""
        hidden = self._path(f"manifests/.{batch}-{uuid.uuid4().hex}")
        out = self._fs.create(hidden)
        out.write(bytearray(json.dumps({"batch": batch, "rows": rows, "buckets": buckets, "replaces": replaces}).encode()))
        out.close()
        self._fs.rename(hidden, self._path(f"manifests/{batch}.json"))

    # --- rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self, buckets: list[int] | None = None) -> DataFrame:
        """Committed rows; of some buckets, only their folders are read."""
        live = self.live()
        if not live:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        d = self.spark.read.schema(f"{self.schema}, batch string, bucket int").option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/batch={b}" for b in live))
        return (d if buckets is None else d.where(F.col("bucket").isin(buckets))).drop("batch")

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _put(self, batch: str, rows: DataFrame) -> tuple[int, list[int]]:
        """Write over what a failed attempt may have left, one file per bucket and task; the counts come from what was written."""
        at = f"{self.path}/data/batch={batch}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        # a batch that adds nothing leaves a folder without files
        counts = self.spark.read.schema(f"{self.schema}, bucket int").parquet(at).groupBy("bucket").count().collect()
        return sum(r["count"] for r in counts), sorted(r["bucket"] for r in counts)

    def write(self, rows: DataFrame, batch: str) -> bool:
        """Add the rows whose key is not stored yet, the first of a key in ``order``. False if the batch was there already."""
        if self.committed(batch):
            return False
        rows = rows.select(*self.spark.createDataFrame([], self.schema).columns).withColumn("bucket", self._bucket())
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most ``buckets``
        order = self.order or [F.col(f"`{c}`") for c in rows.columns if c not in (*self.keys, "bucket") and "map<" not in dict(rows.dtypes)[c]]
        there = self._stored(touched).select(*(F.col(k).alias(f"_{k}") for k in self.keys)).distinct()
        first = append_absent(rows, rows.limit(0), self.keys, order)
        new = first.join(there, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys], "left_anti")
        self.commit(batch, *self._put(batch, new), replaces=[])
        return True

    def compact(self) -> str | None:
        """Rewrite the rows of all live batches as one batch. The old folders go after the commit; a crash before it leaves
        them in force. Their manifests stay, so that a late replay of one of them still adds nothing."""
        live = self.live()
        return self.replace(live, self._stored()) if len(live) > 1 else None

    def replace(self, live: list[str], rows: DataFrame) -> str:
        """One new batch of ``rows`` (with bucket) in place of the batches ``live``."""
        batch = f"compact-{uuid.uuid4().hex}"
        self.commit(batch, *self._put(batch, rows), replaces=live)
        for b in live:
            self._fs.delete(self._path(f"data/batch={b}"), True)
        return batch
