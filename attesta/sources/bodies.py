"""A content-addressed store of document bodies: one row per digest, written once; a pruned body is refused and not empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.streaming.sink import BucketedSink


class BodyStore:
    """Bodies lie in buckets by digest, beside a list of pruned digests that only grows. Both are idempotent by batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.bodies = BucketedSink(spark, f"{path}/bodies", "body_sha256 string, body binary, size long", ["body_sha256"], buckets, order=[F.lit(0)])
        self.pruned = BucketedSink(spark, f"{path}/pruned", "body_sha256 string, pruned_at timestamp", ["body_sha256"], buckets, order=[F.col("pruned_at")])

    def put(self, docs: DataFrame, body: str, batch: str) -> DataFrame:
        """Store what is not there yet; returns ``docs`` with body_sha256 in place of the body. A null body has no digest. What
        was pruned stays pruned, though the same bytes come again."""
        d = docs.withColumn("body_sha256", F.sha2(F.col(body).cast("binary"), 256))
        self.bodies.write(d.where("body_sha256 is not null").select("body_sha256", F.col(body).cast("binary").alias("body"), F.octet_length(F.col(body)).cast("long").alias("size")), batch)
        return d.drop(body)

    def prune(self, digests: DataFrame, as_of: Column, batch: str) -> None:
        self.pruned.write(digests.where("body_sha256 is not null").select("body_sha256", as_of.alias("pruned_at")), batch)

    def status(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (with body_sha256) and its body, size, state (RETAINED, PRUNED or ABSENT) and pruned_at."""
        d = wanted.join(self.bodies.read(), "body_sha256", "left").join(self.pruned.read(), "body_sha256", "left")
        state = F.when(F.col("pruned_at").isNotNull(), "PRUNED").when(F.col("body").isNotNull(), "RETAINED").otherwise("ABSENT")
        kept = {c: F.when(F.col("pruned_at").isNull(), F.col(c)) for c in ("body", "size")}
        return d.withColumn("state", state).withColumns(kept)

    def require(self, wanted: DataFrame) -> DataFrame:
        """As ``status``, but a body that is pruned or absent ends the query that asks for it, with its digest and time."""
        why = F.when(F.col("state") == "PRUNED", F.concat(F.lit("body "), F.col("body_sha256"), F.lit(" was pruned at "), F.col("pruned_at").cast("string"), F.lit("; its source must be fetched again")))
        why = why.otherwise(F.concat(F.lit("no body "), F.coalesce("body_sha256", F.lit("null"))))
        d = self.status(wanted)
        return d.withColumn("body", F.when(F.col("state") == "RETAINED", F.col("body")).otherwise(F.raise_error(why).cast("binary"))).drop("state", "pruned_at")

    def vacuum(self) -> None:
        """Rewrite the bodies without those that are pruned; their digests stay in the list."""
        live = self.bodies.live()
        if live:
            keep = self.bodies._stored().join(self.pruned.read().select("body_sha256"), "body_sha256", "left_anti")
            self.bodies.replace(live, keep)
