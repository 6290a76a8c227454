"""Sources and sinks."""

from __future__ import annotations

import json
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CANDIDATE = "legal_name string, website_domain string, country string, city string, postal_code string, address string, phone string, employees_min int, employees_max int, categories array<string>"
SNAPSHOT = (
    "metadata struct<title:string,generated_date:string,universe_size:int,score_version:string>, source_catalog map<string,struct<title:string,url:string,publisher:string>>, "
    "markets array<struct<country:string,region:string,raw:map<string,double>,subscores:map<string,double>,market_score:double,rank:int,market_categories:array<string>,confidence_level:string,sources:array<string>>>, "
    "home_market_benchmark struct<country:string,region:string,raw:map<string,double>,subscores:map<string,double>,market_score:double,sources:array<string>>, "
    "excluded_from_top50_but_in_normalization_universe array<struct<country:string,market_score:double>>"
)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _json_position(raw: pd.Series) -> pd.DataFrame:
    """Where a text stops being JSON: message, line and column. It runs on rejected documents alone."""
    rows = []
    for x in raw:
        try:
            json.loads(x)
            rows.append((None, None, None))
        except json.JSONDecodeError as e:
            rows.append((e.msg, e.lineno, e.colno))
    return pd.DataFrame(rows, columns=["message", "line", "col"])


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nested JSON documents, one a file, as tables: markets, home, excluded, sources, metadata and rejects.

    Rejects (file, reason, position) are files whose bytes are no UTF-8 (NOT_UTF8, with the first bad byte, from 1), that are no
    JSON (MALFORMED, with line and column), that hold no object (NOT_OBJECT) or no metadata (NO_METADATA). Spark passes over
    files without a byte.
    """
    d = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    v = F.try_parse_json("text")
    reason = F.when(~F.is_valid_utf8("text"), "NOT_UTF8").when(v.isNull(), "MALFORMED").when(~F.schema_of_variant(v).startswith("OBJECT"), "NOT_OBJECT")
    d = d.withColumn("reason", reason).withColumn("doc", F.when(F.col("reason").isNull(), F.from_json("text", SNAPSHOT)))
    d = d.withColumn("reason", F.coalesce("reason", F.when(F.col("doc.metadata").isNull(), "NO_METADATA")))
    ok = d.where("reason is null").select("file", "doc.*")
    bad = d.where("reason is not null")
    good_part = F.substring_index(F.make_valid_utf8("text"), "\ufffd", 1)
    at = F.pandas_udf(_json_position, "message string, line int, col int")
    where = lambda j: F.concat(j["message"], F.lit(" (line "), j["line"], F.lit(", column "), j["col"], F.lit(")"))
    rejects = bad.where("reason <> 'MALFORMED'").select("file", "reason", F.when(F.col("reason") == "NOT_UTF8", (F.octet_length(good_part) + 1).cast("string")).alias("position"))
    rejects = rejects.unionByName(bad.where("reason = 'MALFORMED'").withColumn("j", at("text")).select("file", "reason", where(F.col("j")).alias("position")))
    return {
        "markets": ok.select("file", F.explode("markets").alias("m")).select("file", "m.*"),
        "home": ok.where("home_market_benchmark is not null").select("file", "home_market_benchmark.*"),
        "excluded": ok.select("file", F.explode("excluded_from_top50_but_in_normalization_universe").alias("m")).select("file", "m.*"),
        "sources": ok.select("file", F.explode("source_catalog").alias("source_key", "s")).select("file", "source_key", "s.*"),
        "metadata": ok.select("file", "metadata.*"),
        "rejects": rejects,
    }


def read_provider_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "external_id string, payload struct<legal_name:string,website_domain:string,trading_names:array<string>,employees:struct<min:int,max:int>,founded:int,legal_form:string,categories:array<string>,location:struct<country:string,city:string,postal_code:string,address:string>,phone:string,registry_ids:map<string,string>>"
    p = spark.read.schema(schema).option("multiLine", True).json(path)
    return p.select("external_id", "payload.legal_name", "payload.website_domain", "payload.location.country", "payload.location.city", "payload.location.postal_code", "payload.location.address", "payload.phone", F.col("payload.employees.min").alias("employees_min"), F.col("payload.employees.max").alias("employees_max"), "payload.categories")


def read_provider_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    number = lambda c: F.expr(f"try_cast(trim({c}) as int)")
    return raw.select(text("company").alias("legal_name"), text("domain").alias("website_domain"), text("country").alias("country"), text("city").alias("city"), text("zip").alias("postal_code"), number("staff_min").alias("employees_min"), number("staff_max").alias("employees_max"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their true numbers, from 1, however the files are split.

    Lines of a split stand together in their task; the counts of the splits before it in the file are summed up.
    """
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    d = staged(d, "lines")
    sizes = d.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "split", "first", before.alias("before"))
    return d.join(starts, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def read_cohort(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of target lists in CSV, each with its file and line.

    Every file has a header of its own; columns may stand in any order, and unknown ones are ignored. A file without
    company_name is refused. A row without a name is a problem; blank lines are none. A record is a line.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    width = lines.where("line = 1").agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    cells = F.array(*(F.col("v")[f"c{i}"] for i in range(width)))
    d = lines.withColumn("v", F.from_csv(F.regexp_replace("value", "^\ufeff", ""), ", ".join(f"c{i} string" for i in range(width)))).select("file", "line", F.transform(cells, lambda c: F.trim(c)).alias("cells"))
    heads = d.where("line = 1").select("file", F.col("cells").alias("names"))
    without = [r["file"] for r in heads.where(~F.coalesce(F.array_contains("names", "company_name"), F.lit(False))).select("file").limit(5).collect()]
    if without:
        raise ValueError(f"a target list needs the column company_name: {', '.join(without)}")
    d = d.where("line > 1").join(heads, "file")
    cell = lambda c: F.nullif(F.get(F.col("cells"), (F.array_position("names", c) - 1).cast("int")), F.lit(""))
    rows = d.select("file", "line", *(F.when(F.array_contains("names", c), cell(c)).alias(c) for c in ("company_name", "canonical_domain", "website_url", "source_id")))
    return rows.where("company_name is not null"), rows.where("company_name is null").select("file", "line", F.lit("no company_name").alias("problem"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body"), F.sha2("content", 256).alias("body_sha256"), F.col("length").alias("size"))


def append_absent(new: DataFrame, existing: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The rows of ``new`` whose key is not there yet, one per key: an append of them is idempotent. The first of a key in
    ``order`` (all columns in turn, if not given) is the one that stays, whatever the order of rows."""
    order = order or [F.col(f"`{c}`") for c in new.columns if c not in keys and "map<" not in dict(new.dtypes)[c]]
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)])))).where("_r = 1").drop("_r")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def rebuild(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def upsert_latest(current: DataFrame, delta: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key of both: the first in ``order``."""
    both = current.unionByName(delta)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def apply_prune(df: DataFrame, plan: DataFrame, key: str, payload: str, as_of: Column) -> DataFrame:
    """Payloads that the plan names become null and PRUNED; hashes stay, and nothing comes back."""
    marked = df.join(plan.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("retention_state") == "RETAINED")
    return marked.withColumns({payload: F.when(~hit & (F.col("retention_state") == "RETAINED"), F.col(payload)), "pruned_at": F.when(hit, as_of).otherwise(F.col("pruned_at")), "retention_state": F.when(hit, "PRUNED").otherwise(F.col("retention_state"))}).drop("_hit")


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """Parquet written to a shared folder and read back, to cut a plan."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; in local mode a temporary folder stands in where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/attesta/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Parquet under a new name in the shared folder, read back; see ``scratch`` and ``discard``."""
    path = scratch(df.sparkSession, name)
    out = write_and_read(df, path)
    out._staged_at = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """``df`` staged as a table in ``buckets`` by ``keys``: it is shuffled once, and no join on the keys shuffles it again.

    It is an external table of a new name, which ``discard`` drops with its files.
    """
    path, table = scratch(df.sparkSession, name), f"attesta_{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
    out = df.sparkSession.table(table)
    out._staged_at, out._table = path, table
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table from which every later table has been staged."""
    if getattr(df, "_table", None):
        df.sparkSession.sql(f"drop table if exists {df._table}")
    p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Owner:
    """Staged tables of one piece of work, deleted together once nothing reads them any more."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(staged(df, name))
        return self.tables[-1]

    def release(self) -> None:
        while self.tables:
            discard(self.tables.pop())
