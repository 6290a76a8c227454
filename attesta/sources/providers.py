"""Providers of company records behind one contract: capabilities, scan, parse, normalise, canonicalise, key.

A provider is a value: what it says about itself, how its files are scanned into raw records, and the candidate columns over
what was parsed. Everything is Spark's own readers and functions, so files may lie wherever Spark reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import columns as fn

CANDIDATE = {
    "legal_name": "string", "trading_names": "array<string>", "registrable_domain": "string", "country": "string", "city": "string", "postal_code": "string", "address": "string", "phone": "string",
    "employee_count_min": "int", "employee_count_max": "int", "founded_year": "int", "legal_form": "string", "registry_ids": "map<string,string>", "vertical_hints": "array<string>",
}
NATIVE, DERIVED, CONTENT = "NATIVE_EXTERNAL_ID", "DERIVED_STABLE_KEY", "CONTENT_ONLY"


@dataclass(frozen=True)
class Provider:
    """``scan`` gives (file, body, parsed, problem) with parsed a struct or map, null where the body cannot be read; ``shape``
    gives the candidate columns that the provider has; ``native_id`` reads the record's own id from parsed."""

    key: str
    name: str
    identity: str
    strategy: str
    media_type: str
    trust_tier: float
    scan: Callable[[SparkSession, str], DataFrame]
    shape: Callable[[Column], dict[str, Column]]
    canonical: Callable[[DataFrame], Column]
    native_id: Callable[[Column], Column] | None = None
    key_fields: tuple[str, ...] = ()
    key_version: str = "1"
    filters: tuple[str, ...] = field(default=())


def text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _scan_json(schema: str) -> Callable[[SparkSession, str], DataFrame]:
    def scan(spark: SparkSession, path: str) -> DataFrame:
        """One JSON record a line. A line that is no JSON object keeps its place and says so; blank lines are none."""
        d = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
        v = F.try_parse_json("body")
        bad = v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")
        return d.withColumn("problem", F.when(bad, "MALFORMED")).withColumn("parsed", F.when(F.col("problem").isNull(), F.from_json("body", schema)))

    return scan


def _scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a row of another width than the header, or with broken quotes, is MALFORMED."""
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join([*(f"`{c}` string" for c in names), "_bad string"])
    # a reader that must name its corrupt column may prune nothing, so all columns are asked for
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schema).csv(path)
    pairs = F.create_map(*(x for c in names for x in (F.lit(c), F.col(f"`{c}`"))))
    d = raw.select(F.col("_metadata.file_path").alias("file"), pairs.alias("parsed"), "_bad")
    return d.select("file", F.to_json("parsed", {"ignoreNullFields": "false"}).alias("body"), F.when(F.col("_bad").isNotNull(), "MALFORMED").alias("problem"), F.when(F.col("_bad").isNull(), F.col("parsed")).alias("parsed"))


_DIRECTORY = "external_id string, payload struct<legal_name:string,website_domain:string,trading_names:array<string>,employees:struct<min:int,max:int>,founded:int,legal_form:string,categories:array<string>,location:struct<country:string,city:string,postal_code:string,address:string>,phone:string,registry_ids:map<string,string>>"
_SCRAPE = "title string, domain string, city string, country string, tags array<string>"

JSON_DIRECTORY = Provider(
    "json_directory", "JSON directory", NATIVE, "JSON_CANONICAL_V1", "application/json", 0.8, _scan_json(_DIRECTORY),
    lambda p: {
        "legal_name": p["payload"]["legal_name"], "trading_names": p["payload"]["trading_names"], "registrable_domain": p["payload"]["website_domain"], "country": p["payload"]["location"]["country"], "city": p["payload"]["location"]["city"],
        "postal_code": p["payload"]["location"]["postal_code"], "address": p["payload"]["location"]["address"], "phone": p["payload"]["phone"], "employee_count_min": p["payload"]["employees"]["min"], "employee_count_max": p["payload"]["employees"]["max"],
        "founded_year": p["payload"]["founded"], "legal_form": p["payload"]["legal_form"], "registry_ids": p["payload"]["registry_ids"], "vertical_hints": p["payload"]["categories"],
    },
    lambda d: F.to_json(F.try_variant_get(F.try_parse_json("body"), "$.payload", "variant")), native_id=lambda p: text(p["external_id"]), filters=("country", "vertical"),
)
CSV_EXPORT = Provider(
    "csv_export", "CSV export", DERIVED, "CSV_ROW_V1", "text/csv", 0.5, _scan_csv,
    lambda p: {
        "legal_name": text(p["company"]), "registrable_domain": F.lower(text(p["domain"])), "country": text(p["country"]), "city": text(p["city"]), "postal_code": text(p["zip"]),
        "employee_count_min": text(p["staff_min"]).try_cast("int"), "employee_count_max": text(p["staff_max"]).try_cast("int"),
    },
    lambda d: fn.canonical_csv("parsed"), key_fields=("registrable_domain",),
)
SCRAPE = Provider(
    "scrape", "Scraped pages", CONTENT, "JSON_CANONICAL_V1", "application/json", 0.3, _scan_json(_SCRAPE),
    lambda p: {"legal_name": text(p["title"]), "registrable_domain": F.lower(text(p["domain"])), "country": text(p["country"]), "city": text(p["city"]), "vertical_hints": p["tags"]},
    lambda d: fn.canonical_json("body"),
)
PROVIDERS = [JSON_DIRECTORY, CSV_EXPORT, SCRAPE]


def capabilities(spark: SparkSession, providers: list[Provider] = PROVIDERS) -> DataFrame:
    """A row for each provider: what it says about itself, without any file."""
    rows = [(p.key, p.name, p.identity, p.strategy, p.media_type, list(p.key_fields), p.key_version if p.key_fields else None, p.trust_tier, list(p.filters)) for p in providers]
    return spark.createDataFrame(rows, "provider string, name string, identity_capability string, canonicalization_strategy string, media_type string, key_fields array<string>, key_version string, trust_tier double, supported_filters array<string>")


def candidates(spark: SparkSession, provider: Provider, path: str) -> DataFrame:
    """The records of a provider's files in candidate shape: provider, file, external_id, content_hash, body, problem and the
    columns of ``CANDIDATE``.

    The content hash is of the canonical form (of the payload, where the record's id stands beside it), so the order of keys and spaces do not count. The id is the record's own, or a
    hash of the declared key fields, or the content hash, as the provider's capability says; it is null where the own id or a
    key field is missing, which is a problem of the record (NO_STABLE_KEY) and no partial key. A malformed record has its
    body's hash and no columns.
    """
    raw = provider.scan(spark, path)
    shape = provider.shape(F.col("parsed"))
    columns = {c: shape[c].cast(kind) if c in shape else F.lit(None).cast(kind) for c, kind in CANDIDATE.items()}
    d = raw.withColumn("content_hash", F.sha2(F.coalesce(F.when(F.col("problem").isNull(), provider.canonical(raw)), F.col("body")), 256)).withColumns(columns)
    if provider.identity == NATIVE:
        key = provider.native_id(F.col("parsed"))
    elif provider.identity == DERIVED:
        key = fn.derive_key(list(provider.key_fields), provider.key_version)
    else:
        key = F.col("content_hash")
    ok = F.col("problem").isNull()
    d = d.withColumn("external_id", F.when(ok, key))
    d = d.withColumn("problem", F.coalesce("problem", F.when(F.col("external_id").isNull(), "NO_STABLE_KEY")))
    return d.select(F.lit(provider.key).alias("provider"), "file", "external_id", "content_hash", "body", "problem", *CANDIDATE)
