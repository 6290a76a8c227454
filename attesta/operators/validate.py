"""Validation: each function returns the rows that break a rule, with a ``violation`` column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import columns as fn
from attesta.functions import config as cfg
from attesta.operators import relational as rel
from attesta.sources import io


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row per broken rule; a rule is a condition that must not be true."""
    tests = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    return df.withColumn("violation", F.explode(tests))


def structural_violations(df: DataFrame, spec: dict[str, str], required: list[str]) -> DataFrame:
    """String columns against declared types: missing values and values that do not cast."""
    rules = {f"missing:{c}": F.col(c).isNull() for c in required}
    rules |= {f"type:{c}": F.col(c).isNotNull() & F.expr(f"try_cast({c} as {t})").isNull() for c, t in spec.items()}
    return broken(df, rules)


def uniqueness_violations(df: DataFrame, keys: list[str], expected: int | None = None) -> DataFrame:
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.concat_ws("|", *keys).alias("key"), "n", F.lit("duplicate").alias("violation"))
    if expected is not None:
        d = d.unionByName(df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected).select(F.lit(None).cast("string").alias("key"), "n", F.lit("cardinality").alias("violation")))
    return d


def universe_violations(ranked: DataFrame, excluded: DataFrame, declared: int) -> DataFrame:
    n = ranked.select(F.lit(1).alias("x")).union(excluded.select(F.lit(1))).agg((F.count("x") + 1).alias("n"))
    return n.where(F.col("n") != declared).withColumn("violation", F.lit("universe"))


def bound_violations(components: DataFrame, weights: dict[str, float], value: str = "value") -> DataFrame:
    top = fn.lookup("component", weights)
    return broken(components, {"below_zero": F.col(value) < 0, "above_weight": F.col(value) > top + 1e-6, "unknown_component": top.isNull()})


def vocabulary_violations(df: DataFrame, col: str, vocabulary: list[str]) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(vocabulary)).withColumn("violation", F.concat(F.lit("vocabulary:"), F.col(col)))


def benchmark_violations(metadata: DataFrame, home: DataFrame, countries: DataFrame) -> DataFrame:
    m = fn_country(metadata, "home_market", countries, "meta_key")
    h = fn_country(home, "country", countries, "home_key")
    same = F.coalesce(F.col("meta_key") == F.col("home_key"), F.lower("home_market") == F.lower("country"))
    return m.withColumn("_j", F.lit(1)).join(h.withColumn("_j", F.lit(1)), "_j").drop("_j").where(~same).withColumn("violation", F.lit("benchmark"))


def fn_country(df: DataFrame, col: str, countries: DataFrame, out: str) -> DataFrame:
    return fn.resolve_country(df.select(col), col, countries).withColumnRenamed("country_key", out)


def orphan_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti").withColumn("violation", F.lit("orphan"))


def warnings(df: DataFrame, optional: list[str], label: str) -> DataFrame:
    return broken(df, {f"absent:{c}": F.col(c).isNull() for c in optional} | {"low_confidence": F.col(label) == "LOW"})


def invariant_violations(df: DataFrame) -> DataFrame:
    """Availability, date precision, attribution path and confidence of claims and observations."""
    seen = F.col("availability") == "OBSERVED"
    return broken(
        df,
        {
            "observed_without_fact_type": seen & F.col("fact_type").isNull(),
            "absent_with_value": ~seen & (F.col("value").isNotNull() | F.col("fact_type").isNotNull()),
            "date_without_day": F.col("observed_at").isNotNull() != (F.col("granularity") == "DATE"),
            "attribution": F.col("record_id").isNotNull() == F.col("subject_id").isNotNull(),
            "confidence_range": ~F.col("confidence").between(0, 1),
        },
    )


def registry_violations(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims against (attribute_key, kind, fact_types, unit)."""
    j = claims.join(registry, "attribute_key", "left")
    get = lambda k: F.get_json_object("value_json", f"$.{k}")
    return broken(
        j,
        {
            "unknown_attribute": F.col("kind").isNull(),
            "fact_type": ~F.array_contains("fact_types", F.col("fact_type")),
            "scalar_without_value": (F.col("kind") == "SCALAR") & get("value").isNull(),
            "range_without_bounds": (F.col("kind") == "RANGE") & (get("min").isNull() | get("max").isNull()),
            "range_order": (F.col("kind") == "RANGE") & (get("min").cast("double") > get("max").cast("double")),
            "set_without_values": (F.col("kind") == "SET") & get("values").isNull(),
        },
    )


def interval_violations(claims: DataFrame) -> DataFrame:
    return broken(claims, {"interval": F.col("valid_from") >= F.col("valid_to"), "assertion": ~F.col("assertion").isin("ASSERTS", "RETRACTS")})


def research_violations(obs: DataFrame, ceilings: dict[str, str] = cfg.CLASS_CEILING, order: dict[str, int] = cfg.FACT_RANK_RESEARCH) -> DataFrame:
    """A fact type above what the evidence class allows."""
    rank = lambda c: fn.lookup(c, {k: float(v) for k, v in order.items()}, 9.0)
    top = F.create_map(*[F.lit(x) for kv in ceilings.items() for x in kv])
    limit = F.try_element_at(top, F.col("evidence_class"))
    return broken(obs, {"ceiling": limit.isNotNull() & (rank("fact_type") < rank(limit)), "class": F.col("evidence_class").isNotNull() & limit.isNull()})


def chain_violations(d: DataFrame, id_col: str = "decision_id", parent: str = "supersedes_decision_id", entity: str = "record_id") -> DataFrame:
    """Chains with no root or several, parents of several, rows above themselves, and parents of another entity. The links are
    staged and dealt by parent into parts that follow the size of the table."""
    d = io.staged(d.select(id_col, parent, entity), "chain-links")
    roots = d.groupBy(entity).agg(F.count_if(F.col(parent).isNull()).alias("n")).where("n <> 1").select(F.col(entity).cast("string").alias("key"), F.lit("roots").alias("violation"))
    linked = rel.spread(d.where(F.col(parent).isNotNull()), parent)
    kids = linked.groupBy(parent).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(parent).cast("string").alias("key"), F.lit("children").alias("violation"))
    me = d.where(F.col(id_col) == F.col(parent)).select(F.col(id_col).cast("string").alias("key"), F.lit("self").alias("violation"))
    up = d.select(F.col(id_col).alias(parent), F.col(entity).alias("_e"))
    other = linked.join(rel.spread(up, parent), parent).where(F.col(entity) != F.col("_e")).select(F.col(id_col).cast("string").alias("key"), F.lit("entity").alias("violation"))
    return roots.union(kids).union(me).union(other)


def illegal_transitions(events: DataFrame, key: str, graph: list[tuple], rank: dict[str, int], kind: str = "event_kind", at: str = "occurred_at", id_col: str = "event_id") -> DataFrame:
    """Events that the one before them does not permit. The graph is a bounded literal; null precedes the first event."""
    order = [F.col(at), fn.lookup(kind, {k: float(v) for k, v in rank.items()}, 99.0), F.col(id_col)]
    d = events.withColumn("previous", F.lag(kind).over(Window.partitionBy(key).orderBy(*order)))
    pair = F.concat_ws(">", F.coalesce("previous", F.lit("-")), kind)
    return d.where(~pair.isin([f"{a or '-'}>{b}" for a, b in graph])).withColumn("violation", pair)


def unsupported_claims(claims: DataFrame, links: DataFrame) -> DataFrame:
    return claims.where("requires_evidence").join(links.select("claim_id").distinct(), "claim_id", "left_anti").withColumn("violation", F.lit("unsupported"))


def fetch_violations(events: DataFrame) -> DataFrame:
    ok = F.col("outcome") == "OK"
    return broken(events, {"ok_without_body": ok & F.col("body_sha256").isNull(), "not_modified_without_body": (F.col("outcome") == "NOT_MODIFIED") & F.col("validated_body").isNull(), "body_on_failure": ~ok & F.col("body_sha256").isNotNull()})


def table_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()])


def fingerprint_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of protected tables before and after, and whether they changed; a table of one side alone changed."""
    b, a = before.withColumnRenamed("rows", "rows_before"), after.withColumnRenamed("rows", "rows_after")
    return b.join(a, "table", "full").withColumn("changed", ~F.col("rows_before").eqNullSafe(F.col("rows_after")))


def confidence_divergence(claims: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Claims whose stored confidence is not the derived one."""
    r = recomputed.select("claim_id", F.col("confidence").alias("derived"))
    return claims.join(r, "claim_id").where(F.abs(F.col("confidence") - F.col("derived")) > 1e-9).withColumn("violation", F.lit("confidence"))
