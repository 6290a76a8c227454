"""Read models and the steps that feed them: listings, queues, imported runs, company, research and signal views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import columns as fn
from attesta.functions import config as cfg
from attesta.operators import relational as rel
from attesta.plans import entities as ent
from attesta.plans import research as res

# --- listings (TK) ----------------------------------------------------------------------------------------------------


def listing_order(df: DataFrame, key: str = "market_key", score: str = "score") -> DataFrame:
    """Best score first, an unknown one as 0, then key."""
    return df.orderBy(F.desc(F.coalesce(score, F.lit(0.0))), key)


def queue_page(df: DataFrame, limit: int, at: str = "raised_at", id_col: str = "candidate_id", **filters) -> DataFrame:
    """The oldest entries of a queue under equality filters."""
    return rel.filter_eq(df, **filters).orderBy(at, id_col).limit(limit)


def claim_page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy("attribute_key", "created_at", "claim_id").offset(offset).limit(limit)


# --- imported markets (SC05, SC06, SC28) ------------------------------------------------------------------------------

_RANGES = {"tam": "tam", "sam": "sam", "som_accounts": "som_accounts", "ticket": "ticket_usd", "sam_value": "sam_value_usd", "som_pool_value": "som_pool_value_usd"}


def normalise_blocks(markets: DataFrame, categories: list[str], by: str = "market_key") -> dict[str, DataFrame]:
    """The nested blocks of a market as tables: known categories and the unknown ones, competition, size ranges (where
    given; both ends null where a range is), and deep dives with their lists split."""
    cats = markets.select(by, F.explode("market_categories").alias("category_key"))
    known = F.col("category_key").isin(categories)
    size = F.col("tam_sam_som")
    ends = [c for out, field in _RANGES.items() if field in markets.schema["tam_sam_som"].dataType.names for c in (size[field]["min"].alias(f"{out}_min"), size[field]["max"].alias(f"{out}_max"))]
    dive = F.col("deep_dive")
    lists = [fn.split_list(dive[c]).alias(c) for c in ("priority_verticals", "priority_geographies", "common_buyers")]
    return {
        "categories": cats.where(known).distinct(),
        "unknown_categories": cats.where(~known),
        "competition": markets.where("competition is not null").select(by, "competition.*"),
        "sizes": markets.where(size.isNotNull()).select(by, size["fact_type"].alias("fact_type"), *ends),
        "deep_dives": markets.where(dive.isNotNull()).select(by, *lists, dive["recommended_channel"].alias("recommended_channel")),
    }


def reference_run(markets: DataFrame, components: DataFrame, universe_only: DataFrame, weights: dict[str, float], by: str = "market_key") -> dict[str, DataFrame]:
    """A published run as it is: scores (coverage 1, or 0 for markets with a total alone), every component of the model with
    its share of the weight, and how far any total is from the sum of its components."""
    sums = components.groupBy(by).agg(F.sum("value").alias("component_sum"))
    scored = markets.join(sums, by, "left").withColumn("component_sum", F.coalesce("component_sum", F.lit(0.0)))
    names = F.array(*[F.struct(F.lit(k).alias("component"), F.lit(w).alias("weight")) for k, w in weights.items()])
    slots = markets.select(by, F.explode(names).alias("c")).select(by, "c.*").join(components.select(by, "component", "value"), [by, "component"], "left")
    extra = universe_only.select(by, "score", F.lit(None).cast("int").alias("rank"), F.lit(0.0).alias("coverage"), F.lit(None).cast("double").alias("component_sum"))
    return {
        "scores": scored.select(by, "score", "rank", F.lit(1.0).alias("coverage"), "component_sum").unionByName(extra),
        "components": slots.withColumns({"normalized": F.col("value") / F.col("weight"), "coverage": F.col("value").isNotNull().cast("double")}),
        "delta": scored.agg(F.coalesce(F.max(F.abs(F.col("component_sum") - F.col("score"))), F.lit(0.0)).alias("max_delta")),
    }


def set_gap_status(gaps: DataFrame, updates: DataFrame) -> DataFrame:
    """Gaps with the status of their latest update; updates of unknown gaps change nothing."""
    last = rel.first_per_key(updates, ["gap_id"], [F.desc("updated_at"), F.desc("update_id")]).select("gap_id", F.col("status").alias("_s"), F.col("updated_at").alias("_at"))
    j = gaps.join(last, "gap_id", "left")
    return j.withColumns({"status": F.coalesce("_s", "status"), "updated_at": F.coalesce("_at", "updated_at")}).drop("_s", "_at")



# --- entities (ER08-ER18, ER24-ER31) ----------------------------------------------------------------------------------


def renormalise(versions: DataFrame, done: DataFrame, normaliser: str, schema: str) -> DataFrame:
    """Stored versions that this version of the normaliser has not seen, in candidate shape."""
    seen = done.where(F.col("normaliser") == normaliser).select("content_hash").distinct()
    return ent.normalise(versions.join(seen, "content_hash", "left_anti"), schema).withColumn("normaliser", F.lit(normaliser))


def changed_only(decisions: DataFrame, heads: DataFrame) -> DataFrame:
    """Decisions that say something else than the head of their record, or that have no head."""
    h = heads.select("record_id", F.col("decision").alias("_d"), F.col("company_id").alias("_c"), F.lit(True).alias("_h"))
    j = decisions.join(h, "record_id", "left")
    same = F.coalesce("_h", F.lit(False)) & F.col("decision").eqNullSafe(F.col("_d")) & F.col("company_id").eqNullSafe(F.col("_c"))
    return j.where(~same).drop("_d", "_c", "_h")


def ambiguous_queue(decisions: DataFrame, limit: int) -> DataFrame:
    """Heads that wait for a person, oldest first."""
    return queue_page(rel.heads(decisions).where("decision = 'AMBIGUOUS'"), limit, "decided_at", "decision_id")


def unclaimed(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """(version, decision) pairs that have produced no claims yet."""
    return pairs.join(claims.select("version_id", "decision_id").distinct(), ["version_id", "decision_id"], "left_anti")


def project_locations(claims: DataFrame) -> DataFrame:
    """Per company, kind and normalised address the winning claim's place, and the claims behind it."""
    get = lambda k: F.get_json_object("value_json", f"$.{k}")
    c = claims.where("attribute_key = 'location'").withColumns({"location_type": F.coalesce(get("location_type"), F.lit("HEADQUARTERS")), "address_normalized": F.coalesce(get("address_normalized"), F.lit("unknown"))})
    by = ["company_id", "location_type", "address_normalized"]
    ids = c.groupBy(*by).agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))
    return rel.first_per_key(c, by, ent.precedence()).select(*by, get("city").alias("city"), get("postal_code").alias("postal_code")).join(ids, by)


def project_verticals(claims: DataFrame) -> DataFrame:
    """Per company and vertical the winning claim's standing; the lowest vertical id, as text, is primary."""
    c = claims.where("attribute_key = 'vertical'").withColumn("vertical_id", F.get_json_object("value_json", "$.vertical_id")).where("vertical_id is not null")
    by = ["company_id", "vertical_id"]
    ids = c.groupBy(*by).agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))
    w = rel.first_per_key(c, by, ent.precedence()).select(*by, "fact_type", "confidence")
    return rel.primary_flag(w.join(ids, by), ["company_id"], "vertical_id")


def company_view(companies: DataFrame, profiles: DataFrame, presences: DataFrame | None = None, verticals: DataFrame | None = None, market: str | None = None, vertical: str | None = None, lifecycle: str | None = None) -> DataFrame:
    """Companies with their profile, if any, under the filters given; ``projection_conflict`` is false without a profile."""
    d = rel.filter_eq(companies, lifecycle_status=lifecycle)
    if market is not None:
        d = rel.having_match(d, presences, "company_id", F.col("market") == market)
    if vertical is not None:
        d = rel.having_match(d, verticals, "company_id", F.col("vertical_id") == vertical)
    return rel.with_optional(d, profiles, "company_id").withColumn("projection_conflict", F.coalesce("projection_conflict", F.lit(False)))


# --- research (RS22-RS45) ---------------------------------------------------------------------------------------------


def origins(evidence: DataFrame, by: str = "claim_id") -> DataFrame:
    """The distinct (source, artifact) pairs behind each claim, in order."""
    return evidence.groupBy(by).agg(F.array_sort(F.collect_set(F.struct("source_id", "artifact_id"))).alias("origins"))


def corroboration(claims: DataFrame, links: DataFrame) -> DataFrame:
    """(company, attribute, value, witnesses): independent witnesses over all claims that say the same."""
    key = ["company_id", "attribute_key", "value_json"]
    c = claims.withColumn("value_json", F.coalesce(fn.canonical_json("value_json"), "value_json"))
    return res.independent_witnesses(c.select("claim_id", *key).join(links, "claim_id"), key)


def review_queue(candidates: DataFrame, reviews: DataFrame, provenance: DataFrame, limit: int = 50, company: object | None = None, reason: str | None = None) -> DataFrame:
    """Candidates nobody has decided on, oldest first; the company comes from their evidence's provenance."""
    d = rel.pending(candidates, reviews, "candidate_id")
    if company is not None:
        d = rel.having_match(d, provenance, "evidence_id", F.col("company_id") == company)
    return queue_page(d, limit, reason=reason)


def confirm(candidates: DataFrame, reviews: DataFrame, observations: DataFrame) -> DataFrame:
    """Claims of confirmed candidates: the stored observation becomes a human extraction, its evidence, and a claim."""
    c = res.confirmed(candidates, reviews).select("candidate_id", "review_id", "fingerprint", "company_id")
    o = c.join(rel.first_per_key(observations, ["fingerprint"], [F.col("observation_id")]), "fingerprint")
    o = o.withColumn("extraction_id", F.sha2(F.concat_ws("|", F.lit("human"), "fingerprint"), 256))
    return res.claims_from_observations(res.evidence_items(o))


def signal_view(occurrences: DataFrame, events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every occurrence of a signal with its status now and its evidence."""
    now = res.current_status(events, "occurrence_id", cfg.SIGNAL_RANK).select("occurrence_id", F.col("event_kind").alias("status"), F.col("occurred_at").alias("since"))
    e = evidence.groupBy("occurrence_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    return occurrences.join(now, "occurrence_id", "left").join(e, "occurrence_id", "left")


def research_view(claims: DataFrame, horizons: DataFrame, as_of: Column) -> DataFrame:
    """What is known of each company, attribute by attribute, with the freshest verdict at a day."""
    p = res.company_profile(claims)
    s = res.company_staleness(claims, horizons, as_of).select("company_id", "attribute_key", F.col("state").alias("staleness"))
    return p.join(s, ["company_id", "attribute_key"], "left")


def source_report(fetches: DataFrame, links: DataFrame, discoveries: DataFrame) -> DataFrame:
    """Retrievals, links in and out and discoveries of every source."""
    parts = [fetches.select("source_id", F.lit("fetch").alias("part")), discoveries.select("source_id", F.lit("discovery"))]
    parts += [links.select(F.col("from_id").alias("source_id"), F.lit("out")), links.select(F.col("to_id"), F.lit("in"))]
    return rel.counts_by(reduce(DataFrame.union, parts), "source_id", "part")
