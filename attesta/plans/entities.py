"""Provider records to companies: evidence versions, resolution decisions, typed claims and their projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import columns as fn
from attesta.functions import config as cfg
from attesta.operators import relational as rel

# --- evidence (ER01-ER09) ---------------------------------------------------------------------------------------------


def assign_identity(records: DataFrame, capability: Column, native: str, key_cols: list[str], body: str, version: str = "1") -> DataFrame:
    """external_id by what the provider can do: its own id, a key derived from declared fields (else the content), or the
    content. A native id that is missing is a violation."""
    content = fn.sha256(body)
    derived = F.coalesce(fn.derive_key(key_cols, version), content)
    ext = F.when(capability == "NATIVE", F.col(native).cast("string")).when(capability == "DERIVED", derived).otherwise(content)
    kind = F.when(capability == "DERIVED", F.when(fn.derive_key(key_cols, version).isNull(), "CONTENT").otherwise("DERIVED")).otherwise(capability)
    return records.withColumns({"external_id": ext, "identity_kind": kind, "content_hash": content, "violation": F.when(ext.isNull(), "NO_NATIVE_ID")})


def entities(records: DataFrame) -> DataFrame:
    return records.where("external_id is not null").groupBy("provider", "external_id").agg(F.min("seen_at").alias("first_seen_at")).withColumn("entity_id", F.sha2(F.concat_ws("|", "provider", "external_id"), 256))


def versions(records: DataFrame) -> DataFrame:
    """One row per entity and content, with the first time it was seen."""
    return records.where("external_id is not null").groupBy("provider", "external_id", "content_hash").agg(F.min("seen_at").alias("first_seen_at"), F.count(F.lit(1)).alias("n_sightings"))


def bodies(records: DataFrame) -> DataFrame:
    return records.select("content_hash", "body").dropDuplicates(["content_hash"])


def sightings(records: DataFrame) -> DataFrame:
    return records.select("provider", "external_id", "content_hash", "query_id").distinct()


def normalise(records: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """The payload in candidate shape; a row that cannot be read keeps its place and says why."""
    parsed = F.from_json(body, schema)
    bad = F.try_parse_json(body).isNull()
    return records.withColumns({"candidate": F.when(~bad, parsed), "error": F.when(bad, "MALFORMED")})


def ingest_report(records: DataFrame, page_size: int = 100) -> DataFrame:
    return records.groupBy("provider").agg(
        F.ceil(F.count(F.lit(1)) / page_size).alias("pages"), F.count(F.lit(1)).alias("records"), F.countDistinct("external_id").alias("entities"),
        F.countDistinct("external_id", "content_hash").alias("versions"), F.countDistinct("content_hash").alias("bodies"), F.count("violation").alias("errors"),
    )


def resolvable(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("completed_at").isNotNull() | F.coalesce("allow_partial", F.lit(False)))


# --- resolution (ER10-ER16) -------------------------------------------------------------------------------------------


def collisions(records: DataFrame, entity: str = "entity_id", name: str = "legal_name") -> DataFrame:
    """Entities of a derived key with several normalised names."""
    return records.where("identity_kind = 'DERIVED'").groupBy(entity).agg(F.countDistinct(fn.normalize_name(name)).alias("names")).where("names > 1")


def match_domain(records: DataFrame, domains: DataFrame) -> DataFrame:
    """(record_id, company_id): the identity domain of an active company; the lowest id on a tie."""
    r = records.select("record_id", fn.normalize_domain("domain").alias("d")).where("d is not null").where(~F.col("d").isin(cfg.SHARED_HOSTS))
    d = domains.where("role = 'IDENTITY' and lifecycle = 'ACTIVE'").select(F.col("domain").alias("d"), "company_id")
    return r.join(d, "d").groupBy("record_id").agg(F.min("company_id").alias("company_id"))


def score_candidates(records: DataFrame, names: DataFrame, domains: DataFrame, weights: dict[str, float] = cfg.CANDIDATE_WEIGHTS, threshold: float = 0.55, k: int = 25) -> DataFrame:
    """(record_id, company_id, score, signals) from exact names, similar names and shared group domains."""
    r = records.select("record_id", fn.normalize_name("name").alias("name"), fn.normalize_domain("domain").alias("domain"))
    n = names.select("company_id", fn.normalize_name("name").alias("name"))
    exact = r.join(n, "name").select("record_id", "company_id", F.lit("exact_name").alias("signal"))
    fuzzy = rel.fuzzy_join(r.where("name is not null").select("record_id", "name"), n.where("name is not null").withColumnRenamed("name", "other"), "record_id", "name", "company_id", "other", threshold, k)
    group = r.join(domains.where("role = 'GROUP'").select("domain", "company_id"), "domain").select("record_id", "company_id", F.lit("group_domain").alias("signal"))
    all_ = exact.union(fuzzy.select("record_id", "company_id", F.lit("fuzzy_name"))).union(group).distinct()
    return all_.groupBy("record_id", "company_id").agg(F.round(F.sum(fn.lookup("signal", weights, 0.0)), 4).alias("score"), F.array_sort(F.collect_set("signal")).alias("signals"))


def resolve(records: DataFrame, heads: DataFrame, domain_match: DataFrame, candidates: DataFrame, collided: DataFrame, auto: float = cfg.AUTO_MATCH, ambiguous: float = cfg.AMBIGUOUS) -> DataFrame:
    """One decision per record, all against one state of the projections; a record that has a head is left out."""
    best = rel.first_per_key(candidates, ["record_id"], [F.desc("score"), F.col("company_id")]).select("record_id", F.col("company_id").alias("cand"), "score")
    j = records.join(heads.select("record_id"), "record_id", "left_anti").join(domain_match.withColumnRenamed("company_id", "by_domain"), "record_id", "left").join(best, "record_id", "left").join(collided.select("record_id").distinct().withColumn("_c", F.lit(True)), "record_id", "left")
    blank = F.col("name").isNull() & F.col("domain").isNull()
    verdict = lambda d, m: F.struct(F.lit(d).alias("d"), F.lit(m).alias("m"))
    case = (
        F.when(blank, verdict("AMBIGUOUS", "no_identifiers"))
        .when(F.col("by_domain").isNotNull(), verdict("MATCHED", "domain"))
        .when(F.coalesce("_c", F.lit(False)), verdict("AMBIGUOUS", "key_collision"))
        .when(F.col("score") >= auto, verdict("MATCHED", "candidate"))
        .when(F.col("score") >= ambiguous, verdict("AMBIGUOUS", "candidate"))
        .otherwise(verdict("CREATED_NEW", "new"))
    )
    j = j.withColumn("_x", case).withColumns({"decision": F.col("_x.d"), "method": F.col("_x.m")})
    company = F.when(F.col("decision") == "CREATED_NEW", F.sha2(F.col("record_id").cast("string"), 256)).when(F.col("decision") == "MATCHED", F.coalesce(F.col("by_domain").cast("string"), F.col("cand").cast("string")))
    return j.select("record_id", "decision", "method", company.alias("company_id"), "score")


def append_decisions(decisions: DataFrame, human: DataFrame) -> DataFrame:
    """Human decisions on top of the head of their record; one that changes nothing appends nothing."""
    head = rel.heads(decisions).select("record_id", F.col("decision_id").alias("supersedes_decision_id"), F.col("decision").alias("_d"), F.col("company_id").alias("_c"))
    new = human.join(head, "record_id", "left").where(~(F.col("decision").eqNullSafe(F.col("_d")) & F.col("company_id").eqNullSafe(F.col("_c"))))
    new = new.withColumn("decision_id", F.sha2(F.concat_ws("|", "record_id", "decision", "company_id", "supersedes_decision_id"), 256))
    return decisions.unionByName(new.select(*decisions.columns))


# --- claims and projections (ER17-ER28) -------------------------------------------------------------------------------


def claims_from_candidates(c: DataFrame) -> DataFrame:
    """Typed claims, one per attribute that is there: (company_id, record_id, attribute_key, value_json, fact_type, confidence)."""
    one = lambda k, col, fact: F.struct(F.lit(k).alias("attribute_key"), F.when(F.col(col).isNotNull(), F.to_json(F.struct(F.col(col).alias("value")))).alias("value_json"), F.lit(fact).alias("fact_type"))
    names = {"legal_name": "FACT", "website_domain": "FACT", "country": "FACT", "city": "FACT", "phone": "FACT", "language": "PROXY"}
    rows = [one(k, k, f) for k, f in names.items() if k in c.columns]
    if {"employees_min", "employees_max"} <= set(c.columns):
        known = F.col("employees_min").isNotNull() | F.col("employees_max").isNotNull()
        rows.append(F.struct(F.lit("employees").alias("attribute_key"), F.when(known, F.to_json(F.struct(F.col("employees_min").alias("min"), F.col("employees_max").alias("max")))).alias("value_json"), F.lit("ESTIMATE").alias("fact_type")))
    d = c.withColumn("x", F.explode(F.array(*rows))).where("x.value_json is not null")
    d = d.select("company_id", "record_id", "provider", "observed_at", "x.*")
    return d.withColumns({"confidence": fn.evidence_confidence("fact_type", F.lit("DATE"), F.lit(None)), "claim_id": F.sha2(F.concat_ws("|", "company_id", "record_id", "attribute_key", "value_json"), 256)})


def relationship_claims(df: DataFrame, symmetric: list[str] = ("SISTER_OF",)) -> DataFrame:
    """Edges with ends in order of id where the type is symmetric."""
    s = F.col("edge_type").isin(list(symmetric))
    return df.withColumns({"from_id": F.when(s, F.least("from_id", "to_id")).otherwise(F.col("from_id")), "to_id": F.when(s, F.greatest("from_id", "to_id")).otherwise(F.col("to_id"))})


def precedence(order: dict[str, int] = cfg.FACT_RANK_PROJECTION) -> list[Column]:
    """Human first, then fact type, trust, later observation, lowest id."""
    return [F.desc("human"), fn.lookup("fact_type", {k: float(v) for k, v in order.items()}, 9.0), F.desc("trust"), F.desc_nulls_last("observed_at"), F.col("claim_id")]


def effective_claims(claims: DataFrame, heads: DataFrame, trust: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Claims of records whose head decides for a company, with the provider's trust (0.5 if unknown), and direct claims."""
    live = heads.where("decision in ('MATCHED', 'CREATED_NEW')").select("record_id", F.col("company_id").alias("_company"))
    c = claims.join(live, "record_id").withColumn("company_id", F.col("_company")).drop("_company")
    c = rel.with_default(c, trust, "provider", "trust", 0.5).withColumn("human", F.lit(False))
    return c if direct is None else c.unionByName(direct.withColumns({"trust": F.lit(1.0), "human": F.lit(True)}), allowMissingColumns=True)


def project_profiles(claims: DataFrame) -> DataFrame:
    """Per company and attribute the winner, whether its equals in rank disagree, and the claims behind it."""
    w = rel.winners(claims, ["company_id", "attribute_key"], precedence(), "value_json", 4)
    ids = claims.groupBy("company_id", "attribute_key").agg(F.array_sort(F.collect_set("claim_id")).alias("derived_from_claim_ids"))
    return w.select("company_id", "attribute_key", "value_json", "fact_type", "conflict").join(ids, ["company_id", "attribute_key"])


def project_values(claims: DataFrame, attribute: str, out: str, primary: str = "is_primary") -> DataFrame:
    """Distinct values of an attribute per company (names, locations, verticals), the lowest one primary."""
    v = claims.where(F.col("attribute_key") == attribute).select("company_id", F.get_json_object("value_json", "$.value").alias(out), "claim_id").where(F.col(out).isNotNull())
    g = v.groupBy("company_id", out).agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))
    return rel.primary_flag(g, ["company_id"], out).withColumnRenamed("is_primary", primary)


def project_domains(claims: DataFrame) -> DataFrame:
    """Domains with their role: shared hosts are GROUP, and one company keeps IDENTITY for a domain."""
    v = claims.where("attribute_key = 'website_domain'").select("company_id", fn.normalize_domain(F.get_json_object("value_json", "$.value")).alias("domain")).where("domain is not null").distinct()
    v = v.withColumn("role", F.when(F.col("domain").isin(cfg.SHARED_HOSTS), "GROUP").otherwise("IDENTITY"))
    return rel.single_owner(v, "domain", "company_id")


def _intervals(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open intervals, one per key and start: a retraction removes its own, and only a stated end closes one (that
    of the highest claim with an end); a missing start is 1900-01-01."""
    c = claims.withColumn("effective_from", F.coalesce("valid_from", F.to_date(F.lit("1900-01-01"))))
    by = [*keys, "effective_from"]
    gone = c.where("assertion = 'RETRACTS'").select(*by).distinct()
    c = c.where("assertion <> 'RETRACTS'").join(gone, by, "left_anti")
    return c.groupBy(*by).agg(F.max_by("valid_to", F.when(F.col("valid_to").isNotNull(), F.col("claim_id"))).alias("effective_to"), F.min("claim_id").alias("claim_id"))


def project_presences(claims: DataFrame, by: list[str]) -> DataFrame:
    return _intervals(claims, by).drop("claim_id")


def project_relationships(rels: DataFrame) -> DataFrame:
    """Intervals of edges over claims that nothing supersedes; the lowest claim of an interval stands for it."""
    return _intervals(rel.heads(rels, "claim_id", "supersedes_claim_id"), ["from_id", "to_id", "edge_type"])


def projection_report(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in tables.items():
        d = rel.content_digest(t).withColumn("table", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


# --- cohorts and read models (ER29-ER32) ------------------------------------------------------------------------------


def classify_cohort(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """LOADED, NEEDS_REVIEW (no usable domain), ALREADY_PRESENT, or DUPLICATE within the list."""
    d = rows.withColumn("d", fn.normalize_domain("canonical_domain"))
    known = domains.where("role = 'IDENTITY'").select(F.col("domain").alias("d")).distinct().withColumn("_k", F.lit(True))
    d = rel.mark_operative(d.join(known, "d", "left"), ["d"], [F.col("company_name")])
    ok = F.col("d").isNotNull() & ~F.coalesce(F.col("d").isin(cfg.SHARED_HOSTS), F.lit(True))
    return d.withColumn("status", F.when(~ok, "NEEDS_REVIEW").when(F.col("_k"), "ALREADY_PRESENT").when(~F.col("operative"), "DUPLICATE").otherwise("LOADED")).drop("_k", "operative")


def domain_scope(domains: DataFrame) -> DataFrame:
    """Per company the domains to research, the primary one, and those left out with the reason."""
    shared = F.col("domain").isin(cfg.PLATFORM_DOMAINS)
    use = (F.col("role") == "IDENTITY") & ~shared
    why = F.when(shared, "PLATFORM").otherwise("GROUP_ROLE")
    return domains.groupBy("company_id").agg(F.min(F.when(use, F.col("domain"))).alias("primary_domain"), F.array_sort(F.collect_set(F.when(use, F.col("domain")))).alias("researchable"), F.array_sort(F.collect_set(F.when(~use, F.concat_ws(":", "domain", why)))).alias("excluded"))


def run_versions(sightings: DataFrame) -> DataFrame:
    """The distinct versions that each run saw, and how often."""
    return sightings.groupBy("run_id", "external_id", "content_hash").agg(F.count(F.lit(1)).alias("n_seen"))


def version_view(v: DataFrame, body: DataFrame, seen: DataFrame) -> DataFrame:
    b = body.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_bodies"))
    s = seen.groupBy("external_id", "content_hash").agg(F.count(F.lit(1)).alias("n_seen"))
    zero = F.lit(0).cast("long")
    return v.join(b, "content_hash", "left").join(s, ["external_id", "content_hash"], "left").withColumns({"n_bodies": F.coalesce("n_bodies", zero), "n_seen": F.coalesce("n_seen", zero)})
