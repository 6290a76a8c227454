"""Web documents to evidence: sources, text, rule extraction, witnesses, claims, profiles, gaps, staleness, retention."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import columns as fn
from attesta.functions import config as cfg
from attesta.operators import relational as rel
from attesta.plans.witnesses import independent_witnesses
from attesta.sources import io

# --- sources and documents (RS01-RS11) --------------------------------------------------------------------------------


def sources(urls: DataFrame, url: str = "url", seen: str = "seen_at") -> DataFrame:
    d = urls.select(fn.normalize_locator(url).alias("locator"), seen)
    d = d.groupBy("locator").agg(F.min(seen).alias("first_seen"), F.count(F.lit(1)).alias("n_urls"))
    return d.withColumn("host", fn.host_of("locator")).withColumn("domain", fn.registrable_domain("host"))


def discoveries(candidates: DataFrame) -> DataFrame:
    """One row per locator, method and context."""
    return rel.one_per_key(candidates.withColumn("context_hash", fn.fingerprint("method", "parent", "pursued_for")), ["locator", "context_hash"])


def link_report(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Every reference of the pages' anchors with what became of it: (url, href, locator, in_scope, relevant, reason).

    A reference is resolved against its page as a browser does; the locator is null where it names no web page. The reason is
    null for a link to follow, else FRAGMENT (a place on the same page), SCHEME (mail, scripts, files), HOST (none), SELF,
    OUT_OF_SCOPE (another registrable domain) or IRRELEVANT. References that a page repeats count once.
    """
    base = fn.normalize_locator(url)
    hrefs = F.array_distinct(F.regexp_extract_all(html, F.lit("""(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*["']\\s*([^"'>\\s]+)"""), F.lit(1)))
    d = pages.select(F.col(url).alias("url"), base.alias("base"), F.explode(hrefs).alias("href")).distinct()
    d = d.withColumn("full", fn.resolve_reference("base", "href"))
    web, host = F.col("full").rlike("^https?:"), fn.host_of("full") != ""
    d = d.withColumn("locator", F.when(web & host & ~F.col("href").startswith("#"), fn.normalize_locator(fn.strip_presentation("full"))))
    d = d.withColumns({"in_scope": fn.registrable_domain(fn.host_of("locator")) == fn.registrable_domain(fn.host_of("base")), "relevant": fn.is_relevant("locator")})
    reason = (
        F.when(F.col("href").startswith("#"), "FRAGMENT").when(~web, "SCHEME").when(~host, "HOST").when(~F.col("in_scope"), "OUT_OF_SCOPE").when(~F.col("relevant"), "IRRELEVANT")
        .when(F.col("locator") == F.col("base"), "SELF")
    )
    return d.select("url", "href", "locator", "in_scope", "relevant", reason.alias("reason"))


def extract_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(url, locator, in_scope, relevant) of the pages' anchors that name a web page."""
    return link_report(pages, html, url).where("locator is not null").select("url", "locator", "in_scope", "relevant").distinct()


def expand(links: DataFrame, seeds: DataFrame, max_depth: int = 2, budget: int | None = None) -> DataFrame:
    """(company_id, locator, depth) reached over stored links; each level asks only for what no level before has. Links and
    levels are staged, so that none is worked out again for the next one."""
    links = io.staged(links.select("url", "locator").distinct(), "links")
    seen = level = io.staged(seeds.select("company_id", "locator", F.lit(0).alias("depth")).distinct(), "level")
    for depth in range(1, max_depth + 1):
        nxt = level.select("company_id", F.col("locator").alias("url")).join(links, "url").select("company_id", "locator").distinct()
        nxt = nxt.join(seen.select("company_id", "locator"), ["company_id", "locator"], "left_anti").withColumn("depth", F.lit(depth))
        if budget:
            nxt = rel.frontier(nxt.withColumn("hint", fn.relevance_hint("locator")), "company_id", budget).where("fetched").select("company_id", "locator", "depth")
        level = io.staged(nxt, "level")
        seen = seen.unionByName(level)
    io.discard(links)
    return seen


def sitemap_urls(docs: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """URLs of stored sitemaps; an index leads one level on."""
    locs = docs.select(F.col(url).alias("sitemap"), F.col(body).contains("<sitemapindex").alias("is_index"), F.explode(F.regexp_extract_all(body, F.lit("(?is)<loc>\\s*(.*?)\\s*</loc>"), F.lit(1))).alias("loc"))
    direct = locs.where("not is_index").select("sitemap", "loc")
    below = locs.where("is_index").select(F.col("sitemap").alias("root"), F.col("loc").alias("sitemap")).join(direct, "sitemap").select(F.col("root").alias("sitemap"), "loc")
    return direct.union(below).distinct()


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, trimmed and without its quotes; empty where the tag has none."""
    value = F.regexp_extract(tag, rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(value, r"""^["']|["']$""", ""))


def declared_edges(pages: DataFrame, html: str = "html", url: str = "url", fetches: DataFrame | None = None) -> DataFrame:
    """CANONICAL and LANGUAGE edges that pages declare, and REDIRECT edges of ``fetches`` (url, redirect_to); no edge
    leads to itself. Attributes of a tag may stand in any order, quoted or bare; a relative href is one of the page."""
    tag = lambda x: F.struct(*(_attribute(x, a).alias(a) for a in ("rel", "hreflang", "href")))
    tags = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<link\b([^>]*)>"), F.lit(1)), tag)
    says = lambda t, word: (t["href"] != "") & F.array_contains(F.split(F.lower(t["rel"]), r"\s+"), word)
    canonical = F.slice(F.filter("tags", lambda t: says(t, "canonical")), 1, 1)  # a page's first counts
    alternate = F.filter("tags", lambda t: says(t, "alternate") & (t["hreflang"] != ""))
    edge = lambda kind: lambda t: F.struct(t["href"].alias("href"), F.lit(kind).alias("edge_type"))
    found = F.concat(F.transform(canonical, edge("CANONICAL")), F.transform(alternate, edge("LANGUAGE")))
    edges = pages.select(F.col(url).alias("page"), tags.alias("tags")).select("page", F.inline(found))
    edges = edges.select(fn.normalize_locator("page").alias("from_locator"), fn.normalize_locator(fn.resolve_reference("page", "href")).alias("to_locator"), "edge_type")
    if fetches is not None:
        edges = edges.union(fetches.select(fn.normalize_locator("url").alias("from_locator"), fn.normalize_locator("redirect_to").alias("to_locator"), F.lit("REDIRECT").alias("edge_type")))
    return edges.where("from_locator <> to_locator").distinct()


def mirrors(derivations: DataFrame) -> DataFrame:
    """(artifact_id, domain, locator, copies, origin) of artifacts that stand on several domains: of each domain the lowest
    locator and how many there are, and the artifact's lowest. Representatives stand for their copies, so a text that is
    everywhere makes a row per domain and not one per pair."""
    r = derivations.distinct().groupBy("artifact_id", "domain").agg(F.min("locator").alias("locator"), F.count(F.lit(1)).alias("copies"))
    a = r.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("_n"), F.min("locator").alias("origin")).where("_n > 1").drop("_n")
    return r.join(a, "artifact_id")


def web_bodies(fetches: DataFrame) -> DataFrame:
    """Fetches with the body they stand for: a 304 has that of the last successful fetch of its source."""
    w = Window.partitionBy("source_id").orderBy("fetched_at", "fetch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("outcome") == "OK", F.col("body_sha256"))
    return fetches.withColumn("body_ref", F.when(F.col("outcome").isin("OK", "NOT_MODIFIED"), F.last(own, ignorenulls=True).over(w)))


def classify(bodies: DataFrame, body: str = "body") -> DataFrame:
    return bodies.withColumn("media_type", fn.sniff(body))


def derive_artifacts(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(body_sha256, media_type, text, artifact_id, title, language, published): bodies with equal text are one artifact."""
    m = F.col("media_type")
    text = F.when(m == "text/html", fn.html_text(body)).when(m == "application/json", fn.canonical_json(body)).when(m == "application/pdf", fn.paged_text(body)["text"]).otherwise(F.trim(F.regexp_replace(body, fn.SPACES, " ")))
    d = classify(bodies, body).withColumn("text", text)
    html = m == "text/html"
    return d.select("body_sha256", "media_type", "text", F.sha2("text", 256).alias("artifact_id"), F.when(html, fn.html_title(body)).alias("title"), F.when(html, fn.html_language(body)).alias("language"), F.when(html, fn.parse_published(fn.html_published(body))).alias("published"))


def derive_text(artifacts: DataFrame, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    out = None
    for v in versions:
        d = artifacts.select("artifact_id", F.lit(v).alias("redaction_version"), fn.redact("text", v).alias("text"))
        out = d if out is None else out.unionByName(d)
    return out.withColumn("text_id", F.sha2("text", 256))


# --- extraction (RS12-RS18, FLT10) ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PhraseRule:
    """A phrase and the observation that finding it licenses. ``number`` is the group that holds a number, 0 for none."""

    rule_id: str
    pattern: str
    attribute_key: str
    fact_type: str
    number: int = 0
    unit: str | None = None
    evidence_class: str | None = None


#: Phrases of operational pages.
RULES = [
    PhraseRule("technicians", r"([0-9]{1,4}) field technicians", "technician_count", "FACT", 1, "PEOPLE"),
    PhraseRule("technicians_about", r"approximately ([0-9]{1,4}) technicians", "technician_count", "ESTIMATE", 1, "PEOPLE"),
    PhraseRule("workforce", r"[0-9]{1,4} field technicians", "field_workforce_present", "FACT"),
    PhraseRule("fleet", r"fleet of ([0-9]{1,4}) service vehicles", "fleet_size", "ESTIMATE", 1, "VEHICLES"),
    PhraseRule("locations", r"Locations: ([0-9]{1,3})", "branch_count", "PROXY", 1, "LOCATIONS"),
    PhraseRule("installation", r"HVAC installation", "installation", "FACT"),
    PhraseRule("preventive", r"(?i)preventive maintenance", "preventive_maintenance", "FACT"),
    PhraseRule("corrective", r"(?i)corrective repair|corrective maintenance", "corrective_maintenance", "FACT"),
    PhraseRule("emergency", r"(?i)24/7 emergency|24 hours a day, 7 days a week emergency", "emergency_service", "FACT"),
    PhraseRule("work_order", r"completes the work order on site and submits it to the service coordinator", "handoff_observation", "FACT", 0, None, "EXPLICIT_COMPANY_STATEMENT"),
    PhraseRule("fabrication", r"in-house sheet metal fabrication shop", "fabrication_operation_present", "FACT", 0, None, "EXPLICIT_COMPANY_STATEMENT"),
]


def _matches(text: Column, r: PhraseRule) -> Column:
    """A rule's matches in a text: array of structs, one type for all rules."""
    end = lambda acc: F.when(F.size(acc) > 0, F.element_at(acc, -1)["start"] + F.length(F.element_at(acc, -1)["quote"])).otherwise(0)
    place = lambda acc, q: F.array(F.struct(q.alias("quote"), (F.call_function("locate", q, text, (end(acc) + 1).cast("int")) - 1).cast("int").alias("start")))
    none = F.array().cast("array<struct<quote:string,start:int>>")
    spans = F.aggregate(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)), none, lambda acc, q: F.concat(acc, place(acc, q)))

    def row(s: Column) -> Column:
        n = F.regexp_extract(s["quote"], r.pattern, r.number).cast("int")
        value = F.to_json(F.struct(n.alias("min"), n.alias("max"))) if r.number else F.lit('{"value":true}')
        fixed = [F.lit(v).cast("string").alias(k) for k, v in (("rule_id", r.rule_id), ("attribute_key", r.attribute_key), ("fact_type", r.fact_type), ("unit", r.unit), ("evidence_class", r.evidence_class))]
        return F.struct(*fixed, s["quote"].alias("quote"), s["start"].alias("start"), (s["start"] + F.length(s["quote"])).alias("end"), value.alias("value_json"))

    return F.transform(spans, row)


def run_rules(texts: DataFrame, rules: list[PhraseRule], text: str = "text") -> DataFrame:
    """Every match of every rule as a row: quote, start, end, value and the rule's facts. Rules are data; each is one
    regular expression inside the JVM, and positions follow from the text between matches."""
    found = [_matches(F.col(text), r) for r in rules]
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.explode(F.flatten(F.array(*found))).alias("o")).select(*keep, "o.*")


def extract_postings(texts: DataFrame, text: str = "text") -> DataFrame:
    schema = "job_id string, employer string, title string, location string, posted_at string, description string, responsibilities array<string>, requirements array<string>"
    p = texts.where(fn.canonical_json(text).isNotNull()).withColumn("p", F.from_json(text, schema)).where("p.job_id is not null")
    return p.withColumn("posted", fn.parse_published("p.posted_at")).select(*[c for c in texts.columns if c != text], "p.job_id", "p.employer", "p.title", "posted", F.posexplode_outer("p.responsibilities").alias("position", "responsibility"))


def extract_registry(texts: DataFrame, text: str = "text") -> DataFrame:
    get = lambda k: F.get_json_object(text, f"$.{k}")
    keep = [c for c in texts.columns if c != text]
    return texts.where(fn.canonical_json(text).isNotNull()).select(*keep, get("jurisdiction").alias("jurisdiction"), get("entity_number").alias("entity_number"), get("legal_name").alias("legal_name"), get("principal_address.city").alias("city")).where("entity_number is not null")


def extract_paged(texts: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """First match of a pattern with its page and numbered section."""
    keep = [c for c in texts.columns if c != text]
    d = texts.withColumn("q", F.regexp_extract(text, pattern, 0)).where("q <> ''").withColumn("at", F.call_function("locate", F.col("q"), F.col(text)) - 1)
    page = F.size(F.split(F.substring(F.col(text), F.lit(1), F.col("at") + 1), "\f"))
    return d.select(*keep, F.col("q").alias("quote"), "at", page.alias("page"), fn.section_at(text, "at").alias("section"))


def applicable_extractors(texts: DataFrame, extractors: list[dict]) -> DataFrame:
    """Text by extractor, where the media type fits and all required JSON keys are there. Extractors are a bounded list."""
    x = F.from_json(F.lit(__import__("json").dumps(extractors)), "array<struct<extractor_id:string,media_type:string,required:array<string>>>")
    d = texts.withColumn("x", F.explode(x)).where("media_type = x.media_type")
    keys = F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>"))
    ok = F.size(F.coalesce("x.required", F.array().cast("array<string>"))) == 0
    return d.where(ok | rel.is_subset(F.col("x.required"), keys)).select(*texts.columns, "x.extractor_id")


def plan_extractions(texts: DataFrame, contracts: DataFrame, done: DataFrame) -> DataFrame:
    """CREATED or REUSED per text, contract and slot."""
    j = texts.join(contracts, "media_type").join(done.select("text_id", "contract_hash", "slot").distinct().withColumn("_d", F.lit(True)), ["text_id", "contract_hash", "slot"], "left")
    return j.withColumn("usage", F.when(F.col("_d"), "REUSED").otherwise("CREATED")).drop("_d")


def evidence_items(obs: DataFrame) -> DataFrame:
    keys = ["extraction_id", "fetch_id", "text_id", "locator_hash"]
    d = rel.one_per_key(obs.withColumn("locator_hash", fn.fingerprint("start", "end", "quote")), keys)
    return d.withColumn("evidence_id", F.sha2(F.concat_ws("|", *keys), 256))


def evidence_provenance(obs: DataFrame, fetches: DataFrame, derivations: DataFrame) -> DataFrame:
    """Observations whose lineage does not agree on a body, with why: the cited ``body_id`` must be the one that the retrieval
    carried (FETCH_BODY) and the one that the text derives from (DERIVATION_BODY). An unknown retrieval or derivation agrees
    with nothing, nor does a null body. Rows of fetches (fetch_id, body_id) and derivations (text_id, body_id) are by key."""
    f = fetches.select("fetch_id", F.col("body_id").alias("_fetched"))
    d = derivations.select("text_id", F.col("body_id").alias("_derived"))
    j = obs.join(f, "fetch_id", "left").join(d, "text_id", "left")
    agrees = lambda c: F.coalesce(F.col(c) == F.col("body_id"), F.lit(False))
    why = F.array_compact(F.array(F.when(~agrees("_fetched"), "FETCH_BODY"), F.when(~agrees("_derived"), "DERIVATION_BODY")))
    return j.withColumn("violation", F.explode(why)).select(*obs.columns, "violation")


def route(obs: DataFrame, threshold: float = 0.60) -> DataFrame:
    """REVIEW for sampled or weak observations, ASSERT for the rest."""
    return obs.withColumn("route", F.when(F.coalesce("sampled", F.lit(False)), "REVIEW_SAMPLED").when(F.col("extractor_confidence") < threshold, "REVIEW_WEAK").otherwise("ASSERT"))


def resolve_locators(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """EXACT where the quote stands at its place, REHOMED where it stands elsewhere, ROTTED (weight 0.5) where not."""
    j = evidence.join(texts.select("text_id", F.col("text").alias("_t")), "text_id", "left")
    here = F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote")
    at = F.call_function("locate", F.col("quote"), F.col("_t"))
    state = F.when(F.coalesce(here, F.lit(False)), "EXACT").when(F.coalesce(at, F.lit(0)) > 0, "REHOMED").otherwise("ROTTED")
    return j.withColumns({"resolution": state, "weight": F.when(state == "ROTTED", 0.5).otherwise(1.0), "start": F.when(state == "REHOMED", at - 1).otherwise(F.col("start"))}).drop("_t")


# --- witnesses and claims (RS19-RS27) ---------------------------------------------------------------------------------


def claims_from_observations(obs: DataFrame, by: list[str] = ("company_id",)) -> DataFrame:
    """Assertions: observations grouped by what they say, with a fingerprint that leaves out who extracted them."""
    keys = [*by, "attribute_key", "value_json", "unit", "fact_type"]
    g = obs.groupBy(*keys).agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.array_sort(F.collect_set(F.struct("source_id", "artifact_id"))).alias("origins"))
    return g.withColumn("claim_id", fn.assertion_fingerprint(*keys, origins="origins"))


def link_evidence(links: DataFrame, publishers: dict[str, str], trust: dict[str, float] = cfg.TRUST) -> DataFrame:
    c = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in publishers.items() for x in kv]), F.col("domain")), F.lit("UNKNOWN"))
    return links.withColumn("source_class", c).withColumn("trust", fn.lookup("source_class", trust, trust["UNKNOWN"]))


def score_claims(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Confidence of each claim from the trust of its links and its independent witnesses."""
    top = links.groupBy("claim_id").agg(F.max("trust").alias("trust"))
    wit = independent_witnesses(links, ["claim_id"])
    j = claims.join(top, "claim_id", "left").join(wit, "claim_id", "left")
    return j.withColumn("confidence", fn.claim_confidence("fact_type", F.coalesce("trust", F.lit(0.40)), F.coalesce("witnesses", F.lit(0)), F.coalesce("inferred", F.lit(False))))


@dataclass(frozen=True)
class InferenceRule:
    """All of ``reads`` (attribute, SQL condition on value_json) hold for a company, so ``writes`` is concluded."""

    rule_id: str
    reads: tuple[tuple[str, str], ...]
    writes: str
    conclusion: str


INFERENCES = [InferenceRule("dispatch", (("emergency_service", "get_json_object(value_json, '$.value') = 'true'"), ("branch_count", "cast(get_json_object(value_json, '$.min') as int) > 1")), "dispatch_coordination", '{"value":"LIKELY_REQUIRED"}')]


def infer(claims: DataFrame, rules: list[InferenceRule]) -> DataFrame:
    out = None
    for r in rules:
        hit = None
        for attribute, condition in r.reads:
            d = claims.where((F.col("attribute_key") == attribute) & F.expr(condition)).groupBy("company_id").agg(F.collect_set("claim_id").alias("ids"))
            hit = d if hit is None else hit.join(d.withColumnRenamed("ids", "more"), "company_id").select("company_id", F.array_union("ids", "more").alias("ids"))
        d = hit.select("company_id", F.lit(r.writes).alias("attribute_key"), F.lit(r.conclusion).alias("value_json"), F.lit("INFERENCE").alias("fact_type"), F.lit(r.rule_id).alias("rule_id"), F.array_sort("ids").alias("inherits"))
        out = d if out is None else out.unionByName(d)
    return out


def company_profile(claims: DataFrame, set_attributes: list[str] = ()) -> DataFrame:
    """Per company and attribute: envelope, best claim, contradiction, witnesses and claim ids."""
    n = lambda k: F.get_json_object("value_json", f"$.{k}").cast("double")
    order = [fn.lookup("fact_type", {k: float(v) for k, v in cfg.FACT_RANK_RESEARCH.items()}, 9.0), F.desc_nulls_last("trust"), F.asc_nulls_last(F.col("observed_at").isNull().cast("int")), F.desc_nulls_last("observed_at"), F.col("claim_id")]
    best = rel.first_per_key(claims, ["company_id", "attribute_key"], order).select("company_id", "attribute_key", F.col("value_json").alias("best_value"), "fact_type")
    g = claims.groupBy("company_id", "attribute_key").agg(F.min(n("min")).alias("min"), F.max(n("max")).alias("max"), F.array_sort(F.collect_set("value_json")).alias("values"), F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))
    wit = independent_witnesses(claims, ["company_id", "attribute_key"])
    bad = (F.size("values") > 1) & ~F.col("attribute_key").isin(list(set_attributes))
    return g.withColumn("contradicted", bad).join(best, ["company_id", "attribute_key"]).join(wit, ["company_id", "attribute_key"], "left")


def plan_profile(questions: DataFrame, profile: DataFrame) -> DataFrame:
    """Coverage of required attributes per question, with mean confidence of those present and the rate contradicted."""
    j = questions.join(profile.select("company_id", "attribute_key", "confidence", F.col("contradicted").cast("int").alias("bad")), ["company_id", "attribute_key"], "left")
    has = F.col("confidence").isNotNull()
    return j.groupBy("run_id").agg(F.round(F.avg(has.cast("int")), 4).alias("coverage"), F.round(F.avg("confidence"), 4).alias("confidence"), F.coalesce(F.round(F.avg("bad"), 4), F.lit(0.0)).alias("contradiction_rate"))


# --- gaps, staleness, review, retention (RS28-RS45) -------------------------------------------------------------------


def unreachable(pursued: DataFrame, fetches: DataFrame) -> DataFrame:
    """(company, attribute) whose every pursued source has an outcome and none but permanent failures."""
    f = fetches.groupBy("source_id").agg(F.bool_and(F.col("outcome").isin(cfg.PERMANENT_FAILURES)).alias("dead"))
    j = pursued.join(f, "source_id", "left")
    return rel.every(j, ["company_id", "attribute_key"], F.coalesce("dead", F.lit(False))).where("all").select("company_id", "attribute_key")


def raise_gaps(targets: DataFrame, profile: DataFrame, weak: DataFrame, dead: DataFrame, stale: DataFrame) -> DataFrame:
    """Of a target that no claim evidences exactly one of UNRESOLVABLE_SOURCE, INSUFFICIENT_EVIDENCE (observed, but too
    weak) and NO_EVIDENCE; beside it STALE_EVIDENCE, and CONTRADICTED for one that is held."""
    k = ["company_id", "attribute_key"]
    mark = lambda d, name: d.select(*k).distinct().withColumn(name, F.lit(True))
    j = targets.join(profile.select(*k, F.lit(True).alias("_held"), "contradicted"), k, "left")
    for d, name in ((weak, "_weak"), (dead, "_dead"), (stale, "_stale")):
        j = j.join(mark(d, name), k, "left")
    main = F.when(F.col("_held").isNotNull(), None).when(F.col("_dead"), "UNRESOLVABLE_SOURCE").when(F.col("_weak"), "INSUFFICIENT_EVIDENCE").otherwise("NO_EVIDENCE")
    kinds = F.array_compact(F.array(main, F.when(F.col("_stale"), "STALE_EVIDENCE"), F.when(F.coalesce("contradicted", F.lit(False)), "CONTRADICTED")))
    return j.withColumn("gap_kind", F.explode(kinds)).select(*k, "gap_kind")


def current_status(events: DataFrame, key: str, rank: dict[str, int], kind: str = "event_kind", at: str = "occurred_at", id_col: str = "event_id") -> DataFrame:
    """The latest event of each key; at one instant the one further on in the lifecycle."""
    r = fn.lookup(kind, {k: float(v) for k, v in rank.items()}, -1.0)
    return rel.first_per_key(events, [key], [F.desc(at), F.desc(r), F.desc(id_col)])


def gap_view(gaps: DataFrame, events: DataFrame) -> DataFrame:
    """Status, attempts, last attempt of each gap; the events are aggregated before they are joined."""
    s = current_status(events, "gap_id", cfg.GAP_RANK).select("gap_id", F.col("event_kind").alias("status"))
    g = events.groupBy("gap_id").agg(F.count_if(F.col("event_kind") == "ATTEMPTED").alias("attempts"), F.countDistinct(F.when(F.col("event_kind") == "ATTEMPTED", F.to_date("occurred_at"))).alias("attempt_days"), F.max(F.when(F.col("event_kind") == "ATTEMPTED", F.col("occurred_at"))).alias("last_attempt"))
    return gaps.join(s, "gap_id", "left").join(g, "gap_id", "left")


def company_staleness(claims: DataFrame, horizons: DataFrame, as_of: Column) -> DataFrame:
    """The freshest verdict per company and attribute."""
    d = claims.join(horizons, "attribute_key", "left").withColumn("state", fn.staleness("observed_at", "staleness_days", as_of))
    order = fn.lookup("state", {"FRESH": 0.0, "AGING": 1.0, "UNKNOWN_AGE": 2.0, "STALE": 3.0}, 9.0)
    return rel.first_per_key(d, ["company_id", "attribute_key"], [order, F.desc_nulls_last("observed_at"), F.col("claim_id")]).select("company_id", "attribute_key", "state", "observed_at")


def apply_reviews(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every review with ``operative``: the first of a candidate; later ones with another decision are dissent."""
    r = rel.mark_operative(reviews, ["candidate_id"], [F.col("decided_at"), F.col("review_id")])
    first = F.max(F.when(F.col("operative"), F.col("decision"))).over(Window.partitionBy("candidate_id"))
    return candidates.join(r.withColumn("dissent", ~F.col("operative") & (F.col("decision") != first)), "candidate_id")


def confirmed(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    return apply_reviews(candidates, reviews).where("operative and decision = 'CONFIRM'")


def reconcile(gaps: DataFrame, claims: DataFrame) -> DataFrame:
    """RESOLVED events for open INSUFFICIENT_EVIDENCE gaps that a confirmed claim answers."""
    k = ["company_id", "attribute_key"]
    c = claims.groupBy(*k).agg(F.min("claim_id").alias("resolving_claim_id"))
    return gaps.where("gap_kind = 'INSUFFICIENT_EVIDENCE' and status in ('RAISED', 'ATTEMPTED')").join(c, k).select("gap_id", F.lit("RESOLVED").alias("event_kind"), "resolving_claim_id")


def raise_signals(new: DataFrame, occurrences: DataFrame, events: DataFrame) -> DataFrame:
    """A new occurrence of a concern where none is open, numbered on from the last."""
    c = rel.one_per_key(new.withColumn("signal_id", fn.signal_fingerprint("company_id", "concern")), ["signal_id"])
    now = current_status(events, "occurrence_id", cfg.SIGNAL_RANK).select("occurrence_id", F.col("event_kind").alias("status"))
    o = occurrences.join(now, "occurrence_id", "left")
    open_ = o.where("status in ('OPEN', 'ACKNOWLEDGED')").select("signal_id").distinct()
    last = o.groupBy("signal_id").agg(F.max("number").alias("number"), F.max_by("occurrence_id", "number").alias("supersedes"))
    return c.join(open_, "signal_id", "left_anti").join(last, "signal_id", "left").withColumn("number", F.coalesce("number", F.lit(0)) + 1)


def evidence_view(companies: DataFrame, attributes: list[str], claims: DataFrame, links: DataFrame) -> DataFrame:
    """Every company by every attribute of a bounded list; claims without evidence do not show, unknown is NOT_AVAILABLE."""
    slots = companies.select("company_id", F.explode(F.array(*[F.lit(a) for a in attributes])).alias("attribute_key"))
    c = claims.join(links.select("claim_id").distinct(), "claim_id", "left_semi").select("company_id", "attribute_key", "value_json", "fact_type", "confidence", "claim_id")
    return slots.join(c, ["company_id", "attribute_key"], "left").withColumn("availability", F.when(F.col("claim_id").isNull(), "NOT_AVAILABLE").otherwise("OBSERVED"))


def retention_plan(bodies: DataFrame, fetches: DataFrame, as_of: Column) -> DataFrame:
    """Bodies past the cut-off of their declared type, which is that of the lowest fetch."""
    t = fetches.groupBy("body_sha256").agg(F.min_by("declared_type", "fetch_id").alias("media_type"), F.max("fetched_at").alias("last_fetched"))
    return bodies.where("retention_state = 'RETAINED'").join(t, "body_sha256").withColumn("cutoff", fn.retention_cutoff("media_type", as_of)).where(F.to_date("last_fetched") < F.col("cutoff"))


def questions(runs: DataFrame) -> DataFrame:
    """One question per plan, however often it was asked; ``conflict`` where an attempt is open."""
    d = runs.withColumn("plan_hash", fn.plan_hash("company_id", "vertical", targets="targets"))
    return d.groupBy("plan_hash").agg(F.min("run_id").alias("run_id"), F.count(F.lit(1)).alias("asked"), F.bool_or(F.coalesce("attempt_open", F.lit(False))).alias("conflict"))


def run_report(fetches: DataFrame, gaps: DataFrame) -> DataFrame:
    f = rel.counts_by(fetches, "outcome").select(F.lit("fetch").alias("part"), F.col("outcome").alias("kind"), "n")
    return f.union(rel.counts_by(gaps, "gap_kind").select(F.lit("gap"), "gap_kind", "n"))


def claim_list(claims: DataFrame, links: DataFrame) -> DataFrame:
    g = links.groupBy("claim_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    return claims.join(g, "claim_id", "left")


def source_history(fetches: DataFrame, discoveries: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """What happened to each source, in order: (source_id, part, place, ref_id, other_id, at).

    ``fetches`` has source_id, fetch_id, fetched_at; ``discoveries`` source_id, discovery_id, discovered_at; ``edges`` edge_id,
    from_id, to_id, observed_at. Retrievals come newest first, discoveries and edges oldest first, ties by id; an edge stands
    with both of its ends (OUT and IN), one from a source to itself once (OUT). ``sources`` (source_id) narrows the history.
    """
    rows = [
        fetches.select("source_id", F.lit("RETRIEVAL").alias("part"), F.col("fetch_id").alias("ref_id"), F.lit(None).cast(dict(edges.dtypes)["to_id"]).alias("other_id"), F.col("fetched_at").alias("at")),
        discoveries.select("source_id", F.lit("DISCOVERY"), "discovery_id", F.lit(None), "discovered_at"),
        edges.select("from_id", F.lit("OUT"), "edge_id", "to_id", "observed_at"),
        edges.where("not from_id <=> to_id").select("to_id", F.lit("IN"), "edge_id", "from_id", "observed_at"),
    ]
    d = reduce(DataFrame.union, rows).where("source_id is not null")
    if sources is not None:
        d = d.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    newest = F.when(F.col("part") == "RETRIEVAL", F.col("at"))
    order = Window.partitionBy("source_id", "part").orderBy(newest.desc(), "at", "ref_id", "other_id")
    return d.withColumn("place", F.row_number().over(order))


def lineage_down(derivations: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, artifact_id, depth): all that was derived from each root, at any number of steps, over a graph in which an
    artifact may have several parents; depth is the least. ``derivations`` has parent_id and child_id, ``roots`` root_id.

    Each level asks only for what no level before has, so cycles end; levels are staged, and there is no bound on their number.
    The derivations are shuffled once, into buckets by parent, and not once per level; repeated ones meet in the level they lead to.
    """
    edges = derivations.where("parent_id is not null and child_id is not null").select("parent_id", "child_id")
    edges = io.bucketed(edges, "derivations", rel.parts(edges, share=8), "parent_id")
    try:
        seen = level = io.staged(roots.where("root_id is not null").select("root_id", F.col("root_id").alias("artifact_id"), F.lit(0).alias("depth")).distinct(), "lineage")
        depth = 0
        while not level.isEmpty():
            depth += 1
            nxt = level.select("root_id", F.col("artifact_id").alias("parent_id")).join(edges, "parent_id").select("root_id", F.col("child_id").alias("artifact_id")).distinct()
            level = io.staged(nxt.join(seen.select("root_id", "artifact_id"), ["root_id", "artifact_id"], "left_anti").withColumn("depth", F.lit(depth)), "lineage")
            seen = seen.unionByName(level)
    finally:
        io.discard(edges)
    return seen
