"""More registered queries: sinks, validations, sets, read models, review and retention views."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import columns as fn
from attesta.functions import config as cfg
from attesta.operators import relational as rel
from attesta.operators import validate as val
from attesta.plans import entities as ent
from attesta.plans import research as res
from attesta.plans import scoring as sc
from attesta.plans.catalog import _CLAIMS, _DOM, _LIFE, _LINK, _LOC, _REC, _TEXT, lifecycle, page_claims, provider_records, query, web_records
from attesta.sources import io

# --- sinks ------------------------------------------------------------------------------------------------------------


@query("snk01_append", "select user_id, event_id, event_type from events where user_id % 3 <> 0 qualify row_number() over (partition by user_id order by event_id) = 1")
def _(t):
    e = t("events").select("user_id", "event_id", "event_type")
    return io.append_absent(e, e.where("user_id % 3 = 0"), ["user_id"], [F.col("event_id")])


@query("snk03_upsert", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def _(t):
    o = t("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return io.upsert_latest(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("snk04_prune", "select doc_id, case when doc_id % 3 = 0 then null else lang end payload, case when doc_id % 3 = 0 then 'PRUNED' else 'RETAINED' end retention_state, case when doc_id % 3 = 0 then '2024-01-01' end pruned_at from documents")
def _(t):
    d = t("documents").select("doc_id", F.col("lang").alias("payload"), F.lit("RETAINED").alias("retention_state"), F.lit(None).cast("string").alias("pruned_at"))
    return io.apply_prune(d, d.where("doc_id % 3 = 0"), "doc_id", "payload", F.lit("2024-01-01"))


# --- validation -------------------------------------------------------------------------------------------------------


@query("val03_universe", "select count(*) + 1 n, 'universe' violation from (select n_nationkey from nation union all select r_regionkey from region)")
def _(t):
    return val.universe_violations(t("nation"), t("region"), 7)


@query("val04_bounds", "with x as (select l_orderkey, l_linenumber, l_partkey, l_returnflag component, l_quantity value from lineitem) select l_orderkey, l_linenumber, l_partkey, case when component = 'R' then 'unknown_component' else 'above_weight' end violation from x where component = 'R' or value > case component when 'A' then 20 else 30 end + 1e-6")
def _(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("component"), F.col("l_quantity").alias("value"))
    return val.bound_violations(d, {"A": 20.0, "N": 30.0}).select("l_orderkey", "l_linenumber", "l_partkey", "violation")


@query("val08_warnings", "select doc_id, unnest(list_filter([case when quality is null then 'absent:quality' end, case when lang = 'de' then 'low_confidence' end], lambda x: x is not null)) violation from documents left join labels using (doc_id)")
def _(t):
    d = t("documents").join(t("labels"), "doc_id", "left").withColumn("label", F.when(F.col("lang") == "de", "LOW").otherwise("HIGH"))
    return val.warnings(d, ["quality"], "label").select("doc_id", "violation")


@query(
    "val10_registry",
    """with x as (select event_id, case event_type when 'view' then 'range' when 'click' then 'scalar' else 'none' end a, event_id % 10 lo, event_id % 7 hi, case when event_id % 3 = 0 then 'FACT' else 'PROXY' end f from events)
select event_id, unnest(list_filter([case when a = 'none' then 'unknown_attribute' end, case when a = 'range' and f <> 'FACT' then 'fact_type' end, case when a = 'scalar' then 'scalar_without_value' end, case when a = 'range' and lo > hi then 'range_order' end], lambda v: v is not null)) violation from x""",
)
def _(t):
    k, e = F.col("event_id"), F.col("event_type")
    c = t("events").select(k, F.when(e == "view", "range").when(e == "click", "scalar").otherwise("none").alias("attribute_key"), F.to_json(F.struct((k % 10).alias("min"), (k % 7).alias("max"))).alias("value_json"), F.when(k % 3 == 0, "FACT").otherwise("PROXY").alias("fact_type"))
    reg = c.sparkSession.createDataFrame([("range", "RANGE", ["FACT"]), ("scalar", "SCALAR", ["FACT", "PROXY"])], "attribute_key string, kind string, fact_types array<string>")
    return val.registry_violations(c, reg).select("event_id", "violation")


@query("val11_intervals", "select o_orderkey, 'interval' violation from orders where o_orderdate >= timestamp '1996-01-01' union all select o_orderkey, 'assertion' from orders where o_orderstatus = 'P'")
def _(t):
    d = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("valid_from"), F.to_date(F.lit("1996-01-01")).alias("valid_to"), F.when(F.col("o_orderstatus") == "P", "MAYBE").otherwise("ASSERTS").alias("assertion"))
    return val.interval_violations(d).select("o_orderkey", "violation")


@query("val15_unsupported", "select doc_id claim_id, 'unsupported' violation from documents where lang = 'en' and doc_id not in (select doc_id from labels)")
def _(t):
    c = t("documents").select(F.col("doc_id").alias("claim_id"), (F.col("lang") == "en").alias("requires_evidence"))
    return val.unsupported_claims(c, t("labels").withColumnRenamed("doc_id", "claim_id")).select("claim_id", "violation")


@query("val16_fetch_pairs", "with x as (select event_id, case event_type when 'view' then 'OK' when 'click' then 'NOT_MODIFIED' else 'GONE' end o, event_id % 2 = 0 b from events) select event_id, case when o = 'OK' then 'ok_without_body' when o = 'NOT_MODIFIED' then 'not_modified_without_body' end violation from x where o in ('OK', 'NOT_MODIFIED') and not b union all select event_id, 'body_on_failure' from x where o <> 'OK' and b")
def _(t):
    e, b = F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "b")
    d = t("events").select("event_id", F.when(e == "view", "OK").when(e == "click", "NOT_MODIFIED").otherwise("GONE").alias("outcome"), b.alias("body_sha256"), b.alias("validated_body"))
    return val.fetch_violations(d).select("event_id", "violation")


@query("val18_divergence", """with k as (select user_id claim_id, count(distinct event_type) w, max(value) > 19 odd from events group by 1), d as (select *, round(least(1, 0.80 * 0.75 * case least(w, 4) when 0 then 1.0 when 1 then 1.0 when 2 then 1.10 when 3 then 1.16 else 1.20 end), 4) c from k) select claim_id, 'confidence' violation from d where odd and abs(c - 0.5) > 1e-9""")
def _(t):
    """Stored confidences against those that the links give: the ones of users with a high value were written by hand."""
    e = t("events").select(F.col("user_id").alias("claim_id"), F.col("event_type").alias("publisher"), F.col("event_type").alias("document"), F.lit("boards.example").alias("domain"))
    claims = t("events").groupBy(F.col("user_id").alias("claim_id")).agg((F.max("value") > 19).alias("odd")).withColumns({"fact_type": F.lit("ESTIMATE"), "inferred": F.lit(False)})
    derived = res.score_claims(claims, res.link_evidence(e, {"boards.example": "JOB_BOARD"}))
    stored = derived.select("claim_id", F.when(F.col("odd"), 0.5).otherwise(F.col("confidence")).alias("confidence"))
    return val.confidence_divergence(stored, derived).select("claim_id", "violation")


# --- joins, aggregates, windows, sets ---------------------------------------------------------------------------------


@query("jn02_optional", "select doc_id, quality, toxic from documents left join labels using (doc_id)")
def _(t):
    return rel.with_optional(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("jn12_provenance", "select o_orderkey, count(distinct l_suppkey) owners from orders left join lineitem on l_orderkey = o_orderkey group by 1 having count(distinct l_suppkey) <> 1")
def _(t):
    walk = t("orders").join(rel.spread(t("lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rel.provenance_violations(walk, "o_orderkey", "l_suppkey")


@query("ag13_claim_dates", "select o_custkey, max(o_orderdate) last_seen, min(o_orderdate) first_seen, max(l_shipdate) last_retrieved from orders join lineitem on l_orderkey = o_orderkey group by 1")
def _(t):
    j = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    seen = rel.envelope(j, ["o_custkey"], "o_orderdate", "o_orderdate").select("o_custkey", F.col("min").alias("first_seen"), F.col("max").alias("last_seen"))
    return seen.join(rel.envelope(j, ["o_custkey"], "l_shipdate", "l_shipdate").select("o_custkey", F.col("max").alias("last_retrieved")), "o_custkey")


@query("ag17_provenance", "select o_orderpriority source, count(*) n, array_to_string(list_sort(list(distinct o_orderstatus || ':' || year(o_orderdate))), ',') provenance from orders group by 1")
def _(t):
    o = t("orders").select(F.col("o_orderpriority").alias("source"), F.concat_ws(":", "o_orderstatus", F.year("o_orderdate")).alias("origin"))
    return rel.counts_by(o, "source").join(rel.scalar_envelope(o, ["source"], "origin"), "source").select("source", "n", F.array_join("values", ",").alias("provenance"))


@query("ag22_assertions", "select user_id company_id, event_type attribute_key, props::json->>'$.k' as \"value\", count(distinct event_id) n_evidence from events group by all")
def _(t):
    o = t("events").select(F.col("user_id").alias("company_id"), F.col("event_type").alias("attribute_key"), F.get_json_object("props", "$.k").alias("value_json"), F.lit("COUNT").alias("unit"), F.lit("FACT").alias("fact_type"), F.col("event_id").alias("evidence_id"), F.col("event_id").alias("source_id"), F.col("event_id").alias("artifact_id"))
    return res.claims_from_observations(o).select("company_id", "attribute_key", F.col("value_json").alias("value"), F.size("evidence_ids").cast("long").alias("n_evidence"))


@query("wn12_numbered", "select event_id, user_id, row_number() over w::int number, lag(event_id) over w supersedes from events window w as (partition by user_id order by ts, event_id)")
def _(t):
    return rel.number_in_group(t("events").select("event_id", "user_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_id").drop("ts")


@query("wn15_last_end", "select o_custkey, arg_max(e, o_orderkey) filter (e is not null) ended from (select *, case when o_orderkey % 3 = 0 then o_orderdate::date end e from orders) group by 1")
def _(t):
    d = t("orders").withColumn("ended", F.when(F.col("o_orderkey") % 3 == 0, F.to_date("o_orderdate")))
    return rel.last_end(d, ["o_custkey"], "ended", "o_orderkey")


@query("tk03_top_deltas", "select c_custkey market_key, round(abs(c_acctbal - c_nationkey), 6) delta from customer order by 2 desc, 1 limit 10")
def _(t):
    d = t("customer").select(F.col("c_custkey").alias("market_key"), F.round(F.abs(F.col("c_acctbal") - F.col("c_nationkey")), 6).alias("delta"))
    return rel.top_deltas(d)


@query("so01_claim_union", "select o_custkey company_id, o_orderkey claim_id, case o_orderpriority when '1-URGENT' then 0.8 else 0.5 end::double trust, false human from orders where o_orderstatus = 'F' union all select c_custkey, -c_custkey, 1.0, true from customer where c_acctbal > 5000")
def _(t):
    """Claims through their records' heads, and direct claims of people."""
    o = t("orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("provider"), F.lit(None).cast("long").alias("company_id"))
    heads = t("orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("company_id"), F.when(F.col("o_orderstatus") == "F", "MATCHED").otherwise("AMBIGUOUS").alias("decision"))
    trust = o.sparkSession.createDataFrame([("1-URGENT", 0.8)], "provider string, trust double")
    direct = t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("company_id"), (-F.col("c_custkey")).alias("claim_id"))
    return ent.effective_claims(o, heads, trust, direct).select("company_id", "claim_id", "trust", "human")


@query("so05_subsets", "select l_orderkey, len(list_filter(list(distinct l_returnflag), lambda x: x not in ('A', 'N'))) = 0 covered from lineitem group by 1")
def _(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"))
    return g.select("l_orderkey", rel.is_subset(F.col("s"), F.array(F.lit("A"), F.lit("N"))).alias("covered"))


# --- functions --------------------------------------------------------------------------------------------------------


@query("fn08_countries", "select c_custkey, n_regionkey country_key from customer left join (select lower(n_name) a, min(n_regionkey) n_regionkey from nation where n_nationkey < 20 group by 1) x on x.a = (select lower(n_name) from nation where n_nationkey = c_nationkey)")
def _(t):
    n = t("nation")
    c = t("customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.upper("n_name").alias("name")), "c_nationkey").select("c_custkey", "name")
    return fn.resolve_country(c, "name", n.where("n_nationkey < 20").select(F.col("n_name").alias("alias"), F.col("n_regionkey").alias("country_key"))).select("c_custkey", "country_key")


@query("fn09_verticals", "select p_partkey, case when v = 'large' then 'v1' when v like '%economy%' then 'v2' when v like '%promo%' then 'v3' when v like '%large%' then 'v1' end vertical from (select p_partkey, lower(p_type || case when p_partkey % 2 = 0 then ' tools' else '' end) v from part)")
def _(t):
    label = F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, " tools").otherwise(""))
    return t("part").select("p_partkey", fn.match_vertical(label, {"large": "v1", "economy": "v2", "promo": "v3"}).alias("vertical"))


@query("fn10_lists", "select o_orderkey, array_to_string(list_filter(list_transform(string_split(o_orderpriority || '; ;' || o_orderstatus, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') items, trim(regexp_replace(upper(o_orderpriority), '[ ]+', ' ', 'g')) concern from orders")
def _(t):
    return t("orders").select("o_orderkey", F.array_join(fn.split_list(F.concat_ws("; ;", "o_orderpriority", "o_orderstatus")), "|").alias("items"), fn.normalize_concern("o_orderpriority").alias("concern"))


@query("fn41_explanations", "select l_orderkey, l_linenumber, l_partkey, case when l_discount > 0.05 then printf('%s: not covered, missing %s', l_returnflag, 'a, b') else printf('%s: %.4f of %.1f', l_returnflag, l_quantity, 50.0) end as \"text\" from lineitem")
def _(t):
    earned = F.when(F.col("l_discount") <= 0.05, F.col("l_quantity"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fn.explain("l_returnflag", earned, F.lit(50.0), F.array(F.lit("b"), F.lit("a"))).alias("text"))


# --- scoring views ----------------------------------------------------------------------------------------------------


@query("sc01_snapshots", "with x as (select *, md5(o_custkey || '|' || o_orderpriority || '|' || o_orderstatus) d from orders), s as (from x where o_orderdate < '1998-01-01') select o_orderkey, case when d in (select d from s) then 'NOOP' when o_custkey in (select o_custkey from s) then 'CONFLICT' else 'NEW' end status from x where o_orderdate >= '1998-01-01'")
def _(t):
    """Orders of a customer as snapshots of one key: those before 1998 are stored, the later ones come in."""
    o = t("orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("snapshot_key"), F.md5(F.concat_ws("|", "o_custkey", "o_orderpriority", "o_orderstatus")).alias("digest"))
    day = F.lit("1998-01-01").cast("timestamp")
    return sc.classify_snapshots(o.where(F.col("o_orderdate") >= day), o.where(F.col("o_orderdate") < day)).select("o_orderkey", "status")


@query("sc03_growth", "select p_partkey, case when p_size % 4 <> 0 and p_type <> 'PROMO' then p_size::double end as \"value\", case when p_size % 4 <> 0 and p_type <> 'PROMO' then 'OBSERVED' else 'NOT_AVAILABLE' end availability, case when p_size % 3 = 0 then 'YEAR' when p_size % 3 = 1 then 'SNAPSHOT' else 'UNDATED' end granularity from part")
def _(t):
    s = F.col("p_size")
    d = t("part").select("p_partkey", F.when(s % 4 != 0, s.cast("double")).alias("value_pct"), F.when(s % 3 == 0, 2024).alias("year"), F.when(s % 3 == 1, "2023-24").alias("period"), F.when(F.col("p_type") != "PROMO", "ESTIMATE").otherwise("N/D").alias("fact_type"))
    return sc.spending_growth(d).select("p_partkey", "value", "availability", "granularity")


@query("sc04_attribution", "select c_custkey market_key, s source_key, case when c_custkey % 2 = 0 and s = 'a' then 'EXPLICIT' when s = 'b' then 'METRIC_HINT' else 'MARKET_LEVEL' end attribution from customer, (values ('a'), ('b'), ('c')) v(s)")
def _(t):
    o = t("customer").select(F.col("c_custkey").alias("market_key"), F.lit("gdp").alias("metric_key"), F.when(F.col("c_custkey") % 2 == 0, "a").alias("explicit_source"))
    src = o.select("market_key", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("source_key"))
    return sc.attribute_sources(o, src, {"gdp": ["b"]}).select("market_key", "source_key", "attribution")


@query("sc30_market_view", "select c_custkey market_key, array_to_string(list_sort(list(distinct o_orderpriority)), ',') categories, any_value(c_acctbal) score from customer left join orders on o_custkey = c_custkey group by 1")
def _(t):
    m = t("customer").select(F.col("c_custkey").alias("market_key"))
    c = t("orders").select(F.col("o_custkey").alias("market_key"), F.col("o_orderpriority").alias("category"))
    s = t("customer").select(F.col("c_custkey").alias("market_key"), F.col("c_acctbal").alias("score"), F.lit(1).alias("rank"))
    return sc.market_view(m, c, s).select("market_key", F.coalesce(F.array_join("categories", ","), F.lit(None)).alias("categories"), "score")


@query("sc32_latest_run", "select arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) run_id from orders where o_orderstatus = 'F'")
def _(t):
    r = t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("completed_at"))
    return sc.latest_run(r, "F")


# --- entity views -----------------------------------------------------------------------------------------------------


@query("er05_sightings", f"with {_REC} select distinct provider, ext external_id, ch content_hash from r")
def _(t):
    return ent.sightings(provider_records(t)).drop("query_id")


@query("er10_collisions", "select c_nationkey % 7 entity_id, count(distinct lower(c_mktsegment)) names from customer group by 1 having count(distinct lower(c_mktsegment)) > 1")
def _(t):
    d = t("customer").select((F.col("c_nationkey") % 7).alias("entity_id"), F.col("c_mktsegment").alias("legal_name"), F.lit("DERIVED").alias("identity_kind"))
    return ent.collisions(d)


@query("er23_domains", f"with d as (select distinct regexp_extract(html, '(?i)<html[^>]*\\blang=[\"'']([^\"'']+)[\"'']', 1) company_id, {_DOM} as \"domain\" from pages) select company_id, \"domain\", case when row_number() over (partition by \"domain\" order by company_id) > 1 then 'GROUP' else 'IDENTITY' end as \"role\" from d where company_id <> ''")
def _(t):
    """Publishers of a language that claim a page's domain: the first keeps it, the others are demoted."""
    value = F.to_json(F.struct(fn.host_of("url").alias("value")))
    c = t("pages").select(fn.html_language("html").alias("company_id"), F.lit("website_domain").alias("attribute_key"), value.alias("value_json")).where("company_id is not null")
    return ent.project_domains(c)


@query("er32_versions", f"with {_REC} select provider, ext external_id, ch content_hash, 1::bigint n_bodies, count(*) over (partition by ext, ch) n_seen from (select distinct provider, ext, ch from r)")
def _(t):
    r = provider_records(t)
    return ent.version_view(ent.versions(r).select("provider", "external_id", "content_hash"), ent.bodies(r), ent.sightings(r))


def _digest_sql(table, name, columns):
    row = " || '|' || ".join(f"coalesce({c}::varchar, chr(1))" for c in columns)
    return f"select '{name}' as \"table\", count(*) as \"rows\", count(*) || ':' || bit_xor(h) || ':' || sum(h)::bigint digest from (select ('0x' || substr(md5({row}), 1, 8))::bigint h from {table})"


@query("er28_report", _digest_sql("orders", "a", ["o_custkey", "o_orderkey", "o_orderstatus"]) + " union all " + _digest_sql("part", "b", ["p_brand", "p_partkey"]))
def _(t):
    return ent.projection_report({"a": t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "b": t("part").select("p_partkey", "p_brand")})


# --- research views ---------------------------------------------------------------------------------------------------


@query(
    "rs04_expansion",
    f"""with recursive {_LOC}, {_LINK}, o as (select distinct l.locator u, k.locator v from k join pages using (url) join l using (page_id)), e as (select u, v from o union select v, u from o),
w as (select host, min(locator) n, 0 depth from l group by 1 union select w.host, e.v, depth + 1 from w join e on e.u = w.n where depth < 3) select host, n locator, min(depth)::int depth from w group by 1, 2""",
)
def _(t):
    """Links and back links of the stored pages, three steps from the first locator of each host."""
    out = res.extract_links(t("pages")).where("in_scope").select(fn.normalize_locator("url").alias("url"), "locator").distinct()
    links = out.union(out.select("locator", "url")).distinct()
    seeds = res.sources(t("pages").select("url", F.col("page_id").alias("seen_at"))).groupBy(F.col("host").alias("company_id")).agg(F.min("locator").alias("locator"))
    return res.expand(links, seeds, 3).select(F.col("company_id").alias("host"), "locator", "depth")


@query(
    "rs04_pages",
    f"""with recursive {_LOC}, {_LINK}, e as (select distinct l.locator u, k.locator v from k join pages using (url) join l using (page_id)),
w as (select host, min(locator) n, 0 depth from l group by 1 union select w.host, e.v, depth + 1 from w join e on e.u = w.n where depth < 2) select host, n locator, min(depth)::int depth from w group by 1, 2""",
)
def _(t):
    """The links of the stored pages, from the first locator of each host."""
    links = res.extract_links(t("pages")).where("in_scope").select(fn.normalize_locator("url").alias("url"), "locator").distinct()
    seeds = res.sources(t("pages").select("url", F.col("page_id").alias("seen_at"))).groupBy(F.col("host").alias("company_id")).agg(F.min("locator").alias("locator"))
    return res.expand(links, seeds, 2).select(F.col("company_id").alias("host"), "locator", "depth")


@query("rs08_bodies", "with f as (select event_id, user_id, ts, case event_type when 'view' then 'OK' when 'click' then 'NOT_MODIFIED' else 'GONE' end o from events) select event_id, case when o in ('OK', 'NOT_MODIFIED') then last_value(case when o = 'OK' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) end body_ref from f")
def _(t):
    e = F.col("event_type")
    f = t("events").select(F.col("event_id").alias("fetch_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("fetched_at"), F.when(e == "view", "OK").when(e == "click", "NOT_MODIFIED").otherwise("GONE").alias("outcome"), F.when(e == "view", F.col("event_id")).alias("body_sha256"))
    return res.web_bodies(f).select(F.col("fetch_id").alias("event_id"), "body_ref")


@query("rs11_texts", f"with a as (select distinct {_TEXT} x from pages) select sha256(x) artifact_id, 1 redaction_version, sha256(regexp_replace(x, '{fn.EMAIL}', '[REDACTED_EMAIL]', 'g')) text_id from a union all select sha256(x), 2, sha256(regexp_replace(regexp_replace(x, '{fn.EMAIL}', '[REDACTED_EMAIL]', 'g'), '{fn.PHONE}', '[REDACTED_PHONE]', 'g')) from a")
def _(t):
    b = t("pages").select("html", F.sha2("html", 256).alias("body_sha256")).dropDuplicates(["body_sha256"])
    a = res.derive_artifacts(b, "html").select("artifact_id", "text").distinct()
    return res.derive_text(a).select("artifact_id", "redaction_version", "text_id")


@query("rs16_extractions", "select doc_id text_id, lang contract_hash, case when doc_id in (select doc_id from labels) then 'REUSED' else 'CREATED' end usage from documents")
def _(t):
    d = t("documents").select(F.col("doc_id").alias("text_id"), F.col("lang").alias("media_type"))
    c = d.select("media_type", F.col("media_type").alias("contract_hash"), F.lit(0).alias("slot")).distinct()
    done = t("labels").select(F.col("doc_id").alias("text_id")).join(d, "text_id").select("text_id", F.col("media_type").alias("contract_hash"), F.lit(0).alias("slot"))
    return res.plan_extractions(d, c, done).select("text_id", "contract_hash", "usage")


@query("rs26_profiles", f"with {_CLAIMS} select company_id, attribute_key, count(distinct v) n_values, count(distinct v) > 1 contradicted, count(*) n_claims from cl group by 1, 2")
def _(t):
    c = page_claims(t).withColumns({"trust": F.lit(0.9), "publisher": F.lit("own"), "document": F.col("record_id")})
    return res.company_profile(c).select("company_id", "attribute_key", F.size("values").cast("long").alias("n_values"), "contradicted", F.size("claim_ids").cast("long").alias("n_claims"))


@query("rs30_unreachable", "with f as (select o_custkey s, bool_and(o_orderstatus in ('F', 'P')) dead from orders group by 1), p as (select distinct c_nationkey c, c_custkey s, c_mktsegment a from customer where c_acctbal > 8500) select c company_id, a attribute_key from p left join f using (s) group by 1, 2 having bool_and(coalesce(dead, false))")
def _(t):
    p = t("customer").where("c_acctbal > 8500").select(F.col("c_nationkey").alias("company_id"), F.col("c_mktsegment").alias("attribute_key"), F.col("c_custkey").alias("source_id"))
    f = t("orders").select(F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderstatus").isin("F", "P"), "GONE").otherwise("OK").alias("outcome"))
    return res.unreachable(p, f)


@query("rs36_reconciled", f"with {_LIFE}, s as (select gap_id, k status from r qualify row_number() over (partition by gap_id order by ts desc, l desc, event_id desc) = 1) select gap_id, 'RESOLVED' event_kind from s where status in ('RAISED', 'ATTEMPTED') and gap_id % 2 = 0")
def _(t):
    s = res.current_status(lifecycle(t), "gap_id", cfg.GAP_RANK).select("gap_id", F.col("event_kind").alias("status"), F.lit("INSUFFICIENT_EVIDENCE").alias("gap_kind"), F.col("gap_id").alias("company_id"), F.lit("a").alias("attribute_key"))
    claims = s.where("gap_id % 2 = 0").select("company_id", "attribute_key", F.col("gap_id").alias("claim_id"))
    return res.reconcile(s, claims).select("gap_id", "event_kind")


@query("rs41_questions", "select o_custkey % 40 company_id, min(o_orderkey) run_id, count(*) asked, bool_or(o_orderstatus = 'P') conflict from orders group by 1, o_orderpriority")
def _(t):
    r = t("orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 40).alias("company_id"), F.col("o_orderpriority").alias("vertical"), F.array(F.lit("b"), F.lit("a")).alias("targets"), (F.col("o_orderstatus") == "P").alias("attempt_open"))
    q = res.questions(r)
    return q.join(r.select("run_id", "company_id"), "run_id").select("company_id", "run_id", "asked", "conflict")


@query("rs42_run_report", "select 'fetch' part, event_type kind, count(*) n from events group by 2 union all select 'gap', o_orderpriority, count(*) from orders group by 2")
def _(t):
    return res.run_report(t("events").select(F.col("event_type").alias("outcome")), t("orders").select(F.col("o_orderpriority").alias("gap_kind")))
