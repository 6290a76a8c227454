"""Registered queries of the read models and of the steps that feed them."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import columns as fn
from attesta.operators import relational as rel
from attesta.operators import validate as val
from attesta.plans import entities as ent
from attesta.plans import readmodels as rm
from attesta.plans import research as res
from attesta.plans import scoring as sc
from attesta.plans.catalog import _COMP_SQL, _SCORE_SQL, ORACLES, contextual, native_scores, observations, query
from attesta.sources import io

# --- listings ---------------------------------------------------------------------------------------------------------


@query("tk02_listing", "select c_custkey market_key, case when c_acctbal > 0 then c_acctbal end score from customer order by coalesce(score, 0) desc, market_key limit 40")
def _(t):
    return rm.listing_order(t("customer").select(F.col("c_custkey").alias("market_key"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("score"))).limit(40)


def candidates(t):
    return t("orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderdate").alias("raised_at"), F.col("o_orderpriority").alias("reason"), F.col("o_orderkey").alias("evidence_id"), F.col("o_orderstatus"))


@query("tk06_queue", "select o_orderkey candidate_id, o_orderdate raised_at from orders where o_orderpriority = '1-URGENT' order by o_orderdate, o_orderkey limit 50")
def _(t):
    return rm.queue_page(candidates(t), 50, reason="1-URGENT").select("candidate_id", "raised_at")


@query("tk07_claims", "select o_orderkey claim_id, o_orderpriority attribute_key from orders order by o_orderpriority, o_orderdate, o_orderkey limit 30 offset 20")
def _(t):
    c = t("orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("attribute_key"), F.col("o_orderdate").alias("created_at"))
    return rm.claim_page(c, 30, 20).select("claim_id", "attribute_key")


@query("rs33_queue", "select o_orderkey candidate_id from orders where o_orderpriority = '2-HIGH' and o_orderstatus <> 'F' and o_orderkey in (select l_orderkey from lineitem where l_suppkey = 3) order by o_orderdate, o_orderkey limit 50")
def _(t):
    c = candidates(t)
    walk = t("lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.col("l_suppkey").alias("company_id"))
    return rm.review_queue(c, c.where("o_orderstatus = 'F'"), walk, 50, company=3, reason="2-HIGH").select("candidate_id")


@query("flt03_ranked", _SCORE_SQL + ", k as (select market_key, case when unranked_reason is null then rank() over (partition by unranked_reason is null order by score desc) end::int as \"rank\" from g) select market_key, \"rank\" from k where \"rank\" is not null")
def _(t):
    return rel.ranked_only(native_scores(t)).select("market_key", "rank")


@query("flt09_applicable", "select p_partkey, p_brand from part where len(list_filter(string_split(case when p_size % 3 = 0 then '' else p_type end, ' '), lambda x: x <> '')) = 0 or list_contains(list_filter(string_split(case when p_size % 3 = 0 then '' else p_type end, ' '), lambda x: x <> ''), 'PROMO')")
def _(t):
    words = F.filter(F.split(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")), " "), lambda x: x != "")
    return t("part").where(fn.is_applicable(words, F.lit("PROMO"))).select("p_partkey", "p_brand")


@query("fn35_contracts", "select doc_id, sha256('{\"extractor\":\"rules\",\"version\":\"3\"}') contract, sha256('{\"f0\":\"' || lang || '\",\"f1\":' || doc_id || '}') assertion from documents")
def _(t):
    return t("documents").select("doc_id", F.lit(fn.contract_hash(version="3", extractor="rules")).alias("contract"), fn.fingerprint("lang", "doc_id").alias("assertion"))


@query("val06_benchmark", "select n_name country, r_name home_market, 'benchmark' violation from nation, region where n_nationkey = 3 and n_regionkey <> r_regionkey")
def _(t):
    n, r = t("nation"), t("region")
    alias = n.select(F.col("n_name").alias("alias"), F.col("n_regionkey").alias("country_key")).union(r.select("r_name", "r_regionkey"))
    return val.benchmark_violations(r.select(F.col("r_name").alias("home_market")), n.where("n_nationkey = 3").select(F.col("n_name").alias("country")), alias).select("country", "home_market", "violation")


# --- imported markets -------------------------------------------------------------------------------------------------


@query(
    "sc05_blocks",
    """with m as (select c_custkey k, lower(c_mktsegment) s, c_nationkey n, c_acctbal b from customer)
select k market_key, 'category' block, s as "value" from m where s in ('building', 'machinery') union all select k, 'unknown', s from m where s not in ('building', 'machinery') union all select k, 'unknown', 'other' from m
union all select k, 'competition', case when n % 2 = 0 then 'LOW' else 'HIGH' end from m where n % 5 <> 0 union all select k, 'size', n || '..' || case when b > 0 then (n + 10)::varchar else '' end from m where n % 3 = 0 union all select k, 'dive', s || '|' || 'x' from m where n % 4 = 0""",
)
def _(t):
    s, n = F.lower("c_mktsegment"), F.col("c_nationkey")
    m = t("customer").select(
        F.col("c_custkey").alias("market_key"), F.array(s, F.lit("other")).alias("market_categories"), F.when(n % 5 != 0, F.struct(F.when(n % 2 == 0, "LOW").otherwise("HIGH").alias("level"))).alias("competition"),
        F.when(n % 3 == 0, F.struct(F.lit("ESTIMATE").alias("fact_type"), F.struct(n.alias("min"), F.when(F.col("c_acctbal") > 0, n + 10).alias("max")).alias("tam"))).alias("tam_sam_som"),
        F.when(n % 4 == 0, F.struct(F.concat(s, F.lit("; x ;")).alias("priority_verticals"), F.lit("").alias("priority_geographies"), F.lit("a").alias("common_buyers"), F.lit("email").alias("recommended_channel"))).alias("deep_dive"),
    )
    b = rm.normalise_blocks(m, ["building", "machinery"])
    row = lambda d, name, value: d.select("market_key", F.lit(name).alias("block"), value.alias("value"))
    out = row(b["categories"], "category", F.col("category_key")).union(row(b["unknown_categories"], "unknown", F.col("category_key"))).union(row(b["competition"], "competition", F.col("level")))
    size = F.concat_ws("..", F.col("tam_min").cast("string"), F.coalesce(F.col("tam_max").cast("string"), F.lit("")))
    return out.union(row(b["sizes"], "size", size)).union(row(b["deep_dives"], "dive", F.array_join("priority_verticals", "|")))


def _reference(t):
    p = F.col("o_orderpriority")
    c = t("orders").groupBy(F.col("o_custkey").alias("market_key"), F.when(p == "1-URGENT", "a").when(p == "2-HIGH", "b").otherwise("c").alias("component")).agg(F.round(F.max("o_totalprice") / 100000, 4).alias("value"))
    m = t("customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("market_key"), F.round("c_acctbal", 2).alias("score"), F.col("c_nationkey").cast("int").alias("rank"))
    return rm.reference_run(m, c, t("customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("market_key"), F.round("c_acctbal", 2).alias("score")), {"a": 20.0, "b": 30.0, "c": 50.0})


_REF = """with c as (select o_custkey market_key, case o_orderpriority when '1-URGENT' then 'a' when '2-HIGH' then 'b' else 'c' end component, round(max(o_totalprice) / 100000, 4) v from orders group by 1, 2),
s as (select c_custkey market_key, round(c_acctbal, 2) score, c_nationkey::int as "rank", coalesce((select sum(v) from c where market_key = c_custkey), 0) cs, c_custkey % 10 = 0 u from customer)"""


@query("sc06_reference", _REF + " select market_key, score, case when not u then \"rank\" end as \"rank\", case when u then 0.0 else 1.0 end::double coverage, case when not u then round(cs, 6) end::double component_sum from s")
def _(t):
    return _reference(t)["scores"].withColumn("component_sum", F.round("component_sum", 6))


@query("sc06_delta", _REF + " select round(max(abs(cs - score)), 6) max_delta from s where not u")
def _(t):
    return _reference(t)["delta"].select(F.round("max_delta", 6).alias("max_delta"))


@query("sc28_status", "select gap_id, coalesce(s, 'OPEN') status from (select user_id gap_id, arg_max(upper(event_type), struct_pack(a := ts, b := event_id)) filter (event_type in ('click', 'purchase')) s from events group by 1)")
def _(t):
    e = t("events")
    gaps = e.select(F.col("user_id").alias("gap_id")).distinct().withColumns({"status": F.lit("OPEN"), "updated_at": F.lit(None).cast("timestamp")})
    u = e.where("event_type in ('click', 'purchase')").select(F.col("user_id").alias("gap_id"), F.col("event_id").alias("update_id"), F.upper("event_type").alias("status"), F.col("ts").alias("updated_at"))
    return rm.set_gap_status(gaps, u).select("gap_id", "status")


@query("sc26_answerable", "select context_key, bool_or(comparable) answerable, count(*) filter (comparable) n_comparable from (" + ORACLES["sc24_contextual"] + ") group by 1")
def _(t):
    return sc.comparable_contexts(contextual(t))


@query("sc31_detail", _COMP_SQL + " select market_key, count(*) n_components, round(sum(coalesce(earned, 0)) + 1e-9, 4)::double earned, coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(missing, []))))), ','), '') open_gaps from e group by 1")
def _(t):
    c = sc.component_scores(observations(t))
    d = sc.score_detail(c, sc.engine_gaps(c))
    earned = F.aggregate("components", F.lit(0.0), lambda a, x: a + F.coalesce(x["earned"], F.lit(0.0)))
    return d.select("market_key", F.size("components").cast("long").alias("n_components"), F.round(earned + 1e-9, 4).alias("earned"), F.coalesce(F.array_join("open_gaps", ","), F.lit("")).alias("open_gaps"))


@query("sc33_gaps", _COMP_SQL + ", x as (select distinct market_key, unnest(missing) metric_key from e) select market_key, metric_key, case when metric_key = 'population' then 'HIGH' else 'MEDIUM' end priority from x where metric_key <> 'population'")
def _(t):
    gaps = sc.engine_gaps(sc.component_scores(observations(t))).withColumn("priority", fn.gap_priority("metric_key"))
    return sc.gap_list(gaps, {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}, priority="MEDIUM").select("market_key", "metric_key", "priority")


# --- entities ---------------------------------------------------------------------------------------------------------


@query("er06_normalised", "select event_id, case when event_id % 7 <> 0 then (props::json->>'$.k')::int end k, case when event_id % 7 = 0 then 'MALFORMED' end error from events")
def _(t):
    r = t("events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("body"))
    return ent.normalise(r, "k int").select("event_id", F.col("candidate.k").alias("k"), "error")


@query("er09_renormalised", "select distinct sha256(props) content_hash, (props::json->>'$.k')::int k from events where sha256(props) not in (select sha256(props) from events where event_type = 'signup' and user_id < 20)")
def _(t):
    v = t("events").select(F.sha2("props", 256).alias("content_hash"), F.col("props").alias("body"), "event_type", "user_id")
    done = v.where("event_type = 'signup' and user_id < 20").select("content_hash", F.lit("n2").alias("normaliser")).union(v.where("event_type = 'view'").select("content_hash", F.lit("n1")))
    return rm.renormalise(v.select("content_hash", "body").dropDuplicates(["content_hash"]), done, "n2", "k int").select("content_hash", F.col("candidate.k").alias("k"))


@query("er08_resolvable", "select o_orderkey run_id from orders where o_orderstatus = 'F' or o_orderpriority = '1-URGENT'")
def _(t):
    r = t("orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("completed_at"), F.when(F.col("o_orderpriority") == "1-URGENT", True).alias("allow_partial"))
    return ent.resolvable(r).select("run_id")


def _log(t):
    """Orders of a customer as the decisions on a record, in order of date."""
    d = t("orders").select(F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("record_id"), F.col("o_orderdate").alias("decided_at"), F.when(F.col("o_orderstatus") == "P", "AMBIGUOUS").otherwise("MATCHED").alias("decision"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("company_id"))
    return rel.number_in_group(d, ["record_id"], [F.col("decided_at"), F.col("decision_id")], "decision_id").withColumnRenamed("supersedes", "supersedes_decision_id")


_LOG = "h as (select o_custkey record_id, o_orderkey decision_id, o_orderdate decided_at, case when o_orderstatus = 'P' then 'AMBIGUOUS' else 'MATCHED' end decision, case when o_orderstatus <> 'P' then o_orderpriority end company_id from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)"


@query("er14_changed", f"with {_LOG}, n as (select c_custkey record_id, 'MATCHED' decision, case when c_nationkey % 2 = 0 then '1-URGENT' else '2-HIGH' end company_id from customer) select n.record_id, n.decision, n.company_id from n left join h using (record_id) where h.record_id is null or h.decision <> n.decision or h.company_id is distinct from n.company_id")
def _(t):
    n = t("customer").select(F.col("c_custkey").alias("record_id"), F.lit("MATCHED").alias("decision"), F.when(F.col("c_nationkey") % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("company_id"))
    return rm.changed_only(n, rel.heads(_log(t)))


@query("er15_queue", f"with {_LOG} select record_id, decision_id from h where decision = 'AMBIGUOUS' order by decided_at, decision_id limit 30")
def _(t):
    return rm.ambiguous_queue(_log(t), 30).select("record_id", "decision_id")


@query("er16_human", f"with {_LOG}, n as (select c_custkey record_id, 'MATCHED' decision, '1-URGENT' company_id from customer where c_nationkey < 9) select o_custkey record_id, count(*) + coalesce((select count(*) from n where n.record_id = o_custkey and not exists (select 1 from h where h.record_id = n.record_id and h.decision = n.decision and h.company_id = n.company_id)), 0) n from orders group by 1")
def _(t):
    log = _log(t).withColumn("decision_id", F.col("decision_id").cast("string")).withColumn("supersedes_decision_id", F.col("supersedes_decision_id").cast("string")).select("decision_id", "record_id", "decision", "company_id", "supersedes_decision_id")
    human = t("customer").where("c_nationkey < 9").select(F.col("c_custkey").alias("record_id"), F.lit("MATCHED").alias("decision"), F.lit("1-URGENT").alias("company_id")).join(log.select("record_id").distinct(), "record_id", "left_semi")
    return rel.counts_by(ent.append_decisions(log, human), "record_id")


@query("er18_unclaimed", "select distinct o_custkey version_id, o_orderpriority decision_id from orders where (o_custkey, o_orderpriority) not in (select o_custkey, o_orderpriority from orders where o_orderstatus = 'P')")
def _(t):
    p = t("orders").select(F.col("o_custkey").alias("version_id"), F.col("o_orderpriority").alias("decision_id"), "o_orderstatus")
    return rm.unclaimed(p.drop("o_orderstatus").distinct(), p.where("o_orderstatus = 'P'"))


def _facts(t):
    """Line items as claims of suppliers: places by return flag and line number, verticals by ship year."""
    place = F.to_json(F.struct(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("location_type"), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber").cast("string")).alias("address_normalized"), F.col("l_linestatus").alias("city")))
    kind = F.to_json(F.struct(F.date_format("l_shipdate", "yyyy").alias("vertical_id")))
    d = t("lineitem").select(F.col("l_suppkey").alias("company_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("claim_id"), F.lit(0.5).alias("trust"), F.lit(False).alias("human"), F.to_date("l_shipdate").alias("observed_at"), F.when(F.col("l_linestatus") == "O", "FACT").otherwise("PROXY").alias("fact_type"), F.lit(0.9).alias("confidence"), place.alias("p"), kind.alias("k"), "l_partkey")
    d = d.groupBy("company_id", "claim_id").agg(*[F.min_by(c, "l_partkey").alias(c) for c in ("trust", "human", "observed_at", "fact_type", "confidence", "p", "k")])
    pick = lambda a, c: d.withColumns({"attribute_key": F.lit(a), "value_json": F.col(c)}).drop("p", "k")
    return pick("location", "p").unionByName(pick("vertical", "k"))


_FACTS = """f as (select l_suppkey company_id, l_orderkey * 8 + l_linenumber claim_id, arg_min(l_shipdate::date, l_partkey) observed_at, arg_min(l_linestatus, l_partkey) ls, arg_min(l_returnflag, l_partkey) rf, min(l_linenumber) ln from lineitem group by 1, 2),
w as (select *, case when rf <> 'N' then rf else 'HEADQUARTERS' end location_type, case when ln < 6 then ln::varchar else 'unknown' end address_normalized, year(observed_at)::varchar vertical_id, case ls when 'O' then 'FACT' else 'PROXY' end fact_type from f)"""


@query("er24_locations", f"with {_FACTS} select company_id, location_type, address_normalized, any_value(n) claims, max(ls) filter (r = 1) city from (select *, count(*) over p n, row_number() over (partition by company_id, location_type, address_normalized order by case fact_type when 'FACT' then 0 else 1 end, observed_at desc, claim_id) r from w window p as (partition by company_id, location_type, address_normalized)) group by 1, 2, 3")
def _(t):
    return rm.project_locations(_facts(t)).select("company_id", "location_type", "address_normalized", F.size("claim_ids").cast("long").alias("claims"), "city")


@query("er26_verticals", f"with {_FACTS} select company_id, vertical_id, vertical_id = min(vertical_id) over (partition by company_id) is_primary, ft fact_type, n claims from (select company_id, vertical_id, min(fact_type) ft, count(*) n from w group by 1, 2)")
def _(t):
    return rm.project_verticals(_facts(t)).select("company_id", "vertical_id", "is_primary", "fact_type", F.size("claim_ids").cast("long").alias("claims"))


@query("er30_scope", "with d as (select distinct l_suppkey company_id, case l_linenumber % 3 when 0 then 'facebook.com' else 'd' || l_linenumber || '.example' end as \"domain\", case when l_linenumber > 5 then 'GROUP' else 'IDENTITY' end role from lineitem), u as (select *, role = 'IDENTITY' and \"domain\" <> 'facebook.com' ok from d) select company_id, min(\"domain\") filter (ok) primary_domain, count(distinct \"domain\") filter (ok) researchable, count(distinct \"domain\") filter (not ok) excluded from u group by 1")
def _(t):
    k = F.col("l_linenumber")
    d = t("lineitem").select(F.col("l_suppkey").alias("company_id"), F.when(k % 3 == 0, "facebook.com").otherwise(F.concat(F.lit("d"), k, F.lit(".example"))).alias("domain"), F.when(k > 5, "GROUP").otherwise("IDENTITY").alias("role")).distinct()
    return ent.domain_scope(d).select("company_id", "primary_domain", F.size("researchable").cast("long").alias("researchable"), F.size("excluded").cast("long").alias("excluded"))


@query("er31_companies", "select s_suppkey company_id, case when s_suppkey % 4 <> 0 then s_name end canonical_name, s_suppkey % 8 = 1 projection_conflict from supplier where s_suppkey % 2 = 1 and exists (select 1 from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R') and exists (select 1 from lineitem where l_suppkey = s_suppkey and year(l_shipdate) = 1997)")
def _(t):
    k = F.col("s_suppkey")
    c = t("supplier").select(k.alias("company_id"), F.when(k % 2 == 1, "ACTIVE").otherwise("MERGED").alias("lifecycle_status"))
    p = t("supplier").where("s_suppkey % 4 <> 0").select(k.alias("company_id"), F.col("s_name").alias("canonical_name"), (k % 8 == 1).alias("projection_conflict"))
    market = t("lineitem").select(F.col("l_suppkey").alias("company_id"), F.col("l_returnflag").alias("market"))
    kind = t("lineitem").select(F.col("l_suppkey").alias("company_id"), F.date_format("l_shipdate", "yyyy").alias("vertical_id"))
    return rm.company_view(c, p, market, kind, "R", "1997", "ACTIVE").select("company_id", "canonical_name", "projection_conflict")


# --- research ---------------------------------------------------------------------------------------------------------


@query("rs02_discoveries", "select distinct page_id % 20 locator, case page_id % 3 when 0 then 'LINK' else 'SITEMAP' end as \"method\", page_id % 5 parent from pages")
def _(t):
    k = F.col("page_id")
    c = t("pages").select((k % 20).alias("locator"), F.when(k % 3 == 0, "LINK").otherwise("SITEMAP").alias("method"), (k % 5).alias("parent"), F.lit("x").alias("pursued_for"))
    return res.discoveries(c).select("locator", "method", "parent")


@query("rs15_paged", "with d as (select conv_id, string_agg(text, chr(12) order by turn) x from conversations group by 1), q as (select conv_id, x, regexp_extract(x, '[a-z]{7,}') q from d) select conv_id, q quote, (strpos(x, q) - 1)::int as \"at\", len(string_split(left(x, strpos(x, q)), chr(12)))::int page from q where q <> ''")
def _(t):
    d = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    d = d.select("conv_id", F.array_join(F.transform("x", lambda v: v["text"]), "\f").alias("text"))
    return res.extract_paged(d, "[a-z]{7,}").select("conv_id", "quote", "at", "page")


@query("rs17_evidence", "select user_id extraction_id, event_type fetch_id, count(distinct props) n from events group by 1, 2")
def _(t):
    o = t("events").select(F.col("user_id").alias("extraction_id"), F.col("event_type").alias("fetch_id"), F.lit("t").alias("text_id"), F.lit(0).alias("start"), F.length("props").alias("end"), F.col("props").alias("quote"))
    return rel.counts_by(res.evidence_items(o), "extraction_id", "fetch_id")


@query("rs22_origins", "select l_orderkey claim_id, array_to_string(list_sort(list(distinct lpad(l_suppkey::varchar, 9, '0') || ':' || l_returnflag)), ',') origins from lineitem group by 1")
def _(t):
    e = t("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("source_id"), F.col("l_returnflag").alias("artifact_id"))
    return rm.origins(e).select("claim_id", F.array_join(F.transform("origins", lambda o: F.concat_ws(":", o["source_id"], o["artifact_id"])), ",").alias("origins"))


@query("rs27_corroboration", "select lang company_id, n_chars % 7 attribute_key, '{\"value\":' || n_chars % 3 || '}' value_json, count(distinct source) witnesses from documents group by 1, 2, 3")
def _(t):
    d = t("documents")
    c = d.select(F.col("doc_id").alias("claim_id"), F.col("lang").alias("company_id"), (F.col("n_chars") % 7).alias("attribute_key"), F.concat(F.lit('{ "value": '), F.col("n_chars") % 3, F.lit("}")).alias("value_json"))
    return rm.corroboration(c, d.select(F.col("doc_id").alias("claim_id"), F.col("source").alias("publisher"), F.col("doc_id").alias("document")))


@query(
    "rs35_confirmed",
    "with f as (select doc_id, quality, row_number() over (partition by doc_id % 500 order by doc_id) r from labels) select lang company_id, 'quality' attribute_key, f.doc_id value_json, 1::bigint n_evidence from f join documents using (doc_id) where r = 1 and quality = 1",
)
def _(t):
    k = F.col("doc_id")
    r = t("labels").select((k % 500).alias("candidate_id"), k.alias("review_id"), k.alias("decided_at"), F.when(F.col("quality") == 1, "CONFIRM").otherwise("REJECT").alias("decision"))
    first = r.groupBy("candidate_id").agg(F.min("review_id").alias("doc_id"))
    c = first.join(t("documents"), "doc_id").select("candidate_id", F.col("lang").alias("company_id"), F.sha2(k.cast("string"), 256).alias("fingerprint"))
    o = t("documents").select(F.sha2(k.cast("string"), 256).alias("fingerprint"), k.alias("observation_id"), k.alias("fetch_id"), k.alias("text_id"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.substring("text", 1, 1).alias("quote"), F.lit("quality").alias("attribute_key"), k.alias("value_json"), F.lit("COUNT").alias("unit"), F.lit("FACT").alias("fact_type"), F.col("source").alias("source_id"), k.alias("artifact_id"))
    return rm.confirm(c, r, o).select("company_id", "attribute_key", "value_json", F.size("evidence_ids").cast("long").alias("n_evidence"))


def _signals(t):
    e = F.col("event_type")
    return t("events").select(F.col("user_id").alias("occurrence_id"), "event_id", F.col("ts").alias("occurred_at"), F.when(e == "signup", "OPEN").when(e.isin("view", "click"), "ACKNOWLEDGED").when(e == "purchase", "ACTIONED").otherwise("DISMISSED").alias("event_kind"))


_SIG = "g as (select user_id occurrence_id, event_id, ts, case when event_type = 'signup' then 'OPEN' when event_type in ('view', 'click') then 'ACKNOWLEDGED' when event_type = 'purchase' then 'ACTIONED' else 'DISMISSED' end k from events), s as (select occurrence_id, k status, ts since from g qualify row_number() over (partition by occurrence_id order by ts desc, case k when 'OPEN' then 0 when 'ACKNOWLEDGED' then 1 else 2 end desc, event_id desc) = 1)"


@query("rs38_signals", f"with {_SIG} select o.occurrence_id, status, since, n_evidence from (select distinct user_id + 0 occurrence_id from events) o left join s using (occurrence_id) left join (select user_id occurrence_id, count(distinct props) n_evidence from events where value > 10 group by 1) x using (occurrence_id)")
def _(t):
    s = _signals(t)
    e = t("events").where("value > 10").select(F.col("user_id").alias("occurrence_id"), F.col("props").alias("evidence_id"))
    return rm.signal_view(s.select("occurrence_id").distinct(), s, e).select("occurrence_id", "status", "since", F.when(F.col("evidence_ids").isNotNull(), F.size("evidence_ids")).cast("long").alias("n_evidence"))


@query("rs37_signals", f"with {_SIG} select s.occurrence_id company_id, 2 number from s where status in ('ACTIONED', 'DISMISSED') union all select c_custkey, 1 from customer where c_custkey not in (select occurrence_id from s)")
def _(t):
    s = _signals(t)
    new = t("customer").select(F.col("c_custkey").alias("company_id"), F.lit(" Merger ").alias("concern")).union(s.select("occurrence_id", F.lit("merger")).distinct())
    sid = fn.signal_fingerprint("company_id", "concern")
    o = s.select(F.col("occurrence_id").alias("company_id"), F.lit("MERGER").alias("concern"), "occurrence_id").distinct().select(sid.alias("signal_id"), "occurrence_id", F.lit(1).alias("number"))
    return res.raise_signals(new, o, s).select("company_id", "number")


@query(
    "rs43_research",
    """with c as (select o_custkey company_id, o_orderpriority attribute_key, o_orderdate::date d, o_orderkey k, o_orderstatus v, case o_orderpriority when '1-URGENT' then 100 when '2-HIGH' then 400 when '3-MEDIUM' then 1500 end h from orders),
s as (select *, case when h is null then 'FRESH' when date '1998-12-31' - d > h then 'STALE' when date '1998-12-31' - d > h * 0.5 then 'AGING' else 'FRESH' end st from c)
select company_id, attribute_key, arg_min(v, struct_pack(a := -epoch(d), b := k)) best_value, count(distinct v) > 1 contradicted, count(*) n_claims, arg_min(st, case st when 'FRESH' then 0 when 'AGING' then 1 else 3 end) staleness, count(distinct k) witnesses from s group by 1, 2""",
)
def _(t):
    k = F.col("o_orderkey")
    c = t("orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("attribute_key"), F.to_date("o_orderdate").alias("observed_at"), k.alias("claim_id"), F.col("o_orderstatus").alias("value_json"), F.lit("FACT").alias("fact_type"), F.lit(0.5).alias("trust"), k.alias("publisher"), k.alias("document"))
    h = c.sparkSession.createDataFrame([("1-URGENT", 100), ("2-HIGH", 400), ("3-MEDIUM", 1500)], "attribute_key string, staleness_days int")
    return rm.research_view(c, h, F.to_date(F.lit("1998-12-31"))).select("company_id", "attribute_key", "best_value", "contradicted", F.size("claim_ids").cast("long").alias("n_claims"), "staleness", "witnesses")


@query("rs45_history", "select user_id source_id, part, sum(n)::bigint n from (select user_id, 'fetch' part, 1 n from events union all select user_id, 'discovery', 1 from events where event_type = 'view' union all select user_id, 'out', 1 from events where event_type = 'click' union all select event_id % 50, 'in', 1 from events where event_type = 'click') group by 1, 2")
def _(t):
    f = t("events").select(F.col("user_id").alias("source_id"), "event_type", "event_id")
    links = f.where("event_type = 'click'").select(F.col("source_id").alias("from_id"), (F.col("event_id") % 50).alias("to_id"))
    return rm.source_report(f, links, f.where("event_type = 'view'"))


# --- sinks ------------------------------------------------------------------------------------------------------------


@query("snk02_rebuild", "select o_custkey, count(*) n from orders group by 1")
def _(t):
    """The derived table is written whole over its last state, twice, and read back."""
    d = t("orders")
    path = io.scratch(d.sparkSession, "rebuilt")
    for part in (d.where("o_orderstatus = 'P'"), d):
        io.rebuild(rel.counts_by(part, "o_custkey"), path)
    return d.sparkSession.read.parquet(path)
