"""Registered queries of extractors, gates and fingerprints over texts that the given tables are written out as."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import columns as fn
from attesta.functions import config as cfg
from attesta.operators import relational as rel
from attesta.plans import entities as ent
from attesta.plans import research as res
from attesta.plans.catalog import query

_SHARED, _PLATFORM = sorted(cfg.SHARED_HOSTS)[0], sorted(cfg.PLATFORM_DOMAINS)[0]


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


@query(
    "flt08_seeds",
    f"""with x as (select c_custkey, case c_nationkey % 4 when 0 then '{_SHARED}' when 1 then '{_PLATFORM}' when 2 then lower(c_mktsegment) || '.com' end d from customer)
select c_custkey, coalesce(d not in ({_sql_list(cfg.SHARED_HOSTS)}), false) identity_domain, coalesce(d not in ({_sql_list(cfg.PLATFORM_DOMAINS)}), false) crawlable from x""",
)
def _(t):
    """Customers with the domain of a shared host, of a platform, of their own, or none."""
    n = F.col("c_nationkey") % 4
    d = F.when(n == 0, _SHARED).when(n == 1, _PLATFORM).when(n == 2, F.concat(F.lower("c_mktsegment"), F.lit(".com")))
    c = t("customer").withColumn("url", F.concat(F.lit("https://www."), d, F.lit("/about")))
    return c.select("c_custkey", fn.is_identity_domain("url").alias("identity_domain"), F.coalesce(fn.is_crawlable_seed("url"), F.lit(False)).alias("crawlable"))


@query(
    "flt10_extractors",
    """with x as (select event_id, case event_type when 'click' then 'text/plain' else 'application/json' end m, case event_type when 'view' then 0 when 'error' then 1 else 2 end j from events)
select event_id, 'json' extractor_id from x where m = 'application/json' union all select event_id, 'keyed' from x where m = 'application/json' and j <> 1 union all select event_id, 'both' from x where m = 'application/json' and j = 0 union all select event_id, 'plain' from x where m = 'text/plain'""",
)
def _(t):
    """Events' properties as texts: views have one more key, errors are cut short and no JSON."""
    e = F.col("event_type")
    text = F.when(e == "view", F.regexp_replace("props", r"\}$", ', "seen": true}')).when(e == "error", F.regexp_replace("props", r"\}$", "")).otherwise(F.col("props"))
    texts = t("events").select("event_id", F.when(e == "click", "text/plain").otherwise("application/json").alias("media_type"), text.alias("text"))
    wanted = [("json", "application/json", []), ("keyed", "application/json", ["k"]), ("both", "application/json", ["k", "seen"]), ("plain", "text/plain", [])]
    return res.applicable_extractors(texts, [dict(zip(("extractor_id", "media_type", "required"), w, strict=True)) for w in wanted]).select("event_id", "extractor_id")


@query("fn32_csv_rows", """select o_orderkey, '{"clerk":' || case when o_orderpriority = '1-URGENT' then 'null' else '"' || o_orderpriority || '"' end || ',"key":"' || o_orderkey || '","status":"' || o_orderstatus || '"}' "row" from orders""")
def _(t):
    cells = F.create_map(F.lit(" STATUS "), F.col("o_orderstatus"), F.lit("Key "), F.concat(F.lit("  "), "o_orderkey"), F.lit("clerk"), F.when(F.col("o_orderpriority") == "1-URGENT", " ").otherwise(F.col("o_orderpriority")))
    return t("orders").select("o_orderkey", fn.canonical_csv(cells).alias("row"))


@query("fn36_assertions", """select o_custkey, sha256('{"f0":' || o_custkey || ',"f1":"orders","f2":null,"f3":' || to_json(list_sort(list(distinct o_orderpriority)))::varchar || '}') fingerprint from orders group by 1""")
def _(t):
    """An assertion has the sorted origins of its evidence and not the extractor."""
    g = t("orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("origins"))
    return g.select("o_custkey", fn.assertion_fingerprint("o_custkey", F.lit("orders"), F.lit(None).cast("string"), origins="origins").alias("fingerprint"))


@query(
    "fn37_observations",
    """select event_id, sha256('{"f0":"' || event_type || '","f1":"' || (props::json->>'$.k') || '","f2":null,"f3":"FACT","f4":"' || sha256('{"f0":0,"f1":' || length(props) || '}') || '","f5":"DIRECT","f6":' || case when user_id % 2 = 0 then user_id::varchar else 'null' end || '}') fingerprint from events""",
)
def _(t):
    """Events as readings of their own text: the place is all of it, every second user's share a lineage."""
    e = t("events").withColumns({"value": F.get_json_object("props", "$.k"), "locator": fn.fingerprint(F.lit(0), F.length("props")), "lineage": F.when(F.col("user_id") % 2 == 0, F.col("user_id"))})
    return e.select("event_id", fn.observation_fingerprint("event_type", "value", F.lit(None).cast("string"), F.lit("FACT"), "locator", F.lit("DIRECT"), "lineage").alias("fingerprint"))


@query("fn38_signals", """select c_custkey, sha256('{"f0":' || c_nationkey || ',"f1":"' || c_mktsegment || ' LATE"}') signal, sha256('{"f0":' || c_custkey || ',"f1":["' || c_mktsegment || '","late"]}') plan from customer""")
def _(t):
    """A signal's concern is the same whatever its case and spaces; a plan's attributes are sorted."""
    concern = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" \n late "))
    plan = fn.plan_hash("c_custkey", targets=F.array(F.lit("late"), F.col("c_mktsegment")))
    return t("customer").select("c_custkey", fn.signal_fingerprint("c_nationkey", concern).alias("signal"), plan.alias("plan"))


@query(
    "rs06_declared",
    """with p as (select page_id, 'https://p' || page_id || '.example/a/b' u from pages)
select u from_locator, 'https://p' || page_id || '.example/a/main' to_locator, 'CANONICAL' edge_type from p where page_id % 5 <> 0
union all select u, 'https://p' || page_id || '.example/de', 'LANGUAGE' from p
union all select u, 'https://fr.example/' || page_id, 'LANGUAGE' from p where page_id % 3 = 0
union all select 'https://old.example/' || page_id, u, 'REDIRECT' from p where page_id % 4 = 1""",
)
def _(t):
    """All pages, each with tags before its own text: attributes in three orders and quotings, relative and absolute targets,
    every fifth page its own canonical, an alternate without a language, and redirects from an older address."""
    i = F.col("page_id")
    u = F.concat(F.lit("https://p"), i, F.lit(".example/a/b"))
    href = F.when(i % 5 == 0, u).otherwise("main")
    canonical = F.when(i % 3 == 0, F.concat(F.lit('<link rel="canonical" href="'), href, F.lit('">'))).when(i % 3 == 1, F.concat(F.lit("<LINK href='"), href, F.lit("' REL='canonical' />"))).otherwise(F.concat(F.lit("<link\nid=x rel=canonical href="), href, F.lit(">")))
    second = F.lit('<link rel="canonical" href="/second"><link rel="alternate" href="/feed"><link hreflang="de" href="/de" rel="alternate">')
    french = F.when(i % 3 == 0, F.concat(F.lit('<link rel="alternate" hreflang="fr" href="https://FR.example/'), i, F.lit('#top">'))).otherwise("")
    pages = t("pages").select(u.alias("url"), F.concat(canonical, second, french, F.coalesce("html", F.lit(""))).alias("html"))
    fetches = t("pages").where(i % 4 == 1).select(F.concat(F.lit("https://old.example/"), i).alias("url"), u.alias("redirect_to"))
    return res.declared_edges(pages, fetches=fetches)


@query(
    "rs17_provenance",
    """with o as (select l_orderkey * 8 + l_linenumber extraction_id, o_custkey + case when l_linenumber % 3 = 0 then 1 else 0 end body, o_custkey, o_orderstatus, c_nationkey from lineitem join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey)
select extraction_id, 'FETCH_BODY' violation, count(*) n from o where o_orderstatus = 'P' or body <> o_custkey group by 1
union all select extraction_id, 'DERIVATION_BODY', count(*) from o where c_nationkey is null or o_custkey + case when c_nationkey % 5 = 0 then 1 else 0 end <> body group by 1""",
)
def _(t):
    """Lines as observations of their order's retrieval and their customer's text; every third cites another body, open orders
    carried none, and the texts of every fifth nation derive from another."""
    o = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    body = F.col("o_custkey") + F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)
    o = o.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("extraction_id"), F.col("l_orderkey").alias("fetch_id"), F.col("o_custkey").alias("text_id"), body.alias("body_id"))
    fetches = t("orders").select(F.col("o_orderkey").alias("fetch_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("body_id"))
    derivations = t("customer").select(F.col("c_custkey").alias("text_id"), (F.col("c_custkey") + F.when(F.col("c_nationkey") % 5 == 0, 1).otherwise(0)).alias("body_id"))
    return rel.counts_by(res.evidence_provenance(o, fetches, derivations), "extraction_id", "violation")


@query(
    "jn13_edges_of",
    """with r as (select distinct l_suppkey f, l_partkey t from lineitem), n as (select s_suppkey id from supplier where s_acctbal > 0)
select id, f from_id, t to_id, true outward from r join n on f = id union all select id, f, t, false from r join n on t = id where f <> t""",
)
def _(t):
    """The edges of all suppliers that are in credit, in a graph of suppliers and parts numbered alike."""
    r = t("lineitem").select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id")).distinct()
    return rel.edges_of_each(r, t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")), "id")


@query(
    "rs05_sitemaps",
    """with h as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) host from pages)
select 'https://' || host || '/map-' || page_id sitemap, url loc from h union select 'https://index.example/' || page_id, url from h""",
)
def _(t):
    """A sitemap of each page on its host, and an index that leads to it."""
    p = t("pages").select("page_id", "url", F.concat(F.lit("https://"), fn.host_of("url"), F.lit("/map-"), "page_id").alias("map"))
    loc = lambda tag, c: F.concat(F.lit(f"<{tag}>\n<loc> "), F.col(c), F.lit(f"\n</loc></{tag}>"))
    docs = p.select(F.col("map").alias("url"), loc("urlset", "url").alias("body")).union(p.select(F.concat(F.lit("https://index.example/"), "page_id"), loc("sitemapindex", "map")))
    return res.sitemap_urls(docs)


@query(
    "rs13_postings",
    """select o_orderkey, o_custkey::varchar employer, o_orderdate::date posted, (row_number() over (partition by o_orderkey order by l_linenumber, l_returnflag) - 1)::int as "position", l_linenumber || l_returnflag responsibility
from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'P' union all select o_orderkey, o_custkey::varchar, o_orderdate::date, null, null from orders where o_orderstatus <> 'P' and o_orderkey not in (select l_orderkey from lineitem)""",
)
def _(t):
    """Orders as job postings with their lines as responsibilities; those in progress lack the id and are none."""
    duties = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("d"))
    o = t("orders").join(duties, "o_orderkey", "left")
    job = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("string"))
    said = F.transform("d", lambda x: F.concat(x["l_linenumber"], x["l_returnflag"]))
    text = F.to_json(F.struct(job.alias("job_id"), F.col("o_custkey").cast("string").alias("employer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted_at"), said.alias("responsibilities")))
    return res.extract_postings(o.select("o_orderkey", text.alias("text"))).select("o_orderkey", "employer", F.col("posted.date").alias("posted"), "position", "responsibility")


@query(
    "rs14_registry",
    "select s_suppkey, n_name jurisdiction, s_suppkey::varchar entity_number, s_name legal_name, r_name city from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where s_acctbal > 0 and s_suppkey % 5 <> 0",
)
def _(t):
    """Suppliers as registry entries; those in debt have no number, and every fifth text is cut short and no JSON."""
    s = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    number = F.when(F.col("s_acctbal") > 0, F.col("s_suppkey").cast("string"))
    text = F.to_json(F.struct(F.col("n_name").alias("jurisdiction"), number.alias("entity_number"), F.col("s_name").alias("legal_name"), F.struct(F.col("r_name").alias("city")).alias("principal_address")))
    text = F.when(F.col("s_suppkey") % 5 == 0, F.regexp_replace(text, r"\}$", "")).otherwise(text)
    return res.extract_registry(s.select("s_suppkey", text.alias("text")))


@query("ag21_versions", "select year(o_orderdate)::int run_id, o_custkey external_id, md5(o_orderpriority || o_orderstatus) content_hash, count(*) n_seen from orders group by all")
def _(t):
    """Years as runs, customers as entities and an order's state as the version that it shows."""
    return ent.run_versions(t("orders").select(F.year("o_orderdate").alias("run_id"), F.col("o_custkey").alias("external_id"), F.md5(F.concat("o_orderpriority", "o_orderstatus")).alias("content_hash")))
