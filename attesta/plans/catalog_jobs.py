"""Registered queries of the jobs with state of their own: references and seeds, streams, matchings, file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import columns as fn
from attesta.functions import columns as fn
from attesta.functions import config as cfg
from attesta.plans import research as res
from attesta.plans import scoring as sc
from attesta.plans import witnesses as wit
from attesta.plans.catalog import _LIFE, _LINK, _LOC, _OBS_SQL, lifecycle, observations, query
from attesta.sources import io, providers
from attesta.sources.bodies import BodyStore
from attesta.streaming import jobs
from attesta.streaming.sink import BucketedSink

# --- references and seeds ---------------------------------------------------------------------------------------------

#: A page for each stored one, with a reference of every form; ``_FORMS`` states what each means, without resolving it.
_HREFS = ["w1", "../w2/./x", "/p/q/../r#top", "//Other.example.org/z", "?item=9", "#top", "mailto:a@b.example", "javascript:void(0)", "HTTPS://www.ex-9.example.org/fr/../abs/", "../../../../up", "./", "svc?utm_source=x&b=2&a=1", "tel:+1555", "w3/."]
_FORMS = [
    "base || dir || 'w1'", "base || up || 'w2/x'", "base || '/p/r'", "scheme || '://other.example.org/z'", "base || path || '?item=9'", "null", "null", "null",
    "'https://www.ex-9.example.org/abs'", "base || '/up'", "base || case when dir = '/' then '/' else regexp_replace(dir, '/$', '') end", "base || dir || 'svc?a=1&b=2'", "null", "base || dir || 'w3'",
]
_TWO = "array_to_string(string_split({}, '.')[-2:], '.')"


@query(
    "rs03_references",
    f"""with {_LOC}, b as (select url, l.page_id, regexp_extract(locator, '^([a-z]+)://', 1) scheme, regexp_extract(locator, '^([a-z]+://[^/?]+)', 1) base, regexp_extract(locator, '^[a-z]+://[^/?]+([^?]*)', 1) path from l join pages using (page_id)),
d as (select *, regexp_replace(path, '[^/]*$', '') dir from b), e as (select *, regexp_replace(dir, '[^/]+/$', '') up from d),
f as ({" union all ".join(f"select page_id, scheme, base, '{h}' href, {f} locator from e" for h, f in zip(_HREFS, _FORMS, strict=True))})
select page_id, href, locator, case when href = '#top' then 'FRAGMENT' when locator is null then 'SCHEME' when {_TWO.format("regexp_extract(locator, '^[a-z]+://([^/?]+)', 1)")} <> {_TWO.format("regexp_extract(base, '^[a-z]+://([^/?]+)', 1)")} then 'OUT_OF_SCOPE' else 'WEB' end reason from f""",
)
def _(t):
    html = "".join(f'<a class="x" href="{h}">y</a>' for h in _HREFS)
    pages = t("pages").select("page_id", "url", F.lit(html).alias("html"))
    d = res.link_report(pages.select("url", "html").distinct()).join(pages.select("page_id", "url"), "url")
    kept = F.when(F.col("reason").isin("FRAGMENT", "SCHEME", "HOST", "OUT_OF_SCOPE"), F.col("reason")).otherwise("WEB")
    return d.select("page_id", "href", "locator", kept.alias("reason"))


@query("rs02_links", f"with {_LOC}, {_LINK} select distinct k.locator, 'CRAWL_LINK' \"method\", l.locator parent from k join pages using (url) join l using (page_id)")
def _(t):
    """The links of all stored pages as discoveries: one per locator and the page that led to it, however often it does."""
    links = res.extract_links(t("pages")).where("in_scope")
    d = links.select("locator", F.lit("CRAWL_LINK").alias("method"), fn.normalize_locator("url").alias("parent"), F.lit("crawl").alias("pursued_for"))
    return res.discoveries(d.union(d)).select("locator", "method", "parent")


@query(
    "src07_seeds",
    """with n as (select c_nationkey nation, c_mktsegment segment, min(c_acctbal) balance from customer group by all), s as (select distinct c_nationkey, c_mktsegment from customer where c_custkey % 5 = 0)
select nation, segment, balance from n where not exists (select 1 from s where c_nationkey = nation and c_mktsegment = segment)""",
)
def _(t):
    """Balances by nation and segment, of which every fifth customer's key is stored with another value."""
    c = t("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), "c_custkey")
    stored = c.where("c_custkey % 5 = 0").select("nation", "segment", (F.col("balance") + 1).alias("balance"))
    return cfg.absent_rows(c.drop("c_custkey"), stored, ["nation", "segment"])


# --- witnesses --------------------------------------------------------------------------------------------------------

#: The deficiency formula: the greatest matching misses as many publishers as some set of them exceeds its documents by. Sets
#: are bits, over documents counted by the set of publishers that have them.
_DEFICIENCY = """with e as (select distinct lang, source p, sha256(text) d from documents where source is not null and text is not null),
b as (select *, dense_rank() over (partition by lang order by p) - 1 bit from e), n as (select lang, max(bit) + 1 n from b group by 1),
m as (select lang, bits, count(*) n_docs from (select lang, d, sum(1::bigint << bit::int)::bigint bits from b group by 1, 2) group by 1, 2),
s as (select lang, unnest(range(0, 1::bigint << n::int)) s from n),
x as (select s.lang, s, bit_count(s) - sum(case when bits & s <> 0 then n_docs else 0 end) missed from s join m on m.lang is not distinct from s.lang group by 1, 2)"""


@query("rs23_witnesses", _DEFICIENCY + " select x.lang, (any_value(n) - max(missed))::bigint witnesses from x join n on n.lang is not distinct from x.lang group by 1")
def _(t):
    e = t("documents").select("lang", F.col("source").alias("publisher"), F.sha2("text", 256).alias("document"))
    return res.independent_witnesses(e, ["lang"])


@query(
    "rs23_contested",
    """with d as (select distinct user_id % 12 p, event_type g, user_id // 12 % 7 d from events),
n as (select g, count(distinct p) n from d group by 1), b as (select *, dense_rank() over (partition by g order by p) - 1 bit from d),
m as (select g, bits, count(*) n_docs from (select g, d, sum(1::bigint << bit::int)::bigint bits from b group by 1, 2) group by 1, 2),
s as (select g, unnest(range(0, 1::bigint << n::int)) s from n), x as (select s.g, s, bit_count(s) - sum(case when bits & s <> 0 then n_docs else 0 end) missed from s join m using (g) group by 1, 2)
select x.g event_type, (any_value(n) - max(missed))::bigint witnesses, true proven from x join n using (g) group by 1""",
)
def _(t):
    """Many publishers that share few documents, with the cover that proves the count."""
    e = t("events").select("event_type", (F.col("user_id") % 12).alias("publisher"), F.expr("(user_id div 12) % 7").alias("document"))
    pairs, edges = wit.witness_pairs(e, ["event_type"])
    cover = wit.witness_cover(pairs, edges).groupBy("g").agg(F.count(F.lit(1)).alias("cover"))
    d = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("witnesses")).join(cover, "g")
    return d.select(F.get_json_object("g", "$.event_type").alias("event_type"), "witnesses", (F.col("witnesses") == F.col("cover")).alias("proven"))


# --- streams ----------------------------------------------------------------------------------------------------------


def _quarters(df, at: str):
    """A number from 0 to 3 for each row by where ``at`` (a time) lies between the table's ends."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    low, high = (F.lit(x).cast("long") for x in df.agg(F.min(us), F.max(us)).first())
    return df.withColumn("quarter", F.least(F.lit(3), F.floor((us - low) * 4 / (high - low + 1))).cast("int"))


def _files(df, column: str, n: int, name: str) -> tuple[str, int]:
    """A folder of Parquet files for a file stream, the values of ``column`` one after another, and the number of files of a
    value. They are as many as ``df`` has splits, so that a file does not grow with the table."""
    path, parts, counts = io.scratch(df.sparkSession, name), max(1, df.rdd.getNumPartitions()), [0]
    for i in range(n):
        rows = df.where(F.col(column) == i).drop(column)
        rows.repartition(parts).write.mode("append").parquet(path)
        counts.append(len(df.sparkSession.read.schema(rows.schema).parquet(path).inputFiles()))
    return path, max(b - a for a, b in zip(counts, counts[1:]))


class _Crash(Exception):
    pass


class _CrashingSink(BucketedSink):
    """Fails once between write and commit."""

    crashed = False

    def commit(self, batch, *rest, **more):
        if batch.endswith("-2") and not self.crashed:
            self.crashed = True
            raise _Crash(batch)
        super().commit(batch, *rest, **more)


@query("st01_ingest", "select user_id, event_type, event_id, ts from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def _(t):
    """Events in four micro-batches: the third is written, fails before its commit and is replayed; the second comes twice more,
    before and after the batches are compacted. The first event of each user and kind stays."""
    e = t("events").select("user_id", "event_type", "event_id", "ts")
    spark, schema = e.sparkSession, "user_id long, event_type string, event_id long, ts timestamp_ntz"
    parts = io.staged(_quarters(e, "ts"), "quarters")
    sink = _CrashingSink(spark, io.scratch(spark, "ingested"), schema, ["user_id", "event_type"], buckets=16, order=[F.col("ts"), F.col("event_id")])
    (stream, files), checkpoint = _files(parts, "quarter", 4, "arrivals"), io.scratch(spark, "ingest-checkpoint")
    for _ in range(2):
        try:
            jobs.stream_ingest(jobs.replay(spark, stream, schema, files), sink, checkpoint, "events").awaitTermination()
        except Exception:
            if not sink.crashed:
                raise
    again = parts.where("quarter = 1").drop("quarter")
    sink.write(again, "events-1")
    sink.compact()
    sink.write(again, "events-1")
    sink.write(again, "events-late")  # the same rows under another name: their keys are there
    return sink.read()


@query(
    "st02_status",
    f"""with recursive {_LIFE}, o as (select gap_id, event_id, k, row_number() over (partition by gap_id order by ts, l, event_id) n from r),
w as (select gap_id, 0::bigint event_id, ''::varchar k, 0::bigint n, null::varchar previous, false accepted, null::varchar status from (select distinct gap_id from o)
  union all select o.gap_id, o.event_id, o.k, o.n, w.status, coalesce(w.status, '-') || '>' || o.k in ('->RAISED', 'RAISED>ATTEMPTED', 'ATTEMPTED>ATTEMPTED', 'RAISED>RESOLVED', 'ATTEMPTED>RESOLVED', 'RAISED>ABANDONED', 'ATTEMPTED>ABANDONED'),
    case when coalesce(w.status, '-') || '>' || o.k in ('->RAISED', 'RAISED>ATTEMPTED', 'ATTEMPTED>ATTEMPTED', 'RAISED>RESOLVED', 'ATTEMPTED>RESOLVED', 'RAISED>ABANDONED', 'ATTEMPTED>ABANDONED') then o.k else w.status end
  from w join o on o.gap_id = w.gap_id and o.n = w.n + 1)
select gap_id, event_id, k event_kind, previous, accepted from w where n > 0""",
)
def _(t):
    """The events of every user in four micro-batches, a third of them a quarter late; a closing event brings the watermark past
    all others."""
    e = lifecycle(t).select(F.col("gap_id").cast("string").alias("key"), "event_id", "event_kind", F.col("occurred_at").cast("timestamp").alias("occurred_at"))
    spark, schema = e.sparkSession, "key string, event_id long, event_kind string, occurred_at timestamp"
    d = _quarters(e, "occurred_at")
    d = d.withColumn("quarter", F.when(F.col("event_id") % 3 == 0, F.least(F.col("quarter") + 1, F.lit(3))).otherwise(F.col("quarter")))
    span = d.agg(F.max("occurred_at").alias("last"), F.expr("(max(unix_seconds(occurred_at)) - min(unix_seconds(occurred_at))) div 2 + 1").alias("half"), F.count(F.lit(1)).alias("n")).first()
    if span["last"] is None:
        return spark.createDataFrame([], "gap_id long, event_id long, event_kind string, previous string, accepted boolean")
    folder, files = _files(d, "quarter", 4, "happenings")
    for i in range(2):  # a closing event in each file of a batch
        at = F.lit(span["last"]) + F.expr(f"make_dt_interval(0, 0, 0, {3 * span['half'] + i})")
        close = spark.range(0, files, 1, files).select(F.lit("").alias("key"), F.lit(-1).cast("long").alias("event_id"), F.lit("CLOSE").alias("event_kind"), at.cast("timestamp").alias("occurred_at"))
        close.write.mode("append").parquet(folder)
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = io.scratch(spark, "verdicts")
    try:
        status = jobs.stream_status(jobs.replay(spark, folder, schema, files), f"{span['half']} seconds", buckets=max(64, span["n"] // 16_000))
        status.writeStream.format("parquet").option("path", out).option("checkpointLocation", io.scratch(spark, "status-checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    d = spark.read.schema(jobs.STATUS).parquet(out).where("key <> ''")
    return d.select(F.col("key").cast("long").alias("gap_id"), "event_id", "event_kind", "previous", "accepted")


# --- file sources -----------------------------------------------------------------------------------------------------


@query(
    "src01_snapshots",
    """with c as (select c_nationkey n, count(*) m, max(c_acctbal) b from customer group by 1) select n nation, case n % 6 when 1 then 'NOT_UTF8' when 2 then 'MALFORMED' when 3 then 'NOT_OBJECT' when 4 then 'NO_METADATA' end reason,
case when n % 6 in (0, 5) then m else 0 end n_markets, case when n % 6 in (0, 5) then b end best, case when n % 6 = 1 then '2' end bad_byte from c""",
)
def _(t):
    """A document for each nation with its customers as markets, four of six damaged, each in a way of its own."""
    c = t("customer")
    spark, n = c.sparkSession, F.col("nation")
    market = F.struct(F.col("c_name").alias("country"), F.create_map(F.lit("gdp"), F.col("c_acctbal")).alias("raw"))
    d = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_list(market).alias("markets"))
    whole = F.to_json(F.struct(F.struct(F.lit("t").alias("title")).alias("metadata"), "markets"))
    bare = F.to_json(F.struct("markets"))
    broken = F.concat(F.expr("cast(X'7BFF' as string)"), whole)
    value = F.when(n % 6 == 1, broken).when(n % 6 == 2, F.expr("substring(doc, 1, length(doc) - 2)")).when(n % 6 == 3, F.concat(F.lit("["), F.col("doc"), F.lit("]"))).when(n % 6 == 4, bare).otherwise(F.col("doc"))
    path = io.scratch(spark, "snapshots")
    d.withColumn("doc", whole).select("nation", value.alias("value")).repartition("nation").write.partitionBy("nation").text(path)
    got = io.read_snapshot(spark, f"{path}/*/*.txt")
    nation = F.regexp_extract("file", "nation=([0-9]+)", 1).cast("int").alias("nation")
    markets = got["markets"].groupBy(nation).agg(F.count(F.lit(1)).alias("n_markets"), F.max(F.col("raw")["gdp"]).alias("best"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("bad_byte"))
    bad = got["rejects"].select(nation, "reason", F.when(F.col("reason") == "NOT_UTF8", F.col("position")).alias("bad_byte"), F.lit(0).cast("long").alias("n_markets"), F.lit(None).cast("double").alias("best"))
    return markets.unionByName(bad).select("nation", "reason", "n_markets", "best", "bad_byte")


@query(
    "src02_directory",
    """select case when s_suppkey % 11 in (0, 5) then null else 'S' || s_suppkey end external_id, case s_suppkey % 11 when 0 then 'MALFORMED' when 5 then 'NO_STABLE_KEY' end problem,
case when s_suppkey % 11 <> 0 then s_name end legal_name, case when s_suppkey % 11 <> 0 then 'n' || s_nationkey end country, case when s_suppkey % 11 <> 0 then s_suppkey % 50 end employee_count_min,
case when s_suppkey % 11 <> 0 then sha256('{"employees":{"min":' || s_suppkey % 50 || '},"legal_name":"' || s_name || '","location":{"country":"n' || s_nationkey || '"}}')
  else sha256('[' || s_suppkey || ']') end content_hash from supplier""",
)
def _(t):
    """Suppliers as a provider's JSON lines, in two orders of keys; every eleventh is no object, and as many have no id."""
    s, spark = t("supplier"), t("supplier").sparkSession
    k = F.col("s_suppkey")
    place, staff = F.struct(F.concat(F.lit("n"), "s_nationkey").alias("country")).alias("location"), F.struct((k % 50).alias("min")).alias("employees")
    own = F.when(k % 11 != 5, F.concat(F.lit("S"), k)).alias("external_id")
    name = F.col("s_name").alias("legal_name")
    one, two = F.to_json(F.struct(own, F.struct(name, place, staff).alias("payload"))), F.to_json(F.struct(F.struct(staff, place, name).alias("payload"), own))
    line = F.when(k % 11 == 0, F.concat(F.lit("["), k, F.lit("]"))).when(k % 2 == 0, one).otherwise(two)
    path = io.scratch(spark, "directory")
    s.select(line.alias("value")).write.text(path)
    return providers.candidates(spark, providers.JSON_DIRECTORY, path).select("external_id", "problem", "legal_name", "country", "employee_count_min", "content_hash")


@query(
    "src03_export",
    """select case when c_custkey % 9 <> 0 then sha256('1|c' || c_custkey % 1000 || '.example') end external_id, case when c_custkey % 9 = 0 then 'NO_STABLE_KEY' end problem, c_name legal_name,
case when c_custkey % 9 <> 0 then 'c' || c_custkey % 1000 || '.example' end registrable_domain, case when c_custkey % 4 <> 0 then c_custkey % 30 end employee_count_min from customer""",
)
def _(t):
    """Customers as a CSV export: blank domains have no stable key, numbers that are none are null."""
    c, spark = t("customer"), t("customer").sparkSession
    k = F.col("c_custkey")
    domain = F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit(" C"), k % 1000, F.lit(".Example ")))
    d = c.select(F.concat(F.lit(" "), "c_name").alias("company"), domain.alias("domain"), F.col("c_nationkey").cast("string").alias("country"), F.lit("").alias("city"), F.lit("1").alias("zip"), F.when(k % 4 == 0, "many").otherwise((k % 30).cast("string")).alias("staff_min"), F.lit(None).cast("string").alias("staff_max"), F.lit('a "quoted", cell').alias("other"))
    path = io.scratch(spark, "export")
    d.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return providers.candidates(spark, providers.CSV_EXPORT, path).select("external_id", "problem", "legal_name", "registrable_domain", "employee_count_min")


@query(
    "src04_targets",
    "with n as (select *, row_number() over (order by c_custkey) + 1 line from customer) select line, case when c_custkey % 7 <> 0 then c_name end company_name, case when c_custkey % 7 <> 0 and c_custkey % 2 = 0 then 'c' || c_custkey || '.example' end canonical_domain, case when c_custkey % 7 = 0 then 'no company_name' end problem from n",
)
def _(t):
    """Customers in order as a target list with an unknown column; every seventh has a blank name."""
    c, spark = t("customer"), t("customer").sparkSession
    k = F.col("c_custkey")
    d = c.select(k, F.when(k % 2 == 0, F.concat(F.lit("c"), k, F.lit(".example"))).otherwise("").alias("canonical_domain"), F.lit("x, y").alias("note"), F.when(k % 7 == 0, "  ").otherwise(F.col("c_name")).alias("company_name"))
    path = io.scratch(spark, "targets")
    d.orderBy("c_custkey").coalesce(1).drop("c_custkey").write.option("header", True).csv(path)
    good, bad = io.read_cohort(spark, path)
    none = F.lit(None).cast("string")
    return good.select("line", "company_name", "canonical_domain", none.alias("problem")).unionByName(bad.select("line", none.alias("company_name"), none.alias("canonical_domain"), "problem"))


@query(
    "src05_bodies",
    "select page_id, sha256(html) body_sha256, case when substr(sha256(html), 1, 1) < '4' then 'PRUNED' else 'RETAINED' end state, case when substr(sha256(html), 1, 1) >= '4' then octet_length(encode(html)) end size, case when substr(sha256(html), 1, 1) >= '4' then sha256(html) end again from pages",
)
def _(t):
    """The bodies of all pages, stored in two batches of which one comes twice; a quarter of the digests is pruned."""
    p, spark = t("pages"), t("pages").sparkSession
    store = BodyStore(spark, io.scratch(spark, "bodies"), buckets=8)
    half = F.col("page_id") % 2
    for i in (0, 1, 0):
        store.put(p.where(half == i).select("page_id", "html"), "html", f"pages-{i}")
    wanted = p.select("page_id", F.sha2("html", 256).alias("body_sha256"))
    store.prune(wanted.where("body_sha256 < '4'").select("body_sha256"), F.lit("2024-05-01").cast("timestamp"), "first")
    store.vacuum()
    store.put(p.where(half == 0).select("page_id", "html"), "html", "pages-again")
    return store.status(wanted).select("page_id", "body_sha256", "state", "size", F.sha2("body", 256).alias("again"))


# --- universes, thresholds, history -----------------------------------------------------------------------------------


@query("sc14_members", _OBS_SQL + ' select metric_key, market_key from obs where "value" is not null')
def _(t):
    return sc.members_of(*sc.universe_members(observations(t))).select("metric_key", "market_key")


@query(
    "sc14_unions",
    _OBS_SQL + """, um as (select distinct metric_key, market_key from obs where "value" is not null), k as (select distinct metric_key from um)
select a.metric_key, b.metric_key other, count(distinct um.market_key) observed from k a, k b, um where a.metric_key < b.metric_key and um.metric_key in (a.metric_key, b.metric_key) group by 1, 2""",
)
def _(t):
    """Observed markets of every two metrics together, from their bitmaps."""
    members, _ = sc.universe_members(observations(t))
    members = io.staged(members, "universe")
    names = sorted(r["metric_key"] for r in members.select("metric_key").distinct().collect())
    pair = F.array(*(F.struct(F.lit(a).alias("metric_key"), F.lit(b).alias("other")) for i, a in enumerate(names) for b in names[i + 1 :]))
    d = members.withColumnRenamed("metric_key", "m").withColumn("p", F.explode(F.filter(pair, lambda p: (p["metric_key"] == F.col("m")) | (p["other"] == F.col("m")))))
    return d.groupBy("p", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("members")).alias("n")).groupBy("p").agg(F.sum("n").alias("observed")).select("p.*", "observed")


@query("sc26_thresholds", "select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then (o_orderkey % 100) / 100.0 end, case when o_custkey % 2 = 0 then 0.7 end, 0.5)::double least from orders")
def _(t):
    k = F.col("o_orderkey")
    request, model = F.when(k % 3 == 0, (k % 100) / 100.0), F.when(F.col("o_custkey") % 2 == 0, 0.7)
    return t("orders").select("o_orderkey", sc.resolve_threshold(request, model, 0.5).alias("least"))


@query(
    "rs45_timeline",
    """with e as (select *, case event_type when 'click' then event_id % 150 end target from events), r as (
select user_id source_id, 'RETRIEVAL' part, event_id ref_id, null::bigint other_id, row_number() over (partition by user_id order by ts desc, event_id) place from e where event_type not in ('view', 'click')
union all select user_id, 'DISCOVERY', event_id, null, row_number() over (partition by user_id order by ts, event_id) from e where event_type = 'view'
union all select user_id, 'OUT', event_id, target, row_number() over (partition by user_id order by ts, event_id) from e where event_type = 'click'
union all select target, 'IN', event_id, user_id, row_number() over (partition by target order by ts, event_id) from e where event_type = 'click' and target <> user_id) select * from r""",
)
def _(t):
    """Views discover a user, clicks lead from one to another, all else retrieves."""
    e = t("events").select("event_id", F.col("user_id").alias("source_id"), "event_type", "ts")
    f = e.where("event_type not in ('view', 'click')").select("source_id", F.col("event_id").alias("fetch_id"), F.col("ts").alias("fetched_at"))
    d = e.where("event_type = 'view'").select("source_id", F.col("event_id").alias("discovery_id"), F.col("ts").alias("discovered_at"))
    g = e.where("event_type = 'click'").select(F.col("event_id").alias("edge_id"), F.col("source_id").alias("from_id"), (F.col("event_id") % 150).alias("to_id"), F.col("ts").alias("observed_at"))
    return res.source_history(f, d, g).select("source_id", "part", "ref_id", "other_id", "place")


_DERIVED = """d as (select 'r' || n_regionkey p, 'n' || n_nationkey c from nation union select 'n' || c_nationkey, 'c' || c_custkey from customer union select 'c' || o_custkey, 'o' || o_orderkey from orders
union select 'o' || l_orderkey, 'p' || l_partkey from lineitem union select 'n' || s_nationkey, 's' || s_suppkey from supplier union select 's' || l_suppkey, 'p' || l_partkey from lineitem)"""


@query("rs45_lineage", f"with recursive {_DERIVED}, w as (select distinct p root_id, p artifact_id, 0 depth from d where p like 'r%' union select root_id, c, depth + 1 from w join d on p = artifact_id) select root_id, artifact_id, min(depth)::int depth from w group by 1, 2")
def _(t):
    """From region to part, over customers and orders or over suppliers: a part has many parents, at unlike depths."""
    key = lambda letter, c: F.concat(F.lit(letter), c)
    edge = lambda table, a, p, b, c: t(table).select(key(a, p).alias("parent_id"), key(b, c).alias("child_id"))
    d = edge("nation", "r", "n_regionkey", "n", "n_nationkey").union(edge("customer", "n", "c_nationkey", "c", "c_custkey")).union(edge("orders", "c", "o_custkey", "o", "o_orderkey"))
    d = d.union(edge("lineitem", "o", "l_orderkey", "p", "l_partkey")).union(edge("supplier", "n", "s_nationkey", "s", "s_suppkey")).union(edge("lineitem", "s", "l_suppkey", "p", "l_partkey"))
    return res.lineage_down(d, d.where("parent_id like 'r%'").select(F.col("parent_id").alias("root_id")))
