import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attesta.functions import columns as fn
from attesta.functions import config as cfg
from attesta.operators import relational as rel
from attesta.operators import validate as val
from attesta.plans import catalog
from attesta.plans import entities as ent
from attesta.plans import research as res
from attesta.plans import scoring as sc
from attesta.sources import io


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# --- ranks and percentiles --------------------------------------------------------------------------------------------


def test_competition_rank_and_gate(spark):
    df = spark.createDataFrame([("a", 80.0, 1.0, False), ("b", 80.0, 0.4, False), ("c", 72.0, 1.0, False), ("h", 99.0, 1.0, True), ("d", 80.0, 0.9, False), ("n", None, 1.0, False)], "market_key string, score double, coverage double, is_home_market boolean")
    got = {r["market_key"]: (r["rank"], r["unranked_reason"]) for r in rel.gated_rank(df, []).collect()}
    assert got == {"a": (1, None), "d": (1, None), "c": (3, None), "b": (None, "LOW_COVERAGE"), "h": (None, "HOME_MARKET"), "n": (None, "NO_SCORE")}


@pytest.mark.parametrize("method", rel.PERCENTILE_METHODS)
def test_percentiles(spark, method):
    values = [3.0, 1.0, 2.0, 2.0, None, 5.0]
    seen = [v for v in values if v is not None]
    n = len(seen)
    below, equal = (lambda x: sum(v < x for v in seen)), (lambda x: seen.count(x))
    want = {"midrank": lambda x: (below(x) + (equal(x) - 1) / 2) / (n - 1), "strict_below": lambda x: below(x) / n, "weak_below": lambda x: (below(x) + equal(x)) / n, "midpoint": lambda x: (below(x) + 0.5 * equal(x)) / n, "percentrank_inc": lambda x: below(x) / (n - 1)}[method]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", rel.percentile("v", [], method).alias("p")).collect()
    for r in got:
        assert r["p"] == (None if r["v"] is None else pytest.approx(want(r["v"])))


def test_positions_equal_the_windows(spark):
    """Percentiles and ranks dealt by range are those of a window, with ties, nulls, one value for most rows, and no key."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), None if i % 11 == 0 else 7.0 if i % 3 else float(rng.randrange(40))) for i in range(900)] + [(901, "c", 1.0), (902, "d", None)]
    df = spark.createDataFrame(rows, "i long, k string, v double").repartition(7)
    for by in (["k"], []):
        plain = df.select("i", rel.percentile("v", by).alias("p"), F.when(F.col("v").isNotNull(), F.rank().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("v")))).alias("r"))
        want = {r["i"]: (r["p"], r["r"]) for r in plain.collect()}
        got = {r["i"]: (r["p"], r["rank"]) for r in rel.with_percentile(rel.competition_rank(df, "v", by), "v", by, "p").collect()}
        assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and got[i][0] == (None if want[i][0] is None else pytest.approx(want[i][0])) for i in got)
    assert rel.positions(df.limit(0), ["k"], "v").count() == 0


def test_common_texts_multiply_nothing(spark):
    left = spark.createDataFrame([(i, "north air") for i in range(40)], "a long, x string")
    right = spark.createDataFrame([(100 - i, "north air") for i in range(60)] + [(500, "north airs")], "b long, y string")
    got = rel.fuzzy_join(left, right, "a", "x", "b", "y").collect()
    assert len(got) == 40 * 25 and {r["b"] for r in got} == set(range(41, 66)) and all(r["similarity"] == 1.0 for r in got)


def test_first_of_a_key_is_appended(spark):
    from pyspark.sql import functions as F

    new = spark.createDataFrame([(1, 5), (1, 3), (2, 9), (3, None), (3, 1)], "k long, v long").repartition(5)
    got = io.append_absent(new, new.where("k = 2"), ["k"], [F.desc("v")]).collect()
    assert sorted((r["k"], r["v"]) for r in got) == [(1, 5), (3, 1)]


def test_refusals(spark):
    from attesta.plans import scoring

    with pytest.raises(ValueError, match="nothing observed"):
        scoring.require_nonempty(spark.range(0), "nothing observed")
    assert scoring.require_nonempty(spark.range(2), "").count() == 2


def test_provider_json(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"external_id": "e1", "payload": {"legal_name": "A", "employees": {"min": 2}, "location": {"city": "X"}, "phone": "1"}}]')
    r = io.read_provider_json(spark, f"file://{tmp_path}/p.json").first()
    assert (r["external_id"], r["legal_name"], r["employees_min"], r["employees_max"], r["city"], r["website_domain"]) == ("e1", "A", 2, None, "X", None)


def test_fuzzy_join_is_exact(spark):
    rng = random.Random(2)
    words = ["north", "south", "norther", "air", "airco", "cool", "cooling", "services", "service"]
    names = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)]

    def grams(x):
        return {f"  {w} "[i : i + 3] for w in x.split() for i in range(len(w) + 1)}

    left, right = list(enumerate(names[:30])), list(enumerate(names[30:]))
    want = {}
    for (i, a), (j, b) in itertools.product(left, right):
        s = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        if s > 0.55:
            want.setdefault(i, []).append((-round(s, 9), j))
    want = {(i, j) for i, v in want.items() for _, j in sorted(v)[:5]}
    got = rel.fuzzy_join(spark.createDataFrame(left, "l int, a string"), spark.createDataFrame(right, "r int, b string"), "l", "a", "r", "b", k=5)
    assert {(x["l"], x["r"]) for x in got.collect()} == want


def test_chain_and_heads(spark):
    d = spark.createDataFrame([(i, i - 1 if i % 10 else None) for i in range(40)], "decision_id int, supersedes_decision_id int")
    assert rows(rel.heads(d), "decision_id") == rows(d.where("decision_id % 10 = 9"), "decision_id")
    assert all((r["root"], r["depth"]) == (r["decision_id"] // 10 * 10, r["decision_id"] % 10) for r in rel.chain(d).collect())


def test_long_chain(spark):
    n = 700
    d = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(5001, 9000), (5002, 5001)], "decision_id int, supersedes_decision_id int")
    got = {r["decision_id"]: (r["root"], r["depth"]) for r in rel.chain(d).collect()}
    assert got == {**{i: (0, i) for i in range(n)}, 5001: (9000, 1), 5002: (9000, 2)}
    with pytest.raises(ValueError, match="cycle"):
        rel.chain(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], d.schema))


def test_vocabulary():
    assert rel.coerce_vocab(" high ", ["HIGH", "LOW"]) == "HIGH"
    with pytest.raises(ValueError, match="none of"):
        rel.coerce_vocab("x", ["HIGH"])


# --- scores -----------------------------------------------------------------------------------------------------------


def test_unknown_is_not_zero(spark):
    obs = [(m, k, float(v), "FACT", "DATE", None) for m, k, v in [("a", "innovation_digital_proxy", 1), ("b", "innovation_digital_proxy", 2), ("a", "real_gdp_growth", 1), ("b", "real_gdp_growth", 2), ("c", "real_gdp_growth", 3)]]
    df = spark.createDataFrame(obs, "market_key string, metric_key string, value double, fact_type string, granularity string, label string")
    got = {r["market_key"]: r for r in sc.native_recalculation(df, F.lit(False)).collect()}
    assert got["c"]["score"] == 100.0 and got["c"]["coverage"] == 0.05 and got["c"]["rank"] is None
    assert got["b"]["coverage"] == 0.25 and got["b"]["score"] == pytest.approx((20 + 2.5) / 25 * 100)


def test_golden_entry(spark):
    df = entry.entry(spark)
    assert {"market_key", "score", "rank", "coverage"} <= set(df.columns) and df.count() > 0


def test_snapshots(spark):
    stored = spark.createDataFrame([("k1", "d1")], "snapshot_key string, digest string")
    new = spark.createDataFrame([("k1", "d1"), ("k1", "d2"), ("k2", "d3")], "snapshot_key string, digest string")
    assert rows(sc.classify_snapshots(new, stored), "digest", "status") == [("d1", "NOOP"), ("d2", "CONFLICT"), ("d3", "NEW")]


# --- entities ---------------------------------------------------------------------------------------------------------


def test_intervals(spark):
    rows_ = [(1, "x", "2020-01-01", None, "ASSERTS", 1), (1, "x", "2020-01-01", "2022-01-01", "ASSERTS", 2), (1, "x", "2020-01-01", None, "ASSERTS", 3), (1, "y", "2020-01-01", None, "ASSERTS", 4), (1, "y", "2020-01-01", None, "RETRACTS", 5), (1, "y", "2021-01-01", None, "ASSERTS", 6), (2, "x", None, None, "ASSERTS", 7)]
    c = spark.createDataFrame(rows_, "company_id int, market string, f string, t string, assertion string, claim_id int").withColumns({"valid_from": F.to_date("f"), "valid_to": F.to_date("t")})
    got = rows(ent.project_presences(c, ["company_id", "market"]).selectExpr("company_id", "market", "string(effective_from) f", "string(effective_to) t"), "company_id", "market", "f", "t")
    # silence closes nothing, and a retraction takes its own interval alone
    assert got == [(1, "x", "2020-01-01", "2022-01-01"), (1, "y", "2021-01-01", None), (2, "x", "1900-01-01", None)]


def test_resolution_tiers(spark):
    r = spark.createDataFrame([(1, "Acme Ltd", "acme.com"), (2, "Acme", None), (3, None, None), (4, "New", "new.org"), (5, "Z", "site.wixsite.com")], "record_id int, name string, domain string")
    c = spark.createDataFrame([(9, "Acme", "acme.com", "IDENTITY", "ACTIVE")], "company_id int, name string, domain string, role string, lifecycle string")
    none = r.select("record_id").limit(0)
    cand = ent.score_candidates(r, c, c)
    got = {x["record_id"]: (x["decision"], x["method"]) for x in ent.resolve(r, none, ent.match_domain(r, c), cand, none).collect()}
    assert got == {1: ("MATCHED", "domain"), 2: ("AMBIGUOUS", "candidate"), 3: ("AMBIGUOUS", "no_identifiers"), 4: ("CREATED_NEW", "new"), 5: ("CREATED_NEW", "new")}
    low = ent.resolve(r, none, ent.match_domain(r, c), cand, none, auto=0.5)
    assert {x["decision"] for x in low.where("record_id = 2").collect()} == {"MATCHED"}
    assert ent.resolve(r, r.select("record_id"), ent.match_domain(r, c), cand, none).count() == 0


def test_rebuild_is_equal(spark, data):
    table = lambda n: io.load(spark, data, n)
    a, b = ent.project_domains(catalog.page_claims(table).withColumn("attribute_key", F.lit("website_domain"))), ent.project_domains(catalog.page_claims(table).repartition(3).withColumn("attribute_key", F.lit("website_domain")))
    assert rel.rebuild_diff(a, b).count() == 0
    assert len({r["digest"] for r in ent.projection_report({"a": a, "b": b}).collect()}) == 1


def test_append_and_prune(spark):
    new = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert rows(io.append_absent(new, new.where("k = 2"), ["k"]), "k") == [(1,)]
    t = spark.createDataFrame([(1, "p", "RETAINED", None), (2, "q", "RETAINED", None), (3, None, "PRUNED", "2020")], "k int, payload string, retention_state string, pruned_at string")
    plan = spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(io.apply_prune(t, plan, "k", "payload", F.lit("2024")), "k", "payload", "retention_state", "pruned_at") == [(1, None, "PRUNED", "2024"), (2, "q", "RETAINED", None), (3, None, "PRUNED", "2020")]
    assert rows(io.upsert_latest(new.distinct(), spark.createDataFrame([(1, "z")], "k int, v string"), ["k"], [F.desc("v")]), "k", "v") == [(1, "z"), (2, "b")]


# --- research ---------------------------------------------------------------------------------------------------------


def test_rules_keep_their_places(spark):
    text = "We run 12 field technicians; approximately 30 technicians; a fleet of 7 service vehicles. 12 field technicians. Preventive Maintenance."
    got = res.run_rules(spark.createDataFrame([(1, text)], "id int, text string"), res.RULES).collect()
    assert {r["attribute_key"] for r in got} == {"technician_count", "field_workforce_present", "fleet_size", "preventive_maintenance"}
    assert all(text[r["start"] : r["end"]] == r["quote"] for r in got)
    starts = sorted(r["start"] for r in got if r["rule_id"] == "technicians")
    assert len(starts) == 2 and json.loads([r for r in got if r["rule_id"] == "technicians_about"][0]["value_json"]) == {"min": 30, "max": 30}


def test_json_extractors(spark):
    post = json.dumps({"job_id": "j", "employer": "e", "title": "t", "posted_at": "2024-05", "responsibilities": ["a", "b"]})
    reg = json.dumps({"jurisdiction": "OH", "entity_number": "7", "legal_name": "L", "principal_address": {"city": "C"}})
    df = spark.createDataFrame([(1, post), (2, reg), (3, "{broken")], "id int, text string")
    assert rows(res.extract_postings(df).selectExpr("id", "responsibility r", "posted.granularity g"), "id", "r", "g") == [(1, "a", "MONTH"), (1, "b", "MONTH")]
    assert rows(res.extract_registry(df), "id", "entity_number", "city") == [(2, "7", "C")]
    texts = df.withColumn("media_type", F.lit("application/json")).where("id < 3")
    ex = [{"extractor_id": "p", "media_type": "application/json", "required": ["job_id"]}, {"extractor_id": "any", "media_type": "application/json", "required": []}]
    assert rows(res.applicable_extractors(texts, ex), "id", "extractor_id") == [(1, "any"), (1, "p"), (2, "any")]


def test_graph(spark):
    pages = spark.createDataFrame([("https://a.com/", '<a href="/services">s</a><a href="https://b.com/x">x</a><link rel="canonical" href="https://a.com/home"><link rel="alternate" hreflang="de" href="https://a.com/de">'), ("https://a.com/services", '<a href="/services/hvac">h</a><a href="/">home</a>')], "url string, html string")
    links = res.extract_links(pages)
    assert rows(links.where("in_scope and relevant"), "locator") == [("https://a.com/",), ("https://a.com/services",), ("https://a.com/services/hvac",)]
    reach = res.expand(links.where("in_scope"), spark.createDataFrame([(1, "https://a.com/")], "company_id int, locator string"), 2)
    assert rows(reach, "depth", "locator") == [(0, "https://a.com/"), (1, "https://a.com/services"), (2, "https://a.com/services/hvac")]
    assert rows(res.declared_edges(pages), "edge_type", "to_locator") == [("CANONICAL", "https://a.com/home"), ("LANGUAGE", "https://a.com/de")]
    maps = spark.createDataFrame([("i", "<sitemapindex><loc>m</loc></sitemapindex>"), ("m", "<urlset><loc> u1 </loc><loc>u2</loc></urlset>")], "url string, body string")
    assert rows(res.sitemap_urls(maps), "sitemap", "loc") == [("i", "u1"), ("i", "u2"), ("m", "u1"), ("m", "u2")]


def test_bodies_of_304(spark):
    f = spark.createDataFrame([(1, "s", 1, "OK", "b1"), (2, "s", 2, "NOT_MODIFIED", None), (3, "s", 3, "OK", "b2"), (4, "s", 4, "NOT_MODIFIED", None), (5, "s", 5, "GONE", None)], "fetch_id int, source_id string, fetched_at int, outcome string, body_sha256 string")
    assert [r["body_ref"] for r in res.web_bodies(f).orderBy("fetch_id").collect()] == ["b1", "b1", "b2", "b2", None]


def test_signals(spark):
    new = spark.createDataFrame([(1, "Late  invoices"), (1, "late invoices "), (2, "x")], "company_id int, concern string")
    none = spark.createDataFrame([], "occurrence_id string, signal_id string, number int")
    ev = spark.createDataFrame([], "occurrence_id string, event_kind string, occurred_at int, event_id int")
    first = res.raise_signals(new, none, ev)
    assert first.count() == 2
    occ = first.select(F.lit("o1").alias("occurrence_id"), "signal_id", "number").where("number = 1").limit(1)
    open_ = spark.createDataFrame([("o1", "OPEN", 1, 1)], ev.schema)
    occ = spark.createDataFrame(occ.collect(), none.schema)
    assert res.raise_signals(new, occ, open_).count() == 1
    again = res.raise_signals(new, occ, open_.union(spark.createDataFrame([("o1", "DISMISSED", 2, 2)], ev.schema)))
    assert sorted(r["number"] for r in again.collect()) == [1, 2]


def test_lifecycle(spark):
    ev = [("g", 1, "RAISED", 1), ("g", 2, "ATTEMPTED", 2), ("g", 3, "RESOLVED", 2), ("g", 4, "ATTEMPTED", 3), ("h", 5, "ATTEMPTED", 1)]
    df = spark.createDataFrame(ev, "key string, event_id long, event_kind string, occurred_at long")
    assert rows(val.illegal_transitions(df, "key", cfg.GAP_GRAPH, cfg.GAP_RANK), "event_id") == [(4,), (5,)]
    assert rows(res.current_status(df, "key", cfg.GAP_RANK), "key", "event_kind") == [("g", "ATTEMPTED"), ("h", "ATTEMPTED")]


def test_validations(spark):
    c = spark.createDataFrame([("a", -1.0), ("a", 25.0), ("b", 1.0), ("z", 1.0)], "component string, value double")
    assert rows(val.bound_violations(c, {"a": 20.0, "b": 5.0}), "component", "violation") == [("a", "above_weight"), ("a", "below_zero"), ("z", "unknown_component")]
    claims = spark.createDataFrame([("n", '{"min":5,"max":3}', "FACT"), ("n", '{"min":1}', "FACT"), ("q", "{}", "FACT"), ("n", '{"min":1,"max":2}', "GUESS")], "attribute_key string, value_json string, fact_type string")
    reg = spark.createDataFrame([("n", "RANGE", ["FACT"])], "attribute_key string, kind string, fact_types array<string>")
    assert sorted(r["violation"] for r in val.registry_violations(claims, reg).collect()) == ["fact_type", "range_order", "range_without_bounds", "unknown_attribute"]
    f = spark.createDataFrame([("OK", None, None), ("GONE", "b", None), ("NOT_MODIFIED", None, None), ("OK", "b", None)], "outcome string, body_sha256 string, validated_body string")
    assert sorted(r["violation"] for r in val.fetch_violations(f).collect()) == ["body_on_failure", "not_modified_without_body", "ok_without_body"]


# --- sources and streams ----------------------------------------------------------------------------------------------


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"metadata": {"title": "t", "universe_size": 3}, "source_catalog": {"s1": {"title": "x"}}, "markets": [{"country": "A", "raw": {"gdp": 1.0}, "rank": 1}], "home_market_benchmark": {"country": "H"}, "excluded_from_top50_but_in_normalization_universe": [{"country": "E"}]}))
    (tmp_path / "bad.json").write_text("{nope")
    t = io.read_snapshot(spark, str(tmp_path / "*.json"))
    assert [t[k].count() for k in ("markets", "home", "excluded", "sources", "rejects")] == [1, 1, 1, 1, 1]
    (tmp_path / "p.csv").write_text("company,domain,country,city,zip,staff_min,staff_max\nA, a.com,US,,1,5,x\n")
    r = io.read_provider_csv(spark, str(tmp_path / "p.csv")).first()
    assert (r["legal_name"], r["website_domain"], r["city"], r["employees_min"], r["employees_max"]) == ("A", "a.com", None, 5, None)
    (tmp_path / "c.csv").write_text("company_name,other\nA,1\n ,2\n")
    good, bad = io.read_cohort(spark, str(tmp_path / "c.csv"))
    assert (good.count(), bad.count()) == (1, 1)
    with pytest.raises(ValueError, match="company_name"):
        io.read_cohort(spark, str(tmp_path / "p.csv"))
    assert io.read_bodies(spark, str(tmp_path / "p.csv")).first()["size"] > 10


def test_entry_points_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.QUERIES) > 60


def test_expansion_of_stored_pages(spark, tmp_path):
    page = lambda i, url, *hrefs: (i, url, "".join(f'<a href="{h}">x</a>' for h in hrefs))
    pages = [page(1, "https://a.com/", "/b", "https://b.com/"), page(2, "https://a.com/b", "/c"), page(3, "https://a.com/c", "/d"), page(4, "https://z.org/q", "/r")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["rs04_pages"](spark, str(tmp_path))
    assert rows(got, "host", "locator", "depth") == [("a.com", "https://a.com/", 0), ("a.com", "https://a.com/b", 1), ("a.com", "https://a.com/c", 2), ("z.org", "https://z.org/q", 0), ("z.org", "https://z.org/r", 1)]


def test_edges_of_and_require_nonempty(spark):
    d = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (2, 3)], "from_id int, to_id int")
    assert rows(rel.edges_of(d, 1), "from_id", "to_id") == [(1, 1), (1, 2), (2, 1)]
    assert sc.require_nonempty(d, "no edges") is d
    with pytest.raises(ValueError, match="no edges"):
        sc.require_nonempty(d.limit(0), "no edges")


def test_json_equality_ignores_order_and_spaces(spark):
    d = spark.createDataFrame([('{"a":1,"b":[1,2]}', '{ "b":[1, 2], "a":1 }'), ('{"a":1}', '{"a":2}'), (None, None), (None, "{}"), ("{x", "{x"), ("[1,2]", "[2,1]")], "a string, b string")
    assert [r[0] for r in d.select(fn.json_equal("a", "b")).collect()] == [True, False, True, False, True, False]


def test_redirects_are_edges(spark):
    pages = spark.createDataFrame([("https://a.com/x", '<link rel="canonical" href="https://a.com/y">')], "url string, html string")
    fetches = spark.createDataFrame([("https://a.com/o", "https://a.com/n"), ("https://a.com/s", "https://a.com/s#t"), ("https://a.com/z", None)], "url string, redirect_to string")
    got = res.declared_edges(pages, fetches=fetches)
    assert rows(got, "from_locator", "to_locator", "edge_type") == [("https://a.com/o", "https://a.com/n", "REDIRECT"), ("https://a.com/x", "https://a.com/y", "CANONICAL")]


def test_seeding_twice_adds_nothing(spark):
    first = cfg.seed_tables(spark, {})
    again = cfg.seed_tables(spark, first)
    assert all(d.isEmpty() for d in again.values())
    part = cfg.seed_tables(spark, {**first, "trust": first["trust"].where("source_class <> 'NEWS'")})
    assert rows(part["trust"], "source_class", "trust") == [("NEWS", 0.7)]
    assert first["base_model"].count() == len(set(cfg.BASE_MODEL))


def test_declared_edges_in_any_order_of_attributes(spark):
    html = """<link href=c rel='shortcut canonical'><link rel="canonical" href="/late"><LINK
    hreflang='de' data-href="/no" href="../de" REL="alternate"><link rel=alternate href=/feed><link rel="canonical"><a rel=canonical href=/a>"""
    pages = spark.createDataFrame([("https://a.com/x/y", html), ("https://a.com/z", '<link rel="canonical" href="#top">'), ("https://a.com/n", None), ("https://a.com/e", "")], "url string, html string")
    assert rows(res.declared_edges(pages), "from_locator", "to_locator", "edge_type") == [("https://a.com/x/y", "https://a.com/de", "LANGUAGE"), ("https://a.com/x/y", "https://a.com/x/c", "CANONICAL")]


def test_evidence_of_another_body_is_a_violation(spark):
    obs = spark.createDataFrame([(1, 10, 20, 5), (2, 10, 21, 5), (3, 11, 20, 5), (4, 99, 98, 5), (5, 10, 20, None)], "extraction_id int, fetch_id int, text_id int, body_id int")
    fetches = spark.createDataFrame([(10, 5), (11, None)], "fetch_id int, body_id int")
    derivations = spark.createDataFrame([(20, 5), (21, 6)], "text_id int, body_id int")
    got = rows(res.evidence_provenance(obs, fetches, derivations), "extraction_id", "violation")
    assert got == [(2, "DERIVATION_BODY"), (3, "FETCH_BODY"), (4, "DERIVATION_BODY"), (4, "FETCH_BODY"), (5, "DERIVATION_BODY"), (5, "FETCH_BODY")]


def test_fingerprints_own_their_rules(spark):
    d = spark.createDataFrame([(1, ["b", "a", "a"], " Late  Pay "), (1, ["a", "b"], "late pay")], "id int, xs array<string>, concern string")
    for c in (fn.assertion_fingerprint("id", origins="xs"), fn.signal_fingerprint("id", "concern")):
        assert d.select(c.alias("h")).distinct().count() == 1
    plans = spark.createDataFrame([(["x", "y"],), (["y", "x"],)], "xs array<string>").select(fn.plan_hash(F.lit(1), targets="xs").alias("h"))
    assert plans.distinct().count() == 1
    readings = [("a", "1", None), ("b", "1", None), ("a", "2", None), ("a", "1", "t")]
    o = spark.createDataFrame(readings, "k string, v string, tag string")
    assert o.select(fn.observation_fingerprint("k", "v", F.lit("u"), F.lit("FACT"), F.lit("h"), F.lit("DIRECT"), "tag").alias("h")).distinct().count() == 4


def test_edges_of_many_nodes(spark):
    r = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 5), (None, 1)], "from_id int, to_id int")
    n = spark.createDataFrame([(1,), (3,), (3,), (None,)], "id int")
    got = {(x["id"], x["from_id"], x["to_id"], x["outward"]) for x in rel.edges_of_each(r, n, "id").collect()}
    assert got == {(1, 1, 2, True), (1, 2, 1, False), (3, 3, 3, True), (1, None, 1, False)} and rel.edges_of_each(r, n, "id").count() == 4


def test_positions_with_many_rows_without_a_value(spark):
    d = spark.range(0, 400, 1, 8).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 8).alias("x"))
    got = rel.with_percentile(d, "x", [], "p").groupBy("x", "p").count().collect()
    assert {(r["x"], None if r["p"] is None else round(r["p"], 6), r["count"]) for r in got} == {(None, None, 300), (0, round(24.5 / 99, 6), 50), (4, round(74.5 / 99, 6), 50)}


def test_contextual_scores_of_large_keys(spark, tmp_path):
    """Supplier keys on both sides of each step of the ladders, as in larger tables, against the SQL."""
    import duckdb

    from attesta.plans import catalog

    keys = [1, 7, 249, 751, 1502, 2999, 3001, 3003, 5999, 6001, 40_001, 60_002]
    spark.createDataFrame([(k, f"s{k}", k % 25, float(k % 9000)) for k in keys], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"file://{tmp_path}/supplier.parquet")
    got = catalog.QUERIES["sc24_contextual"](spark, f"file://{tmp_path}").collect()
    c = duckdb.connect()
    c.execute(f"create view supplier as from '{tmp_path}/supplier.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(c.execute(catalog.ORACLES["sc24_contextual"]).fetchall())


def test_fuzzy_join_shuffles_no_failing_pairs(spark, monkeypatch):
    """600 texts that all share a word, in blocks of 50: the best of each, and no staged table holds pairs beyond the best."""
    monkeypatch.setattr(rel, "_MEET", 50)
    staged, kept = rel.io.staged, []
    monkeypatch.setattr(rel.io, "staged", lambda df, name: kept.append((name, staged(df, name))) or kept[-1][1])
    texts = [(i, f"common {i * 7919 % 1000:03d}x{i % 7} {i * 104729 % 997:03d}") for i in range(600)]
    d = spark.createDataFrame(texts, "a long, x string")
    out = rel.fuzzy_join(d, d.toDF("b", "y"), "a", "x", "b", "y", k=3)
    g = {i: {w[j : j + 3] for w in (f"  {v} " for v in x.split()) for j in range(len(w) - 2)} for i, x in texts}
    sim = lambda a, b: len(g[a] & g[b]) / len(g[a] | g[b])
    want = {a: sorted((-s, b) for b in g if (s := sim(a, b)) > 0.55)[:3] for a in g}
    assert sorted(map(tuple, out.collect())) == sorted((a, b, -s) for a in want for s, b in want[a])
    assert dict(kept)["best-texts"].count() <= 3 * 600


def test_spread_grows_with_the_scan(spark, tmp_path):
    """A table of more splits is dealt to more parts, rows of a key together."""
    spark.range(4000).selectExpr("id % 50 as k", "id").repartition(6).write.parquet(f"file://{tmp_path}/t")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        d = spark.read.parquet(f"file://{tmp_path}/t")
        assert d.rdd.getNumPartitions() >= 6
        out = rel.spread(d, "k")
        assert out.rdd.getNumPartitions() == 32 * d.rdd.getNumPartitions()
        assert out.count() == 4000 and out.select("k", F.spark_partition_id()).distinct().count() == 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_chain_violations_deal_their_links(spark, monkeypatch):
    """Every kind of violation, from links that are dealt by parent into parts of their own."""
    dealt, spread = [], rel.spread
    monkeypatch.setattr(rel, "spread", lambda df, *keys: dealt.append(keys) or spread(df, *keys))
    d = spark.createDataFrame([(1, None, 1), (2, 1, 1), (3, 1, 1), (4, 4, 2), (5, None, 3), (6, 5, 1)], "decision_id long, supersedes_decision_id long, record_id long")
    got = sorted(map(tuple, val.chain_violations(d).collect()))
    assert got == [("1", "children"), ("2", "roots"), ("4", "self"), ("6", "entity")]
    assert dealt == [("supersedes_decision_id",)] * 2


def test_fuzzy_join_counts_pairs_in_blocks(spark, monkeypatch):
    """900 texts of few syllables against 700, in blocks, with text ids and a null one: as by brute force, and no join makes the pairs."""
    import re

    monkeypatch.setattr(rel, "_MEET", 150)
    staged, plans = rel.io.staged, {}
    monkeypatch.setattr(rel.io, "staged", lambda df, name: plans.update({name: df._jdf.queryExecution().toString()}) or staged(df, name))
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "an", "ed", "er", "ou", "ñ", "re"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(1100)]
    left = [(i, rng.choice(texts)) for i in range(900)] + [(900, "ñ"), (901, "")]
    right = [(None if i == 3 else f"é{i % 650}", rng.choice(texts)) for i in range(700)]
    got = rel.fuzzy_join(spark.createDataFrame(left, "a long, x string"), spark.createDataFrame(right, "b string, y string"), "a", "x", "b", "y", k=4).collect()
    grams = {t: {w[j : j + 3] for v in re.split("[^a-z0-9]+", t) if v for w in [f"  {v} "] for j in range(len(w) - 2)} for _, t in left + right}
    first = lambda b: (b is not None, (b or "").encode())
    want, cache = [], {}
    for a, x in left:
        if x not in cache:
            alike = [(len(grams[x] & grams[y]) / len(grams[x] | grams[y]), b) for b, y in right if grams[x] and grams[y]]
            cache[x] = sorted(((-s, first(b), b) for s, b in alike if s > 0.55), key=lambda r: r[:2])[:4]
        want += [(a, r[2] or "", -r[0]) for r in cache[x]]
    assert len(want) > 900 and sorted((r["a"], r["b"] or "", r["similarity"]) for r in got) == sorted(want)
    assert "FlatMapCoGroupsInArrow" in plans["best-texts"]
