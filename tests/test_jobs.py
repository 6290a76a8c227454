import random
import re
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from attesta.functions import columns as fn
from attesta.functions import config as cfg
from attesta.operators import relational as rel
from attesta.plans import catalog_jobs
from attesta.plans import research as res
from attesta.plans import scoring as sc
from attesta.plans import witnesses as wit
from attesta.sources import io, providers
from attesta.sources.bodies import BodyStore
from attesta.streaming import jobs
from attesta.streaming.sink import BucketedSink


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_references_resolve_as_the_standard_says(spark):
    """The examples of RFC 3986 section 5.4, and pages with and without folders and queries."""
    refs = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/./x", "a//b/../c", "//h/a/../b", "https://h.x/a/./b/../c?d#e", "mailto:a@b", "/", "?"]
    bases = ["http://a/b/c/d;p?q", "http://a", "https://a.com/x/y", "https://a.com/x/y/?k=v", "http://a/?q=/x/y"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    got = {(r["b"], r["r"]): r["u"] for r in df.withColumn("u", fn.resolve_reference("b", "r")).collect()}
    for (b, r), u in got.items():
        if r == "a//b/../c":  # the library joins double slashes, the standard does not
            assert u.endswith("/a//c")
        elif r in ("//h/a/../b", "https://h.x/a/./b/../c?d#e"):  # nor does it clean the path of another host
            assert u == (b.split(":")[0] + "://h/b" if r[0] == "/" else "https://h.x/a/c?d")
        elif r == "?":  # the library takes an empty query for none
            assert u == b.split("?")[0] + "?"
        else:
            assert u == urldefrag(urljoin(b, r)).url, (b, r)


def test_link_report(spark):
    html = '<a href="z">1</a><A class=x HREF = \'../w\'>2</A><a href="/p#top">3</a><a href="#top"><a href="mailto:x@a.com"><a href="javascript:f()"><a href="//b.org/x"><a href="/x/y"><a href="https://www.a.com/services"><a href="//"><area href="no"><a data-href="no" href="/services/hvac">'
    page = spark.createDataFrame([("https://a.com/x/y", html), ("https://a.com/x/y", html), ("https://n.com/", None)], "url string, html string")
    got = {r["href"]: (r["locator"], r["reason"]) for r in res.link_report(page).collect()}
    assert got["z"][0] == "https://a.com/x/z" and got["../w"][0] == "https://a.com/w" and got["/p#top"][0] == "https://a.com/p"
    assert got["#top"] == (None, "FRAGMENT") and got["mailto:x@a.com"] == (None, "SCHEME") and got["javascript:f()"] == (None, "SCHEME") and got["//"] == (None, "HOST")
    assert got["//b.org/x"] == ("https://b.org/x", "OUT_OF_SCOPE") and got["/services/hvac"] == ("https://a.com/services/hvac", None) and got["https://www.a.com/services"][1] is None
    assert "no" not in got and len(got) == 11 and res.link_report(page).count() == 11
    assert rows(res.extract_links(page).where("in_scope"), "locator")[0] == ("https://a.com/p",)


def test_seeding_goes_by_key(spark):
    stored = {"fact_factor": spark.createDataFrame([("FACT", 0.9)], "fact_type string, factor double")}
    got = cfg.seed_tables(spark, stored)
    assert "FACT" not in {r["fact_type"] for r in got["fact_factor"].collect()} and got["fact_factor"].count() == len(cfg.FACT_FACTOR) - 1
    assert got["gap_graph"].count() == len(cfg.GAP_GRAPH)
    new = spark.createDataFrame([(None, 2), (None, 1), (1, 5), (2, 6)], "k int, v int")
    assert rows(cfg.absent_rows(new, new.where("k = 1"), ["k"]), "k", "v") == [(2, 6), (None, 1)]
    assert cfg.absent_rows(new, cfg.absent_rows(new, new.limit(0), ["k"]), ["k"]).count() == 0


# --- witnesses --------------------------------------------------------------------------------------------------------


def matching(edges):
    """The size of a greatest matching: augmenting paths, one publisher after another."""
    docs, owner = {}, {}
    for p, d in edges:
        docs.setdefault(p, []).append(d)

    def place(p, seen):
        for d in docs[p]:
            if d not in seen:
                seen.add(d)
                if d not in owner or place(owner[d], seen):
                    owner[d] = p
                    return True
        return False

    return sum(place(p, set()) for p in docs)


def test_witnesses(spark):
    rng = random.Random(3)
    groups = {"known": [("A", "1"), ("A", "2"), ("B", "2"), ("B", "3"), ("C", "3")], "one": [("A", "1")], "star": [("A", str(i)) for i in range(5)], "copy": [(p, "1") for p in "ABCD"], None: [("A", "1"), ("B", "1")]}
    for i in range(20):
        n = rng.randint(2, 12)
        groups[f"g{i}"] = list({(f"p{rng.randrange(n)}", f"d{rng.randrange(n)}") for _ in range(rng.randint(1, 4 * n))})
    groups["long"] = [(f"p{i}", f"d{j}") for i in range(12) for j in (i, i + 1) if j < 12] + [("x", "d0"), ("x", "d1")]  # a path that must be turned over
    groups["dense"] = [(f"p{i}", f"d{(i * j) % 17}") for i in range(30) for j in range(1, 4)]
    df = spark.createDataFrame([(g, p, d) for g, es in groups.items() for p, d in es] + [("void", None, "d"), ("known", "Z", None)], "g string, publisher string, document string")
    got = {r["g"]: r["witnesses"] for r in res.independent_witnesses(df.union(df), ["g"]).collect()}
    assert got["known"] == 3 and got == {g: matching(es) for g, es in groups.items()}
    assert res.independent_witnesses(df.limit(0), ["g"]).count() == 0


def test_cover_proves_the_matching(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(g, rng.randrange(12), rng.randrange(9)) for g in "ab" for _ in range(50)], "g string, publisher int, document int")
    pairs, edges = wit.witness_pairs(df, ["g"])
    m = pairs.collect()
    assert len({(r["g"], r["p"]) for r in m}) == len(m) == len({(r["g"], r["d"]) for r in m})
    every = {(r["g"], r["p"], r["d"]) for r in edges.collect()}
    assert {(r["g"], r["p"], r["d"]) for r in m} <= every
    cover = {(r["g"], r["side"], r["node"]) for r in wit.witness_cover(pairs, edges).collect()}
    assert len(cover) == len(m) and all((g, "publisher", p) in cover or (g, "document", d) in cover for g, p, d in every)
    with pytest.raises(ValueError, match="augmenting"):
        wit.witness_cover(pairs.limit(3), edges)


# --- streams ----------------------------------------------------------------------------------------------------------


def test_sink_is_idempotent(spark, tmp_path):
    out = BucketedSink(spark, f"file://{tmp_path}/out", "k int, v string", ["k"], buckets=4)
    a = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (None, "n"), (None, "m")], "k int, v string")
    assert out.read().count() == 0 and out.write(a, "s-0") and not out.write(a.limit(0), "s-0") and not out.write(a, "s-0")
    assert rows(out.read(), "k", "v") == [(1, "a"), (2, "b"), (None, "m")]
    assert out.write(a.withColumn("v", F.lit("z")), "s-1") and out.write(a.limit(0), "s-2")  # nothing new, nothing at all
    assert out.read().count() == 3 and out.manifests()["s-1"]["rows"] == 0
    more = spark.createDataFrame([(i, "x") for i in range(20)], "k int, v string")
    assert out.write(more, "s-3") and out.read().count() == 21
    name = out.compact()
    assert out.live() == [name] and out.read().count() == 21 and out.compact() is None
    assert not out.write(more, "s-3") and out.write(more, "s-4") and out.read().count() == 21


def test_a_crash_between_write_and_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    out = BucketedSink(spark, f"file://{tmp_path}/out", "k int, v string", ["k"], buckets=4)
    a, b = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string"), spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    out.write(a.where("k = 1"), "s-00")
    out.write(a, "s-0")
    with monkeypatch.context() as m:
        m.setattr(out, "commit", lambda *_, **__: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            out.write(b.union(a.withColumn("k", F.lit(9))), "s-1")
        with pytest.raises(ZeroDivisionError):
            out.compact()
    assert rows(out.read(), "k", "v") == [(1, "a"), (2, "a")]
    assert out.write(b, "s-1") and rows(out.read(), "k", "v") == [(1, "a"), (2, "a"), (3, "b")]


def test_only_touched_buckets_are_read(spark, tmp_path):
    out = BucketedSink(spark, f"file://{tmp_path}/out", "k int", ["k"], buckets=8)
    out.write(spark.range(200).select(F.col("id").cast("int").alias("k")), "s-0")
    d = out._stored([3])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+[^\]]* 3", plan) and out.read().count() == 200
    assert {r["f"].split("bucket=")[1][0] for r in d.select(F.input_file_name().alias("f")).distinct().collect()} == {"3"}


def test_stream_ingest_restarts(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    out = BucketedSink(spark, f"file://{tmp_path}/out", "k int, v string", ["k"], buckets=4)
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    for run in range(3):
        (a if run else a.limit(2)).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_ingest(jobs.replay(spark, src, "k int, v string"), out, f"file://{tmp_path}/ckpt").awaitTermination(90)
    assert rows(out.read(), "k", "v") == [(1, "a"), (2, "b")] and set(out.manifests()) == {"stream-0", "stream-1", "stream-2"}


def test_status_of_events_out_of_order(spark, tmp_path):
    """A key's events in the wrong order within the delay, a terminal status, a tie broken by place, a null key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema, src = "key string, event_id long, event_kind string, minute int", f"file://{tmp_path}/ev"
        batches = [
            [("g", 2, "RESOLVED", 5), ("h", 3, "ATTEMPTED", 1), (None, 4, "RAISED", 2)],
            [("g", 1, "RAISED", 3), ("g", 5, "ATTEMPTED", 5), ("h", 6, "RAISED", 7), ("g", None, "RAISED", 1)],
            [("x", 7, "CLOSE", 100)],
            [("g", 8, "ATTEMPTED", 101), ("h", 9, "ABANDONED", 1)],  # the second is late, yet no later event of its key is judged
            [("x", 10, "CLOSE", 300)],
            [("x", 11, "CLOSE", 301)],
        ]
        for ev in batches:
            d = spark.createDataFrame(ev, schema)
            d.withColumn("occurred_at", F.timestamp_seconds(F.col("minute") * 60)).drop("minute").coalesce(1).write.mode("append").parquet(src)
        stream = jobs.replay(spark, src, "key string, event_id long, event_kind string, occurred_at timestamp")
        q = jobs.stream_status(stream, "10 minutes").writeStream.format("memory").queryName("status").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = rows(spark.table("status").where("event_id < 10 and event_kind <> 'CLOSE'"), "event_id", "previous", "accepted")
    assert got == [(1, None, True), (2, "ATTEMPTED", True), (3, None, False), (4, None, True), (5, "RAISED", True), (6, None, True), (8, "RESOLVED", False), (9, None, False)]


def test_state_is_by_buckets_of_keys(spark, tmp_path):
    """Many keys, among them null, with null and unknown kinds: judged as one after another, while state has a few rows a bucket."""
    rng, rank = random.Random(4), cfg.GAP_RANK
    kinds = [*rank, "OTHER", None]
    events = [(rng.choice([None, *map(str, range(700))]), i, rng.choice(kinds), rng.randint(1, 20)) for i in range(4000)]
    batches = [[e for e in events if e[3] <= 12], [e for e in events if e[3] > 12], [("x", -1, "CLOSE", 100)], [("x", -2, "CLOSE", 300)]]
    src, schema = f"file://{tmp_path}/ev", "key string, event_id long, event_kind string, minute int"
    for ev in batches:
        d = spark.createDataFrame(ev, schema)
        d.withColumn("occurred_at", F.timestamp_seconds(F.col("minute") * 60)).drop("minute").coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = jobs.replay(spark, src, "key string, event_id long, event_kind string, occurred_at timestamp")
        q = jobs.stream_status(stream, "10 minutes", buckets=5).writeStream.format("memory").queryName("many").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    status, want = {}, []
    for key, i, kind, _ in sorted(events, key=lambda e: (e[3], rank.get(e[2], 99), e[1])):
        accepted = (status.get(key), kind) in cfg.GAP_GRAPH
        want.append((i, key, kind, status.get(key), accepted))
        if accepted:
            status[key] = kind
    assert rows(spark.table("many").where("event_id >= 0"), "event_id", "key", "event_kind", "previous", "accepted") == sorted(want, key=repr)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 8 * 5


def test_waiting_events_are_held_in_pieces(monkeypatch):
    monkeypatch.setattr(jobs, "HELD_ROWS", 3)
    t = jobs.EVENT.empty_table().from_pylist([{"key": k, "at": i, "place": 0, "event_id": i, "event_kind": None} for i, k in enumerate("abc" * 3 + "d")], schema=jobs.EVENT)
    held = jobs._pack(t)

    class State:
        exists = staticmethod(lambda: True)
        get = staticmethod(lambda: iter(held))

    assert len(held) == 4 and jobs._unpack(State, jobs.EVENT).equals(t)


def test_files_of_a_stream_follow_the_splits(spark):
    d = spark.range(0, 4000, 1, 3).withColumn("q", (F.col("id") * 2 / 4000).cast("int"))
    path, files = catalog_jobs._files(d, "q", 2, "many-files")
    got = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("at")).agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("at").collect()
    assert files == 3 and len(got) == 6 and all(r["high"] < 2000 for r in got[:3]) and all(r["low"] >= 2000 for r in got[3:])


# --- file sources -----------------------------------------------------------------------------------------------------


def test_providers_keep_their_contract(spark, tmp_path):
    caps = {r["provider"]: r for r in providers.capabilities(spark).collect()}
    assert caps["csv_export"]["key_fields"] == ["registrable_domain"] and caps["json_directory"]["identity_capability"] == "NATIVE_EXTERNAL_ID" and caps["scrape"]["key_version"] is None
    lines = ['{"external_id":" e1 ","payload":{"legal_name":"A","employees":{"min":2},"registry_ids":{"x":"1"}}}', "", '{ "payload":{"registry_ids":{"x":"1"}, "employees":{"min":2},"legal_name":"A"},"external_id":"e2"}', "{broken", "[1]", '{"payload":{"legal_name":"B"}}']
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text("\n".join(lines))
    d = providers.candidates(spark, providers.JSON_DIRECTORY, f"file://{tmp_path}/d")
    assert [c for c in providers.CANDIDATE if c not in d.columns] == []
    got = d.orderBy("body").collect()
    by = {r["external_id"]: r for r in got}
    assert len(got) == 5 and by["e1"]["content_hash"] == by["e2"]["content_hash"] and by["e1"]["employee_count_min"] == 2 and by["e1"]["registry_ids"] == {"x": "1"}
    assert sorted(str(r["problem"]) for r in got) == ["MALFORMED", "MALFORMED", "NO_STABLE_KEY", "None", "None"]
    (tmp_path / "e.csv").write_text('company,domain,country,city,zip,staff_min,staff_max\nA,"a.com ",US,,1,5,x\nB,A.COM,US,,1,5,x\nC,,US,,1,5,x\n"D, E",d.com,US,,1,5\n')
    got = {r["legal_name"]: r for r in providers.candidates(spark, providers.CSV_EXPORT, f"file://{tmp_path}/e.csv").collect()}
    assert got["A"]["external_id"] == got["B"]["external_id"] != got["C"]["external_id"] and got["C"]["problem"] == "NO_STABLE_KEY" and got[None]["problem"] == "MALFORMED"
    assert (got["A"]["registrable_domain"], got["A"]["city"], got["A"]["employee_count_min"], got["A"]["employee_count_max"]) == ("a.com", None, 5, None)
    (tmp_path / "s.json").write_text('{"title":"T","tags":["x"]}\n{"tags":["x"],"title":"T"}\n{"title":"U"}')
    got = providers.candidates(spark, providers.SCRAPE, f"file://{tmp_path}/s.json").collect()
    assert len({r["external_id"] for r in got}) == 2 and all(r["external_id"] == r["content_hash"] for r in got)


def test_target_lists_have_true_lines(spark, tmp_path):
    """Files cut into small splits, each with its own order of columns; blank lines and a byte-order mark."""
    text = "﻿other,company_name,source_id\n" + "".join(f'"x, {i}",{" " if i % 10 == 3 else f"name {i}"},s{i}\n' + ("\n" if i % 50 == 0 else "") for i in range(1000))
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.csv").write_text(text)
    (tmp_path / "t/b.csv").write_text("company_name\nonly\n\n \n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        good, bad = io.read_cohort(spark, f"file://{tmp_path}/t")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    want = {(i + 1, line) for i, line in enumerate(text.split("\n")) if line.strip()}
    a = {(r["line"], r["company_name"], r["source_id"]) for r in good.where("file like '%a.csv'").collect()}
    assert a == {(n, x.split(",")[2], x.split(",")[3]) for n, x in want if n > 1 and x.split(",")[2].strip()}
    assert {r["line"] for r in bad.collect()} == {n for n, x in want if n > 1 and not x.split(",")[2].strip()} and len(a) == 900
    assert rows(good.where("file like '%b.csv'"), "line", "company_name", "source_id") == [(2, "only", None)]
    (tmp_path / "t/c.csv").write_text("name\nx\n")
    with pytest.raises(ValueError, match="c.csv"):
        io.read_cohort(spark, f"file://{tmp_path}/t")


def test_snapshots_are_rejected_with_their_place(spark, tmp_path):
    files = {"ok": b'{"metadata":{"title":"t"},"markets":[{"country":"A"}]}', "utf": b'{"metadata":{"title":"\xc3\xa9\xff"}}', "bad": b'{"metadata":\n {"title":}}', "list": b"[1]", "bare": b'{"markets":[]}', "blank": b" \n"}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_bytes(body)
    t = io.read_snapshot(spark, f"file://{tmp_path}/*.json")
    got = {r["file"].split("/")[-1][:-5]: (r["reason"], r["position"]) for r in t["rejects"].collect()}
    assert got["utf"] == ("NOT_UTF8", "25") and got["list"] == ("NOT_OBJECT", None) and got["bare"] == ("NO_METADATA", None) and set(got) == set(files) - {"ok"}
    assert got["bad"][0] == "MALFORMED" and "(line 2, column 11)" in got["bad"][1] and got["blank"][0] == "MALFORMED" and t["markets"].count() == 1


def test_pruned_bodies_are_refused(spark, tmp_path):
    store = BodyStore(spark, f"file://{tmp_path}/b", buckets=2)
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None), (5, "")], "id int, html string")
    put = store.put(docs, "html", "one")
    assert put.columns == ["id", "body_sha256"] and store.bodies.read().count() == 3
    x = put.where("id = 1").select("body_sha256")
    assert bytes(store.require(x).first()["body"]) == b"x"
    store.prune(x, F.lit("2024-01-02").cast("timestamp"), "p")
    store.vacuum()
    store.put(docs, "html", "two")
    assert rows(store.status(put), "id", "state", "size") == [(1, "PRUNED", None), (2, "RETAINED", 1), (3, "PRUNED", None), (4, "ABSENT", None), (5, "RETAINED", 0)]
    with pytest.raises(Exception, match="was pruned at 2024-01-02"):
        store.require(x).collect()
    with pytest.raises(Exception, match="no body q"):
        store.require(spark.createDataFrame([("q",)], "body_sha256 string")).collect()


# --- universes, thresholds, refusals, history -------------------------------------------------------------------------


def test_universe_bitmaps(spark):
    d = spark.range(100_000).select(F.concat(F.lit("m"), "id").alias("market_key"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("metric_key"))
    k = F.regexp_extract("market_key", "[0-9]+", 0).cast("int")
    d = d.withColumn("value", F.when((F.col("metric_key") == "a") & (k % 3 == 0) | (F.col("metric_key") == "b") & (k % 5 == 0), 1.0))
    members, index = sc.universe_members(d.union(d))
    assert members.count() <= 16 and sc.union_count(members, ["a"]).first()[0] == 33_334 and sc.union_count(members).first()[0] == 46_667 and sc.union_count(members, ["z"]).first()[0] == 0
    assert sc.members_of(members, index).exceptAll(d.where("value is not null").select("metric_key", "market_key")).count() == 0 and sc.members_of(members, index).count() == 53_334
    assert rows(sc.universe_definition(d), "metric_key", "observed") == [("a", 33_334), ("b", 20_000)]


def test_refusals_are_part_of_the_plan(spark):
    d = spark.range(3)
    assert sc.refuse_empty(d, "no rows").count() == 3
    late = sc.refuse_empty(d.where("id > 5"), "no rows here")  # nothing happens until it is read
    with pytest.raises(Exception, match="no rows here"):
        late.collect()
    t = spark.createDataFrame([(0.1, 0.2), (None, 0.2), (None, None)], "r double, m double")
    assert [r[0] for r in t.select(sc.resolve_threshold(F.col("r"), F.col("m"), 0.5)).collect()] == [0.1, 0.2, 0.5]
    with pytest.raises(Exception, match="between 0 and 1: 1.5"):
        t.select(sc.resolve_threshold(F.lit(1.5), F.col("m"), 0.5)).collect()
    s = spark.createDataFrame([("x", False, False), ("x", True, False), ("y", False, True), ("z", False, None)], "context_key string, comparable boolean, allow_low_coverage boolean")
    assert sc.refuse_incomparable(s.where("context_key <> 'z'")).count() == 3
    with pytest.raises(Exception, match="context z"):
        sc.refuse_incomparable(s).collect()
    with pytest.raises(Exception, match="no market has an observation"):
        sc.native_recalculation(spark.createDataFrame([], "market_key string, metric_key string, value double, fact_type string, granularity string, label string"), F.lit(False)).collect()


def test_history_and_lineage(spark):
    f = spark.createDataFrame([(1, 10, 5), (1, 11, 7), (1, 12, 7), (None, 13, 1)], "source_id int, fetch_id int, fetched_at int")
    d = spark.createDataFrame([(1, 20, 3), (2, 21, 1), (1, 22, 2)], "source_id int, discovery_id int, discovered_at int")
    e = spark.createDataFrame([(30, 1, 2, 4), (31, 1, 1, 5), (32, 3, 1, 1)], "edge_id int, from_id int, to_id int, observed_at int")
    got = rows(res.source_history(f, d, e), "source_id", "part", "place", "ref_id", "other_id")
    assert [g for g in got if g[0] == 1] == [(1, "DISCOVERY", 1, 22, None), (1, "DISCOVERY", 2, 20, None), (1, "IN", 1, 32, 3), (1, "OUT", 1, 30, 2), (1, "OUT", 2, 31, 1), (1, "RETRIEVAL", 1, 11, None), (1, "RETRIEVAL", 2, 12, None), (1, "RETRIEVAL", 3, 10, None)]
    assert rows(res.source_history(f, d, e, d.where("source_id = 2").select("source_id")), "part", "ref_id") == [("DISCOVERY", 21), ("IN", 30)]
    g = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 2), (7, 5), (None, 9), (1, 5)], "parent_id int, child_id int")
    r = spark.createDataFrame([(1,), (7,), (8,), (None,)], "root_id int")
    got = rows(res.lineage_down(g, r), "root_id", "artifact_id", "depth")
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 1), (7, 2, 2), (7, 4, 3), (7, 5, 1), (7, 7, 0), (8, 8, 0)]


def test_derivations_are_shuffled_once(spark):
    """A chain of seven levels beside many edges that no root leads to, some twice: rows shuffled do not grow with the levels."""
    n, gateway = 20_000, spark.sparkContext._gateway
    g = spark.range(n).select(F.col("id") + 100, F.col("id") + 100 + n).union(spark.range(7).select("id", F.col("id") + 1)).union(spark.range(7).select("id", F.col("id") + 1)).toDF("parent_id", "child_id")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = gateway.jvm.java.util.ArrayList()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = set(shuffled())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows(res.lineage_down(g, spark.createDataFrame([(0,)], "root_id long")), "root_id", "artifact_id", "depth")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = sum(v for k, v in shuffled().items() if k not in before)
    assert got == [(0, i, i) for i in range(8)] and n <= moved < 1.1 * n
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("attesta_")]


def test_one_row_of_a_key_whatever_the_order(spark):
    d = spark.createDataFrame([(1, "b", {"x": 1}), (1, "a", {"x": 2}), (None, "c", None), (2, None, None), (2, "z", None)], "k int, v string, m map<string,int>")
    for t in (d, d.repartition(5, "v"), d.orderBy(F.desc("v"))):
        assert rows(rel.one_per_key(t, ["k"]), "k", "v") == [(1, "a"), (2, None), (None, "c")]
    assert rows(rel.with_optional(spark.range(3).select(F.col("id").cast("int").alias("k")), d, "k"), "k", "v") == [(0, None), (1, "a"), (2, None)]
