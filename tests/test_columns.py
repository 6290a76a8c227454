import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.functions import columns as fn


def one(spark, *values, schema, col):
    return spark.createDataFrame([values], schema).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("https://www.Acme.com/a?b", "acme.com"), ("shop.acme.co.uk", "acme.co.uk"), ("localhost", None), ("", None), (None, None), ("a.b.acme.com.", "acme.com"), ("acme.co.uk", "acme.co.uk")],
)
def test_domain(spark, raw, want):
    assert one(spark, raw, schema="c string", col=fn.normalize_domain("c")) == want


@pytest.mark.parametrize(("raw", "want"), [("Bau  GmbH & Co. KG", "bau"), ("Acme Ltd.", "acme"), ("X Pty Ltd", "x pty"), ("Inc", "inc"), ("  ", None), (None, None), ("Foo S.L.U.", "foo")])
def test_name(spark, raw, want):
    assert one(spark, raw, schema="c string", col=fn.normalize_name("c")) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://Acme.com:443/A/?utm_source=x&b=2&a=1#f", "https://acme.com/A?a=1&b=2"),
        ("http://acme.com", "http://acme.com/"),
        ("http://acme.com:8080/x//", "http://acme.com:8080/x"),
        ("https://a.com/?ref=1", "https://a.com/"),
        ("https://a.com/x?flag", "https://a.com/x?flag="),
    ],
)
def test_locator(spark, raw, want):
    assert one(spark, raw, schema="c string", col=fn.normalize_locator("c")) == want


@pytest.mark.parametrize(
    ("url", "want", "hint"),
    [("https://a.com/", True, 1.0), ("https://a.com/services/hvac", True, 0.9), ("https://a.com/blog/commercial-tips", False, 0.95), ("https://a.com/x.pdf", False, 0.4), ("https://a.com/logo.png", False, 0.4), ("https://a.com/about?x=1", True, 0.85), ("https://a.com/about?q=1", False, 0.85)],
)
def test_relevance(spark, url, want, hint):
    got = spark.createDataFrame([(url,)], "c string").select(fn.is_relevant("c").alias("r"), fn.relevance_hint("c").alias("h")).first()
    assert (got["r"], got["h"]) == (want, hint)


def test_seeds(spark):
    df = spark.createDataFrame([("https://www.linkedin.com/company/x",), ("https://acme.com/",)], "c string")
    assert [r["x"] for r in df.select(fn.is_crawlable_seed("c").alias("x")).collect()] == [False, True]
    assert one(spark, "shop.wixsite.com", schema="c string", col=fn.is_identity_domain("c")) is False


@pytest.mark.parametrize(
    ("raw", "date", "kind"),
    [("2023", dt.date(2023, 1, 1), "YEAR"), ("2023-05", dt.date(2023, 5, 1), "MONTH"), ("2023-05-06T10:00", dt.date(2023, 5, 6), "DATE"), ("soon", None, "UNDATED"), (None, None, "UNDATED"), ("2023-13", None, "UNDATED"), ("2023-02-30", None, "UNDATED")],
)
def test_published(spark, raw, date, kind):
    got = one(spark, raw, schema="c string", col=fn.parse_published("c"))
    assert (got["date"], got["granularity"]) == (date, kind)


def test_html(spark):
    page = '<!DOCTYPE html><html lang="de"><head><title> A\n b </title><meta property="article:published_time" content="2024-01-02"/><script>x<y</script></head><body><!-- c --><h1>T&amp;U</h1><p>one&nbsp;two</p></body></html>'
    d = spark.createDataFrame([(page,)], "c string").select(fn.html_text("c").alias("t"), fn.html_title("c").alias("h"), fn.html_language("c").alias("l"), fn.html_published("c").alias("p"), fn.sniff("c").alias("s")).first()
    assert tuple(d) == ("A b T&U one two", "A b", "de", "2024-01-02", "text/html")
    for raw, kind in (('{"a": 1}', "application/json"), ("{broken", "text/plain"), ("%PDF-1.4\nx", "application/pdf"), ("hi", "text/plain")):
        assert one(spark, raw, schema="c string", col=fn.sniff("c")) == kind


def test_pages_and_sections(spark):
    got = one(spark, "%PDF-x\n1.1  Intro\ntext\fpage   two", schema="c string", col=fn.paged_text("c"))
    assert got["text"] == "1.1 Intro text\npage two" and [(p["page"], p["start"]) for p in got["pages"]] == [(1, 0), (2, 15)]
    html = "<h1>A</h1><h2>B</h2><h3>C</h3><h2>D</h2>xx"
    assert one(spark, html, schema="c string", col=fn.heading_trail("c", F.lit(len(html)))) == ["A", "D"]
    assert one(spark, "1 One\nx\n2.1 Two\ny", schema="c string", col=fn.section_at("c", F.lit(15))) == "2.1 Two"


def test_redaction(spark):
    text = "mail a.b+c@d-e.co.uk or (216) 555-0100."
    assert one(spark, text, schema="c string", col=fn.redact("c", 1)) == "mail [REDACTED_EMAIL] or (216) 555-0100."
    assert "[REDACTED_PHONE]" in one(spark, text, schema="c string", col=fn.redact("c", 2))


def test_trigrams(spark):
    assert one(spark, "word", "two words", schema="a string, b string", col=fn.trigram_similarity("a", "b")) == pytest.approx(4 / 11)
    assert one(spark, "", "", schema="a string, b string", col=fn.trigram_similarity("a", "b")) == 0.0


def test_confidence(spark):
    assert one(spark, "PROXY", schema="f string", col=fn.evidence_confidence("f", F.lit("YEAR"), F.lit("medium"))) == pytest.approx(0.57375)
    assert one(spark, None, schema="f string", col=fn.evidence_confidence("f", F.lit(None), F.lit(None))) == 0.0
    assert one(spark, "FACT", schema="f string", col=fn.claim_confidence("f", F.lit(1.0), F.lit(9), F.lit(False))) == 1.0
    assert one(spark, "INFERENCE", schema="f string", col=fn.claim_confidence("f", F.lit(0.9), F.lit(2), F.lit(True))) == pytest.approx(0.4208)


def test_gap_scope(spark):
    dims = {"market": F.lit("m"), "offer": F.lit("o"), "channel": F.lit("c")}
    same = spark.range(1).select(*[(fn.gap_fingerprint(F.lit(m), dims) == fn.gap_fingerprint(F.lit(m), dims | {"offer": F.lit("other")})).alias(n) for n, m in (("market", "population"), ("prefix", "gdp_x"), ("full", "other"))]).first()
    assert tuple(same) == (True, True, False)


def test_json(spark):
    assert one(spark, '{"b": 1, "a": [1, 2]}', schema="c string", col=fn.canonical_json("c")) == '{"a":[1,2],"b":1}'
    assert one(spark, {" B ": " x", "A": ""}, schema="c map<string,string>", col=fn.canonical_csv("c")) == '{"a":null,"b":"x"}'
    assert one(spark, "Acme ", None, schema="a string, b string", col=fn.derive_key(["a", "b"], "1")) is None


def test_staleness(spark):
    day = F.to_date(F.lit("2024-06-01"))
    rows = [("2024-05-31", 100, "FRESH"), ("2024-04-01", 100, "AGING"), ("2023-01-01", 100, "STALE"), (None, 100, "UNKNOWN_AGE"), ("2000-01-01", None, "FRESH")]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "d string, h int").select(fn.staleness(F.to_date("d"), "h", day).alias("s"))
    assert [r["s"] for r in df.collect()] == [s for _, _, s in rows]


def test_fetch_outcomes(spark):
    rows = [(304, "", 0, "", "NOT_MODIFIED"), (404, "", 0, "", "NOT_FOUND"), (410, "", 0, "", "GONE"), (403, "", 0, "", "DENIED"), (500, "", 0, "", "TRANSPORT_ERROR"), (200, "text/html", 9_000_000, "", "TOO_LARGE"), (200, "image/png", 1, "", "MIME_MISMATCH"), (200, "text/html; x", 1, '<input type="password">', "LOGIN_WALL"), (200, "text/html", 1, "hello", "OK")]
    df = spark.createDataFrame([r[:4] for r in rows], "s int, m string, z long, b string").select(fn.fetch_outcome("s", "m", "z", "b").alias("o"))
    assert [r["o"] for r in df.collect()] == [r[4] for r in rows]


def test_vertical_and_lists(spark):
    assert one(spark, "Commercial HVAC firms", schema="c string", col=fn.match_vertical("c", {"hvac": "v1", "commercial hvac": "v2"})) == "v2"
    assert one(spark, " a ;; b", schema="c string", col=fn.split_list("c")) == ["a", "b"]
    assert one(spark, "https://a.com/x?hsLang=en&id=2", schema="c string", col=fn.strip_presentation("c")) == "https://a.com/x?id=2"
