"""Column functions: normalisation, parsing, confidence and identity. No Python runs on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import config as cfg

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: ColumnOrName, table: dict[str, float], default: float | None = None) -> Column:
    """A dictionary as a literal map, with a default for null and unknown keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(c)), F.lit(default))


def any_of(c: Column, terms: list[str]) -> Column:
    return c.rlike("|".join(re.escape(t) for t in terms))


# --- domains, names, addresses, URLs (FN01-FN07) ----------------------------------------------------------------------


def normalize_domain(c: ColumnOrName, suffixes: list[str] = cfg.TWO_LABEL_SUFFIXES) -> Column:
    v = F.rtrim(F.lower(F.trim(_c(c))), F.lit("."))
    v = F.regexp_replace(v, "^https://", "")
    v = F.regexp_replace(v, "^http://", "")
    v = F.regexp_replace(F.regexp_replace(v, "[/?].*$", ""), r"^www\.", "")
    parts = F.split(v, r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    deep = (F.size(parts) >= 3) & last(2).isin(suffixes)
    return F.when(v.contains("."), F.when(deep, last(3)).otherwise(last(2)))


def normalize_name(c: ColumnOrName, suffixes: list[str] = cfg.LEGAL_SUFFIXES) -> Column:
    """Lower case, single spaces, without the first legal suffix of the declared order that fits."""
    v = F.trim(F.regexp_replace(F.lower(_c(c)), r"[ \t\r\n\f]+", " "))
    # an ending of a later suffix that is declared before it wins, so the later one never applies; else the longest does
    used = [s for i, s in enumerate(suffixes) if not any(s.endswith(" " + t) for t in suffixes[:i])]
    out = F.trim(F.regexp_replace(v, " (?:" + "|".join(re.escape(s) for s in used) + ")$", ""))
    return F.nullif(out, F.lit(""))


def normalize_address(address: ColumnOrName, postal_code: ColumnOrName, city: ColumnOrName, country: ColumnOrName) -> Column:
    joined = F.concat_ws(" ", *[F.nullif(F.trim(F.lower(_c(p))), F.lit("")) for p in (address, postal_code, city, country)])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("unknown"))


def _query_pairs(query: Column, dropped: list[str]) -> Column:
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(dropped))
    return F.array_join(F.array_sort(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))), "&")


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_locator(c: ColumnOrName, dropped: list[str] = cfg.TRACKING_PARAMS) -> Column:
    """Scheme and host in lower case; no default port, fragment, trailing slash or tracking parameter; sorted query."""

    def parts(u: Column) -> Column:
        scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("")), F.lit("https"))
        return F.named_struct(F.lit("scheme"), scheme, F.lit("rest"), F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", ""))

    def join(x: Column) -> Column:
        scheme, rest = x["scheme"], x["rest"]
        host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
        host = let(host, lambda h: F.when(scheme == "http", F.regexp_replace(h, ":80$", "")).when(scheme == "https", F.regexp_replace(h, ":443$", "")).otherwise(h))
        path = let(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))
        query = let(_query_pairs(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), dropped), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        return F.concat(scheme, F.lit("://"), host, path, query)

    return let(F.regexp_replace(F.trim(_c(c)), "#.*$", ""), lambda u: let(parts(u), join))


def strip_presentation(c: ColumnOrName) -> Column:
    """Drop parameters that change how a page looks and not which page it is."""

    def build(u: Column) -> Column:
        query = let(_query_pairs(F.regexp_extract(u, r"\?([^#]*)", 1), cfg.PRESENTATION_PARAMS), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        return F.concat(F.regexp_extract(u, r"^([^?#]*)", 1), query, F.regexp_extract(u, "(#.*)$", 1))

    return let(_c(c), build)


def resolve_reference(base: ColumnOrName, reference: ColumnOrName) -> Column:
    """The absolute URL that a reference means on the page ``base``, by RFC 3986 section 5.2: scheme, authority, path and query
    are taken from the reference as far as it has them, relative paths are merged with the folder of the page, and dot segments
    are a stack. The fragment goes. A reference with a scheme of its own that has no authority (``mailto:x``) stays as it is."""

    def parts(u: Column) -> Column:
        rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*:", "")
        return F.struct(
            F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"), rest.startswith("//").alias("has_host"), F.regexp_extract(rest, "^//([^/?]*)", 1).alias("host"),
            F.regexp_extract(rest, "^(?://[^/?]*)?([^?]*)", 1).alias("path"), rest.contains("?").alias("has_query"), F.regexp_extract(rest, r"\?(.*)$", 1).alias("query"),
        )

    def no_dots(path: Column) -> Column:
        segments = F.slice(F.split(path, "/"), 2, 1 << 30)  # what follows the first slash
        push = lambda stack, x: F.when(x == ".", stack).when(x == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(x)))
        folder = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(segments, F.expr("cast(array() as array<string>)"), push), folder), "/"))

    def clean(path: Column) -> Column:
        return let(path, lambda p: F.when(p.startswith("/"), no_dots(p)).otherwise(p))

    def build(b: Column, r: Column) -> Column:
        merged = F.when(b["path"] == "", F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_extract(b["path"], "^(.*/)", 1), r["path"]))
        path = F.when(r["has_host"], clean(r["path"])).when(r["path"] == "", b["path"]).otherwise(clean(F.when(r["path"].startswith("/"), r["path"]).otherwise(merged)))
        own_query = r["has_query"] | r["has_host"] | (r["path"] != "")
        query = F.when(own_query & r["has_query"], F.concat(F.lit("?"), r["query"])).when(~own_query & b["has_query"], F.concat(F.lit("?"), b["query"])).otherwise("")
        joined = F.concat(b["scheme"], F.lit("://"), F.when(r["has_host"], r["host"]).otherwise(b["host"]), path, query)
        absolute = F.concat(r["scheme"], F.lit("://"), r["host"], clean(r["path"]), F.when(r["has_query"], F.concat(F.lit("?"), r["query"])).otherwise(""))
        alone = F.concat(r["scheme"], F.lit(":"), r["path"], F.when(r["has_query"], F.concat(F.lit("?"), r["query"])).otherwise(""))
        return F.when(r["scheme"] == "", joined).when(r["has_host"], absolute).otherwise(alone)

    bare = lambda c: F.regexp_replace(F.trim(_c(c)), "#.*$", "")
    return let(F.struct(parts(bare(base)).alias("b"), parts(bare(reference)).alias("r")), lambda x: build(x["b"], x["r"]))


def host_of(c: ColumnOrName) -> Column:
    return F.lower(F.regexp_extract(_c(c), "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))


def registrable_domain(host: ColumnOrName) -> Column:
    parts = F.split(_c(host), r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, F.size(parts) - 1, 2), ".")).otherwise(_c(host))


def _path(c: ColumnOrName) -> Column:
    return F.lower(F.regexp_extract(_c(c), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def relevance_hint(c: ColumnOrName) -> Column:
    p = _path(c)
    out = F.when(p.isin("", "/"), 1.0)
    for score, terms in cfg.HINTS:
        out = out.when(any_of(p, terms), score)
    return out.otherwise(0.40)


def is_relevant(c: ColumnOrName) -> Column:
    p, q = _path(c), F.lower(F.regexp_extract(_c(c), r"\?([^#]*)", 1))
    full = F.when(q == "", p).otherwise(F.concat(p, F.lit("?"), q))
    return (
        F.when(p.rlike(r"\.(" + "|".join(cfg.SKIPPED_SUFFIXES) + ")$"), False)
        .when(any_of(full, cfg.DENIED_TERMS), False)
        .when(p.isin("", "/"), True)
        .otherwise(any_of(p, cfg.ALLOWED_TERMS))
    )


def is_identity_domain(c: ColumnOrName) -> Column:
    d = normalize_domain(c)
    return F.coalesce(~d.isin(cfg.SHARED_HOSTS), F.lit(False))


def is_crawlable_seed(c: ColumnOrName) -> Column:
    host = host_of(normalize_locator(c))
    return (host != "") & ~registrable_domain(host).isin(cfg.PLATFORM_DOMAINS) & ~host.isin(cfg.PLATFORM_DOMAINS)


# --- lists, labels, vocabulary (FN10-FN12) ----------------------------------------------------------------------------


def split_list(c: ColumnOrName) -> Column:
    return F.filter(F.transform(F.split(_c(c), ";"), lambda x: F.trim(x)), lambda x: x != "")


def normalize_concern(c: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(F.upper(_c(c)), r"[ \t\r\n]+", " "))


def label_factor(c: ColumnOrName) -> Column:
    return lookup(F.upper(_c(c)), cfg.LABEL_FACTOR, 1.0)


def is_applicable(attribute_verticals: ColumnOrName, vertical: ColumnOrName) -> Column:
    v = _c(attribute_verticals)
    return v.isNull() | (F.size(v) == 0) | F.array_contains(v, _c(vertical))


# --- trigrams (FN13) --------------------------------------------------------------------------------------------------


def trigrams(c: ColumnOrName) -> Column:
    """Distinct trigrams of the words, each padded with two spaces before and one behind."""
    words = F.filter(F.split(F.lower(_c(c)), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


# --- documents (FN14-FN18) --------------------------------------------------------------------------------------------

SPACES = r"[ \t\r\n\f]+"


def html_text(c: ColumnOrName) -> Column:
    v = F.regexp_replace(_c(c), r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    v = F.regexp_replace(F.regexp_replace(v, r"(?s)<!--.*?-->", " "), "<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"')):
        v = F.replace(v, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(v, SPACES, " "))


def html_title(c: ColumnOrName) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(_c(c), r"(?is)<title[^>]*>(.*?)</title>", 1), SPACES, " ")), F.lit(""))


def html_language(c: ColumnOrName) -> Column:
    return F.nullif(F.regexp_extract(_c(c), r"""(?i)<html[^>]*\blang=["']([^"']+)["']""", 1), F.lit(""))


def html_published(c: ColumnOrName) -> Column:
    return F.nullif(F.regexp_extract(_c(c), r"""(?i)<meta[^>]+property=["']article:published_time["'][^>]+content=["']([^"']+)["']""", 1), F.lit(""))


def sniff(c: ColumnOrName) -> Column:
    """The media type that a body's own text shows."""
    head = F.lower(F.ltrim(F.substring(_c(c), 1, 512)))
    json = head.rlike(r"^[{\[]") & F.try_parse_json(_c(c)).isNotNull()
    return F.when(F.startswith(_c(c), F.lit("%PDF-")), "application/pdf").when(head.rlike("^(<!doctype html|<html)"), "text/html").when(json, "application/json").otherwise("text/plain")


def paged_text(c: ColumnOrName) -> Column:
    """Pages cut at form feeds: struct<text, pages array<struct<page, start, text>>>, one character between pages."""
    body = F.when(F.startswith(_c(c), F.lit("%PDF-")), F.regexp_extract(_c(c), r"(?s)^[^\n]*\n(.*)$", 1)).otherwise(_c(c))
    pages = F.transform(F.split(body, "\f"), lambda p: F.trim(F.regexp_replace(p, r"[ \t\r\n]+", " ")))
    start = lambda i: F.aggregate(F.slice(pages, 1, i), F.lit(0), lambda a, p: a + F.length(p) + 1)
    return F.struct(F.array_join(pages, "\n").alias("text"), F.transform(pages, lambda p, i: F.struct((i + 1).alias("page"), start(i).alias("start"), p.alias("text"))).alias("pages"))


EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+"
PHONE = r"\b(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}\b"


def redact(c: ColumnOrName, version: int = 2) -> Column:
    v = F.regexp_replace(_c(c), EMAIL, "[REDACTED_EMAIL]")
    return F.regexp_replace(v, PHONE, "[REDACTED_PHONE]") if version >= 2 else v


# --- scores and confidence (FN19-FN27) --------------------------------------------------------------------------------


def log_transform(c: ColumnOrName) -> Column:
    return F.when(_c(c) > 0, F.ln(_c(c)))


def sam_scale(c: ColumnOrName) -> Column:
    out = F.when(_c(c).isNull(), F.lit(None).cast("double"))
    for top, value in cfg.FIRM_LADDER:
        out = out.when(_c(c) <= top, value)
    return out.otherwise(1.0)


def ticket_overlap(ticket: ColumnOrName, low: ColumnOrName, high: ColumnOrName) -> Column:
    """1 inside the range, falling linearly to 0 at the range's own width (1 at least) from it; bounds in either order."""
    t, lo, hi = _c(ticket), F.least(_c(low), _c(high)), F.greatest(_c(low), _c(high))
    known = t.isNotNull() & _c(low).isNotNull() & _c(high).isNotNull()
    outside = F.greatest(lo - t, t - hi)
    return F.when(known, F.when(outside <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - outside / F.greatest(hi - lo, F.lit(1.0)))))


def clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def evidence_confidence(fact: ColumnOrName, granularity: ColumnOrName, label: ColumnOrName) -> Column:
    return F.round(clamp(lookup(fact, cfg.FACT_FACTOR, 0.0) * lookup(granularity, cfg.RECENCY_FACTOR, 0.70) * label_factor(label)), 6)


def corroboration_factor(n: ColumnOrName) -> Column:
    table = F.array(*[F.lit(v) for v in cfg.CORROBORATION])
    return F.element_at(table, F.least(_c(n).cast("int"), F.lit(len(cfg.CORROBORATION) - 1)) + 1)


def claim_confidence(fact: ColumnOrName, trust: ColumnOrName, publishers: ColumnOrName, inferred: ColumnOrName) -> Column:
    base = lookup(fact, cfg.CLAIM_BASE, 0.0) * _c(trust) * corroboration_factor(publishers)
    return F.round(clamp(base * F.when(_c(inferred), cfg.INFERENCE_PENALTY).otherwise(1.0)), 4)


def parse_published(c: ColumnOrName) -> Column:
    """struct<date, granularity> that never invents precision."""
    t = F.trim(_c(c))
    year = F.when(t.rlike(r"^[0-9]{4}$"), F.try_to_timestamp(F.concat(t, F.lit("-01-01")), F.lit("yyyy-MM-dd")).cast("date"))
    month = F.when(t.rlike(r"^[0-9]{4}.[0-9]{2}$"), F.try_to_timestamp(F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 6, 2), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"))
    day = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))
    n = F.length(t)
    date = F.when(n == 4, year).when(n == 7, month).when(n >= 10, day)
    kind = F.when(n == 4, "YEAR").when(n == 7, "MONTH").otherwise("DATE")
    out = F.struct(date.alias("date"), F.when(date.isNull(), "UNDATED").otherwise(kind).alias("granularity"))
    return out.cast("struct<date:date,granularity:string>")


def staleness(observed: ColumnOrName, horizon: ColumnOrName, as_of: ColumnOrName) -> Column:
    age = F.datediff(_c(as_of), _c(observed))
    return F.when(_c(observed).isNull(), "UNKNOWN_AGE").when(_c(horizon).isNull(), "FRESH").when(age > _c(horizon), "STALE").when(age > _c(horizon) * 0.5, "AGING").otherwise("FRESH")


def retention_cutoff(media: ColumnOrName, as_of: ColumnOrName) -> Column:
    days = {k: v for k, v in cfg.RETENTION_DAYS.items()}
    return F.date_sub(_c(as_of), lookup(media, days, 90).cast("int"))


# --- identity (FN28-FN38) ---------------------------------------------------------------------------------------------


def gap_fingerprint(metric: ColumnOrName, dims: dict[str, ColumnOrName]) -> Column:
    """SHA-256 of the metric and its dimensions in order of name; those outside the metric's scope are left blank."""
    m = _c(metric)
    market = m.isin(cfg.MARKET_SCOPED) | F.coalesce(m.rlike("^(" + "|".join(cfg.MARKET_PREFIXES) + ")"), F.lit(False))
    vertical = m.isin(cfg.VERTICAL_SCOPED)
    parts = [m]
    for name in sorted(("market", "vertical", "icp", "offer", "channel", "snapshot", "model")):
        value = F.coalesce(_c(dims[name]).cast("string"), F.lit("")) if name in dims else F.lit("")
        if name == "vertical":
            value = F.when(market, "").otherwise(value)
        elif name not in ("market", "snapshot"):
            value = F.when(market | vertical, "").otherwise(value)
        parts.append(F.concat(F.lit(f"{name}="), value))
    return F.sha2(F.concat_ws("|", *parts), 256)


def gap_priority(metric: ColumnOrName) -> Column:
    return F.when(_c(metric).isin(cfg.HIGH_PRIORITY), "HIGH").when(F.startswith(_c(metric), F.lit("context.")), "LOW").otherwise("MEDIUM")


def sha256(c: ColumnOrName) -> Column:
    return F.sha2(_c(c), 256)


def canonical_json(c: ColumnOrName) -> Column:
    """Sorted keys and tight separators, through the variant type; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(_c(c)))


def json_equal(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Whether two JSON texts are one value, whatever the order of their keys and their spaces. Two nulls are equal; a text
    that is no JSON equals the same text alone."""
    same = lambda c: F.coalesce(canonical_json(c), _c(c))
    return same(a).eqNullSafe(same(b))


def canonical_csv(m: ColumnOrName) -> Column:
    """A CSV row as JSON: trimmed lower-case headers in order, blanks as null."""
    entries = F.transform(F.map_entries(_c(m)), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.nullif(F.trim(e["value"]), F.lit("")).alias("value")))
    return F.to_json(F.map_from_entries(F.array_sort(entries)), {"ignoreNullFields": "false"})


def derive_key(cols: list[ColumnOrName], version: str) -> Column:
    """A stable key from declared fields, or null where one is missing or blank."""
    parts = [F.nullif(F.lower(F.trim(_c(c).cast("string"))), F.lit("")) for c in cols]
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.sha2(F.concat_ws("|", F.lit(version), *parts), 256))


def fingerprint(*cols: ColumnOrName) -> Column:
    """SHA-256 of the columns' JSON, nulls kept: for assertions, observations, signals and plans."""
    return F.sha2(F.to_json(F.struct(*[_c(c).alias(f"f{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256)


def assertion_fingerprint(*said: ColumnOrName, origins: ColumnOrName) -> Column:
    """What an assertion says and where its evidence comes from, in whatever order and however often; never who extracted it."""
    return fingerprint(*said, F.array_sort(F.array_distinct(_c(origins))))


def observation_fingerprint(attribute: ColumnOrName, value: ColumnOrName, unit: ColumnOrName, fact_type: ColumnOrName, locator_hash: ColumnOrName, support: ColumnOrName, lineage: ColumnOrName) -> Column:
    """One exact reading of one place. Two readings differ by attribute, value, unit, strength, place, kind of support or lineage;
    the quote follows from the place and takes no part."""
    return fingerprint(attribute, value, unit, fact_type, locator_hash, support, lineage)


def signal_fingerprint(company: ColumnOrName, concern: ColumnOrName) -> Column:
    """A company's concern, the same whatever its case and spaces."""
    return fingerprint(company, normalize_concern(concern))


def plan_hash(*scope: ColumnOrName, targets: ColumnOrName) -> Column:
    """What a research plan asks about whom; the order of its targets says nothing."""
    return fingerprint(*scope, F.array_sort(_c(targets)))


def contract_hash(**fields: str) -> str:
    """The hash of a contract's fields, once on the driver."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def extract_shadow(value: ColumnOrName) -> Column:
    """struct<numeric, text, ref>: typed shadows of a JSON value."""
    get = lambda k: F.get_json_object(_c(value), f"$.{k}")
    return F.struct(F.try_to_number(F.coalesce(get("value"), get("min")), F.lit("999999999999.999999")).cast("double").alias("numeric"), F.coalesce(get("value"), get("min")).alias("text"), get("ref").alias("ref"))


# --- spans and headings (FN39, FN40), explanations (FN41), fetches (FN42) ---------------------------------------------


def span(text: ColumnOrName, quote: ColumnOrName, after: ColumnOrName | None = None) -> Column:
    """struct<start, end> of the first place of the quote from a position on (both from 0), or null."""
    begin = F.lit(1) if after is None else _c(after) + 1
    at = F.call_function("locate", _c(quote), _c(text), begin.cast("int"))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(_c(quote))).alias("end")))


def headings(html: ColumnOrName) -> Column:
    """array<struct<level, title>> of h1 to h6, in order."""
    tags = F.regexp_extract_all(_c(html), F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"), F.lit(1))
    return F.transform(tags, lambda t: F.struct(F.substring(t, 3, 1).cast("int").alias("level"), F.trim(F.regexp_replace(t, "<[^>]+>", "")).alias("title")))


def heading_trail(html: ColumnOrName, offset: ColumnOrName) -> Column:
    """Titles of the last heading of each level before an offset, each under those of higher rank."""
    found = headings(F.substring(_c(html), F.lit(1), _c(offset)))
    start = F.lit(None).cast("array<struct<level:int,title:string>>")
    trail = F.aggregate(found, F.coalesce(start, F.array().cast("array<struct<level:int,title:string>>")), lambda acc, h: F.concat(F.filter(acc, lambda x: x["level"] < h["level"]), F.array(h)))
    return F.transform(trail, lambda x: x["title"])


def section_at(text: ColumnOrName, offset: ColumnOrName) -> Column:
    """The last line like "3.1 Title" before an offset."""
    found = F.regexp_extract_all(F.substring(_c(text), F.lit(1), _c(offset)), F.lit(r"(?m)^([0-9]+(?:\.[0-9]+)* [^\n]+)$"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def explain(component: ColumnOrName, earned: ColumnOrName, weight: ColumnOrName, missing: ColumnOrName) -> Column:
    return F.when(_c(earned).isNull(), F.format_string("%s: not covered, missing %s", _c(component), F.array_join(F.array_sort(_c(missing)), ", "))).otherwise(
        F.format_string("%s: %.4f of %.1f", _c(component), _c(earned), _c(weight))
    )


def fetch_outcome(status: ColumnOrName, media: ColumnOrName, size: ColumnOrName, body: ColumnOrName, max_bytes: int = 5_000_000) -> Column:
    s, m = _c(status), F.lower(F.trim(F.split(_c(media), ";")[0]))
    login = m.isin("text/html", "application/xhtml+xml") & F.lower(_c(body)).rlike("""(type|name)=(["'])password\\2""") & (F.length(_c(body)) < 40_000)
    return (
        F.when(s == 304, "NOT_MODIFIED").when(s == 404, "NOT_FOUND").when(s == 410, "GONE").when(s.isin(401, 402, 403, 405, 406, 423, 429, 451), "DENIED").when(s >= 400, "TRANSPORT_ERROR")
        .when(_c(size) > max_bytes, "TOO_LARGE").when((m != "") & ~m.isin(cfg.ACCEPTED_MEDIA), "MIME_MISMATCH").when(login, "LOGIN_WALL").otherwise("OK")
    )


# --- dimension lookups that need a join (FN08, FN09) ------------------------------------------------------------------


def resolve_country(df: DataFrame, col: str, countries: DataFrame) -> DataFrame:
    """Add ``country_key`` by normalised name or alias from (alias, country_key); unmatched rows get null."""
    key = F.trim(F.regexp_replace(F.lower(F.col(col)), "[^a-z0-9]+", " "))
    dim = countries.select(F.trim(F.regexp_replace(F.lower("alias"), "[^a-z0-9]+", " ")).alias("_a"), "country_key").groupBy("_a").agg(F.min("country_key").alias("country_key"))
    return df.withColumn("_a", key).join(dim, "_a", "left").drop("_a")


def match_vertical(col: ColumnOrName, aliases: dict[str, str]) -> Column:
    """Exact alias, else the longest alias contained, else null. The alias list is a versioned literal."""
    v = F.lower(F.trim(_c(col)))
    out = F.when(v.isin(list(aliases)), F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), v))
    for a in sorted(aliases, key=lambda a: (-len(a), a)):
        out = out.when(v.contains(a), aliases[a])
    return out
