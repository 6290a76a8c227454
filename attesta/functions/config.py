"""Models, registries and vocabularies, as literals and as small tables. All are parameters with these defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- fixed values: results depend on these names, weights and lists --------------------------------------------------

TWO_LABEL_SUFFIXES = ["co.uk", "com.au", "co.nz", "com.br", "co.jp", "com.mx"]
LEGAL_SUFFIXES = ["gmbh & co. kg", "gmbh", "ltd.", "ltd", "limited", "s.l.u.", "s.l.", "s.a.", "inc.", "inc", "llc", "b.v.", "n.v.", "plc", "oy", "ab", "a/s", "sp. z o.o.", "pty ltd", "srl", "s.r.l."]
SHARED_HOSTS = ["wixsite.com", "business.site", "weebly.com", "squarespace.com", "wordpress.com", "blogspot.com", "google.com", "facebook.com", "linkedin.com", "godaddysites.com", "myshopify.com", "sites.google.com"]
PLATFORM_DOMAINS = ["linkedin.com", "facebook.com", "instagram.com", "x.com", "twitter.com", "youtube.com", "google.com", "sites.google.com", "wixsite.com", "wordpress.com", "blogspot.com", "weebly.com", "squarespace.com", "godaddysites.com", "business.site", "yelp.com", "angi.com", "houzz.com", "bbb.org", "indeed.com", "glassdoor.com"]
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "ref", "ref_src"]
PRESENTATION_PARAMS = ["hslang", "lang", "language", "locale", "hl", "print", "printable", "amp", "output", "format", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_ga", "_gl", "yclid", "igshid"]
SKIPPED_SUFFIXES = ["jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "bmp", "tif", "tiff", "avif", "mp4", "mov", "avi", "webm", "mp3", "wav", "m4a", "css", "js", "mjs", "map", "woff", "woff2", "ttf", "eot", "otf", "zip", "gz", "tar", "rar", "7z", "dmg", "exe", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "rss", "atom"]
DENIED_TERMS = ["privacy", "terms", "tos", "legal", "cookie", "disclaimer", "accessibility", "sitemap.xml", "wp-json", "wp-admin", "wp-login", "xmlrpc", "/blog/", "/news/", "/press/", "/article/", "/articles/", "/post/", "/posts/", "/tag/", "/tags/", "/category/", "/categories/", "/author/", "/archive/", "/archives/", "/feed", "/rss", "/comments/", "/page/", "/paged/", "cart", "checkout", "basket", "shop", "product", "store", "pricing", "login", "signin", "sign-in", "register", "account", "my-account", "password", "logout", "admin", "portal", "payment", "pay-bill", "paybill", "search", "?s=", "?q=", "facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "youtube.com", "yelp.com", "pinterest", "tiktok", "maps.google"]
ALLOWED_TERMS = ["commercial", "service", "services", "maintenance", "preventive", "preventative", "emergency", "24-7", "24-hour", "247", "industrial", "mechanical", "hvac", "refrigeration", "chiller", "boiler", "plumbing", "controls", "building-automation", "retrofit", "installation", "locations", "location", "branches", "branch", "service-area", "areas-served", "coverage", "about", "about-us", "company", "who-we-are", "our-team", "team", "history", "capabilities", "why", "industries", "markets", "sectors", "verticals", "clients", "customers", "careers", "career", "jobs", "employment", "join", "apply", "technician", "technicians", "apprentice", "fleet", "projects", "portfolio", "case-studies", "case-study", "contact", "contact-us"]
HINTS = [(0.95, ["commercial", "preventive", "preventative", "maintenance"]), (0.90, ["service", "services", "capabilities", "industrial"]), (0.85, ["about", "company", "who-we-are", "history"]), (0.80, ["careers", "jobs", "employment", "technician"]), (0.75, ["locations", "branches", "service-area", "areas-served"]), (0.70, ["industries", "markets", "sectors", "clients"]), (0.60, ["projects", "portfolio", "case-studies"]), (0.50, ["contact", "emergency", "24-7"])]
ACCEPTED_MEDIA = ["text/html", "application/xhtml+xml", "text/plain", "application/pdf", "application/json"]

FACT_FACTOR = {"FACT": 1.00, "PROXY": 0.75, "ESTIMATE": 0.65, "INFERENCE": 0.50, "HYPOTHESIS": 0.30}
RECENCY_FACTOR = {"DATE": 1.00, "YEAR": 0.90, "SNAPSHOT": 0.85, "UNDATED": 0.70}
LABEL_FACTOR = {"HIGH": 1.00, "HIGH_MEDIUM": 0.92, "MEDIUM_HIGH": 0.92, "MEDIUM": 0.85, "LOW_MEDIUM": 0.75, "MEDIUM_LOW": 0.75, "LOW_TO_MEDIUM": 0.75, "LOW": 0.60}
FACT_RANK_PROJECTION = {"FACT": 0, "PROXY": 1, "ESTIMATE": 2, "INFERENCE": 3, "HYPOTHESIS": 4}
FACT_RANK_RESEARCH = {"FACT": 0, "ESTIMATE": 1, "PROXY": 2, "INFERENCE": 3, "HYPOTHESIS": 4}
CLAIM_BASE = {"FACT": 0.95, "ESTIMATE": 0.80, "PROXY": 0.65, "INFERENCE": 0.50, "HYPOTHESIS": 0.35}
CORROBORATION = [1.0, 1.0, 1.10, 1.16, 1.20]
INFERENCE_PENALTY = 0.85
TRUST = {"REGISTRY": 1.00, "OWN_SITE": 0.90, "JOB_BOARD": 0.75, "NEWS": 0.70, "VENDOR": 0.60, "DIRECTORY": 0.55, "UNKNOWN": 0.40}
CLASS_CEILING = {"EXPLICIT_COMPANY_STATEMENT": "FACT", "PORTAL_BRANDING": "FACT", "INTEGRATION_DOCUMENT": "FACT", "JOB_MENTION": "PROXY", "TECH_DATABASE": "PROXY", "SCRIPT_FINGERPRINT": "HYPOTHESIS", "EMPLOYEE_PROFILE": "HYPOTHESIS"}
FIRM_LADDER = [(100, 0.1), (500, 0.25), (2_000, 0.45), (10_000, 0.65), (30_000, 0.85), (60_000, 0.95)]
RETENTION_DAYS = {"application/pdf": 30, "text/html": 90, "application/json": 180, "text/plain": 180}
PERMANENT_FAILURES = ["NOT_FOUND", "GONE", "DENIED", "LOGIN_WALL", "ROBOTS_DENIED", "MIME_MISMATCH"]
GAP_GRAPH = [(None, "RAISED"), ("RAISED", "ATTEMPTED"), ("ATTEMPTED", "ATTEMPTED"), ("RAISED", "RESOLVED"), ("ATTEMPTED", "RESOLVED"), ("RAISED", "ABANDONED"), ("ATTEMPTED", "ABANDONED")]
GAP_RANK = {"RAISED": 0, "ATTEMPTED": 1, "RESOLVED": 2, "ABANDONED": 2}
SIGNAL_GRAPH = [(None, "OPEN"), ("OPEN", "ACKNOWLEDGED"), ("ACKNOWLEDGED", "ACTIONED"), ("OPEN", "DISMISSED"), ("ACKNOWLEDGED", "DISMISSED")]
SIGNAL_RANK = {"OPEN": 0, "ACKNOWLEDGED": 1, "ACTIONED": 2, "DISMISSED": 2}
INVERSE_EDGE = {"SUBSIDIARY_OF": "PARENT_OF", "FRANCHISE_OF": "FRANCHISOR_OF", "ACQUIRED_BY": "ACQUIRER_OF", "SISTER_OF": "SISTER_OF"}
HIGH_PRIORITY = ["population", "market_size_estimate.sam_min", "market_size_estimate.sam_max", "market_vertical_profile.fit_score", "market_vertical_profile.sam"]
MARKET_PREFIXES = ["gdp_", "real_gdp_", "innovation_", "manufacturing_", "software_", "language_", "timezone_", "b2b_", "technology_spending_"]
MARKET_SCOPED = ["population", "market_size_estimate.sam_min", "market_size_estimate.sam_max", "market_size_estimate.ticket_min_usd", "market_size_estimate.ticket_max_usd", "base_market_score"]
VERTICAL_SCOPED = ["market_vertical_profile.fit_score", "market_vertical_profile.sam"]
CANDIDATE_WEIGHTS = {"exact_name": 0.45, "group_domain": 0.10, "fuzzy_name": 0.10}
AUTO_MATCH, AMBIGUOUS = 0.80, 0.45

#: component, component weight, kind, term weight, metric, transform, inverted, native
BASE_MODEL = [
    ("economic_strength_20", 20.0, "percentile_sum", 12.0, "gdp_nominal", "log", False, True),
    ("economic_strength_20", 20.0, "percentile_sum", 8.0, "gdp_per_capita", "log", False, True),
    ("technology_investment_readiness_20", 20.0, "percentile_sum", 20.0, "innovation_digital_proxy", "none", False, True),
    ("digitalization_opportunity_15", 15.0, "percentile_product", 15.0, "gdp_per_capita", "log", False, True),
    ("digitalization_opportunity_15", 15.0, "percentile_product", 15.0, "innovation_digital_proxy", "none", True, True),
    ("icp_density_proxy_20", 20.0, "percentile_sum", 9.0, "population", "log", False, False),
    ("icp_density_proxy_20", 20.0, "percentile_sum", 7.0, "manufacturing", "log", False, False),
    ("icp_density_proxy_20", 20.0, "percentile_sum", 4.0, "gdp_nominal", "log", False, False),
    ("ability_to_pay_10", 10.0, "percentile_sum", 10.0, "gdp_per_capita", "log", False, True),
    ("gtm_ease_10", 10.0, "linear", 4.0, "language_ease", "none", False, True),
    ("gtm_ease_10", 10.0, "linear", 3.0, "timezone_ease", "none", False, True),
    ("gtm_ease_10", 10.0, "linear", 3.0, "b2b_email_access", "none", False, True),
    ("outlook_5", 5.0, "percentile_sum", 5.0, "real_gdp_growth", "none", False, True),
]
CONTEXT_WEIGHTS = {"base_prior": 35.0, "vertical_density": 25.0, "icp_availability": 15.0, "ticket_fit": 10.0, "channel_access": 10.0, "reuse": 5.0}
CHANNEL_WEIGHTS = {"email": (0.70, 0.30, None), "phone": (None, 0.40, 0.60), "linkedin": (None, 0.70, 0.30), "partner": (None, 0.50, 0.50), "event": (None, 0.50, 0.50), "multichannel": (0.40, 0.35, 0.25)}
MIN_COVERAGE = 0.5


def config_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The literals as tables; a new version of a model is new rows."""
    pairs = lambda d, k, v: spark.createDataFrame([(a, float(b)) for a, b in d.items()], f"{k} string, {v} double")
    return {
        "base_model": spark.createDataFrame(BASE_MODEL, "component string, weight double, kind string, term_weight double, metric_key string, transform string, inverted boolean, native boolean"),
        "fact_factor": pairs(FACT_FACTOR, "fact_type", "factor"),
        "recency_factor": pairs(RECENCY_FACTOR, "granularity", "factor"),
        "label_factor": pairs(LABEL_FACTOR, "label", "factor"),
        "trust": pairs(TRUST, "source_class", "trust"),
        "gap_graph": spark.createDataFrame(GAP_GRAPH, "previous string, event_kind string"),
        "signal_graph": spark.createDataFrame(SIGNAL_GRAPH, "previous string, event_kind string"),
        "context_weights": pairs(CONTEXT_WEIGHTS, "component", "weight"),
        "channel_weights": spark.createDataFrame([(k, *v) for k, v in CHANNEL_WEIGHTS.items()], "channel string, email double, language double, timezone double"),
        "inverse_edge": spark.createDataFrame(list(INVERSE_EDGE.items()), "edge_type string, inverse_type string"),
    }


#: What tells the rows of each registry apart; the other columns are its values.
REGISTRY_KEYS = {
    "base_model": ["component", "metric_key", "transform"], "fact_factor": ["fact_type"], "recency_factor": ["granularity"], "label_factor": ["label"], "trust": ["source_class"],
    "gap_graph": ["previous", "event_kind"], "signal_graph": ["previous", "event_kind"], "context_weights": ["component"], "channel_weights": ["channel"], "inverse_edge": ["edge_type"],
}


def absent_rows(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not stored, one per key (the first by its other columns); a null key is a key. A stored key keeps
    its values, so appending the result twice, or after a value was changed by hand, adds nothing."""
    order = [F.col(c) for c in rows.columns if c not in keys]
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)])))).where("_r = 1").drop("_r")
    there = stored.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return first.join(there, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def seed_tables(spark: SparkSession, stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What each stored registry lacks: rows of ``config_tables`` whose key is not in the table of that name. Appending them
    twice adds nothing; a table that is not stored yet gets all its rows."""
    tables = config_tables(spark)
    return {name: absent_rows(rows, stored.get(name, rows.limit(0)), REGISTRY_KEYS[name]) for name, rows in tables.items()}
