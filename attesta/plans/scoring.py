"""Market scores: observations, percentiles, components, coverage-gated ranks, contexts and research gaps."""

from __future__ import annotations

import functools
from operator import add, and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import columns as fn
from attesta.functions import config as cfg
from attesta.operators import relational as rel
from attesta.sources.io import append_absent, staged


def classify_snapshots(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """NOOP for a digest that is stored, CONFLICT for a stored key with another digest, else NEW."""
    d = stored.select("digest").distinct().withColumn("_d", F.lit(True))
    k = stored.select("snapshot_key").distinct().withColumn("_k", F.lit(True))
    j = incoming.join(d, "digest", "left").join(k, "snapshot_key", "left")
    return j.withColumn("status", F.when(F.col("_d"), "NOOP").when(F.col("_k"), "CONFLICT").otherwise("NEW")).drop("_d", "_k")


def unpivot_metrics(df: DataFrame, ids: list[str], metric_map: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Wide raw metrics as observations. ``metric_map``: column to (fact type, granularity, unit). Null rows stay, as NOT_AVAILABLE."""
    long = df.unpivot(ids, list(metric_map), "metric_key", "value")
    info = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in metric_map.items() for x in (k, v[i])]), F.col("metric_key"))
    seen = F.col("value").isNotNull()
    return long.select(*ids, "metric_key", "value", F.when(seen, "OBSERVED").otherwise("NOT_AVAILABLE").alias("availability"), F.when(seen, info(0)).alias("fact_type"), info(1).alias("granularity"), info(2).alias("unit"))


def spending_growth(df: DataFrame, value: str = "value_pct", year: str = "year", period: str = "period", fact: str = "fact_type") -> DataFrame:
    """A dated observation whose precision is what the source declares; N/D is not available."""
    missing = F.col(value).isNull() | (F.upper(F.coalesce(F.col(fact), F.lit("N/D"))) == "N/D")
    kind = F.when(F.col(year).isNotNull(), "YEAR").when(F.col(period).isNotNull(), "SNAPSHOT").otherwise("UNDATED")
    return df.withColumns({"metric_key": F.lit("technology_spending_growth"), "value": F.when(~missing, F.col(value)), "fact_type": F.when(~missing, F.col(fact)), "availability": F.when(missing, "NOT_AVAILABLE").otherwise("OBSERVED"), "granularity": kind})


def attribute_sources(obs: DataFrame, market_sources: DataFrame, hints: dict[str, list[str]], by: str = "market_key") -> DataFrame:
    """EXPLICIT where the observation names the source, METRIC_HINT where the source is one for the metric, else MARKET_LEVEL."""
    j = obs.join(market_sources.select(by, "source_key"), by)
    hint = F.coalesce(F.array_contains(F.element_at(F.create_map(*[x for k, v in hints.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]), F.col("metric_key")), F.col("source_key")), F.lit(False))
    named = F.coalesce(F.col("explicit_source") == F.col("source_key"), F.lit(False))
    return j.withColumn("attribution", F.when(named, "EXPLICIT").when(hint, "METRIC_HINT").otherwise("MARKET_LEVEL"))


def reference_reproduction(components: DataFrame, weights: dict[str, float], by: str = "market_key") -> DataFrame:
    """Sum of imported components without renormalisation; the universe is who has one, coverage what part of the weights."""
    names = [(k, v) for k, v in weights.items()]
    slots = F.array(*[F.struct(F.lit(k).alias("component"), F.lit(v).alias("weight")) for k, v in names])
    universe = components.where("value is not null").select(by).distinct().withColumn("c", F.explode(slots)).select(by, "c.*")
    j = universe.join(components.select(by, "component", "value"), [by, "component"], "left")
    return j.groupBy(by).agg(F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("score"), (F.sum(F.when(F.col("value").isNotNull(), F.col("weight"))) / F.sum("weight")).alias("coverage"))


def component_scores(obs: DataFrame, model: list[tuple] = cfg.BASE_MODEL, by: str = "market_key", declared: int | None = None) -> DataFrame:
    """(market, component, weight, earned, confidence, missing) of every market with an observation; earned is null where
    a required metric is missing or the component is not native. A percentile's universe is its own observed values. A market
    has a metric once (``validate.uniqueness``); of several the greatest counts."""
    logged = sorted({r[4] for r in model if r[5] == "log"})
    ranked = sorted({r[4] for r in model if r[2] != "linear"})
    metric = F.col("metric_key")
    x = F.when(metric.isin(logged), fn.log_transform("value")).otherwise(F.col("value"))
    v = obs.where("value is not null").select(by, "metric_key", x.alias("x"), F.when(metric.isin(ranked), x).alias("y"), fn.evidence_confidence("fact_type", "granularity", "label").alias("conf"))
    v = rel.with_percentile(staged(v, "observed"), "y", ["metric_key"], "p", declared)
    # a market's values side by side: one row of as many columns as the model has metrics, and every component a sum over it
    names = sorted({r[4] for r in model})
    col = lambda m, c: F.col(f"{c}{names.index(m)}")
    wide = v.groupBy(by).agg(*(F.max(F.when(metric == m, F.col(c))).alias(f"{c}{i}") for i, m in enumerate(names) for c in ("x", "p", "conf")))

    def component(name: str) -> Column:
        terms = [r for r in model if r[0] == name]
        _, weight, kind, _, _, _, _, native = terms[0]
        parts = [col(r[4], "x") if kind == "linear" else 1 - col(r[4], "p") if r[6] else col(r[4], "p") for r in terms]
        whole = functools.reduce(and_, [x.isNotNull() for x in parts], F.lit(native))
        lacks = F.array_compact(F.array(*(F.when(x.isNull(), F.lit(r[4])) for r, x in zip(terms, parts, strict=True))))
        return F.struct(
            F.lit(name).alias("component"), F.lit(weight).alias("weight"), F.lit(kind).alias("kind"), F.lit(native).alias("native"), whole.alias("whole"),
            functools.reduce(add, [F.lit(r[3]) * x for r, x in zip(terms, parts, strict=True)]).alias("sum"),
            F.when(whole & F.lit(kind == "percentile_product"), F.round(functools.reduce(mul, parts), 12)).alias("pp"),
            (functools.reduce(add, [F.coalesce(col(r[4], "conf"), F.lit(0.0)) for r in terms]) / len(terms)).alias("confidence"),
            F.array_sort(F.array_distinct(lacks)).alias("missing"),
        )

    g = wide.select(by, F.inline(F.array(*(component(c) for c in dict.fromkeys(r[0] for r in model)))))
    g = staged(g, "components")  # read again for its percentiles
    g = rel.with_percentile(g.withColumnRenamed("pp", "product_"), "product_", ["component"], "pp")
    earned = F.when(F.col("whole"), F.when(F.col("kind") == "percentile_product", F.col("weight") * F.col("pp")).otherwise(F.col("sum")))
    return g.select(by, "component", "weight", F.round(earned, 6).alias("earned"), F.round("confidence", 6).alias("confidence"), "missing", "native")


def native_recalculation(obs: DataFrame, home: Column, model: list[tuple] = cfg.BASE_MODEL, minimum: float = cfg.MIN_COVERAGE, by: str = "market_key", scope: list[str] | None = None) -> DataFrame:
    """Score, coverage, confidence and gated rank of every market with an observation; none at all is refused."""
    s = rel.coverage_score(component_scores(obs, model, by), [by], confidence="confidence")
    s = staged(s.withColumn("is_home_market", home), "scores")
    return refuse_empty(rel.gated_rank(s, scope or [], minimum=minimum), "no market has an observation, so nothing can be scored")


def engine_gaps(components: DataFrame, by: str = "market_key") -> DataFrame:
    """(market, metric, reason): metrics that a component lacks, and components that are blocked for all."""
    g = components.where(F.size("missing") > 0).withColumn("metric_key", F.explode("missing"))
    return g.groupBy(by, "metric_key").agg(F.concat_ws(",", F.array_sort(F.collect_set("component"))).alias("reason"))


def universe_definition(obs: DataFrame) -> DataFrame:
    return obs.groupBy("metric_key").agg(F.count("value").alias("observed"))


def universe_members(obs: DataFrame, by: str = "market_key") -> tuple[DataFrame, DataFrame]:
    """(members, index): who is in the universe of each metric, as bitmaps (metric_key, bucket, members) over the places
    (by, bucket, bit) that the index gives every market. A bitmap holds 32,768 places, so a metric of any size is many rows.

    Unions are ``bitmap_or_agg`` over the metrics, counts are sums of ``bitmap_count``; see ``union_count`` and ``members_of``.
    """
    seen = obs.where("value is not null").select("metric_key", by).distinct()
    place = F.monotonically_increasing_id() + 1  # gapless within a task, so few buckets are thin
    index = staged(seen.select(by).distinct().withColumn("place", place), "universe-index")
    index = index.select(by, F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit"))
    return seen.join(index, by).groupBy("metric_key", "bucket").agg(F.bitmap_construct_agg("bit").alias("members")), index


def union_count(members: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(observed) of the union of some metrics' universes, or of all."""
    d = members if metrics is None else members.where(F.col("metric_key").isin(metrics))
    return d.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("members")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("observed"))


def members_of(members: DataFrame, index: DataFrame) -> DataFrame:
    """The markets of each bitmap: (metric_key, by)."""
    byte = F.conv(F.hex(F.substring(F.col("members"), F.expr("cast(bit div 8 as int)") + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.getbit(byte, F.expr("cast(bit % 8 as int)")) == 1
    return members.join(index, "bucket").where(inside).select("metric_key", *[c for c in index.columns if c not in ("bucket", "bit")])


def refuse_empty(df: DataFrame, why: str) -> DataFrame:
    """``df``, or an error with ``why`` when it is read and has no row. The check is part of the plan: nothing is collected."""
    check = df.limit(1).agg(F.count(F.lit(1)).alias("n")).where(F.assert_true(F.col("n") > 0, why).isNotNull())
    return df.unionByName(check.select(*(F.lit(None).cast(kind).alias(c) for c, kind in df.dtypes)))


def resolve_threshold(request: Column, model: Column, default: float) -> Column:
    """The least coverage to compare at: the request's, else the model's, else the default. One outside [0, 1] is refused."""
    t = F.coalesce(request, model, F.lit(default))
    return F.when((t >= 0) & (t <= 1), t).otherwise(F.raise_error(F.concat(F.lit("min_coverage must be between 0 and 1: "), t.cast("string"))).cast("double"))


def refuse_incomparable(scores: DataFrame) -> DataFrame:
    """``scores``, or an error when they are read and a context that does not allow low coverage has no comparable market."""
    c = scores.groupBy("context_key").agg(F.bool_or("comparable").alias("_any"), F.bool_or(F.coalesce("allow_low_coverage", F.lit(False))).alias("_allowed"))
    why = F.concat(F.lit("no market in context "), F.col("context_key"), F.lit(" reached the minimum coverage; allow low coverage to see the partial evidence"))
    d = scores.join(c, "context_key").withColumn("comparable", F.when(F.col("_any") | F.col("_allowed"), F.col("comparable")).otherwise(F.raise_error(why).cast("boolean")))
    return d.drop("_any", "_allowed")


def require_nonempty(df: DataFrame, why: str) -> DataFrame:
    if df.limit(1).isEmpty():
        raise ValueError(why)
    return df


def compare_runs(a: DataFrame, b: DataFrame, key: str = "market_key") -> DataFrame:
    """One row: matched markets, greatest delta, ranks that moved."""
    return rel.compare(a, b, key).agg(F.count(F.lit(1)).alias("matched"), F.max("delta").alias("max_delta"), F.sum(F.col("rank_moved").cast("long")).alias("rank_mismatches"))


# --- contexts ---------------------------------------------------------------------------------------------------------


def _channel(m: str) -> Column:
    """Weighted mean over the channel's observed inputs, and the share of weight observed."""
    cases = []
    for name, weights in cfg.CHANNEL_WEIGHTS.items():
        used = [(w, c) for w, c in zip(weights, ("email", "language", "timezone"), strict=True) if w]
        total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for w, c in used), F.lit(0.0))
        seen = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for w, c in used), F.lit(0.0))
        cases.append((name, total / F.nullif(seen, F.lit(0.0)) if m == "value" else seen / sum(w for w, _ in used)))
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, c in cases:
        out = out.when(F.col("channel_key") == name, c)
    return out


def context_handlers() -> dict[str, tuple[Column, Column]]:
    """component: (value in [0, 1] or null, confidence). Extend the dictionary to add a component."""
    density = F.coalesce("vertical_fit_score", fn.sam_scale((F.col("vertical_sam_min") + F.col("vertical_sam_max")) / 2))
    ticket = F.coalesce("ticket_usd", (F.col("offer_low") + F.col("offer_high")) / 2)
    motion = F.lower("recommended_channel")
    aligned = F.when(motion.contains(F.lower("channel_key")) | (F.col("channel_key") == "multichannel") & motion.contains("+"), 1.0).otherwise(0.4)
    compared = motion.isNotNull() & F.col("channel_key").isNotNull()
    return {
        "base_prior": (F.col("base_score") / 100, F.lit(0.90)),
        "vertical_density": (density, F.coalesce("vertical_confidence", F.lit(0.5))),
        "icp_availability": (fn.sam_scale((F.col("sam_min") + F.col("sam_max")) / 2), F.when(F.col("sam_fact_type") == "ESTIMATE", 0.65).otherwise(0.5)),
        "ticket_fit": (fn.ticket_overlap(ticket, "ticket_min", "ticket_max"), F.lit(0.65)),
        "channel_access": (_channel("value"), _channel("seen") * 0.5),
        "reuse": (F.when(compared, F.col("language") * 0.75 + aligned * 0.25).otherwise(F.col("language")), F.when(compared, 0.6).otherwise(0.5)),
    }


def contextual_scores(markets: DataFrame, contexts: list[dict], minimum: float = 0.5, weights: dict[str, float] = cfg.CONTEXT_WEIGHTS, model_minimum: float | None = None, refuse: bool = False) -> DataFrame:
    """Every market in every context of a bounded list: score, confidence, coverage, comparable and rank.

    An unknown component leaves numerator and denominator. Ranks count comparable markets, all scored ones where the
    context allows low coverage. A context's min_coverage goes before the model's, and that before ``minimum``. With ``refuse``
    a context without a comparable market ends the query, unless it allows low coverage.
    """
    fields = "struct<context_key:string,channel_key:string,ticket_usd:double,offer_low:double,offer_high:double,allow_low_coverage:boolean,min_coverage:double>"
    rows = F.from_json(F.lit(__import__("json").dumps(contexts)), f"array<{fields}>")
    d = markets.withColumn("_x", F.explode(rows)).select(*markets.columns, "_x.*")
    total = sum(weights.values())
    for name, (value, conf) in context_handlers().items():
        d = d.withColumns({f"v_{name}": fn.clamp(value), f"c_{name}": conf})
    d = staged(d, "context-values")  # else each value's expression stands in every sum below
    z = F.lit(0.0)
    seen = sum((F.when(F.col(f"v_{n}").isNotNull(), w).otherwise(0.0) for n, w in weights.items()), z)
    earned = sum((F.coalesce(F.round(F.col(f"v_{n}") * w, 6), z) for n, w in weights.items()), z)
    conf = sum((F.when(F.col(f"v_{n}").isNotNull(), F.col(f"c_{n}") * w).otherwise(0.0) for n, w in weights.items()), z)
    least = resolve_threshold(F.col("min_coverage"), F.lit(model_minimum).cast("double"), minimum)
    d = d.select("market_key", "is_home_market", "context_key", "allow_low_coverage", F.round(earned / F.nullif(seen, z) * 100 + 1e-9, 4).alias("score"), F.round(seen / total, 4).alias("coverage"), F.round(fn.clamp(conf / F.nullif(seen, z) * seen / total + 1e-9), 4).alias("confidence"), least.alias("_least"))
    d = d.withColumn("comparable", F.col("coverage") >= F.col("_least"))
    gate = F.when(F.coalesce("allow_low_coverage", F.lit(False)), 0.0).otherwise(F.col("_least"))
    d = staged(d, "context-scores")
    ranked = rel.gated_rank(refuse_incomparable(d) if refuse else d, ["context_key"], minimum=gate)
    return ranked.drop("_least", "allow_low_coverage")


def comparable_contexts(scores: DataFrame) -> DataFrame:
    """Contexts with their number of comparable markets, and whether there is any; ``refuse_incomparable`` refuses."""
    return scores.groupBy("context_key").agg(F.bool_or("comparable").alias("answerable"), F.count_if("comparable").alias("n_comparable"))


# --- gaps, profiles, read models --------------------------------------------------------------------------------------


def record_gaps(items: DataFrame, existing: DataFrame, dims: dict[str, str]) -> DataFrame:
    """New gaps: scoped fingerprint, first of each, none that is known. context.* inputs are no gaps."""
    d = items.where(~F.startswith(F.col("metric_key"), F.lit("context.")))
    d = d.withColumns({"fingerprint": fn.gap_fingerprint("metric_key", dims), "priority": fn.gap_priority("metric_key")})
    return append_absent(d, existing, ["fingerprint"], [F.col("metric_key")])


def derive_profiles(deep_dives: DataFrame, sizes: DataFrame, aliases: dict[str, str], by: str = "market_key") -> DataFrame:
    """Market by vertical from priority lists: the first place of each vertical; quantities stay null where unknown."""
    d = deep_dives.select(by, F.posexplode(fn.split_list("priority_verticals")).alias("position", "label"))
    d = d.withColumn("vertical_key", fn.match_vertical("label", aliases)).where("vertical_key is not null")
    return d.groupBy(by, "vertical_key").agg(F.min("position").alias("position")).join(sizes, by, "left")


def gap_list(gaps: DataFrame, order: dict[str, int] | None = None, **filters) -> DataFrame:
    """Filtered gaps; priority in order of its text, or by an order map."""
    d = rel.filter_eq(gaps, **filters)
    p = fn.lookup("priority", {k: float(v) for k, v in order.items()}, 99.0) if order else F.col("priority")
    return d.orderBy(p, "metric_key")


def latest_run(runs: DataFrame, kind: str) -> DataFrame:
    return runs.where(F.col("kind") == kind).agg(F.max_by("run_id", F.struct("completed_at", "run_id")).alias("run_id"))


def market_view(markets: DataFrame, categories: DataFrame, scores: DataFrame, by: str = "market_key") -> DataFrame:
    c = categories.groupBy(by).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    return markets.join(c, by, "left").join(scores.select(by, "score", "rank"), by, "left")


def score_detail(components: DataFrame, gaps: DataFrame, by: str = "market_key") -> DataFrame:
    c = components.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("component", "earned", "weight"))).alias("components"))
    g = gaps.groupBy(by).agg(F.array_sort(F.collect_set("metric_key")).alias("open_gaps"))
    return c.join(g, by, "left")
