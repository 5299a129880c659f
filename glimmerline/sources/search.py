"""Search monitors, results and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..functions.arrays import clamp, first_nonempty, short_hash, strings
from ..functions.dates import window_cutoff
from ..functions.text import strip_ends
from ..functions.vocab import DEFAULT_RISK_TERMS, SOCIAL_HOSTS


# --- F33 --------------------------------------------------------------------------------
def build_queries(monitors: DataFrame) -> DataFrame:
    """one row per monitor, template and term."""
    full = lambda c: F.size(F.coalesce(F.col(c), F.array())) > 0
    risk = F.when(full("risk_terms"), F.col("risk_terms")).otherwise(strings(DEFAULT_RISK_TERMS))
    products = F.when(full("products"), F.col("products")).otherwise(F.array("topic"))
    rivals = F.coalesce("competitors", F.expr("CAST(array() AS ARRAY<STRING>)"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    topic = quoted(F.col("topic"))
    t = F.col("template")
    texts = (
        F.when(t == "brand_updates", F.array(F.concat(topic, F.lit(" (announcement OR update OR roadmap)"))))
        .when(t == "brand_risk", F.array(F.concat(topic, F.lit(" ("), F.array_join(F.transform(risk, quoted), " OR "), F.lit(")"))))
        .when(t == "product_updates", F.transform(products, lambda p: F.concat(quoted(p), F.lit(" (release OR changelog OR launch)"))))
        .when(t == "product_feedback", F.transform(products, lambda p: F.concat(quoted(p), F.lit(" (review OR complaint OR feedback)"))))
        .when(t == "competitor_tracking",
              F.transform(rivals, lambda c: F.concat(topic, F.lit(" "), quoted(c), F.lit(" (benchmark OR compare OR pricing)"))))
        .when(t == "industry_trend", F.array(F.concat(topic, F.lit(" (trend OR forecast OR adoption)"))))
        .otherwise(F.array(topic))
    )
    known = t.isin("brand_updates", "brand_risk", "product_updates", "product_feedback", "competitor_tracking", "industry_trend")
    templates = F.when(full("query_templates"), F.col("query_templates")).otherwise(F.array(F.lit("brand_updates")))
    rows = monitors.select("*", F.posexplode(templates).alias("template_at", "template")).withColumn(
        "intent", F.when(known, t).otherwise("fallback")
    )
    rows = rows.select("*", F.posexplode(texts).alias("text_at", "_text")).filter(F.trim("_text") != "")
    digest = short_hash(F.concat_ws("|", "monitor_id", "intent", "_text"), 16)
    return rows.select(
        F.concat_ws(":", "monitor_id", digest).alias("query_id"), "monitor_id", F.col("topic").alias("topic_id"),
        strip_ends(F.col("_text")).alias("text"), "intent", "template", "template_at", "text_at",
        *[c for c in ("language", "region", "time_window", "priority") if c in monitors.columns],
    )


def planned_searches(queries: DataFrame, monitor_providers: DataFrame) -> DataFrame:
    """Every query of a monitor on each of its enabled providers."""
    return queries.join(monitor_providers.select("monitor_id", "provider_id", "provider"), "monitor_id")


# --- A1 -----------------------------------------------------------------------------------
def with_canonical(results: DataFrame) -> DataFrame:
    """Result rows with their `canonical_url`; results that several steps read carry it already."""
    return results if "canonical_url" in results.columns else results.withColumn("canonical_url", urls.canonical_url(F.col("url")))


def merge_results(results: DataFrame) -> DataFrame:
    """A1: result rows with a `pos` order to one candidate per canonical url.

    Query and provider ids are reduced to distinct values first; a url that
    fills a third of the results is combined map-side.
    """
    from ..operators.unions import ordered_unions

    rows = with_canonical(results)
    head = rows.groupBy("canonical_url").agg(
        F.min_by(F.struct("url", "title", "snippet"), "pos").alias("h"), F.max("published_hint").alias("published_hint"),
        F.min("pos").alias("pos"), F.count("*").alias("evidence_count"),
    )
    lists = ordered_unions(
        rows, ["canonical_url"], F.col("pos"),
        {"matched_queries": F.array("query_id"), "provider_hits": F.array("provider_id")},
    )
    return head.join(lists, "canonical_url").select(
        F.concat(F.lit("search:"), short_hash(F.col("canonical_url"), 20)).alias("candidate_id"), "canonical_url", "pos",
        "h.url", F.col("h.title").alias("title_hint"), F.col("h.snippet").alias("summary_hint"), "published_hint",
        urls.netloc(F.col("canonical_url")).alias("domain"), "matched_queries", "provider_hits", "evidence_count",
    )


def provider_evidence(results: DataFrame) -> DataFrame:
    """A1: the evidence rows behind the candidates, kept as rows."""
    return with_canonical(results).select(
        F.concat(F.lit("search:"), short_hash(F.col("canonical_url"), 20)).alias("candidate_id"), "pos",
        F.col("provider_id").alias("provider"), "rank", "title", "snippet",
    )


# --- F28, F29, F31 ----------------------------------------------------------------------------
def guess_origin(candidates: DataFrame, domains: DataFrame) -> DataFrame:
    """First party, community or external."""
    known = domains.select(F.col("domain").alias("_d")).distinct()
    joined = candidates.join(known, F.col("domain") == F.col("_d"), "left")
    return joined.withColumn(
        "likely_origin_type",
        F.when(F.col("_d").isNotNull(), "first_party").when(F.col("domain").isin(*SOCIAL_HOSTS), "community").otherwise("external_web"),
    ).drop("_d")


def score_candidates(candidates: DataFrame, now: Column, time_window: Column | str = "7d") -> DataFrame:
    """score and explain list."""
    window = F.lit(time_window) if isinstance(time_window, str) else time_window
    cutoff = window_cutoff(window, now)
    queries, providers = F.size("matched_queries"), F.size("provider_hits")
    fresh = F.coalesce(F.col("published_hint") >= cutoff, F.lit(False))
    origin = F.col("likely_origin_type")
    titled = F.length(F.coalesce("title_hint", F.lit(""))) > 10
    score = (
        F.least(F.lit(0.35), queries * 0.1) + F.least(F.lit(0.25), providers * 0.08) + F.when(fresh, 0.2).otherwise(0.0)
        + F.when(origin == "first_party", 0.15).when(origin == "community", 0.1).otherwise(0.0)
        + F.when(titled, 0.05).otherwise(0.0)
    )
    explain = F.array_compact(
        F.array(
            F.concat(F.lit("query_hits="), queries.cast("string")), F.concat(F.lit("provider_hits="), providers.cast("string")),
            F.when(fresh, "freshness=within_window").when(F.col("published_hint").isNotNull(), "freshness=stale_or_unknown")
            .otherwise("freshness=missing"),
            F.when(origin == "first_party", "origin=first_party_bonus").when(origin == "community", "origin=community_bonus")
            .otherwise("origin=external_web"),
            F.when(titled, F.lit("title_signal=good")),
        )
    )
    return candidates.withColumns({"score": clamp(score), "explain": explain})


def route_candidates(scored: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Route, fetch priority and the closing explain lines."""
    origin = F.col("likely_origin_type")
    routed = scored.withColumn(
        "route",
        F.when(F.col("score") < min_score, "skip_low_value").when(origin == "first_party", "route_to_official_reconcile")
        .when(origin == "community", "route_to_social_reconcile").otherwise("route_to_web_fetch"),
    )
    return routed.withColumns(
        {
            "fetch_priority": F.floor(F.col("score") * 100).cast("int"),
            "explain": F.concat(
                "explain", F.array(F.format_string("final_score=%.3f", "score"), F.concat(F.lit("route="), "route"))
            ),
        }
    )


def top_candidates(routed: DataFrame, n: int | None = None) -> DataFrame:
    """Best fetch priority first, arrival order breaks ties."""
    from ..operators.ordering import top_n

    return top_n(routed, [F.desc("fetch_priority"), F.col("pos")], n)


def common_candidates(routed: DataFrame) -> DataFrame:
    """Ranked rows in the shared candidate schema."""
    url = F.coalesce(first_nonempty(F.col("canonical_url")), F.col("url"))
    return routed.select(
        F.concat(F.lit("search:"), "candidate_id").alias("source_id"), F.lit("search_discovery").alias("provider"),
        F.lit("html_listing").alias("transport"), url.alias("external_id"), url.alias("url"), F.col("title_hint").alias("title"),
        F.col("summary_hint").alias("summary"), F.col("published_hint").alias("published_at"),
        F.col("route").alias("search_route"), "fetch_priority", "likely_origin_type", "provider_hits",
    )


def fetch_plans(routed: DataFrame) -> DataFrame:
    """Plans for the candidates that need a page."""
    return routed.filter("route = 'route_to_web_fetch'").select(
        F.concat(F.lit("search:"), "candidate_id").alias("source_id"), F.lit("search_discovery").alias("company"),
        F.coalesce(first_nonempty(F.col("canonical_url")), F.col("url")).alias("url"), F.lit("direct_html").alias("mode"),
        F.lit("search_candidate_fetch").alias("reason"),
    )


def trace_payload(evidence: Column) -> Column:
    """The explain payload of a candidate as JSON."""
    return F.to_json(
        F.struct(
            "candidate_id", "canonical_url", "matched_queries", "provider_hits",
            F.array(F.lit("web_search")).alias("discovery_channels"), "likely_origin_type", "score",
            evidence.alias("provider_evidence"),
        )
    )
