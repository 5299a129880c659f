"""Search and social acquisition as batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import top_n_per
from ..session import cut_lineage, written
from ..sources.payloads import hn_item_candidates, hn_search_candidates, reddit_candidates, search_results
from ..sources.registry import monitor_providers
from ..sources.search import (
    build_queries, guess_origin, merge_results, planned_searches, route_candidates, score_candidates, top_candidates, with_canonical,
)
from ..sources.social import comment_lines, social_health, social_records, with_comments


def search_discovery(
    monitors: DataFrame, providers: DataFrame, payloads: DataFrame, domains: DataFrame, now: Column,
    top: int | None = None, min_score: float = 0.3, window: str = "7d",
) -> tuple[DataFrame, DataFrame]:
    """(ranked candidates, all results). `payloads(query_id, provider_id, body)` are landed responses."""
    pairs = monitor_providers(monitors, providers)
    plan = planned_searches(build_queries(monitors.filter("enabled")), pairs)
    landed = payloads.select("query_id", "provider_id", "body").join(
        plan.select("query_id", "provider_id", "provider", "monitor_id", "template_at", "text_at"), ["query_id", "provider_id"]
    )
    results = search_results(landed).join(
        plan.select("query_id", "provider_id", "monitor_id", "template_at", "text_at"), ["query_id", "provider_id"]
    )
    # arrival order: monitor, provider, query, rank
    results = written(
        with_canonical(results.withColumn("pos", F.struct("monitor_id", "provider_id", "template_at", "text_at", "rank"))), "results"
    )
    merged = merge_results(results)
    scored = score_candidates(guess_origin(merged, domains), now, window)
    return top_candidates(route_candidates(scored, min_score), top), results


def social_batches(
    sources: DataFrame, payloads: DataFrame, comments: DataFrame, max_comments: int | None = None, comment_chars: int | None = None,
    per_source: bool = False,
) -> dict[str, DataFrame]:
    """Records, fallback records and health of the enabled social sources.

    `payloads(source_id, source_type, platform, form, item, body, error)` are
    landed responses; `comments(external_id, at, author, body, failed)` the
    landed comment rows. Items whose enrichment failed fall back to what
    discovery knows when the source allows it. All items count, unless
    `per_source` holds them to their source's `max_items`; comments are whole
    and all unless bounded here.
    """
    live = sources.filter("enabled")
    mine = payloads.join(live.select("source_id"), "source_id", "left_semi")
    ok = mine.filter(F.col("error").isNull())
    found = (
        reddit_candidates(ok.filter("platform = 'reddit'")).drop("cursor_after")
        .unionByName(hn_search_candidates(ok.filter("platform = 'hackernews' and form = 'search'")))
        .unionByName(hn_item_candidates(ok.filter("platform = 'hackernews' and form = 'item'")))
    )
    known = found.join(live.select("source_id", "max_items", "trust_tier", "include_comments", "metadata_fallback", "priority"), "source_id")
    found = cut_lineage(top_n_per(known, ["source_id"], ["item"], F.greatest(F.lit(1), "max_items")) if per_source else known)
    failed = comments.filter("failed").select("external_id").distinct().withColumn("_failed", F.lit(True))
    marked = found.join(failed, "external_id", "left").withColumn("_failed", F.coalesce("_failed", F.lit(False)))
    good = comments.filter("not failed")
    lines = comment_lines(good.join(found.select("external_id"), "external_id", "left_semi"), max_comments, comment_chars)
    asked = marked.filter("include_comments and not _failed")
    plain = marked.filter("not include_comments and not _failed").withColumn("comment_context", F.lit(""))
    enriched = with_comments(asked, lines).unionByName(plain)
    fallback = marked.filter("_failed and metadata_fallback").withColumn("comment_context", F.lit(""))
    as_records = lambda df, only: social_records(df.withColumn("metadata_only", F.lit(only)))
    tries = mine.join(live.select("source_id", "platform"), ["source_id", "platform"]).select(
        "source_id", "platform", F.col("item").alias("pos"), F.col("error").isNull().alias("success"), "error", F.lit(False).alias("fallback"),
    )
    fell = fallback.groupBy("source_id").agg(F.count("*").alias("fell"))
    health = social_health(tries).join(fell, "source_id", "left").withColumn(
        "metadata_fallback_used", F.coalesce("fell", F.lit(0))
    ).drop("fell")
    return {"records": as_records(enriched, False), "fallback": as_records(fallback, True), "health": health}
