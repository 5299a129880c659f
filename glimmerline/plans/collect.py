"""The source stage: official discovery, social and search acquisition to one raw table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..operators.ordering import with_positions
from ..session import written
from ..sources.payloads import document_records, official_records, search_records, union_batches
from .acquisition import search_discovery, social_batches
from .discovery import discover
from .ingestion import canonical_candidates, is_seed, with_children
from .pages import expand_listings, with_candidate_fields
from .run import run_layers


@dataclass(frozen=True)
class Official:
    """Sources, and what was landed of their feeds, sitemaps, lists and listing pages."""

    sources: DataFrame
    feeds: DataFrame
    sitemaps: DataFrame
    apis: DataFrame
    pages: DataFrame
    mode: str = "balanced"


@dataclass(frozen=True)
class Social:
    sources: DataFrame
    payloads: DataFrame
    comments: DataFrame


@dataclass(frozen=True)
class Search:
    """Monitors and providers, landed responses, the official domains, and the fetched pages of the candidates."""

    monitors: DataFrame
    providers: DataFrame
    payloads: DataFrame
    domains: DataFrame
    fetched: DataFrame
    min_score: float = 0.3


def official_candidates(given: Official, max_child_links: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, report). Listing seeds stay, followed by the item pages that they open."""
    found, report = discover(given.sources, given.feeds, given.sitemaps, given.apis, mode=given.mode)
    # `pos` is only an order here, so no global position is needed
    ranked = found.withColumn("pos", F.struct(F.col("priority").isNull(), -F.col("priority"), "source_id", F.col("url").alias("at")))
    first = written(canonical_candidates(with_candidate_fields(ranked)), "candidates")
    pages = given.pages.withColumn("url", urls.canonical_url(F.col("url")))
    return with_children(first, expand_listings(first.filter(is_seed()), pages, max_child_links)), report


def collect_sources(official: Official, social: Social, search: Search, now: Column, documents: DataFrame | None = None) -> dict[str, DataFrame]:
    """All channels as one raw table with positions, and what else the channels tell.

    Channels follow each other as official, documents (of an ingestion run, if
    given), social, social fallbacks, search; within a channel rows are ordered
    by provider and external id.
    """
    candidates, report = official_candidates(official)
    posts = social_batches(social.sources, social.payloads, social.comments)
    ranked, _ = search_discovery(search.monitors, search.providers, search.payloads, search.domains, now, min_score=search.min_score)
    hits, errors = search_records(ranked, search.fetched)
    channels = {"official": official_records(candidates)}
    if documents is not None:
        channels["documents"] = document_records(documents)
    channels |= {"social": posts["records"], "social_fallback": posts["fallback"], "search": hits}
    every = written(union_batches(**channels), "channels")  # the range sort reads its input twice
    raw = with_positions(every, ["channel_order", "provider_id", "external_id"], "pos")
    return {"raw": raw, "discovery_report": report, "social_health": posts["health"], "search_errors": errors}


def run_from_sources(official: Official, social: Social, search: Search, now: Column, documents: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five-layer run, beginning with its sources."""
    collected = collect_sources(official, social, search, now, documents)
    return run_layers(collected["raw"]) | {k: v for k, v in collected.items() if k != "raw"}
