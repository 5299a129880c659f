"""Page ingestion from candidates to stored documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..operators.dedup import document_keys, greedy_dedup, keep_first
from ..operators.fetching import gather_results, landed_at, last_results, pick_extractor, plan_access
from ..operators.health import document_health, run_stats, source_health
from ..operators.ordering import top_n, with_positions
from ..session import cut_lineage, written
from ..sources.store import attempt_rows
from .pages import (
    expand_listings, extract_fulltext, extract_index, extract_listing, extract_metadata, metadata_without_result, normalize_documents, with_candidate_fields,
)

_SLIM = ("_row", "url", "pos", "child_at", "canonical_url", "content_hash", "title", "published_at", "source_id", "detail_fetch_attempt",
         "detail_extract_success", "metadata_fallback")
EXTRACTORS = {
    "fulltext": extract_fulltext, "listing": extract_listing, "metadata": extract_metadata, "index": extract_index, "unfetched": metadata_without_result,
}


def canonical_candidates(candidates: DataFrame, pos: str = "pos") -> DataFrame:
    """Allowed urls in canonical form, first per url."""
    allowed = candidates.filter(urls.is_allowed(F.col("url"))).withColumn("url", urls.canonical_url(F.col("url")))
    return keep_first(allowed, ["url"], [pos])


def is_seed() -> Column:
    return F.coalesce("seed", F.lit(False)) | (F.coalesce("hint_doc_type", F.lit("")) == "listing")


def replace_seeds(candidates: DataFrame, children: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """D3: seeds give way to their children, then first per url by priority."""
    expanded = children.select(F.col("parent_listing_url").alias("url")).distinct()
    kept = candidates.filter(~is_seed()).unionByName(candidates.filter(is_seed()).join(expanded, "url", "left_anti"))
    both = kept.withColumn("child_at", F.lit(-1)).unionByName(children, allowMissingColumns=True)
    first = keep_first(both, ["url"], [F.desc("priority"), "pos", "child_at"])
    return top_n(first, [F.desc("priority"), F.col("pos"), F.col("child_at")], max_candidates)


def with_children(candidates: DataFrame, children: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """Seeds followed by their children, first per url."""
    both = candidates.withColumn("child_at", F.lit(-1)).unionByName(children, allowMissingColumns=True)
    return top_n(keep_first(both, ["url"], ["pos", "child_at"]), [F.col("pos"), F.col("child_at")], max_candidates)


def extract(candidates: DataFrame, results: DataFrame, landed: DataFrame) -> DataFrame:
    """Every page through the extractor that its row asks for.

    Candidates and results carry no body. It is joined here, from the landed
    rows that the results name, and goes straight into the extractor. A
    candidate without a result is a document of its own metadata.
    """
    fields = results.select("url", "status_code", "fetch_mode", "block_type", "success", "error", "has_body", "landed_at")
    asked = cut_lineage(
        with_candidate_fields(candidates).join(fields, "url", "left")
        .withColumn("extractor", F.when(F.col("has_body").isNull(), "unfetched").otherwise(pick_extractor(F.col("has_body")))).drop("has_body")
    )
    bodies = landed.select("url", landed_at().alias("landed_at"), "raw_html")
    joined = asked.join(bodies, ["url", "landed_at"], "left").drop("landed_at")
    return reduce(
        DataFrame.unionByName, [job(joined.filter(F.col("extractor") == name)) for name, job in EXTRACTORS.items()]
    )


@dataclass(frozen=True)
class Prepared:
    """What runs over the same candidates and landed responses share: candidates, item pages of their seeds, and last results."""

    first: DataFrame
    children: DataFrame
    last: DataFrame


def prepare(candidates: DataFrame, landed: DataFrame, max_child_links: int | None = None) -> Prepared:
    """The steps of `ingest` that depend neither on health nor on what becomes of the seeds, done once."""
    first = cut_lineage(canonical_candidates(with_candidate_fields(candidates)))
    children = cut_lineage(expand_listings(first.filter(is_seed()), landed, max_child_links))
    return Prepared(first, children, cut_lineage(last_results(landed)))


def ingest(
    candidates: DataFrame, landed: DataFrame, now: Column, health: DataFrame | None = None,
    max_candidates: int | None = None, max_child_links: int | None = None, keep_seeds: bool = False, prepared: Prepared | None = None,
) -> dict[str, DataFrame]:
    """Candidates (with `pos`) and landed responses to documents, attempts, health and counts.

    `health` is the source health that an earlier run returned; it steers the
    access plans and is carried on. Seeds give way to their children (D3), or
    stay before them if `keep_seeds` (D5). Several runs over the same
    candidates and responses share what `prepare` returns.
    """
    if prepared is None:
        first = cut_lineage(canonical_candidates(with_candidate_fields(candidates)))
        children, last = expand_listings(first.filter(is_seed()), landed, max_child_links), None
    else:
        first, children, last = prepared.first, prepared.children, prepared.last
    wanted = cut_lineage(with_children(first, children, max_candidates) if keep_seeds else replace_seeds(first, children, max_candidates))
    planned = plan_access(wanted.drop("anti_bot_score"), health)
    results = cut_lineage(gather_results(planned, landed, last))
    extracted = extract(wanted, results, landed)
    about = wanted.select("url", "source_type", "hint_doc_type", "pos", "child_at").join(
        results.select("url", "status_code", "fetch_mode", "block_type"), "url"
    )
    # written once with a row number, by which the few kept columns find their text again
    docs = written(
        normalize_documents(extracted.join(about, "url")).withColumns({"ingested_at": now, "_row": F.monotonically_increasing_id()}), "documents"
    )
    slim = keep_first(docs.select(*_SLIM), ["url"], ["_row"])  # a body landed twice in one moment is one document
    ordered = cut_lineage(with_positions(slim, ["pos", "child_at", "url"], "doc_pos"))
    chosen = cut_lineage(
        greedy_dedup(
            ordered, "doc_pos",
            document_keys(F.col("canonical_url"), F.col("content_hash"), F.col("title"), F.col("published_at")),
        )
    )
    unique = docs.join(chosen.select("_row", "doc_pos"), "_row").drop("_row")
    timed = results.join(wanted.select("url", F.struct("pos", "child_at").alias("pos")), "url").withColumn("ts", now)
    return {
        "candidates": wanted, "results": results, "documents": unique, "attempts": attempt_rows(results, now),
        "source_health": source_health(timed.select("source_id", "ts", "pos", "block_type", "success"), health),
        "document_health": document_health(chosen),
        "stats": run_stats(discovered=candidates, fetched=results, normalized=ordered, deduped=chosen),
    }
