"""Official discovery over landed payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.dedup import keep_first
from ..operators.health import discovery_report
from ..operators.ordering import top_n
from ..sources.payloads import feed_candidates, last_landed, rest_candidates, sitemap_candidates
from ..sources.registry import listing_seeds, resolve_transports, stamp_candidates, with_strategy
from ..session import cut_lineage, written

_COMMON = ["id", "company", "transport", "turn", "item", "url", "hint_doc_type", "title", "snippet", "date", "published_at"]


def discover(
    sources: DataFrame, feeds: DataFrame, sitemaps: DataFrame, apis: DataFrame,
    max_candidates: int | None = None, mode: str = "balanced",
) -> tuple[DataFrame, DataFrame]:
    """(candidates, report). Payload tables are keyed by `url`, with `body`; the last landed body of a url counts."""
    turns = resolve_transports(sources, mode)
    most = 2**31 - 1 if max_candidates is None else max_candidates
    sized = turns.withColumn(
        "cap", F.greatest(F.lit(8), F.floor(F.lit(most) / F.count("*").over(Window.partitionBy("id"))).cast("int"))
    )  # a source has a handful of transports
    turns = cut_lineage(sized)
    of = lambda kind: turns.filter(F.col("transport") == kind)
    null = lambda kind: F.lit(None).cast(kind)
    base = ["id", "company", "transport", "turn", "cap"]

    rss = feed_candidates(
        of("rss").join(last_landed(feeds, "url").select(F.col("url").alias("transport_url"), "body"), "transport_url").select(*base, "body"), F.col("cap")
    )
    rest = rest_candidates(
        of("rest_api").join(last_landed(apis, "url").select(F.col("url").alias("transport_url"), "body"), "transport_url")
        .select(*base, F.col("transport_url").alias("list_url"), "items_path", "field_map", "body"), F.col("cap")
    ).withColumns({"date": null("string"), "published_at": null("timestamp")})
    maps = sitemap_candidates(
        of("sitemap").select(F.concat_ws("\u0001", "id", "turn").alias("source_id"), F.col("transport_url").alias("sitemap_url")),
        sitemaps.withColumnRenamed("url", "sitemap_url"), max_candidates,
    )
    if max_candidates is None:
        ranked = maps.withColumn("item", F.element_at("trail", -1))  # no cap, so no rank is needed
    else:
        w = Window.partitionBy("source_id").orderBy("trail")  # cut to max_candidates before
        ranked = maps.withColumn("item", F.row_number().over(w) - 1)
    maps = (
        ranked.join(of("sitemap").withColumn("source_id", F.concat_ws("\u0001", "id", "turn")), "source_id")
        .filter(F.col("item") < F.col("cap"))
        .select(*base, "item", ranked["url"], F.lit("article").alias("hint_doc_type"), null("string").alias("title"),
                null("string").alias("snippet"), null("string").alias("date"), null("timestamp").alias("published_at"))
    )
    seeds = listing_seeds(turns).withColumn("transport", F.lit("html_listing"))
    found = (
        rss.select(*_COMMON).unionByName(rest.select(*_COMMON)).unionByName(maps.select(*_COMMON)).unionByName(seeds.select(*_COMMON))
    )
    found = written(found, "found")
    got = found.groupBy("id", "turn").agg(F.count("*").alias("found"))
    tried = turns.select("id", "turn", "transport_collection_mode").join(got, ["id", "turn"], "left").na.fill(0, ["found"])
    # the first transport that returned rows ends a fallback chain
    winner = tried.filter("found > 0").groupBy("id").agg(F.min("turn").alias("win"))
    tried = tried.join(winner, "id", "left")
    fallback = F.col("transport_collection_mode") == "prefer_fallback"
    used = tried.filter(~fallback | F.col("win").isNull() | (F.col("turn") <= F.col("win")))
    report = discovery_report(used.select(F.col("id").alias("source_id"), "found", F.lit(None).cast("string").alias("error")))
    rows = found.join(used.select("id", "turn", "transport_collection_mode", "win"), ["id", "turn"])
    kept = rows.filter(~fallback | (F.col("turn") == F.col("win")))
    first = keep_first(kept, ["id", "url"], ["turn", "item"])  # D4
    best = top_n(
        stamp_candidates(first, sources).join(sources.select("id", "source_pos"), "id"),
        [F.desc("priority"), F.col("source_pos"), F.col("turn"), F.col("item")], max_candidates,
    )
    about = with_strategy(sources).select(
        "id", F.col("type").alias("source_type"), "source_strategy", "follow_detail_pages", "protected_policy", "display_name",
        "path_contains_any", "exclude_path_substrings", "allow_aggregate_paths",
    )
    out = best.join(about, "id").withColumns(
        {"source_id": F.col("id"), "seed": F.col("hint_doc_type") == "listing", "published_hint": F.col("published_at").cast("string")}
    ).drop("id", "win", "published_at")
    return out, report
