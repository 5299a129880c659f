"""Source, provider and monitor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls
from ..functions.arrays import first_nonempty
from ..functions.vocab import FULLTEXT_SOURCES, PROTECTED_SOURCES

STRATEGY = (
    "struct<transport:string,enabled:boolean,priority:int,url:string,items_path:string,"
    "field_map:map<string,string>>"
)
SOURCE_FIELDS = {
    "type": "string", "url": "string", "access": "string", "priority": "string", "enabled": "boolean",
    "display_name": "string", "source_strategy": "string", "preferred_discovery_mode": "string",
    "follow_detail_pages": "boolean", "metadata_fallback": "boolean", "protected_policy": "string",
    "content_quality_expectation": "string", "path_contains_any": "array<string>",
    "exclude_path_substrings": "array<string>", "allow_aggregate_paths": "boolean",
    "strategies": f"array<{STRATEGY}>", "transport_collection_mode": "string", "rss_url": "string",
    "sitemap_url": "string", "api_list_url": "string", "api_items_path": "string",
    "api_field_map": "map<string,string>",
}
SOURCE_DEFAULTS = {
    "access": "listing_only", "priority": "medium", "enabled": True, "preferred_discovery_mode": "auto",
    "protected_policy": "degrade", "content_quality_expectation": "medium", "transport_collection_mode": "combine",
}


def _fill(df: DataFrame, fields: dict[str, str], defaults: dict) -> DataFrame:
    for name, kind in fields.items():
        c = F.col(name) if name in df.columns else F.lit(None).cast(kind)
        if name in defaults:
            c = F.coalesce(c, F.lit(defaults[name]))
        df = df.withColumn(name, c)
    return df


def source_url(url: Column, strategies: Column) -> Column:
    """The url, else the first listing strategy's, else any strategy's, else about:blank."""
    with_url = F.filter(strategies, lambda s: F.coalesce(s["url"], F.lit("")) != "")
    listing = F.filter(with_url, lambda s: s["transport"] == "html_listing")
    return first_nonempty(url, F.get(listing, F.lit(0))["url"], F.get(with_url, F.lit(0))["url"], F.lit("about:blank"))


def scan_sources(companies: DataFrame) -> DataFrame:
    """Nested company rows to one row per source."""
    rows = companies.select("company", F.posexplode("sources").alias("source_pos", "s")).select(
        "company", "source_pos", "s.*"
    )
    rows = _fill(rows, SOURCE_FIELDS, SOURCE_DEFAULTS)
    return rows.withColumn("url", source_url(F.col("url"), F.col("strategies")))


def group_by_provider(official: DataFrame) -> DataFrame:
    """The flat shape (provider per row) as company rows' sources."""
    named = official.withColumn("company", F.coalesce("provider", F.lit("unknown")))
    if "source_id" in named.columns and "id" not in named.columns:
        named = named.withColumnRenamed("source_id", "id")
    rows = _fill(named.drop("provider"), SOURCE_FIELDS, SOURCE_DEFAULTS)
    return rows.withColumn("url", source_url(F.col("url"), F.col("strategies")))


SOCIAL_FIELDS = {
    "source_id": "string", "platform": "string", "source_type": "string", "enabled": "boolean", "priority": "int",
    "strategy": "string", "auth_ref": "string", "query": "string", "handle_or_community": "string",
    "include_comments": "boolean", "max_items": "int", "metadata_fallback": "boolean", "trust_tier": "int",
}
SOCIAL_DEFAULTS = {
    "enabled": True, "priority": 50, "strategy": "fulltext_preferred", "include_comments": False, "max_items": 20,
    "metadata_fallback": True, "trust_tier": 2,
}


def scan_social_sources(rows: DataFrame) -> DataFrame:
    """Social sources with defaults."""
    return _fill(rows, SOCIAL_FIELDS, SOCIAL_DEFAULTS)


def enabled_social(sources: DataFrame) -> DataFrame:
    """Enabled sources, highest priority first."""
    return sources.filter("enabled").orderBy(F.desc("priority"), "source_id")


def monitor_providers(monitors: DataFrame, providers: DataFrame, most: int = 10_000) -> DataFrame:
    """Enabled monitors with each enabled known provider.

    A monitor that names no provider gets all enabled ones. These are few, as
    each one is a search service: more than `most` are refused, and the list of
    them is one value that the monitors explode in place.
    """
    live = providers.filter("enabled").select("provider_id", "provider")
    mons = monitors.filter("enabled")
    named = mons.filter(F.size(F.coalesce("providers", F.array())) > 0).withColumn(
        "provider_id", F.explode("providers")
    ).join(live, "provider_id")
    if live.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} enabled providers")
    every = live.agg(F.sort_array(F.collect_list(F.struct(*live.columns)))).scalar()
    rest = mons.filter(F.size(F.coalesce("providers", F.array())) == 0).withColumn("_each", F.explode(every)).select(*mons.columns, "_each.*")
    return named.unionByName(rest.select(*named.columns))


# --- P7, P8 -----------------------------------------------------------------------------
def _legacy() -> Column:
    kind = F.lower("type")
    none_map = F.lit(None).cast("map<string,string>")

    def entry(cond, transport, url, priority, items=None, fields=None):
        return F.when(
            cond,
            F.struct(
                F.lit(transport).alias("transport"), F.lit(True).alias("enabled"),
                F.lit(priority).cast("int").alias("priority"), url.alias("url"),
                (F.lit(None).cast("string") if items is None else items).alias("items_path"),
                (none_map if fields is None else fields).alias("field_map"),
            ),
        )

    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    feed = kind.contains("rss") | kind.isin("atom", "feed")
    return F.array_compact(
        F.array(
            entry(given("rss_url"), "rss", F.col("rss_url"), 100),
            entry(given("sitemap_url"), "sitemap", F.col("sitemap_url"), 80),
            entry(given("api_list_url"), "rest_api", F.col("api_list_url"), 120, F.col("api_items_path"), F.col("api_field_map")),
            entry(feed, "rss", F.col("url"), 90),
            entry(~feed & kind.contains("sitemap"), "sitemap", F.col("url"), 90),
            entry(~feed & ~kind.contains("sitemap"), "html_listing", F.col("url"), 60),
        )
    )


def resolve_transports(sources: DataFrame, mode: str = "balanced") -> DataFrame:
    """One row per enabled source and transport, `turn` counts from 1."""
    given = F.coalesce(F.size("strategies"), F.lit(0)) > 0
    chosen = F.filter(F.when(given, F.col("strategies")).otherwise(_legacy()), lambda s: F.coalesce(s["enabled"], F.lit(True)))
    rows = sources.filter("enabled").withColumn("_list", chosen).select(
        "*", F.posexplode("_list").alias("_at", "_t")
    ).select(
        *[c for c in sources.columns if c != "strategies"], "_at",
        F.col("_t.transport").alias("transport"), F.coalesce("_t.priority", F.lit(50)).alias("transport_priority"),
        first_nonempty(F.col("_t.url"), F.when(F.col("_t.transport") == "rest_api", F.col("api_list_url")), F.col("url")).alias("transport_url"),
        F.coalesce("_t.items_path", "api_items_path").alias("items_path"),
        F.coalesce("_t.field_map", "api_field_map").alias("field_map"),
    )
    keys = [F.desc("transport_priority"), F.col("_at")]
    if mode == "rss_only":
        rows, keys = rows.filter("transport = 'rss'"), [F.col("_at")]
    elif mode == "rss_first":
        keys = [F.when(F.col("transport") == "rss", 0).otherwise(1), *keys]
    # a source has a handful of transports
    w = Window.partitionBy("id").orderBy(*keys)
    return rows.withColumn("turn", F.row_number().over(w)).drop("_at")


# --- P9, P10 -----------------------------------------------------------------------------------
def source_strategy() -> Column:
    """How the pages of a source are read."""
    sid = F.lower("id")
    return (
        F.when(F.coalesce("source_strategy", F.lit("")) != "", F.col("source_strategy"))
        .when(sid.isin(*PROTECTED_SOURCES), "protected")
        .when(sid.contains("changelog") | sid.contains("release_notes"), "structured_index")
        .when(sid.isin(*FULLTEXT_SOURCES), "fulltext_preferred")
        .when(F.col("access") == "metadata_only", "metadata_preferred")
        .otherwise("fulltext_preferred")
    )


def with_strategy(sources: DataFrame) -> DataFrame:
    """P10: the strategy columns that every candidate of a source carries."""
    strategy = source_strategy()
    return sources.withColumns(
        {
            "follow_detail_pages": F.coalesce(
                "follow_detail_pages", ~strategy.isin("structured_index", "protected", "metadata_preferred")
            ),
            "metadata_fallback": F.coalesce("metadata_fallback", F.lit(True)),
            "source_strategy": strategy,
        }
    )


def listing_seeds(transports: DataFrame) -> DataFrame:
    """One seed candidate per listing transport."""
    return transports.filter("transport = 'html_listing'").select(
        "id", "company", "turn", F.lit(0).alias("item"), F.trim("transport_url").alias("url"),
        F.lit(70).alias("priority"), F.lit("listing").alias("hint_doc_type"), F.lit(True).alias("seed"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("snippet"),
        F.lit(None).cast("string").alias("date"), F.lit(None).cast("timestamp").alias("published_at"),
    )


def official_domains(sources: DataFrame) -> DataFrame:
    """The hosts a company itself publishes on."""
    return sources.select(F.explode(F.array("url", "rss_url", "sitemap_url")).alias("u")).select(
        urls.netloc(F.col("u")).alias("domain")
    ).filter("domain <> ''").distinct()


def stamp_candidates(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Url score and configured access on every candidate."""
    by_id = sources.select("id", F.col("priority").alias("_rank"), F.col("access").alias("_access"))
    return candidates.join(by_id, "id").withColumns(
        {"priority": urls.url_priority(F.col("url"), F.col("_rank")), "access": F.col("_access")}
    ).drop("_rank", "_access")
