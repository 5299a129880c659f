"""Columns over page markup (H1-H5, H8 helpers, T-D3, T-D4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .arrays import empty_strings, has_any, strings
from .dates import parse_iso
from .entities import unescape
from .text import clean_text, drop_tags
from .vocab import AGGREGATE_URL_PARTS, ARTICLE_LD_TYPES, INTERSTITIAL_PHRASES

# --- fixed values: head patterns -------------------------------------------------
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
META_DESCRIPTION = r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["'](.*?)["']"""
OG_TITLE = r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["'](.*?)["']"""
OG_TYPE = r"""(?i)<meta[^>]+property=["']og:type["'][^>]+content=["']([^"']+)["']"""
CANONICAL_LINK = r"""(?is)<link[^>]+rel=["']canonical["'][^>]+href=["'](.*?)["']"""
TIME_TAG = r"""(?i)<time[^>]+datetime=["']([^"']+)["']"""
LD_SCRIPT = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
CARD_CLASS = r"""(?i)class=["'][^"']*(?:card|teaser|tile|grid-item|post-preview|story-card)[^"']*["']"""
NAV_TITLE = r"(?i)^\s*(featured|learn more|read more|blog|news|updates|archives)\s*$"


def meta_content(html: Column, attribute: str, name: str) -> Column:
    """Content of the first matching meta tag; null when absent or empty."""
    pattern = rf"""(?i)<meta[^>]+{attribute}=["']{name}["'][^>]+content=["']([^"']+)["']"""
    hit = F.trim(F.regexp_extract(html, pattern, 1))
    return F.when(hit != "", hit)


def found(html: Column, pattern: str) -> Column:
    """Cleaned first group, null when the pattern is absent."""
    return F.when(html.rlike(pattern), clean_text(F.regexp_extract(html, pattern, 1)))


def head_fields(html: Column) -> Column:
    """H5: title, meta description, og:title and canonical link."""
    canonical = F.trim(F.regexp_extract(html, CANONICAL_LINK, 1))
    return F.struct(
        found(html, TITLE).alias("title"),
        found(html, META_DESCRIPTION).alias("description"),
        found(html, OG_TITLE).alias("og_title"),
        F.when(html.rlike(CANONICAL_LINK), canonical).alias("canonical_link"),
    )


# --- JSON-LD ------------------------------------------------------------------------
def _ld_blobs(html: Column, entities: bool) -> Column:
    """Texts of all valid ld+json scripts, in page order."""
    raw = F.regexp_extract_all(html, F.lit(LD_SCRIPT), F.lit(1))
    texts = F.transform(raw, lambda b: drop_tags(unescape(b) if entities else b))
    return F.filter(texts, lambda b: (b != "") & F.try_parse_json(b).isNotNull())


def _ld_values(blobs: Column, keys: str, lists: bool = True) -> Column:
    """String values of the named keys at any depth, in text order."""
    value = r'("(?:[^"\\]|\\.)*"|\[[^\]]*\])' if lists else r'("(?:[^"\\]|\\.)*")'
    raw = F.flatten(
        F.transform(blobs, lambda b: F.regexp_extract_all(b, F.lit(rf'(?i)"(?:{keys})"\s*:\s*{value}'), F.lit(1)))
    )
    return F.flatten(
        F.transform(raw, lambda v: F.regexp_extract_all(v, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)))
    )


def ld_types(html: Column) -> Column:
    """H2: all `@type` values, lower case."""
    values = _ld_values(_ld_blobs(html, entities=False), "@type")
    return F.when(html.contains("ld+json"), F.transform(values, F.lower)).otherwise(empty_strings())


def _first_date(values: Column) -> Column:
    """struct(raw, ts) of the first value that is an ISO date."""
    dated = F.transform(values, lambda v: F.struct(v.alias("raw"), parse_iso(v).alias("ts")))
    return F.get(F.filter(dated, lambda d: d["ts"].isNotNull()), F.lit(0))


def ld_dates(html: Column) -> Column:
    """T-D4: first parsable published and modified dates of the ld+json scripts."""
    blobs = _ld_blobs(html, entities=True)
    return F.struct(
        _first_date(_ld_values(blobs, "datePublished|dateCreated|uploadDate")).alias("published"),
        _first_date(_ld_values(blobs, "dateModified|dateUpdated", lists=False)).alias("modified"),
    )


# --- dates in markup (T-D3) ------------------------------------------------------------
PUBLISHED_METAS = (
    ("article:published_time", "property", "article:published_time"),
    ("og:published_time", "property", "og:published_time"),
    ("pubdate", "name", "pubdate"),
)


def with_html_dates(df: DataFrame, html: str = "html") -> DataFrame:
    """T-D3: adds html_published, html_updated, date_fields and date_notes."""
    h = F.coalesce(F.col(html), F.lit(""))
    # a name that the lower-cased page lacks is in no tag of it, which spares most pages most of the patterns
    meta = lambda attr, name: F.when(F.contains(F.col("_low"), F.lit(name)), meta_content(h, attr, name))
    metas = {label: meta(attr, name) for label, attr, name in PUBLISHED_METAS}
    step = df.withColumn("_low", F.lower(h)).withColumns(
        {
            **{f"_m{i}": metas[label] for i, (label, _, _) in enumerate(PUBLISHED_METAS)},
            "_ld": F.when(h.contains("ld+json"), ld_dates(h)),
            "_time": _first_date(F.transform(F.regexp_extract_all(h, F.lit(TIME_TAG), F.lit(1)), lambda x: F.trim(x))),
            "_mod": meta("property", "article:modified_time"),
            "_ogu": meta("property", "og:updated_time"),
            "_last": meta("name", "lastmod"),
        }
    )
    step = step.withColumns(
        {
            **{f"_t{i}": parse_iso(F.col(f"_m{i}")) for i in range(3)},
            "_tmod": parse_iso(F.col("_mod")), "_togu": parse_iso(F.col("_ogu")), "_tlast": parse_iso(F.col("_last")),
        }
    )
    t = [F.col(f"_t{i}") for i in range(3)]
    by_meta = F.coalesce(*t)
    no_meta = by_meta.isNull()
    ld_pub, ld_mod = F.col("_ld.published.ts"), F.col("_ld.modified.ts")
    tag = F.col("_time.ts")
    strong = F.coalesce(by_meta, ld_pub, tag)
    updated_ld = F.when(no_meta, ld_mod)
    pick = [t[0].isNotNull(), t[0].isNull() & t[1].isNotNull(), t[0].isNull() & t[1].isNull() & t[2].isNotNull()]
    use_tag = no_meta & ld_pub.isNull() & tag.isNotNull()
    og_used = updated_ld.isNull() & F.col("_tmod").isNull() & F.col("_togu").isNotNull()
    weak = strong.isNull() & F.col("_tlast").isNotNull()

    def entry(cond, name, raw):
        return F.when(cond, F.struct(F.lit(name).alias("key"), raw.alias("value")))

    fields = F.map_from_entries(
        F.array_compact(
            F.array(
                *[entry(pick[i], label, F.col(f"_m{i}")) for i, (label, _, _) in enumerate(PUBLISHED_METAS)],
                entry(no_meta & ld_pub.isNotNull(), "json_ld_datePublished", F.col("_ld.published.raw")),
                entry(no_meta & ld_mod.isNotNull(), "json_ld_dateModified", F.col("_ld.modified.raw")),
                entry(use_tag, "time_datetime", F.col("_time.raw")),
                entry(F.col("_tmod").isNotNull(), "article:modified_time", F.col("_mod")),
                entry(og_used, "og:updated_time", F.col("_ogu")),
                entry(weak, "lastmod_name_meta_weak", F.col("_last")),
            )
        )
    )
    notes = F.array_compact(
        F.array(
            *[F.when(pick[i], F.lit(f"published_from_meta:{label}")) for i, (label, _, _) in enumerate(PUBLISHED_METAS)],
            F.when(no_meta & ld_pub.isNotNull(), F.lit("published_from_json_ld")),
            F.when(use_tag, F.lit("published_from_time_tag")),
            F.when(F.col("_tmod").isNotNull(), F.lit("updated_from_meta:article:modified_time")),
            F.when(og_used, F.lit("updated_from_meta:og:updated_time")),
            F.when(weak, F.lit("published_weak_fallback_name_lastmod")),
        )
    )
    out = step.withColumns(
        {
            "html_published": F.coalesce(strong, F.col("_tlast")),
            "html_updated": F.coalesce(updated_ld, F.col("_tmod"), F.col("_togu")),
            "date_fields": fields,
            "date_notes": notes,
        }
    )
    return out.drop("_low", "_ld", "_time", "_mod", "_ogu", "_last", "_tmod", "_togu", "_tlast",
                    *[f"_m{i}" for i in range(3)], *[f"_t{i}" for i in range(3)])


# --- counting (H3) and ladders (H1, H4) ----------------------------------------------------
def link_count(html: Column) -> Column:
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit(r"(?i)\bhref\s*=")).cast("int")


def text_length(html: Column) -> Column:
    return F.length(drop_tags(html))


def listing_reason(html: Column, url: Column, clean_length: Column) -> Column:
    """H4: why a page is likely an aggregate listing; empty text when it is not."""
    u = F.lower(F.coalesce(url, F.lit("")))
    h = F.lower(F.coalesce(html, F.lit("")))
    return (
        F.when(has_any(u, ("/content-type/", "/topic/", "/category/")), "url_aggregation_path")
        .when(h.contains("archives page") | h.rlike(r"archive?s?\s+page\s+\d+"), "html_archives_title")
        .when(h.contains("cookie") & h.contains("onetrust") & (clean_length < 800), "short_consent_shell")
        .when(u.contains("/blog/") & (u.contains("/page/") | u.rlike(r"page/\d+")), "pagination_listing")
        .otherwise("")
    )


def with_page_class(
    df: DataFrame,
    html: str = "html",
    url: str = "url",
    title: Column | None = None,
    block_type: Column | None = None,
    description: Column | None = None,
) -> DataFrame:
    """H1: adds page_type, body_handling, quality_cap, suggested_snippet, page_signals."""
    none = F.lit(None).cast("string")
    title = none if title is None else title
    block = F.lit("success") if block_type is None else block_type
    description = none if description is None else description
    h = F.coalesce(F.col(html), F.lit(""))
    u = F.lower(F.coalesce(F.col(url), F.lit("")))
    step = df.withColumns(
        {
            "_title": title, "_desc": description, "_block": block,
            "_low_hit": (F.length(h) > 200) & has_any(F.lower(h), INTERSTITIAL_PHRASES),
            "_links": link_count(h),
            "_len": text_length(h),
            "_article": h.rlike(r"(?i)<article[\s>]"),
            "_main": h.rlike(r"""(?i)<main[\s>]|role=["']main["']"""),
            "_cards": F.regexp_count(h, F.lit(CARD_CLASS)).cast("int"),
            "_types": ld_types(h),
            "_og": F.lower(F.regexp_extract(h, OG_TYPE, 1)),
            "_scripts": F.regexp_count(h, F.lit(r"(?i)<script[^>]*>")).cast("int"),
        }
    )
    density = F.col("_links") / F.greatest(F.col("_len"), F.lit(1)) * 1000
    step = step.withColumns(
        {
            "_density": density,
            "_ld_article": F.arrays_overlap(F.col("_types"), strings(ARTICLE_LD_TYPES)),
            "_agg": has_any(u, AGGREGATE_URL_PARTS),
        }
    )
    d, n, length, og = F.col("_density"), F.col("_links"), F.col("_len"), F.col("_og")
    short = F.coalesce(F.nullif(F.col("_desc"), F.lit("")), F.substring(F.coalesce(F.col("_title"), F.lit("")), 1, 400))

    def verdict(kind, handling, cap, reason, snippet=None):
        return F.struct(
            F.lit(kind).alias("page_type"), F.lit(handling).alias("body_handling"), F.lit(cap).alias("quality_cap"),
            F.lit(reason).alias("reason"), (F.col("_desc") if snippet is None else snippet).alias("snippet"),
        )

    ladder = (
        F.when(F.col("_block").isin("cloudflare_challenge", "cloudflare_block"),
               verdict("challenge_or_interstitial", "metadata_only", 0.12, "block_type_challenge"))
        .when(F.col("_low_hit"), verdict("challenge_or_interstitial", "metadata_only", 0.12, "challenge_body_patterns"))
        .when(F.col("_ld_article") & (d < 10) & ~F.col("_agg"), verdict("article_page", "full", 0.8, "json_ld"))
        .when(F.col("_agg"), verdict("aggregation_page", "trimmed", 0.28, "aggregation_url", short))
        .when(og.isin("website", "profile"), verdict("listing_page", "trimmed", 0.32, "og_listing", short))
        .when(og.isin("article", "newsarticle", "blogpostings"), verdict("article_page", "full", 0.82, "og_article"))
        .when((d > 8) & ((F.col("_cards") >= 6) | (n > 80)),
              verdict("aggregation_page", "trimmed", 0.26, "dense_cards", short))
        .when((F.col("_article") | F.col("_main")) & (d > 12) & (og == ""),
              verdict("listing_page", "trimmed", 0.35, "dense_article", short))
        .when(F.col("_article") | F.col("_main"), verdict("article_page", "full", 0.78, "article_tag"))
        .when((F.col("_scripts") > 40) & (length < 2500),
              verdict("docs_shell_page", "trimmed", 0.3, "script_shell", short))
        .when(F.trim(F.coalesce(F.col("_title"), F.lit(""))).rlike(NAV_TITLE),
              verdict("listing_page", "trimmed", 0.22, "nav_title"))
        .when((length > 800) & (d < 6), verdict("article_page", "full", 0.65, "long_text"))
        .otherwise(verdict("listing_page", "trimmed", 0.38, "default", short))
    )
    challenged = F.col("_v.page_type") == "challenge_or_interstitial"
    out = step.withColumn("_v", ladder).withColumns(
        {
            "page_type": F.col("_v.page_type"),
            "body_handling": F.col("_v.body_handling"),
            "quality_cap": F.col("_v.quality_cap"),
            "class_reason": F.col("_v.reason"),
            "suggested_snippet": F.col("_v.snippet"),
            "page_signals": F.when(
                ~challenged,
                F.struct(
                    n.alias("link_count"), length.alias("approx_text_len"), F.col("_article").alias("has_article"),
                    F.col("_main").alias("has_main"), F.col("_cards").alias("card_class_hits"),
                    F.slice(F.col("_types"), 1, 12).alias("json_ld_types"),
                    F.col("_ld_article").alias("json_ld_article_like"), F.nullif(og, F.lit("")).alias("og_type"),
                    F.round(d, 3).alias("link_density_per_1k_chars"),
                ),
            ),
        }
    )
    return out.drop("_v", "_title", "_desc", "_block", "_low_hit", "_links", "_len", "_article", "_main", "_cards",
                    "_types", "_og", "_scripts", "_density", "_ld_article", "_agg")
