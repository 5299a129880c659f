"""Pages to items, entries and extracted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..functions.arrays import first_nonempty
from ..functions.dates import parse_changelog_date, parse_feed_date, parse_title_date
from ..functions.markup import (
    CANONICAL_LINK, META_DESCRIPTION, OG_TITLE, TITLE, found, listing_reason, with_html_dates, with_page_class,
)
from ..functions.text import clean_text, drop_tags, language_guess
from ..functions.vocab import CHANGELOG_URL_PARTS, KNOWN_SOURCE_TITLES, MONTHS
from ..operators.dedup import keep_last
from ..operators.fetching import CHALLENGES, child_strategy, fetch_verdict, landed_at
from ..operators.unions import explode_computed

# --- fixed values: anchor and entry patterns --------------------------------------------
ANCHOR = r"""(?is)<a\s+[^>]*href\s*=\s*(['"])(.*?)\1[^>]*>(.*?)</a>"""
HREF_IN_ANCHOR = r"""(?is)<a\s+[^>]*href\s*=\s*(['"])(.*?)\1"""
HREF_WITH_TAIL = r"""(?is)(?=href)(?=(.{0,400}))href\s*=\s*(["'])([^"']+)\2"""
_DATE = rf"(?:{MONTHS})[a-z]*\s+\d{{1,2}},\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}"
DATED_ENTRY = rf"(?iU)({_DATE})\s*[:\-–]\s*([^\n]{{8,200}})"
LEADING_DATE = rf"(?iU)^({_DATE})\b"
LIST_ITEM = r"(?is)<li[^>]*>(.*?)</li>"


def _first(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


def _first_of_each(items: Column, key: str) -> Column:
    """Keep the first struct per key field inside an array."""
    keys = F.transform(items, lambda x: x[key])
    return F.filter(items, lambda x, i: F.array_position(keys, x[key]) == i + 1)


# --- H6, H7 ---------------------------------------------------------------------------------
def _selectors(pages: DataFrame) -> DataFrame:
    for name, kind in (("path_contains_any", "array<string>"), ("exclude_path_substrings", "array<string>"),
                       ("allow_aggregate_paths", "boolean")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    return pages


def with_listing_items(pages: DataFrame, max_items: int | None = None, url: str = "url", html: str = "html", name: str = "items") -> DataFrame:
    """H6: adds an array of (url, title) for the item links of a listing page.

    The whole rule runs inside the row, so it needs no shuffle.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    pairs = F.arrays_zip(
        F.regexp_extract_all(h, F.lit(ANCHOR), F.lit(2)).alias("href"), F.regexp_extract_all(h, F.lit(ANCHOR), F.lit(3)).alias("inner")
    )
    usable = lambda x: ~F.lower(F.ltrim(x["href"])).rlike(r"^($|#|javascript:|mailto:)")
    stage = _selectors(pages).withColumns({"_pairs": F.filter(pairs, usable), "_base": urls.base_parts(F.col(url))})
    stage = stage.withColumn(
        "_abs",
        F.transform("_pairs", lambda x: F.struct(urls.resolve_from(F.col("_base"), x["href"]).alias("abs"), x["inner"].alias("inner"))),
    ).withColumn(
        "_abs",
        F.transform(
            "_abs",
            lambda x: F.struct(x["abs"], x["inner"], urls.netloc(x["abs"]).alias("site"), F.lower(urls.raw_path(x["abs"])).alias("path")),
        ),
    )
    excluded = F.coalesce("exclude_path_substrings", F.expr("CAST(array() AS ARRAY<STRING>)"))
    keep = lambda x: (
        (x["site"] != "") & (x["site"] == F.col("_base.site")) & urls.is_allowed(x["abs"])
        & ~F.exists(excluded, lambda part: x["path"].contains(F.lower(part)))
        & urls.is_detail_from(F.col("_base"), x["abs"], x["path"], F.col("path_contains_any"))
        & (~urls.is_aggregate(x["abs"]) | F.coalesce("allow_aggregate_paths", F.lit(False)))
    )
    stage = stage.withColumn("_kept", F.filter("_abs", keep)).withColumn(
        "_named",
        F.transform(
            "_kept",
            lambda x: F.struct(urls.canonical_url(x["abs"]).alias("url"), drop_tags(x["inner"]).alias("t")),
        ),
    )
    items = F.transform(
        _first(_first_of_each(F.col("_named"), "url"), max_items),
        lambda x: F.struct(x["url"].alias("url"), F.when(F.length(x["t"]) >= 2, x["t"]).alias("title")),
    )
    added = [c for c in ("path_contains_any", "exclude_path_substrings", "allow_aggregate_paths") if c not in pages.columns]
    return stage.withColumn(name, items).drop("_pairs", "_base", "_abs", "_kept", "_named", *added)


def with_plain_links(pages: DataFrame, max_links: int | None = None, url: str = "url", html: str = "html", name: str = "links") -> DataFrame:
    """H7: adds an array of item urls by the plainer rule."""
    h = F.coalesce(F.col(html), F.lit(""))
    hrefs = F.regexp_extract_all(h, F.lit(HREF_IN_ANCHOR), F.lit(2))
    stage = pages.withColumns(
        {"_h": F.filter(hrefs, lambda x: ~F.lower(F.ltrim(x)).rlike(r"^($|#|javascript:)")), "_base": urls.base_parts(F.col(url))}
    )
    stage = stage.withColumn("_a", F.transform("_h", lambda x: urls.resolve_from(F.col("_base"), x)))
    site = F.col("_base.site")
    keep = lambda a: (
        (site != "") & (urls.netloc(a) == site) & urls.is_allowed(a)
        & urls.is_detail_from(F.col("_base"), a, F.lower(urls.raw_path(a)), plain=True)
    )
    links = _first(F.array_distinct(F.transform(F.filter("_a", keep), lambda a: urls.canonical_url(a))), max_links)
    return stage.withColumn(name, links).drop("_h", "_a", "_base")


def listing_items(pages: DataFrame, max_items: int | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """H6 as rows: page url, position, item url and title."""
    rows = explode_computed(with_listing_items(pages.select(url, html), max_items, url, html), [url], "items", "item", "i")
    return rows.select(F.col(url).alias("page_url"), "item", "i.url", "i.title")


# --- H8 -----------------------------------------------------------------------------------------
def _entry(title: Column, detail: Column, hint: Column, key: Column) -> Column:
    return F.struct(
        title.alias("title"), detail.alias("detail_url"), hint.alias("date_hint"), title.alias("snippet"), key.alias("key")
    )


def with_changelog_entries(pages: DataFrame, max_items: int | None = None, url: str = "url", html: str = "html", name: str = "entries") -> DataFrame:
    """H8: adds an array of dated lines, changelog links and, when few, list items."""
    h = F.coalesce(F.col(html), F.lit(""))
    base = urls.netloc(F.col(url))
    stage = pages.withColumn("_plain", clean_text(h))
    dated = F.arrays_zip(
        F.regexp_extract_all("_plain", F.lit(DATED_ENTRY), F.lit(1)).alias("d"),
        F.regexp_extract_all("_plain", F.lit(DATED_ENTRY), F.lit(2)).alias("t"),
    )
    one = F.transform(
        dated,
        lambda x: _entry(F.trim(x["t"]), F.lit(""), F.trim(x["d"]),
                         F.concat(F.trim(x["d"]), F.lit("|"), F.trim(x["t"]))),
    )
    tails = F.filter(
        F.arrays_zip(
            F.regexp_extract_all(h, F.lit(HREF_WITH_TAIL), F.lit(1)).alias("tail"),
            F.regexp_extract_all(h, F.lit(HREF_WITH_TAIL), F.lit(3)).alias("href"),
        ),
        lambda x: ~F.trim(x["href"]).rlike("^($|#)") & urls.with_any_hint(x["href"], CHANGELOG_URL_PARTS),
    )
    two = F.transform(
        F.filter(
            F.transform(tails, lambda x: F.struct(urls.resolve(F.col(url), x["href"]).alias("abs"), x["tail"].alias("tail"))),
            lambda x: urls.netloc(x["abs"]) == base,
        ),
        lambda x: F.struct(
            x["abs"].alias("abs"),
            F.when(x["tail"].rlike(r">([^<]{3,200})<"), clean_text(F.regexp_extract(x["tail"], r">([^<]{3,200})<", 1)))
            .otherwise(x["abs"]).alias("t"),
        ),
    )
    two = F.transform(two, lambda x: _entry(x["t"], x["abs"], F.lit(""), x["abs"]))
    chunks = F.filter(
        F.transform(F.regexp_extract_all(h, F.lit(LIST_ITEM), F.lit(1)), clean_text), lambda c: F.length(c) >= 15
    )
    three = F.transform(
        F.transform(
            chunks,
            lambda c: F.struct(
                F.regexp_extract(c, LEADING_DATE, 1).alias("d"),
                F.when(c.rlike(LEADING_DATE), F.regexp_replace(F.regexp_replace(c, LEADING_DATE, ""), r"^[ \-:\t]+|[ \-:\t]+$", ""))
                .otherwise(c).alias("c"),
            ),
        ),
        lambda x: F.struct(
            x["c"].alias("title"), F.lit("").alias("detail_url"), x["d"].alias("date_hint"), x["c"].alias("snippet"), x["c"].alias("key"),
        ),
    )
    stage = stage.withColumns({"_one": one, "_two": two, "_three": three})
    stage = stage.withColumn("_first", _first_of_each(F.concat("_one", "_two"), "key"))
    every = F.when(F.size("_first") < 3, _first_of_each(F.concat("_first", "_three"), "key")).otherwise(F.col("_first"))
    return stage.withColumn(
        name, F.transform(_first(every, max_items), lambda e: e.dropFields("key"))
    ).drop("_plain", "_one", "_two", "_three", "_first")


# --- candidate columns ---------------------------------------------------------------------------
CANDIDATE_FIELDS = {
    "source_id": "string", "company": "string", "source_type": "string", "hint_doc_type": "string", "priority": "int",
    "seed": "boolean", "from_listing_expansion": "boolean", "access": "string", "source_strategy": "string",
    "follow_detail_pages": "boolean", "protected_policy": "string", "title": "string", "snippet": "string", "date": "string",
    "published_hint": "string", "display_name": "string", "parent_listing_url": "string", "detail_url": "string",
    "meta_canonical_url": "string",
}


def with_candidate_fields(df: DataFrame) -> DataFrame:
    """Candidate columns that a table lacks are added as null."""
    missing = {n: F.lit(None).cast(t) for n, t in CANDIDATE_FIELDS.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def metadata_published() -> Column:
    """T-D9: published date of the candidate itself."""
    return parse_feed_date(F.coalesce(first_nonempty(F.col("published_hint")), F.col("date")))


_DOC = ["url", "source_id", "company", "canonical_url", "doc_title", "doc_published", "doc_updated", "body_text",
        "doc_summary", "language", "quality_score", "page_type", "notes", "normalized_doc_type", "detail_fetch_attempt",
        "detail_extract_success", "metadata_fallback"]


def _document(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(c) for c in _DOC],
    ).withColumnsRenamed({"doc_title": "title", "doc_published": "published_at", "doc_updated": "updated_at", "doc_summary": "summary"})


# --- X10 ------------------------------------------------------------------------------------------
def extract_fulltext(pages: DataFrame) -> DataFrame:
    """Candidates joined with their result to full documents."""
    df = with_candidate_fields(pages)
    h = F.coalesce("raw_html", F.lit(""))
    df = with_html_dates(df.withColumns({"_clean": clean_text(h), "_meta_pub": metadata_published()}), "raw_html")
    head = first_nonempty(F.col("title"), found(h, TITLE), F.col("url"))
    described = F.coalesce(first_nonempty(F.col("snippet")), found(h, META_DESCRIPTION), F.col("snippet"))
    df = df.withColumns({"doc_title": head, "_sum": described})
    df = df.withColumns(
        {
            "_title_pub": parse_title_date(F.col("doc_title")),
            "_text_pub": parse_changelog_date(F.col("_clean"), one_line=True),
        }
    )
    df = with_page_class(df, "raw_html", "url", F.col("doc_title"), F.col("block_type"), F.col("_sum"))
    pick = first_nonempty(F.col("suggested_snippet"), F.col("_sum"))
    df = df.withColumns(
        {
            "_agg": listing_reason(h, F.col("url"), F.length("_clean")),
            "_body0": F.when(F.col("body_handling") == "metadata_only", F.lit(""))
            .when(F.col("body_handling") == "trimmed", F.coalesce(pick, F.col("_clean")))
            .otherwise(F.col("_clean")),
        }
    )
    swap = (F.col("_agg") != "") & (F.col("page_type") == "article_page")
    body = F.when(swap, F.coalesce(pick, F.col("_body0"))).otherwise(F.col("_body0"))
    full = F.col("body_handling") == "full"
    base = F.when(full & (F.length("_body0") > 120), 0.7).when(full & (F.col("_body0") != ""), 0.45).otherwise(0.2)
    score = F.least(base, F.col("quality_cap"), F.when(F.col("_agg") != "", 0.25).otherwise(1.0))
    kind = F.when(swap, "aggregation_page").otherwise(F.col("page_type"))
    had = lambda c: F.col(c).isNotNull()
    notes = F.concat(
        F.array_compact(F.array(F.when(had("_meta_pub"), F.lit("published_from_metadata_string")))),
        F.col("date_notes"),
        F.array_compact(
            F.array(
                F.when(~had("_meta_pub") & ~had("html_published") & had("_title_pub"), F.lit("published_from_title_month_day_year")),
                F.when(~had("_meta_pub") & ~had("html_published") & ~had("_title_pub") & had("_text_pub"),
                       F.lit("published_from_changelog_line")),
                F.concat(F.lit("page_classified:"), F.col("page_type")),
                F.when(F.col("_agg") != "", F.concat(F.lit("aggregate_listing:"), F.col("_agg"))),
            )
        ),
    )
    df = df.withColumns({"body_text": body, "_kind": kind, "notes": notes})
    listing = F.col("_kind").isin("aggregation_page", "listing_page", "docs_shell_page")
    link = F.trim(F.regexp_extract(h, CANONICAL_LINK, 1))
    return _document(
        df.withColumns(
            {
                "canonical_url": F.when(h.rlike(CANONICAL_LINK), link).otherwise(F.col("url")),
                "doc_published": F.coalesce("_meta_pub", "html_published", "_title_pub", "_text_pub"),
                "doc_updated": F.col("html_updated"),
                "doc_summary": F.coalesce("_sum", F.when(F.col("body_text") != "", F.substring("body_text", 1, 280))),
                "language": language_guess(F.col("doc_title")),
                "quality_score": score, "page_type": F.col("_kind"), "normalized_doc_type": F.lit(None).cast("string"),
                "detail_fetch_attempt": F.lit(True), "detail_extract_success": (F.length("body_text") > 100) & ~listing,
                "metadata_fallback": F.lit(False),
            }
        )
    )


# --- X11 --------------------------------------------------------------------------------------------
def extract_listing(pages: DataFrame) -> DataFrame:
    """X11: a listing page as one document of item lines."""
    df = with_listing_items(with_candidate_fields(pages), None, "url", "raw_html")
    h = F.coalesce("raw_html", F.lit(""))
    df = with_html_dates(df.withColumn("_clean", clean_text(h)), "raw_html")
    lines = F.transform(
        "items", lambda i: F.concat(F.lit("- "), F.coalesce(i["title"], i["url"]), F.lit(" :: "), i["url"])
    )
    df = df.withColumn("_lines", lines)
    any_line = F.size("_lines") > 0
    return _document(
        df.withColumns(
            {
                "canonical_url": F.col("url"), "doc_title": first_nonempty(F.col("title"), found(h, TITLE), F.col("url")),
                "doc_published": F.col("html_published"), "doc_updated": F.col("html_updated"),
                "body_text": F.when(any_line, F.array_join("_lines", "\n")).otherwise(F.col("_clean")),
                "doc_summary": F.when(any_line, F.substring(F.get("_lines", F.lit(0)), 1, 400)).otherwise(F.substring("_clean", 1, 280)),
                "language": F.lit(None).cast("string"), "quality_score": F.when(any_line, 0.35).otherwise(0.22),
                "page_type": F.lit("listing_page"), "notes": F.concat("date_notes", F.array(F.lit("listing_index_fallback"))),
                "normalized_doc_type": F.lit(None).cast("string"), "detail_fetch_attempt": F.lit(False),
                "detail_extract_success": F.lit(False), "metadata_fallback": F.lit(True),
            }
        )
    )


# --- X12 ----------------------------------------------------------------------------------------------
def extract_metadata(pages: DataFrame) -> DataFrame:
    """Candidate metadata and weak page signals, no body."""
    df = with_candidate_fields(pages)
    h = F.coalesce("raw_html", F.lit(""))
    own = first_nonempty(F.col("title"), F.col("detail_url"))
    bare = own.isNull() | (F.trim(own) == F.trim("url"))
    known = None
    for sid, name in KNOWN_SOURCE_TITLES.items():
        known = F.when(F.col("source_id") == sid, name) if known is None else known.when(F.col("source_id") == sid, name)
    named = F.when(bare & first_nonempty(F.col("display_name")).isNotNull(), F.col("display_name")).when(
        bare & known.isNotNull(), known
    ).otherwise(own)
    title = first_nonempty(named, F.coalesce(found(h, OG_TITLE), found(h, TITLE)), F.col("url"))
    summary = F.coalesce(first_nonempty(F.col("snippet")), found(h, META_DESCRIPTION), F.lit(""))
    df = with_html_dates(df.withColumns({"_meta_pub": metadata_published(), "doc_title": title, "_sum": summary}), "raw_html")
    df = df.withColumn("_title_pub", parse_title_date(F.col("doc_title")))
    df = with_page_class(df, "raw_html", "url", F.col("doc_title"), F.col("block_type"), F.col("_sum"))
    challenged = F.col("block_type").isin(*CHALLENGES)
    kind = F.when(challenged, "challenge_or_interstitial").when(h != "", F.col("page_type"))
    had = lambda c: F.col(c).isNotNull()
    notes = F.concat(
        F.array_compact(F.array(F.lit("metadata_rich_document"), F.when(had("_meta_pub"), F.lit("published_from_metadata_string")))),
        F.col("date_notes"),
        F.array_compact(
            F.array(
                F.when(~had("_meta_pub") & ~had("html_published") & had("_title_pub"), F.lit("published_from_title_month_day_year")),
                F.when(challenged, F.lit("page_type:challenge_from_block")).when(h != "", F.concat(F.lit("page_classified:"), kind)),
            )
        ),
    )
    return _document(
        df.withColumns(
            {
                "canonical_url": first_nonempty(F.col("meta_canonical_url"), F.col("url")),
                "doc_published": F.coalesce("_meta_pub", "html_published", "_title_pub"), "doc_updated": F.col("html_updated"),
                "body_text": F.lit(""), "doc_summary": first_nonempty(F.col("_sum"), F.col("doc_title")),
                "language": F.lit(None).cast("string"), "quality_score": F.when(F.col("_sum") != "", 0.25).otherwise(0.18),
                "notes": notes, "page_type": kind, "normalized_doc_type": F.lit(None).cast("string"),
                "detail_fetch_attempt": F.coalesce("from_listing_expansion", F.lit(False)),
                "detail_extract_success": F.lit(False), "metadata_fallback": F.lit(True),
            }
        )
    )


def metadata_without_result(candidates: DataFrame) -> DataFrame:
    """X12, plain form: a candidate that has no fetch result."""
    df = with_candidate_fields(candidates)
    return _document(
        df.withColumns(
            {
                "canonical_url": F.col("url"), "doc_title": first_nonempty(F.col("title"), F.col("url")),
                "doc_published": metadata_published(), "doc_updated": F.lit(None).cast("timestamp"), "body_text": F.lit(""),
                "doc_summary": F.coalesce("snippet", F.lit("")), "language": F.lit(None).cast("string"), "quality_score": F.lit(0.2),
                "page_type": F.lit(None).cast("string"), "notes": F.array(F.lit("metadata_only_legacy_no_result")),
                "normalized_doc_type": F.lit(None).cast("string"), "detail_fetch_attempt": F.lit(False),
                "detail_extract_success": F.lit(False), "metadata_fallback": F.lit(True),
            }
        )
    )


# --- X13 ------------------------------------------------------------------------------------------------
def doc_subtype(source_type: Column) -> Column:
    t = F.lower(F.coalesce(source_type, F.lit("")))
    return F.when(t.contains("changelog"), "changelog_entry").when(t.contains("release"), "release_note").otherwise("docs_update")


def extract_index(pages: DataFrame) -> DataFrame:
    """A changelog or release page as one document of entry lines."""
    df = with_changelog_entries(with_candidate_fields(pages), None, "url", "raw_html")
    h = F.coalesce("raw_html", F.lit(""))
    df = with_html_dates(df.withColumn("_clean", clean_text(h)), "raw_html")
    lines = F.transform(
        "entries",
        lambda e: F.concat(
            F.lit("- ["), e["date_hint"], F.lit("] "), e["title"],
            F.when(e["detail_url"] != "", F.concat(F.lit(" :: "), e["detail_url"])).otherwise(""),
        ),
    )
    df = df.withColumn("_lines", lines)
    any_line = F.size("_lines") > 0
    df = df.withColumn("body_text", F.when(any_line, F.array_join("_lines", "\n")).otherwise(F.col("_clean")))
    df = df.withColumns(
        {
            "_text_pub": parse_changelog_date(F.col("body_text")), "_meta_pub": parse_feed_date(F.col("published_hint")),
            "doc_title": first_nonempty(F.col("title"), found(h, TITLE), F.concat(F.col("source_id"), F.lit(" — structured index"))),
        }
    )
    summary = F.when(any_line, F.substring(F.get("_lines", F.lit(0)), 1, 400)).otherwise(F.substring(F.coalesce("snippet", F.lit("")), 1, 400))
    late = F.col("html_published").isNull() & F.col("_text_pub").isNotNull()
    return _document(
        df.withColumns(
            {
                "canonical_url": F.col("url"), "doc_published": F.coalesce("html_published", "_text_pub", "_meta_pub"),
                "doc_updated": F.col("html_updated"), "doc_summary": first_nonempty(summary, F.col("doc_title")),
                "language": F.lit("en"), "quality_score": F.when(F.size("entries") >= 2, 0.55).otherwise(0.38),
                "page_type": F.lit("listing_page"),
                "notes": F.concat("date_notes", F.array(F.lit("structured_index_extractor")),
                                  F.array_compact(F.array(F.when(late, F.lit("published_from_changelog_text"))))),
                "normalized_doc_type": doc_subtype(F.col("source_type")), "detail_fetch_attempt": F.lit(True),
                "detail_extract_success": (F.size("_lines") >= 2) | (F.length("body_text") > 80), "metadata_fallback": F.lit(False),
            }
        )
    )


# --- H9 -------------------------------------------------------------------------------------------------
def normalize_documents(extracted: DataFrame) -> DataFrame:
    """H9: extracted rows with source_type, hint_doc_type and the result columns to stored documents."""
    canonical = urls.canonical_url(F.coalesce(first_nonempty(F.col("canonical_url")), F.col("url")))
    stage = extracted.withColumns({"_can": canonical, "_text": F.coalesce("body_text", F.lit(""))})
    basis = F.concat("_can", F.lit("|"), F.coalesce(first_nonempty(F.col("_text"), F.col("title")), F.lit("")))
    return stage.withColumns(
        {
            "content_hash": F.sha2(basis, 256),
            "document_id": F.substring(F.sha2(F.concat("source_id", F.lit(":"), "_can"), 256), 1, 24),
            "canonical_url": F.col("_can"), "content_text": F.col("_text"),
            "doc_type": F.coalesce(first_nonempty(F.col("normalized_doc_type")), F.col("hint_doc_type")),
            "blocked_by": F.when(F.col("block_type") != "success", F.col("block_type")),
        }
    ).drop("_can", "_text", "body_text", "normalized_doc_type")


# --- X14 -------------------------------------------------------------------------------------------------
def expand_listings(seeds: DataFrame, landed: DataFrame, max_child_links: int | None = None) -> DataFrame:
    """Item candidates of the seed pages that were landed.

    The last landed page of a url counts, and only if its fetch succeeded by
    P13, so challenges and error pages open nothing.
    """
    cand = with_candidate_fields(seeds)
    if "ts" in landed.columns:
        placed = landed.join(cand.select("url").distinct(), "url", "left_semi").withColumn("landed_at", landed_at())
        last = keep_last(placed.select("url", "landed_at"), ["url"], ["landed_at"])  # the pages themselves are not sorted
        landed = placed.join(last, ["url", "landed_at"])
    if {"status_code", "headers", "content_type"} <= set(landed.columns):
        landed = landed.withColumn("_v", fetch_verdict(F.col("status_code"), F.col("headers"), F.col("content_type"), F.col("raw_html"))).filter("_v.success")
    elif "status_code" in landed.columns:
        landed = landed.filter(F.col("status_code").between(200, 399))
    joined = cand.join(landed.select("url", F.col("raw_html").alias("html")), "url")
    both = with_plain_links(with_listing_items(joined, max_child_links), max_child_links)
    children = F.when(F.size("items") > 0, F.col("items")).otherwise(
        F.transform("links", lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("title")))
    )
    rows = explode_computed(both.withColumn("_c", children).drop("items", "links", "html"), ["*"], "_c", "child_at", "c")
    plan = child_strategy(F.col("url"), F.col("c.url"), F.coalesce("source_strategy", F.lit("")), F.coalesce("follow_detail_pages", F.lit(True)))
    return rows.withColumn("_p", plan).withColumns(
        {
            "parent_listing_url": F.col("url"), "url": F.col("c.url"), "detail_url": F.col("c.url"), "title": F.col("c.title"),
            "snippet": F.lit(""), "seed": F.lit(False), "from_listing_expansion": F.lit(True),
            "access": F.coalesce("access", F.lit("listing_only")), "hint_doc_type": F.lit("article"),
            "priority": F.greatest(F.lit(1), F.col("priority") - 5), "source_strategy": F.col("_p.source_strategy"),
            "follow_detail_pages": F.col("_p.follow_detail_pages"),
        }
    ).drop("_c", "c", "_p")
