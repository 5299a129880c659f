"""Access plans and landed fetch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..functions.arrays import first_nonempty, has_any, lower_headers
from ..functions.vocab import FETCH_CHALLENGE_PHRASES, LISTING_FIRST_TYPES
from .dedup import keep_last

CHALLENGES = ("cloudflare_challenge", "cloudflare_block")


def child_strategy(seed: Column, child: Column, strategy: Column, follow: Column) -> Column:
    """struct(strategy, follow) of an item page below a listing."""
    sp = F.regexp_replace(urls.raw_path(seed), "/+$", "")
    cp = F.regexp_replace(urls.raw_path(child), "/+$", "")
    below = F.startswith(cp, F.concat(sp, F.lit("/")))
    tail = F.regexp_replace(F.substr(cp, F.length(sp) + 1), "^/+", "")
    opened = (strategy == "structured_index") & (cp != sp) & (~below | tail.contains("/") | (F.length(tail) > 5))
    return F.struct(
        F.when(opened, "fulltext_preferred").otherwise(strategy).alias("source_strategy"),
        F.when(opened, True).otherwise(follow).alias("follow_detail_pages"),
    )


def access_plan() -> Column:
    """struct(mode, reason, retryable) for a candidate row."""
    access = F.lower(F.trim(F.coalesce("access", F.lit(""))))
    kind, u = F.lower("source_type"), F.lower("url")
    strategy = F.coalesce(first_nonempty(F.col("source_strategy")), F.lit("fulltext_preferred"))
    follow = F.coalesce("follow_detail_pages", F.lit(True))
    hostile = F.coalesce(F.col("anti_bot_score") > 0.5, F.lit(False))

    def plan(mode, reason, retry):
        mode = F.lit(mode) if isinstance(mode, str) else mode
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(mode.alias("mode"), reason.alias("reason"), F.lit(retry).alias("retryable"))

    second = (
        F.when(access == "metadata_only", plan("metadata_only", "second_level_respect_metadata_only", False))
        .when((strategy == "protected") | (F.coalesce("protected_policy", F.lit("")) == "skip_detail"),
              plan("metadata_only", "protected_skip_detail_fetch", False))
        .when(~follow, plan("metadata_only", "structured_index_listing_metadata_only", False))
        .when(hostile, plan("metadata_only", "second_level_health_degrade", False))
        .otherwise(plan("direct_html", "second_level_article_body", True))
    )
    first = (
        F.when(hostile, plan("metadata_only", "health_anti_bot_degrade", False))
        .when(access.isin("metadata_only", "feed_only", "listing_only", "skip"),
              plan(access, F.concat(F.lit("source_config_"), access), False))
        .when(kind.isin("rss", "atom"), plan("feed_only", "feed_sources_prefer_feed_only", False))
        .when(kind.isin(*LISTING_FIRST_TYPES), plan("listing_only", "official_listing_first", False))
        .when(u.contains("api."), plan("api", "api_like_endpoint", True))
        .when(has_any(u, ("release-notes", "changelog")), plan("listing_only", "release_notes_prefer_listing", False))
        .otherwise(plan("direct_html", "default_direct_html", True))
    )
    return F.when(F.coalesce("from_listing_expansion", F.lit(False)), second).otherwise(first)


def plan_access(candidates: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """Adds mode, reason and retryable from the source's health."""
    if health is not None:
        candidates = candidates.join(health.select("source_id", "anti_bot_score"), "source_id", "left")
    elif "anti_bot_score" not in candidates.columns:
        candidates = candidates.withColumn("anti_bot_score", F.lit(0.0))
    return candidates.withColumn("_p", access_plan()).withColumns(
        {"mode": F.col("_p.mode"), "reason": F.col("_p.reason"), "plan_retryable": F.col("_p.retryable")}
    ).drop("_p")


def fetch_verdict(status: Column, headers: Column, content_type: Column, body: Column) -> Column:
    """struct(block_type, success, retryable, platform)."""

    def v(block, ok, retry, platform=None):
        return F.struct(
            F.lit(block).alias("block_type"), F.lit(ok).alias("success"),
            (F.lit(retry) if isinstance(retry, bool) else retry).alias("retryable"),
            F.lit(platform).cast("string").alias("platform"),
        )

    names = lower_headers(F.coalesce(headers, F.expr("CAST(map() AS MAP<STRING,STRING>)")))
    text = F.coalesce(body, F.lit(""))
    low = F.lower(text)
    cf = F.array_contains(F.map_keys(names), "cf-ray") | F.lower(F.coalesce(names["server"], F.lit(""))).contains("cloudflare")
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    blob = F.regexp_replace(text, r"(?U)^\s+", "")
    head = F.lower(F.substring(blob, 1, 12000))
    html_like = blob.startswith("<!DOCTYPE") | blob.startswith("<html") | head.contains("<article")
    heavy = (F.regexp_count(blob, F.lit("<a ")) > 12) & (F.length(blob) > 2500) & head.contains("<div")
    foreign = (kind != "") & ~kind.contains("html") & ~kind.contains("xml")
    accepted = (
        (kind.contains("json") & (head.contains("<div") | head.contains("<span"))) | html_like | heavy
        | kind.contains("json") | kind.contains("text")
    )
    return (
        F.when(status.isNull(), v("network_error", False, True))
        .when(status.isin(301, 302), v("redirect", True, False))
        .when(status == 429, v("rate_limited", False, True))
        .when((status == 403) & cf & has_any(low, FETCH_CHALLENGE_PHRASES), v("cloudflare_challenge", False, False, "cloudflare"))
        .when((status == 403) & cf, v("cloudflare_block", False, False, "cloudflare"))
        .when((status == 403) & (text != ""), v("origin_forbidden", False, False))
        .when(status == 403, v("unknown_403", False, True))
        .when(status >= 400, v("network_error", False, status >= 500))
        .when(foreign & ~accepted, v("unsupported_content_type", False, False))
        .otherwise(v("success", True, False))
    )


def classify_results(results: DataFrame) -> DataFrame:
    """Verdict columns; a challenge degrades the mode to metadata only."""
    return with_verdict(
        results.withColumn("_v", fetch_verdict(F.col("status_code"), F.col("headers"), F.col("content_type"), F.col("raw_html")))
    )


def with_verdict(results: DataFrame) -> DataFrame:
    """The fields of the verdict `_v` as columns."""
    out = results.withColumns(
        {"block_type": F.col("_v.block_type"), "success": F.col("_v.success"), "retryable": F.col("_v.retryable"),
         "platform": F.col("_v.platform")}
    )
    return out.withColumn(
        "fetch_mode", F.when(F.col("block_type").isin(*CHALLENGES), "metadata_only").otherwise(F.col("fetch_mode"))
    ).drop("_v")


def network_error_kind(error: Column, error_class: Column | None = None) -> Column:
    """Kind of a transport error from its message and class."""
    m = F.lower(F.coalesce(error, F.lit("")))
    cls = F.lit("") if error_class is None else F.coalesce(error_class, F.lit(""))
    return (
        F.when(m.contains("timed out") | cls.contains("Timeout"), "timeout")
        .when(has_any(m, ("name or service not known", "temporary failure in name resolution")), "dns")
        .when(has_any(m, ("certificate", "ssl", "tls")), "tls")
        .when(cls == "HTTPStatusError", "http_status")
        .when(m.contains("connection") | (cls == "ConnectError"), "connection")
        .otherwise("unknown")
    )


def unfetched_results(planned: DataFrame) -> DataFrame:
    """P20: result rows of plans that need no response."""
    skip = F.col("mode") == "skip"
    return planned.filter(F.col("mode").isin("metadata_only", "skip")).select(
        "source_id", "company", "url", F.lit(None).cast("string").alias("final_url"),
        F.when(skip, 204).otherwise(200).alias("status_code"),
        F.when(~skip, F.lit("application/x.metadata")).alias("content_type"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.lit("").alias("raw_html"),
        F.col("mode").alias("fetch_mode"), F.lit(None).cast("string").alias("error"),
    )


def landed_at() -> Column:
    """Which of a url's landed rows: its time, and a hash that tells rows of one time apart."""
    return F.struct("ts", F.xxhash64("status_code", "raw_html").alias("tie"))


def last_results(landed: DataFrame) -> DataFrame:
    """Verdict, address (`landed_at`) and whether there is a body of the last landed row of each url, without the body."""
    slim = landed.select(
        "url", "final_url", "status_code", "content_type", "headers", "error", landed_at().alias("landed_at"), has_body(F.col("raw_html")).alias("has_body"),
        fetch_verdict(F.col("status_code"), F.col("headers"), F.col("content_type"), F.col("raw_html")).alias("_v"),
    )
    return keep_last(slim, ["url"], ["landed_at"])


def gather_results(planned: DataFrame, landed: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """One classified result per planned url; the last landed one counts.

    Bodies are read where they lie: the verdict, and whether there is a body,
    are columns of the landed row. Only these and the row's address (`landed_at`)
    are grouped and joined. `last` are the `last_results` of `landed`, if they
    are at hand.
    """
    last = last_results(landed) if last is None else last
    fetched = planned.filter(~F.col("mode").isin("metadata_only", "skip")).select(
        "source_id", "company", "url", F.col("mode").alias("fetch_mode")
    ).join(last, "url", "left")
    quiet = unfetched_results(planned).drop("raw_html")
    both = fetched.unionByName(quiet, allowMissingColumns=True)
    none = fetch_verdict(F.col("status_code"), F.col("headers"), F.col("content_type"), F.lit(""))
    return with_verdict(both.withColumns({"_v": F.coalesce("_v", none), "has_body": F.coalesce("has_body", F.lit(False))}))


def has_body(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).rlike(r"(?U)\S")  # ends at the first character


def pick_extractor(body: Column | None = None) -> Column:
    """Which of the four extractors reads the page; `body` tells whether it has one, if the page itself is not at hand."""
    body = has_body(F.col("raw_html")) if body is None else body
    index = F.coalesce("source_strategy", F.lit("")) == "structured_index"
    seed = F.coalesce("seed", F.lit(False)) | (F.coalesce("hint_doc_type", F.lit("")) == "listing")
    mode = F.col("fetch_mode")
    return (
        F.when(mode.isin("feed_only", "skip"), "metadata")
        .when((mode == "metadata_only") & index & body, "index")
        .when(mode == "metadata_only", "metadata")
        .when((mode == "listing_only") & F.col("success") & body & seed & index, "index")
        .when((mode == "listing_only") & F.col("success") & body & seed, "listing")
        .when(mode == "listing_only", "metadata")
        .when(~body, "metadata")
        .when(index, "index")
        .otherwise("fulltext")
    )
