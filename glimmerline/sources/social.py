"""Social items: scores, comments, raw records, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import clamp, first_nonempty
from ..functions.text import strip_ends
from ..functions.vocab import COMMENT_SEPARATOR, JUNK_POSTS
from ..operators.ordering import top_n_per


def _num(engagement: Column, key: str) -> Column:
    return F.coalesce(engagement[key].try_cast("double"), F.lit(0.0))


def engagement_score(engagement: Column, platform: Column) -> Column:
    """counters of a post as one number up to 1."""
    root = lambda k: F.sqrt(_num(engagement, k))
    x = F.lit(0.0)
    for key in reversed(("like_count", "retweet_count", "reply_count", "quote_count")):
        x = F.when(F.array_contains(F.map_keys(engagement), key), _num(engagement, key) / 5000.0).otherwise(x)
    score = _num(engagement, "score")
    plain = F.when(score != 0, score).otherwise(_num(engagement, "votes")) / 500.0
    return F.least(
        F.lit(1.0),
        F.when(platform == "reddit", root("score") / 200.0 + root("num_comments") / 150.0)
        .when(platform == "hackernews", root("points") / 180.0 + root("num_comments") / 120.0)
        .when(platform == "x", x)
        .otherwise(plain),
    )


def trust_weight(tier: Column) -> Column:
    """F24."""
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), tier.cast("double") / 5.0))


def looks_like_noise(text: Column, title: Column) -> Column:
    """too short, or a navigation or removal phrase."""
    t, body = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    blob = strip_ends(F.concat(t, F.lit(" "), body))
    return (
        (F.length(blob) < 12)
        | F.lower(blob).isin(*JUNK_POSTS)
        | ((t != "") & (F.length(t) < 6) & (F.length(body) < 40))
    )


def has_links(text: Column) -> Column:
    """F26."""
    return F.coalesce(text, F.lit("")).rlike("(?i)https?://")


def quality_score(engagement: Column, trust: Column, comments: Column, text: Column, title: Column, metadata_only: Column) -> Column:
    """F27."""
    part = lambda cond, v: F.when(cond, v).otherwise(0.0)
    return clamp(
        engagement * trust + part(comments, 0.15) + part(has_links(text), 0.05)
        - part(looks_like_noise(text, title), 0.25) - part(metadata_only, 0.2)
    )


def comment_lines(comments: DataFrame, limit: int | None = None, chars: int | None = None) -> DataFrame:
    """(external_id, comment_context) from rows (external_id, at, author, body).

    Deleted bodies are skipped after the cut, as they take a place in it.
    """
    first = comments if limit is None else top_n_per(comments, ["external_id"], ["at"], limit)
    body = strip_ends(F.replace(F.coalesce("body", F.lit("")), F.lit("<p>"), F.lit("\n")))
    kept = first.withColumn("_b", body).filter(~F.col("_b").isin("", "[deleted]", "[removed]"))
    line = F.concat(F.lit("- @"), F.coalesce("author", F.lit("")), F.lit(": "), F.col("_b") if chars is None else F.substring("_b", 1, chars))
    return kept.groupBy("external_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n")
        .alias("comment_context")
    )


def with_comments(items: DataFrame, lines: DataFrame) -> DataFrame:
    """comment lines appended to the text under a separator."""
    joined = items.join(lines, "external_id", "left").withColumn("comment_context", F.coalesce("comment_context", F.lit("")))
    text = F.coalesce("text", F.lit(""))
    return joined.withColumn(
        "text",
        F.when(F.col("comment_context") != "", F.concat(strip_ends(text), F.lit(COMMENT_SEPARATOR), "comment_context")).otherwise(text),
    )


def social_records(items: DataFrame) -> DataFrame:
    """Posts as raw records; reads trust_tier, comment_context, metadata_only."""
    body = F.coalesce(
        first_nonempty(strip_ends(F.coalesce(first_nonempty(F.col("text")), F.col("summary"), F.lit("")))), F.col("title"), F.lit("")
    )
    stage = items.withColumns(
        {"_body": body, "_eng": engagement_score(F.col("engagement"), F.col("platform"))}
    )
    return stage.select(
        F.concat(F.lit("social:"), "source_id").alias("provider_id"), "external_id", F.lit("text/plain").alias("mime_type"),
        F.col("_body").alias("text"), "title", "url", "published_at", "platform",
        F.col("source_id").alias("social_source_id"), "source_type", F.col("_eng").alias("engagement_score"),
        quality_score(
            F.col("_eng"), trust_weight(F.col("trust_tier")), F.coalesce("comment_context", F.lit("")) != "",
            F.col("_body"), F.col("title"), F.col("metadata_only"),
        ).alias("quality_score"),
        "trust_tier", F.col("metadata_only").alias("metadata_fallback"), "author_handle", "summary",
        F.concat_ws(":", F.lit("social"), "source_id", "external_id").alias("idempotency_key"),
    )


def social_health(attempts: DataFrame) -> DataFrame:
    """Rows (source_id, platform, pos, success, error, fallback) to one row per source."""
    return attempts.groupBy("source_id", "platform").agg(
        F.count("*").alias("total_attempts"),
        F.count_if("success").alias("total_successes"),
        F.max_by(F.when(~F.col("success"), F.col("error")), "pos").alias("last_error"),
        F.count_if(F.col("fallback")).alias("metadata_fallback_used"),
        (F.count_if("success") / F.count("*")).alias("success_rate"),
    )
