"""Story clusters to trends, findings, alerts and briefing items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import clamp, empty_strings, hash_id, has_any, label
from ..functions.text import is_url_like
from ..functions.vocab import (
    ADOPTION_WORDS, COMPETITION_WORDS, EVENT_LABELS, FINDING_ACTIONS, FINDING_LABELS, TREND_LABELS,
)
from ..operators.ordering import one_row, row_count, top_n, top_n_per, with_positions
from ..operators.story_pairs import rank_struct
from ..operators.unions import ordered_unions

SCORES = ("risk_signal", "opportunity_signal", "competition_signal", "adoption_signal", "narrative_shift",
          "momentum_signal")


def flag(c: Column) -> Column:
    """1.0 when true, 0.0 when false or null."""
    return F.when(c, 1.0).otherwise(0.0)


def filled(a: Column) -> Column:
    return F.size(F.coalesce(a, empty_strings())) > 0


# --- F16 -----------------------------------------------------------------------------
def trend_scores(n: Column, sources: Column, docs: Column, sig: Column, conf: Column, cue: Column, has_url: Column) -> Column:
    """F16: strength, corroboration, novelty and confidence, not rounded."""
    s, d = F.greatest(F.lit(1), sources), F.greatest(F.lit(1), docs)
    s3 = F.least(s, F.lit(3))
    above = lambda x: F.greatest(sig - x, F.lit(0.0))
    return F.struct(
        clamp(0.3 + 0.1 * s3 + 0.05 * (n - 1) + 0.15 * above(0.5)).alias("strength"),
        clamp(0.4 + 0.05 * s3 + 0.08 * (d - 1) + 0.06 * (n - 1)).alias("corroboration"),
        clamp(
            0.32 + 0.16 * flag(cue) + 0.12 * flag(has_url) + 0.1 * above(0.45) + 0.08 * flag(n == 1)
        ).alias("novelty"),
        clamp(
            conf + 0.05 * F.least(d - 1, F.lit(2)) + 0.05 * F.least(n - 1, F.lit(2)), 0.35, 0.95
        ).alias("confidence"),
    )


# --- F14, F15 ----------------------------------------------------------------------------
def competition_cue(watch: Column, text: Column, family: Column) -> Column:
    return (F.size(watch) >= 2) | has_any(text, COMPETITION_WORDS) | (family == "competition")


def adoption_cue(topics: Column, text: Column, family: Column) -> Column:
    return (
        (family == "adoption")
        | F.exists(topics, lambda t: t.endswith(":model_release"))
        | has_any(text, ADOPTION_WORDS)
    )


def trend_type(family, n, corroboration, watch, topics, risk, opportunity, text) -> Column:
    """first rule that holds."""
    low = F.lower(text)
    return (
        F.when(filled(risk) | (family == "risk") | F.exists(topics, lambda t: t.contains(":risk")), "risk_cluster")
        .when(adoption_cue(topics, low, family), "adoption_cluster")
        .when(
            filled(opportunity) | (family == "opportunity") | F.exists(topics, lambda t: t.contains(":opportunity")),
            "opportunity_cluster",
        )
        .when(competition_cue(watch, low, family), "competition_cluster")
        .when((n > 1) & (corroboration >= 0.52), "momentum_cluster")
        .otherwise("narrative_cluster")
    )


def direction(n: Column, novelty: Column, corroboration: Column) -> Column:
    """F15."""
    return (
        F.when((n >= 3) | ((n >= 2) & (novelty >= 0.58) & (corroboration >= 0.5)), "accelerating")
        .when(novelty >= 0.55, "emerging")
        .otherwise("stable")
    )


# --- F17 ------------------------------------------------------------------------------------
def with_route(df: DataFrame) -> DataFrame:
    """adds finding_type, routing_explain and routing_scores.

    Reads display_title, summary, trend_type, event_family, event_count,
    significance_avg, novelty_score, corroboration_score and the four hit lists.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("display_title", F.lit("")), F.coalesce("summary", F.lit(""))))
    stage = df.withColumn("_text", text).withColumns(
        {
            "_comp": competition_cue(F.col("watchlist_hits"), F.col("_text"), F.col("event_family")),
            "_adopt": adoption_cue(F.col("topic_hits"), F.col("_text"), F.col("event_family")),
            "_narr": (F.col("event_family") == "narrative") | (F.col("trend_type") == "narrative_cluster"),
            "_risk": filled(F.col("risk_keyword_hits")) | F.exists("topic_hits", lambda t: t.contains(":risk")),
            "_opp": filled(F.col("opportunity_keyword_hits")) | F.exists("topic_hits", lambda t: t.contains(":opportunity")),
            "_many": F.col("event_count") > 1,
            "_firm": F.col("corroboration_score") >= 0.5,
            "_fresh": F.col("novelty_score") >= 0.58,
            "_big": F.when(F.col("significance_avg") == 0, 0.5).otherwise(F.col("significance_avg")) >= 0.65,
        }
    ).withColumn("_watch", filled(F.col("watchlist_hits")) & ~F.col("_comp"))
    c = F.col

    def bonus(kind: str, value: float) -> Column:
        return value * flag(c("trend_type") == kind)

    score = {
        "risk_signal": 0.08 + 0.52 * flag(c("_risk")) + 0.1 * flag(c("_big")) + 0.03 * flag(c("_watch"))
        + bonus("risk_cluster", 0.18),
        "opportunity_signal": 0.08 + 0.52 * flag(c("_opp")) + 0.08 * flag(c("_fresh") & ~c("_adopt"))
        + 0.1 * flag(c("_big")) + 0.03 * flag(c("_watch")) + bonus("opportunity_cluster", 0.18)
        - 0.04 * flag(c("_adopt")),
        "competition_signal": 0.05 + 0.42 * flag(c("_comp")) + bonus("competition_cluster", 0.16)
        - 0.1 * flag(~c("_comp")),
        "adoption_signal": 0.08 + 0.58 * flag(c("_adopt")) + 0.05 * flag(c("_watch"))
        + bonus("adoption_cluster", 0.18),
        "narrative_shift": 0.18 + 0.32 * flag(c("_narr")) + 0.06 * flag(c("_firm")) + 0.05 * flag(c("_fresh"))
        + bonus("narrative_cluster", 0.12),
        "momentum_signal": 0.15 + 0.18 * flag(c("_many")) + 0.18 * flag(c("_firm")) + 0.12 * flag(c("_fresh"))
        + 0.12 * flag(c("_big")) + bonus("momentum_cluster", 0.16),
    }
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(k).alias("name")) for k, s in score.items()]))
    first3 = lambda a: F.array_join(F.slice(a, 1, 3), ", ")
    lead = lambda hits: F.when(filled(hits), hits).otherwise(c("topic_hits"))
    explain = F.array_distinct(
        F.array_compact(
            F.array(
                F.when(c("_risk"), F.concat(F.lit("risk cues: "), first3(lead(c("risk_keyword_hits"))))),
                F.when(c("_adopt"), F.lit("adoption/release style event cues present")),
                F.when(c("_opp"), F.concat(F.lit("opportunity cues: "), first3(lead(c("opportunity_keyword_hits"))))),
                F.when(c("_comp"), F.lit("multiple peer/comparison cues present")),
                F.when(c("_narr"), F.lit("cluster looks like a narrative/coverage shift")),
                F.when(c("_many"), F.format_string("%d related events merged into one story", c("event_count"))),
                F.when(c("_firm"), F.format_string("corroboration %.2f indicates repeated confirmation", c("corroboration_score"))),
                F.when(c("_fresh"), F.format_string("novelty %.2f suggests a fresh development", c("novelty_score"))),
                F.when(c("_big"), F.format_string("mean significance %.2f lifts urgency", c("significance_avg"))),
                F.when(c("_watch"), F.concat(F.lit("watchlist hits: "), first3(c("watchlist_hits")))),
            )
        )
    )
    fallback = F.when(c("_many"), "momentum_signal").otherwise("narrative_shift")
    return (
        stage.withColumn("_best", best)
        .withColumns(
            {
                "finding_type": F.when(c("_best")["score"] < 0.4, fallback).otherwise(c("_best")["name"]),
                "routing_explain": explain,
                "routing_scores": F.struct(*[F.round(s, 3).alias(k) for k, s in score.items()]),
            }
        )
        .drop("_text", "_comp", "_adopt", "_narr", "_risk", "_opp", "_many", "_firm", "_fresh", "_big", "_watch", "_best")
    )


# --- F18 --------------------------------------------------------------------------------------
def importance(sig: Column, corroboration: Column, scores: Column, n: Column, hits: Column) -> Column:
    top = F.greatest(*[scores[k] for k in SCORES])
    return clamp(
        0.28 + 0.3 * sig + 0.18 * corroboration + 0.12 * top + 0.06 * F.least(n - 1, F.lit(2)) + 0.04 * flag(hits)
    )


def relevance(importance_raw: Column, sig: Column, scores: Column, watch: Column, topics: Column) -> Column:
    top = F.greatest(*[scores[k] for k in ("risk_signal", "opportunity_signal", "adoption_signal", "competition_signal")])
    return clamp(0.4 * importance_raw + 0.22 * top + 0.12 * sig + 0.08 * flag(watch) + 0.06 * flag(topics))


# --- A2 + F19 -------------------------------------------------------------------------------------
def _mean(c: str) -> Column:
    # an exact sum, so that the result does not depend on the partitioning
    return F.sum(F.col(c).cast("decimal(20,10)")).cast("double") / F.count("*")


def build_trends(profiles: DataFrame, membership: DataFrame, reasons: DataFrame) -> DataFrame:
    """One trend per story."""
    members = profiles.join(membership, "event_id")
    lists = ordered_unions(
        members, ["component"], rank_struct(),
        {
            "evidence_ids": F.col("evidence_ids"), "doc_ids": F.col("doc_ids"), "urls": F.col("canonical_urls"),
            "source_ids": F.col("source_ids"), "watchlist_hits": F.col("watchlist_hits"),
            "topic_hits": F.col("topic_hits"), "risk_keyword_hits": F.col("risk_keyword_hits"),
            "opportunity_keyword_hits": F.col("opportunity_keyword_hits"), "event_types": F.array("event_type"),
            "event_family": F.array("event_family"), "subject": F.array("subject"), "days": F.array("day_bucket"),
        },
        modes=("event_family", "subject"),
    )
    totals = members.groupBy("component").agg(
        F.count("*").alias("n"), _mean("significance_score").alias("sig"), _mean("confidence").alias("conf"),
        F.min("event_time").alias("window_start"), F.max("event_time").alias("window_end"),
        F.bool_or(F.col("event_family").isin("adoption", "competition")).alias("moving"),
        F.transform(F.array_sort(F.collect_list(rank_struct())), lambda r: r["id"]).alias("event_ids"),
    )
    leaders = top_n_per(
        members.select("component", "event_id", "significance_score", "confidence", "display_title", "event_type",
                       "similarity_text"),
        ["component"], [F.desc("significance_score"), F.desc("confidence"), "event_id"], 2,
    ).groupBy("component").agg(
        F.array_sort(
            F.collect_list(
                F.struct(rank_struct().alias("r"), "event_id", "display_title", "event_type", "similarity_text")
            )
        ).alias("lead")
    ).select(
        "component", F.col("lead")[0].alias("rep"),
        F.array_join(F.transform("lead", lambda r: r["similarity_text"]), " ").alias("lead_text"),
    )
    joined = (
        totals.join(lists, "component").join(leaders, "component")
        .join(reasons, "component", "left")
        .withColumn("merge_reasons", F.coalesce("merge_reasons", empty_strings()))
    )
    stage = joined.withColumns(
        {
            "n_sources": F.greatest(F.size("source_ids"), F.lit(1)),
            "n_docs": F.greatest(F.size("doc_ids"), F.lit(1)),
            "n_evidence": F.size("evidence_ids"),
        }
    ).withColumn(
        "raw",
        trend_scores(
            F.col("n"), F.col("n_sources"), F.col("n_docs"), F.col("sig"), F.col("conf"),
            filled(F.col("opportunity_keyword_hits")) | filled(F.col("risk_keyword_hits")) | F.col("moving"),
            filled(F.col("urls")),
        ),
    ).withColumns(
        {
            "trend_type": trend_type(
                F.col("event_family"), F.col("n"), F.col("raw.corroboration"), F.col("watchlist_hits"),
                F.col("topic_hits"), F.col("risk_keyword_hits"), F.col("opportunity_keyword_hits"), F.col("lead_text"),
            ),
            "direction": direction(F.col("n"), F.col("raw.novelty"), F.col("raw.corroboration")),
        }
    )
    trend_label = label(TREND_LABELS, F.col("trend_type"), "story cluster")
    shown = F.col("rep.display_title")
    stage = stage.withColumn(
        "title",
        F.when((shown != "") & ~is_url_like(shown), shown)
        .when(F.col("n") > 1, F.concat_ws(" ", "subject", trend_label))
        .otherwise(F.concat_ws(" ", "subject", label(EVENT_LABELS, F.col("rep.event_type"), "story signal"))),
    )
    first3 = lambda a: F.array_join(F.slice(F.col(a), 1, 3), ", ")
    explain = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, F.format_string("Merged %d related events into one trend.", "n")),
            F.when(filled(F.col("merge_reasons")),
                   F.concat(F.lit("Grouping signals: "), F.array_join("merge_reasons", ", "), F.lit("."))),
            F.when(F.col("n_docs") > 1, F.format_string("Story is supported by %d canonical document(s).", "n_docs")),
            F.when(F.col("n_sources") > 1, F.format_string("Coverage spans %d distinct source(s).", "n_sources")),
            F.when(filled(F.col("watchlist_hits")),
                   F.concat(F.lit("Watchlist entity hits: "), first3("watchlist_hits"), F.lit("."))),
            F.when(filled(F.col("topic_hits")), F.concat(F.lit("Topic hits: "), first3("topic_hits"), F.lit("."))),
            F.when(filled(F.col("risk_keyword_hits")),
                   F.concat(F.lit("Risk cues: "), first3("risk_keyword_hits"), F.lit("."))),
            F.when(filled(F.col("opportunity_keyword_hits")),
                   F.concat(F.lit("Opportunity cues: "), first3("opportunity_keyword_hits"), F.lit("."))),
        )
    )
    alone = F.array(F.lit("Single event retained as its own trend because no strong merge signals were present."))
    why = F.format_string(
        "%s has %d related event(s) grouped into a single story. Corroboration is %.2f across %d document(s) and "
        "%d evidence item(s); novelty is %.2f and the story direction is %s.",
        "subject", "n", "raw.corroboration", "n_docs", "n_evidence", "raw.novelty", "direction",
    )
    noted = filled(F.col("watchlist_hits")) | filled(F.col("topic_hits"))
    return stage.select(
        hash_id("tr", F.col("event_ids")).alias("trend_id"),
        "title", F.col("title").alias("display_title"),
        F.format_string("%s (%d event(s), %d evidence item(s)).", "title", "n", "n_evidence").alias("summary"),
        "subject", F.concat_ws(" ", "subject", trend_label).alias("theme"),
        "trend_type", "direction",
        F.round("raw.strength", 3).alias("strength_score"), F.round("raw.novelty", 3).alias("novelty_score"),
        F.round("raw.corroboration", 3).alias("corroboration_score"), F.round("raw.confidence", 3).alias("confidence"),
        F.col("event_ids").alias("supporting_event_ids"), F.col("evidence_ids").alias("supporting_evidence_ids"),
        F.col("doc_ids").alias("supporting_document_ids"), F.col("urls").alias("canonical_urls"), "event_ids",
        "window_start", "window_end", F.greatest(F.lit(1), F.size("days")).alias("span_days"),
        F.array(hash_id("bun", F.col("event_ids"))).alias("bundle_ids"),
        F.concat(why, F.when(noted, F.lit(" Watchlist context is present.")).otherwise("")).alias("why_it_matters"),
        "merge_reasons", F.when(F.size(explain) > 0, explain).otherwise(alone).alias("explain"),
        "event_types", "event_family", "watchlist_hits", "topic_hits", "risk_keyword_hits",
        "opportunity_keyword_hits", "source_ids", F.col("rep.event_id").alias("representative_event_id"),
        F.col("n").alias("event_count"), F.col("n_evidence").alias("evidence_count"),
        F.size("doc_ids").alias("document_count"), F.round("sig", 3).alias("significance_avg"),
        F.col("sig").alias("significance_raw"), (-F.col("rep.r.s")).alias("lead_significance"),
    )


def action_texts() -> Column:
    """the three texts of a finding type."""
    out = None
    for kind, texts in FINDING_ACTIONS.items():
        value = F.array(*[F.lit(t) for t in texts])
        out = F.when(F.col("finding_type") == kind, value) if out is None else out.when(F.col("finding_type") == kind, value)
    return out


def finding_summary(kind: Column, title: Column, subject: Column, n: Column) -> Column:
    """one sentence per finding type."""
    name = label(FINDING_LABELS, kind, "Finding")
    return (
        F.when(kind == "risk_signal", F.format_string("%s for %s: %s (%d related event(s)).", name, subject, title, n))
        .when(kind == "opportunity_signal", F.format_string("%s around %s: %s.", name, subject, title))
        .when(kind == "competition_signal",
              F.format_string("%s around %s: monitor how peers respond to %s.", name, subject, F.lower(title)))
        .when(kind == "adoption_signal",
              F.format_string("%s for %s: rollout or customer uptake is becoming visible.", name, subject))
        .when(kind == "momentum_signal",
              F.format_string("%s: repeated related events suggest this story is gaining traction.", name))
        .otherwise(F.format_string("%s: this story is shaping the surrounding narrative for %s.", name, subject))
    )


def build_findings(trends: DataFrame) -> DataFrame:
    """One routed and scored finding per trend."""
    routed = with_route(trends)
    scores, sig, n = F.col("routing_scores"), F.col("significance_raw"), F.col("event_count")
    watch, topics = filled(F.col("watchlist_hits")), filled(F.col("topic_hits"))
    stage = routed.withColumn("_imp", importance(sig, F.col("corroboration_score"), scores, n, watch | topics))
    title = F.concat(label(FINDING_LABELS, F.col("finding_type"), "Finding"), F.lit(" — "), F.col("display_title"))
    return stage.select(
        hash_id("fd", F.array("trend_id", "finding_type")).alias("finding_id"),
        "trend_id", "finding_type", title.alias("title"), title.alias("display_title"),
        finding_summary(F.col("finding_type"), F.col("display_title"), F.col("subject"), n).alias("summary"),
        "subject", "theme", "confidence",
        F.round("_imp", 3).alias("importance_score"),
        F.round(relevance(F.col("_imp"), sig, scores, watch, topics), 3).alias("decision_relevance_score"),
        "supporting_event_ids", "supporting_evidence_ids", action_texts().alias("recommended_actions"),
        "why_it_matters", "bundle_ids", "trend_type", "watchlist_hits", "topic_hits", "risk_keyword_hits",
        "opportunity_keyword_hits", F.col("routing_explain").alias("explain"), "routing_scores", "merge_reasons",
        "event_types", "representative_event_id", "lead_significance",
    )


# --- X6 -----------------------------------------------------------------------------------------
def finding_order() -> list[Column]:
    return [F.desc("importance_score"), F.desc("decision_relevance_score"), F.col("finding_id")]


def story_order() -> list[Column]:
    """Input order of the decision layer: best story first."""
    return [F.desc("lead_significance"), F.col("representative_event_id")]


def build_alerts(findings: DataFrame) -> DataFrame:
    """Important or relevant findings, and the first in any case."""
    slim = findings.select("finding_id", "importance_score", "decision_relevance_score")
    ranked = with_positions(slim, finding_order())
    raised = (F.col("importance_score") >= 0.58) | (F.col("decision_relevance_score") >= 0.52) | (F.col("rank") == 0)
    return ranked.filter(raised).select(
        F.concat(F.lit("al_"), (F.col("rank") + 1).cast("string")).alias("alert_id"), "finding_id",
        F.when(F.col("importance_score") >= 0.82, "high").otherwise("medium").alias("level"),
    )


def build_briefing_items(findings: DataFrame) -> DataFrame:
    """The first three findings."""
    top = top_n(findings.select("finding_id", "importance_score", "decision_relevance_score", "display_title"),
                finding_order(), 3)
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(*finding_order()))  # three rows
    return top.select(
        F.concat(F.lit("br_"), n.cast("string")).alias("briefing_id"), "finding_id", F.col("display_title").alias("title")
    )


def layer_counts(events: DataFrame, trends: DataFrame, findings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counts of the intelligence layer in one row."""
    out = one_row(
        events.sparkSession, input_events=row_count(events), trends=row_count(trends), findings=row_count(findings), alerts=row_count(alerts)
    )
    return out.withColumns(
        {
            "briefing_items": F.least(F.col("findings"), F.lit(3)).cast("bigint"),
            "merged_events": F.greatest(F.lit(0), F.col("input_events") - F.col("trends")).cast("bigint"),
        }
    )
