"""Findings to signals, recommendations and briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import empty_strings, first_nonempty, hash_id, label, ordered_distinct
from ..functions.vocab import ACTION_ROWS, BRIEF_ROWS, SECTION_LABELS, SECTION_ORDER, WATCH_ORDER
from ..operators.ordering import one_row, row_count, sequential_ids, top_n, top_n_per
from ..operators.unions import first_values, ordered_unions
from .findings import filled, flag

_FALLBACK = next(r for r in ACTION_ROWS if r[0] == "momentum_signal")


def _action(field: int) -> Column:
    """A field of the action table for the finding type of the row."""
    out = None
    for row in ACTION_ROWS:
        hit = F.col("finding_type") == row[0]
        out = F.when(hit, row[field]) if out is None else out.when(hit, row[field])
    return out.otherwise(_FALLBACK[field])


def build_signals(findings: DataFrame, order: list[Column]) -> DataFrame:
    """One signal per finding, numbered in input order."""
    kinds = {r[0]: r[3] for r in ACTION_ROWS}
    numbered = sequential_ids(findings, order, "ds_", "signal_id")
    return numbered.select(
        "signal_id", "finding_id", label(kinds, F.col("finding_type"), "watch").alias("signal_type"),
        "decision_relevance_score", F.array("finding_id").alias("supporting_finding_ids"),
        "supporting_event_ids", "supporting_evidence_ids",
        F.regexp_extract("signal_id", r"(\d+)$", 1).cast("bigint").alias("pos"),
    )


def finding_records(findings: DataFrame, signals: DataFrame) -> DataFrame:
    """Findings with their input position and signal, defaults filled."""
    f = findings.drop("pos") if "pos" in findings.columns else findings
    joined = f.join(signals.select("finding_id", "signal_id", "pos"), "finding_id")
    text = lambda *names: F.coalesce(first_nonempty(*[F.col(n) for n in names]), F.lit(""))
    arr = lambda n: F.coalesce(F.col(n), empty_strings())
    return joined.select(
        "pos", "signal_id", "finding_id",
        F.coalesce(first_nonempty(F.col("finding_type")), F.lit("narrative_shift")).alias("finding_type"),
        text("display_title", "title").alias("title"), text("theme").alias("theme"), text("subject").alias("subject"),
        F.coalesce("importance_score", F.lit(0.0)).alias("importance_score"),
        F.coalesce("decision_relevance_score", F.lit(0.0)).alias("decision_relevance_score"),
        arr("supporting_event_ids").alias("supporting_event_ids"),
        arr("supporting_evidence_ids").alias("supporting_evidence_ids"),
        arr("watchlist_hits").alias("watchlist_hits"), arr("topic_hits").alias("topic_hits"),
        arr("explain").alias("explain"),
    )


def recommendation_priority(rel: Column, imp: Column, boost: Column, watch: Column, topics: Column, n: Column) -> Column:
    """F21."""
    breadth = F.least(F.lit(0.12), 0.04 * F.greatest(n - 1, F.lit(0)))
    return F.least(
        F.lit(1.0),
        F.round(rel * 0.55 + imp * 0.25 + boost + 0.04 * flag(watch) + 0.03 * flag(topics) + breadth, 3),
    )


def build_recommendations(records: DataFrame) -> DataFrame:
    """Findings of one action and theme become one recommendation (A3)."""
    keyed = records.withColumns(
        {
            "recommended_action": _action(1),
            "group_theme": first_nonempty(F.col("theme"), F.col("subject"), _action(3)),
            "display_action": _action(2), "bucket": _action(3), "boost": _action(4),
            "base_rationale": _action(5), "base_why": _action(6),
        }
    )
    key = ["recommended_action", "group_theme"]
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,10)")).cast("double") / F.count("*")
    totals = keyed.groupBy(*key).agg(
        F.count("*").alias("n"), exact("decision_relevance_score").alias("rel"), exact("importance_score").alias("imp"),
        F.max("decision_relevance_score").alias("top_relevance"),
        F.bool_or(F.size("watchlist_hits") > 0).alias("watch"), F.bool_or(F.size("topic_hits") > 0).alias("topics"),
        F.min_by("signal_id", "pos").alias("signal_id"),
        *[F.first(c).alias(c) for c in ("display_action", "bucket", "boost", "base_rationale", "base_why")],
    )
    lists = ordered_unions(
        keyed, key, F.col("pos"),
        {
            "supporting_finding_ids": F.array("finding_id"), "supporting_event_ids": F.col("supporting_event_ids"),
            "supporting_evidence_ids": F.col("supporting_evidence_ids"), "consolidated_signal_ids": F.array("signal_id"),
            "consolidated_subjects": F.array("subject"), "titles": F.array("title"),
            "watchlist_hits": F.col("watchlist_hits"), "topic_hits": F.col("topic_hits"),
        },
    )
    joined = totals.join(lists, key)
    n = F.col("n")
    breadth = F.least(F.lit(0.12), 0.04 * F.greatest(n - 1, F.lit(0)))
    rationale = F.concat(
        F.col("base_rationale"),
        F.when(
            n > 1,
            F.format_string(" This consolidated action combines %d related findings under %s.", n, F.col("group_theme")),
        ).when(filled(F.col("titles")), F.format_string(" The leading finding is '%s'.", F.get("titles", F.lit(0))))
        .otherwise(""),
    )
    why = F.concat(
        F.col("base_why"),
        F.when(
            filled(F.col("consolidated_subjects")),
            F.concat(F.lit(" Focus is concentrated on "), F.array_join(F.slice("consolidated_subjects", 1, 3), ", "), F.lit(".")),
        ).otherwise(""),
    )
    explain = F.array_compact(
        F.array(
            F.format_string("0.55*decision_relevance_avg(%.2f)", "rel"),
            F.format_string("+ 0.25*importance_avg(%.2f)", "imp"),
            F.format_string("+ action_boost(%.2f)", "boost"),
            F.when(F.col("watch"), F.lit("+ watchlist_boost(0.04)")),
            F.when(F.col("topics"), F.lit("+ topic_boost(0.03)")),
            F.when(breadth > 0, F.format_string("+ breadth_boost(%.2f)", breadth)),
        )
    )
    ids = ordered_distinct(F.concat(F.array("recommended_action", "group_theme"), F.col("supporting_finding_ids")))
    return joined.select(
        hash_id("rec", ids).alias("recommendation_id"), "signal_id", "recommended_action", "display_action",
        recommendation_priority(
            F.col("rel"), F.col("imp"), F.col("boost"), F.col("watch"), F.col("topics"), n
        ).alias("priority"),
        rationale.alias("rationale"), why.alias("why_now"),
        (F.col("recommended_action") == "escalate_risk_review").alias("requires_human_review"),
        "supporting_finding_ids", "supporting_event_ids", "supporting_evidence_ids", "bucket",
        "consolidated_signal_ids", F.size("consolidated_signal_ids").alias("consolidated_signal_count"),
        n.alias("consolidated_finding_count"), "consolidated_subjects", explain.alias("priority_explain"),
        F.col("group_theme").alias("theme"), F.slice("titles", 1, 5).alias("supporting_titles"),
        "watchlist_hits", "topic_hits", "top_relevance",
    )


def recommendation_order() -> list[Column]:
    """W8."""
    return [F.desc("top_relevance"), F.desc("consolidated_finding_count"), F.col("recommended_action"), F.col("theme")]


# --- X9 -------------------------------------------------------------------------------------------
def _theme_label() -> Column:
    return first_nonempty(F.col("theme"), F.col("subject"), F.replace("finding_type", F.lit("_"), F.lit(" ")))


def _section_rank() -> Column:
    return F.struct(
        (-F.col("decision_relevance_score")).alias("r"), (-F.col("importance_score")).alias("i"),
        F.col("finding_id").alias("id"),
    )


def build_sections(records: DataFrame) -> DataFrame:
    """A4: at most six rows, one per finding type, in section order."""
    known = records.filter(F.col("finding_type").isin(*SECTION_ORDER)).withColumn("label_text", _theme_label())
    counts = known.groupBy("finding_type").agg(F.count("*").alias("n"))
    lists = first_values(
        known, ["finding_type"], _section_rank(),
        {
            "subjects": (F.array("subject"), 3), "titles": (F.array("title"), 1), "explains": (F.col("explain"), 2),
            "finding_ids": (F.array("finding_id"), 4),
        },
    )
    leaders = top_n_per(
        known, ["finding_type"],
        [F.desc("decision_relevance_score"), F.desc("importance_score"), "finding_id"], 3,
    ).groupBy("finding_type").agg(
        F.array_sort(F.collect_list(F.struct(_section_rank().alias("r"), "label_text", "title"))).alias("lead")
    )
    rows = counts.join(lists, "finding_type").join(leaders, "finding_type")
    subjects = F.when(filled(F.col("subjects")), F.col("subjects")).otherwise(F.array(F.col("lead")[0]["label_text"]))
    paragraph = F.concat(
        label(SECTION_LABELS, F.col("finding_type"), "Theme"), F.lit(": "), F.array_join(subjects, ", "), F.lit("."),
        F.when(filled(F.col("titles")), F.concat(F.lit(" Leading signal: "), F.get("titles", F.lit(0)), F.lit("."))).otherwise(""),
        F.when(F.col("n") > 1, F.format_string(" %d findings reinforce the same story cluster.", "n")).otherwise(""),
        F.when(filled(F.col("explains")),
               F.concat(F.lit(" Why it matters: "), F.array_join("explains", "; "), F.lit("."))).otherwise(""),
    )
    place = F.array_position(F.array(*[F.lit(t) for t in SECTION_ORDER]), F.col("finding_type"))
    return rows.select(
        place.cast("int").alias("section"), F.initcap(F.replace("finding_type", F.lit("_"), F.lit(" "))).alias("title"),
        "finding_type", paragraph.alias("paragraph"), "finding_ids", F.col("n").alias("finding_count"),
        F.transform("lead", lambda x: x["label_text"]).alias("labels"),
        F.transform(F.slice("lead", 1, 2), lambda x: F.coalesce(first_nonempty(x["title"]), x["label_text"])).alias("watch"),
    )


def _first_ids(recs: DataFrame, n: int, name: str, value: str = "recommendation_id") -> DataFrame:
    top = top_n(recs.select("top_relevance", "consolidated_finding_count", "recommended_action", "theme", "recommendation_id"),
                recommendation_order(), n)
    ranked = F.struct((-F.col("top_relevance")).alias("a"), (-F.col("consolidated_finding_count")).alias("b"),
                      F.col("recommended_action").alias("c"), F.col("theme").alias("d"), F.col(value).alias("v"))
    return top.agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["v"]).alias(name))


def build_briefs(records: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Three briefs over the whole run.

    Everything joined here is a single row: counts, and lists cut to the few
    entries a brief shows. The full id lists are `brief_support` rows.
    """
    sections = build_sections(records)
    per_type = lambda kind, field: F.flatten(
        F.collect_list(F.when(F.col("finding_type") == kind, F.col(field)))
    )
    shown = sections.agg(
        F.array_sort(
            F.collect_list(F.struct("section", "title", "finding_type", "paragraph", "finding_ids"))
        ).alias("sections"),
        per_type("risk_signal", "labels").alias("top_risks"),
        per_type("opportunity_signal", "labels").alias("top_opportunities"),
        F.concat(*[per_type(k, "watch") for k in WATCH_ORDER]).alias("watch"),
    )
    memo = recommendations.filter(
        F.col("recommended_action").isin("escalate_risk_review", "pursue_opportunity_validation")
    )
    one = one_row(
        records.sparkSession, n_findings=row_count(records), n_recommendations=row_count(recommendations),
        shown=shown.select(F.struct("sections", "top_risks", "top_opportunities", "watch")),
        best=_first_ids(recommendations, 5, "best"), memo=_first_ids(memo, 5, "memo"),
        actions=_first_ids(recommendations, 3, "actions", "recommended_action"),
    ).filter("n_findings > 0").select("*", "shown.*").drop("shown")
    signal_ids = lambda k: F.transform(
        F.sequence(F.lit(1), F.least(F.col("n_findings"), F.lit(k)).cast("int")), lambda i: F.concat(F.lit("ds_"), i.cast("string"))
    )
    kinds = F.explode(
        F.array(*[F.struct(F.lit(t).alias("brief_type"), F.lit(a).alias("title"), F.lit(f).alias("focus"))
                  for t, a, f in BRIEF_ROWS])
    )
    rows = one.withColumn("k", kinds).select("*", "k.brief_type", "k.title", "k.focus").drop("k")
    summary = (
        F.when(
            F.col("brief_type") == "watch_brief",
            F.format_string("%d findings collapsed into %d action items. Focus on the stories that continue to "
                            "accumulate corroboration.", "n_findings", "n_recommendations"),
        )
        .when(
            F.col("brief_type") == "risk_opportunity_memo",
            F.format_string("Top risks: %d. Top opportunities: %d. Recommendations have been consolidated to avoid "
                            "duplicate action items.", F.size("top_risks"), F.size("top_opportunities")),
        )
        .otherwise(
            F.format_string("%d findings now resolve into %d higher-value recommendations instead of per-signal "
                            "action stacks.", "n_findings", "n_recommendations")
        )
    )
    picked = F.when((F.col("brief_type") == "risk_opportunity_memo") & filled(F.col("memo")), F.col("memo")).when(
        F.col("brief_type") == "risk_opportunity_memo", F.slice("best", 1, 3)
    ).otherwise(F.col("best"))
    lines = F.array_compact(
        F.concat(
            F.array(F.concat(F.lit("This brief summarizes "), F.col("focus"), F.lit("."))),
            F.transform(F.slice("sections", 1, 3), lambda s: s["paragraph"]),
            F.array(
                F.when(filled(F.col("watch")),
                       F.concat(F.lit("Continue watching: "), F.array_join(F.slice("watch", 1, 4), ", "), F.lit("."))),
                F.when(filled(F.col("actions")),
                       F.concat(F.lit("Next actions: "), F.array_join("actions", ", "), F.lit("."))),
            ),
        )
    )
    rows = rows.withColumn("picked", picked)
    ids = F.filter(
        F.concat(F.array("brief_type"), signal_ids(4), F.slice("picked", 1, 4)), lambda v: v.isNotNull() & (v != "")
    )
    return rows.select(
        hash_id("dbrief", ids).alias("brief_id"), "brief_type", "title", summary.alias("summary"),
        F.array_join(lines, "\n\n").alias("narrative"),
        F.transform("sections", lambda s: s.dropFields("section")).alias("sections"),
        signal_ids(6).alias("key_signals"), F.col("picked").alias("recommendations"), "top_risks", "top_opportunities",
        F.slice(ordered_distinct(F.col("watch")), 1, 6).alias("top_watch_items"), F.col("focus").alias("brief_focus"),
        "n_findings", "n_recommendations", F.size("sections").alias("section_count"),
        F.transform("sections", lambda s: s["title"]).alias("section_themes"),
    )


def brief_support(records: DataFrame) -> DataFrame:
    """All finding, event and evidence ids behind the briefs, a row each.

    Every brief of a run rests on the same ids, so they are stored once and
    carry the first position that shows them.
    """
    tag = lambda kind, ids: F.transform(ids, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), v.alias("id")))
    rows = records.select(
        "pos",
        F.explode(
            F.concat(tag("finding", F.array("finding_id")), tag("event", F.col("supporting_event_ids")),
                     tag("evidence", F.col("supporting_evidence_ids")))
        ).alias("t"),
    )
    return rows.groupBy(F.col("t.kind").alias("kind"), F.col("t.id").alias("id")).agg(
        F.min(F.struct("pos", "t.at")).alias("first")
    ).select("kind", "id", F.col("first.pos").alias("pos"), F.col("first.at").alias("at"))


def decision_counts(records: DataFrame, recommendations: DataFrame, briefs: DataFrame) -> DataFrame:
    """Counts of the decision layer in one row."""
    return one_row(
        records.sparkSession, findings_in=row_count(records), signals=row_count(records), recommendations=row_count(recommendations),
        consolidated_actions=recommendations.agg(F.count_distinct("recommended_action")), briefs=row_count(briefs),
    )
