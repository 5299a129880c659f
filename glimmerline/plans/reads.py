"""Filtered, sorted and drill-down reads over stored layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import empty_strings, first_nonempty
from ..operators.ordering import one_row, page, page_info, row_count, top_n_per

# --- P16 ---------------------------------------------------------------------------------
FILTERS = {
    "run_id": lambda v: F.col("run_id") == v, "finding_type": lambda v: F.col("finding_type") == v,
    "trend_type": lambda v: F.col("trend_type") == v, "event_type": lambda v: F.col("event_type") == v,
    "subject": lambda v: F.col("subject") == v, "theme": lambda v: F.col("theme") == v,
    "recommended_action": lambda v: F.col("recommended_action") == v,
    "min_importance": lambda v: F.col("importance_score") >= v,
    "min_decision_relevance": lambda v: F.col("decision_relevance_score") >= v,
}
# entity -> (id, {sort name: column}, default sort)
SORTS = {
    "trends": ("trend_id", {"strength": "strength_score", "novelty": "novelty_score", "corroboration": "corroboration_score",
                            "created_at": "created_at"}, "strength"),
    "findings": ("finding_id", {"importance": "importance_score", "decision_relevance": "decision_relevance_score",
                                "created_at": "created_at"}, "importance"),
    "events": ("event_id", {"significance": "significance_score", "created_at": "created_at"}, "significance"),
    "recommendations": ("recommendation_id", {"priority": "priority", "created_at": "created_at"}, "priority"),
    "briefs": ("brief_id", {"created_at": "created_at"}, "created_at"),
    "briefing_items": ("briefing_id", {"created_at": "created_at"}, "created_at"),
    "alerts": ("alert_id", {"created_at": "created_at"}, "created_at"),
    "watchlists": ("watchlist_id", {"created_at": "created_at"}, "created_at"),
}


def apply_filters(df: DataFrame, **wanted) -> DataFrame:
    """The given filters joined by AND; None is no filter."""
    parts = [FILTERS[k](v) for k, v in wanted.items() if v is not None and v != ""]
    return df.filter(reduce(lambda a, b: a & b, parts)) if parts else df


def order_for(entity: str, sort: str | None = None) -> list[Column]:
    """Sort columns; the id breaks ties."""
    key, sorts, default = SORTS[entity]
    return [F.desc(sorts.get(sort or default, sorts[default])), F.col(key)]


def list_page(df: DataFrame, entity: str, sort: str | None = None, page_no: int = 1, page_size: int = 20, **wanted) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, total and total_pages)."""
    hit = apply_filters(df, **wanted)
    return page(hit, order_for(entity, sort), page_no, page_size), page_info(hit, page_size)


def size_or_zero(c: str) -> Column:
    return F.size(F.coalesce(F.col(c), empty_strings()))


# --- S22 summaries ---------------------------------------------------------------------------
def trend_summary(trends: DataFrame) -> DataFrame:
    title = first_nonempty(F.col("display_title"), F.col("title"), F.col("theme"), F.col("trend_id"))
    return trends.withColumns(
        {
            "title": title, "display_title": title, "event_count": size_or_zero("event_ids"),
            "evidence_count": size_or_zero("supporting_evidence_ids"), "document_count": size_or_zero("supporting_document_ids"),
        }
    )


def finding_summary(findings: DataFrame) -> DataFrame:
    title = first_nonempty(F.col("display_title"), F.col("title"), F.col("finding_id"))
    return findings.withColumns(
        {
            "title": title, "display_title": title, "event_count": size_or_zero("supporting_event_ids"),
            "evidence_count": size_or_zero("supporting_evidence_ids"),
        }
    )


def event_summary(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "canonical_title": first_nonempty(F.col("canonical_title"), F.col("title")),
            "significance_score": F.coalesce("significance_score", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit(0.0)),
            "evidence_count": size_or_zero("supporting_evidence_ids"),
        }
    )


def recommendation_summary(recs: DataFrame) -> DataFrame:
    return recs.withColumns(
        {
            "finding_count": size_or_zero("supporting_finding_ids"), "event_count": size_or_zero("supporting_event_ids"),
            "evidence_count": size_or_zero("supporting_evidence_ids"),
        }
    )


def brief_summary(briefs: DataFrame) -> DataFrame:
    return briefs.withColumns({"signal_count": size_or_zero("key_signals"), "recommendation_count": size_or_zero("recommendations")})


# --- drill-downs -------------------------------------------------------------------------------
def _shown(parents: DataFrame, key: str, ids: Column, n: int | None, children: DataFrame, child_key: str, fields: list[Column], name: str) -> DataFrame:
    """Per run and parent, an ordered array of the first n children; no row for a parent without any.

    Only the ids that are shown take part in the join; ids without a row are
    left out of the array.
    """
    shown = F.coalesce(ids, empty_strings())
    if n is not None:
        shown = F.slice(shown, 1, n)
    wanted = parents.select("run_id", key, F.posexplode(shown).alias("_at", "_cid"))
    kids = children.select(F.col("run_id").alias("_run"), F.col(child_key).alias("_kid"), F.struct(*fields).alias("_row"))
    hit = wanted.join(kids, (F.col("run_id") == F.col("_run")) & (F.col("_cid") == F.col("_kid")))
    return hit.groupBy("run_id", key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_row"))), lambda x: x["_row"]).alias(name)
    )


def _children(parents: DataFrame, key: str, *about) -> DataFrame:
    """Parent rows with an ordered array of their first n children."""
    return parents.join(_shown(parents, key, *about), ["run_id", key], "left")


def _first_of(rows: DataFrame, key: str, value: Column, most: int, name: str) -> DataFrame:
    """Per run and key, an ordered array of the first `most` values, and how many there are in all."""
    named = rows.select("run_id", key, value.alias("_v"))
    counts = named.groupBy("run_id", key).agg(F.count("*").alias(f"{name}_count"))
    top = top_n_per(named, ["run_id", key], ["_v"], most).groupBy("run_id", key).agg(F.array_sort(F.collect_list("_v")).alias(name))
    return top.join(counts, ["run_id", key])


def event_fields() -> list[Column]:
    return [
        F.col("event_id"), first_nonempty(F.col("canonical_title"), F.col("title"), F.col("event_id")).alias("canonical_title"),
        F.col("event_type"), F.col("subject"), F.coalesce("significance_score", F.lit(0.0)).alias("significance_score"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    ]


def _evidence_with_docs(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    docs = documents.select(
        F.col("run_id").alias("_r"), F.col("document_id").alias("_d"), F.col("title").alias("doc_title"),
        F.col("canonical_url").alias("doc_url"), F.col("source_id").alias("doc_source"),
    )
    return evidence.join(docs, (F.col("run_id") == F.col("_r")) & (F.col("doc_id") == F.col("_d")), "left").drop("_r", "_d")


def finding_detail(findings, trends, events, evidence, documents, recommendations, signals, most: int = 20) -> DataFrame:
    """Findings with trend, first 10 events, first 10 evidence rows, the first `most` recommendations and their count."""
    f = finding_summary(findings)
    t = trends.select("run_id", "trend_id", F.struct(*[F.col(c) for c in trends.columns if c not in ("run_id",)]).alias("related_trend"))
    # ids are read from the findings themselves: from joined rows every list would repeat the joins before it
    related_events = _shown(f, "finding_id", F.col("supporting_event_ids"), 10, events, "event_id", event_fields(), "related_events")
    ev = _evidence_with_docs(evidence, documents)
    related_evidence = _shown(
        f, "finding_id", F.col("supporting_evidence_ids"), 10, ev, "evidence_id",
        [
            F.col("evidence_id"), first_nonempty(F.col("source_id"), F.col("doc_source")).alias("source_id"),
            F.col("doc_title").alias("title"), F.col("doc_url").alias("canonical_url"),
            F.substring(F.coalesce("text", F.lit("")), 1, 240).alias("snippet"),
        ],
        "related_evidence",
    )
    lead = recommendations.join(signals.select("run_id", "signal_id", "finding_id"), ["run_id", "signal_id"])
    recs = _first_of(lead, "finding_id", F.struct("recommendation_id", "recommended_action", "priority"), most, "related_recommendations")
    out = f.join(t, ["run_id", "trend_id"], "left")
    for part in (related_events, related_evidence, recs):
        out = out.join(part, ["run_id", "finding_id"], "left")
    return out


def trend_detail(trends: DataFrame, events: DataFrame) -> DataFrame:
    """Trends with their first 20 events."""
    fields = event_fields() + [F.col("supporting_evidence_ids")]
    return _children(trend_summary(trends), "trend_id", F.col("event_ids"), 20, events, "event_id", fields, "related_events")


def event_detail(events: DataFrame, evidence: DataFrame, links: DataFrame, most: int = 20) -> DataFrame:
    """Events with their first `most` evidence rows; links stand in when the list is empty. `link_count` counts all links."""
    e = event_summary(events)
    fields = [F.col("evidence_id"), F.col("doc_id"), F.col("source_id"), F.col("text")]
    direct = _children(e.filter(F.col("evidence_count") > 0), "event_id", F.col("supporting_evidence_ids"), most, evidence, "evidence_id", fields, "evidence_items")
    bare = e.filter(F.col("evidence_count") == 0)
    linked = _first_of(links, "event_id", F.struct("link_id", "evidence_id"), most, "link")
    ids = F.transform("link", lambda x: x["evidence_id"])
    through = _children(bare.join(linked, ["run_id", "event_id"], "left"), "event_id", ids, most, evidence, "evidence_id", fields, "evidence_items").drop("link")
    counts = linked.select("run_id", "event_id", "link_count")
    both = direct.join(counts, ["run_id", "event_id"], "left").unionByName(through)
    return both.withColumn("link_count", F.coalesce("link_count", F.lit(0).cast("long")))


def evidence_detail(evidence: DataFrame, documents: DataFrame, links: DataFrame, events: DataFrame, most: int = 20) -> DataFrame:
    """Evidence with its document, the first `most` events that cite it and their count."""
    docs = documents.select(
        F.col("run_id").alias("_r"), F.col("document_id").alias("_d"), "title", "canonical_url", F.col("source_id").alias("_src"),
        F.col("origin_type"), F.col("body_text").alias("_body"),
    )
    ev = evidence.join(docs, (F.col("run_id") == F.col("_r")) & (F.col("doc_id") == F.col("_d")), "left")
    known = links.select("run_id", "evidence_id", "event_id").join(events.select("run_id", "event_id", F.struct(*event_fields()).alias("e")), ["run_id", "event_id"])
    cited = _first_of(known, "evidence_id", F.col("e"), most, "linked_events")
    return ev.join(cited, ["run_id", "evidence_id"], "left").select(
        "run_id", "evidence_id", F.coalesce("_d", "doc_id").alias("document_id"), first_nonempty(F.col("source_id"), F.col("_src")).alias("source_id"),
        "origin_type", "title", "canonical_url", first_nonempty(F.col("text"), F.col("_body")).alias("body_text"), "source_trace", "linked_events",
        F.coalesce("linked_events_count", F.lit(0).cast("long")).alias("linked_event_count"),
    )


def recommendation_detail(recs: DataFrame, signals: DataFrame, findings: DataFrame) -> DataFrame:
    """Recommendations with their lead signal and first 10 findings."""
    s = signals.select("run_id", "signal_id", F.struct("finding_id", "signal_type", "decision_relevance_score").alias("related_signal"))
    out = recommendation_summary(recs).join(s, ["run_id", "signal_id"], "left")
    fields = [F.col("finding_id"), F.col("finding_type"), F.col("title"), F.col("importance_score")]
    return _children(out, "recommendation_id", F.col("supporting_finding_ids"), 10, findings, "finding_id", fields, "related_findings")


def alert_list(alerts: DataFrame, findings: DataFrame) -> DataFrame:
    """Alerts with title, summary and importance of their finding."""
    f = findings.select(
        "run_id", "finding_id", F.col("title").alias("_t"), F.col("summary").alias("_s"), F.col("importance_score").alias("_i")
    )
    own = lambda c: F.col(c) if c in alerts.columns else F.lit(None).cast("string")
    return alerts.join(f, ["run_id", "finding_id"], "left").select(
        "run_id", "alert_id", "level", "finding_id", first_nonempty(F.col("_t"), own("title")).alias("title"),
        first_nonempty(F.col("_s"), own("summary")).alias("summary"), F.coalesce("_i", F.lit(0.0)).alias("importance_score"), "created_at",
    )


def watchlist_detail(watchlists: DataFrame, entities: DataFrame, topics: DataFrame) -> DataFrame:
    """Child tables when they have rows, else the arrays stored in the watchlist."""
    key = ["run_id", "watchlist_id"]
    ent = entities.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("canonical_name", "entity_type", F.coalesce("weight", F.lit(1.0)).alias("weight"), "aliases"))).alias("_e")
    )
    top = topics.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("topic_name", F.coalesce("weight", F.lit(1.0)).alias("weight"), "keywords"))).alias("_t")
    )
    joined = watchlists.join(ent, key, "left").join(top, key, "left")
    out = joined.withColumns({"entities": F.coalesce("_e", "entities"), "topics": F.coalesce("_t", "topics")}).drop("_e", "_t")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.withColumns({"entity_count": F.greatest(n("entities"), F.lit(0)), "topic_count": F.greatest(n("topics"), F.lit(0))})


def brief_detail(briefs: DataFrame, brief_id: str) -> DataFrame:
    """One brief with counts."""
    return brief_summary(briefs.filter(F.col("brief_id") == brief_id))


# --- J15 ------------------------------------------------------------------------------------------
def reference_check(documents, evidence, links, events, findings, signals) -> DataFrame:
    """Rows per foreign key that point nowhere."""

    def missing(name: str, child: DataFrame, child_key: Column, parent: DataFrame, parent_key: str) -> DataFrame:
        refs = child.select("run_id", child_key.alias("_k"))
        lost = refs.join(parent.select("run_id", F.col(parent_key).alias("_k")), ["run_id", "_k"], "left_anti")
        return one_row(child.sparkSession, n_refs=row_count(refs), n_missing=row_count(lost)).select(
            F.lit(name).alias("reference"), "n_refs", "n_missing"
        )

    return reduce(
        DataFrame.unionByName,
        [
            missing("evidence.document", evidence, F.col("doc_id"), documents, "document_id"),
            missing("link.event", links, F.col("event_id"), events, "event_id"),
            missing("link.evidence", links, F.col("evidence_id"), evidence, "evidence_id"),
            missing("finding.event", findings, F.explode("supporting_event_ids"), events, "event_id"),
            missing("signal.finding", signals, F.col("finding_id"), findings, "finding_id"),
        ],
    )


# --- A6, A7, W11, W12 ---------------------------------------------------------------------------------
def layer_counts(**tables: DataFrame) -> DataFrame:
    """Rows per run and table, a column each."""
    parts = [df.groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit(name).alias("layer"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("run_id").pivot("layer", list(tables)).agg(F.sum("n")).na.fill(0)


def run_list(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Runs with their counts; order by started_at for the newest first."""
    joined = runs.join(counts, "run_id", "left")
    return joined.na.fill(0, [c for c in counts.columns if c != "run_id"])


def latest_run(runs: DataFrame) -> DataFrame:
    """W11."""
    return runs.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def dashboard(runs, counts, trends, findings, recommendations, alerts, briefs, run_id: str | None = None) -> dict[str, DataFrame]:
    """Counts and top lists of one run, the latest if none is named."""
    chosen = latest_run(runs) if run_id is None else runs.filter(F.col("run_id") == run_id).select("run_id")
    of_run = lambda df: df.join(F.broadcast(chosen), "run_id", "left_semi")  # noqa: E731 - one row
    return {
        "counts": of_run(counts), "latest_run": of_run(run_list(runs, counts)),
        "top_trends": page(of_run(trend_summary(trends)), order_for("trends"), 1, 5),
        "top_findings": page(of_run(finding_summary(findings)), order_for("findings"), 1, 5),
        "top_recommendations": page(of_run(recommendation_summary(recommendations)), order_for("recommendations"), 1, 5),
        "recent_alerts": page(of_run(alert_list(alerts, findings)), order_for("alerts"), 1, 5),
        "latest_briefs": page(of_run(brief_summary(briefs)), order_for("briefs"), 1, 3),
    }
