"""Queries over stored layers, health and streams.

Layers are written from the star tables: a finding per order, an event, a
piece of evidence and a document per line, a recommendation per customer, and
a run per remainder of the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dedup import keep_first
from ..operators.health import discovery_report, document_health, run_stats, source_health
from ..operators.ordering import page, page_info, sequential_ids, top_n, top_n_per
from ..plans import reads
from ..session import scratch_path
from ..sources.store import (
    append_attempts, compact_table, current_runs, document_rows, layer_rows, read_layer, read_table, save_layer, upsert, upsert_table, widen,
)
from ..streaming.intake import append_new, health_each, read_landing, read_new, upsert_each
from .base import big, joined, query, table, text_of

RUNS = 5


def s(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def star_layers(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored layers, without their JSON columns."""
    o = table(spark, folder, "orders")
    # of lines that share order and number the first one in the table counts, the same one in every layer
    at_row = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    line = keep_first(
        table(spark, folder, "lineitem").select("*", *at_row).join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi"),
        ["l_orderkey", "l_linenumber"], ["_file", "_row"],
    )
    ok = F.col("o_orderkey").cast("string")
    lid = F.concat_ws("_", "l_orderkey", "l_linenumber")
    run, line_run = (s("run", (F.col(c) % RUNS).cast("string")) for c in ("o_orderkey", "l_orderkey"))
    at = F.lit("2024-05-01").cast("timestamp")
    rows = line.select(
        line_run.alias("run_id"), lid.alias("lid"), "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_partkey", at.alias("created_at"), "l_returnflag"
    )
    events = rows.select(
        "run_id", s("evt_", F.col("lid")).alias("event_id"), s("Line ", F.col("lid")).alias("title"), F.lit(None).cast("string").alias("canonical_title"),
        F.when(F.col("l_returnflag") == "R", "risk_event").otherwise("story_event").alias("event_type"), s("S", F.col("l_suppkey").cast("string")).alias("subject"),
        (F.col("l_quantity") / 100).alias("significance_score"), F.lit(None).cast("double").alias("confidence"),
        F.when(F.col("l_linenumber") % 3 == 0, F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.array(s("evi_", F.col("lid")))).alias("supporting_evidence_ids"), "created_at",
    )
    evidence = rows.select(
        "run_id", s("evi_", F.col("lid")).alias("evidence_id"), s("doc_", F.col("lid")).alias("doc_id"), F.when(F.col("l_linenumber") != 1, s("src", F.col("l_suppkey").cast("string"))).alias("source_id"),
        s("Text of ", F.col("lid")).alias("text"), F.lit("{}").alias("source_trace"), "created_at",
    )
    documents = rows.filter("l_linenumber <> 2").select(
        "run_id", s("doc_", F.col("lid")).alias("document_id"), s("Part ", F.col("l_partkey").cast("string")).alias("title"), s("https://p.example/", F.col("l_partkey").cast("string")).alias("canonical_url"),
        F.lit("docs").alias("source_id"), F.lit("unknown").alias("origin_type"), F.lit("body").alias("body_text"), "created_at",
    )
    links = rows.select("run_id", s("link_", F.col("lid")).alias("link_id"), s("evt_", F.col("lid")).alias("event_id"), s("evi_", F.col("lid")).alias("evidence_id"), F.lit(0.7).alias("support_strength"), "created_at")
    ids = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "lid"))).alias("m")).select(
        F.col("l_orderkey").alias("o_orderkey"), F.transform("m", lambda x: s("evt_", x["lid"])).alias("ev"), F.transform("m", lambda x: s("evi_", x["lid"])).alias("evi")
    )
    kinds = ("risk_signal", "opportunity_signal", "competition_signal", "adoption_signal", "narrative_shift", "momentum_signal")
    base = o.join(ids, "o_orderkey", "left").withColumns({"run_id": run, "created_at": at})
    findings = base.select(
        "run_id", s("fd_", ok).alias("finding_id"), s("tr_", ok).alias("trend_id"), F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % 6).cast("int")).alias("finding_type"),
        s("Finding ", ok).alias("title"), F.lit("").alias("display_title"), s("About ", ok).alias("summary"), F.col("o_orderpriority").alias("subject"), F.col("o_orderpriority").alias("theme"),
        F.round(F.col("o_totalprice") / 500000, 8).alias("importance_score"), (F.col("o_orderkey") % 100 / 100.0).alias("decision_relevance_score"),
        F.col("ev").alias("supporting_event_ids"), F.col("evi").alias("supporting_evidence_ids"), "created_at",
    )
    trends = base.select(
        "run_id", s("tr_", ok).alias("trend_id"), s("Trend ", ok).alias("title"), F.lit(None).cast("string").alias("display_title"), F.col("o_orderpriority").alias("theme"), F.col("o_orderpriority").alias("subject"),
        F.lit("risk_cluster").alias("trend_type"), F.round(F.col("o_totalprice") / 500000, 8).alias("strength_score"), F.lit(0.5).alias("novelty_score"), F.lit(0.4).alias("corroboration_score"),
        F.col("ev").alias("event_ids"), F.col("evi").alias("supporting_evidence_ids"), F.col("evi").alias("supporting_document_ids"), "created_at",
    )
    signals = base.select(
        "run_id", s("ds_", ok).alias("signal_id"), s("fd_", ok).alias("finding_id"), F.lit("risk").alias("signal_type"), (F.col("o_orderkey") % 100 / 100.0).alias("decision_relevance_score"), "created_at"
    )
    recs = o.groupBy(run.alias("run_id"), "o_custkey").agg(
        F.min("o_orderkey").alias("k"), F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: s("fd_", x.cast("string"))).alias("supporting_finding_ids"), F.max("o_totalprice").alias("top")
    ).select(
        "run_id", s("rec_", F.col("run_id"), "_", F.col("o_custkey").cast("string")).alias("recommendation_id"), s("ds_", F.col("k").cast("string")).alias("signal_id"), F.lit("increase_monitoring").alias("recommended_action"),
        F.round(F.col("top") / 500000, 8).alias("priority"), "supporting_finding_ids", F.expr("CAST(array() AS ARRAY<STRING>)").alias("supporting_event_ids"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("supporting_evidence_ids"), at.alias("created_at"),
    )
    alerts = base.filter("o_totalprice > 200000").select(
        "run_id", s("al_", ok).alias("alert_id"), F.when(F.col("o_orderkey") % 2 == 0, s("fd_", ok)).otherwise("fd_gone").alias("finding_id"), F.lit("medium").alias("level"), s("Alert ", ok).alias("title"), F.lit(None).cast("string").alias("summary"), "created_at"
    )
    briefs = o.groupBy(run.alias("run_id")).agg(F.count("*").alias("n")).select(
        "run_id", s("dbrief_", F.col("run_id")).alias("brief_id"), F.lit("watch_brief").alias("brief_type"), F.lit("Watch").alias("title"), F.array(F.lit("ds_1"), F.lit("ds_2")).alias("key_signals"), F.array(F.lit("rec_1")).alias("recommendations"), at.alias("created_at")
    )
    runs = o.groupBy(run.alias("run_id")).agg(F.min("o_orderdate").cast("timestamp").alias("started_at"))
    return {"events": events, "evidence": evidence, "documents": documents, "links": links, "findings": findings, "trends": trends, "signals": signals,
            "recommendations": recs, "alerts": alerts, "briefs": briefs, "runs": runs}


_L = """
l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) *, l_orderkey || '_' || l_linenumber AS lid, 'run' || (l_orderkey % 5) AS run_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
o AS (SELECT *, 'run' || (o_orderkey % 5) AS run_id FROM orders)
"""


@query(
    "finding_page",
    f"""
    WITH {_L}, f AS (SELECT 'fd_' || o_orderkey AS finding_id, round(o_totalprice / 500000, 8) AS importance_score FROM o WHERE run_id = 'run1' AND o_totalprice / 500000 >= 0.2 AND o_orderkey % 100 / 100.0 >= 0.3)
    SELECT finding_id, importance_score, (SELECT count(*) FROM f) AS total, (SELECT greatest(1, ceil(count(*) / 20))::BIGINT FROM f) AS total_pages FROM f ORDER BY importance_score DESC, finding_id LIMIT 20 OFFSET 20
    """,
)
def finding_page(spark, folder):
    rows, info = reads.list_page(star_layers(spark, folder)["findings"], "findings", "importance", 2, 20, run_id="run1", min_importance=0.2, min_decision_relevance=0.3)
    return rows.select("finding_id", "importance_score", info.select("total").scalar().alias("total"), info.select("total_pages").scalar().alias("total_pages"))


@query(
    "finding_details",
    f"""
    WITH {_L}, e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM l),
    d AS (SELECT l_orderkey, string_agg('Line ' || lid, '|' ORDER BY n) AS events, string_agg(CASE WHEN l_linenumber <> 1 THEN 'src' || l_suppkey WHEN l_linenumber <> 2 THEN 'docs' END || ':' || CASE WHEN l_linenumber <> 2 THEN 'Part ' || l_partkey ELSE '-' END, '|' ORDER BY n) AS evidence FROM e WHERE n <= 10 GROUP BY 1),
    r AS (SELECT run_id, o_custkey, min(o_orderkey) AS k FROM o GROUP BY ALL)
    SELECT 'fd_' || o_orderkey AS finding_id, 'Finding ' || o_orderkey AS title, 'Trend ' || o_orderkey AS trend, coalesce(events, '') AS events, coalesce(evidence, '') AS evidence,
      coalesce((SELECT 'rec_' || r.run_id || '_' || r.o_custkey FROM r WHERE r.k = o.o_orderkey), '') AS recommendations, (SELECT count(*) FROM r WHERE r.k = o.o_orderkey) AS recommendation_count, (SELECT count(*) FROM l WHERE l.l_orderkey = o.o_orderkey) AS event_count FROM o LEFT JOIN d ON l_orderkey = o_orderkey
    """,
)
def finding_details(spark, folder):
    x = star_layers(spark, folder)
    d = reads.finding_detail(x["findings"], x["trends"], x["events"], x["evidence"], x["documents"], x["recommendations"], x["signals"])
    empty = F.lit("")
    return d.select(
        "finding_id", "title", F.col("related_trend.title").alias("trend"), F.coalesce(joined(F.col("related_events.canonical_title")), empty).alias("events"),
        F.coalesce(joined(F.transform("related_evidence", lambda e: s(e["source_id"], ":", F.coalesce(e["title"], F.lit("-"))))), empty).alias("evidence"),
        F.coalesce(joined(F.col("related_recommendations.recommendation_id")), empty).alias("recommendations"),
        F.coalesce("related_recommendations_count", F.lit(0).cast("long")).alias("recommendation_count"), big(F.col("event_count")).alias("event_count"),
    )


@query(
    "trend_details",
    f"""
    WITH {_L} SELECT 'tr_' || o_orderkey AS trend_id, 'Trend ' || o_orderkey AS title,
      coalesce((SELECT string_agg('evt_' || lid, '|' ORDER BY l_linenumber) FROM l WHERE l_orderkey = o_orderkey), '') AS events FROM o
    """,
)
def trend_details(spark, folder):
    x = star_layers(spark, folder)
    return reads.trend_detail(x["trends"], x["events"]).select("trend_id", "title", F.coalesce(joined(F.col("related_events.event_id")), F.lit("")).alias("events"))


@query("event_details", f"WITH {_L} SELECT 'evt_' || lid AS event_id, 'Line ' || lid AS canonical_title, 'evi_' || lid AS evidence, (l_linenumber % 3 <> 0)::BIGINT AS evidence_count, 1::BIGINT AS link_count FROM l")
def event_details(spark, folder):
    x = star_layers(spark, folder)
    return reads.event_detail(x["events"], x["evidence"], x["links"]).select(
        "event_id", "canonical_title", joined(F.col("evidence_items.evidence_id")).alias("evidence"), big(F.col("evidence_count")).alias("evidence_count"), "link_count"
    )


@query(
    "evidence_details",
    f"""
    WITH {_L} SELECT 'evi_' || lid AS evidence_id, 'doc_' || lid AS document_id, CASE WHEN l_linenumber <> 1 THEN 'src' || l_suppkey ELSE 'docs' END AS source_id,
      CASE WHEN l_linenumber <> 2 THEN 'Part ' || l_partkey END AS title, 'Text of ' || lid AS body_text, 'evt_' || lid AS events, 1::BIGINT AS event_count FROM l
    """,
)
def evidence_details(spark, folder):
    x = star_layers(spark, folder)
    return reads.evidence_detail(x["evidence"], x["documents"], x["links"], x["events"]).select(
        "evidence_id", "document_id", "source_id", "title", "body_text", joined(F.col("linked_events.event_id")).alias("events"), F.col("linked_event_count").alias("event_count")
    )


@query(
    "recommendation_details",
    f"""
    WITH {_L}, r AS (SELECT run_id, o_custkey, o_orderkey, row_number() OVER (PARTITION BY run_id, o_custkey ORDER BY o_orderkey) AS n FROM o)
    SELECT 'rec_' || run_id || '_' || o_custkey AS recommendation_id, 'fd_' || min(o_orderkey) AS lead, count(*) AS finding_count, string_agg('Finding ' || o_orderkey, '|' ORDER BY n) FILTER (n <= 10) AS findings FROM r GROUP BY run_id, o_custkey
    """,
)
def recommendation_details(spark, folder):
    x = star_layers(spark, folder)
    return reads.recommendation_detail(x["recommendations"], x["signals"], x["findings"]).select(
        "recommendation_id", F.col("related_signal.finding_id").alias("lead"), big(F.col("finding_count")).alias("finding_count"), joined(F.col("related_findings.title")).alias("findings")
    )


@query(
    "alert_list",
    f"""
    WITH {_L} SELECT 'al_' || o_orderkey AS alert_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Finding ' || o_orderkey ELSE 'Alert ' || o_orderkey END AS title,
      CASE WHEN o_orderkey % 2 = 0 THEN 'About ' || o_orderkey END AS summary, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice / 500000, 8) ELSE 0 END AS importance_score FROM o WHERE o_totalprice > 200000
    """,
)
def alert_list(spark, folder):
    x = star_layers(spark, folder)
    return reads.alert_list(x["alerts"], x["findings"]).select("alert_id", "title", "summary", "importance_score")


@query(
    "watchlist_details",
    """
    SELECT 'w' || n_nationkey AS watchlist_id, CASE WHEN n_nationkey % 2 = 0 THEN coalesce((SELECT string_agg(s_name, '|' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), n_name) ELSE n_name END AS entities,
      CASE WHEN n_nationkey % 2 = 0 THEN greatest(1, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)) ELSE 1 END AS entity_count, 'embedded' AS topics, 1::BIGINT AS topic_count FROM nation
    """,
)
def watchlist_details(spark, folder):
    key = F.col("n_nationkey").cast("string")
    w = table(spark, folder, "nation").select(
        F.lit("run0").alias("run_id"), s("w", key).alias("watchlist_id"),
        F.array(F.struct(F.col("n_name").alias("canonical_name"), F.lit(None).cast("string").alias("entity_type"), F.lit(1.0).alias("weight"), F.array().cast("array<string>").alias("aliases"))).alias("entities"),
        F.array(F.struct(F.lit("embedded").alias("topic_name"), F.lit(1.0).alias("weight"), F.array().cast("array<string>").alias("keywords"))).alias("topics"),
    )
    ent = table(spark, folder, "supplier").filter("s_nationkey % 2 = 0").select(
        F.lit("run0").alias("run_id"), s("w", F.col("s_nationkey").cast("string")).alias("watchlist_id"), F.col("s_name").alias("canonical_name"), F.lit(None).cast("string").alias("entity_type"),
        F.lit(None).cast("double").alias("weight"), F.array().cast("array<string>").alias("aliases"),
    )
    top = ent.limit(0).select("run_id", "watchlist_id", F.lit("t").alias("topic_name"), "weight", F.col("aliases").alias("keywords"))
    return reads.watchlist_detail(w, ent, top).select(
        "watchlist_id", joined(F.col("entities.canonical_name")).alias("entities"), big(F.col("entity_count")).alias("entity_count"), joined(F.col("topics.topic_name")).alias("topics"), big(F.col("topic_count")).alias("topic_count")
    )


@query("brief_details", f"WITH {_L} SELECT DISTINCT 'dbrief_' || run_id AS brief_id, 'Watch' AS title, 2::BIGINT AS signal_count, 1::BIGINT AS recommendation_count FROM o WHERE run_id = 'run2'")
def brief_details(spark, folder):
    return reads.brief_detail(star_layers(spark, folder)["briefs"], "dbrief_run2").select("brief_id", "title", big(F.col("signal_count")).alias("signal_count"), big(F.col("recommendation_count")).alias("recommendation_count"))


@query(
    "reference_check",
    f"""
    WITH {_L}, n AS (SELECT count(*) AS c, count(*) FILTER (l_linenumber = 2) AS m FROM l)
    SELECT 'evidence.document' AS reference, c AS n_refs, m AS n_missing FROM n UNION ALL SELECT 'link.event', c, 0 FROM n UNION ALL SELECT 'link.evidence', c, 0 FROM n
    UNION ALL SELECT 'finding.event', c, 0 FROM n UNION ALL SELECT 'signal.finding', (SELECT count(*) FROM o), 0
    """,
)
def reference_check(spark, folder):
    x = star_layers(spark, folder)
    return reads.reference_check(x["documents"], x["evidence"], x["links"], x["events"], x["findings"], x["signals"])


_COUNT_SQL = f"""
{_L}, c AS (SELECT run_id, count(*) AS n_lines, count(*) FILTER (l_linenumber <> 2) AS n_docs FROM l GROUP BY 1),
k AS (SELECT run_id, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_cust, count(*) FILTER (o_totalprice > 200000) AS n_alerts, min(o_orderdate) AS started FROM o GROUP BY 1)
"""


def _counts(x: dict[str, DataFrame]) -> DataFrame:
    return reads.layer_counts(
        documents=x["documents"], evidence=x["evidence"], events=x["events"], trends=x["trends"], findings=x["findings"],
        recommendations=x["recommendations"], briefs=x["briefs"], alerts=x["alerts"],
    )


@query(
    "overview_counts",
    f"WITH {_COUNT_SQL} SELECT run_id, n_docs AS documents, n_lines AS evidence, n_lines AS events, n_orders AS trends, n_orders AS findings, n_cust AS recommendations, 1::BIGINT AS briefs, n_alerts AS alerts FROM k JOIN c USING (run_id)",
)
def overview_counts(spark, folder):
    return _counts(star_layers(spark, folder))


@query(
    "run_list",
    f"WITH {_COUNT_SQL} SELECT run_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, n_docs AS documents, n_lines AS events, n_orders AS findings, run_id = (SELECT arg_max(run_id, (started, run_id)) FROM k) AS latest FROM k JOIN c USING (run_id)",
)
def run_list(spark, folder):
    x = star_layers(spark, folder)
    latest = reads.latest_run(x["runs"]).withColumn("latest", F.lit(True))
    return reads.run_list(x["runs"], _counts(x)).join(latest, "run_id", "left").select(
        "run_id", text_of(F.col("started_at")).alias("started"), "documents", "events", "findings", F.coalesce("latest", F.lit(False)).alias("latest")
    )


@query(
    "dashboard",
    f"""
    WITH {_COUNT_SQL}, r AS (SELECT arg_max(run_id, (started, run_id)) AS run_id FROM k),
    t AS (SELECT 'tr_' || o_orderkey AS id, round(o_totalprice / 500000, 8) AS score FROM o JOIN r USING (run_id) ORDER BY score DESC, id LIMIT 5),
    f AS (SELECT 'fd_' || o_orderkey AS id, round(o_totalprice / 500000, 8) AS score FROM o JOIN r USING (run_id) ORDER BY score DESC, id LIMIT 5),
    rc AS (SELECT 'rec_' || run_id || '_' || o_custkey AS id, round(max(o_totalprice) / 500000, 8) AS score FROM o JOIN r USING (run_id) GROUP BY run_id, o_custkey ORDER BY score DESC, id LIMIT 5),
    a AS (SELECT 'al_' || o_orderkey AS id FROM o JOIN r USING (run_id) WHERE o_totalprice > 200000 ORDER BY id LIMIT 5)
    SELECT 'trend' AS kind, id FROM t UNION ALL SELECT 'finding', id FROM f UNION ALL SELECT 'recommendation', id FROM rc UNION ALL SELECT 'alert', id FROM a UNION ALL SELECT 'brief', 'dbrief_' || run_id FROM r
    """,
)
def dashboard(spark, folder):
    x = star_layers(spark, folder)
    d = reads.dashboard(x["runs"], _counts(x), x["trends"], x["findings"], x["recommendations"], x["alerts"], x["briefs"])
    pick = lambda name, kind, key: d[name].select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    out = pick("top_trends", "trend", "trend_id").unionByName(pick("top_findings", "finding", "finding_id"))
    out = out.unionByName(pick("top_recommendations", "recommendation", "recommendation_id")).unionByName(pick("recent_alerts", "alert", "alert_id"))
    return out.unionByName(pick("latest_briefs", "brief", "brief_id"))


# --- ranking shapes -------------------------------------------------------------------------------
@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, folder):
    return top_n(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query("capped_per_source", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 3")
def capped_per_source(spark, folder):
    return top_n_per(table(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("sequential_ids", "SELECT event_id, 'evt_' || row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def sequential_ids_query(spark, folder):
    e = table(spark, folder, "events").select("event_id", "ts")
    return sequential_ids(e, ["ts", "event_id"], "evt_", "id").select("event_id", "id")


@query("customer_page", "SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS total, (SELECT ceil(count(*) / 50)::BIGINT FROM customer) AS total_pages FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 50")
def customer_page(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    info = page_info(c, 50)
    rows = page(c, [F.desc("c_acctbal"), F.col("c_custkey")], 2, 50)
    return rows.select("*", info.select("total").scalar().alias("total"), info.select("total_pages").scalar().alias("total_pages"))


# --- stores -------------------------------------------------------------------------------------------
@query(
    "stored_documents",
    "SELECT 'run' || (doc_id % 3) AS run_id, doc_id::VARCHAR AS document_id, sha256(text) AS content_hash, length(substring(text, 1, 500)) AS preview FROM documents",
)
def stored_documents(spark, folder):
    """Two saves of the same rows, read back."""
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("body_text"), F.sha2("text", 256).alias("fingerprint"), F.col("doc_id").alias("pos"))
    root = scratch_path(spark, "layers")
    rows = layer_rows(document_rows(d), s("run", (F.col("pos") % 3).cast("string")), F.lit("2024-01-01").cast("timestamp"), "document_id", ["pos"])
    save_layer(rows.filter("run_id = 'run0'").withColumn("body_preview", F.lit("old")), root, "documents")
    save_layer(rows, root, "documents")
    return read_layer(spark, root, "documents").select("run_id", "document_id", "content_hash", big(F.length("body_preview")).alias("preview"))


@query("upserted_orders", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def upserted_orders(spark, folder):
    """Two waves of rows into one versioned table."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    path = scratch_path(spark, "upsert")
    upsert_table(spark, path, o.filter("o_orderkey % 2 = 0"), "o_custkey", "o_orderkey")
    upsert_table(spark, path, o.filter("o_orderkey % 2 = 1"), "o_custkey", "o_orderkey")
    compact_table(spark, path, "o_custkey", "o_orderkey")
    return read_table(spark, path, "o_custkey", "o_orderkey")


@query("widened_rows", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS s_name FROM supplier")
def widened_rows(spark, folder):
    x = table(spark, folder, "supplier")
    return widen(x.filter("s_suppkey % 2 = 1").select("s_suppkey"), x.filter("s_suppkey % 2 = 0").select("s_suppkey", "s_name"))


@query("merged_rows", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM customer")
def merged_rows(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey")
    old, new = c.withColumns({"state": F.lit("old"), "v": F.lit(1)}), c.filter("c_custkey % 2 = 0").withColumns({"state": F.lit("new"), "v": F.lit(2)})
    return upsert(old, new, "c_custkey", "v").drop("v")


@query("attempt_log", "SELECT user_id::VARCHAR AS source_id, event_type AS block_type, (event_type = 'error')::INT::BIGINT AS retryable, count(*) AS n FROM events GROUP BY ALL")
def attempt_log(spark, folder):
    """Attempts appended in two saves."""
    e = table(spark, folder, "events").select(
        "event_id", F.col("user_id").cast("string").alias("source_id"), F.lit("u").alias("url"), F.lit(200).alias("status_code"), F.col("event_type").alias("block_type"), F.lit("direct_html").alias("fetch_mode"),
        (F.col("event_type") == "error").alias("retryable"), F.lit(None).cast("string").alias("error"),
    )
    path, now = scratch_path(spark, "attempts"), F.lit("2024-01-01").cast("timestamp")
    append_attempts(e.filter("event_id % 2 = 0"), path, now)
    append_attempts(e.filter("event_id % 2 = 1"), path, now)
    return spark.read.parquet(path).groupBy("source_id", "block_type", big(F.col("retryable")).alias("retryable")).agg(F.count("*").alias("n"))


@query(
    "run_states",
    """
    SELECT 'r' || o_custkey AS run_id, CASE WHEN count(*) > 5 THEN 'completed' ELSE 'running' END AS status, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS started,
      CASE WHEN count(*) > 5 THEN strftime(max(o_orderdate) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END AS finished FROM orders GROUP BY o_custkey
    """,
)
def run_states(spark, folder):
    g = table(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp").alias("a"), F.max("o_orderdate").cast("timestamp").alias("b"), F.count("*").alias("n"))
    run = s("r", F.col("o_custkey").cast("string")).alias("run_id")
    tail = [F.lit("{}").alias("metadata_json"), F.lit(None).cast("string").alias("topic_query")]
    start = g.select(run, F.lit("running").alias("status"), F.col("a").alias("at"), *tail)
    done = g.filter("n > 5").select(run, F.lit("completed").alias("status"), (F.col("b") + F.expr("INTERVAL 1 DAY")).alias("at"), *tail)
    return current_runs(start.unionByName(done)).select("run_id", "status", text_of(F.col("started_at")).alias("started"), text_of(F.col("finished_at")).alias("finished"))


# --- health and streams ---------------------------------------------------------------------------------
def fetch_log(events: DataFrame) -> DataFrame:
    """Events as fetch results: an error is a failure whose kind depends on the value."""
    k = F.get_json_object("props", "$.k").cast("int") % 4
    bad = F.col("event_type") == "error"
    block = F.when(~bad, "success").when(k == 0, "cloudflare_challenge").when(k == 1, "rate_limited").otherwise("network_error")
    return events.select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("pos"), block.alias("block_type"), (~bad).alias("success"))


_HEALTH_SQL = """
WITH e AS (SELECT *, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN 'success' ELSE ['cloudflare_challenge', 'rate_limited', 'network_error', 'network_error'][json_extract_string(props, '$.k')::INT % 4 + 1] END AS b FROM events),
g AS (SELECT user_id, count(*) AS n, count(*) FILTER (ok) AS good, count(*) FILTER (b = 'cloudflare_challenge') AS guarded, arg_max(b, event_id) AS last_b, arg_max(b, event_id) FILTER (NOT ok) AS last_bad, max(event_id) FILTER (NOT ok) AS bad_at,
  min(event_id) FILTER (b = 'cloudflare_challenge') AS first_c,
  list_reduce(list_prepend(0, list(CASE b WHEN 'success' THEN 0 WHEN 'cloudflare_challenge' THEN 6 WHEN 'rate_limited' THEN 2 ELSE -1 END ORDER BY ts, event_id)), lambda x, y: CASE WHEN y > 0 THEN least(20, x + y) ELSE greatest(0, x + y) END) AS score FROM e GROUP BY 1)
SELECT user_id::VARCHAR AS source_id, n AS total_attempts, good AS total_successes, guarded AS protected_events, round(score / 20.0, 6)::DOUBLE AS anti_bot_score,
  CASE WHEN first_c IS NOT NULL THEN 'metadata_only' ELSE 'listing_only' END AS preferred_mode,
  CASE WHEN last_bad = 'cloudflare_challenge' THEN 'metadata_only' WHEN last_bad = 'rate_limited' THEN 'listing_only' WHEN last_bad IS NOT NULL AND first_c < bad_at THEN 'metadata_only' ELSE 'listing_only' END AS recommended_mode,
  CASE WHEN last_b <> 'success' THEN last_b END AS failure_reason FROM g
"""
_HEALTH_COLUMNS = ("source_id", "total_attempts", "total_successes", "protected_events", "anti_bot_score", "preferred_mode", "recommended_mode", "failure_reason")


@query("source_health", _HEALTH_SQL)
def source_health_query(spark, folder):
    return source_health(fetch_log(table(spark, folder, "events"))).withColumn("anti_bot_score", F.round("anti_bot_score", 6)).select(*_HEALTH_COLUMNS)


@query("carried_health", _HEALTH_SQL)
def carried_health(spark, folder):
    """A9 in two runs: the second starts from the stored rows of the first."""
    log = fetch_log(table(spark, folder, "events"))
    cut = F.lit("2024-01-16").cast("timestamp")
    path = scratch_path(spark, "health")
    source_health(log.filter(F.col("ts") < cut)).write.parquet(path)
    second = source_health(log.filter(F.col("ts") >= cut), spark.read.parquet(path))
    return second.withColumn("anti_bot_score", F.round("anti_bot_score", 6)).select(*_HEALTH_COLUMNS)


@query(
    "document_health",
    """
    SELECT source AS source_id, count(*) AS documents_ingested, count(*) FILTER (doc_id % 2 = 0) AS detail_fetch_attempts, count(*) FILTER (doc_id % 4 = 0) AS detail_fetch_successes,
      round(CASE WHEN count(*) FILTER (doc_id % 2 = 0) > 0 THEN count(*) FILTER (doc_id % 4 = 0) / count(*) FILTER (doc_id % 2 = 0) ELSE 0 END, 6) AS detail_success_rate, round(count(*) FILTER (doc_id % 3 = 0) / count(*), 6) AS metadata_fallback_rate FROM documents GROUP BY 1
    """,
)
def document_health_query(spark, folder):
    k = F.col("doc_id")
    d = table(spark, folder, "documents").select(
        F.col("source").alias("source_id"), (k % 2 == 0).alias("detail_fetch_attempt"), (k % 4 == 0).alias("detail_extract_success"), (k % 3 == 0).alias("metadata_fallback")
    )
    return document_health(d).select(
        "source_id", "documents_ingested", "detail_fetch_attempts", "detail_fetch_successes", F.round("detail_success_rate", 6).alias("detail_success_rate"), F.round("metadata_fallback_rate", 6).alias("metadata_fallback_rate")
    )


@query(
    "attempt_report",
    "SELECT user_id::VARCHAR AS source_id, grouping(user_id) = 1 AS of_all, count(*) AS attempted, count(*) FILTER (event_type NOT IN ('error', 'view')) AS succeeded, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ROLLUP (user_id)",
)
def attempt_report(spark, folder):
    e = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("source_id"), F.when(F.col("event_type") == "view", 0).otherwise(3).alias("found"), F.when(F.col("event_type") == "error", F.lit("boom")).alias("error")
    )
    return discovery_report(e)


@query("stage_counts", "SELECT (SELECT count(*) FROM pages) AS discovered, (SELECT count(*) FROM documents) AS normalized, (SELECT count(DISTINCT text) FROM documents) AS deduped")
def stage_counts(spark, folder):
    d = table(spark, folder, "documents")
    return run_stats(discovered=table(spark, folder, "pages"), normalized=d, deduped=d.select("text").distinct())


_EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _event_stream(spark, folder) -> DataFrame:
    return read_landing(spark, folder, _EVENT_SCHEMA, "events.parquet")


@query("stream_first_keys", "SELECT DISTINCT user_id || ':' || event_type AS idempotency_key FROM events")
def stream_first_keys(spark, folder):
    """New keys of the landing folder, each once, over two polls."""
    key = s(F.col("user_id").cast("string"), ":", F.col("event_type"))
    stream = _event_stream(spark, folder).select(key.alias("idempotency_key"), F.col("ts").cast("timestamp").alias("fetched_at"))
    out, checkpoint = scratch_path(spark, "keys"), scratch_path(spark, "keys-cp")
    for _ in range(2):  # the second poll finds nothing new
        append_new(stream, out, checkpoint).awaitTermination()
    return read_new(spark, out, "idempotency_key string, fetched_at timestamp").select("idempotency_key")


@query("stream_health", _HEALTH_SQL)
def stream_health(spark, folder):
    """Health carried over the micro-batches."""
    path = scratch_path(spark, "stream-health")
    health_each(fetch_log(_event_stream(spark, folder)), path, path + "-cp").awaitTermination()
    return read_table(spark, path, "source_id", "total_attempts").withColumn("anti_bot_score", F.round("anti_bot_score", 6)).select(*_HEALTH_COLUMNS)


@query("stream_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark, folder):
    """T4: the last row per key, upserted from a stream."""
    path = scratch_path(spark, "stream-upsert")
    upsert_each(_event_stream(spark, folder).select("user_id", "event_id"), path, path + "-cp", "user_id", "event_id").awaitTermination()
    return read_table(spark, path, "user_id", "event_id")
