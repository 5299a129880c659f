"""The five-layer run: stored, read back, and traced from signal to document."""

from pyspark.sql import functions as F

from glimmerline.catalog.stories import raw_records
from glimmerline.plans import reads
from glimmerline.plans.run import order_batches, run_layers, store_run
from glimmerline.sources.store import current_runs, fresh_root, read_layer


def test_run_is_stored_and_traceable(spark, data):
    raw = raw_records(spark, data).drop("pos").limit(60).withColumn("channel_note", F.lit("x"))
    batches = order_batches(official=raw.filter("external_id < '3'"), social=raw.filter("external_id >= '3'"))
    layers = run_layers(batches)
    root = fresh_root(spark)
    events = store_run(layers, root, "run-1", F.lit("2026-01-01").cast("timestamp"))
    store_run(layers, root, "run-1", F.lit("2026-01-02").cast("timestamp"))  # saving again replaces the run
    assert current_runs(events).first()["status"] == "completed"

    stored = {t: read_layer(spark, root, t) for t in ("documents", "evidence_items", "events", "event_evidence_links", "trend_signals",
                                                      "intelligence_findings", "decision_signals", "recommendation_items", "decision_briefs")}
    assert stored["documents"].count() == 60 and stored["events"].count() == 60
    assert stored["trend_signals"].count() == stored["intelligence_findings"].count() == stored["decision_signals"].count()
    assert stored["decision_briefs"].count() == 3
    check = reads.reference_check(
        stored["documents"], stored["evidence_items"], stored["event_evidence_links"], stored["events"], stored["intelligence_findings"], stored["decision_signals"]
    ).collect()
    assert all(r["n_missing"] == 0 for r in check) and {r["n_refs"] for r in check if r["reference"].startswith("link")} == {60}


def test_ids_do_not_change_between_runs(spark, data):
    raw = raw_records(spark, data).limit(40)
    a, b = ({r["finding_id"] for r in run_layers(raw)["intelligence_findings"].collect()} for _ in range(2))
    assert a == b
