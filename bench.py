"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
cores of the local session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glimmerline.catalog import QUERIES  # noqa: E402
from glimmerline.session import build_session  # noqa: E402

HEADLINE = [
    "url_canonical", "page_text", "page_classes", "page_items", "fulltext_documents", "document_tokens", "token_overlap",
    "evidence_rows", "event_profiles", "document_dedup", "copy_components", "top_findings", "trend_scoring", "finding_routing",
    "alert_ranking", "recommendations", "decision_briefs", "search_candidates", "feed_candidates", "source_health",
    "finding_details", "overview_counts", "dashboard", "stored_documents", "stream_first_keys",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus,
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/nation.parquet").count()  # session warm-up
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
