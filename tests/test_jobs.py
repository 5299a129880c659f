"""Jobs with rounds, state or nested inputs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from glimmerline import catalog
from glimmerline.functions import urls
from glimmerline.operators import dedup, unions
from glimmerline.operators.health import anti_bot_scores, discovery_report
from glimmerline.plans import collect, reads
from glimmerline.plans.ingestion import extract
from glimmerline.session import scratch_path
from glimmerline.sources.payloads import last_landed, sitemap_candidates
from glimmerline.sources.registry import monitor_providers
from glimmerline.streaming.intake import append_new, read_landing, read_new


def sequential(rows):
    claimed, kept = set(), []
    for pos, *keys in sorted(rows):
        own = {(k, v) for k, v in enumerate(keys) if v is not None}
        if not own & claimed:
            kept.append(pos)
            claimed |= own
    return kept


def test_dedup_of_a_long_chain(spark, monkeypatch):
    """Ten thousand rows, each sharing a key with the next."""
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(10_000)]
    frame = spark.createDataFrame(rows, "pos long, x string, y string")
    steps = []
    plain = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: (steps.append(1), plain(df))[1])
    got = sorted(r.pos for r in dedup.greedy_dedup(frame, "pos", {"x": F.col("x"), "y": F.col("y")}).collect())
    assert got == sequential(rows) and len(steps) < 40


def test_dedup_with_walked_and_large_components(spark):
    r = random.Random(5)
    rows = [(i, r.choice([None, f"a{r.randint(0, 60)}"]), f"b{r.randint(0, 200)}") for i in range(300)]
    frame = spark.createDataFrame(rows, "pos long, x string, y string")
    keys = {"x": F.col("x"), "y": F.col("y")}
    for most in (5, 100_000):
        assert sorted(x.pos for x in dedup.greedy_dedup(frame, "pos", keys, rounds=1, most=most).collect()) == sequential(rows)


def test_health_fold_over_many_chunks(spark):
    r = random.Random(2)
    steps = [(f"s{r.choice([0, 0, 0, 1])}", r.randint(0, 50), i, r.choice([6, 2, 0, -1, -1])) for i in range(400)] + [(None, 1, 1, 6)]
    frame = spark.createDataFrame(steps, "source_id string, t int, pos int, step int").withColumn("ts", F.timestamp_seconds("t"))
    start = spark.createDataFrame([("s0", 0.35)], "source_id string, anti_bot_score double")
    got = {x.source_id: round(x.anti_bot_score * 20) for x in anti_bot_scores(frame, start, bits=3).collect()}
    want = {"s0": 7, "s1": 0, None: 0}
    for s, _, _, step in sorted(steps, key=lambda x: (x[1], x[2])):
        want[s] = min(20, max(0, want[s] + step))
    assert got == want


def test_report_tells_the_total_from_a_null_source(spark):
    frame = spark.createDataFrame([("a", 1, None), (None, 0, "x")], "source_id string, found int, error string")
    got = {(r.source_id, r.of_all): (r.attempted, r.errors) for r in discovery_report(frame).collect()}
    assert got == {("a", False): (1, 0), (None, False): (1, 1), (None, True): (2, 1)}


def sitemap(kind, *locations):
    outer = "sitemapindex" if kind == "sitemap" else "urlset"
    return f"<{outer}>" + "".join(f"<{kind}><loc>{x}</loc></{kind}>" for x in locations) + f"</{outer}>"


def test_sitemaps_named_twice_and_in_circles(spark):
    landed = [
        ("root", sitemap("sitemap", "left", "right", "leaf2"), 1), ("left", sitemap("sitemap", "leaf1", "root"), 1), ("right", sitemap("sitemap", "leaf1", "leaf2", "left"), 1),
        ("leaf1", sitemap("url", "old"), 1), ("leaf1", sitemap("url", "p1", "p2"), 2), ("leaf2", sitemap("url", "p3"), 1), ("leaf2", sitemap("url", "p3"), 1),
    ]
    frame = spark.createDataFrame(landed, "sitemap_url string, body string, ts int")
    asked = spark.createDataFrame([("s", "root"), ("t", "leaf1"), ("u", "absent")], "source_id string, sitemap_url string")
    got = sorted((r.source_id, r.sitemap, r.url, list(r.trail)) for r in sitemap_candidates(asked, frame).collect())
    assert got == [("s", "leaf1", "p1", [0, 0, 0]), ("s", "leaf1", "p2", [0, 0, 1]), ("s", "leaf2", "p3", [2, 0]), ("t", "leaf1", "p1", [0]), ("t", "leaf1", "p2", [1])]
    assert last_landed(frame, "sitemap_url").count() == 5


def test_providers_of_monitors(spark):
    monitors = spark.createDataFrame([("m1", True, ["p1", "gone"]), ("m2", True, []), ("m3", False, []), ("m4", True, None)], "monitor_id string, enabled boolean, providers array<string>")
    providers = spark.createDataFrame([("p1", "brave", True), ("p2", "tavily", True), ("p3", "brave", False)], "provider_id string, provider string, enabled boolean")
    got = sorted((r.monitor_id, r.provider_id, r.provider) for r in monitor_providers(monitors, providers).collect())
    assert got == [("m1", "p1", "brave"), ("m2", "p1", "brave"), ("m2", "p2", "tavily"), ("m4", "p1", "brave"), ("m4", "p2", "tavily")]


def test_streamed_keys_are_refused_for_good(spark):
    """A key that returns after a restart, long after its first time, is not stored again; a batch run twice changes nothing."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "new")
    schema = "idempotency_key string, fetched_at timestamp, n int"

    def poll(rows, checkpoint=f"{out}-cp"):
        if rows:
            spark.createDataFrame(rows, "idempotency_key string, t long, n int").withColumn("fetched_at", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(landing)
        append_new(read_landing(spark, landing, schema), out, checkpoint, compact=2).awaitTermination()
        return sorted((r.idempotency_key, r.n) for r in read_new(spark, out, schema).collect())

    first = [("a", 5, 1), ("a", 3, 2), ("b", 1, 3), (None, 1, 4)]
    assert poll(first) == [("a", 2), ("b", 3)]
    year = 365 * 24 * 3600
    assert poll([("a", 3 * year, 5), ("c", 3 * year, 6)]) == [("a", 2), ("b", 3), ("c", 6)]
    assert poll([("b", 1, 7), ("d", 2, 8)]) == [("a", 2), ("b", 3), ("c", 6), ("d", 8)]
    assert poll([("c", 1, 9), ("a", 9 * year, 10)]) == [("a", 2), ("b", 3), ("c", 6), ("d", 8)]
    # a lost checkpoint reads all files as batch 0 again, which holds what batch 0 brings and keeps the others
    assert {k for k, _ in poll([], f"{out}-cp2")} == {"a", "b", "c", "d"}


def test_drill_downs_are_bounded_and_counted(spark):
    events = spark.createDataFrame(
        [("r", "e1", [], 0.5, 0.5)], "run_id string, event_id string, supporting_evidence_ids array<string>, significance_score double, confidence double"
    ).selectExpr("*", "'t' AS canonical_title", "'t' AS title", "'story' AS event_type", "'s' AS subject", "timestamp'2024-01-01' AS created_at", "'' AS summary")
    evidence = spark.createDataFrame([("r", f"v{k:03d}", "d", "s", "x") for k in range(50)], "run_id string, evidence_id string, doc_id string, source_id string, text string")
    links = spark.createDataFrame([("r", "e1", f"l{k:03d}", f"v{k:03d}") for k in range(50)], "run_id string, event_id string, link_id string, evidence_id string")
    (row,) = reads.event_detail(events, evidence, links, most=7).collect()
    assert [x.evidence_id for x in row.evidence_items] == [f"v{k:03d}" for k in range(7)] and row.link_count == 50


def test_candidates_without_a_result_are_metadata_documents(spark):
    cand = spark.createDataFrame([("https://a.example/x", "A title", "said", "2024-01-02T03:04:05Z")], "url string, title string, snippet string, published_hint string")
    results = spark.createDataFrame(
        [], "url string, status_code int, fetch_mode string, block_type string, success boolean, error string, has_body boolean, landed_at struct<ts:timestamp,tie:bigint>"
    )
    landed = spark.createDataFrame([], "url string, status_code int, raw_html string, ts timestamp")
    (row,) = extract(cand, results, landed).collect()
    assert (row.title, row.summary, row.quality_score, row.notes) == ("A title", "said", 0.2, ["metadata_only_legacy_no_result"])
    assert str(row.published_at) == "2024-01-02 03:04:05" and row.metadata_fallback


def test_search_responses_are_parsed_once(spark, data):
    """three branches read the results; they used to parse the responses and build the urls anew."""
    plan = catalog.QUERIES["search_traces"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan


def test_collected_records_sort_once(spark, data, monkeypatch):
    """the only global position is that of the raw table, over rows that are written before."""
    calls, place = [], collect.with_positions

    def placed(df, order, name="rank"):
        calls.append(df._jdf.queryExecution().optimizedPlan().toString())
        return place(df, order, name)

    monkeypatch.setattr(collect, "with_positions", placed)
    assert catalog.QUERIES["collected_records"](spark, data).count() > 0
    assert len(calls) == 1 and "Window" not in calls[0] and "Generate" not in calls[0]


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("https://h.com/a/B%20c", "https://h.com/a/B%20c"), ("https://h.com", "https://h.com/"), ("https://h.com/a\n", "https://h.com/a"),
        ("https://h.com/a//", "https://h.com/a"), ("https://h.com/a;b/c;d", "https://h.com/a;b/c"), ("HTTPS://H.com/A?b=2&a=1&gclid=3#f", "https://h.com/A?a=1&b=2"),
        (" http://é.com/É ", "http://é.com/É"), ("/a/", "/a"), ("", "/"), (None, "/"),
    ],
)
def test_canonical_urls_by_the_short_and_the_full_way(spark, url, wanted):
    assert spark.createDataFrame([(url,)], "u string").select(urls.canonical_url(F.col("u"))).first()[0] == wanted


def test_values_of_unions_carry_a_number_for_their_list(spark):
    """the name of the list was shuffled with each value."""
    rows = spark.createDataFrame([("k", 1, ["b", "a"], ["x"]), ("k", 0, ["a"], ["y"])], "k string, o int, first_list array<string>, second_list array<string>")
    out = unions.ordered_unions(rows, ["k"], F.col("o"), {"first_list": F.col("first_list"), "second_list": F.col("second_list")})
    tags = rows.select(F.explode(unions._tags({"first_list": F.col("first_list")})).alias("t")).select("t.list")
    assert tags.dtypes == [("list", "tinyint")]
    assert out.first().asDict() == {"k": "k", "first_list": ["a", "b"], "second_list": ["y", "x"]}


def test_seeded_runs_prepare_their_pages_once(spark, monkeypatch):
    from glimmerline.catalog import web

    made, used = [], []
    monkeypatch.setattr(web, "prepare", lambda *a: made.append(a) or "same", raising=False)
    monkeypatch.setattr(web, "ingest", lambda *a, **k: used.append(k.get("prepared")) or {"source_health": None})
    web.seeded_runs(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and used == ["same"] * 3
