"""Rules on small hand-made rows, checked by hand or by a plain loop."""

import html
import random
from datetime import datetime
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from glimmerline.functions import dates, markup, text, urls
from glimmerline.functions.entities import unescape
from glimmerline.operators.components import connected_components
from glimmerline.operators.dedup import document_keys, greedy_dedup
from glimmerline.operators.fetching import fetch_verdict
from glimmerline.operators.health import source_health
from glimmerline.operators.ordering import with_positions
from glimmerline.plans.decisions import build_briefs, build_recommendations, build_signals, finding_records, recommendation_order
from glimmerline.plans.evidence import build_documents, build_events, build_evidence
from glimmerline.plans.findings import build_findings, build_trends
from glimmerline.plans.pages import with_changelog_entries, with_plain_links
from glimmerline.plans.stories import cluster_stories, event_profiles
from glimmerline.sources.social import engagement_score, quality_score, trust_weight


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("v")).first()["v"]


# --- D2, D9, W9, A9 -----------------------------------------------------------------------
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_dedup_matches_a_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["", "u1", "u2", f"u{i}"]), f"h{r.randint(0, 40)}", r.choice(["", "t1", "t2", f"t{i}"]), r.choice([None, "d1", "d2"])) for i in range(150)]
    kept, seen = [], set()
    for i, u, h, t, d in rows:
        keys = {("h", h)} | ({("u", u)} if u else set()) | ({("t", t, d or "")} if t else set())
        if not keys & seen:
            kept.append(i)
            seen |= keys
    df = spark.createDataFrame(rows, "pos bigint, url string, hash string, title string, day string")
    out = greedy_dedup(df, "pos", document_keys(F.col("url"), F.col("hash"), F.col("title"), F.col("day")))
    assert sorted(r["pos"] for r in out.collect()) == kept


def test_dropped_rows_claim_no_keys(spark):
    rows = [(1, "a", "h1", "t"), (2, "b", "h1", "x"), (3, "c", "h3", "x")]
    df = spark.createDataFrame(rows, "pos bigint, url string, hash string, title string").withColumn("day", F.lit("d"))
    out = greedy_dedup(df, "pos", document_keys(F.col("url"), F.col("hash"), F.col("title"), F.col("day")))
    assert sorted(r["pos"] for r in out.collect()) == [1, 3]


def test_components_match_a_loop(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(400, 500)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {n: find(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {g["node"]: g["component"] for g in got} == want


def test_positions_follow_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = with_positions(df, ["k"]).collect()
    assert sorted(r["rank"] for r in got) == list(range(5000))
    assert [r["k"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(r["k"] for r in got)


def test_health_fold_matches_a_loop(spark):
    r = random.Random(3)
    kinds = ["success", "cloudflare_challenge", "rate_limited", "network_error", "origin_forbidden"]
    rows = [("hot" if r.random() < 0.6 else f"s{r.randint(0, 5)}", datetime(2024, 1, 1, 0, r.randint(0, 59)), i, r.choice(kinds)) for i in range(600)]
    want = {}
    for sid, ts, pos, kind in sorted(rows, key=lambda x: (x[1], x[2])):
        h = want.setdefault(sid, {"score": 0, "mode": "listing_only", "rec": None, "n": 0})
        h["n"] += 1
        if kind == "success":
            h["rec"] = h["rec"] or h["mode"]
        elif kind == "cloudflare_challenge":
            h.update(score=min(20, h["score"] + 6), mode="metadata_only", rec="metadata_only")
        elif kind == "rate_limited":
            h.update(score=min(20, h["score"] + 2), rec="listing_only")
        else:
            h.update(score=max(0, h["score"] - 1), rec=h["mode"])
    df = spark.createDataFrame(rows, "source_id string, ts timestamp, pos bigint, block_type string").withColumn("success", F.col("block_type") == "success")
    for g in source_health(df).collect():
        w = want[g["source_id"]]
        assert (round(g["anti_bot_score"] * 20), g["preferred_mode"], g["recommended_mode"], g["total_attempts"]) == (w["score"], w["mode"], w["rec"], w["n"])


# --- urls, dates, pages --------------------------------------------------------------------------
@pytest.mark.parametrize(
    "url,want",
    [("HTTPS://OpenAI.com/News/?utm_source=x&b=2&a=1#f", "https://openai.com/News?a=1&b=2"), ("https://x.com", "https://x.com/"),
     ("https://x.com/a;p=1?q=a+b&z=%7E*%zz&e=", "https://x.com/a?q=a+b&z=~%2A%25zz")],
)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.lit(url))) == want


@pytest.mark.parametrize(
    "base,href,want",
    [("https://x.com/a/b", "../c#f", "https://x.com/c"), ("https://x.com/a/", "b//c", "https://x.com/a/b/c"), ("https://x.com/a", "//y.com/z", "https://y.com/z"),
     ("https://x.com/a?q=1", "?z=2", "https://x.com/a?z=2"), ("https://x.com/a/b/c", "../../../g", "https://x.com/g")],
)
def test_resolve(spark, base, href, want):
    assert one(spark, urls.resolve(F.lit(base), F.lit(href))) == want


@pytest.mark.parametrize(
    "raw,want",
    [("2026-01-15T10:00:00Z", "2026-01-15 10:00:00"), ("20260115", "2026-01-15 00:00:00"), ("2026-01-15T10", "2026-01-15 10:00:00"), ("2026-01", None),
     ("2026", None), ("2026-02-30", None), ("bad-date-format", None), ("Wed, 15 Jan 2026 10:00:00 -0500", "2026-01-15 15:00:00")],
)
def test_feed_date(spark, raw, want):
    assert one(spark, F.date_format(dates.parse_feed_date(F.lit(raw)), "yyyy-MM-dd HH:mm:ss")) == want


def test_rare_entities_are_resolved_once(spark):
    assert one(spark, text.clean_text(F.lit("<b>a</b>&nbsp;&eacute; &amp;lt; &#233;"))) == "a é &lt; é"


@pytest.mark.parametrize(
    "status,headers,body,want",
    [(403, {"server": "cloudflare", "cf-ray": "abc"}, "<title>Just a moment...</title>", ("cloudflare_challenge", False)), (403, {"server": "nginx"}, "Forbidden", ("origin_forbidden", False)),
     (429, {}, "", ("rate_limited", True)), (403, {}, "", ("unknown_403", True)), (None, {}, "", ("network_error", True))],
)
def test_fetch_verdict(spark, status, headers, body, want):
    df = spark.createDataFrame([(status, headers, body)], "s int, h map<string,string>, b string")
    v = df.select(fetch_verdict(F.col("s"), F.col("h"), F.lit("text/html"), F.col("b")).alias("v")).first()["v"]
    assert (v["block_type"], v["retryable"]) == want


def page_type(spark, html, url="https://a.example/x", block="success"):
    df = spark.createDataFrame([(html, url)], "html string, url string")
    return markup.with_page_class(df, block_type=F.lit(block)).first()


def test_page_types(spark):
    article = '<script type="application/ld+json">{"@type": "NewsArticle"}</script><article>' + "word " * 300 + "</article>"
    assert (page_type(spark, article)["page_type"], page_type(spark, article)["body_handling"]) == ("article_page", "full")
    assert page_type(spark, "<p>x</p>", "https://a.example/content-type/y")["page_type"] == "aggregation_page"
    assert page_type(spark, "<p>x</p>", block="cloudflare_challenge")["page_type"] == "challenge_or_interstitial"
    cards = "".join(f'<a href="/p{i}" class="card">c</a>' for i in range(25)) + "word " * 400
    assert page_type(spark, cards)["page_type"] in ("aggregation_page", "listing_page")


def test_links_of_a_listing(spark):
    html = '<a href="/">Home</a><a href="/news/first-article">A</a><a href="https://other.example/news/x">B</a><a href="/news/2026/deep">C</a>'
    df = spark.createDataFrame([("https://a.example/news/", html)], "url string, html string")
    assert with_plain_links(df).first()["links"] == ["https://a.example/news/first-article", "https://a.example/news/2026/deep"]


@pytest.mark.parametrize("seed", [1, 2])
def test_character_references_match_the_standard_library(spark, seed):
    r = random.Random(seed)
    names = sorted(html5)
    odd = ["&", "&&", "&amp;lt;", "&amp;eacute;", "&#38;lt;", "&;", "&#;", "&#x;", "a b", "\n", "&" + "a" * 40 + ";"]

    def part():
        code = r.choice([r.randrange(0x180), r.randrange(0xD000, 0x10000), r.randrange(0x110100), 0xFEFF, 0x1FFFF, 10**12])
        end = r.choice(["", ";", "z", "2"])
        return r.choice(["&" + r.choice(names), "&" + r.choice(names).rstrip(";") + end, f"&#{code}{end}", f"&#x{code:X}{end}", r.choice(odd)])

    rows = ["".join(part() for _ in range(r.randrange(6))) for _ in range(1500)] + ["&" + n for n in names[seed::2]]
    df = spark.createDataFrame([*enumerate(rows), (-1, None)], "i long, t string")
    got = dict(df.select("i", unescape(F.col("t"))).collect())
    assert got.pop(-1) is None
    assert [(t, got[i]) for i, t in enumerate(rows) if got[i] != html.unescape(t)] == []


def test_entities_in_entries_and_linked_data(spark):
    page = """<a href="/changelog/one">It&#8217;s caf&eacute; day &lt;b&gt;</a><li>Feb 3, 2026: na&iuml;ve &amp;eacute; &#x2014; done at last</li>
    <script type="application/ld+json">{"@type": "Article", "datePublished": &#34;2026-03-04&#34;}</script>"""
    df = spark.createDataFrame([("https://a.example/changelog", page)], "url string, html string")
    titles = [e["title"] for e in with_changelog_entries(df).first()["entries"]]
    assert "It\u2019s caf\u00e9 day <b>" in titles and any("na\u00efve &eacute; \u2014 done" in t for t in titles)
    plan = df.select(text.clean_text(F.col("html")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_changelog_entries(spark):
    html = '<a href="/changelog/item-one">Item one title</a><a href="/changelog/item-two">Item two title</a><p>Jan 5, 2026: Something shipped today</p>'
    df = spark.createDataFrame([("https://a.example/changelog", html)], "url string, html string")
    entries = with_changelog_entries(df).first()["entries"]
    assert len(entries) >= 2 and any("item-one" in e["detail_url"] for e in entries)
    assert entries[0]["date_hint"] == "Jan 5, 2026"


def test_social_quality(spark):
    engagement = F.create_map(F.lit("score"), F.lit(100.0), F.lit("num_comments"), F.lit(20.0))
    score = engagement_score(engagement, F.lit("reddit"))
    assert one(spark, score) == pytest.approx(10 / 200 + 20**0.5 / 150)
    q = quality_score(score, trust_weight(F.lit(3)), F.lit(True), F.lit("see https://x.example for more"), F.lit("a title of 20 chars.."), F.lit(False))
    assert one(spark, q) == pytest.approx((10 / 200 + 20**0.5 / 150) * 0.6 + 0.2)


# --- layers ------------------------------------------------------------------------------------------
RAW = "pos bigint, provider_id string, external_id string, text string, url string, title string, source_id string, published_at string, body_bytes binary"


def test_evidence_rules(spark):
    rows = [(1, "official:a", "u1", "x" * 5000, "https://a/1", "T", "a", "2026-01-15T10:00:00Z", None), (2, "p", "u2", "", None, None, None, "bad-date-format", None),
            (3, "p", "u3", None, None, None, None, None, bytearray(b"hi \xff there")), (4, "official:a", "u1", "other", "https://a/1", None, None, None, None)]
    raw = spark.createDataFrame(rows, RAW)
    docs = {r["pos"]: r for r in build_documents(raw).collect()}
    ev = {r["pos"]: r for r in build_evidence(raw).collect()}
    assert docs[1]["doc_id"] == docs[4]["doc_id"] and len(docs[1]["doc_id"]) == 24
    assert docs[2]["published_at"] is None and docs[2]["source_id"] == "p" and docs[3]["body_text"] == "hi  there"
    cut = {r["pos"]: r for r in build_evidence(raw, text_limit=4000).collect()}
    assert len(ev[1]["text"]) == 5000 and len(cut[1]["text"]) == 4000 and ev[1]["evidence_id"] == "evi_" + docs[1]["doc_id"]


SCENARIOS = [
    ("risk_event", "OpenAI", 0.84, 0.70, ["ai_companies:risk"], ["outage", "incident"], [], [], "risk_signal"),
    ("opportunity_event", "Anthropic", 0.76, 0.66, ["ai_companies:opportunity"], [], ["partnership"], [], "opportunity_signal"),
    ("competition_event", "OpenAI", 0.69, 0.60, [], [], [], ["a", "b"], "competition_signal"),
    ("adoption_event", "Mistral", 0.67, 0.61, ["ai_companies:model_release"], [], [], [], "adoption_signal"),
    ("research_publication", "Model governance", 0.58, 0.56, [], [], [], [], "narrative_shift"),
]


@pytest.mark.parametrize("scenario", SCENARIOS, ids=[s[-1] for s in SCENARIOS])
def test_router_scenarios(spark, scenario):
    kind, subject, sig, conf, topics, risk, opp, watch, want = scenario
    schema = ("event_id string, pos bigint, event_type string, subject string, title string, significance_score double, confidence double, topic_hits array<string>, "
              "risk_keyword_hits array<string>, opportunity_keyword_hits array<string>, watchlist_hits array<string>, supporting_evidence_ids array<string>")
    events = spark.createDataFrame([("evt_1", 1, kind, subject, "Quiet note on a topic", sig, conf, topics, risk, opp, watch, [])], schema)
    raw = spark.createDataFrame([], RAW)
    profiles, members, reasons = cluster_stories(event_profiles(events, build_evidence(raw), build_documents(raw)))
    f = build_findings(build_trends(profiles, members, reasons)).collect()
    assert [x["finding_type"] for x in f] == [want]


def test_two_events_make_one_story(spark):
    raw = spark.createDataFrame(
        [(1, "openai_news", "u1", "OpenAI launches a new model for developers", "https://openai.com/news/launch", "OpenAI launches new model", "openai_news", "2026-01-15T10:00:00Z", None),
         (2, "openai_blog", "u2", "OpenAI launches a new model for everyone", "https://www.openai.com/blog/launch", "OpenAI launches new model today", "openai_blog", "2026-01-15T12:00:00Z", None)], RAW)
    docs, ev = build_documents(raw), build_evidence(raw)
    t = build_trends(*cluster_stories(event_profiles(build_events(ev), ev, docs))).collect()
    assert len(t) == 1 and t[0]["event_ids"] == ["evt_1", "evt_2"] and t[0]["subject"] == "OpenAI"
    assert t[0]["trend_type"] == "adoption_cluster" and "canonical url slug overlap" in t[0]["merge_reasons"]


FINDING = ("finding_id string, finding_type string, title string, display_title string, theme string, subject string, decision_relevance_score double, importance_score double, "
           "supporting_event_ids array<string>, supporting_evidence_ids array<string>, watchlist_hits array<string>, topic_hits array<string>, explain array<string>, k int")


def test_consolidation(spark):
    rows = [("fd_1", "competition_signal", "A", "A", None, None, 0.78, 0.74, ["e1"], ["v1"], [], [], [], 1), ("fd_2", "competition_signal", "B", "B", None, None, 0.71, 0.68, ["e2"], ["v1"], [], [], [], 2),
            ("fd_3", "momentum_signal", "C", "C", None, None, 0.66, 0.63, ["e3"], ["v3"], [], [], [], 3)]
    f = spark.createDataFrame(rows, FINDING)
    signals = build_signals(f, [F.col("k")])
    records = finding_records(f, signals)
    recs = build_recommendations(records).orderBy(*recommendation_order()).collect()
    assert [r["recommended_action"] for r in recs] == ["track_competitor_response", "increase_monitoring"]
    assert recs[0]["supporting_finding_ids"] == ["fd_1", "fd_2"] and recs[0]["consolidated_signal_count"] == 2 and recs[0]["theme"] == "competition"
    assert recs[0]["priority"] == pytest.approx(0.745 * 0.55 + 0.71 * 0.25 + 0.12 + 0.04, abs=6e-4)
    briefs = build_briefs(records, build_recommendations(records)).collect()
    assert [b["brief_type"] for b in briefs] == ["watch_brief", "risk_opportunity_memo", "weekly_decision_brief"]
    assert "Next actions: track_competitor_response, increase_monitoring." in briefs[0]["narrative"]


def test_no_findings_no_briefs(spark):
    f = spark.createDataFrame([], FINDING)
    records = finding_records(f, build_signals(f, [F.col("k")]))
    assert build_recommendations(records).count() == 0 and build_briefs(records, build_recommendations(records)).count() == 0


def test_page_rules_skip_what_a_page_lacks(spark):
    from glimmerline.functions import dates
    from glimmerline.operators.fetching import has_body

    rows = [(0, " \n\t  "), (1, "<META property='article:published_time' content='2024-03-05'>"), (2, None), (3, "x" * 50), (4, "March 5, 2024 - news")]
    df = spark.createDataFrame(rows, "k int, html string")
    got = markup.with_html_dates(df.withColumn("body", has_body(F.col("html")))).orderBy("k").collect()
    assert [r.body for r in got] == [False, True, False, True, True]
    assert [str(r.html_published) if r.html_published else None for r in got] == [None, "2024-03-05 00:00:00", None, None, None]
    plan = df.select(has_body(F.col("html")).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # a test ends at the first character, a replacement reads all
    log = [dates.parse_changelog_date(F.col("html"), one_line=one) for one in (True, False)]
    assert all(a == b for a, b in df.select(log[0].alias("a"), log[1].alias("b")).collect())
    assert "split(" not in df.select(log[0].alias("d"))._jdf.queryExecution().optimizedPlan().toString()


def test_tails_of_links_are_read_where_links_are(spark):
    """The 400 characters that follow a link: as the plain rule reads them, and not looked up at every character of a page."""
    import random
    import re
    import time

    from glimmerline.plans.pages import HREF_WITH_TAIL

    r = random.Random(4)
    parts = ["<a ", "href=", "HREF = ", "'", '"', "/changelog/1", "hhref", "href", "\n", "x" * 30, ">Release<", " href='#'", "ſ"]
    pages = ["".join(r.choice(parts) for _ in range(r.randint(0, 80))) for _ in range(60)]
    plain = re.compile(r"""(?is)(?=(.{0,400}))href\s*=\s*(["'])([^"']+)\2""")
    groups = F.struct(*[F.regexp_extract_all("html", F.lit(HREF_WITH_TAIL), F.lit(g)).alias(f"g{g}") for g in (1, 3)])
    rows = spark.createDataFrame([(p,) for p in pages], "html string").select("html", groups.alias("g")).collect()
    for row in rows:
        want = [(m[1], m[3]) for m in plain.finditer(row.html)]
        assert list(zip(row.g.g1, row.g.g3, strict=True)) == want
    large = spark.range(1).select(F.repeat(F.lit("no link here. "), 500_000).alias("html"))

    def seconds(pattern):
        start = time.perf_counter()
        assert large.select(F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)))).first()[0] == 0
        return time.perf_counter() - start

    seconds("href")
    assert seconds(HREF_WITH_TAIL) < 20 * seconds("href") + 1


def test_finding_detail_reads_findings_and_trends_once_per_list(spark):
    """Lists of a finding are looked up from the findings, not from rows that are joined already."""
    from glimmerline.plans.reads import finding_detail

    ids = F.array(F.lit("x1")).alias("supporting_event_ids"), F.array(F.lit("y1")).alias("supporting_evidence_ids")
    one = spark.range(1).select(F.lit("r").alias("run_id"))
    text = lambda *names: [F.lit(n[:1] + "1").alias(n) for n in names]
    findings = one.select("run_id", *text("finding_id", "trend_id", "title", "display_title"), *ids)
    trends = spark.createDataFrame([("r", "t1", "Trend")], "run_id string, trend_id string, trend_title string")
    events = one.select("run_id", F.lit("x1").alias("event_id"), *text("canonical_title", "title", "event_type", "subject"), F.lit(0.1).alias("significance_score"), F.lit(0.2).alias("confidence"))
    evidence = one.select("run_id", F.lit("y1").alias("evidence_id"), *text("doc_id", "source_id", "text"))
    documents = one.select("run_id", F.lit("d1").alias("document_id"), *text("title", "canonical_url", "source_id"))
    recs = one.select("run_id", *text("recommendation_id", "signal_id", "recommended_action"), F.lit(0.5).alias("priority"))
    signals = one.select("run_id", *text("signal_id", "finding_id"))
    out = finding_detail(findings, trends, events, evidence, documents, recs, signals)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("trend_title#") and sum("LogicalRDD" in line and "trend_title" in line for line in plan.splitlines()) == 1
    row = out.first()
    assert row.related_trend.trend_title == "Trend" and row.related_recommendations_count == 1
    assert [e.event_id for e in row.related_events] == ["x1"] and [e.evidence_id for e in row.related_evidence] == ["y1"]


def test_positions_keep_a_small_copy_of_wide_rows(spark):
    """What fixes an order on disk takes a fraction of the rows; positions follow the order over all partitions."""
    import os

    from glimmerline.session import shared_dir

    def held():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared_dir(spark).removeprefix("file:")) for f in files)

    n = 20_000
    rows = spark.range(n, numPartitions=5).select(
        (F.col("id") * 7919 % n).alias("key"), F.concat(F.lit("https://source.example/news/"), F.col("id")).alias("url"), F.lit(None).cast("string").alias("empty"),
        F.array(F.lit("web_search")).alias("channels"),
    )
    before = held()
    placed = with_positions(rows, ["key"], "pos")
    assert 0 < held() - before < 10 * n
    assert placed.filter("pos <> key").count() == 0 and placed.count() == n
