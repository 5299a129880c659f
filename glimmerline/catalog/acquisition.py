"""Queries over sources, payloads, social items and search candidates.

Payloads are written from the given tables (a page of orders as a feed, a
customer as a search response), so their number grows with the tables while
each payload stays as small as a real one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.acquisition import search_discovery, social_batches
from ..plans.collect import Official, Search, Social, collect_sources
from ..plans.discovery import discover
from ..sources.payloads import (
    document_records, feed_candidates, feed_records, hn_cursor, hn_item_candidates, hn_search_candidates, official_records,
    reddit_candidates, rest_candidates, search_records, search_results, sitemap_candidates, union_batches,
)
from ..sources.registry import (
    enabled_social, group_by_provider, listing_seeds, monitor_providers, official_domains, resolve_transports, scan_social_sources, scan_sources,
    stamp_candidates, with_strategy,
)
from ..sources.search import (
    build_queries, common_candidates, fetch_plans, guess_origin, merge_results, planned_searches, provider_evidence, route_candidates,
    score_candidates, trace_payload, with_canonical,
)
from ..session import cut_lineage
from ..sources.social import comment_lines, social_health, social_records, with_comments
from .base import big, joined, query, table, text_of

PAGE = 8  # orders per payload


def s(*parts):
    """Concatenates columns and literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def order_pages(spark: SparkSession, folder: str, item) -> DataFrame:
    """Orders in pages of at most 8 consecutive keys, `items` in key order."""
    o = table(spark, folder, "orders").withColumn("page", F.floor(F.col("o_orderkey") / PAGE).cast("bigint"))
    return o.groupBy("page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("x")))), lambda v: v["x"]).alias("items")
    )


_P = "p AS (SELECT *, o_orderkey // 8 AS page, row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY o_orderkey) - 1 AS i FROM orders)"


# --- S1, P7-P10, S8, J6 -------------------------------------------------------------------------
def companies(spark: SparkSession, folder: str) -> DataFrame:
    """One company per nation, one source per supplier."""
    k = F.col("s_suppkey")
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<transport:STRING,enabled:BOOLEAN,priority:INT,url:STRING,items_path:STRING,field_map:MAP<STRING,STRING>>>)")

    def strat(transport, on, pri, url):
        return F.struct(F.lit(transport).alias("transport"), F.lit(on).alias("enabled"), F.lit(pri).alias("priority"), url.alias("url"),
                        F.lit(None).cast("string").alias("items_path"), F.lit(None).cast("map<string,string>").alias("field_map"))

    many = F.array(strat("html_listing", True, 50, s("https://l", k.cast("string"), ".example/news/")),
                   strat("rss", True, 80, s("https://l", k.cast("string"), ".example/rss")), strat("sitemap", False, 99, F.lit("https://off.example")))
    src = F.struct(
        F.when(k % 10 == 0, s("changelog_", k.cast("string"))).when(k % 10 == 1, F.lit("xai_news")).otherwise(s("src_", k.cast("string"))).alias("id"),
        F.when(k % 4 == 0, "rss").when(k % 4 == 1, "sitemap_feed").otherwise("newsroom").alias("type"),
        F.when(k % 3 != 0, s("https://s", k.cast("string"), ".example/start")).alias("url"),
        F.when(k % 5 == 0, "metadata_only").alias("access"), F.when(k % 2 == 0, "high").alias("priority"), (k % 9 != 0).alias("enabled"),
        F.when(k % 3 == 0, many).otherwise(empty).alias("strategies"),
        F.when(k % 6 == 1, s("https://feed", k.cast("string"), ".example/x")).alias("rss_url"),
    )
    sup = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return sup.groupBy(F.col("n_name").alias("company")).agg(F.collect_list(src).alias("sources"))


_SRC_SQL = """
x AS (SELECT *, CASE WHEN s_suppkey % 10 = 0 THEN 'changelog_' || s_suppkey WHEN s_suppkey % 10 = 1 THEN 'xai_news' ELSE 'src_' || s_suppkey END AS id,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'https://s' || s_suppkey || '.example/start' ELSE 'https://l' || s_suppkey || '.example/news/' END AS url,
  CASE WHEN s_suppkey % 5 = 0 THEN 'metadata_only' ELSE 'listing_only' END AS access, s_suppkey % 9 <> 0 AS enabled, n_name AS company FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


@query("source_registry", f"WITH {_SRC_SQL} SELECT company, id, url, access, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'medium' END AS priority, enabled FROM x")
def source_registry(spark, folder):
    return scan_sources(companies(spark, folder)).select("company", "id", "url", "access", "priority", "enabled")


@query(
    "transports",
    f"""
    WITH {_SRC_SQL}, t AS (
      SELECT company, id, url AS source_url, 'rss' AS transport, 80 AS p, 'https://l' || s_suppkey || '.example/rss' AS u FROM x WHERE enabled AND s_suppkey % 3 = 0
      UNION ALL SELECT company, id, url, 'html_listing', 50, 'https://l' || s_suppkey || '.example/news/' FROM x WHERE enabled AND s_suppkey % 3 = 0
      UNION ALL SELECT company, id, url, 'rss', 100, 'https://feed' || s_suppkey || '.example/x' FROM x WHERE enabled AND s_suppkey % 3 <> 0 AND s_suppkey % 6 = 1
      UNION ALL SELECT company, id, url, CASE s_suppkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'sitemap' ELSE 'html_listing' END, CASE WHEN s_suppkey % 4 < 2 THEN 90 ELSE 60 END, url FROM x WHERE enabled AND s_suppkey % 3 <> 0)
    SELECT source_url, transport, u AS transport_url, p::BIGINT AS transport_priority FROM t
    """,
)
def transports(spark, folder):
    return resolve_transports(scan_sources(companies(spark, folder))).select(
        F.col("url").alias("source_url"), "transport", "transport_url", big(F.col("transport_priority")).alias("transport_priority")
    )


@query(
    "transport_modes",
    f"""
    WITH {_SRC_SQL}, t AS (
      SELECT id, url AS source_url, 'rss' AS transport, 80 AS p FROM x WHERE enabled AND s_suppkey % 3 = 0
      UNION ALL SELECT id, url, 'html_listing', 50 FROM x WHERE enabled AND s_suppkey % 3 = 0
      UNION ALL SELECT id, url, 'rss', 100 FROM x WHERE enabled AND s_suppkey % 3 <> 0 AND s_suppkey % 6 = 1
      UNION ALL SELECT id, url, CASE s_suppkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'sitemap' ELSE 'html_listing' END, CASE WHEN s_suppkey % 4 < 2 THEN 90 ELSE 60 END FROM x WHERE enabled AND s_suppkey % 3 <> 0)
    SELECT 'rss_only' AS mode, source_url, transport, row_number() OVER (PARTITION BY id ORDER BY p DESC) AS turn FROM t WHERE transport = 'rss' AND id <> 'xai_news'
    UNION ALL SELECT 'rss_first', source_url, transport, row_number() OVER (PARTITION BY id ORDER BY transport = 'rss' DESC, p DESC) FROM t WHERE id <> 'xai_news'
    """,
)
def transport_modes(spark, folder):
    """P8, feeds only and feeds first; of sources whose id is their own."""
    sources = scan_sources(companies(spark, folder)).filter("id <> 'xai_news'")
    parts = [
        resolve_transports(sources, mode).select(F.lit(mode).alias("mode"), F.col("url").alias("source_url"), "transport", big(F.col("turn")).alias("turn"))
        for mode in ("rss_only", "rss_first")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "flat_registry",
    """
    SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' ELSE n_name END AS company, 'flat_' || s_suppkey AS id,
      CASE WHEN s_suppkey % 3 = 0 THEN 'about:blank' ELSE 'https://f' || s_suppkey || '.example/' END AS url, s_suppkey % 5 <> 0 AS enabled FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
def flat_registry(spark, folder):
    """S1, the flat shape: a provider and a source per row."""
    k = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(k % 4 != 0, F.col("n_name")).alias("provider"), s("flat_", k.cast("string")).alias("source_id"),
        F.when(k % 3 != 0, s("https://f", k.cast("string"), ".example/")).alias("url"), F.when(k % 5 == 0, False).alias("enabled"),
    )
    return group_by_provider(rows).select("company", "id", "url", "enabled")


@query(
    "source_strategies",
    f"""
    WITH {_SRC_SQL} SELECT url, CASE WHEN id = 'xai_news' THEN 'protected' WHEN contains(id, 'changelog') THEN 'structured_index' WHEN access = 'metadata_only' THEN 'metadata_preferred'
      ELSE 'fulltext_preferred' END AS strategy, NOT (id = 'xai_news' OR contains(id, 'changelog') OR access = 'metadata_only') AS follow FROM x
    """,
)
def source_strategies(spark, folder):
    return with_strategy(scan_sources(companies(spark, folder))).select(
        "url", F.col("source_strategy").alias("strategy"), F.col("follow_detail_pages").alias("follow")
    )


@query("listing_seeds", f"WITH {_SRC_SQL} SELECT url, 70::BIGINT AS priority, 'listing' AS hint_doc_type FROM x WHERE enabled AND (s_suppkey % 3 = 0 OR s_suppkey % 4 >= 2)")
def listing_seeds_query(spark, folder):
    seeds = listing_seeds(resolve_transports(scan_sources(companies(spark, folder))))
    return seeds.select("url", big(F.col("priority")).alias("priority"), "hint_doc_type")


@query(
    "official_domains",
    f"""
    WITH {_SRC_SQL} SELECT DISTINCT d AS domain FROM (SELECT regexp_extract(url, '//([^/]*)', 1) AS d FROM x
      UNION ALL SELECT 'feed' || s_suppkey || '.example' FROM x WHERE s_suppkey % 6 = 1)
    """,
)
def official_domains_query(spark, folder):
    return official_domains(scan_sources(companies(spark, folder)))


@query(
    "social_registry",
    "SELECT 'soc_' || s_suppkey AS source_id, 50::BIGINT AS priority, 20::BIGINT AS max_items, 2::BIGINT AS trust_tier, (s_suppkey % 2 = 0) AS include_comments FROM supplier WHERE s_suppkey % 4 <> 0",
)
def social_registry(spark, folder):
    k = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(
        s("soc_", k.cast("string")).alias("source_id"), F.lit("reddit").alias("platform"), F.when(k % 4 == 0, False).alias("enabled"),
        F.when(k % 2 == 0, True).alias("include_comments"),
    )
    return enabled_social(scan_social_sources(rows)).select(
        "source_id", big(F.col("priority")).alias("priority"), big(F.col("max_items")).alias("max_items"), big(F.col("trust_tier")).alias("trust_tier"), "include_comments"
    )


# --- S4-S7 ------------------------------------------------------------------------------------------
def _feed_bodies(spark, folder) -> DataFrame:
    k, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "EEE, dd MMM yyyy")
    rss = s("<item><title>Order ", k, "</title><link>", F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(s("https://shop.example/o/", k)), "</link><guid isPermaLink=\"false\">g", k,
            "</guid><pubDate>", day, " 06:00:00 GMT</pubDate><description>Worth &lt;b&gt; ", F.col("o_orderpriority"), "</description></item>")
    atom = s("<entry><title>Order ", k, "</title><link rel=\"alternate\" href=\"", F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(s("https://shop.example/o/", k)), "\"/><id>g", k,
             "</id><updated>", F.date_format("o_orderdate", "yyyy-MM-dd"), "T06:00:00Z</updated><summary>Worth &lt;b&gt; ", F.col("o_orderpriority"), "</summary></entry>")
    p = order_pages(spark, folder, F.when(F.floor(F.col("o_orderkey") / PAGE) % 2 == 0, rss).otherwise(atom))
    text = F.array_join("items", "")
    body = F.when(
        F.col("page") % 2 == 0, s("<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><title>c</title>", text, "</channel></rss>")
    ).otherwise(s("<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>c</title>", text, "</feed>"))
    return p.select("page", s("prov", F.col("page").cast("string")).alias("provider_id"), s("https://shop.example/rss/", F.col("page").cast("string")).alias("feed_url"), body.alias("body"))


@query(
    "feed_candidates",
    f"""
    WITH {_P} SELECT page, i AS item, 'https://shop.example/o/' || o_orderkey AS url, (90 - i)::BIGINT AS priority, 'Order ' || o_orderkey AS title,
      strftime(o_orderdate, '%Y-%m-%d 06:00:00') AS published, 'Worth <b> ' || o_orderpriority AS snippet FROM p WHERE o_orderkey % 7 <> 0
    """,
)
def feed_candidates_query(spark, folder):
    return feed_candidates(_feed_bodies(spark, folder)).select(
        "page", big(F.col("item")).alias("item"), "url", big(F.col("priority")).alias("priority"), "title", text_of(F.col("published_at")).alias("published"), "snippet"
    )


@query(
    "feed_records",
    f"""
    WITH {_P} SELECT 'prov' || page AS provider_id, 'g' || o_orderkey AS external_id, 'Worth <b> ' || o_orderpriority AS text,
      CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'https://shop.example/o/' || o_orderkey END AS url, 'rss:prov' || page || ':g' || o_orderkey AS idempotency_key FROM p
    """,
)
def feed_records_query(spark, folder):
    return feed_records(_feed_bodies(spark, folder)).select("provider_id", "external_id", "text", "url", "idempotency_key")


@query(
    "sitemap_candidates",
    """
    WITH o AS (SELECT *, o_orderkey // 8 AS page, o_orderkey // 32 AS root FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY o_orderkey) - 1 AS i FROM o)
    SELECT 'root' || root AS source_id, 'https://shop.example/o/' || o_orderkey AS url, (80 - i)::BIGINT AS priority, strftime(o_orderdate, '%Y-%m-%d') AS lastmod FROM r
    """,
)
def sitemap_candidates_query(spark, folder):
    """Index files of four sitemaps each, all landed twice."""
    k = F.col("o_orderkey").cast("string")
    entry = s("<url><loc>https://shop.example/o/", k, "</loc><lastmod>", F.date_format("o_orderdate", "yyyy-MM-dd"), "</lastmod></url>")
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    name = lambda p: s("https://shop.example/map", p.cast("string"), ".xml")
    leaves = order_pages(spark, folder, entry).select(
        name(F.col("page")).alias("sitemap_url"), F.floor(F.col("page") / 4).cast("bigint").alias("root"), "page", s(f"<urlset {ns}>", F.array_join("items", ""), "</urlset>").alias("body")
    )
    roots = leaves.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("page", "sitemap_url"))).alias("m")).select(
        s("root", F.col("root").cast("string")).alias("source_id"), s("https://shop.example/index", F.col("root").cast("string")).alias("sitemap_url"),
        s(f"<sitemapindex {ns}>", F.array_join(F.transform("m", lambda x: s("<sitemap><loc>", x["sitemap_url"], "</loc></sitemap>")), ""), "</sitemapindex>").alias("body"),
    )
    landed = leaves.select("sitemap_url", "body").unionByName(roots.select("sitemap_url", "body"))
    out = sitemap_candidates(roots.select("source_id", "sitemap_url"), landed.unionByName(landed))
    return out.select("source_id", "url", big(F.col("priority")).alias("priority"), "lastmod")


@query(
    "rest_candidates",
    f"""
    WITH {_P} SELECT page, i AS item, 'https://api.example/' || CASE page % 3 WHEN 0 THEN 'o/' ELSE 'list/o/' END || o_orderkey AS url, 'Order ' || o_orderkey AS title, (95 - i)::BIGINT AS priority, o_orderkey::VARCHAR AS external_id FROM p
    """,
)
def rest_candidates_query(spark, folder):
    """Three shapes: nested path with a field map, a usual list key, a bare list with link objects."""
    k = F.col("o_orderkey").cast("string")
    mod = F.floor(F.col("o_orderkey") / PAGE) % 3
    item = F.when(mod == 0, s('{"meta":{"href":"/o/', k, '"},"name":"Order ', k, '","key":"', k, '"}')).when(
        mod == 1, s('{"link":"o/', k, '","title":"Order ', k, '","id":', k, "}")
    ).otherwise(s('{"url":{"href":"https://api.example/list/o/', k, '"},"title":"Order ', k, '","id":"', k, '"}'))
    p = order_pages(spark, folder, item)
    rows, m = F.array_join("items", ","), F.col("page") % 3
    body = F.when(m == 0, s('{"d":{"rows":[', rows, "]}}")).when(m == 1, s('{"n":1,"data":{"x":1},"results":[', rows, "]}")).otherwise(s("[", rows, "]"))
    fields = F.when(m == 0, F.create_map(F.lit("url"), F.lit("meta.href"), F.lit("title"), F.lit("name"), F.lit("id"), F.lit("key")))
    out = rest_candidates(p.select("page", F.lit("https://api.example/list/").alias("list_url"), F.when(m == 0, "d.rows").alias("items_path"), fields.alias("field_map"), body.alias("body")))
    return out.select("page", big(F.col("item")).alias("item"), "url", "title", big(F.col("priority")).alias("priority"), "external_id")


# --- S9, S10, S13, F23-F27, F34, A11 ----------------------------------------------------------------------
def _reddit_payloads(spark, folder) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    epoch = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    item = s('{"kind":"', F.when(F.col("o_orderkey") % 6 == 0, "t1").otherwise("t3"), '","data":{"id":"', k, '","title":"Post ', k, '","selftext":"See https://x.example/', k,
             '","permalink":"/r/a/', k, '","author":"u', F.col("o_custkey").cast("string"), '","created_utc":', epoch, ',"score":', (F.col("o_orderkey") % 900).cast("string"), ',"num_comments":',
             (F.col("o_orderkey") % 50).cast("string"), "}}")
    p = order_pages(spark, folder, item)
    listing = s('{"data":{"children":[', F.array_join("items", ","), '],"after":"a', F.col("page").cast("string"), '"}}')
    return p.select(s("sub", F.col("page").cast("string")).alias("source_id"), F.lit("search").alias("source_type"), F.lit("reddit").alias("platform"), F.lit("listing").alias("form"),
                    F.lit(0).alias("item"), F.when(F.col("page") % 2 == 0, listing).otherwise(s("[", listing, ',{"data":{}}]')).alias("body"), F.lit(None).cast("string").alias("error"))


@query(
    "reddit_candidates",
    f"""
    WITH {_P} SELECT 'sub' || page AS source_id, i AS item, 't3_' || o_orderkey AS external_id, 'https://www.reddit.com/r/a/' || o_orderkey AS url, 'u' || o_custkey AS author_handle,
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS published, 'a' || page AS cursor_after FROM p WHERE o_orderkey % 6 <> 0
    """,
)
def reddit_candidates_query(spark, folder):
    return reddit_candidates(_reddit_payloads(spark, folder)).select(
        "source_id", big(F.col("item")).alias("item"), "external_id", "url", "author_handle", text_of(F.col("published_at")).alias("published"), "cursor_after"
    )


@query(
    "hn_candidates",
    f"""
    WITH {_P} SELECT 'hn' || page AS source_id, o_orderkey::VARCHAR AS external_id, CASE WHEN o_orderkey % 2 = 0 THEN 'https://news.ycombinator.com/item?id=' || o_orderkey ELSE 'https://x.example/' || o_orderkey END AS url,
      (o_orderkey % 300)::DOUBLE AS points, max(o_orderkey) OVER (PARTITION BY page) AS last_max_id FROM p
    """,
)
def hn_candidates(spark, folder):
    """Even pages as search hits, odd pages as story items."""
    k = F.col("o_orderkey").cast("string")
    link = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(s("https://x.example/", k))
    hit = s('{"objectID":"', k, '","title":"T ', k, '","url":"', link, '","author":"a","created_at_i":1700000000,"points":', (F.col("o_orderkey") % 300).cast("string"), ',"num_comments":3}')
    o = table(spark, folder, "orders").withColumn("page", F.floor(F.col("o_orderkey") / PAGE).cast("bigint"))
    p = order_pages(spark, folder, hit).filter("page % 2 = 0").select(
        s("hn", F.col("page").cast("string")).alias("source_id"), F.lit("search").alias("source_type"), s('{"hits":[', F.array_join("items", ","), "]}").alias("body")
    )
    items = o.filter("page % 2 = 1").select(
        s("hn", F.col("page").cast("string")).alias("source_id"), F.lit("top").alias("source_type"), F.lit(0).alias("item"),
        s('{"id":', k, ',"type":"story","title":"T ', k, '","url":"', link, '","by":"a","time":1700000000000,"score":', (F.col("o_orderkey") % 300).cast("string"), ',"descendants":3,"kids":[1]}').alias("body"),
    )
    both = hn_search_candidates(p).unionByName(hn_item_candidates(items))
    return both.join(hn_cursor(both), "source_id").select(
        "source_id", "external_id", "url", F.col("engagement")["points"].alias("points"), "last_max_id"
    )


@query(
    "social_records",
    f"""
    WITH {_P}, x AS (SELECT *, 'See https://x.example/' || o_orderkey AS body, least(1.0::DOUBLE, sqrt(o_orderkey % 900) / 200.0::DOUBLE + sqrt(o_orderkey % 50) / 150.0::DOUBLE) AS eng FROM p WHERE o_orderkey % 6 <> 0)
    SELECT 'social:sub' || page AS provider_id, 't3_' || o_orderkey AS external_id, body AS text, round(eng, 6) AS engagement_score,
      round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, eng * 0.6::DOUBLE + 0.05::DOUBLE - (CASE WHEN o_orderkey % 2 = 0 THEN 0.2 ELSE 0.0 END)::DOUBLE)), 6) AS quality_score FROM x
    """,
)
def social_records_query(spark, folder):
    c = reddit_candidates(_reddit_payloads(spark, folder)).withColumns(
        {"trust_tier": F.lit(3), "comment_context": F.lit(""), "metadata_only": F.substring("external_id", 4, 20).cast("bigint") % 2 == 0}
    )
    return social_records(c).select(
        "provider_id", "external_id", "text", F.round("engagement_score", 6).alias("engagement_score"), F.round("quality_score", 6).alias("quality_score")
    )


@query(
    "comment_context",
    """
    WITH c AS (SELECT conv_id, role, trim(text, ' ' || chr(10)) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT t.conv_id, trim(t.text, ' ' || chr(10)) || coalesce(chr(10) || chr(10) || '--- comments ---' || chr(10) || (SELECT string_agg('- @' || role || ': ' || body, chr(10) ORDER BY n) FROM c WHERE c.conv_id = t.conv_id AND body <> ''), '') AS text
    FROM conversations t WHERE turn = 0
    """,
)
def comment_context(spark, folder):
    c = table(spark, folder, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("external_id"), F.col("turn").alias("at"), F.col("role").alias("author"), F.col("text").alias("body"))
    posts = c.filter("turn = 0").select(F.col("conv_id").cast("string").alias("external_id"), "text")
    return with_comments(posts, comment_lines(rows)).select(F.col("external_id").cast("bigint").alias("conv_id"), "text")


@query(
    "social_health",
    """
    SELECT 'u' || user_id AS source_id, count(*) AS total_attempts, count(*) FILTER (event_type <> 'error') AS total_successes,
      CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'e' || max(event_id) END AS last_error, count(*) FILTER (event_id % 10 = 0) AS metadata_fallback_used,
      round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate FROM events GROUP BY user_id
    """,
)
def social_health_query(spark, folder):
    e = table(spark, folder, "events").select(
        s("u", F.col("user_id").cast("string")).alias("source_id"), F.lit("reddit").alias("platform"), F.col("event_id").alias("pos"),
        (F.col("event_type") != "error").alias("success"), s("e", F.col("event_id").cast("string")).alias("error"), (F.col("event_id") % 10 == 0).alias("fallback"),
    )
    return social_health(e).select("source_id", "total_attempts", "total_successes", "last_error", "metadata_fallback_used", F.round("success_rate", 6).alias("success_rate"))


@query(
    "social_run",
    f"""
    WITH {_P}, c AS (SELECT conv_id, string_agg('- @' || role || ': ' || trim(text, ' ' || chr(10)), chr(10) ORDER BY turn) FILTER (trim(text, ' ' || chr(10)) <> '') AS lines FROM conversations GROUP BY 1),
    x AS (SELECT p.*, 'See https://x.example/' || o_orderkey AS body, coalesce(conv_id % 7 = 0, false) AS failed, CASE WHEN conv_id % 7 <> 0 THEN lines END AS lines,
      least(1.0::DOUBLE, sqrt(o_orderkey % 900) / 200.0::DOUBLE + sqrt(o_orderkey % 50) / 150.0::DOUBLE) AS eng FROM p LEFT JOIN c ON conv_id = o_orderkey WHERE o_orderkey % 6 <> 0)
    SELECT CASE WHEN failed THEN 'fallback' ELSE 'enriched' END AS channel, 'social:sub' || page AS provider_id, 't3_' || o_orderkey AS external_id,
      length(body || coalesce(chr(10) || chr(10) || '--- comments ---' || chr(10) || lines, '')) AS n_chars,
      round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, eng * 0.6::DOUBLE + (CASE WHEN lines IS NOT NULL THEN 0.15 ELSE 0 END)::DOUBLE + 0.05::DOUBLE - (CASE WHEN failed THEN 0.2 ELSE 0 END)::DOUBLE)), 6) AS quality_score,
      failed AS metadata_fallback FROM x
    """,
)
def social_run(spark, folder):
    """X17 over order pages as subreddits and conversations as comments."""
    out = social_batches(*social_inputs(spark, folder))
    return union_batches(enriched=out["records"], fallback=out["fallback"]).select(
        "channel", "provider_id", "external_id", big(F.length("text")).alias("n_chars"), F.round("quality_score", 6).alias("quality_score"), "metadata_fallback"
    )


def social_inputs(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    pay = _reddit_payloads(spark, folder)
    src = scan_social_sources(pay.select("source_id", "platform", "source_type", F.lit(True).alias("include_comments"), F.lit(3).alias("trust_tier")))
    com = table(spark, folder, "conversations").select(
        s("t3_", F.col("conv_id").cast("string")).alias("external_id"), F.col("turn").alias("at"), F.col("role").alias("author"), F.col("text").alias("body"), (F.col("conv_id") % 7 == 0).alias("failed")
    )
    return src, pay, com


# --- S11, A1, F28-F33, J7 -----------------------------------------------------------------------------------
def _search_payloads(spark, folder) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    host = F.when(F.col("o_custkey") % 3 == 0, "official.example").when(F.col("o_custkey") % 3 == 1, "www.reddit.com").otherwise("other.example")
    link = F.when(F.col("o_orderkey") % 12 == 0, "").otherwise(s("https://", host, "/c/", (F.col("o_custkey") % 400).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "/?utm_source=x").otherwise("")))
    item = s('{"url":"', link, '","title":"Result title ', k, '","description":"d', k, '","content":"d', k, '","publishedAt":"', F.date_format("o_orderdate", "yyyy-MM-dd"), 'T00:00:00Z"}')
    p = order_pages(spark, folder, item)
    rows, m = F.array_join("items", ","), F.col("page") % 3
    body = F.when(m == 0, s('{"articles":[', rows, "]}")).when(m == 1, s('{"web":{"results":[', rows, "]}}")).otherwise(s('{"results":[', rows, "]}"))
    name = F.when(m == 0, "newsapi").when(m == 1, "brave").otherwise("tavily")
    return p.select("page", s("q", (F.col("page") % 50).cast("string")).alias("query_id"), s(name, "_", (F.col("page") % 2).cast("string")).alias("provider_id"), name.alias("provider"), body.alias("body"))


_RES_SQL = f"""
{_P}, res AS (SELECT o_orderkey AS pos, 'q' || (page % 50) AS query_id, ['newsapi', 'brave', 'tavily'][(page % 3 + 1)::INT] || '_' || (page % 2) AS provider_id, i + 1 AS rank,
  'https://' || ['official.example', 'www.reddit.com', 'other.example'][(o_custkey % 3 + 1)::INT] || '/c/' || (o_custkey % 400) AS canon,
  ['official.example', 'www.reddit.com', 'other.example'][(o_custkey % 3 + 1)::INT] AS domain, CASE WHEN page % 3 = 0 THEN o_orderdate::DATE::TIMESTAMP END AS published FROM p WHERE o_orderkey % 12 <> 0)
"""


@query(
    "search_results",
    f"WITH {_RES_SQL} SELECT query_id, provider_id, rank::BIGINT AS rank, domain, 'Result title ' || pos AS title, 'd' || pos AS snippet, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM res",
)
def search_results_query(spark, folder):
    return search_results(_search_payloads(spark, folder)).select(
        "query_id", "provider_id", big(F.col("rank")).alias("rank"), "domain", "title", "snippet", text_of(F.col("published_hint")).alias("published")
    )


def _candidates(spark, folder) -> tuple[DataFrame, DataFrame]:
    r = search_results(_search_payloads(spark, folder)).withColumn("pos", F.regexp_extract("title", r"(\d+)$", 1).cast("bigint"))
    r = cut_lineage(with_canonical(r))  # read by three branches
    domains = spark.range(1).select(F.lit("official.example").alias("domain"))
    scored = score_candidates(guess_origin(merge_results(r), domains), F.lit("1998-08-02").cast("timestamp"), "30d")
    return route_candidates(scored), r


_CAND_SQL = f"""
{_RES_SQL}, q AS (SELECT canon, query_id, min(pos) AS f FROM res GROUP BY ALL), pv AS (SELECT canon, provider_id, min(pos) AS f FROM res GROUP BY ALL),
g AS (SELECT canon, min(domain) AS domain, min(pos) AS pos, max(published) AS published, count(*) AS evidence_count,
  (SELECT string_agg(query_id, '|' ORDER BY f) FROM q WHERE q.canon = res.canon) AS queries, (SELECT string_agg(provider_id, '|' ORDER BY f) FROM pv WHERE pv.canon = res.canon) AS providers,
  count(DISTINCT query_id) AS nq, count(DISTINCT provider_id) AS np FROM res GROUP BY canon),
sc AS (SELECT *, CASE domain WHEN 'official.example' THEN 'first_party' WHEN 'www.reddit.com' THEN 'community' ELSE 'external_web' END AS origin,
  least(1.0, least(0.35, nq * 0.1) + least(0.25, np * 0.08) + CASE WHEN published >= TIMESTAMP '1998-08-02' - INTERVAL 30 DAY THEN 0.2 ELSE 0 END
    + CASE domain WHEN 'official.example' THEN 0.15 WHEN 'www.reddit.com' THEN 0.1 ELSE 0 END + 0.05)::DOUBLE AS score FROM g)
"""


@query(
    "search_candidates",
    f"""
    WITH {_CAND_SQL} SELECT 'search:' || substring(sha256(canon), 1, 20) AS candidate_id, canon AS canonical_url, pos, queries, providers, evidence_count, origin, round(score, 6) AS score,
      CASE WHEN score < 0.3 THEN 'skip_low_value' WHEN origin = 'first_party' THEN 'route_to_official_reconcile' WHEN origin = 'community' THEN 'route_to_social_reconcile' ELSE 'route_to_web_fetch' END AS route FROM sc
    """,
)
def search_candidates(spark, folder):
    c, _ = _candidates(spark, folder)
    return c.select(
        "candidate_id", "canonical_url", "pos", joined(F.col("matched_queries")).alias("queries"), joined(F.col("provider_hits")).alias("providers"), "evidence_count",
        F.col("likely_origin_type").alias("origin"), F.round("score", 6).alias("score"), "route",
    )


@query(
    "search_fetch_plans",
    f"WITH {_CAND_SQL} SELECT 'search:search:' || substring(sha256(canon), 1, 20) AS source_id, canon AS url, 'direct_html' AS mode FROM sc WHERE origin = 'external_web' AND score >= 0.3",
)
def search_fetch_plans(spark, folder):
    c, _ = _candidates(spark, folder)
    shared = common_candidates(c).filter("search_route = 'route_to_web_fetch'").select("source_id", "url")
    return fetch_plans(c).select("source_id", "url", "mode").join(shared, ["source_id", "url"], "left_semi")


@query(
    "search_traces",
    f"""
    WITH {_CAND_SQL} SELECT 'search:' || substring(sha256(canon), 1, 20) AS candidate_id, nq AS n_queries, evidence_count AS n_evidence FROM sc
    """,
)
def search_traces(spark, folder):
    c, r = _candidates(spark, folder)
    ev = provider_evidence(r).groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("pos", "provider", "rank", "title", "snippet"))).alias("ev"))
    payload = c.join(ev, "candidate_id").select("candidate_id", trace_payload(F.col("ev")).alias("t"))
    return payload.select(
        "candidate_id", big(F.json_array_length(F.get_json_object("t", "$.matched_queries"))).alias("n_queries"),
        big(F.json_array_length(F.get_json_object("t", "$.provider_evidence"))).alias("n_evidence"),
    )


@query(
    "search_fetch_records",
    f"""
    WITH {_CAND_SQL} SELECT 'search:' || substring(sha256(canon), 1, 20) AS candidate_id, CASE WHEN pos % 2 = 0 THEN 'record' ELSE 'error' END AS kind,
      CASE WHEN pos % 2 = 0 THEN canon || '#final' ELSE '500' END AS detail FROM sc WHERE origin = 'external_web' AND score >= 0.3
    """,
)
def search_fetch_records(spark, folder):
    c, _ = _candidates(spark, folder)
    ok = F.col("pos") % 2 == 0
    fetched = c.select(
        F.col("canonical_url").alias("url"), s(F.col("canonical_url"), "#final").alias("final_url"), ok.alias("success"), F.when(ok, 200).otherwise(500).alias("status_code"),
        F.lit("text/html").alias("content_type"), F.lit("body").alias("raw_text"), F.lit("").alias("error"),
    )
    good, bad = search_records(c, fetched)
    return good.select(F.substring("provider_id", 8, 100).alias("candidate_id"), F.lit("record").alias("kind"), F.col("url").alias("detail")).unionByName(
        bad.select(F.regexp_extract("error", r"^(.*):(.*)$", 1).alias("candidate_id"), F.lit("error").alias("kind"), F.regexp_extract("error", r"^(.*):(.*)$", 2).alias("detail"))
    )


def monitors(spark, folder) -> DataFrame:
    k, txt = F.col("c_custkey"), F.col("c_custkey").cast("string")
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    return table(spark, folder, "customer").select(
        s("m", txt).alias("monitor_id"), s("Topic ", txt).alias("topic"), (k % 10 != 0).alias("enabled"),
        F.when(k % 2 == 0, F.array(F.lit("brand_updates"), F.lit("brand_risk"), F.lit("competitor_tracking"))).when(k % 3 == 0, F.array(F.lit("product_updates"), F.lit("x"))).otherwise(none).alias("query_templates"),
        F.when(k % 4 == 0, F.array(F.lit("p1"), F.lit("p9"))).otherwise(none).alias("providers"), F.array(F.lit("outage"), F.lit("lawsuit")).alias("risk_terms"),
        F.array(s("Rival ", txt)).alias("competitors"), none.alias("products"),
    )


_MON_SQL = """
m AS (SELECT c_custkey AS k, 'm' || c_custkey AS mid, 'Topic ' || c_custkey AS t FROM customer),
q AS (SELECT k, mid, '"' || t || '" (announcement OR update OR roadmap)' AS text, 'brand_updates' AS intent FROM m WHERE k % 2 = 0 OR k % 3 <> 0
  UNION ALL SELECT k, mid, '"' || t || '" ("outage" OR "lawsuit")', 'brand_risk' FROM m WHERE k % 2 = 0
  UNION ALL SELECT k, mid, '"' || t || '" "Rival ' || k || '" (benchmark OR compare OR pricing)', 'competitor_tracking' FROM m WHERE k % 2 = 0
  UNION ALL SELECT k, mid, '"' || t || '" (release OR changelog OR launch)', 'product_updates' FROM m WHERE k % 2 = 1 AND k % 3 = 0
  UNION ALL SELECT k, mid, '"' || t || '"', 'fallback' FROM m WHERE k % 2 = 1 AND k % 3 = 0)
"""


@query("monitor_queries", f"WITH {_MON_SQL} SELECT mid || ':' || substring(sha256(mid || '|' || intent || '|' || text), 1, 16) AS query_id, mid AS monitor_id, text, intent FROM q")
def monitor_queries(spark, folder):
    return build_queries(monitors(spark, folder)).select("query_id", "monitor_id", "text", "intent")


def _providers(spark) -> DataFrame:
    return spark.range(4).select(
        s("p", F.col("id").cast("string")).alias("provider_id"), F.get(F.array(F.lit("newsapi"), F.lit("brave"), F.lit("tavily"), F.lit("brave")), F.col("id").cast("int")).alias("provider"),
        (F.col("id") != 3).alias("enabled"),
    )


@query(
    "planned_searches",
    f"""
    WITH {_MON_SQL}, pr AS (SELECT unnest(['p0', 'p1', 'p2']) AS provider_id)
    SELECT mid AS monitor_id, provider_id, count(*) AS n_queries FROM q CROSS JOIN pr WHERE k % 10 <> 0 AND (k % 4 <> 0 OR provider_id = 'p1') GROUP BY ALL
    """,
)
def planned_searches_query(spark, folder):
    m = monitors(spark, folder)
    pairs = monitor_providers(m, _providers(spark))
    return planned_searches(build_queries(m.filter("enabled")), pairs).groupBy("monitor_id", "provider_id").agg(F.count("*").alias("n_queries"))


@query(
    "search_run",
    f"""
    WITH {_MON_SQL}, r AS (SELECT mid, provider_id, k FROM q CROSS JOIN (SELECT unnest(['p0', 'p1', 'p2']) AS provider_id) WHERE k % 10 <> 0 AND (k % 4 <> 0 OR provider_id = 'p1')),
    g AS (SELECT k, count(*) AS evidence_count, count(DISTINCT provider_id) AS np, count(*) / count(DISTINCT provider_id) AS nq FROM r GROUP BY 1)
    SELECT 'https://site.example/' || k AS canonical_url, evidence_count, floor((least(0.35::DOUBLE, nq * 0.1::DOUBLE) + least(0.25::DOUBLE, np * 0.08::DOUBLE) + 0.05::DOUBLE) * 100)::BIGINT AS fetch_priority FROM g
    """,
)
def search_run(spark, folder):
    """One landed response per planned search, each with the monitor's own page."""
    ranked, _ = search_discovery(*search_inputs(spark, folder), F.lit("2024-01-01").cast("timestamp"), top=None, min_score=0.0)
    return ranked.select("canonical_url", "evidence_count", big(F.col("fetch_priority")).alias("fetch_priority"))


def search_inputs(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    m = monitors(spark, folder)
    plan = planned_searches(build_queries(m.filter("enabled")), monitor_providers(m, _providers(spark)))
    item = s('{"url":"https://site.example/', F.substring("monitor_id", 2, 20), '","title":"A longer title"}')
    body = F.when(F.col("provider") == "newsapi", s('{"articles":[', item, "]}")).when(F.col("provider") == "brave", s('{"web":{"results":[', item, "]}}")).otherwise(s('{"results":[', item, "]}"))
    domains = spark.range(1).select(F.lit("official.example").alias("domain"))
    return m, _providers(spark), plan.select("query_id", "provider_id", body.alias("body")), domains


# --- S12, S15, S16, P17, X19 ---------------------------------------------------------------------------------
@query(
    "raw_channels",
    """
    SELECT 'official' AS channel, 'official:' || s_suppkey AS provider_id, 'https://s/' || s_suppkey AS external_id, 'official:' || s_suppkey || ':https://s/' || s_suppkey AS idempotency_key FROM supplier
    UNION ALL SELECT 'pages', 'src' || page_id, url, 'focused:src' || page_id || ':' || substring(sha256(url), 1, 24) FROM pages
    """,
)
def raw_channels(spark, folder):
    k = F.col("s_suppkey").cast("string")
    official = official_records(table(spark, folder, "supplier").select(k.alias("source_id"), s("https://s/", k).alias("url"), F.lit("c").alias("company"), F.lit("rss").alias("transport")))
    docs = table(spark, folder, "pages").select(
        s("src", F.col("page_id").cast("string")).alias("source_id"), "url", F.col("url").alias("canonical_url"), F.lit("t").alias("title"), F.lit("").alias("content_text"),
        F.lit("short").alias("summary"), F.lit("web").alias("source_type"), F.lit(None).cast("string").alias("blocked_by"), F.lit("direct_html").alias("access_mode"), F.sha2("url", 256).alias("content_hash"),
    )
    return union_batches(official=official, pages=document_records(docs)).select("channel", "provider_id", "external_id", "idempotency_key")


@query(
    "stamped_candidates",
    "SELECT s_suppkey, (CASE WHEN s_suppkey % 2 = 0 THEN 90 ELSE 60 END + 6)::BIGINT AS priority, CASE WHEN s_suppkey % 5 = 0 THEN 'metadata_only' ELSE 'listing_only' END AS access FROM supplier",
)
def stamped_candidates(spark, folder):
    k = F.col("s_suppkey")
    sup = table(spark, folder, "supplier")
    src = sup.select(k.cast("string").alias("id"), F.when(k % 2 == 0, "high").otherwise("medium").alias("priority"), F.when(k % 5 == 0, "metadata_only").otherwise("listing_only").alias("access"))
    cand = sup.select(k.cast("string").alias("id"), s("https://x.example/news/", k.cast("string")).alias("url"))
    return stamp_candidates(cand, src).select(F.col("id").cast("bigint").alias("s_suppkey"), big(F.col("priority")).alias("priority"), "access")


def discovery_run(spark, folder) -> tuple[DataFrame, DataFrame]:
    return discover(*discovery_inputs(spark, folder), max_candidates=None)


def discovery_inputs(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Suppliers as sources with a feed, landed twice, a REST list and a listing page each; bodies from their parts."""
    k = F.col("s_suppkey").cast("string")
    sup = table(spark, folder, "supplier").select("s_suppkey", F.row_number().over(_by("s_nationkey", "s_suppkey")).alias("r"))
    sources = scan_sources(
        sup.groupBy(F.lit("acme").alias("company"), F.col("s_suppkey").alias("g")).agg(
            F.collect_list(F.struct(
                s("s", k).alias("id"), F.lit("newsroom").alias("type"), s("https://s", k, ".example/news").alias("url"), F.lit("high").alias("priority"),
                s("https://s", k, ".example/rss").alias("rss_url"), F.array(s("/n/", k)).alias("path_contains_any"), s("https://s", k, ".example/api").alias("api_list_url"),
                F.when(F.col("s_suppkey") % 2 == 0, "prefer_fallback").otherwise("combine").alias("transport_collection_mode"),
            )).alias("sources")
        )
    )
    rows = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("n")).distinct()
    lk = F.col("l_suppkey").cast("string")
    feeds = rows.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("n")).alias("ns")).select(
        s("https://s", lk, ".example/rss").alias("url"),
        s("<rss><channel>", F.array_join(F.transform("ns", lambda n: s("<item><title>t</title><link>https://s", lk, ".example/n/", n.cast("string"), "</link></item>")), ""), "</channel></rss>").alias("body"),
        s("https://s", lk, ".example/api").alias("api"),
        F.when(F.col("l_suppkey") % 3 == 0, s('{"items":[{"url":"/n/', F.get("ns", F.lit(0)).cast("string"), '","title":"a"}]}')).otherwise('{"items":[]}').alias("api_body"),
    )
    apis = feeds.select(F.col("api").alias("url"), F.col("api_body").alias("body"))
    none = feeds.select("url", "body").limit(0)
    return sources, feeds.select("url", "body").unionByName(feeds.select("url", "body")), none, apis


def _by(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


_DISC_SQL = """
l AS (SELECT DISTINCT l_suppkey AS k, l_orderkey AS n FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS place FROM l)
"""


@query(
    "official_discovery",
    f"""
    WITH {_DISC_SQL} SELECT 's' || k AS source_id, 'https://s' || k || '.example/n/' || n AS url, CASE WHEN place = 1 AND k % 3 = 0 THEN 'rest_api' ELSE 'rss' END AS transport, 'newsroom' AS source_type, '/n/' || k AS selectors FROM f WHERE k % 2 = 1 OR k % 3 <> 0 OR place = 1
    UNION ALL SELECT 's' || s_suppkey, 'https://s' || s_suppkey || '.example/news', 'html_listing', 'newsroom', '/n/' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 1
    """,
)
def official_discovery(spark, folder):
    return discovery_run(spark, folder)[0].select("source_id", "url", "transport", "source_type", joined(F.col("path_contains_any")).alias("selectors"))


@query(
    "discovery_report",
    """
    WITH s AS (SELECT 's' || s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 1 THEN 3 WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS attempted,
      CASE WHEN s_suppkey % 2 = 1 THEN (CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 2 END) ELSE 1 END AS succeeded FROM supplier)
    SELECT source_id, false AS of_all, attempted::BIGINT AS attempted, succeeded::BIGINT AS succeeded, 0::BIGINT AS errors FROM s UNION ALL SELECT NULL, true, sum(attempted), sum(succeeded), 0 FROM s
    """,
)
def discovery_report(spark, folder):
    return discovery_run(spark, folder)[1]


@query(
    "collected_records",
    f"""
    WITH {_DISC_SQL}, {_MON_SQL}, {_P}, off AS (
      SELECT 's' || k AS source_id, 'https://s' || k || '.example/n/' || n AS url FROM f WHERE k % 2 = 1 OR k % 3 <> 0 OR place = 1
      UNION ALL SELECT 's' || s_suppkey, 'https://s' || s_suppkey || '.example/news' FROM supplier WHERE s_suppkey % 2 = 1
      UNION ALL SELECT 's' || s_suppkey, 'https://s' || s_suppkey || '.example/n/' || s_suppkey || '/story-of-the-day' FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 5 <> 0),
    sites AS (SELECT DISTINCT k, 'https://site.example/' || k AS url FROM q WHERE k % 10 <> 0 AND k % 3 <> 0),
    every AS (
      SELECT 0 AS place, 'official' AS channel, 'official:' || source_id AS provider_id, url AS external_id, 'official:' || source_id || ':' || url AS idempotency_key FROM off
      UNION ALL SELECT CASE WHEN failed THEN 2 ELSE 1 END, CASE WHEN failed THEN 'social_fallback' ELSE 'social' END, 'social:sub' || page, 't3_' || o_orderkey, 'social:sub' || page || ':t3_' || o_orderkey
        FROM (SELECT page, o_orderkey, o_orderkey % 7 = 0 AND o_orderkey IN (SELECT conv_id FROM conversations) AS failed FROM p WHERE o_orderkey % 6 <> 0)
      UNION ALL SELECT 3, 'search', 'search:search:' || substring(sha256(url), 1, 20), url, 'search:search:' || substring(sha256(url), 1, 20) || ':' || url FROM sites)
    SELECT row_number() OVER (ORDER BY place, provider_id, external_id) - 1 AS pos, channel, provider_id, external_id, idempotency_key FROM every
    """,
)
def collected_records(spark, folder):
    """S16 fed by X19 with D5, X17 and X16 with S14: the raw table with which a five-layer run begins."""
    sources, feeds, maps, apis = discovery_inputs(spark, folder)
    k = F.col("s_suppkey").cast("string")
    html = s("<html><a href='/n/", k, "/story-of-the-day'>The story of the day</a><a href='/about'>About</a></html>")
    pages = table(spark, folder, "supplier").filter("s_suppkey % 5 <> 0").select(s("https://s", k, ".example/news").alias("url"), html.alias("raw_html"))
    m, providers, responses, domains = search_inputs(spark, folder)
    number = F.substring("monitor_id", 2, 20)
    fetched = m.select(
        s("https://site.example/", number).alias("url"), F.lit(None).cast("string").alias("final_url"), (number.cast("bigint") % 3 != 0).alias("success"),
        F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), s("Page of ", number).alias("raw_text"), F.lit(None).cast("string").alias("error"),
    ).distinct()
    out = collect_sources(
        Official(sources, feeds, maps, apis, pages), Social(*social_inputs(spark, folder)), Search(m, providers, responses, domains, fetched, 0.0),
        F.lit("2024-01-01").cast("timestamp"),
    )
    return out["raw"].select("pos", "channel", "provider_id", "external_id", "idempotency_key")
