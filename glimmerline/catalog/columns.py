"""Queries over the column functions: urls, text, arrays, hashes, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates, text, urls
from ..functions.arrays import (
    document_id, fill_missing, hash_id, jaccard, keyword_hits, lower_headers, ordered_distinct, overlap_size, overlay, union_size,
)
from ..functions.vocab import KEPT_HEADERS, RISK_WORDS, OPPORTUNITY_WORDS, TOKEN_STOPWORDS
from ..operators.ordering import first_seen_mode
from ..plans.stories import event_family, explicit_subject, infer_event_type, subject_of_source, subject_of_title, subject_of_urls
from ..sources.store import json_value, row_json
from .base import big, joined, query, table, text_of

_STOP = ",".join(f"'{w}'" for w in TOKEN_STOPWORDS)
# SQL pieces reused by several checks
SQL_NETLOC = "lower(regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
SQL_PATH = "regexp_replace(regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
SQL_CANON = """
lower(regexp_extract(trim({u}), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || """ + SQL_NETLOC + """ ||
CASE WHEN rtrim(""" + SQL_PATH + """, '/') = '' THEN '/' ELSE rtrim(""" + SQL_PATH + """, '/') END ||
coalesce('?' || nullif(list_aggregate(list_sort(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'),
  lambda p: regexp_matches(p, '^[^=]+=.') AND NOT regexp_matches(p, '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid)='))),
  'string_agg', '&'), ''), '')
"""


def sql_canon(u: str) -> str:
    return SQL_CANON.replace("{u}", u)


SQL_CLEAN = (
    "trim(regexp_replace(replace(replace(replace(replace(regexp_replace({h}, '<[^>]+>', ' ', 'g'), "
    "'&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g'))"
)
SQL_SPACE = "trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


@query("url_canonical", f"SELECT page_id, {sql_canon('url')} AS canonical_url FROM pages")
def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pages")
    return p.select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query(
    "url_parts",
    f"""
    WITH x AS (SELECT page_id, {SQL_NETLOC.format(u='url')} AS netloc, lower(rtrim({SQL_PATH.format(u='url')}, '/')) AS path FROM pages)
    SELECT page_id, netloc, path, list_extract(string_split(path, '/'), -1) AS slug FROM x
    """,
)
def url_parts(spark, folder):
    u = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", urls.netloc(u).alias("netloc"), urls.path(u).alias("path"), urls.slug(u).alias("slug")
    )


@query(
    "link_resolution",
    f"""
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href,
                      generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS item FROM pages)
    SELECT page_id, item::BIGINT AS item,
      lower(regexp_extract(url, '^([a-z]+):', 1)) || '://' || {SQL_NETLOC.format(u='url')} || href AS absolute,
      lower(regexp_extract(url, '^([a-z]+):', 1)) || '://' || {SQL_NETLOC.format(u='url')} ||
        regexp_replace({SQL_PATH.format(u='url')}, '[^/]*$', '') || 'p' || item AS sibling,
      lower(regexp_extract(url, '^([a-z]+):', 1)) || '://' || {SQL_NETLOC.format(u='url')} || '/q' AS climbed
    FROM l
    """,
)
def link_resolution(spark, folder):
    p = table(spark, folder, "pages").select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("item", "href")
    )
    u = F.col("url")
    return p.select(
        "page_id", big(F.col("item")).alias("item"), urls.resolve(u, F.col("href")).alias("absolute"),
        urls.resolve(u, F.concat(F.lit("./p"), F.col("item").cast("string"), F.lit("#x"))).alias("sibling"),
        urls.resolve(u, F.lit("../../.././q")).alias("climbed"),
    )


@query(
    "url_rules",
    f"""
    SELECT page_id,
      NOT regexp_matches(lower(url), '\\.(jpg|png|gif|svg|pdf|zip)$') AS allowed,
      {SQL_NETLOC.format(u='url')} = 'm.' || {SQL_NETLOC.format(u='url')} AS same_as_mobile,
      regexp_matches(lower(url), '/content-type/|/topic/|/category/|/tag/|/page/|/author/|/industry/blog|/blog/category/|/blog/page') AS aggregate_url,
      contains(lower({SQL_PATH.format(u='url')}), '/fr/') AS excluded,
      (CASE page_id % 4 WHEN 0 THEN 90 WHEN 1 THEN 60 WHEN 2 THEN 30 ELSE 50 END
        + CASE WHEN contains(lower(url), 'changelog') OR contains(lower(url), 'release') THEN 10 ELSE 0 END
        + CASE WHEN contains(lower(url), 'news') OR contains(lower(url), 'blog') THEN 6 ELSE 0 END)::BIGINT AS priority
    FROM pages
    """,
)
def url_rules(spark, folder):
    u = F.col("url")
    rank = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit("none")), (F.col("page_id") % 4).cast("int"))
    mobile = F.concat(F.lit("https://m."), urls.netloc(u), F.lit("/x"))
    return table(spark, folder, "pages").select(
        "page_id", urls.is_allowed(u).alias("allowed"), urls.same_site(u, mobile).alias("same_as_mobile"),
        urls.is_aggregate(u).alias("aggregate_url"), urls.path_excluded(u, F.array(F.lit("/FR/"))).alias("excluded"),
        big(urls.url_priority(u, rank)).alias("priority"),
    )


@query(
    "page_text",
    f"""
    SELECT page_id, length({SQL_CLEAN.format(h='html')}) AS n_chars, sha256({SQL_CLEAN.format(h='html')}) AS digest FROM pages
    """,
)
def page_text(spark, folder):
    c = text.clean_text(F.col("html"))
    return table(spark, folder, "pages").select("page_id", c.alias("c")).select(
        "page_id", big(F.length("c")).alias("n_chars"), F.sha2("c", 256).alias("digest")
    )


@query(
    "document_tokens",
    f"""
    SELECT doc_id, length({SQL_SPACE.format(t='text')}) AS n_chars,
      coalesce(list_aggregate(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')),
        lambda w: w NOT IN ({_STOP}))), 'string_agg', ' '), '') AS tokens
    FROM documents
    """,
)
def document_tokens(spark, folder):
    d = table(spark, folder, "documents")
    return d.select(
        "doc_id", big(F.length(text.squeeze(F.col("text")))).alias("n_chars"),
        joined(F.array_sort(text.tokens(F.col("text"))), " ").alias("tokens"),
    )


@query(
    "keyword_hits",
    "SELECT doc_id, " + ", ".join(
        "array_to_string(list_filter([" + ",".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in sorted(words))
        + f"], lambda x: x IS NOT NULL), '|') AS {name}" for name, words in (("risk", RISK_WORDS), ("opportunity", OPPORTUNITY_WORDS))
    ) + ", regexp_matches(lower(trim(text)), '^https?://') AS url_like FROM documents",
)
def keyword_hits_query(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", joined(keyword_hits(t, RISK_WORDS)).alias("risk"), joined(keyword_hits(t, OPPORTUNITY_WORDS)).alias("opportunity"),
        text.is_url_like(t).alias("url_like"),
    )


@query(
    "token_overlap",
    f"""
    WITH k AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: w NOT IN ({_STOP})) AS w FROM documents),
    p AS (SELECT a.doc_id, a.w AS x, b.w AS y FROM k a JOIN k b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, len(list_intersect(x, y))::BIGINT AS common, len(list_distinct(x || y))::BIGINT AS total,
      round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, 6) AS jaccard
    FROM p
    """,
)
def token_overlap(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(other, "doc_id").select(
        "doc_id", big(overlap_size(F.col("w"), F.col("v"))).alias("common"), big(union_size(F.col("w"), F.col("v"))).alias("total"),
        F.round(jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"),
    )


@query(
    "ordered_distinct_words",
    """
    WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
    f AS (SELECT conv_id, turn, w, min(i) AS i FROM w WHERE w <> '' GROUP BY ALL)
    SELECT c.conv_id, c.turn, coalesce(string_agg(f.w, ' ' ORDER BY f.i), '') AS words
    FROM conversations c LEFT JOIN f ON f.conv_id = c.conv_id AND f.turn = c.turn GROUP BY ALL
    """,
)
def ordered_distinct_words(spark, folder):
    c = table(spark, folder, "conversations")
    return c.select("conv_id", "turn", joined(ordered_distinct(F.split("text", " ")), " ").alias("words"))


_TITLES = ("Outage hits billing", "New partnership deal", "Benchmark race heats up", "Rollout of the preview", "A research paper", "Quiet day")


@query(
    "event_types",
    """
    WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Outage hits billing' WHEN 1 THEN 'New partnership deal'
      WHEN 2 THEN 'Benchmark race heats up' WHEN 3 THEN 'Rollout of the preview' WHEN 4 THEN 'A research paper' ELSE 'Quiet day' END AS title FROM orders),
    e AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'risk_event' WHEN 1 THEN 'opportunity_event' WHEN 2 THEN 'competition_event'
      WHEN 3 THEN 'adoption_event' WHEN 4 THEN 'research_publication' ELSE 'story_event' END AS event_type FROM t)
    SELECT o_orderkey, event_type, CASE o_orderkey % 6 WHEN 0 THEN 'risk' WHEN 1 THEN 'opportunity' WHEN 2 THEN 'competition'
      WHEN 3 THEN 'adoption' WHEN 4 THEN 'narrative' ELSE 'story' END AS family FROM e
    """,
)
def event_types(spark, folder):
    title = F.get(F.array(*[F.lit(t) for t in _TITLES]), (F.col("o_orderkey") % 6).cast("int"))
    o = table(spark, folder, "orders").select("o_orderkey", title.alias("title"))
    empty = F.expr("CAST(array() AS ARRAY<STRING>)")
    kind = infer_event_type(F.col("title"), F.array(F.lit("src_a")), empty, F.col("title"))
    return o.select("o_orderkey", kind.alias("event_type")).withColumn("family", event_family(F.col("event_type")))


_SOURCE_IDS = ("openai_news", "google_deepmind_blog", "acme_labs_feed", "ibm_research", "news_blog", "x_y_z")


@query(
    "subjects",
    """
    SELECT c_custkey,
      CASE c_custkey % 6 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Google' WHEN 2 THEN 'Acme Labs' WHEN 3 THEN 'IBM' WHEN 4 THEN 'News Blog' ELSE 'X Y' END AS by_source,
      CASE WHEN c_custkey % 2 = 0 THEN 'Mistral' END AS by_url,
      CASE WHEN c_custkey % 3 = 0 THEN 'Hugging Face' WHEN c_custkey % 3 = 1 THEN 'Big Co' END AS by_name,
      'Customer ' || regexp_extract(c_name, '[0-9]+') AS by_title
    FROM customer
    """,
)
def subjects(spark, folder):
    k = F.col("c_custkey")
    sid = F.get(F.array(*[F.lit(s) for s in _SOURCE_IDS]), (k % 6).cast("int"))
    link = F.when(k % 2 == 0, F.lit("https://docs.mistral.ai:443/x")).otherwise(F.lit("https://plain.example/x"))
    name = F.when(k % 3 == 0, F.lit(" HF ")).when(k % 3 == 1, F.lit("Big   Co")).otherwise(F.lit("Research"))
    return table(spark, folder, "customer").select(
        "c_custkey", subject_of_source(sid).alias("by_source"), subject_of_urls(F.array(link)).alias("by_url"),
        explicit_subject(name).alias("by_name"), subject_of_title(F.concat(F.lit("News: "), F.col("c_name"))).alias("by_title"),
    )


@query(
    "stable_ids",
    """
    WITH l AS (SELECT l_orderkey, list_sort(list('li_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey)) AS ids FROM lineitem GROUP BY 1)
    SELECT l_orderkey, 'tr_' || substring(sha256(array_to_string(ids, '|')), 1, 10) AS trend_id,
      substring(sha256('line:' || l_orderkey || ':https://x/' || l_orderkey), 1, 24) AS doc_id FROM l
    """,
)
def stable_ids(spark, folder):
    ids = F.concat_ws("_", F.lit("li"), "l_orderkey", "l_linenumber", "l_partkey")
    o = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(ids).alias("ids"))
    key = F.col("l_orderkey").cast("string")
    return o.select(
        "l_orderkey", hash_id("tr", F.col("ids")).alias("trend_id"),
        document_id(F.lit("line"), key, F.concat(F.lit("https://x/"), key)).alias("doc_id"),
    )


@query(
    "text_cuts",
    """
    SELECT doc_id, sha256(text) AS evidence_digest, coalesce(nullif(substring(text, 1, 80), ''), 'doc') AS title,
      CASE WHEN regexp_matches(substring(text, 1, 80), '[a-zA-Z]') THEN 'en' END AS language FROM documents
    """,
)
def text_cuts(spark, folder):
    t = F.col("text")
    title = text.event_title(text.evidence_text(t), F.lit("doc"))
    return table(spark, folder, "documents").select(
        "doc_id", F.sha2(text.evidence_text(t), 256).alias("evidence_digest"), title.alias("title"),
        text.language_guess(F.substring(t, 1, 80)).alias("language"),
    )


# --- dates ------------------------------------------------------------------------------------
@query(
    "iso_dates",
    """
    SELECT event_id, CASE event_id % 9
      WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')
      WHEN 2 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 3 THEN strftime(ts, '%Y-%m-%d 00:00:00')
      WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN 5 THEN strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S')
      WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:00:00') END AS parsed FROM events
    """,
)
def iso_dates(spark, folder):
    k, ts = F.col("event_id") % 9, F.col("ts")
    f = lambda p: F.date_format(ts, p)
    raw = (
        F.when(k == 0, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.concat(f("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00")))
        .when(k == 2, f("yyyy-MM-dd")).when(k == 3, f("yyyyMMdd")).when(k == 4, f("yyyy-MM-dd HH:mm"))
        .when(k == 5, F.concat(F.lit(" "), f("yyyy-MM-dd'T'HH:mm:ss,SSS"), F.lit("-0530"))).when(k == 6, f("yyyy-MM"))
        .when(k == 7, f("dd.MM.yyyy")).otherwise(f("yyyy-MM-dd'T'HH"))
    )
    return table(spark, folder, "events").select("event_id", text_of(dates.parse_iso(raw)).alias("parsed"))


@query(
    "feed_dates",
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S')
      WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:00') ELSE NULL END AS parsed,
      strftime(ts::DATE + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS from_title, strftime(ts::DATE, '%Y-%m-%d %H:%M:%S') AS from_log FROM events
    """,
)
def feed_dates(spark, folder):
    k, ts = F.col("event_id") % 4, F.col("ts")
    f = lambda p: F.date_format(ts, p)
    raw = (
        F.when(k == 0, f("EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 1, f("d MMM yyyy HH:mm:ss '-0500'"))
        .when(k == 2, f("EEE, d MMM yyyy HH:mm '+0000'")).otherwise(F.lit("soon"))
    )
    title = F.concat(F.lit("Post of "), f("MMM d, yyyy"), F.lit(" in short"))
    log = F.concat(F.lit("Changes\n\n"), F.when(k < 2, f("yyyy-MM-dd")).otherwise(f("MMMM d, yyyy")), F.lit(": first entry\n2001-01-01: old"))
    return table(spark, folder, "events").select(
        "event_id", text_of(dates.parse_feed_date(raw)).alias("parsed"), text_of(dates.parse_title_date(title)).alias("from_title"),
        text_of(dates.parse_changelog_date(log)).alias("from_log"),
    )


@query(
    "epoch_times",
    """
    SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events
    """,
)
def epoch_times(spark, folder):
    k = F.col("event_id") % 3
    at = F.col("ts").cast("timestamp")
    raw = F.when(k == 0, F.unix_seconds(at).cast("string")).when(k == 1, F.unix_millis(at).cast("string")).otherwise("n/a")
    return table(spark, folder, "events").select("event_id", text_of(dates.from_epoch(raw)).alias("parsed"))


@query(
    "activity_windows",
    """
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
      greatest(1, count(DISTINCT strftime(ts, '%Y-%m-%d')))::BIGINT AS span_days,
      count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS in_7d, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR) AS in_36h
    FROM events GROUP BY 1
    """,
)
def activity_windows(spark, folder):
    now = F.lit("2024-01-31").cast("timestamp")
    within = lambda w: F.count_if(F.col("ts") >= dates.window_cutoff(F.lit(w), now))
    return table(spark, folder, "events").groupBy("user_id").agg(
        text_of(F.min("ts")).alias("first_seen"), text_of(F.max("ts")).alias("last_seen"),
        big(F.greatest(F.lit(1), F.count_distinct(dates.day_bucket(F.col("ts"))))).alias("span_days"),
        within("7d").alias("in_7d"), within("36h").alias("in_36h"),
    )


# --- json, maps, mode -------------------------------------------------------------------------
@query(
    "json_paths",
    """
    SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k, 'user ' || user_id || ' ' || event_type AS round_trip FROM events
    """,
)
def json_paths(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", "props")
    doc = row_json(e)
    return e.withColumn("doc", doc).select(
        "event_id", json_value(F.col("props"), "$.k").cast("bigint").alias("k"),
        F.concat(F.lit("user "), json_value(F.col("doc"), "$.user_id"), F.lit(" "), json_value(F.col("doc"), "$.event_type")).alias("round_trip"),
    )


@query(
    "metadata_maps",
    """
    SELECT o_orderkey, 'cf-ray=' || o_custkey || '|server=' || lower(o_orderpriority) AS headers,
      'a=' || o_orderkey || '|b=2|c=3' AS overlay, 'a=1|b=' || o_orderkey || '|c=3' AS filled FROM orders
    """,
)
def metadata_maps(spark, folder):
    key = F.col("o_orderkey").cast("string")
    raw = F.create_map(
        F.lit("Server"), F.lower("o_orderpriority"), F.lit("CF-Ray"), F.col("o_custkey").cast("string"), F.lit("X-Other"), F.lit("1")
    )
    shown = lambda m: joined(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("c"), F.lit("3"))
    return table(spark, folder, "orders").select(
        "o_orderkey", shown(lower_headers(raw, KEPT_HEADERS)).alias("headers"),
        shown(overlay(base, F.create_map(F.lit("a"), key, F.lit("b"), F.lit("2")))).alias("overlay"),
        shown(fill_missing(base, F.create_map(F.lit("a"), F.lit("9"), F.lit("b"), key))).alias("filled"),
    )


@query(
    "first_seen_mode",
    """
    WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL)
    SELECT o_custkey, o_orderpriority FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) = 1
    """,
)
def first_seen_mode_query(spark, folder):
    return first_seen_mode(table(spark, folder, "orders"), ["o_custkey"], "o_orderpriority", F.col("o_orderkey"))
