"""Queries over the evidence, story, finding and decision layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import urls
from ..functions.arrays import short_hash
from ..functions.vocab import FINDING_ACTIONS, FINDING_LABELS, TREND_LABELS
from ..operators.components import connected_components
from ..operators.dedup import document_keys, drop_seen, greedy_dedup, idempotency_key, keep_first, keep_last
from ..plans.decisions import (
    brief_support, build_briefs, build_recommendations, build_sections, build_signals, decision_counts, finding_records,
    recommendation_order,
)
from ..plans.evidence import build_documents, build_events, build_evidence, build_links
from ..plans.findings import build_alerts, build_briefing_items, build_findings, build_trends, finding_order
from ..plans.run import run_layers
from ..plans.stories import event_profiles
from .base import big, joined, query, table, text_of

_LAYERS: dict[tuple, dict[str, DataFrame]] = {}


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """The documents table as raw records: provider, url, publication day."""
    d = table(spark, folder, "documents")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
    return d.select(
        F.col("doc_id").alias("pos"), F.col("source").alias("provider_id"), F.col("doc_id").cast("string").alias("external_id"),
        "text", F.col("lang").alias("language"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/item-"), short_hash(F.col("text"), 12)).alias("url"), day.alias("published_at"),
        F.substring("text", 1, 60).alias("title"),
    )


def layers(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All layers of a run over the documents; built once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LAYERS:
        _LAYERS[key] = run_layers(raw_records(spark, folder))
    return _LAYERS[key]


_RAW_SQL = """
r AS (SELECT doc_id AS pos, source AS provider, text, lang, 'https://' || source || '.example.com/' || lang || '/item-' || substring(sha256(text), 1, 12) AS url,
             strftime(DATE '2024-01-01' + (doc_id % 30)::INT, '%Y-%m-%d') AS day,
             substring(sha256(source || ':' || doc_id || ':https://' || source || '.example.com/' || lang || '/item-' || substring(sha256(text), 1, 12)), 1, 24) AS doc FROM documents)
"""


@query(
    "evidence_documents",
    f"""
    WITH {_RAW_SQL} SELECT pos, doc AS doc_id, provider AS source_id, 'unknown' AS origin_type, url AS canonical_url,
      day || ' 00:00:00' AS published_at, lang AS language, sha256(CASE WHEN text <> '' THEN text ELSE url END) AS fingerprint FROM r
    """,
)
def evidence_documents(spark, folder):
    return build_documents(raw_records(spark, folder)).select(
        "pos", "doc_id", "source_id", "origin_type", "canonical_url", text_of(F.col("published_at")).alias("published_at"), "language", "fingerprint"
    )


@query(
    "evidence_rows",
    f"""
    WITH {_RAW_SQL} SELECT pos, 'evi_' || doc AS evidence_id, doc AS doc_id, provider AS source_id, provider || '/' || pos AS trace,
      length(text) AS n_chars FROM r
    """,
)
def evidence_rows(spark, folder):
    return build_evidence(raw_records(spark, folder)).select(
        "pos", "evidence_id", "doc_id", "source_id",
        F.concat_ws("/", "source_trace.provider_id", "source_trace.external_id").alias("trace"), big(F.length("text")).alias("n_chars"),
    )


@query(
    "events_and_links",
    f"""
    WITH {_RAW_SQL}, n AS (SELECT *, 'evt_' || row_number() OVER (ORDER BY pos) AS event_id FROM r)
    SELECT event_id, coalesce(nullif(substring(text, 1, 80), ''), doc) AS title, provider AS source_id,
      'link_' || event_id || '_evi_' || doc AS link_id, 0.7::DOUBLE AS support_strength FROM n
    """,
)
def events_and_links(spark, folder):
    e = build_events(build_evidence(raw_records(spark, folder)))
    links = build_links(e).select("event_id", "link_id", "support_strength")
    return e.select("event_id", "title", "source_id").join(links, "event_id")


@query(
    "event_profiles",
    f"""
    WITH {_RAW_SQL}, n AS (SELECT *, 'evt_' || row_number() OVER (ORDER BY pos) AS event_id,
        trim(regexp_replace(coalesce(nullif(substring(text, 1, 80), ''), doc), '\\s+', ' ', 'g')) AS title FROM r)
    SELECT event_id, title, upper(substring(provider, 1, 1)) || substring(provider, 2) AS subject, lower(provider) AS subject_key,
      url AS canonical_urls, 'evi_' || doc AS evidence_ids, doc AS doc_ids, day AS day_bucket, 0.5::DOUBLE AS significance_score, 0.45::DOUBLE AS confidence,
      CASE WHEN x.risk THEN 'risk_event' WHEN x.opp THEN 'opportunity_event' WHEN x.comp THEN 'competition_event'
           WHEN x.adopt THEN 'adoption_event' WHEN x.research THEN 'research_publication' ELSE 'story_event' END AS event_type
    FROM n, LATERAL (SELECT lower(title || ' ' || provider || ' ' || url || ' ' || coalesce(nullif(substring(text, 1, 60), ''), url)) AS t) y, LATERAL (SELECT
      regexp_matches(y.t, 'outage|incident|breach|lawsuit|ban|fine|regulation|regulatory|security|safety|privacy|recall|vulnerability|cve|investigation') AS risk,
      regexp_matches(y.t, 'funding|partnership|partner|deal|acquisition|invest|investment|raised|expansion|win') AS opp,
      regexp_matches(y.t, 'benchmark|benchmarks|leaderboard|compare|comparison|competitor|competition|versus|vs|race|outperform|market-share') AS comp,
      regexp_matches(y.t, 'launch|launched|release|released|rollout|rolls|adoption|integrat|deploy|usage|preview|changelog') AS adopt,
      regexp_matches(y.t, 'research|paper|benchmark|analysis') AS research) x
    """,
)
def event_profiles_query(spark, folder):
    raw = raw_records(spark, folder)
    docs, ev = build_documents(raw), build_evidence(raw)
    p = event_profiles(build_events(ev), ev, docs)
    return p.select(
        "event_id", "title", "subject", "subject_key", joined(F.col("canonical_urls")).alias("canonical_urls"),
        joined(F.col("evidence_ids")).alias("evidence_ids"), joined(F.col("doc_ids")).alias("doc_ids"), "day_bucket",
        "significance_score", "confidence", "event_type",
    )


@query("top_findings")
def top_findings(spark, folder):
    """Flagship: raw records to ranked findings."""
    f = layers(spark, folder)["intelligence_findings"]
    return f.select("finding_id", "finding_type", "subject", "title", "importance_score", "decision_relevance_score", "confidence").orderBy(
        *finding_order()
    ).limit(20)


@query("story_trends")
def story_trends(spark, folder):
    t = layers(spark, folder)["trend_signals"]
    return t.select(
        "trend_id", "title", "subject", "theme", "trend_type", "direction", "strength_score", "novelty_score", "corroboration_score",
        "confidence", "event_count", "evidence_count", "document_count", joined(F.col("merge_reasons")).alias("merge_reasons"),
        joined(F.col("event_ids")).alias("event_ids"), text_of(F.col("window_start")).alias("window_start"),
        text_of(F.col("window_end")).alias("window_end"), "span_days", "why_it_matters",
    )


@query("story_recommendations")
def story_recommendations(spark, folder):
    r = layers(spark, folder)["recommendation_items"]
    return r.select("recommendation_id", "signal_id", "recommended_action", "theme", "priority", "rationale", "why_now",
                    "consolidated_finding_count").orderBy(*[F.desc("priority"), "recommendation_id"])


@query("story_briefs")
def story_briefs(spark, folder):
    b = layers(spark, folder)["decision_briefs"]
    return b.select("brief_id", "brief_type", "title", "summary", "narrative", joined(F.col("top_watch_items")).alias("watch"), "section_count")


@query(
    "document_dedup",
    f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id,
        'u' || lang || n_chars AS k1, 'h' || substring(sha256(text), 1, 16) AS k2,
        CASE WHEN trim(lower(substring(text, 1, 30))) <> '' THEN 't' || trim(lower(substring(text, 1, 30))) || (doc_id % 3) END AS k3 FROM documents),
    s AS (SELECT 0::BIGINT AS i, -1::BIGINT AS doc_id, false AS kept, ['']::VARCHAR[] AS seen
      UNION ALL
      SELECT d.i, d.doc_id, NOT list_has_any(s.seen, [k1, k2, coalesce(k3, '-')]),
        CASE WHEN list_has_any(s.seen, [k1, k2, coalesce(k3, '-')]) THEN s.seen ELSE s.seen || [k1, k2] || (CASE WHEN k3 IS NULL THEN [] ELSE [k3] END) END
      FROM s JOIN d ON d.i = s.i + 1)
    SELECT doc_id FROM s WHERE kept
    """,
)
def document_dedup(spark, folder):
    """D2 on url, hash and title with day; many documents share one of them."""
    d = table(spark, folder, "documents").select(
        "doc_id", F.format_string("https://x.example.com/%s/%d", "lang", "n_chars").alias("url"), F.sha2("text", 256).alias("hash"),
        F.substring("text", 1, 30).alias("title"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 3).cast("int")).alias("day"),
    )
    keys = document_keys(F.col("url"), F.col("hash"), F.col("title"), F.col("day"))
    return greedy_dedup(d, "doc_id", keys).select("doc_id")


@query(
    "copy_components",
    """
    WITH RECURSIVE k AS (SELECT doc_id, unnest(['h' || sha256(text), 'n' || lang || n_chars]) AS key FROM documents),
    e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b USING (key) WHERE a.doc_id <> b.doc_id),
    r AS (SELECT DISTINCT x AS node, x AS label FROM e UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.node)
    SELECT node, min(label) AS component FROM r GROUP BY 1
    """,
)
def copy_components(spark, folder):
    """D9 over documents linked by equal text or equal language and length."""
    d = table(spark, folder, "documents")
    keys = d.select(
        "doc_id",
        F.explode(F.array(F.concat(F.lit("h"), F.sha2("text", 256)), F.concat(F.lit("n"), "lang", F.col("n_chars").cast("string")))).alias("key"),
    )
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    edges = keys.join(heads, "key").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    return connected_components(edges)


# --- a whole run over texts that are equal or share no letter ------------------------------------
_PLACES = ("north", "south", "west", "hill", "lake", "moor", "dune", "reef")


def alike_records(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as raw records. Thirty in a row share a text of one letter, of a large alphabet; families and days take turns."""
    k = F.col("c_custkey")
    text = F.repeat(F.decode(F.unhex(_utf8_hex(19968 + F.floor(k / 30) % 20000)), "UTF-8"), 12)
    path = F.when(k % 3 == 0, "outage-").when(k % 3 == 1, "launch-").otherwise("k")
    source = F.get(F.array(*[F.lit(x) for x in _PLACES]), (k % 8).cast("int"))
    return table(spark, folder, "customer").select(
        k.alias("pos"), source.alias("provider_id"), k.cast("string").alias("external_id"), text.alias("text"), text.alias("title"),
        F.concat(F.lit("https://"), source, F.lit(".example.com/"), path, k.cast("string")).alias("url"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 4).cast("int")), "yyyy-MM-dd").alias("published_at"),
    )


def _utf8_hex(code):
    """Hex digits of the three UTF-8 bytes of a code point from 0x800 to 0xFFFF."""
    return F.hex(
        (F.lit(0xE08080) + F.floor(code / 4096) * 65536 + F.floor(code / 64) % 64 * 256 + code % 64).cast("long")
    )


def alike_layers(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, folder, "alike")
    if key not in _LAYERS:
        _LAYERS[key] = run_layers(alike_records(spark, folder))
    return _LAYERS[key]


def _cases(of: str, texts: dict[str, str]) -> str:
    return f"CASE {of} " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in texts.items()) + " END"


_ALIKE_SQL = f"""
c AS (SELECT c_custkey AS k, 'evt_' || row_number() OVER (ORDER BY c_custkey) AS id, repeat(chr((19968 + c_custkey // 30 % 20000)::INT), 12) AS w,
  {list(_PLACES)}[(c_custkey % 8 + 1)::INT] AS src, c_custkey % 3 AS f, c_custkey % 4 AS d FROM customer),
same AS (SELECT w, f, d, min([x.id, y.id]) AS two FROM c x JOIN c y USING (w, f, d, src) WHERE x.id < y.id GROUP BY ALL),
subj AS (SELECT w, f, d, src FROM (SELECT w, f, d, src, count(*) AS n, min(id) AS a FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY w, f, d ORDER BY n DESC, a) = 1),
g AS (SELECT w, f, d, count(*) AS n, count(DISTINCT src) AS s, list(id ORDER BY id) AS ids FROM c GROUP BY ALL),
x AS (SELECT g.*, upper(src[1]) || src[2:] AS subject, ['risk', 'adoption', 'story'][f + 1] AS fam,
  CASE WHEN n = 1 THEN [] WHEN two IS NULL THEN ['title/summary similarity'] WHEN two = ids[1:2] THEN ['same subject + same time window', 'title/summary similarity']
    ELSE ['title/summary similarity', 'same subject + same time window'] END AS reasons,
  (0.3 + 0.1 * least(s, 3) + 0.05 * (n - 1))::DOUBLE AS strength, (0.4 + 0.05 * least(s, 3) + 0.14 * (n - 1))::DOUBLE AS corr,
  (0.445 + 0.16 * (f = 1)::INT + 0.08 * (n = 1)::INT)::DOUBLE AS nov, (0.45 + 0.1 * least(n - 1, 2))::DOUBLE AS cf
  FROM g JOIN subj USING (w, f, d) LEFT JOIN same USING (w, f, d)),
t AS (SELECT *, CASE f WHEN 0 THEN 'risk_cluster' WHEN 1 THEN 'adoption_cluster' ELSE CASE WHEN n > 1 AND corr >= 0.52 THEN 'momentum_cluster' ELSE 'narrative_cluster' END END AS trend_type,
  CASE WHEN n >= 3 OR (n >= 2 AND nov >= 0.58 AND corr >= 0.5) THEN 'accelerating' WHEN nov >= 0.55 THEN 'emerging' ELSE 'stable' END AS direction,
  'tr_' || substring(sha256(array_to_string(list_sort(ids), '|')), 1, 10) AS trend_id FROM x)
"""


@query(
    "alike_stories",
    f"""
    WITH {_ALIKE_SQL} SELECT trend_id, w AS title, w || ' (' || n || ' event(s), ' || n || ' evidence item(s)).' AS summary, subject,
      subject || ' ' || {_cases("trend_type", TREND_LABELS)} AS theme, trend_type, direction, round(strength, 3) AS strength_score,
      round(corr, 3) AS corroboration_score, round(nov, 3) AS novelty_score, round(cf, 3) AS confidence, array_to_string(ids, '|') AS event_ids,
      array_to_string(reasons, '|') AS merge_reasons, '2024-01-0' || (d + 1) || ' 00:00:00' AS window_start,
      subject || ' has ' || n || ' related event(s) grouped into a single story. Corroboration is ' || round(corr::DECIMAL(10,6), 2)::DECIMAL(10,2) || ' across ' || n || ' document(s) and '
        || n || ' evidence item(s); novelty is ' || round(nov::DECIMAL(10,6), 2)::DECIMAL(10,2) || ' and the story direction is ' || direction || '.' AS why_it_matters,
      CASE WHEN n = 1 THEN 'Single event retained as its own trend because no strong merge signals were present.' ELSE
        'Merged ' || n || ' related events into one trend.|Grouping signals: ' || array_to_string(reasons, ', ') || '.|Story is supported by ' || n || ' canonical document(s).'
        || CASE WHEN s > 1 THEN '|Coverage spans ' || s || ' distinct source(s).' ELSE '' END END AS explain FROM t
    """,
)
def alike_stories(spark, folder):
    """A run from raw records to trends, with members in order and all texts."""
    t = alike_layers(spark, folder)["trend_signals"]
    return t.select(
        "trend_id", "title", "summary", "subject", "theme", "trend_type", "direction", "strength_score", "corroboration_score", "novelty_score", "confidence",
        joined(F.col("event_ids")).alias("event_ids"), joined(F.col("merge_reasons")).alias("merge_reasons"), text_of(F.col("window_start")).alias("window_start"),
        "why_it_matters", joined(F.col("explain")).alias("explain"),
    )


_ALIKE_FINDINGS_SQL = f"""
    {_ALIKE_SQL}, sc AS (SELECT *, f = 1 AS ad, round(corr, 3) >= 0.5 AS firm, round(nov, 3) >= 0.58 AS fresh FROM t),
    r AS (SELECT *, [{{'s': 0.08 + 0.18 * (f = 0)::INT, 'k': 'risk_signal'}}, {{'s': 0.08 + 0.08 * (fresh AND NOT ad)::INT - 0.04 * ad::INT, 'k': 'opportunity_signal'}},
      {{'s': -0.05, 'k': 'competition_signal'}}, {{'s': 0.08 + 0.76 * ad::INT, 'k': 'adoption_signal'}},
      {{'s': 0.18 + 0.44 * (trend_type = 'narrative_cluster')::INT + 0.06 * firm::INT + 0.05 * fresh::INT, 'k': 'narrative_shift'}},
      {{'s': 0.15 + 0.18 * (n > 1)::INT + 0.18 * firm::INT + 0.12 * fresh::INT + 0.16 * (trend_type = 'momentum_cluster')::INT, 'k': 'momentum_signal'}}] AS l FROM sc),
    b AS (SELECT *, list_max(l) AS best, greatest(l[1].s, l[2].s, l[4].s) AS cue FROM r),
    i AS (SELECT *, CASE WHEN best.s < 0.4 THEN (CASE WHEN n > 1 THEN 'momentum_signal' ELSE 'narrative_shift' END) ELSE best.k END AS kind,
      least(1, 0.43 + 0.18 * round(corr, 3) + 0.12 * best.s + 0.06 * least(n - 1, 2))::DOUBLE AS imp FROM b),
    fd AS (SELECT *, round(imp, 3) AS importance_score, round(least(1, 0.4 * imp + 0.22 * cue + 0.06)::DOUBLE, 3) AS decision_relevance_score FROM i)
"""


@query(
    "alike_findings",
    f"""
    WITH {_ALIKE_FINDINGS_SQL}
    SELECT 'fd_' || substring(sha256(array_to_string(list_sort([trend_id, kind]), '|')), 1, 10) AS finding_id, kind AS finding_type,
      {_cases("kind", FINDING_LABELS)} || ' — ' || w AS title, subject, importance_score, decision_relevance_score,
      {_cases("kind", {k: "|".join(v) for k, v in FINDING_ACTIONS.items()})} AS actions,
      {_cases("kind", FINDING_LABELS)} || CASE kind WHEN 'risk_signal' THEN ' for ' || subject || ': ' || w || ' (' || n || ' related event(s)).'
        WHEN 'adoption_signal' THEN ' for ' || subject || ': rollout or customer uptake is becoming visible.' WHEN 'momentum_signal' THEN ': repeated related events suggest this story is gaining traction.'
        ELSE ': this story is shaping the surrounding narrative for ' || subject || '.' END AS summary FROM fd
    """,
)
def alike_findings(spark, folder):
    """The findings of the same run, with their texts and actions."""
    f = alike_layers(spark, folder)["intelligence_findings"]
    return f.select(
        "finding_id", "finding_type", "title", "subject", "importance_score", "decision_relevance_score",
        joined(F.col("recommended_actions")).alias("actions"), "summary",
    )


@query(
    "intelligence_counts",
    f"""
    WITH {_ALIKE_FINDINGS_SQL}, a AS (SELECT count(*) FILTER (importance_score >= 0.58 OR decision_relevance_score >= 0.52) AS n, count(*) AS m FROM fd)
    SELECT (SELECT count(*) FROM customer) AS input_events, m AS trends, m AS findings, greatest(n, least(m, 1)) AS alerts, least(m, 3) AS briefing_items,
      (SELECT count(*) FROM customer) - m AS merged_events FROM a
    """,
)
def intelligence_counts(spark, folder):
    """A13, the intelligence half."""
    return alike_layers(spark, folder)["intelligence_counts"].select("input_events", "trends", "findings", "alerts", "briefing_items", "merged_events")


# --- scored stories over the star tables ----------------------------------------------------
_PROFILE_SQL = """
o AS (SELECT *, round(0.40123 + ((o_custkey * 7 + o_orderkey) % 60) / 103.0::DOUBLE, 6) AS sig, 0.45 AS conf,
  ['risk', 'opportunity', 'competition', 'adoption', 'narrative', 'story'][(o_orderkey % 6 + 1)::INT] AS fam,
  CASE WHEN o_orderkey % 11 = 0 THEN ['w1', 'w2'] WHEN o_orderkey % 7 = 0 THEN ['w1'] ELSE [] END AS watch,
  CASE WHEN o_orderkey % 9 = 0 THEN ['ai:model_release'] WHEN o_orderkey % 13 = 0 THEN ['ai:risk'] ELSE [] END AS topics,
  o_orderkey % 10 = 0 AS risky, o_orderkey % 8 = 0 AS lucky FROM orders)
"""
_TREND_SQL = f"""
{_PROFILE_SQL},
m AS (SELECT o_custkey, fam, count(*) AS c, min(struct_pack(s := -sig, id := 'evt_' || o_orderkey)) AS f FROM o GROUP BY ALL),
mode AS (SELECT o_custkey, fam FROM m QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, f) = 1),
t AS (SELECT o_custkey, count(*) AS n, sum(sig::DECIMAL(20,10))::DOUBLE / count(*) AS sig, 0.45::DOUBLE AS conf,
  count(DISTINCT o_orderkey % 5) AS s, count(DISTINCT o_orderkey % 50) AS d, bool_or(fam IN ('adoption', 'competition')) AS moving,
  bool_or(o_orderkey % 4 = 0) AS has_url, bool_or(risky) AS risky, bool_or(lucky) AS lucky,
  len(list_distinct(flatten(list(watch)))) AS nw, len(list_distinct(flatten(list(topics)))) AS nt,
  bool_or(o_orderkey % 9 = 0) AS release, bool_or(o_orderkey % 9 <> 0 AND o_orderkey % 13 = 0) AS risk_topic FROM o GROUP BY 1),
x AS (SELECT t.*, mode.fam,
  least(1, greatest(0, 0.3 + 0.1 * least(s, 3) + 0.05 * (n - 1) + 0.15 * greatest(sig - 0.5, 0)))::DOUBLE AS strength,
  least(1, greatest(0, 0.4 + 0.05 * least(s, 3) + 0.08 * (d - 1) + 0.06 * (n - 1)))::DOUBLE AS corr,
  least(1, greatest(0, 0.32 + 0.16 * (risky OR lucky OR moving)::INT + 0.12 * has_url::INT + 0.1 * greatest(sig - 0.45, 0) + 0.08 * (n = 1)::INT))::DOUBLE AS nov,
  least(0.95, greatest(0.35, conf + 0.05 * least(d - 1, 2) + 0.05 * least(n - 1, 2)))::DOUBLE AS cf
  FROM t JOIN mode USING (o_custkey)),
y AS (SELECT *, CASE WHEN risky OR fam = 'risk' OR risk_topic THEN 'risk_cluster' WHEN fam = 'adoption' OR release THEN 'adoption_cluster'
   WHEN lucky OR fam = 'opportunity' THEN 'opportunity_cluster' WHEN nw >= 2 OR fam = 'competition' THEN 'competition_cluster'
   WHEN n > 1 AND corr >= 0.52 THEN 'momentum_cluster' ELSE 'narrative_cluster' END AS trend_type,
   CASE WHEN n >= 3 OR (n >= 2 AND nov >= 0.58 AND corr >= 0.5) THEN 'accelerating' WHEN nov >= 0.55 THEN 'emerging' ELSE 'stable' END AS direction,
   nw >= 2 OR fam = 'competition' AS comp, fam = 'adoption' OR release AS adopt FROM x)
"""


def order_profiles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as event profiles and customers as stories."""
    o, k = table(spark, folder, "orders"), F.col("o_orderkey")
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    families = F.array(*[F.lit(x) for x in ("risk", "opportunity", "competition", "adoption", "narrative", "story")])
    words = F.concat(F.lit("Item "), k.cast("string"))
    profiles = o.select(
        name("evt_", k).alias("event_id"), k.alias("pos"), "o_custkey",
        F.round(0.40123 + (F.col("o_custkey") * 7 + k) % 60 / 103.0, 6).alias("significance_score"), F.lit(0.45).alias("confidence"),
        words.alias("display_title"), words.alias("similarity_text"), F.lit("story_event").alias("event_type"),
        F.get(families, (k % 6).cast("int")).alias("event_family"), name("Customer ", F.col("o_custkey")).alias("subject"),
        F.array(name("s_", k % 5)).alias("source_ids"), F.array(name("evi_", k)).alias("evidence_ids"),
        F.array(name("d_", k % 50)).alias("doc_ids"),
        F.when(k % 4 == 0, F.array(name("https://x.example/", k))).otherwise(none).alias("canonical_urls"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_bucket"),
        F.when(k % 11 == 0, F.array(F.lit("w1"), F.lit("w2"))).when(k % 7 == 0, F.array(F.lit("w1"))).otherwise(none).alias("watchlist_hits"),
        F.when(k % 9 == 0, F.array(F.lit("ai:model_release"))).when(k % 13 == 0, F.array(F.lit("ai:risk"))).otherwise(none).alias("topic_hits"),
        F.when(k % 10 == 0, F.array(F.lit("outage"))).otherwise(none).alias("risk_keyword_hits"),
        F.when(k % 8 == 0, F.array(F.lit("deal"))).otherwise(none).alias("opportunity_keyword_hits"),
    )
    membership = profiles.select("event_id", F.col("o_custkey").cast("string").alias("component"))
    reasons = membership.select("component").limit(0).withColumn("merge_reasons", none)
    return profiles.drop("o_custkey"), membership, reasons


@query(
    "trend_scoring",
    f"""
    WITH {_TREND_SQL} SELECT 'Customer ' || o_custkey AS subject, n::BIGINT AS event_count, d::BIGINT AS document_count, fam AS event_family, trend_type, direction,
      round(strength, 3) AS strength_score, round(corr, 3) AS corroboration_score, round(nov, 3) AS novelty_score, round(cf, 3) AS confidence FROM y
    """,
)
def trend_scoring(spark, folder):
    return build_trends(*order_profiles(spark, folder)).select(
        "subject", big(F.col("event_count")).alias("event_count"), big(F.col("document_count")).alias("document_count"), "event_family",
        "trend_type", "direction", "strength_score", "corroboration_score", "novelty_score", "confidence",
    )


_ROUTE_SQL = f"""
{_TREND_SQL},
z AS (SELECT *, round(corr, 3) >= 0.5 AS firm, round(nov, 3) >= 0.58 AS fresh, round(sig, 3) >= 0.65 AS big,
  nw > 0 AND NOT comp AS watch, risky OR risk_topic AS rk FROM y),
sc AS (SELECT *,
  0.08 + 0.52 * rk::INT + 0.1 * big::INT + 0.03 * watch::INT + 0.18 * (trend_type = 'risk_cluster')::INT AS r,
  0.08 + 0.52 * lucky::INT + 0.08 * (fresh AND NOT adopt)::INT + 0.1 * big::INT + 0.03 * watch::INT + 0.18 * (trend_type = 'opportunity_cluster')::INT - 0.04 * adopt::INT AS o,
  0.05 + 0.42 * comp::INT + 0.16 * (trend_type = 'competition_cluster')::INT - 0.1 * (NOT comp)::INT AS c,
  0.08 + 0.58 * adopt::INT + 0.05 * watch::INT + 0.18 * (trend_type = 'adoption_cluster')::INT AS a,
  0.18 + 0.32 * (fam = 'narrative' OR trend_type = 'narrative_cluster')::INT + 0.06 * firm::INT + 0.05 * fresh::INT + 0.12 * (trend_type = 'narrative_cluster')::INT AS nr,
  0.15 + 0.18 * (n > 1)::INT + 0.18 * firm::INT + 0.12 * fresh::INT + 0.12 * big::INT + 0.16 * (trend_type = 'momentum_cluster')::INT AS mo FROM z),
w AS (SELECT *, list_max([struct_pack(s := r, k := 'risk_signal'), struct_pack(s := o, k := 'opportunity_signal'), struct_pack(s := c, k := 'competition_signal'),
  struct_pack(s := a, k := 'adoption_signal'), struct_pack(s := nr, k := 'narrative_shift'), struct_pack(s := mo, k := 'momentum_signal')]) AS b,
  least(1, greatest(0, 0.28 + 0.3 * sig + 0.18 * round(corr, 3) + 0.12 * greatest(r, o, c, a, nr, mo) + 0.06 * least(n - 1, 2) + 0.04 * (nw > 0 OR nt > 0)::INT))::DOUBLE AS imp FROM sc)
"""


@query(
    "finding_routing",
    f"""
    WITH {_ROUTE_SQL} SELECT 'Customer ' || o_custkey AS subject, CASE WHEN b.s < 0.4 THEN (CASE WHEN n > 1 THEN 'momentum_signal' ELSE 'narrative_shift' END) ELSE b.k END AS finding_type,
      round(imp, 3) AS importance_score, round(least(1, greatest(0, 0.4 * imp + 0.22 * greatest(r, o, a, c) + 0.12 * sig + 0.08 * (nw > 0)::INT + 0.06 * (nt > 0)::INT))::DOUBLE, 3) AS decision_relevance_score FROM w
    """,
)
def finding_routing(spark, folder):
    f = build_findings(build_trends(*order_profiles(spark, folder)))
    return f.select("subject", "finding_type", "importance_score", "decision_relevance_score")


# --- decision layer over orders as findings ----------------------------------------------------
_FINDING_SQL = """
f AS (SELECT o_orderkey AS k, 'fd_' || o_orderkey AS id, ['risk_signal', 'opportunity_signal', 'competition_signal', 'adoption_signal', 'narrative_shift', 'momentum_signal'][(o_orderkey % 6 + 1)::INT] AS t,
  'Segment ' || o_orderpriority AS theme, 'Customer ' || (o_custkey % 40) AS subject, ((o_orderkey * 13) % 1000) / 1000.0 AS imp, ((o_orderkey * 29) % 997) / 1000.0 AS rel,
  o_orderkey % 50 = 0 AS watch FROM orders)
"""


def order_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in the finding schema."""
    o, k = table(spark, folder, "orders"), F.col("o_orderkey")
    kinds = ("risk_signal", "opportunity_signal", "competition_signal", "adoption_signal", "narrative_shift", "momentum_signal")
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return o.select(
        name("fd_", k).alias("finding_id"), F.get(F.array(*[F.lit(x) for x in kinds]), (k % 6).cast("int")).alias("finding_type"),
        name("Title ", k).alias("title"), name("Title ", k).alias("display_title"), F.concat(F.lit("Segment "), "o_orderpriority").alias("theme"),
        name("Customer ", F.col("o_custkey") % 40).alias("subject"), ((k * 13) % 1000 / 1000.0).alias("importance_score"),
        ((k * 29) % 997 / 1000.0).alias("decision_relevance_score"), F.array(name("evt_", k)).alias("supporting_event_ids"),
        F.array(name("evi_", k % 100)).alias("supporting_evidence_ids"),
        F.when(k % 50 == 0, F.array(F.lit("w"))).otherwise(none).alias("watchlist_hits"), none.alias("topic_hits"),
        F.array(name("because ", k % 3)).alias("explain"), k.alias("order_key"),
    )


@query(
    "alert_ranking",
    f"""
    WITH {_FINDING_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY imp DESC, rel DESC, id) AS n FROM f)
    SELECT 'al_' || n AS alert_id, id AS finding_id, CASE WHEN imp >= 0.82 THEN 'high' ELSE 'medium' END AS level FROM r WHERE imp >= 0.58 OR rel >= 0.52 OR n = 1
    """,
)
def alert_ranking(spark, folder):
    return build_alerts(order_findings(spark, folder))


@query(
    "briefing_items",
    f"""
    WITH {_FINDING_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY imp DESC, rel DESC, id) AS n FROM f)
    SELECT 'br_' || n AS briefing_id, id AS finding_id, 'Title ' || k AS title FROM r WHERE n <= 3
    """,
)
def briefing_items(spark, folder):
    return build_briefing_items(order_findings(spark, folder))


@query(
    "decision_signals",
    f"""
    WITH {_FINDING_SQL} SELECT 'ds_' || row_number() OVER (ORDER BY k) AS signal_id, id AS finding_id,
      CASE WHEN t = 'narrative_shift' THEN 'narrative' ELSE replace(t, '_signal', '') END AS signal_type, rel::DOUBLE AS decision_relevance_score FROM f
    """,
)
def decision_signals(spark, folder):
    return build_signals(order_findings(spark, folder), [F.col("order_key")]).select(
        "signal_id", "finding_id", "signal_type", "decision_relevance_score"
    )


def _records(spark, folder) -> DataFrame:
    f = order_findings(spark, folder)
    return finding_records(f, build_signals(f, [F.col("order_key")]))


@query(
    "recommendations",
    f"""
    WITH {_FINDING_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY k) AS pos FROM f),
    a AS (SELECT * FROM (VALUES ('risk_signal', 'escalate_risk_review', 0.18), ('opportunity_signal', 'pursue_opportunity_validation', 0.16),
      ('competition_signal', 'track_competitor_response', 0.12), ('adoption_signal', 'track_adoption_signals', 0.14),
      ('narrative_shift', 'monitor_narrative_shift', 0.1), ('momentum_signal', 'increase_monitoring', 0.12)) v(t, action, boost)),
    g AS (SELECT action, theme, boost, count(*) AS n, avg(rel) AS rel, avg(imp) AS imp, max(rel) AS top, bool_or(watch) AS w, 'ds_' || min(pos) AS signal_id,
      list_sort(list(id) || [action, theme]) AS ids, string_agg(id, '|' ORDER BY pos) AS findings FROM n JOIN a USING (t) GROUP BY 1, 2, 3)
    SELECT 'rec_' || substring(sha256(array_to_string(ids, '|')), 1, 10) AS recommendation_id, signal_id, action AS recommended_action, theme,
      least(1.0, round(rel::DOUBLE * 0.55 + imp::DOUBLE * 0.25 + boost::DOUBLE + 0.04 * w::INT + least(0.12, 0.04 * (n - 1)), 3))::DOUBLE AS priority,
      n AS consolidated_finding_count, findings, row_number() OVER (ORDER BY top DESC, n DESC, action, theme) AS place FROM g
    """,
)
def recommendations(spark, folder):
    r = build_recommendations(_records(spark, folder))
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(*recommendation_order()))  # a row per action and theme
    return r.select(
        "recommendation_id", "signal_id", "recommended_action", "theme", "priority", "consolidated_finding_count",
        joined(F.col("supporting_finding_ids")).alias("findings"), big(place).alias("place"),
    )


@query(
    "brief_sections",
    f"""
    WITH {_FINDING_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rel DESC, imp DESC, id) AS n FROM f),
    s AS (SELECT t, subject, min(n) AS n FROM r GROUP BY ALL), s3 AS (SELECT t, string_agg(subject, ', ' ORDER BY n) AS subjects FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY t ORDER BY n) <= 3) GROUP BY 1),
    e AS (SELECT t, 'because ' || (k % 3) AS x, min(n) AS n FROM r GROUP BY ALL), e2 AS (SELECT t, string_agg(x, '; ' ORDER BY n) AS why FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY t ORDER BY n) <= 2) GROUP BY 1),
    g AS (SELECT t, count(*) AS c, string_agg(id, '|' ORDER BY n) FILTER (n <= 4) AS finding_ids, max(CASE WHEN n = 1 THEN 'Title ' || k END) AS lead FROM r GROUP BY 1)
    SELECT t AS finding_type, finding_ids, CASE t WHEN 'risk_signal' THEN 'Risk' WHEN 'opportunity_signal' THEN 'Opportunity' WHEN 'competition_signal' THEN 'Competitive'
        WHEN 'adoption_signal' THEN 'Adoption' WHEN 'narrative_shift' THEN 'Narrative' ELSE 'Momentum' END || ' theme: ' || subjects || '. Leading signal: ' || lead || '. ' || c ||
        ' findings reinforce the same story cluster. Why it matters: ' || why || '.' AS paragraph FROM g JOIN s3 USING (t) JOIN e2 USING (t)
    """,
)
def brief_sections(spark, folder):
    return build_sections(_records(spark, folder)).select("finding_type", joined(F.col("finding_ids")).alias("finding_ids"), "paragraph")


@query(
    "decision_briefs",
    f"""
    WITH {_FINDING_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rel DESC, imp DESC, id) AS n FROM f)
    SELECT b.brief_type, (SELECT string_agg(theme, '|' ORDER BY n) FROM r WHERE t = 'risk_signal' AND n <= 3) AS top_risks,
      (SELECT string_agg(theme, '|' ORDER BY n) FROM r WHERE t = 'opportunity_signal' AND n <= 3) AS top_opportunities, 'ds_1|ds_2|ds_3|ds_4|ds_5|ds_6' AS key_signals,
      (SELECT count(*) FROM f) AS n_findings, (SELECT count(DISTINCT t || theme) FROM f) AS n_recommendations, (SELECT count(DISTINCT t) FROM f) AS section_count
    FROM (VALUES ('watch_brief'), ('risk_opportunity_memo'), ('weekly_decision_brief')) b(brief_type)
    """,
)
def decision_briefs(spark, folder):
    records = _records(spark, folder)
    b = build_briefs(records, build_recommendations(records))
    return b.select(
        "brief_type", joined(F.col("top_risks")).alias("top_risks"), joined(F.col("top_opportunities")).alias("top_opportunities"),
        joined(F.col("key_signals")).alias("key_signals"), "n_findings", "n_recommendations", big(F.col("section_count")).alias("section_count"),
    )


@query(
    "brief_support",
    f"WITH {_FINDING_SQL} SELECT 'finding' AS kind, id FROM f UNION ALL SELECT 'event', 'evt_' || k FROM f UNION ALL SELECT DISTINCT 'evidence', 'evi_' || (k % 100) FROM f",
)
def brief_support_query(spark, folder):
    return brief_support(_records(spark, folder)).select("kind", "id")


@query(
    "layer_metadata",
    f"""
    WITH {_FINDING_SQL} SELECT count(*) AS findings_in, count(*) AS signals, count(DISTINCT t || theme) AS recommendations, count(DISTINCT t) AS consolidated_actions, 3::BIGINT AS briefs FROM f
    """,
)
def layer_metadata(spark, folder):
    records = _records(spark, folder)
    recs = build_recommendations(records)
    return decision_counts(records, recs, build_briefs(records, recs))


# --- first-wins rules -----------------------------------------------------------------------------
@query(
    "first_per_url",
    """
    WITH c AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS u FROM pages)
    SELECT u AS url, min(page_id) AS page_id FROM c GROUP BY 1
    """,
)
def first_per_url(spark, folder):
    p = table(spark, folder, "pages").select("page_id", urls.canonical_url(F.regexp_replace("url", r"\?.*$", "")).alias("url"))
    return keep_first(p.filter(urls.is_allowed(F.col("url"))), ["url"], ["page_id"])


@query(
    "latest_order",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def latest_order(spark, folder):
    return keep_last(table(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "unseen_keys",
    "SELECT doc_id, 'v1:' || source || ':' || doc_id AS idempotency_key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def unseen_keys(spark, folder):
    key = idempotency_key(F.lit("v1"), F.col("source"), F.col("doc_id").cast("string"))
    d = table(spark, folder, "documents").select("doc_id", key.alias("idempotency_key"), "source")
    seen = table(spark, folder, "labels").join(d.select("doc_id", "idempotency_key"), "doc_id")
    return drop_seen(d.drop("source"), seen, "idempotency_key")
