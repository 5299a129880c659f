"""Landed feed, sitemap and API payloads to candidate rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..functions.arrays import first_nonempty
from ..functions.dates import from_epoch, parse_feed_date, parse_iso
from ..functions.text import strip_ends
from ..functions.vocab import HN_ITEM_PAGE, REDDIT_ROOT
from ..operators.dedup import keep_first
from ..operators.unions import explode_computed
from ..session import cut_lineage

_GUID = "struct<_VALUE:string,_isPermaLink:string>"
RSS = f"channel struct<item:array<struct<title:string,link:string,guid:{_GUID},pubDate:string,description:string>>>"
_LINK = "struct<_VALUE:string,_href:string,_rel:string>"
ATOM = (
    f"entry array<struct<title:string,link:array<{_LINK}>,id:string,published:string,updated:string,"
    "summary:string,subtitle:string>>"
)
SITEMAP = "url array<struct<loc:string,lastmod:string>>"
SITEMAP_INDEX = "sitemap array<struct<loc:string>>"
_XML = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}


def _xml(body: Column, schema: str) -> Column:
    return F.from_xml(body, schema, _XML)


def feed_entries(payloads: DataFrame, body: str = "body") -> DataFrame:
    """RSS and Atom entries in document order, one schema."""
    atom = F.col(body).rlike(r"(?s)<feed[\s>]")
    rss_items = F.transform(
        _xml(F.when(~atom, F.col(body)), RSS)["channel"]["item"],
        lambda e: F.struct(
            e["title"].alias("title"), e["link"].alias("link"), e["guid"]["_VALUE"].alias("entry_id"),
            e["pubDate"].alias("date"), e["description"].alias("summary"),
        ),
    )

    def href(links: Column) -> Column:
        main = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        return F.coalesce(F.get(main, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"])

    atom_items = F.transform(
        _xml(F.when(atom, F.col(body)), ATOM)["entry"],
        lambda e: F.struct(
            e["title"].alias("title"), href(e["link"]).alias("link"), e["id"].alias("entry_id"),
            F.coalesce(e["published"], e["updated"]).alias("date"),
            first_nonempty(e["summary"], e["subtitle"]).alias("summary"),
        ),
    )
    items = F.coalesce(rss_items, atom_items)
    keep = [c for c in payloads.columns if c != body]
    return explode_computed(payloads.select(*keep, items.alias("_items")), keep, "_items", "item", "e").select(*keep, "item", "e.*")


def feed_candidates(payloads: DataFrame, max_items: int | Column | None = None) -> DataFrame:
    """Feed entries with a link; only the first `max_items` of each feed if that is given."""
    within = F.lit(True) if max_items is None else F.col("item") < max_items
    entries = feed_entries(payloads).filter(within & (F.coalesce("link", F.lit("")) != ""))
    keep = [c for c in payloads.columns if c != "body"]
    return entries.select(
        *keep, "item", F.col("link").alias("url"), (90 - F.col("item")).alias("priority"),
        F.lit("article").alias("hint_doc_type"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("snippet"), "date", parse_feed_date(F.col("date")).alias("published_at"),
        F.lit("feed").alias("discovery_method"),
    )


def feed_records(payloads: DataFrame, max_items: int | None = None) -> DataFrame:
    """Feed entries as raw records; only the first `max_items` of each feed if that is given."""
    e = feed_entries(payloads)
    if max_items is not None:
        e = e.filter(F.col("item") < max_items)
    external = first_nonempty(F.col("entry_id"), F.col("link"), F.concat(F.lit("entry-"), F.col("item").cast("string")))
    title, summary = F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))
    return e.withColumn("_ext", external).select(
        "provider_id", "item", F.col("_ext").alias("external_id"),
        parse_feed_date(F.col("date")).alias("fetched_at"), F.lit("application/rss-item+xml").alias("mime_type"),
        F.coalesce(first_nonempty(strip_ends(summary)), strip_ends(title)).alias("text"), title.alias("title"),
        F.coalesce("link", F.lit("")).alias("url"), "feed_url",
        F.concat(F.lit("rss:"), F.col("provider_id"), F.lit(":"), F.col("_ext")).alias("idempotency_key"),
    )


def last_landed(payloads: DataFrame, key: str) -> DataFrame:
    """The last landed row per key, by `ts` where the table has it; of rows landed together the one with the greater body hash."""
    order = [F.col("ts").desc()] if "ts" in payloads.columns else []
    return keep_first(payloads, [key], [*order, F.xxhash64("body").desc()])


def sitemap_candidates(requests: DataFrame, sitemaps: DataFrame, max_items: int | None = None) -> DataFrame:
    """Pages of the requested sitemaps; index files are followed to the last level.

    `requests(source_id, sitemap_url)` start the walk, `sitemaps(sitemap_url,
    body)` holds what was landed; of a sitemap landed twice the last counts
    (`last_landed`). Each round joins the open references to the landed bodies;
    `trail` keeps the position inside every level for the order. A sitemap is
    read once per source, however often and on whatever levels it is named: at
    its first mention by level, then trail. That also ends cycles.
    """
    landed = last_landed(sitemaps, "sitemap_url").select("sitemap_url", "body")
    is_index = F.col("body").rlike(r"<(?:\w+:)?sitemapindex[\s>]")
    frontier = requests.select("source_id", "sitemap_url", F.array().cast("array<int>").alias("trail"))
    parts: list[DataFrame] = []
    seen: DataFrame | None = None
    while True:
        frontier = keep_first(frontier, ["source_id", "sitemap_url"], ["trail"])
        if seen is not None:
            frontier = frontier.join(seen, ["source_id", "sitemap_url"], "left_anti")
        hit = cut_lineage(frontier.join(landed, "sitemap_url"))
        if hit.isEmpty():
            break
        now = hit.select("source_id", "sitemap_url")
        seen = now if seen is None else cut_lineage(seen.unionByName(now))
        here = ["source_id", "sitemap_url", "trail"]
        pages = explode_computed(
            hit.filter(~is_index).select(*here, _xml(F.col("body"), SITEMAP)["url"].alias("_urls")), here, "_urls", "item", "u"
        )
        parts.append(
            pages.filter((F.lit(True) if max_items is None else F.col("item") < max_items) & (F.coalesce(F.col("u.loc"), F.lit("")) != "")).select(
                "source_id", F.col("sitemap_url").alias("sitemap"), F.concat("trail", F.array("item")).alias("trail"),
                F.col("u.loc").alias("url"), (80 - F.col("item")).alias("priority"), F.col("u.lastmod").alias("lastmod"),
            )
        )
        frontier = explode_computed(
            hit.filter(is_index).select("source_id", "trail", _xml(F.col("body"), SITEMAP_INDEX)["sitemap"].alias("_maps")),
            ["source_id", "trail"], "_maps", "at", "s",
        ).select("source_id", F.col("s.loc").alias("sitemap_url"), F.concat("trail", F.array("at")).alias("trail")).filter(
            F.coalesce("sitemap_url", F.lit("")) != ""
        )
    if not parts:
        return requests.select("source_id").limit(0).selectExpr(
            "source_id", "'' sitemap", "array(0) trail", "'' url", "0 priority", "'' lastmod"
        )
    from ..operators.ordering import top_n_per

    every = reduce(DataFrame.unionByName, parts)
    return every if max_items is None else top_n_per(every, ["source_id"], ["trail"], max_items)


def rest_candidates(payloads: DataFrame, max_items: int | Column | None = None) -> DataFrame:
    """List payloads; needs items_path, field_map (map) and list_url columns."""
    body = F.try_parse_json("body")
    stage = payloads.withColumn("_v", body).filter(F.col("_v").isNotNull())
    # the first of the usual keys that holds a list
    usual = F.coalesce(
        *[F.when(F.get_json_object("body", f"$.{k}").startswith("["), F.get_json_object("body", f"$.{k}"))
          for k in ("items", "data", "results", "records", "entries")]
    )
    at_path = lambda doc, path: F.call_function("get_json_object", doc, F.concat(F.lit("$."), path))
    named = at_path(F.col("body"), F.col("items_path"))
    items = (
        F.when(F.coalesce("items_path", F.lit("")) != "", F.when(named.startswith("["), named))
        .when(F.ltrim("body").startswith("["), F.col("body"))
        .otherwise(usual)
    )
    keep = [c for c in payloads.columns if c != "body"]
    rows = explode_computed(stage.withColumn("_rows", F.from_json(items, "array<string>")), keep, "_rows", "item", "row").filter((F.lit(True) if max_items is None else F.col("item") < max_items) & F.ltrim("row").startswith("{"))

    def field(name: str) -> Column:
        key = F.coalesce(F.col("field_map")[name], F.lit(name))
        return at_path(F.col("row"), key)

    raw_url = field("url")
    link = F.coalesce(raw_url, *[F.get_json_object("row", f"$.{k}") for k in ("link", "href", "permalink", "webUrl")])
    nested = F.get_json_object(link, "$.href")
    link = F.when(link.startswith("{"), nested).otherwise(link)
    full = F.when(link.startswith("http"), link).otherwise(urls.resolve(F.col("list_url"), link))
    return rows.withColumn("_link", link).filter(F.trim(F.coalesce("_link", F.lit(""))) != "").select(
        *[c for c in payloads.columns if c not in ("body", "items_path", "field_map")], "item",
        F.trim(full).alias("url"), (95 - F.least("item", F.lit(90))).alias("priority"),
        F.lit("article").alias("hint_doc_type"), field("title").alias("title"), field("summary").alias("snippet"),
        field("id").alias("external_id"),
    )


# --- social payloads ------------------------------------------------------------------------
_POST = (
    "struct<id:string,title:string,selftext:string,permalink:string,url:string,author:string,created_utc:double,"
    "score:double,num_comments:double,subreddit:string>"
)
_LISTING = f"struct<data:struct<children:array<struct<kind:string,data:{_POST}>>,after:string>>"


def reddit_candidates(payloads: DataFrame) -> DataFrame:
    """Listing or thread payloads to posts."""
    body = F.ltrim("body")
    listing = F.when(
        body.startswith("["), F.get(F.from_json("body", f"array<{_LISTING}>"), F.lit(0))
    ).otherwise(F.from_json("body", _LISTING))
    parsed = payloads.select("source_id", "source_type", listing.alias("_l")).select(
        "source_id", "source_type", F.col("_l.data.after").alias("cursor_after"), F.col("_l.data.children").alias("_posts")
    )
    rows = explode_computed(parsed, ["source_id", "source_type", "cursor_after"], "_posts", "item", "c").filter((F.col("c.kind") == "t3") & (F.coalesce(F.col("c.data.id"), F.lit("")) != ""))
    d = F.col("c.data")
    link = F.coalesce(d["permalink"], F.lit(""))
    return rows.select(
        "source_id", F.lit("reddit").alias("platform"), "source_type", "item",
        F.when(d["id"].startswith("t3_"), d["id"]).otherwise(F.concat(F.lit("t3_"), d["id"])).alias("external_id"),
        F.when(link.startswith("/"), F.concat(F.lit(REDDIT_ROOT), link)).otherwise(first_nonempty(d["url"], link)).alias("url"),
        first_nonempty(d["author"]).alias("author_handle"), first_nonempty(d["title"]).alias("title"),
        F.coalesce(d["selftext"], F.lit("")).alias("text"), F.lit(None).cast("string").alias("summary"),
        from_epoch(d["created_utc"]).alias("published_at"),
        F.map_from_arrays(F.array(F.lit("score"), F.lit("num_comments")), F.array(d["score"], d["num_comments"])).alias("engagement"),
        "cursor_after",
    )


_HIT = "struct<objectID:string,title:string,url:string,author:string,created_at_i:double,points:double,num_comments:double>"
_ITEM = "struct<id:bigint,type:string,title:string,url:string,text:string,by:string,time:double,score:double,descendants:double,kids:array<bigint>>"


def _hn(df: DataFrame, hid: Column, d: Column, author: str, time: str, points: str, comments: str, text: Column) -> DataFrame:
    return df.select(
        "source_id", F.lit("hackernews").alias("platform"), "source_type", "item", hid.alias("external_id"),
        F.coalesce(first_nonempty(d["url"]), F.concat(F.lit(HN_ITEM_PAGE), hid)).alias("url"),
        first_nonempty(d[author]).alias("author_handle"), first_nonempty(d["title"]).alias("title"),
        F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("summary"),
        from_epoch(d[time]).alias("published_at"),
        F.map_from_arrays(F.array(F.lit("points"), F.lit("num_comments")), F.array(d[points], d[comments])).alias("engagement"),
    )


def hn_search_candidates(payloads: DataFrame) -> DataFrame:
    """Search hits."""
    hits = payloads.select("source_id", "source_type", F.from_json("body", f"struct<hits:array<{_HIT}>>")["hits"].alias("_hits"))
    rows = explode_computed(hits, ["source_id", "source_type"], "_hits", "item", "d")
    hid = F.coalesce(F.col("d.objectID").try_cast("bigint"), F.lit(0)).cast("string")
    return _hn(rows, hid, F.col("d"), "author", "created_at_i", "points", "num_comments", F.lit(""))


def hn_item_candidates(payloads: DataFrame) -> DataFrame:
    """Story items, a payload each; needs an `item` order column."""
    rows = payloads.withColumn("d", F.from_json("body", _ITEM)).filter("d.type = 'story'")
    return _hn(rows, F.col("d.id").cast("string"), F.col("d"), "by", "time", "score", "descendants", F.col("d.text"))


def hn_cursor(candidates: DataFrame) -> DataFrame:
    """Highest item id per source."""
    return candidates.groupBy("source_id").agg(F.max(F.col("external_id").try_cast("bigint")).alias("last_max_id"))


# --- search payloads ---------------------------------------------------------------------------
def search_results(payloads: DataFrame) -> DataFrame:
    """NewsAPI, Brave and Tavily payloads to one result schema."""
    keep = ["query_id", "provider_id"]

    def rows(kind: str, schema: str, path: str, snippet: str, published: str | None) -> DataFrame:
        v = F.from_json("body", schema)
        for part in path.split("."):
            v = v[part]
        out = explode_computed(payloads.filter(F.col("provider") == kind).select(*keep, v.alias("_hits")), keep, "_hits", "at", "r")
        return out.select(
            *keep, (F.col("at") + 1).alias("rank"), F.col("r.url").alias("url"), F.col("r.title").alias("title"),
            F.col(f"r.{snippet}").alias("snippet"),
            (parse_iso(F.col(f"r.{published}")) if published else F.lit(None).cast("timestamp")).alias("published_hint"),
        )

    item = "struct<url:string,title:string,{}>"
    news = rows("newsapi", f"struct<articles:array<{item.format('description:string,publishedAt:string')}>>", "articles", "description", "publishedAt")
    brave = rows("brave", f"struct<web:struct<results:array<{item.format('description:string')}>>>", "web.results", "description", None)
    tavily = rows("tavily", f"struct<results:array<{item.format('content:string')}>>", "results", "content", None)
    return (
        news.unionByName(brave).unionByName(tavily)
        .filter(F.coalesce("url", F.lit("")) != "")
        .withColumn("domain", urls.netloc(F.col("url")))
    )


# --- records -----------------------------------------------------------------------------------
def official_records(candidates: DataFrame) -> DataFrame:
    """Discovery-only raw records."""
    return candidates.select(
        F.concat(F.lit("official:"), F.col("source_id")).alias("provider_id"), F.col("url").alias("external_id"),
        F.col("url").alias("text"), "url", "source_id", "company", "transport", F.lit(True).alias("discovery_only"),
        F.concat_ws(":", F.lit("official"), "source_id", "url").alias("idempotency_key"),
    )


def search_records(ranked: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw records, error rows) of candidates routed to a web fetch."""
    target = F.coalesce(first_nonempty(F.col("canonical_url")), F.col("url"))
    mine = ranked.filter("route = 'route_to_web_fetch'").withColumn("_target", target)
    got = mine.join(fetched.select(F.col("url").alias("_target"), "final_url", "success", "status_code", "content_type",
                                   "raw_text", "error"), "_target")
    provider = F.concat(F.lit("search:"), F.col("candidate_id"))
    good = got.filter("success").select(
        provider.alias("provider_id"), F.col("_target").alias("external_id"), F.col("content_type").alias("mime_type"),
        F.col("raw_text").alias("text"), F.coalesce(first_nonempty(F.col("final_url")), F.col("_target")).alias("url"),
        F.col("likely_origin_type").alias("origin_type"), F.array(F.lit("web_search")).alias("discovery_channels"),
        F.concat_ws(":", F.lit("search"), "candidate_id", "_target").alias("idempotency_key"),
    )
    bad = got.filter("not success").select(
        F.concat_ws(":", "candidate_id", F.coalesce(first_nonempty(F.col("error")), F.col("status_code").cast("string"))).alias("error")
    )
    return good, bad


def document_records(docs: DataFrame) -> DataFrame:
    """Normalized documents as raw records."""
    url = F.coalesce(first_nonempty(F.col("canonical_url")), F.col("url"))
    return docs.select(
        F.col("source_id").alias("provider_id"), url.alias("external_id"), F.lit("text/plain").alias("mime_type"),
        F.coalesce(first_nonempty(F.col("content_text"), F.col("summary")), F.lit("")).alias("text"), "title",
        url.alias("url"), "source_type", "blocked_by", "access_mode",
        F.concat(F.lit("focused:"), F.col("source_id"), F.lit(":"), F.substring("content_hash", 1, 24)).alias("idempotency_key"),
    )


def union_batches(**channels: DataFrame) -> DataFrame:
    """Batches of all channels in the given order."""
    tagged = [
        df.withColumns({"channel": F.lit(name), "channel_order": F.lit(i)})
        for i, (name, df) in enumerate(channels.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
