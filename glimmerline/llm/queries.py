"""Named queries of the operators and of the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import chat, decontamination, language, licenses, near_dups, packing, periodic_runs, prefix_trie, repeated_text, search, secret_scan, toxicity, url_filter


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contaminated_words(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.learn_and_score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(_table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.learn_and_identify(_table(spark, folder, "documents"))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(_table(spark, folder, "documents"))


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    given = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    word = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", word), (-1, 1, "assistant", word)], given.schema)
    return chat.conversation_digests(chat.format_turns(given.unionByName(own))).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.secret_spans(_table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["rank"] < len(secret_scan.BASE_RULES))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secret_spans")).alias("spans"),
    )


def op8_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, folder, "documents"))


def op9_top_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return search.top_documents(docs, docs.filter("doc_id % 50 = 0"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"), with_ids=False).drop("ids")


def op11_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_text.without_repeats(_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents of which, where h = crc32(doc_id) is a multiple of 10, the words from a = h / 10 mod n on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    frame = docs.select("doc_id", "text", (h % 10 == 0).alias("planted"), g.alias("g"))
    words = frame.withColumn("words", F.when(F.col("planted"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = F.size("words")
    placed = words.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    text = F.expr("array_join(transform(words, (w, at) -> words[cast(if(at >= a, a + (at - a) % p, at) as int)]), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op12_periods(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_periods(_table(spark, folder, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("x"), r["start"], r["period"], r["length"])))
    row = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(row, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_shared_beginnings(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations rebuilt from keyed turns, all their ids).

    Conversation c begins with the first h = crc32(c) mod 9 turns of conversation c - c mod 5; its own turns follow from the
    (h + 1)-th on. Of a long conversation only its first eight turns travel to others.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "key")
    placed = given.filter("conv_id is not null").select("conv_id", F.row_number().over(order).cast("long").alias("at"), "key", "size")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    ids = given.filter("conv_id is not null").select("conv_id").distinct()
    heads = placed.filter("at <= 8").withColumnRenamed("conv_id", "base")
    asked = ids.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "taken": taken})
    first = asked.join(heads, "base").filter("at <= taken").select("conv_id", "at", "key", "size")
    return first.unionByName(placed.filter(F.col("at") > taken)), ids


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    given = prefix_trie.turn_keys(_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    turns, ids = with_shared_beginnings(given.select("conv_id", "turn", "key", "size"))
    trie = prefix_trie.prefix_trie(turns, turn="at", ids=ids)
    return trie.nodes.join(prefix_trie.end_digests(trie.ends), ["d1", "d2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
spans AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[p:p + 9], ' ') AS win FROM spans),
docs AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM docs, sizes),
hits AS (
  SELECT d.doc_id, d.p, d.size, x.item
  FROM (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS win FROM places) d JOIN wins x ON d.size = x.size AND d.win = x.win
),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS l FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(len(n.l), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(n.l, ','), '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


def _license_sql(least: float = 0.8) -> str:
    quoted = ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}')" for k, t in sorted(licenses.TEMPLATES.items()))
    words = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return rf"""
WITH templates AS (SELECT license, {grams.format('w')} AS g FROM (SELECT license, {words.format('t')} AS w FROM (VALUES {quoted}) v(license, t))),
parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, string_split_regex(text, '\n[ \t\r]*\n') AS p FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, unnest(list_distinct(l)) AS unit FROM parts
  UNION ALL SELECT doc_id, unnest(list_filter(p, lambda x: contains(x, chr(10)))) FROM parts
  UNION ALL SELECT doc_id, text FROM parts WHERE len(p) > 1
),
sets AS (SELECT doc_id, {grams.format('w')} AS g FROM (SELECT doc_id, {words.format('unit')} AS w FROM units) WHERE len(w) > 1),
scores AS (
  SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) AS dice
  FROM sets s JOIN templates t ON len(s.g) <= 2 * len(t.g) AND len(t.g) <= 2 * len(s.g)
)
SELECT doc_id, license, count(*)::BIGINT AS n_units, round(max(dice), 6) AS best_dice FROM scores WHERE dice >= {least} GROUP BY doc_id, license
"""


def _turns_sql() -> str:
    controls = r"(<\|[a-z_]+(?::[0-9]+)?\|>|</?s>|\[/?INST\]|<</?SYS>>)"
    escaped = rf"length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '{controls}'))"
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  sum(length('<|turn|>') + length(role) + 1 + {escaped} + length('<|end|>'))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _secrets_sql() -> str:
    def found(rank: int, rule: secret_scan.Rule) -> str:
        pattern = (rule.sql or rule.pattern).replace("'", "''")
        group = lambda k: f"regexp_extract_all(text, '{pattern}', {k})"
        span = f"list_transform(list_zip({group(1)}, {group(2)}, {group(3)}), lambda g: coalesce(g[1], '') || coalesce(g[2], '') || coalesce(g[3], ''))" if rule.sql else group(0)
        return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, string_split_regex(text, '{pattern}') AS gaps,
  {group(0)} AS hits, {span} AS own, {group(rule.group)} AS parts, {rule.least} AS least FROM documents"""

    rules = " UNION ALL ".join(found(k, r) for k, r in enumerate(secret_scan.RULES))
    return rf"""
WITH found AS ({rules}),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, rank, kind, len(parts[i]) >= least AS real,
    coalesce(list_sum(list_transform(gaps[1:i], lambda g: len(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0) AS start, len(own[i]) AS size
  FROM each
),
named AS (SELECT doc_id, rank, start::BIGINT AS start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM spans WHERE real),
sums AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS c, count(*) FILTER (rank = 2) AS h,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM named GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN sums USING (doc_id)
"""


OP8_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_FOLD.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes i ON i.doc_id = a.doc_id JOIN sizes j ON j.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, i.n, j.n HAVING 100 * count(*) >= 85 * (i.n + j.n - count(*))
),
reach AS (SELECT x, x AS y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) c USING (doc_id)
"""

OP9_SQL = rf"""
WITH docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, greatest(sum(len(w)), 1)::DOUBLE / count(*) AS average FROM docs),
posts AS (SELECT doc_id, size, t, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(w)::DOUBLE AS size, unnest(w) AS t FROM docs) GROUP BY doc_id, size, t),
terms AS (SELECT t, count(*)::DOUBLE AS df FROM posts GROUP BY t),
asked AS (SELECT doc_id AS query_id, t, 1000000 * p.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) AS weight FROM posts p JOIN terms USING (t), stats WHERE doc_id % 50 = 0),
scores AS (
  SELECT query_id, doc_id, sum(round(weight * (tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * size / average))))::BIGINT)::BIGINT AS points
  FROM asked JOIN posts USING (t), stats GROUP BY query_id, doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS rank FROM scores WHERE points > 0)
SELECT query_id, rank::INTEGER AS rank, doc_id, points / 1000000.0::DOUBLE AS score FROM ranked WHERE rank <= 10
"""

OP11_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT r, x, unnest(range(0, len(x) // 2 - 399)) AS p FROM docs),
windows AS (SELECT r, p, md5(substring(x, 2 * p + 1, 800)) AS w FROM places),
again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 400, true) AS fresh FROM windows SEMI JOIN again USING (w)),
marked AS (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS run FROM hits),
runs AS (SELECT r, min(p) AS s, max(p) + 400 AS e FROM marked GROUP BY r, run),
gaps AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS f FROM runs),
sums AS (
  SELECT r, count(*) AS n, sum(e - s) AS removed, string_agg(substring(x, (2 * f + 1)::BIGINT, (2 * (s - f))::BIGINT), '' ORDER BY s) AS kept, max(e) AS f
  FROM gaps JOIN docs USING (r) GROUP BY r
)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(x, (2 * coalesce(f, 0) + 1)::BIGINT))) AS kept_sha256
FROM docs LEFT JOIN sums USING (r)
"""


def _crc32_sql(s: str) -> str:
    """crc32 of an ASCII string, bit by bit."""
    step = "lambda x, k: xor(x >> 1, 3988292384 * (x & 1))"
    codes = f"list_transform(range(1, length({s}) + 1), lambda i: ascii(substring({s}, i, 1))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: list_reduce(range(0, 8), {step}, xor(c, b)), 4294967295::BIGINT), 4294967295)"


OP12_SQL = rf"""
WITH given AS (
  SELECT row_number() OVER () AS r, doc_id, {_crc32_sql('doc_id::VARCHAR')} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
cut AS (SELECT r, doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS f FROM given),
docs AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // f) ELSE i END]) END AS w FROM cut
),
words AS (SELECT r, n, unnest(w) AS x, unnest(range(0, n)) AS i FROM docs),
same AS (SELECT a.r, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isles AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM same),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM isles GROUP BY r, q, isle HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, l, min(q) AS q FROM stretches GROUP BY r, s, l),
sums AS (
  SELECT r, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
    list({{'s': s, 'l': l, 'q': q}} ORDER BY l::DOUBLE / q DESC, s, q)[1] AS best, list({{'s': s, 'l': l, 'q': q}}) AS every
  FROM runs GROUP BY r
),
gone AS (SELECT DISTINCT r, unnest(range(e.s + e.q, e.s + e.l)) AS i FROM (SELECT r, unnest(every) AS e FROM sums)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(sums.n, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""

OP13_SQL = rf"""
WITH placed AS (
  SELECT conv_id AS c, coalesce(role, '') AS ro, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT c, c - c % 5 AS base, {_crc32_sql('c::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT c FROM placed)),
rebuilt AS (
  SELECT ids.c, i, ro, t FROM ids JOIN placed ON placed.c = base WHERE i <= h
  UNION ALL SELECT ids.c, i, ro, t FROM ids JOIN placed ON placed.c = ids.c WHERE i > h
),
ways AS (SELECT c, coalesce(list({{'r': ro, 't': t}} ORDER BY i) FILTER (i IS NOT NULL), []) AS l FROM ids LEFT JOIN rebuilt USING (c) GROUP BY c),
steps AS (SELECT c, len(l) AS n, unnest(range(0, len(l) + 1)) AS d, l FROM ways),
paths AS (SELECT c, n, d, l[1:d] AS p, CASE WHEN d > 0 THEN l[1:d - 1] END AS q, CASE WHEN d > 0 THEN strlen(l[d].t) ELSE 0 END AS size FROM steps),
nodes AS (
  SELECT d, p, min(c) AS c, count(*) AS n_convs, any_value(q) AS q, any_value(size) AS size, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends
  FROM paths GROUP BY d, p
),
kids AS (SELECT q AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY q),
whole AS (SELECT d, p, c, n_convs, q, ends, coalesce(n_children, 0) AS n_children, (n_convs - 1) * size AS own FROM nodes LEFT JOIN kids USING (p)),
up AS (SELECT unnest(range(0, d + 1)) AS k, p, n_children, own FROM whole),
sums AS (SELECT p[1:k] AS p, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved FROM up GROUP BY p[1:k])
SELECT w.c::BIGINT AS conv_id, w.d::BIGINT AS depth, a.c::BIGINT AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM whole w JOIN sums ON sums.p = w.p LEFT JOIN nodes a ON a.p = w.q AND w.d > 0
"""


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_toxicity, op3_url_filter, op4_language, op5_licenses, op6_chat, op7_secrets, op8_near_dups, op9_top_search,
        op10_packing, op11_repeats, op12_periods, op13_prefix_trie, pipeline,
    )
}
ORACLE = {
    "op1_decontamination": OP1_SQL, "op5_licenses": _license_sql(), "op6_chat": _turns_sql(), "op7_secrets": _secrets_sql(),
    "op8_near_dups": OP8_SQL, "op9_top_search": OP9_SQL, "op11_repeats": OP11_SQL, "op12_periods": OP12_SQL, "op13_prefix_trie": OP13_SQL,
}
