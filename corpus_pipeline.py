"""The corpus pipeline: each stage reads the documents that the stage before wrote, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glimmerline.llm import decontamination, language, near_dups, packing, secret_scan
from glimmerline.session import scratch_path

#: SQL can't express language identification by a trained network.
ORACLE_SQL = None

#: A text is rejected if its language is undetermined, or its score lies below this quantile of the scores that correctly
#: tagged documents of that language reach, of those not trained on. About so large a share of good documents goes as well.
QUANTILE = 0.005

#: Near copies share this many hundredths of their 5-word shingles; a pair that does shares no band of five registers with probability
#: (1 - 0.8**5)**48, below 1e-8.
THRESHOLD, BANDS = 80, 48


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, quantile: float = QUANTILE) -> DataFrame:
    """Drops documents without a letter, and those that fit no learned language as documents of it do.

    Rows are judged one by one: null, empty and letterless texts go, rows with
    null or repeated ids and equal rows have equal fates. Without a labelled
    document all texts with a letter stay. Further columns pass through.
    """
    labelled = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    tagger = language.learn(labelled.filter(~language.held_out("id")))
    judged = language.identify(docs.withColumn("doc_id", F.struct(*docs.columns)), tagger)
    if tagger is None:
        return judged.filter(F.col("doc_id.text").rlike(r"\p{L}")).select("doc_id.*")
    least = language.least_scores(labelled.filter(language.held_out("id")), tagger, quantile)
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("lang_pred"))
    return judged.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= bound)).select("doc_id.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: int = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id; of rows that share that id, one per text.

    Copies are texts with at least `threshold` hundredths of their 5-word
    shingles in common. Null, empty and blank texts are copies of nothing and
    stay, as do rows with null id. Of rows alike in id and text, the first by
    their further columns stays.
    """
    kept = near_dups.near_duplicates(docs, threshold=threshold, bands=bands).filter("kept and doc_id is not null").select("doc_id").distinct()
    rest = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))  # maps have no order and no hash
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(rest)
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").select("*", F.row_number().over(order).alias("copy of a row"))
    return named.filter("`copy of a row` = 1").select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Rows are judged one by one; null and empty texts hold none and stay.
    Without benchmark items all stay. Further columns pass through.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated_words(docs.withColumn("doc_id", F.struct(*docs.columns)), items)
    return found.filter("not contaminated").select("doc_id.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in a text by its kind in brackets; counts the characters of changed texts anew.

    All rows stay. Null and empty texts are unchanged; rows that share an id,
    or have none, are masked each by its own text. Of spans that overlap, the
    first by start, then kind, names the run. Further columns pass through.
    """
    spans = "secret_spans"
    while any(c.startswith(spans) for c in docs.columns):
        spans += "_"
    found = secret_scan.secret_spans(docs, out=spans)
    changed = F.size(spans) > 0
    text = F.when(changed, secret_scan.masked(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences, with their ids.

    Null text is empty: a document of its end mark alone. Rows that share an
    id, or have none, and equal rows are documents of their own. Further
    columns are left out.
    """
    return packing.packed(docs)


STAGES = [
    ("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("secrets", mask_secrets), ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet in the shared folder and read again.

    An empty table passes through all stages. The folders stay, since the
    result is read from the last one when it is asked for.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
