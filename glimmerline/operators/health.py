"""Source health and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .fetching import CHALLENGES
from .ordering import one_row, row_count, with_positions

# the score moves in steps of 0.05: +6, +2 or -1 step, held between 0 and 20
TOP = 20


def health_step(block_type: Column, success: Column) -> Column:
    """Change of the anti-bot score, in steps, for one fetch result."""
    return (
        F.when(success, 0).when(block_type.isin(*CHALLENGES), 6).when(block_type == "rate_limited", 2).otherwise(-1)
    )


def _composed(shifts: Column) -> Column:
    """Clamped shifts, each s -> min(high, max(low, s + add)), one after the other as one such shift."""
    none = F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in (("add", 0), ("low", 0), ("high", TOP))])
    held = lambda x, r: F.least(r["high"], F.greatest(r["low"], x + r["add"]))
    return F.aggregate(
        shifts, none,
        lambda s, r: F.struct((s["add"] + r["add"]).alias("add"), held(s["low"], r).alias("low"), held(s["high"], r).alias("high")),
    )


def anti_bot_scores(steps: DataFrame, start: DataFrame | None = None, bits: int = 12) -> DataFrame:
    """Ordered fold of (source_id, ts, pos, step) rows to a score per source.

    One step is a clamped shift of the score, and shifts compose. Rows get
    their position in the order of source, time and pos; each level folds the
    rows of a source whose positions share all but the low `bits` into one
    shift, so no group has more than 2**bits rows, however many a source has.
    Four levels cover 2**(4 * bits) rows.
    """
    placed = with_positions(steps.select("source_id", "ts", "pos", "step"), ["source_id", "ts", "pos"], "at")
    shifts = placed.select(
        "source_id", F.col("at").cast("bigint").alias("at"), F.col("step").cast("bigint").alias("add"),
        F.lit(0).cast("bigint").alias("low"), F.lit(TOP).cast("bigint").alias("high"),
    )
    for _ in range(4):
        folded = shifts.groupBy("source_id", F.shiftright("at", bits).alias("chunk")).agg(
            F.array_sort(F.collect_list(F.struct("at", "add", "low", "high"))).alias("shifts")
        )
        shifts = folded.select("source_id", F.col("chunk").alias("at"), _composed(F.col("shifts")).alias("s")).select("source_id", "at", "s.*")
    if start is not None:
        shifts = shifts.join(start.select("source_id", F.round(F.col("anti_bot_score") * TOP).cast("bigint").alias("s0")), "source_id", "left")
    else:
        shifts = shifts.withColumn("s0", F.lit(0).cast("bigint"))
    end = F.least("high", F.greatest("low", F.coalesce("s0", F.lit(0).cast("bigint")) + F.col("add")))
    return shifts.select("source_id", (end / TOP).alias("anti_bot_score"))


def source_health(results: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """One health row per source from (source_id, ts, pos, block_type, success).

    Counters and last values are plain aggregates; only the clamped score needs
    the order. `start` carries the stored health rows of earlier runs.
    """
    at = F.struct("ts", "pos")
    bad = ~F.col("success")
    challenge = F.col("block_type").isin(*CHALLENGES)
    agg = results.groupBy("source_id").agg(
        F.count("*").alias("n"), F.count_if("success").alias("ok"), F.count_if(challenge).alias("guarded"),
        F.max(F.when(F.col("success"), F.col("ts"))).alias("last_success_at"),
        F.max(F.when(bad, F.col("ts"))).alias("last_failure_at"),
        F.max_by("block_type", at).alias("last_block_reason"), F.max_by("success", at).alias("last_ok"),
        F.max(F.when(bad, F.struct("ts", "pos", "block_type"))).alias("last_bad"),
        F.min(F.when(bad & challenge, at)).alias("first_challenge"),
    )
    scores = anti_bot_scores(results.withColumn("step", health_step(F.col("block_type"), F.col("success"))), start)
    joined = agg.join(scores, "source_id")
    if start is not None:
        old = start.select(
            "source_id", F.col("total_attempts").alias("n0"), F.col("total_successes").alias("ok0"),
            F.col("protected_events").alias("guarded0"), F.col("preferred_mode").alias("preferred0"),
            F.col("recommended_mode").alias("recommended0"), F.col("last_success_at").alias("ls0"),
            F.col("last_failure_at").alias("lf0"), F.col("notes").alias("notes0"),
            F.col("anti_bot_score").alias("score0"), F.col("failure_reason").alias("reason0"), F.col("last_block_reason").alias("block0"),
        )
        joined = joined.join(old, "source_id", "full")
    else:
        joined = joined.withColumns(
            {c: F.lit(None).cast(t) for c, t in (("n0", "bigint"), ("ok0", "bigint"), ("guarded0", "bigint"),
             ("preferred0", "string"), ("recommended0", "string"), ("ls0", "timestamp"), ("lf0", "timestamp"), ("notes0", "string"),
             ("score0", "double"), ("reason0", "string"), ("block0", "string"))}
        )
    plus = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    n, ok, guarded = plus("n", "n0"), plus("ok", "ok0"), plus("guarded", "guarded0")
    was_metadata = F.coalesce(F.col("preferred0") == "metadata_only", F.lit(False))
    first = F.col("first_challenge")
    bad_at = F.struct(F.col("last_bad.ts").alias("ts"), F.col("last_bad.pos").alias("pos"))
    challenged_by_then = was_metadata | F.coalesce(first <= bad_at, F.lit(False))
    preferred = F.when(was_metadata | first.isNotNull(), "metadata_only").otherwise(F.coalesce("preferred0", F.lit("listing_only")))
    kind = F.col("last_bad.block_type")
    by_failure = (
        F.when(kind.isin(*CHALLENGES), "metadata_only").when(kind == "rate_limited", "listing_only")
        .otherwise(F.when(challenged_by_then, "metadata_only").otherwise("listing_only"))
    )
    recommended = F.when(kind.isNotNull(), by_failure).otherwise(F.coalesce("recommended0", preferred))
    return joined.select(
        "source_id", n.alias("total_attempts"), ok.alias("total_successes"), guarded.alias("protected_events"),
        (ok / n).alias("success_rate"), F.least(F.lit(1.0), guarded / n).alias("protected_rate"),
        F.coalesce("last_success_at", "ls0").alias("last_success_at"), F.coalesce("last_failure_at", "lf0").alias("last_failure_at"),
        F.when(F.col("last_ok").isNull(), F.col("reason0")).when(~F.col("last_ok"), F.col("last_block_reason")).alias("failure_reason"),
        F.coalesce("last_block_reason", "block0").alias("last_block_reason"),
        F.coalesce("anti_bot_score", "score0", F.lit(0.0)).alias("anti_bot_score"), preferred.alias("preferred_mode"),
        recommended.alias("recommended_mode"),
        F.when(first.isNotNull(), F.lit("challenge detected: degrade to metadata/listing")).otherwise(F.col("notes0")).alias("notes"),
    )


def document_health(docs: DataFrame) -> DataFrame:
    """A10: (source_id, detail_fetch_attempt, detail_extract_success, metadata_fallback) to rates."""
    tried, won, fell = F.count_if("detail_fetch_attempt"), F.count_if("detail_extract_success"), F.count_if("metadata_fallback")
    return docs.groupBy("source_id").agg(
        F.count("*").alias("documents_ingested"), tried.alias("detail_fetch_attempts"), won.alias("detail_fetch_successes"),
        fell.alias("metadata_fallback_docs"), F.when(tried > 0, won / tried).otherwise(0.0).alias("detail_success_rate"),
        (fell / F.count("*")).alias("metadata_fallback_rate"),
    )


def discovery_report(attempts: DataFrame) -> DataFrame:
    """Rows (source_id, found, error) to counts per source and in total.

    `of_all` marks the total; without it a null source is attempts of no source.
    """
    return attempts.rollup("source_id").agg(
        (F.grouping_id() == 1).alias("of_all"),
        F.count("*").alias("attempted"), F.count_if(F.col("error").isNull() & (F.col("found") > 0)).alias("succeeded"),
        F.count("error").alias("errors"),
    )


def run_stats(**stages: DataFrame) -> DataFrame:
    """One row with the size of every stage table."""
    spark = next(iter(stages.values())).sparkSession
    return one_row(spark, **{name: row_count(df) for name, df in stages.items()})
