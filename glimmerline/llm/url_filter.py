"""URL verdicts: host rules, and boosted trees on lexical features for the rest; DataFrame functions only.

The trees learn from the URLs that a rule decides, so that further URLs like
those get the same verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .tables import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits `host` and all its subdomains, for paths that start with the rule's path; `text` is host and path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])


RULES = (
    HostRule("allow", "org/"), HostRule("block", "example.org/es/"), HostRule("block", "example.org/en/1"),
    HostRule("allow", "com/fr/"), HostRule("block", "com/de/"),
)

FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy",
    "parameters", "longest_segment", "suffix_rate", "suffix_rows", "domain_rate", "domain_rows",
    "segment_rate", "segment_rows",
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: tuple[HostRule, ...]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; of equally long ones the first by text."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _entropy(text: Column) -> Column:
    """Bits per character, from the share of each distinct character."""
    size = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    return F.when(size > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def _share(text: Column, pattern: str) -> Column:
    size = F.length(text)
    return F.when(size > 0, (size - F.length(F.regexp_replace(text, pattern, ""))) / size).otherwise(0.0)


def _with_lexical(frame: DataFrame) -> DataFrame:
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    values = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")), "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": _share(url, "[0-9]"), "host_digit_ratio": _share(host, "[0-9]"),
        "hyphens": F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit(""))), "entropy": _entropy(url), "host_entropy": _entropy(host),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "longest_segment": F.coalesce(F.array_max(F.transform(F.split(path, "/"), F.length)), F.lit(0)),
    }
    return frame.withColumns({k: v.cast("double") for k, v in values.items()} | {
        "suffix": F.element_at(F.split(host, r"\."), -1), "segment": F.coalesce(F.get(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(0)), F.lit("")), "domain": F.array_join(F.slice(F.split(F.concat(F.lit("."), host), r"\."), -2, 2), "."),
    })


_RATED = ("suffix", "domain", "segment")
_FOLDS = 5


def _with_rates(frame: DataFrame, labelled: DataFrame) -> DataFrame:
    """Block rate and log count of a URL's host suffix, domain and first path segment among labelled URLs, drawn to one half by ten rows.

    A labelled URL is rated by the other folds only (folds by a hash of the
    URL), so that no rate holds the label that it helps to learn.
    """
    own = F.col("ruled").isNotNull() & F.col("seen")
    frame = frame.withColumn("fold", F.when(own, F.pmod(F.xxhash64("url", F.lit(3)), F.lit(_FOLDS))).otherwise(-1))
    for name in _RATED:
        sums = F.sum("label").alias(f"{name}_sum"), F.count("*").alias(f"{name}_n")
        folds = labelled.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(_FOLDS))).groupBy(name, "fold").agg(*sums)
        every = folds.groupBy(name).agg(F.sum(f"{name}_sum").alias("s"), F.sum(f"{name}_n").alias("n"))
        frame = frame.join(every, name, "left").join(folds, [name, "fold"], "left")
        left = lambda total, part: F.coalesce(F.col(total), F.lit(0)) - F.coalesce(F.col(part), F.lit(0))
        frame = frame.withColumns({
            f"{name}_rate": (left("s", f"{name}_sum") + 5) / (left("n", f"{name}_n") + 10), f"{name}_rows": F.log1p(left("n", f"{name}_n").cast("double")),
        }).drop("s", "n", f"{name}_sum", f"{name}_n")
    return frame


def judged(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[HostRule, ...] = RULES, sample: int = 20_000,
    trees: int = 12, depth: int = 4, learn_from: Column | None = None,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, block_score.

    The trees are fitted on about `sample` of the URLs that a rule decides,
    drawn by a hash of the URL. Suffix counts are taken over all of those.
    If they all have one verdict, it holds for every other URL; without any,
    the rest is allowed. Null URLs and URLs without `://` have an empty host
    and path. Repeated rows give repeated rows; null ids stay. `learn_from`, a
    condition on `pages`, names the rows that the trees and counts may see, so
    that the others can be held out; it is all of them if unset.
    """
    host, path = url_parts(F.col("url"))
    seen = F.lit(True) if learn_from is None else learn_from
    frame = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), seen.alias("seen")).withColumns({"host": host, "path": path})
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    frame = _with_lexical(frame.withColumns({"rule": rule, "ruled": ruled}))
    labelled = frame.filter("ruled is not null and seen").withColumn("label", (F.col("ruled") == "block").cast("double"))
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        only = "block" if 1.0 in counts else "allow"
        out = frame.withColumn("block_score", F.lit(float(only == "block")))
    else:
        rated = stored(_with_rates(frame, labelled), "urls")
        drawn = rated.filter(F.col("ruled").isNotNull() & F.col("seen") & (F.xxhash64("url") / 2.0**64 + 0.5 < sample / sum(counts.values())))
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
        train = assembler.transform(drawn.withColumn("label", (F.col("ruled") == "block").cast("double"))).select("features", "label")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11).fit(train)
        scored = model.transform(assembler.transform(rated))
        out = scored.withColumn("block_score", vector_to_array("probability")[1])
    own = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return out.select(
        F.col("id").alias(page_id), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "block_score"
    )
