"""The queries against their SQL, and the pipeline stage by stage against plain Python."""

import os
import random
import re

import pytest

import corpus_pipeline
from glimmerline.llm import secret_scan
from glimmerline.llm.decontamination import windows_of, words_of
from glimmerline.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, data, name):
    assert compare(spark, connect(data), data, name, QUERIES[name], ORACLE[name]) is None


def test_pipeline_stages(spark, data):
    stages = dict(corpus_pipeline.STAGES)
    rows = [
        (1, "Th the of and ering thent " * 30, "en", "s", 1), (2, "Th the of and ering thent " * 30, "en", "s", 1), (2, "Th the of and ering thent " * 30, "en", "s", 1),
        (3, None, "en", "s", 0), (4, "123 456", "en", "s", 7), (5, "", "en", "s", 0), (6, 'of the ering token = "abcdefghij" thent', "en", "s", 0),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string")
    given = spark.read.parquet(f"{data}/documents.parquet")
    both = given.unionByName(docs.drop("id").filter("doc_id in (3, 4, 5)").selectExpr("doc_id + 100000000 doc_id", "text", "lang", "source", "n_chars"))
    kept = stages["language"](spark, both, data)
    assert kept.columns == both.columns and kept.count() >= 0.99 * given.count() and kept.filter("doc_id > 100000000").count() == 0
    once = stages["near_duplicates"](spark, docs, data)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == [1, 3, 4, 5, 6]
    items = [windows_of(words_of(r.text), 10) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages["decontamination"](spark, given, data).collect()}
    for r in given.collect():
        text = " " + " ".join(words_of(r.text)) + " "
        assert (r.doc_id in clean) != any(" " + " ".join(w) + " " in text for some in items for w in some)
    masked = {r.doc_id: r for r in stages["secrets"](spark, docs, data).collect()}
    assert masked[6].text == "of the ering [assign]\" thent" and masked[6].n_chars == len(masked[6].text) and masked[1].n_chars == 1
    assert not any(re.search(secret_scan.BASE_RULES[2].pattern, r.text or "") for r in stages["secrets"](spark, given, data).collect())
    for stage in stages.values():
        assert stage(spark, docs.filter("false"), data).count() == 0


def test_language_stage_rejects_what_it_never_learned(spark, data):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 12)))
    soup = [" ".join(word() for _ in range(100)) for _ in range(50)]
    dutch = "de nederlandse taal is een west germaanse taal en de officiële taal van nederland en belgië die door miljoenen mensen wordt gesproken".split()
    finnish = "suomen kieli on itämerensuomalaisiin kieliin kuuluva kieli jota puhutaan pääosin suomessa ja se on yksi maan virallisista kielistä".split()
    unlearned = [" ".join(rng.choice(some) for _ in range(100)) for some in (dutch, finnish) for _ in range(25)]
    own = spark.createDataFrame([(10**8 + k, t, None, "s", len(t)) for k, t in enumerate(soup + unlearned)], "doc_id long, text string, lang string, source string, n_chars long")
    given = spark.read.parquet(f"{os.path.dirname(data)}/sf0.01/documents.parquet")
    kept = [r.doc_id for r in corpus_pipeline.identify_language(spark, given.unionByName(own), data).select("doc_id").collect()]
    assert sum(k < 10**8 for k in kept) >= 0.98 * given.count()
    assert not [k for k in kept if 10**8 <= k < 10**8 + 50]
    assert sum(k >= 10**8 for k in kept) <= 3, "an unlearned language may resemble a learned one"


def test_pipeline_packs_what_is_left(spark, data):
    rows = QUERIES["pipeline"](spark, data).collect()
    left = {r.doc_id for r in rows}
    assert left and all(sum(r.length for r in rows if r.doc_id == d) == next(r.doc_tokens for r in rows if r.doc_id == d) for d in sorted(left)[:20])
