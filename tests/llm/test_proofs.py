"""Whole given tables against independent computations, where SQL has no twin."""

import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmerline.llm import packing, toxicity, url_filter


def test_pieces_join_to_the_ids_of_the_library(spark, data):
    """Every document of a table: its pieces in order are the tokenizers library's ids, each once."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.packed(docs, group_docs=50).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    rows = docs.collect()
    assert len(rows) == len({r.doc_id for r in rows}) == len(pieces)
    for r in rows:
        want = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[r.doc_id])
        assert [start for start, *_ in own] == np.cumsum([0] + [n for _, n, *_ in own[:-1]]).tolist()
        assert np.frombuffer(b"".join(ids for *_, ids, _ in own), "<u4").tolist() == want and {n for *_, n in own} == {len(want)}
    lengths = []
    for held in sequences.values():
        held.sort()
        assert [at for at, _ in held] == np.cumsum([0] + [n for _, n in held[:-1]]).tolist()
        lengths.append(sum(n for _, n in held))
    assert max(lengths) <= 1024 and sum(n not in {2**k for k in range(11)} for n in lengths) <= 0.02 * len(lengths)


def plain_rule(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None, None
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))
    path, best = rest[cut:end], None
    for text, verdict in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")):
        own, _, start = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return host, path, *(best or (None, None))


def test_urls_and_rules_of_all_pages(spark, data):
    folder = os.path.join(os.path.dirname(data), "sf0.01")
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    odd = [None, "", "no scheme", "HTTP://A.EXAMPLE.ORG/es/1?x=/", "x://org", "x://org?/es/", "x://example.org/en/1#q", "://com/de/", "x://Com/fr/", "x://" + "a" * 20_000 + ".com/de/" + "b" * 20_000]
    more = spark.createDataFrame([(None if k % 3 else 10**6, u) for k, u in enumerate(odd)], "page_id long, url string")
    clash = pages.unionByName(more).unionByName(more).withColumns({"host": F.lit("h"), "rule": F.lit(1), "label": F.lit(2), "features": F.lit(3), "id": F.lit(4)})
    given = clash.select("page_id", "url").collect()
    got = url_filter.judged(clash).collect()
    key = lambda x: repr(tuple(x))
    want = [(r.page_id, *plain_rule(r.url)) for r in given]
    assert len(got) == len(want)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == sorted(((i, h, p, t) for i, h, p, t, _ in want), key=key)
    ruled = {(i, h, p): v for i, h, p, _, v in want if v}
    assert all(r.verdict == ruled.get((r.page_id, r.host, r.path), r.verdict) and r.verdict in ("allow", "block") for r in got)


def test_trees_tell_more_than_the_commonest_verdict(spark, data):
    """Of the URLs that a rule decides, one half is held out, by a hash; the trees and counts see the other half."""
    folder = os.path.join(os.path.dirname(data), "sf0.1")
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    known = {r.page_id: plain_rule(r.url)[3] for r in pages.collect()}
    held = {p for p, v in known.items() if v and zlib.crc32(str(p).encode()) % 2}
    seen = F.crc32(F.col("page_id").cast("string").cast("binary")) % 2 == 0
    got = {r.page_id: "block" if r.block_score >= 0.5 else "allow" for r in url_filter.judged(pages, learn_from=seen).collect()}
    right = np.mean([got[p] == known[p] for p in held])
    common = max(np.mean([known[p] == v for p in held]) for v in ("allow", "block"))
    print(f"{len(held)} held-out urls: trees {right:.3f}, commonest verdict {common:.3f}")
    assert right > common


@pytest.mark.parametrize("folder", ["sf0.1"])
def test_toxicity_of_documents_held_out(spark, data, folder):
    """Rank of toxic among clean labelled documents that were not learned from."""
    root = os.path.join(os.path.dirname(data), folder)
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.learn_and_score(docs.select("doc_id", "text"), labels).filter("held_out")
    rows = found.join(labels.filter("toxic is not null").select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = (np.array([r.score for r in rows if r.toxic == y]) for y in (1, 0))
    above = (toxic[:, None] > clean[None, :]).mean() + 0.5 * (toxic[:, None] == clean[None, :]).mean()
    print(f"{len(toxic)} toxic, {len(clean)} clean: area {above:.4f}")
    assert len(toxic) >= 20 and above > 0.95
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
