"""Suffix grouping, repeated stretches, periodic runs and the conversation trie against brute force."""

import hashlib
import random

import numpy as np
import pytest

from glimmerline.llm import periodic_runs, prefix_trie, repeated_text
from glimmerline.llm.recompression import Grammar
from glimmerline.llm.suffix_groups import suffix_arrays


def test_suffix_arrays_of_many_strings():
    r = random.Random(1)
    for _ in range(120):
        strings = []
        for _ in range(r.randint(1, 8)):
            letters = r.choice(["ab", "a", "abc", "abcdefgh"])
            s = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
            strings.append(s[: r.randint(1, 5)] * r.randint(1, 9) if r.random() < 0.3 else s)
        want, base = [], 0
        for s in strings:
            want += [base + i for i in sorted(range(len(s)), key=lambda i, s=s: s[i:])]
            base += len(s)
        symbols = np.frombuffer("".join(strings).encode(), np.uint8)
        assert suffix_arrays(symbols, np.array([len(s) for s in strings])).tolist() == want
    assert suffix_arrays(np.zeros(0, np.uint8), np.zeros(0, np.int64)).tolist() == []


def repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for (key, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        edges = [p for p in range(len(b) + 1) if (p < len(b) and gone[p]) != (p > 0 and bool(gone[p - 1]))]
        out.append((key, len(b), list(zip(edges[::2], edges[1::2], strict=True)), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length,most", [(16, 48), (16, 2), (40, 3)])
def test_repeated_stretches(spark, length, most):
    r = random.Random(length + most)
    word = lambda low, high: "".join(r.choice("abcdé ") for _ in range(r.randint(low, high)))
    passages = [word(10, 120) for _ in range(8)]
    rows = [
        (i // 2 if r.random() < 0.8 else None, "".join(r.choice(passages) if r.random() < 0.4 else word(0, 60) for _ in range(r.randint(0, 6))))
        for i in range(120)
    ]
    rows += [rows[5]] * 3 + [(7, None), (8, ""), (None, None), (999, "ab" * 300), (998, "a" * 500), (997, "  " + passages[0])]
    frame = spark.createDataFrame([(*x, "c", 1, 2) for x in rows], "doc_id long, text string, bytes string, a int, key int")
    got = repeated_text.without_repeats(frame, length=length, most=most).collect()
    assert sorted(((x.doc_id, x.n_bytes, [(s.start, s.end) for s in x.spans], bytes(x.kept)) for x in got), key=repr) == repeats(rows, length)
    assert repeated_text.without_repeats(frame.filter("false")).count() == 0


def test_windows_over_the_borders_of_a_block(spark, monkeypatch):
    """A text longer than what is read at once."""
    r = random.Random(4)
    long = "".join(r.choice("abcd") for _ in range(5000))
    rows = [(1, long), (2, long[1000:1500]), (3, "x" + long[3990:4030] + "y")]
    monkeypatch.setattr(repeated_text, "_BLOCK", 512)
    parts = [repeated_text.segments(np.frombuffer(d, np.uint8), s, np.append(s[1:], len(d)), 40, 16)[1:3] for _, d, s, _ in repeated_text._parts([long.encode()], 40)]
    assert sum(int((hi - lo).sum()) for lo, hi in parts) == len(long) - 39
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in repeated_text.without_repeats(frame, length=40).collect()}
    assert got == {k: s for k, _, s, _ in repeats(rows, 40)}


def brute_runs(words, least=6, times=4):
    best = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def test_common_extensions():
    r = random.Random(3)
    for _ in range(60):
        s = np.array([5] + [r.randrange(2) for _ in range(120)] + [6])
        grammar = Grammar(s)
        a, b = (np.array(x) for x in zip(*[(i, j) for i in range(0, 122, 7) for j in range(0, 122, 5) if i != j], strict=True))
        for back, step in ((False, 1), (True, -1)):
            for i, j, n in zip(a, b, grammar.extensions(a, b, back), strict=True):
                want = 0
                while 0 <= min(i, j) + step * want and max(i, j) + step * want < len(s) and s[i + step * want] == s[j + step * want]:
                    want += 1
                assert want == n


def random_words(r):
    some = "a b cc É".split()[: r.choice([1, 2, 4])]
    words = [r.choice(some) for _ in range(r.randint(0, 80))]
    at = r.randint(0, len(words))
    words[at:at] = ([r.choice(some) for _ in range(r.randint(1, 9))] * 40)[: r.randint(0, 60)]
    return words


def test_periodic_runs(spark):
    r = random.Random(6)
    rows = [(i // 3 if i % 5 else None, r.choice([" ", "\n", "\t ", "  "]).join(random_words(r))) for i in range(300)]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "x " * 30_000), (5, " ".join(map(str, list(range(700)) * 20))), rows[0], rows[0]]
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, runs int, id int")
    want = []
    for key, text in rows:
        words = (text or "").split()
        runs = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1 if words[0] == "x" else 700)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((key, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    got = [(x.doc_id, x.n_words, [tuple(s) for s in x.runs], x.collapsed) for x in periodic_runs.periodic_runs(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(frame.filter("false")).count() == 0


def test_trie_of_a_task():
    for a in range(40):
        for b in range(a + 1, 41):
            assert prefix_trie.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)
    r = random.Random(2)
    for _ in range(150):
        k = r.choice([1, 2, 3])
        ways = [[r.randrange(k) for _ in range(r.randint(0, 14))] for _ in range(r.randint(1, 30))]
        trie, want = prefix_trie.ZFastTrie(), {}
        for i, way in enumerate(ways):
            path, state = [], prefix_trie.ROOT
            for x in way:
                state = hashlib.blake2b(state + bytes([x]), digest_size=16).digest()
                path.append(state)
            trie.insert_batch([(i, path, way)])
            for d in range(len(way) + 1):
                want.setdefault(tuple(way[:d]), []).append(i)
        assert all(node is trie.exit_node(path[: node.depth]) for h, node in trie.handles.items() if path[: node.depth][-1:] == node.digests[-1:])
        got = sorted((d, n, least, size) for d, _, _, size, n, least in trie.expanded())
        assert got == sorted((len(p), len(c), min(c), p[-1] if p else 0) for p, c in want.items())


def brute_trie(ways):
    members, ends = {}, {}
    for c, way in ways.items():
        for d in range(len(way) + 1):
            members.setdefault(way[:d], []).append(c)
        ends.setdefault(way, []).append(c)
    out = []
    for p in members:
        kids = [x for x in members if len(x) == len(p) + 1 and x[: len(p)] == p]
        under = [x for x in members if x[: len(p)] == p]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0) for x in under)
        listed = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), len(leaves), saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,most", [(1, 200_000), (2, 10)])
def test_conversation_trie(spark, seed, most):
    r = random.Random(seed)
    rows, ways = [], {}
    for c in range(60):
        way = [(r.choice(["user", "", None]), r.choice(["é", "b", None, ""])) for _ in range(r.choice([0, 1, 2, 3, 9]))]
        ways[c] = tuple((a or "", b or "") for a, b in way)
        rows += [(c, k if k else None, a, b) for k, (a, b) in enumerate(way)]
    for c in range(100, 140):  # each begins with the next one: a chain as high as there are conversations
        ways[c] = (("user", "deep"),) * (140 - c)
        rows += [(c, k, "user", "deep") for k in range(140 - c)]
    rows += [(None, 1, "user", "x"), (None, None, None, None)]
    r.shuffle(rows)
    frame = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "conv_id long, turn int, role string, text string, d1 int, depth int, conv int")
    ids = spark.createDataFrame([(c,) for c in ways] + [(None,)], "conv_id long")
    keyed = prefix_trie.turn_keys(frame)
    trie = prefix_trie.prefix_trie(keyed, ids=ids, most=most, batch_turns=20)
    ends = {(x.d1, x.d2): x.ends_sha256 for x in prefix_trie.end_digests(trie.ends).collect()}
    none = hashlib.sha256(b"").hexdigest()
    got = [(x.conv, x.depth, x.parent_conv, x.n_convs, x.n_children, x.n_leaves, x.saved, ends.get((x.d1, x.d2), none)) for x in trie.nodes.collect()]
    assert sorted(got, key=repr) == brute_trie(ways)
    empty = prefix_trie.prefix_trie(keyed.filter("false"), ids=ids.filter("false"))
    assert empty.nodes.count() == 0 and prefix_trie.end_digests(empty.ends).count() == 0


def test_ends_of_a_hot_node(spark):
    """Ids of one node, spread over all tasks, are hashed in order."""
    ends = spark.range(30_000).selectExpr("id * 7 % 30000 AS conv", "1 AS d1", "2 AS d2")
    ends = ends.selectExpr("conv", "cast(d1 AS long) AS d1", "cast(d2 AS long) AS d2").repartition(6)
    (row,) = prefix_trie.end_digests(ends).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest()


def test_words_are_hashed_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from glimmerline.llm import words

    texts = [b"word%d " % k * 3 for k in range(100_000)] + [b"x" * 600_000, None, b"ab"]
    block = next(words.blocks(texts, words.BLANKS, 1 << 22))
    tracemalloc.start()
    whole = block.hashes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # one pass over all bytes held ten arrays of 8 bytes a byte
    some = [0, 1, len(whole) // 2, len(whole) - 2, len(whole) - 1]
    alone = [words.Block(block.data, block.row[[k]], block.start[[k]], block.length[[k]]).hashes()[0] for k in some]
    assert [whole[k] for k in some] == alone
    batch = pa.RecordBatch.from_arrays([pa.array(range(4500))], ["id"])
    parts = [*words.some_rows([batch, batch.slice(0, 0)])]
    assert [p.num_rows for p in parts] == [2000, 2000, 500]
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(4500)]
