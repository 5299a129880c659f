"""Which beginnings conversations share: a trie of their turns.

Every task keeps a z-fast trie (Belazzougui et al., 2009) of the conversations
that it reads. Only branching nodes, leaves and ends are nodes there; each is
found in a hash table by its handle, the prefix whose length is the two-fattest
number of its edge. A conversation's exit node takes a binary search over
two-fattest lengths, each step one look-up of a prefix digest. Conversations
enter in batches; a trie that has grown to its bound expands its edges into one
row per node, with its members counted, and starts anew. Rows of equal prefixes
are added up by Spark.

Sums over subtrees do not go node by node. The smallest member of a node stays
the smallest down to its own end, so nodes with one smallest member form a
chain, and chains form a tree. Totals of that tree's subtrees take a round per
doubling of its height; suffix sums along the chains do the rest.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from ..session import spread_out
from .tables import stored, with_type_of

ROOT = hashlib.blake2b(digest_size=16).digest()


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the largest power of two divides."""
    return b & -1 << ((a ^ b).bit_length() - 1)


class Node:
    """An edge of the trie and its lower end: prefixes of low + 1 to depth turns, as digests with the size of their last turn."""

    __slots__ = ("low", "digests", "sizes", "children", "parent", "members", "least")

    def __init__(self, low: int, digests: list[bytes], sizes: list[int], parent: Node | None):
        self.low, self.digests, self.sizes, self.parent = low, digests, sizes, parent
        self.children: dict[bytes, Node] = {}
        self.members, self.least = 0, None

    @property
    def depth(self) -> int:
        return self.low + len(self.digests)

    def handle(self) -> bytes:
        return self.digests[two_fattest(self.low, self.depth) - self.low - 1]


class ZFastTrie:
    """Prefixes of sequences, given as lists of digests: the i-th stands for the first i + 1 turns."""

    def __init__(self) -> None:
        self.root = Node(0, [], [], None)
        self.handles: dict[bytes, Node] = {}
        self.held = 0

    def exit_node(self, path: list[bytes]) -> Node:
        """The node on whose edge, or at whose end, the way of `path` through the trie ends."""
        node, a, b = self.root, 0, len(path)
        while a < b:
            f = two_fattest(a, b)
            found = self.handles.get(path[f - 1])
            if found is None:
                b = f - 1
                continue
            node = found
            if node.depth > len(path) or path[node.depth - 1] != node.digests[-1]:
                return node
            a = node.depth
        # nothing below has its handle on the path; its edge may still begin there
        return node.children.get(path[node.depth], node) if node.depth < len(path) else node

    def insert(self, conv, path: list[bytes], sizes: list[int]) -> None:
        node = self.exit_node(path)
        shared = bisect_left(range(len(node.digests)), True, key=lambda k: node.low + k >= len(path) or path[node.low + k] != node.digests[k])
        if shared < len(node.digests):
            node = self._split(node, shared)
        if node.depth < len(path):
            leaf = Node(node.depth, path[node.depth :], sizes[node.depth :], node)
            node.children[leaf.digests[0]] = leaf
            self.handles[leaf.handle()] = leaf
            self.held += len(leaf.digests) + 1
            node = leaf
        node.members += 1
        node.least = conv if node.least is None else min(node.least, conv)

    def _split(self, node: Node, shared: int) -> Node:
        """Cuts the node's edge after `shared` turns; returns the new upper part."""
        del self.handles[node.handle()]
        upper = Node(node.low, node.digests[:shared], node.sizes[:shared], node.parent)
        node.parent.children[upper.digests[0]] = upper
        node.low, node.digests, node.sizes, node.parent = upper.depth, node.digests[shared:], node.sizes[shared:], upper
        upper.children[node.digests[0]] = node
        self.handles[upper.handle()] = upper
        self.handles[node.handle()] = node
        self.held += 1
        return upper

    def insert_batch(self, batch: list[tuple]) -> None:
        for conv, path, sizes in batch:
            self.insert(conv, path, sizes)

    def expanded(self) -> Iterator[tuple]:
        """(depth, digest, digest of the parent, size of the last turn, members, smallest member) of every node of the plain trie."""
        order, at = [self.root], 0
        while at < len(order):
            order.extend(order[at].children.values())
            at += 1
        for node in reversed(order):  # children before parents
            if node.parent is not None:
                node.parent.members += node.members
                node.parent.least = node.least if node.parent.least is None else min(node.parent.least, node.least)
        if self.root.members:
            yield 0, ROOT, None, 0, self.root.members, self.root.least
        for node in order[1:]:
            before = node.parent.digests[-1] if node.parent.digests else ROOT
            for k, (digest, size) in enumerate(zip(node.digests, node.sizes, strict=True)):
                yield node.low + k + 1, digest, before, size, node.members, node.least
                before = digest


def _inserter(most: int, batch_turns: int):
    """Rows (conv, key, size) in order of conversation and turn to rows of nodes, and one row without members per conversation."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        halves = lambda d: (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True))
        names = ["depth", "d1", "d2", "p1", "p2", "size", "n_convs", "conv"]
        kind = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], kind)], names)

        def nodes() -> Iterator:
            rows = []
            for depth, digest, before, size, members, least in trie.expanded():
                rows.append((depth, *halves(digest), *(halves(before) if before else (None, None)), size, members, least))
                if len(rows) == 8192:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

        trie, waiting, turns, ends = ZFastTrie(), [], 0, []
        conv, path, sizes, state = None, [], [], None

        def close() -> None:
            if conv is not None:
                waiting.append((conv, path, sizes))
                ends.append((len(path), *halves(path[-1] if path else ROOT), None, None, None, None, conv))

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, key, size in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    close()
                    conv, path, sizes, state = c, [], [], ROOT
                    if turns >= batch_turns:
                        trie.insert_batch(waiting)
                        waiting, turns = [], 0
                        yield table(ends)
                        ends = []
                        if trie.held >= most:
                            yield from nodes()
                            trie = ZFastTrie()
                turns += 1
                if key is not None:
                    state = hashlib.blake2b(state + key, digest_size=16).digest()
                    path.append(state)
                    sizes.append(size)
        close()
        if waiting:
            trie.insert_batch(waiting)
            yield table(ends)
        if kind is not None:
            yield from nodes()

    return run


def turn_keys(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Adds key and size: 16 bytes of a digest of role and text, and the UTF-8 bytes of the text. Null role or text is empty."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256))
    return turns.withColumn("key", F.substring(digest, 1, 16)).withColumn("size", F.octet_length(t).cast("long"))


class PrefixTrie(NamedTuple):
    """`nodes`: one row per distinct beginning; `ends`: conversation, and the digest (d1, d2) of its whole."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", ids: DataFrame | None = None, most: int = 200_000, batch_turns: int = 20_000
) -> PrefixTrie:
    """The trie of conversations, whose turns have the columns `key` and `size` of `turn_keys`.

    A node is a distinct sequence of a conversation's first `depth` turns,
    from the root with none. Columns of `nodes`: conv (smallest member), depth,
    parent_conv (smallest member of the parent, null for the root), n_convs,
    n_children, n_leaves (childless nodes of the subtree, the node included),
    saved (over the subtree, members less one times the size of the last
    turn), d1, d2. Turns are ordered by `turn`, null first, equal ones by
    their key. `ids` names further conversations, which may have no turn; they
    are members of the root. Rows without a conversation belong to none and
    are left out. Equal rows are turns of their own. No conversation, no node.
    Other columns are ignored.

    A task's trie holds about `most` turns and nodes, and the conversations of
    one batch; a conversation is read by one task.
    """
    own = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), "key", "size").filter("conv is not null")
    every = own.select("conv") if ids is None else own.select("conv").unionByName(ids.select(F.col(conv).alias("conv")).filter("conv is not null"))
    marks = every.distinct().select("conv", F.lit(None).cast(own.schema["turn"].dataType).alias("turn"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("size"))
    dealt = spread_out(own.unionByName(marks), "conv").sortWithinPartitions("conv", "turn", "key").select("conv", "key", "size")
    schema = with_type_of(dealt, {"conv": "conv"}, "depth long, d1 long, d2 long, p1 long, p2 long, size long, n_convs long")
    made = stored(dealt.mapInArrow(_inserter(most, batch_turns), schema[1:].add(schema[0])), "trie")
    ends = made.filter("n_convs is null").select("conv", "depth", "d1", "d2")
    plain = stored(
        made.filter("n_convs is not null").groupBy("d1", "d2").agg(
            F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("size").alias("size"), F.sum("n_convs").alias("n_convs"),
            F.min("conv").alias("conv"),
        ), "nodes",
    )
    children = plain.filter("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    above = plain.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent_conv"))
    nodes = stored(
        plain.join(children, ["d1", "d2"], "left").join(above, ["p1", "p2"], "left").withColumns({
            "n_children": F.coalesce("n_children", F.lit(0).cast("long")), "own_saved": (F.col("n_convs") - 1) * F.col("size"),
        }).withColumn("own_leaf", (F.col("n_children") == 0).cast("long")), "nodes",
    )
    hung = _chain_totals(nodes).filter("above is not null").groupBy(F.col("above").alias("conv"), F.col("above_depth").alias("depth")).agg(
        F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved")
    )
    below = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda a, b: F.sum(F.col(a) + F.coalesce(b, F.lit(0))).over(below)
    full = nodes.join(hung, ["conv", "depth"], "left").select(
        "conv", "depth", "parent_conv", "n_convs", "n_children", total("own_leaf", "hung_leaves").alias("n_leaves"),
        total("own_saved", "hung_saved").alias("saved"), "d1", "d2",
    )
    return PrefixTrie(full, ends)


def _chain_totals(nodes: DataFrame) -> DataFrame:
    """Rows (conv, above, above_depth, leaves, saved): each chain, the node that it hangs from, and the sums of all chains below it and itself.

    After k rounds the sums cover the chains less than 2**k steps down, and
    `up` is the chain 2**k steps above.
    """
    top = F.min(F.struct("depth", "parent_conv"))
    chains = stored(
        nodes.groupBy("conv").agg(top.alias("top"), F.sum("own_leaf").alias("leaves"), F.sum("own_saved").alias("saved")).select(
            "conv", F.col("top.parent_conv").alias("above"), (F.col("top.depth") - 1).alias("above_depth"), "leaves", "saved", F.col("top.parent_conv").alias("up")
        ), "chains",
    )
    while not chains.filter("up is not null").isEmpty():
        given = chains.filter("up is not null").groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = chains.select(F.col("conv").alias("up"), F.col("up").alias("next"))
        chains = stored(
            chains.join(given, "conv", "left").join(jump, "up", "left").select(
                "conv", "above", "above_depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("next").alias("up"),
            ), "chains",
        )
    return chains


def _joined(batches: Iterator) -> Iterator:
    """Sorted rows (d1, d2, conv) to rows (d1, d2, first, text): conversations of a node, comma-joined, some thousand at a time."""
    import pyarrow as pa

    now, first, texts, out = None, None, [], []
    kind = None

    def table() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], kind), pa.array(columns[3], pa.string())], ["d1", "d2", "first", "text"]
        )

    for batch in batches:
        kind = batch.schema.field(2).type
        for d1, d2, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (d1, d2) or len(texts) == 4096:
                if texts:
                    out.append((*now, first, ",".join(texts)))
                now, first, texts = (d1, d2), conv, []
                if len(out) >= 1024:
                    yield table()
                    out = []
            texts.append(str(conv))
    if texts:
        out.append((*now, first, ",".join(texts)))
    if out:
        yield table()


def _hashed(batches: Iterator) -> Iterator:
    """Sorted rows (d1, d2, text) to a row (d1, d2, sha256) per node, of its texts joined by commas."""
    import pyarrow as pa

    now, state, out = None, None, []
    for batch in batches:
        for d1, d2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now == (d1, d2):
                state.update(b",")
            else:
                if state:
                    out.append((*now, state.hexdigest()))
                now, state = (d1, d2), hashlib.sha256()
            state.update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["d1", "d2", "ends_sha256"])
            out = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], ["d1", "d2", "ends_sha256"])


def end_digests(ends: DataFrame, conv: str = "conv") -> DataFrame:
    """Rows (d1, d2, ends_sha256) for each node where a conversation ends: the hash of those conversations' ids, ascending, comma-joined.

    Ids are joined where they lie after a sort over all tasks; what one task
    reads of a node with very many ends is a row per few thousand of them.
    """
    frame = ends.select("d1", "d2", F.col(conv).alias("conv"))
    sorted_ = frame.repartitionByRange("d1", "d2", "conv").sortWithinPartitions("d1", "d2", "conv")
    parts = sorted_.mapInArrow(_joined, with_type_of(frame, {"d1": "d1", "d2": "d2", "first": "conv"}, "text string"))
    return spread_out(parts, "d1", "d2").sortWithinPartitions("d1", "d2", "first").select("d1", "d2", "text").mapInArrow(
        _hashed, "d1 long, d2 long, ends_sha256 string"
    )
