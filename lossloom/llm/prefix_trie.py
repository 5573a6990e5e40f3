"""Conversation prefix trie from ternary search trees, one per range shard of the sorted conversations.

Turns are dictionary-encoded: every distinct (role, text) gets an id, and a conversation is the array of its ids. The arrays are
sorted and cut into range shards, equal conversations by their ids, so that no beginning, however common, is held by one task. A
shard builds one ternary search tree: its distinct sequences go in by their median first, then the medians of both halves, which
keeps the trees of siblings balanced. Nodes are numbered as they are made, children after parents, so that one loop from the last
node to the first gathers members, leaves and savings without recursion.

Only the beginnings of the first and of the last sequence of a shard can occur in another shard; these nodes are open, all others
are final. Open nodes of all shards are merged by the digest of their turns. What hangs on them is added up along the shards'
border sequences: every open node counts on one of the borders that hold it, each border sums from its end to its start, and a
node's subtree is the sum of those borders' values at the node. No step walks the depths one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.llm.common import join_sized
from lossloom.sources.store import cut_lineage

STEP, HEADS = 5, 9
#: Turns per range shard, on average.
SHARD = 32_000

_ROOT = hashlib.blake2b(b"root", digest_size=16).digest()
NODES = ("kind string, key binary, parent binary, border string, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, size bigint, ends binary, first_end bigint")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class TernaryTree:
    """Sequences of turn ids with their conversations. Lists hold one entry per node; node 0 is the root, -1 is no node."""

    def __init__(self) -> None:
        self.code, self.low, self.high, self.below = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.size, self.members, self.least, self.ends = [-1], [0], [0], [0], [None], [None]

    def _child(self, at: int, code: int, size: int) -> int:
        """The child of ``at`` for one turn, made if there is none: a binary search tree among siblings."""
        links, where, node = self.below, at, self.below[at]
        while node >= 0:
            here = self.code[node]
            if code == here:
                return node
            links, where = (self.low, node) if code < here else (self.high, node)
            node = links[where]
        node = len(self.code)
        links[where] = node
        for column, value in ((self.code, code), (self.low, -1), (self.high, -1), (self.below, -1), (self.parent, at), (self.depth, self.depth[at] + 1),
                              (self.size, size), (self.members, 0), (self.least, None), (self.ends, None)):
            column.append(value)
        return node

    def insert(self, codes, sizes, convs: list[int]) -> None:
        """``convs``: ascending ids of the conversations that are this sequence."""
        node, n, low = 0, len(convs), convs[0]
        self._count(0, n, low)
        for code, size in zip(codes, sizes, strict=True):
            node = self._child(node, code, size)
            self._count(node, n, low)
        self.ends[node] = convs

    def _count(self, node: int, n: int, low: int) -> None:
        self.members[node] += n
        if self.least[node] is None or low < self.least[node]:
            self.least[node] = low

    def path(self, codes) -> list[int]:
        """Nodes from the root along a sequence that is in the tree."""
        out = [0]
        for code in codes:
            out.append(self._child(out[-1], code, 0))
        return out


def median_order(n: int) -> Iterator[int]:
    """0..n-1, each range's middle before its halves."""
    stack = [(0, n)]
    while stack:
        lo, hi = stack.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            stack += [(mid + 1, hi), (lo, mid)]


def shard_nodes(shard: str, rows: list[tuple]) -> Iterator[tuple]:
    """Rows of ``NODES`` for one shard; ``rows``: (codes, sizes, ascending conversation ids), distinct and in order."""
    tree = TernaryTree()
    for i in median_order(len(rows)):
        tree.insert(*rows[i])
    n = len(tree.code)
    borders = [tree.path(rows[0][0]), tree.path(rows[-1][0])]
    is_open = [False] * n
    for border in borders:
        for node in border:
            is_open[node] = True
    # What closed nodes add to their parents; an open child is counted after the merge.
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for node in range(n - 1, 0, -1):
        if not is_open[node]:
            if not children[node]:
                leaves[node] = 1
            saved[node] += (tree.members[node] - 1) * tree.size[node]
            up = tree.parent[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    # Digests of open nodes only: each is its parent's digest and one more turn.
    keys = {0: _ROOT}
    for border in borders:
        for node in border[1:]:
            if node not in keys:
                keys[node] = hashlib.blake2b(keys[tree.parent[node]] + tree.code[node].to_bytes(8, "little", signed=True), digest_size=16).digest()
    for node in range(n):
        if not is_open[node]:
            up, ends = tree.parent[node], tree.ends[node]
            text = ",".join(map(str, ends)).encode() if ends else b""
            row = (tree.depth[node], tree.least[node], None if is_open[up] else tree.least[up], tree.members[node], children[node], leaves[node], saved[node], 0,
                   hashlib.sha256(text).digest(), None)
            yield ("hung" if is_open[up] else "closed", None, keys[up] if is_open[up] else None, None, *row)
    # One row per border and open node; a node of both borders brings its counts once.
    told = set()
    for name, border in zip(("first", "last"), borders, strict=True):
        for node in border:
            once = node not in told
            told.add(node)
            up, ends = tree.parent[node], tree.ends[node] if once else None
            yield ("open", keys[node], keys[up] if node else None, f"{shard}-{name}", tree.depth[node], tree.least[node], None, tree.members[node] if once else 0,
                   children[node] if once else 0, leaves[node] if once else 0, saved[node] if once else 0, tree.size[node],
                   ",".join(map(str, ends)).encode() if ends else None, ends[0] if ends else None)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds one tree per partition; the rows come sorted by sequence and conversation."""
    from pyspark import TaskContext

    rows: list[tuple] = []
    for batch in batches:
        conv = batch.column(0).to_pylist()
        codes, sizes = (batch.column(i) for i in (1, 2))
        for i, c in enumerate(conv):
            s = codes[i].as_py()
            if rows and rows[-1][0] == s:
                rows[-1][2].append(c)
            else:
                rows.append((s, sizes[i].as_py(), [c]))
    if not rows:
        return
    held = []
    for row in shard_nodes(str(TaskContext.get().partitionId()), rows):
        held.append(row)
        if len(held) == 4096:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


_TYPES = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
_FIELDS = [x.strip().split(" ") for x in NODES.split(",")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def head_turns(conv: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its five."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


def encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, codes, sizes): the ids and the bytes of text of each conversation's turns, in order.

    Only digests are shuffled, never texts: the dictionary is counted by digest, and a turn said very often meets it in a broadcast join.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary")), 256))
    rows = cut_lineage(turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), F.octet_length(text).cast("long").alias("size")), "trie-turns")
    words = rows.groupBy("said").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    words = cut_lineage(words.withColumn("code", F.monotonically_increasing_id()), "trie-dictionary")
    coded = join_sized(rows.drop("size"), words, "said", "n")
    turn = F.sort_array(F.collect_list(F.struct("turn", "code", "size")))  # a null turn is the least
    grouped = coded.groupBy("conv_id").agg(turn.alias("t"))
    return grouped.select("conv_id", F.col("t.code").alias("codes"), F.col("t.size").alias("sizes"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, codes, sizes): the head of the group's first conversation, then the own turns after as many."""
    convs = convs.withColumn("_h", head_turns(F.col("conv_id"))).withColumn("_head", F.col("conv_id") - F.col("conv_id") % STEP)
    heads = convs.where("conv_id = _head").select(F.col("conv_id").alias("_head"), F.slice("codes", 1, HEADS - 1).alias("_c"), F.slice("sizes", 1, HEADS - 1).alias("_s"))
    both = convs.join(heads, "_head", "left")

    def joined(own: str, head: str) -> Column:
        first = F.when(F.col("_h") > 0, F.slice(F.coalesce(F.col(head), F.array().cast("array<bigint>")), F.lit(1), F.greatest(F.col("_h"), F.lit(1))))
        rest = F.when(F.size(own) > F.col("_h"), F.slice(own, F.col("_h") + 1, F.greatest(F.size(own) - F.col("_h"), F.lit(1))))
        return F.concat(F.coalesce(first, F.array().cast("array<bigint>")), F.coalesce(rest, F.array().cast("array<bigint>")))

    return both.select("conv_id", joined("codes", "_c").alias("codes"), joined("sizes", "_s").alias("sizes"))


def _streamed_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per key over rows sorted by key and first id; nothing is held but the state of the hash."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ends in zip(batch.column(0), batch.column(1), strict=True):
            k, ends = k.as_py(), ends.as_buffer()
            if k != key:
                if key is not None:
                    done.append((key, state.digest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ends)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.binary()) for i in (0, 1)], ["key", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (key, state.digest())], ["key", "sha"])


def merged(opened: DataFrame) -> DataFrame:
    """(key, n_paths and the node's final columns) from the open rows of all shards."""
    total = opened.groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed"),
        F.sum("n_leaves").alias("hung_leaves"), F.sum("saved_tokens").alias("hung_saved"), F.max("size").alias("size"), F.min("border").alias("owner"))
    total = cut_lineage(total, "trie-merged")
    open_children = total.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("opened"))
    own = total.join(open_children, "key", "left").withColumn("n_children", F.col("closed") + F.coalesce("opened", F.lit(0)))
    own = own.withColumn("leaves", F.col("hung_leaves") + (F.col("n_children") == 0).cast("long"))
    own = cut_lineage(own.withColumn("saved", F.col("hung_saved") + (F.col("n_convs") - 1) * F.col("size")), "trie-own")
    # Each border adds up, from its end to its start, the nodes it owns.
    border = Window.partitionBy("border").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    owned = opened.select("key", "border", "depth").join(own.select(F.col("key"), F.col("owner").alias("border"), "leaves", "saved"), ["key", "border"], "left")
    paths = owned.select("key", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(border).alias(c) for c in ("leaves", "saved")])
    sums = paths.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    sha = (opened.where("ends is not null").select("key", "ends", "first_end").repartition("key").sortWithinPartitions("key", "first_end")
           .select("key", "ends").mapInArrow(_streamed_sha, "key binary, sha binary"))
    return (own.select("key", "parent", "depth", "conv_id", "n_convs", "n_children").join(sums, "key").join(sha, "key", "left")
            .withColumn("ends_sha256", F.coalesce(F.lower(F.hex("sha")), F.sha2(F.lit("").cast("binary"), 256))).drop("sha"))


def trie(convs: DataFrame, per_shard: int = SHARD) -> DataFrame:
    """The trie of (conv_id, codes, sizes) rows: one row per node with ``COLUMNS``."""
    convs = cut_lineage(convs, "trie-conversations")
    rows, turns = convs.agg(F.count(F.lit(1)), F.sum(F.size("codes") + 1)).first()
    shards = min(max(1, rows), max(1, -(-(turns or 0) // per_shard)))
    dealt = convs.repartitionByRange(shards, "codes", "conv_id").sortWithinPartitions("codes", "conv_id")
    nodes = cut_lineage(dealt.select("conv_id", "codes", "sizes").mapInArrow(_shards, NODES), "trie-nodes")
    opened = cut_lineage(merged(nodes.where("kind = 'open'")), "trie-open")
    final = [F.lower(F.hex("ends")).alias("ends_sha256") if c == "ends_sha256" else F.col(c) for c in COLUMNS]
    closed = nodes.where("kind = 'closed'").select(*final)
    hung = nodes.where("kind = 'hung'").drop("parent_conv_id")
    parents = opened.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    hung = join_sized(hung, parents, "parent", "_n").select(*final)
    up = opened.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).alias("_n"))
    inner = opened.join(up, "parent", "left").select(*COLUMNS)
    return closed.unionByName(hung).unionByName(inner)


def prefix_trie(turns: DataFrame, per_shard: int = SHARD) -> DataFrame:
    """The trie of the rebuilt conversations; see ``rebuilt`` and ``COLUMNS``.

    Turns go by turn, null first, ties by content; every row is a turn, repeated ones too. A null role or text is empty; rows without
    a conv_id belong to no conversation and take no part. Turns with one SHA-256 of role and text are taken as equal. Other columns
    are not read. No conversations, no nodes. The turn ids of one conversation, 16 bytes a turn, are held by one task; texts never are.
    """
    return trie(rebuilt(encoded(turns.select("conv_id", "turn", "role", "text"))), per_shard)
