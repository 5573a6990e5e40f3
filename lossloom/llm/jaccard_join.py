"""N-gram Jaccard self-join of documents by chosen paths.

A document is its set of five-word shingles. Documents with equal sets are one node. Each node gets ``TOKENS`` minhash
tokens, so that two nodes share a token with the probability of their similarity. A run walks a tree: at every step a
node follows each of its tokens with a chance of 1 / (threshold * TOKENS), drawn from a hash of path and token, so that nodes
that share a followed token go on together. Paths of ``DEPTH`` steps are the first buckets; buckets above ``LIMIT`` nodes are
split by further steps, small ones are compared pair by pair on their tokens. Runs are repeated until a pair at the threshold
meets with the target recall. No pairs leave a bucket: it reports a spanning forest of the pairs whose tokens agree nearly
enough, and the components of all forests are the candidate groups. Every group is verified on the whole shingle sets, in
blocks so that each pair is checked exactly once; a block reports its link counts and a spanning forest of the links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossloom.llm.common import bounded_batches, join_sized, slices
from lossloom.llm.components import components
from lossloom.llm.wordhash import WORDS, mix, word_hashes
from lossloom.sources.store import cut_lineage

NGRAM, THRESHOLD = 5, 0.8
TOKENS = 128
LIMIT = 4096
#: Nodes of a candidate group whose shingle sets one task holds per side of a comparison.
BLOCK = 256
DEPTH, MAX_DEPTH = 2, 8
#: Depth that the first runs allow for. Nodes of a bucket that is followed further get more runs.
COMMON_DEPTH = 4
RECALL = 0.999
#: Token agreement from which a pair is a candidate: 4.5 standard deviations below the threshold.
SLACK = 4.5

_RNG = np.random.default_rng(977)
_A = _RNG.integers(0, 1 << 31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0x100000001B3)


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, when one run succeeds with 1 / (depth + 1) at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - 1 / (depth + 1)))


def shingles(raw: bytes, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and the texts' offsets in them. A text of fewer than n words is one shingle."""
    words, at = word_hashes(raw.translate(WORDS), offsets)
    docs = len(offsets) - 1
    count = np.diff(at)
    full = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        full = full * _P + words[j:j + len(full)]
    owner = np.repeat(np.arange(docs), count)
    inside = owner[:len(full)] == owner[n - 1:] if len(full) else np.zeros(0, bool)
    values, owners = [full[inside]], [owner[:len(full)][inside]]
    for d in np.flatnonzero((count > 0) & (count < n)).tolist():
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in words[at[d]:at[d + 1]]:
                h = h * _P + w
        values.append(np.array([h], np.uint64))
        owners.append(np.array([d]))
    value, owner = mix(np.concatenate(values)), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])][:len(value)]
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(docs + 1))


def node_of(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit identity per shingle set; 0 for the empty set, which ``features`` replaces."""
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value ^ _STEP), out=sums[1:])
    return np.where(np.diff(at) > 0, mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)), np.uint64(0)).view(np.int64)


def signatures(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """TOKENS minhash values per text (0 for texts without shingles)."""
    filled = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, TOKENS), np.uint32)
    if len(filled):
        low = (value >> np.uint64(32)).astype(np.uint32)
        for j in range(TOKENS):
            out[filled, j] = np.minimum.reduceat(low * _A[j] + _B[j], at[filled])
    return out


def step(paths: np.ndarray, rows: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of sig, longer path) for every token that the paths follow. ``rows`` gives the signature row of each path."""
    most = np.uint64(min(1.0, 1 / (threshold * TOKENS)) * 2**64 - 1)
    out_rows, out_paths = [], []
    tokens = mix(np.arange(TOKENS, dtype=np.uint64)[None, :] << np.uint64(32) | sig)
    for lo in range(0, len(paths), 4096):
        p, r = paths[lo:lo + 4096], rows[lo:lo + 4096]
        drawn = mix(tokens[r] ^ p[:, None])
        i, j = np.nonzero(drawn < most)
        out_rows.append(r[i])
        out_paths.append(mix(drawn[i, j] + _STEP))
    return np.concatenate(out_rows) if out_rows else rows, np.concatenate(out_paths) if out_paths else paths


def _array(binary: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(binary.to_pylist()), dtype).reshape(-1, width)


def features(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """(key, node, sig) of every row. A text without words is identified by its bytes and has no signature."""
    schema = T.StructType([docs.schema["key"], T.StructField("node", T.LongType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in slices(batch, "text"):
                value, at = shingles(raw, offsets, n)
                node, sig = node_of(value, at).copy(), [s.tobytes() for s in signatures(value, at)]
                for d in np.flatnonzero(np.diff(at) == 0).tolist():
                    node[d] = int.from_bytes(hashlib.blake2b(raw[offsets[d]:offsets[d + 1]], digest_size=8, key=b"wordless").digest(), "little", signed=True)
                    sig[d] = None
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(node), pa.array(sig, pa.binary())], schema.names)

    return docs.select("key", "text").mapInArrow(run, schema)


PATHS = T.StructType([T.StructField("path", T.LongType()), T.StructField("node", T.LongType())])


def first_paths(nodes: DataFrame, runs: range, depth: int, threshold: float) -> DataFrame:
    """(path, node) after ``depth`` steps of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sig, n = _array(part.column(1), "<u4", TOKENS), part.num_rows
                rows = np.tile(np.arange(n), len(runs))
                paths = mix(np.repeat(np.array(runs, dtype=np.uint64), n) * _STEP)
                for _ in range(depth):
                    rows, paths = step(paths, rows, sig, threshold)
                node = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(node[rows])], PATHS.names)

    return nodes.select("node", "sig").mapInArrow(run, PATHS)


def longer_paths(large: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """One more step of the nodes in large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                rows, paths = step(part.column(0).to_numpy().view(np.uint64), np.arange(part.num_rows), _array(part.column(2), "<u4", TOKENS), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(part.column(1).to_numpy()[rows])], PATHS.names)

    return large.select("path", "node").join(nodes.select("node", "sig"), "node").select("path", "node", "sig").mapInArrow(run, PATHS)


def buckets(nodes: DataFrame, runs: range, threshold: float, limit: int, depth: int, max_depth: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(path, node) of all buckets with two to ``limit`` nodes; the nodes whose buckets went beyond COMMON_DEPTH, if any; the depth reached.

    A bucket that ``max_depth`` steps leave above the limit is cut into blocks of half the limit, and every two blocks form
    a bucket: nodes that no path can part are almost all similar to each other.
    """
    found, deep, level = [], None, cut_lineage(first_paths(nodes, runs, depth, threshold), "paths")
    while True:
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = cut_lineage(level.join(sizes, "path"), "buckets")
        found.append(sized.where(F.col("n") <= limit).select("path", "node"))
        large = sized.where(F.col("n") > limit)
        if large.isEmpty():
            break
        if depth >= max_depth:
            half = limit // 2
            block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / half)).cast("int")
            pairs = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / half).cast("int") - 1), lambda i: F.struct(F.least(i, block).alias("a"), F.greatest(i, block).alias("b")))
            found.append(large.select("path", "node", F.explode(pairs).alias("_b")).select(F.xxhash64("path", "_b.a", "_b.b").alias("path"), "node"))
            break
        depth += 1
        if depth > COMMON_DEPTH and deep is None:
            deep = cut_lineage(large.select("node").distinct(), "deep")  # later large buckets lie inside these
        level = cut_lineage(longer_paths(large, nodes, threshold), "paths")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, deep, depth


def all_buckets(nodes: DataFrame, recall: float, threshold: float, limit: int, depth: int, max_depth: int) -> DataFrame:
    """(path, node) of the buckets of so many runs that a pair at the threshold has met with probability ``recall``.

    Two nodes meet in a run with 1 / (d + 1) at least, d being the depth to which their common buckets are followed. Runs for
    COMMON_DEPTH come first. Nodes in buckets that are followed further, and only those, take part in the runs that the depth
    reached asks for beyond these.
    """
    common = runs_for(recall, min(COMMON_DEPTH, max_depth))
    out, deep, reached = buckets(nodes, range(1, common + 1), threshold, limit, depth, max_depth)
    if deep is not None:
        some = cut_lineage(nodes.join(deep, "node", "left_semi"), "deep-nodes")
        while True:
            want = runs_for(recall, reached)
            more, _, now = buckets(some, range(common + 1, want + 1), threshold, limit, depth, max_depth)
            out, common = out.unionByName(more), want
            if now <= reached:
                break
            reached = now
    return out


EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least place in the connected component of each of n places, by spreading minima along the links."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def candidates(members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v): a spanning forest, per bucket, of the pairs whose tokens agree nearly as often as the threshold asks.

    Signatures travel as one byte per token. Rows come sorted by bucket; row i meets row i + 1, i + 2, ... of its bucket, all buckets at once.
    """
    least = TOKENS * threshold - SLACK * math.sqrt(TOKENS * threshold * (1 - threshold))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = _array(batch.column(1), "<u4", TOKENS).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in low], pa.binary())], ["node", "low"])

    def forest(path: np.ndarray, node: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        label, lag = np.arange(len(path)), 1
        left = np.flatnonzero(path[:-1] == path[1:])
        firsts, seconds, size = [], [], 0
        while len(left):
            for i in range(0, len(left), 8192):
                x = left[i:i + 8192]
                hit = x[np.count_nonzero(low[x] == low[x + lag], axis=1) >= least]
                new = hit[label[hit] != label[hit + lag]]
                firsts.append(new)
                seconds.append(new + lag)
                size += len(new)
            if size > 1 << 18 or lag % 16 == 0:  # what is connected by now need not be kept again
                label = _labels(len(path), np.concatenate([np.arange(len(path)), *firsts]), np.concatenate([label, *seconds]))
                firsts, seconds, size = [], [], 0
            lag += 1
            left = left[left + lag < len(path)]
            left = left[path[left] == path[left + lag]]
        label = _labels(len(path), np.concatenate([np.arange(len(path)), *firsts]), np.concatenate([label, *seconds]))
        # Each component hangs on its least node, so that the buckets of one group mostly name the same root.
        root = np.full(len(path), np.iinfo(np.int64).max)
        np.minimum.at(root, label, node)
        root = root[label]
        far = np.flatnonzero(root != node)
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], EDGES.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), _array(part.column(2), "u1", TOKENS)))
                size += part.num_rows
                if size >= 20_000:
                    path, node, low = (np.concatenate(x) for x in zip(*held, strict=True))
                    cut = int(np.searchsorted(path, path[-1]))  # the last bucket may go on
                    if cut:
                        yield forest(path[:cut], node[:cut], low[:cut])
                    held, size = [(path[cut:], node[cut:], low[cut:])], len(path) - cut
        if held:
            yield forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    low = nodes.select("node", "sig").mapInArrow(bytes_of, "node bigint, low binary")
    rows = members.join(low, "node").select("path", "node", "low").repartition("path").sortWithinPartitions("path")
    return rows.mapInArrow(run, EDGES)


LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("n", T.LongType())])
CELLS = 1 << 23


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections (exact), from products of 0/1 matrices over the values that occur twice or more."""
    n = len(sets)
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    order = order[count[column[order]] > 1]
    column, owner = column[order], owner[order]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    out = np.zeros((n, n), np.int64)
    width = max(1, CELLS // n)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((n, min(width, int(column[j - 1]) - lo + 1)), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        out += np.rint(m @ m.T).astype(np.int64)
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def verified(groups: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, n: int, block: int) -> DataFrame:
    """Exact check of each candidate group (u, root). Rows (u, v, n): with v, an edge of a spanning forest of links; without, n documents linked to u.

    A group of more than ``block`` nodes is dealt into blocks by hash, and every two blocks (and every block with itself)
    meet in one task, so that each pair is checked once. A node's set is sent to as many tasks as its group has blocks.
    """
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64("u"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(
        F.xxhash64("root", F.least(i, F.col("_own")), F.greatest(i, F.col("_own"))).alias("home"), (i == F.col("_own")).alias("inner")))
    placed = groups.join(sizes, "root").withColumn("_own", own).select(F.col("u").alias("node"), "_own", meets.alias("homes"))
    wanted = placed.join(nodes.select("node", "rep", "size"), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in slices(batch, "text"):
                value, at = shingles(raw, offsets, n)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:4]],
                                                  pa.array([value[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())],
                                                 ["node", "size", "own", "homes", "set"])

    texts = docs.select(F.col("key").alias("rep"), "text").join(wanted, "rep").select("node", "size", F.col("_own").alias("own"), "homes", "text")
    shipped = texts.mapInArrow(sets, "node bigint, size bigint, own int, homes array<struct<home: bigint, inner: boolean>>, set binary")
    shipped = shipped.select(F.explode("homes").alias("h"), "node", "size", "own", "set").select("h.home", "h.inner", "node", "size", "own", "set")

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        inner, node, size, own = rows[0][1], *(np.array([r[i] for r in rows]) for i in (2, 3, 4))
        values = [np.frombuffer(r[5], np.uint64) for r in rows]
        both, count = shared(values), np.array([len(v) for v in values])
        good = both >= threshold * (count[:, None] + count[None, :] - both) - 1e-9
        np.fill_diagonal(good, False)
        if not inner:
            good &= own[:, None] != own[None, :]
        total = good @ size
        a, b = np.nonzero(np.triu(good))
        label = _labels(len(node), a, b)
        far, some = np.flatnonzero(label != np.arange(len(node))), np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[node[far], node[some]]), pa.array([*node[label[far]].tolist(), *[None] * len(some)], pa.int64()),
             pa.array([*[None] * len(far), *total[some].tolist()], pa.int64())], LINKS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for row in zip(*[c.slice(lo, 256).to_pylist() for c in batch.columns], strict=True):
                    if held and held[0][0] != row[0]:
                        yield from links(held)
                        held = []
                    held.append(row)
        if held:
            yield from links(held)

    return shipped.repartition("home").sortWithinPartitions("home").mapInArrow(run, LINKS)


def keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """(key, id, text, rest), stored: rows are known by a key of their own, since ids may be null or repeated. ``rest`` has the other columns."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in (id_col, "text")]
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col("text"), *([F.struct(*rest).alias("rest")] if rest else [])), "jaccard-rows")


def classes(rows: DataFrame, threshold: float, n: int, recall: float, limit: int, depth: int, max_depth: int, block: int) -> DataFrame:
    """(key, id, root, class_id, n_links, class_size) for ``keyed`` rows; ``root`` names the class."""
    bounded_batches(rows.sparkSession)
    marked = cut_lineage(features(rows, n), "jaccard-features")
    named = marked.join(rows.select("key", "id"), "key")
    nodes = cut_lineage(named.groupBy("node").agg(F.min("key").alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("sig").alias("sig")), "jaccard-nodes")
    usable = nodes.where("sig is not null")
    members = all_buckets(usable, recall, threshold, limit, depth, max_depth)
    groups = cut_lineage(components(candidates(members, usable, threshold), "jaccard-candidates"), "jaccard-groups")
    links = cut_lineage(verified(groups, usable, rows, threshold, n, block), "jaccard-links")
    roots = components(links.where("v is not null").select("u", "v"), "jaccard-components")
    counts = links.where("v is null").groupBy("u").agg(F.sum("n").alias("_linked"))
    known = (nodes.drop("sig").join(roots.withColumnRenamed("u", "node"), "node", "left").join(counts.withColumnRenamed("u", "node"), "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    known = cut_lineage(known, "jaccard-known")
    total = cut_lineage(known.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("size").alias("class_size"), F.count(F.lit(1)).alias("_n")), "jaccard-totals")
    table = cut_lineage(join_sized(known, total, "root", "_n").select(
        "node", F.col("size").alias("_size"), "root", "class_id", (F.coalesce("_linked", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), F.col("class_size").cast("long").alias("class_size")),
        "jaccard-classes")
    whole = join_sized(marked.select("key", "node"), table, "node", "_size")
    return whole.join(rows.select("key", "id"), "key").select("key", "id", "root", "class_id", "n_links", "class_size")


def join(docs: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, limit: int = LIMIT,
         depth: int = DEPTH, max_depth: int = MAX_DEPTH, block: int = BLOCK) -> DataFrame:
    """One row per input row: the id, class_id, n_links and class_size.

    n_links counts the other documents with a Jaccard similarity of at least ``threshold`` (equal shingle sets
    included), class_id is the least id of the documents connected by links and class_size their number. Words are
    digits, letters and all above ASCII, A-Z lower-cased. Texts without words are linked to equal texts only; a null text is empty.
    Rows without an id take part like others; a class without any id has a null class_id. Repeated rows link to each other.
    Other columns are not read. Empty in, empty out.
    """
    rows = keyed(docs.select(id_col, "text"), id_col)
    return classes(rows, threshold, n, recall, limit, depth, max_depth, block).select(F.col("id").alias(id_col), "class_id", "n_links", "class_size")


def survivors(docs: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL) -> DataFrame:
    """The row with the least id of every class that ``join`` finds, with all columns of ``docs``.

    A row without an id stays only in a class without any; of several such rows, or rows that share the least id, one stays.
    """
    rows = keyed(docs, id_col)
    found = cut_lineage(classes(rows, threshold, n, recall, LIMIT, DEPTH, MAX_DEPTH, BLOCK).select("key", "id", "root"), "jaccard-survivors")
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    names = {c: f"rest.c{i}" for i, c in enumerate(docs.columns)} | {id_col: "id", "text": "text"}
    return rows.join(stay, "key", "left_semi").select(*[F.col(names[c]).alias(c) for c in docs.columns])
