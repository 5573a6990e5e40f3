"""Approximate nearest neighbours by inner product: a neighbour graph from NN-descent, searched greedily.

Equal vectors are one node. Vectors travel as directions with one byte per component and a scale; exact scores come from the
original vectors at the end. The graph starts from blocks of vectors that fall on the same sides of a few random hyperplanes. Then, round by
round, neighbours of neighbours are introduced to each other: every node names itself to a sample of its own neighbours and of the nodes that
list it, nodes named to the same place are compared there (new ones with all, old ones with new ones), and each keeps the nearest it
has met. Rounds end when few lists still change.

Queries keep a beam of the best nodes met so far. A step expands the best beam nodes that were not expanded yet by one join with the
graph, scores the new nodes by inner product and keeps the best. A query starts from the neighbours of its own place in the graph and from
the longest vectors, which can be near to all queries by inner product though not by direction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossloom.llm.common import join_sized
from lossloom.sources.store import cut_lineage

TOP, QUERY_STEP = 20, 20
#: Neighbours per node, those that take part in a round per kind, rounds at most, share of changed entries that ends them.
NEIGHBOURS, SAMPLE, ROUNDS, SETTLED = 48, 20, 8, 0.05
#: Start: random splits, and rows of a block.
SPLITS, BLOCK = 4, 128
#: Search: nodes kept per query, nodes of them that one step expands, steps at most, longest vectors that every query meets.
BEAM, EXPAND, STEPS, LONGEST = 96, 32, 4, 64
SEED = 71

PAIRS = "u bigint, v bigint, sim float"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: v a non-zero vector of finite numbers, of the length that most rows have."""
    x = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where(~bad & F.exists("v", lambda c: c != 0))
    widths = x.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    common = widths.orderBy(F.desc("n"), F.desc("w")).limit(1).select("w")
    return x.join(F.broadcast(common), F.size("v") == F.col("w"), "left_semi")  # one row


def node_table(rows: DataFrame) -> DataFrame:
    """(node, ids, v, code, scale, norm): one row per distinct vector v; ``ids`` are its TOP + 1 least ids, all that an answer can name.

    ``code`` is the direction, one signed byte per component with the largest at 127, and ``scale`` makes code * scale nearly v.
    """
    key = F.xxhash64("v")  # spreads equal vectors' ids before they are counted; equality is that of the vectors
    least = F.row_number().over(Window.partitionBy("k", "v").orderBy("vec_id"))
    named = rows.distinct().withColumn("k", key).withColumn("_r", least).where(F.col("_r") <= TOP + 1)
    grouped = named.groupBy("k", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                most = np.abs(v).max(1, keepdims=True)
                code = np.rint(v / most * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(most[:, 0] / 127),
                                                  pa.array(most[:, 0] * np.linalg.norm(v / most, axis=1))], ["ids", "v", "code", "scale", "norm"])

    coded = grouped.mapInArrow(run, "ids array<bigint>, v array<double>, code binary, scale double, norm double")
    return cut_lineage(coded.withColumn("node", F.monotonically_increasing_id()), "neighbours-nodes")


def unit_rows(code: pa.Array) -> np.ndarray:
    """Directions of coded vectors, of length one."""
    if not len(code):
        return np.zeros((0, 1), np.float32)
    x = np.frombuffer(b"".join(code.to_pylist()), np.int8).reshape(len(code), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grouped_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups (rows with one value in the first column, which come together), about ``most`` rows each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            held.append(batch.slice(lo, most))
            size += held[-1].num_rows
            if size >= most:
                whole = pa.Table.from_batches(held).combine_chunks()
                g = whole.column(0).to_numpy()
                cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0  # the last group may go on
                if cut:
                    yield whole.slice(0, cut).combine_chunks()
                held, size = whole.slice(cut).to_batches(), len(g) - cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def compared(group: np.ndarray, node: np.ndarray, x: np.ndarray, new: np.ndarray, bar: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, sim) of the pairs inside groups with a new member that raise u's list, at most the best ``keep`` of v per group and u."""
    us, vs, ss = [], [], []
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, len(group)])
    for width in np.unique(-(-sizes // 8) * 8).tolist():  # groups of about one size together
        of = np.flatnonzero((-(-sizes // 8) * 8) == width)
        step = max(1, (1 << 22) // (width * max(width, x.shape[1])))
        for lo in range(0, len(of), step):
            g = of[lo:lo + step]
            at = first[g][:, None] + np.arange(width)[None, :]
            live = np.arange(width)[None, :] < sizes[g][:, None]
            at = np.where(live, at, 0)
            m = x[at]
            sim = m @ m.transpose(0, 2, 1)
            fresh = new[at] & live
            good = (sim > bar[at][:, :, None]) & (fresh[:, :, None] | fresh[:, None, :]) & live[:, :, None] & live[:, None, :]
            good &= node[at][:, :, None] != node[at][:, None, :]
            if width > keep:
                masked = np.where(good, sim, -np.inf)
                good &= sim >= np.partition(masked, -keep, axis=2)[:, :, [-keep]]
            a, i, j = np.nonzero(good)
            us.append(node[at[a, i]])
            vs.append(node[at[a, j]])
            ss.append(sim[a, i, j])
    return np.concatenate(us), np.concatenate(vs), np.concatenate(ss)


def met(rows: DataFrame, keep: int) -> DataFrame:
    """PAIRS from (place, node, code, new, bar) rows: all rows of a place are compared with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped_runs(batches, 16_384):
            c = [t.column(i).chunk(0) for i in range(5)]
            u, v, s = compared(c[0].to_numpy(), c[1].to_numpy(), unit_rows(c[2]), c[3].to_numpy(zero_copy_only=False), c[4].to_numpy(), keep)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s.astype(np.float32))], ["u", "v", "sim"])

    return rows.select("place", "node", "code", "new", "bar").repartition("place").sortWithinPartitions("place").mapInArrow(run, PAIRS)


def hyperplanes(nodes: DataFrame, n: int, bits: int) -> np.ndarray:
    """Differences of ``n * bits`` pairs of directions, from the 2 * n * bits nodes with the least hash: a bounded sample."""
    rows = nodes.select("code", F.xxhash64("v", F.lit(SEED)).alias("h")).orderBy("h").limit(2 * n * bits).toArrow()
    x = unit_rows(pa.array(rows.column("code").to_pylist(), pa.binary()))
    x = np.resize(x, (2 * n * bits, x.shape[1]))
    return x[: n * bits] - x[n * bits:]


def first_lists(nodes: DataFrame, total: int, k: int, splits: int, block: int) -> DataFrame:
    """PAIRS for a start: in each split, nodes on the same sides of all hyperplanes are dealt into blocks and compared there.

    One more split deals all nodes by chance, so that a node that is alone on its sides has neighbours too.
    """
    bits = max(1, int(math.log2(max(total / block, 2))))
    shared = nodes.sparkSession.sparkContext.broadcast(hyperplanes(nodes, splits, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                above = unit_rows(batch.column(1)) @ shared.value.T > 0
                for s in range(splits + 1):
                    side = (above[:, s * bits:(s + 1) * bits] * power).sum(1) * (splits + 1) + s if s < splits else np.full(batch.num_rows, s)
                    yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int64)), *batch.columns], ["side", "node", "code"])

    placed = cut_lineage(nodes.select("node", "code").mapInArrow(run, "side bigint, node bigint, code binary"), "neighbours-sides")
    sizes = cut_lineage(placed.groupBy("side").agg(F.count(F.lit(1)).alias("_n")), "neighbours-sizes")
    part = F.pmod(F.xxhash64("node", "side"), F.ceil(F.col("_n") / block))  # a full side is dealt into blocks by hash
    rows = join_sized(placed, sizes, "side", "_n")
    return met(rows.select(F.xxhash64("side", part).alias("place"), "node", "code", F.lit(True).alias("new"), F.lit(-2.0).cast("float").alias("bar")), k)


LISTS = "u bigint, near array<struct<sim: float, v: bigint, new: boolean>>"


def best(pairs: DataFrame, k: int) -> DataFrame:
    """LISTS with the ``k`` nearest per node, the nearest first, from (u, v, sim, new); a pair that is known already stays known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped_runs(batches, 65_536):
            u, v, sim, new = (t.column(i).chunk(0).to_numpy(zero_copy_only=False) for i in range(4))
            order = np.lexsort((new, v, u))
            order = order[np.r_[True, (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)]]
            order = order[np.lexsort((v[order], -sim[order], u[order]))]
            first = np.searchsorted(u[order], u[order])
            order = order[np.arange(len(order)) - first < k]
            name, at = np.unique(u[order], return_index=True)
            edges = pa.StructArray.from_arrays([pa.array(sim[order]), pa.array(v[order]), pa.array(new[order])], ["sim", "v", "new"])
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.ListArray.from_arrays(pa.array(np.r_[at, len(order)].astype(np.int32)), edges)], ["u", "near"])

    return pairs.select("u", "v", "sim", "new").repartition("u").sortWithinPartitions("u").mapInArrow(run, LISTS)


def sampled(new: bool, n: int, seed: int):
    """At most ``n`` neighbours of one kind in ``near``, those with the least hash."""
    some = F.transform(F.filter("near", lambda e: e["new"] == F.lit(new)), lambda e: F.struct(F.xxhash64("u", e["v"], F.lit(seed)).alias("h"), e["v"].alias("v")))
    return F.transform(F.slice(F.sort_array(some), 1, n), lambda e: e["v"])


def few(edges: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` edges per v and kind, those with the least hash; tasks keep only that many before they are sent."""
    order = Window.partitionBy("v", "new").orderBy(F.xxhash64("u", "v", F.lit(seed)))
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def graph(nodes: DataFrame, k: int = NEIGHBOURS, sample: int = SAMPLE, rounds: int = ROUNDS, splits: int = SPLITS, block: int = BLOCK) -> DataFrame:
    """LISTS: for every node that has met another, its nearest by direction as NN-descent finds them."""
    lists = cut_lineage(best(first_lists(nodes, nodes.count(), k, splits, block).withColumn("new", F.lit(True)), k), "neighbours-graph")
    for turn in range(rounds):
        fresh, size = lists.agg(F.sum(F.size(F.filter("near", lambda e: e["new"]))), F.sum(F.size("near"))).first()
        if not fresh or (turn and fresh < SETTLED * size):
            break
        # Of every list some new and some old neighbours take part. New ones that do are old from now on.
        drawn = lists.select("u", "near", sampled(True, sample, turn).alias("fresh"), sampled(False, sample, turn).alias("known"))
        picked = cut_lineage(drawn.select("u", F.explode("fresh").alias("v"), F.lit(True).alias("new")).unionByName(
            drawn.select("u", F.explode("known").alias("v"), F.lit(False).alias("new"))), "neighbours-picked")
        old = drawn.select("u", "fresh", F.explode("near").alias("e")).select("u", "e.v", "e.sim", (F.col("e.new") & ~F.array_contains("fresh", F.col("e.v"))).alias("new"))
        # v is compared at u's place, and u at v's.
        named = picked.select(F.col("u").alias("place"), F.col("v").alias("node"), "new").unionByName(
            few(picked, sample, turn).select(F.col("v").alias("place"), F.col("u").alias("node"), "new"))
        named = named.groupBy("place", "node").agg(F.max("new").alias("new"))
        full = F.size("near") >= k
        bars = lists.select(F.col("u").alias("node"), F.when(full, F.element_at("near", -1)["sim"]).otherwise(F.lit(-2.0).cast("float")).alias("bar"))
        rows = named.join(nodes.select("node", "code").join(bars, "node"), "node")
        lists = cut_lineage(best(old.unionByName(met(rows, sample).withColumn("new", F.lit(True))), k), "neighbours-graph")
    return lists


def adjacency(lists: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(u, next): both ways; of the nodes that list a node, the ``k`` nearest are kept."""
    edges = lists.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.sim")
    order = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    back = edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select(F.col("v").alias("u"), F.col("u").alias("v"))
    return cut_lineage(edges.select("u", "v").unionByName(back).groupBy("u").agg(F.collect_set("v").alias("next")), "neighbours-adjacency")


def nearness(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, node, score) for (q, node) rows: inner products of the coded vectors, in units of q's scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                b = batch.slice(lo, 8192)
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.int8).reshape(b.num_rows, -1).astype(np.float32) for i in (2, 3))
                score = np.einsum("ij,ij->i", x, y).astype(np.float64) * b.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["q", "node", "score"])

    there = wanted.join(nodes.select("node", F.col("code").alias("there"), "scale"), "node")
    both = there.join(nodes.select(F.col("node").alias("q"), "code"), "q")
    return both.select("q", "node", "code", "there", "scale").mapInArrow(run, "q bigint, node bigint, score double")


def first_of(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` best nodes per query."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    return scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def search(queries: DataFrame, nodes: DataFrame, links: DataFrame, beam: int = BEAM, expand: int = EXPAND, steps: int = STEPS, longest: int = LONGEST) -> DataFrame:
    """(q, node): for each query node (q) the best nodes that greedy search over the graph meets, and q itself."""
    far = [r["node"] for r in nodes.orderBy(F.desc("norm"), "node").limit(longest).select("node").collect()]
    if not far:
        return queries.select("q", F.col("q").alias("node"))
    own = queries.join(links.withColumnRenamed("u", "q"), "q").select("q", F.explode("next").alias("node"))
    start = own.unionByName(queries.select("q", F.explode(F.array(*[F.lit(n) for n in far])).alias("node"))).where("node <> q").distinct()
    scored = cut_lineage(nearness(start, nodes), "neighbours-scored")
    seen = scored.select("q", "node")
    held = cut_lineage(first_of(scored, beam).withColumn("done", F.lit(False)), "neighbours-beam")
    for _ in range(steps):
        todo = first_of(held.where("not done"), expand).select("q", F.col("node").alias("u"))
        if held.where("not done").isEmpty():
            break
        fresh = todo.join(links, "u").select("q", F.explode("next").alias("node")).where("node <> q").distinct().join(seen, ["q", "node"], "left_anti")
        scored = cut_lineage(nearness(fresh, nodes), "neighbours-scored")
        seen = seen.unionByName(scored.select("q", "node"))
        told = todo.select("q", F.col("u").alias("node"), F.lit(True).alias("_t"))
        old = held.join(told, ["q", "node"], "left").select("q", "node", "score", (F.col("done") | F.col("_t").isNotNull()).alias("done"))
        held = cut_lineage(first_of(old.unionByName(scored.withColumn("done", F.lit(False))), beam), "neighbours-beam")
    return held.select("q", "node").unionByName(queries.select("q", F.col("q").alias("node")))


def nearest(vectors: DataFrame, top: int = TOP, query_step: int = QUERY_STEP) -> DataFrame:
    """For every row whose vec_id divides by ``query_step`` the ``top`` rows found with the largest inner products: (query_id, rank, vec_id, score).

    Rows with a null id, or with a vector that is null, zero or holds a null or non-finite component take no part, nor do vectors
    of another length than most (of two lengths held equally often the larger takes part). Scores are double-precision inner products
    of the original vectors; ties go to the smaller id. Equal rows count once; rows of one id with different vectors are one candidate
    with its best score, and never answer a query of that id. Other columns are not read. Empty in, empty out.
    """
    rows = usable(vectors.select("vec_id", "embedding"))
    nodes = node_table(rows)
    links = adjacency(graph(nodes))
    asked = rows.where(F.col("vec_id") % query_step == 0).distinct().join(nodes.select("v", F.col("node").alias("q")), "v")
    asked = cut_lineage(asked.select(F.col("vec_id").alias("query_id"), "q"), "neighbours-queries")
    found = cut_lineage(search(asked.select("q").distinct(), nodes, links), "neighbours-found")
    v = nodes.select("node", "v")
    pairs = found.join(nodes.select("node", "v", "ids"), "node").join(v.select(F.col("node").alias("q"), F.col("v").alias("w")), "q")
    product = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    exact = cut_lineage(pairs.select("q", F.explode("ids").alias("vec_id"), product.alias("score")), "neighbours-exact")
    answers = asked.join(exact, "q").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
