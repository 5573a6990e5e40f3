"""Hard negatives for anchors, with score bounds along a spanning tree of the anchors.

Vectors become integers and a score is an integer inner product. Anchors are dealt into blocks of similar ones and every block gets
the minimum spanning tree of its anchors. Candidates are read where they lie, a batch at a time. The root of a tree is scored
against the whole batch; for a child a of p the score of a candidate c lies within |a - p| * |c| of the score of p, whether that is
known or itself only bounded. Going down the tree, only candidates whose bounds overlap what an anchor still looks for are scored:
first scores above its fifth best positive so far, then, with the positives known, scores in a positive's window that are above the
fifth best negative found there. Each task keeps the first few per anchor, which are then merged.

Anchors pass over the candidates in groups of a bounded number of bytes, so a broadcast never grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossloom.sources.store import cut_lineage

SCALE, TOP = 256, 5
ANCHOR_STEP, NOISE_STEP, LABELS = 100, 7, 10
#: A negative scores at least 80/100 of the positive p: as a whole number, p - floor(p / 5), which stays within 64 bits.
FIFTH = 5
#: Anchors of a tree, candidates of a batch, and bytes of anchors that one pass over the candidates broadcasts.
BLOCK, BATCH, PASS_BYTES = 512, 4096, 32 << 20
#: Share of a batch to score from which an anchor's product with the whole batch is cheaper.
DENSE = 0.25
_EXACT = 2.0**53
_LONG = 2**63

POSITIVES = "place bigint, vec_id bigint, score bigint"
NEGATIVES = "place bigint, slot int, vec_id bigint, score bigint"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, labels with their planted noise."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    label = F.col("label").cast("long")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % NOISE_STEP == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
                       F.col("embedding").cast("array<double>").alias("v"))


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of floor(SCALE * x); vectors shorter than the longest one are filled up with zeros, which no product sees."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    width = int(at.max()) if len(at) else 0
    out = np.zeros((len(at), width))
    out[np.arange(width)[None, :] < at[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * out))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a with the rows of b, held within the 64-bit range."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    with np.errstate(over="ignore"):
        most = np.sqrt((a * a).sum(1).max(initial=0)) * np.sqrt((b * b).sum(1).max(initial=0))
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[min(max(sum(x * y for x, y in zip(r, s, strict=True)), -_LONG), _LONG - 1) for s in whole[1]] for r in whole[0]], np.int64).reshape(len(a), len(b))


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Prim's tree of the rows: the parent of each (-1 at the root), the length of the edge to it, and the rows level by level."""
    n = len(v)
    parent, length, near = np.full(n, -1), np.zeros(n), np.full(n, np.inf)
    level, left, at = np.zeros(n, int), np.ones(n, bool), 0
    for _ in range(n - 1):
        left[at] = False
        with np.errstate(over="ignore"):
            d = np.sqrt(((v - v[at]) ** 2).sum(1))
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], at
        if not np.isfinite(near[left]).any():  # too far apart for floating point: a child without a bound
            near[left] = np.finfo(float).max
            parent[left] = at
        at = int(np.flatnonzero(left)[np.argmin(near[left])])
        length[at], level[at] = near[at], level[parent[at]] + 1
    return parent, length, [np.flatnonzero(level == k) for k in range(int(level.max(initial=0)) + 1)] if n else []


class Block:
    """Anchors of one tree."""

    def __init__(self, place: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.place, self.ids, self.labels, self.v = place, ids, labels, v
        self.parent, self.length, self.levels = spanning_tree(v)


class Kept:
    """The first ``TOP`` (score, id) of each slot so far: higher scores first, ties by smaller id; equal pairs count once."""

    def __init__(self, slots: int):
        self.score, self.id = np.zeros((slots, TOP), np.int64), np.zeros((slots, TOP), np.int64)
        self.n = np.zeros(slots, int)

    def bar(self) -> np.ndarray:
        """The score that a new entry must reach, minus infinity while there is room."""
        return np.where(self.n == TOP, np.nextafter(self.score[:, -1].astype(float), -np.inf), -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        old = np.repeat(touched, self.n[touched])
        take = np.arange(TOP)[None, :] < self.n[touched][:, None]
        slot, score, ids = np.r_[old, slot], np.r_[self.score[touched][take], score], np.r_[self.id[touched][take], ids]
        order = np.lexsort((ids, ~score, slot))  # ~x falls as x rises and never overflows
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.r_[True, (np.diff(slot) != 0) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])]
        slot, score, ids = slot[new], score[new], ids[new]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < TOP
        self.score[slot[keep], rank[keep]], self.id[slot[keep], rank[keep]] = score[keep], ids[keep]
        self.n[touched] = np.minimum(TOP, np.bincount(np.searchsorted(touched, slot), minlength=len(touched)))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, rank = np.nonzero(np.arange(TOP)[None, :] < self.n[:, None])
        return slot, self.id[slot, rank], self.score[slot, rank]


def first_of(score: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the wanted cells that can be among a row's first ``TOP``; ties with the last of them stay in."""
    if score.shape[1] > 4 * TOP:
        masked = np.where(wanted, score, np.iinfo(np.int64).min)
        wanted = wanted & (score >= np.partition(masked, -TOP, axis=1)[:, [-TOP]])
    return np.nonzero(wanted)


class Scorer:
    """Scores batches of candidates against one block of anchors, level by level of its tree."""

    def __init__(self, block: Block, positives: list[np.ndarray] | None):
        """``positives``: per anchor the scores of its positives, for the second stage."""
        self.block, self.stage = block, 1 if positives is None else 2
        self.kept = Kept(len(block.place) * (1 if positives is None else TOP))
        self.scored = self.seen = 0
        if positives is not None:
            self.high = np.full((len(block.place), TOP), -np.inf)
            self.exact = np.zeros((len(block.place), TOP), np.int64)
            for i, p in enumerate(positives):
                self.high[i, :len(p)], self.exact[i, :len(p)] = p, p
            self.least = self.exact - self.exact // FIFTH
            self.low = np.where(np.isfinite(self.high), np.nextafter(self.least.astype(float), -np.inf), np.inf)

    def _wanted(self, at: np.ndarray, same: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if self.stage == 1:
            return same & (hi >= self.kept.bar()[at][:, None])
        bar = self.kept.bar().reshape(-1, TOP)
        out = np.zeros(lo.shape, bool)
        for j in range(TOP):
            floor, top = np.maximum(self.low[at, j], bar[at, j]), self.high[at, j]
            out |= (hi >= floor[:, None]) & (lo <= top[:, None])
        return out & ~same

    def add(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        b, width = self.block, max(v.shape[1], self.block.v.shape[1])
        v = np.pad(v, ((0, 0), (0, width - v.shape[1])))
        anchors = np.pad(b.v, ((0, 0), (0, width - b.v.shape[1])))
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((v * v).sum(1))
            # Bounds are widened by what rounding can cost; a norm beyond floating point bounds nothing.
            loose = np.sqrt((anchors * anchors).sum(1)).max(initial=0) * norm * 1e-9 + 1e-6
        lo, hi = np.full((len(b.place), len(ids)), -np.inf), np.full((len(b.place), len(ids)), np.inf)
        for at in b.levels:
            same = (b.labels[at][:, None] == labels[None, :])
            other = b.ids[at][:, None] != ids[None, :]
            if b.parent[at[0]] >= 0:
                with np.errstate(over="ignore", invalid="ignore"):
                    far = b.length[at][:, None] * norm[None, :] + loose[None, :]
                    lo[at] = np.nan_to_num(lo[b.parent[at]] - far, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    hi[at] = np.nan_to_num(hi[b.parent[at]] + far, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                wanted = self._wanted(at, same, lo[at], hi[at]) & other
            else:
                wanted = np.ones(same.shape, bool)  # the root is scored against all
            self.seen += wanted.size
            if not wanted.any():
                continue
            share = wanted.mean(1)
            exact, full = np.zeros(wanted.shape, np.int64), np.flatnonzero(share >= DENSE)
            if len(full):
                exact[full] = product(anchors[at[full]], v)
                lo[at[full]] = hi[at[full]] = exact[full]
                self.scored += len(full) * len(ids)
            for i in np.flatnonzero((share > 0) & (share < DENSE)):
                c = np.flatnonzero(wanted[i])
                exact[i, c] = product(anchors[at[i]][None, :], v[c])[0]
                lo[at[i], c] = hi[at[i], c] = exact[i, c]
                self.scored += len(c)
            wanted &= other
            if self.stage == 1:
                good = wanted & same & (exact >= self.kept.bar()[at][:, None])
                i, c = first_of(exact, good)
                self.kept.add(at[i], exact[i, c], ids[c])
                continue
            bar = self.kept.bar().reshape(-1, TOP)
            for j in range(TOP):
                good = wanted & ~same & np.isfinite(self.high[at, j])[:, None] & (exact >= bar[at, j][:, None])
                good &= (exact <= self.exact[at, j][:, None]) & (exact >= self.least[at, j][:, None])
                i, c = first_of(exact, good)
                self.kept.add(at[i] * TOP + j, exact[i, c], ids[c])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            part = batch.slice(lo, BATCH)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2))


def anchor_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(place, vec_id, label, v, tree): distinct anchors, numbered; similar ones (by label and leading components) share a tree."""
    anchors = cut_lineage(rows.where(F.col("vec_id") % ANCHOR_STEP == 0).distinct(), "negatives-anchors")
    parts = max(1, -(-anchors.count() // block))
    dealt = anchors.repartitionByRange(parts, "label", "v", "vec_id").sortWithinPartitions("label", "v", "vec_id")
    numbered = dealt.withColumn("place", F.monotonically_increasing_id())
    tree = F.concat_ws("-", F.spark_partition_id(), F.floor(F.col("place") % (1 << 33) / block))
    return cut_lineage(numbered.withColumn("tree", tree), "negatives-blocks")


def passes(anchors: DataFrame, pass_bytes: int) -> list[list[str]]:
    """Trees by pass, from their sizes: one row per tree reaches the driver, no vector does. A tree larger than a pass has its own."""
    out, size = [[]], 0
    for row in anchors.groupBy("tree").agg(F.sum(F.size("v") * 8 + 32).alias("b")).orderBy("tree").toLocalIterator():
        if out[-1] and size + row["b"] > pass_bytes:
            out.append([])
            size = 0
        out[-1].append(row["tree"])
        size += row["b"]
    return [p for p in out if p]


def blocks_of(anchors: DataFrame, trees: list[str]) -> list[Block]:
    """The trees of one pass; at most ``PASS_BYTES`` of vectors are collected."""
    got = anchors.where(F.col("tree").isin(trees)).orderBy("tree", "place").toArrow().combine_chunks()
    if not got.num_rows:
        return []
    name = np.array(got.column("tree").to_pylist())
    cut = np.r_[0, np.flatnonzero(name[1:] != name[:-1]) + 1, len(name)]
    place, ids, labels = (got.column(c).to_numpy() for c in ("place", "vec_id", "label"))
    vectors = got.column("v").combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    v = matrix(vectors)
    return [Block(place[i:j], ids[i:j], labels[i:j], v[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _first(found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The first ``TOP`` distinct (score, vec_id) per key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return cut_lineage(found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP), name)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mine(vectors: DataFrame, block: int = BLOCK, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null id, label or vector, or with a null or non-finite component take no part. Anchors are the rows whose vec_id
    divides by ``ANCHOR_STEP``; labels of rows whose vec_id divides by ``NOISE_STEP`` are moved by one first. Components become
    floor(256 x). Positives are the first five rows of the anchor's label, negatives the first five rows of other labels in a
    positive's window; higher scores first, ties by smaller id. A row with the anchor's id is neither. Rows of one id that have one
    score count once, so repeated rows are one. An id that stands with several vectors or labels gives an anchor, or a candidate, for
    each. A vector shorter than another is read as if filled with zeros. Scores are exact; beyond 64 bits they stay at the
    end of the range. Columns other than vec_id, label and embedding are not read. Empty in, empty out.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select("vec_id", "label", "embedding"))
    anchors = anchor_blocks(rows, block)
    plan = passes(anchors, pass_bytes)

    def scan(first: DataFrame | None, name: str) -> DataFrame:
        found = []
        for trees in plan:
            blocks = blocks_of(anchors, trees)
            given = None
            if first is not None:  # at most TOP scores per anchor of the pass
                got = first.join(F.broadcast(anchors.where(F.col("tree").isin(trees)).select("place")), "place").select("place", "rank", "score").toArrow()
                given = {}
                for p, r, s in zip(*(got.column(c).to_pylist() for c in ("place", "rank", "score")), strict=True):
                    given.setdefault(p, {})[r] = s
            shared = spark.sparkContext.broadcast((blocks, given))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                blocks, given = shared.value
                scorers = [Scorer(b, None if given is None else [np.array([s for _, s in sorted(given.get(p, {}).items())], np.int64) for p in b.place.tolist()]) for b in blocks]
                for ids, labels, v in _candidates(batches):
                    for s in scorers:
                        s.add(ids, labels, v)
                for s in scorers:
                    slot, ids, score = s.kept.rows()
                    if given is None:
                        yield pa.RecordBatch.from_arrays([pa.array(s.block.place[slot]), pa.array(ids), pa.array(score)], ["place", "vec_id", "score"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(s.block.place[slot // TOP]), pa.array((slot % TOP).astype(np.int32)), pa.array(ids), pa.array(score)],
                                                         ["place", "slot", "vec_id", "score"])

            found.append(cut_lineage(rows.mapInArrow(run, POSITIVES if first is None else NEGATIVES), name))
            shared.unpersist()
        return _union(found) if found else spark.createDataFrame([], POSITIVES if first is None else NEGATIVES)

    positives = _first(scan(None, "negatives-first"), ["place"], "negatives-positives")
    negatives = _first(scan(positives, "negatives-second"), ["place", "slot"], "negatives-found")
    pairs = positives.select("place", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("place", F.col("vec_id").alias("anchor_id"))
    return (negatives.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(pairs, ["place", "slot"]).join(named, "place")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
