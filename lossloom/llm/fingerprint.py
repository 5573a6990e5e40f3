"""Document fingerprints from prefix polynomial hashes.

For each text two modular prefix arrays are built in a few numpy passes. They give the hash of any span in constant
time, so span equality is one comparison and the longest common extension of two places is a binary search. The
fingerprint holds the length, the hash of the whole text and, for each of ``SLOTS`` ranges, the smallest mixed hash of
all spans of ``SPAN`` code points (one-permutation sketch); likeness is the share of equal slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lossloom.llm.common import text_of
from lossloom.sources.store import cut_lineage

MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 24
SLOTS = 64
#: Rows of neighbouring ids dealt to one bucket of the succession.
ROWS_PER_BUCKET = 2000
MOST = 1024

_TABLES: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, mod: int, n: int) -> np.ndarray:
    p = _TABLES.get((base, mod))
    if p is None or len(p) < n:
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), mod)) % np.uint64(mod)])
        _TABLES[base, mod] = p
    return p[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class PrefixHash:
    """Prefix arrays of a code point sequence under both moduli."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        c = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base, mod in zip(BASES, MODULI, strict=True):
            s = np.zeros(self.n + 1, np.uint64)
            # Terms stay below 2**31, so the running sum is exact for texts of up to 2**33 code points.
            np.cumsum(c * _powers(base, mod, self.n) % np.uint64(mod), out=s[1:])
            self.sums.append(s)

    def span(self, start, length, k: int = 0):
        """Hash of ``length`` code points from ``start`` under modulus ``k``, the same wherever the span stands. Vectorised."""
        mod = np.uint64(MODULI[k])
        start = np.asarray(start, np.int64)
        top = (self.sums[k][start + length] - self.sums[k][start]) % mod
        inverse = _powers(pow(BASES[k], -1, MODULI[k]), MODULI[k], max(self.n, 1))
        return top * inverse[np.minimum(start, max(self.n - 1, 0))] % mod

    def same(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether two spans are equal (up to a collision under both moduli)."""
        return all(int(self.span(i, length, k)) == int(other.span(j, length, k)) for k in (0, 1))

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Longest common extension: how many code points agree from place ``i`` here and ``j`` there, by binary search."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.same(i, other, j, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def sketch(self) -> np.ndarray:
        """Smallest mixed span hash per slot; a slot without spans takes over from the next filled one."""
        starts = np.arange(max(1, self.n - SPAN + 1))
        h = self.span(starts, min(SPAN, self.n))
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        slot = (h * np.uint64(SLOTS)) >> np.uint64(32)
        low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
        if len(h) > 4 * SLOTS:
            h = np.sort(h)
            slot = (h * np.uint64(SLOTS)) >> np.uint64(32)
            first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            low[slot[first].astype(np.int64)] = h[first]
        else:
            np.minimum.at(low, slot.astype(np.int64), h)
        filled = np.flatnonzero(low != np.iinfo(np.uint64).max)
        take = filled[np.searchsorted(filled, np.arange(SLOTS)) % len(filled)]
        return low[take] & np.uint64(0xFFFF)

    def fingerprint(self) -> str:
        """Hex: length (12 digits), both hashes of the whole text (16), the slots (4 each)."""
        whole = "".join(f"{int(self.span(0, self.n, k)):08x}" for k in (0, 1))
        return f"{self.n:012x}{whole}" + self.sketch().astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal slots of two fingerprints; 1 when length and hashes of the whole texts agree; 0 when one text is empty."""
    if a[:28] == b[:28]:
        return 1.0
    if not int(a[:12], 16) or not int(b[:12], 16):
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s[28:]), ">u2") for s in (a, b))
    return float(np.count_nonzero(x == y)) / SLOTS


def succession(docs: DataFrame, id_col: str = "doc_id", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows (id, text, _bucket, _last) such that each bucket, ordered by _last, id descending, text, lists rows in global order.

    The order is by id descending, nulls last, then by text. Buckets are ranges of (numeric) ids with about
    ``rows_per_bucket`` rows, at most four to a shuffle partition and MOST in all; rows stream through, so a large bucket costs no memory. The first row of each bucket is
    also sent to the bucket before it as its last row, the very first one to the last bucket.
    """
    ids = docs.select(id_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(1, min(ids.count() // rows_per_bucket, 4 * parts, MOST))
    cuts = ids.agg(F.percentile_approx(id_col, [i / wanted for i in range(1, wanted)], 10 * wanted)).first()[0] if wanted > 1 else None
    above = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    key = F.coalesce(F.aggregate(above, F.lit(0), lambda acc, x: acc + (F.col(id_col) < x).cast("int")), F.size(above) + 1)
    rows = docs.select(F.col(id_col), text_of().alias("text")).withColumn("_bucket", key)
    heads = cut_lineage(rows.groupBy("_bucket").agg(F.max(id_col).alias("_head_id")), "fingerprint-heads")
    # One row per bucket: both windows are over that bounded table.
    before = F.coalesce(F.lag("_bucket").over(Window.orderBy("_bucket")), F.max("_bucket").over(Window.partitionBy()))
    marked = rows.join(F.broadcast(heads.withColumn("_sent", before)), "_bucket")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("last"))
    sent = F.struct(F.col("_sent").alias("b"), F.lit(True).alias("last"))
    both = F.when(F.col(id_col).eqNullSafe(F.col("_head_id")), F.array(own, sent)).otherwise(F.array(own))
    return marked.withColumn("_to", F.explode(both)).select(id_col, "text", F.col("_to.b").alias("_bucket"), F.col("_to.last").alias("_last"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
    """(id, text, next text) along the ordered rows; one row is held at a time."""
    bucket = held = None
    for batch in batches:
        for key, text, b, last in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if held is not None and b == bucket:
                yield held[0], held[1], text
            # After the first row sent on, further ones with the same id only repeat the border.
            held = None if last else (key, text)
            bucket = b


def fingerprints(docs: DataFrame, id_col: str = "doc_id", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, shared_prefix.

    The edited text keeps the first half (rounded up) and ends in as many code points from the front of the next
    document as were cut off, or all of it. shared_prefix is the longest common extension of text and next text from their starts.
    Null texts are empty; empty texts have likeness 1 to each other and 0 to others; a lone document is its own next.
    Rows that share an id are ordered by text; equal rows follow one another. Empty in, empty out.
    """
    schema = T.StructType([
        docs.schema[id_col], T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("shared_prefix", T.LongType())])

    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str, PrefixHash, str] | None = None
        out = []
        for key, text, after in _pairs(batches):
            if known is None or known[0] != text:
                ph = PrefixHash(code_points(text))
                known = (text, ph, ph.fingerprint())
            _, own, own_print = known
            half = len(text) // 2
            edited = text[:len(text) - half] + after[:half]
            edited_print = PrefixHash(code_points(edited)).fingerprint()
            ph = PrefixHash(code_points(after))
            known = (after, ph, ph.fingerprint())
            out.append((key, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), own_print, edited_print,
                        likeness(own_print, edited_print), likeness(own_print, known[2]), own.extension(0, ph, 0)))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema.names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema.names)

    rows = succession(docs, id_col, rows_per_bucket).repartition("_bucket")
    return rows.sortWithinPartitions("_bucket", "_last", F.col(id_col).desc_nulls_last(), "text").mapInArrow(run, schema)
