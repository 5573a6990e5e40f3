"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key held by more than 1/HOT of all rows is joined through a broadcast table, which therefore has fewer than HOT rows.
HOT = 4096


def importable(spark: SparkSession) -> None:
    """Let local Python workers import this package when it is run from a checkout; on a cluster it is installed or shipped."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


#: Bytes at which an Arrow batch between Spark and its Python workers is closed.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches unless someone has; whoever maps whole texts calls it before planning.

    Spark bounds rows alone: 10,000 texts and what is made of them are held outside the heap by every task and again by its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, k: int) -> Column:
    """crc32 of the value as text, mod k; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % k, F.lit(-1))


def hash_of(column: str, salt: str) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(column).cast("string"), F.lit("null"))).cast("binary"))


def smallest_hashes(df: DataFrame, column: str, salt: str, n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``column``: a repeatable sample.

    A threshold on the hash that lets about 4 n rows pass comes first, so that the rows that meet in one task to be
    ordered do not grow with the number of partitions.
    """
    least = min(1.0, (4 * n + 100) / max(df.count(), 1)) * (1 << 32)
    h = hash_of(column, salt)
    return df.where(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < F.lit(int(least))).orderBy(h, *ties).limit(n)


def join_sized(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (one row per key with its row count in ``size``) that no hot key can skew.

    Keys with more than 1/HOT of all rows number fewer than HOT and are broadcast; every other key is small enough for a
    shuffle join. Both inputs are read twice, so pass stored tables.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT > total)
    cold = groups.where(F.col(size) * HOT <= total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text: (first row, end row, bytes, n+1 byte offsets).

    A null text is empty. One longer text is a run of its own, so memory follows the longest text and not the batch.
    """
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    data, n = texts.buffers()[2], len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        raw = bytes(data[int(offs[lo]):int(offs[hi])]) if data is not None and offs[hi] > offs[lo] else b""
        yield lo, hi, raw, offs[lo:hi + 1] - offs[lo]
        lo = hi
