"""Exact deduplication of texts with DataFrame functions alone.

Texts are equal when they are identical after no change; a null text counts as empty. Each task first reduces its own
rows to one per text (the partial aggregate). The digest groups are then merged per salt, and the winners of the salts
are merged into one row per text. Every stage groups by the digest *and* the full text, so two texts that share a
digest never merge. A text copied into a third of all rows reaches the reducers as one row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossloom.llm.common import join_sized, text_of
from lossloom.sources.store import cut_lineage

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _merge(docs: DataFrame, winner: Column, salts: int, digest: Digest, id_col: str) -> DataFrame:
    """One row per text: _digest, _text, _win (the largest ``winner``) and group_size."""
    rows = docs.select(winner.alias("_win"), text_of().alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text"))).withColumn("_salt", F.spark_partition_id() % salts)
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max("_win").alias("_win"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("_digest", "_text").agg(F.max("_win").alias("_win"), F.sum("group_size").alias("group_size"))


def survivors(docs: DataFrame, columns: Sequence[str], salts: int = 16, digest: Digest = sha256, id_col: str = "doc_id") -> DataFrame:
    """One whole row per distinct text, that with the largest ``id_col``, restricted to ``columns``.

    Rows without an id lose to rows with one. Rows equal in id and text count as one document; of such rows with other
    values in the remaining columns the largest by those columns stays. A null text comes back as empty. Empty in, empty out.
    """
    rest = [c for c in columns if c not in (id_col, "text")]
    win = F.struct(F.col(id_col).alias(id_col), *[F.col(c).alias(c) for c in rest])
    kept = _merge(docs, win, salts, digest, id_col)
    return kept.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"_win.{c}").alias(c) for c in columns])


def assign(docs: DataFrame, salts: int = 16, digest: Digest = sha256, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept and text_sha256.

    keep_id is the largest id of the rows with the same text (null when none of them has an id); kept says that the row
    has it. Rows equal in id and text are the same document and answer alike. Other columns of ``docs`` are not read, so
    no name can clash. The classes carry digests only; should two texts share one, their rows are told apart by text.
    """
    classes = _merge(docs, F.col(id_col), salts, digest, id_col).select("_digest", F.col("_win").alias("keep_id"), "group_size")
    classes = cut_lineage(classes, "dedup-classes")
    texts = docs.select(F.col(id_col), text_of().alias("_text")).withColumn("_digest", digest(F.col("_text")))
    shared = classes.groupBy("_digest").count().where("count > 1").select("_digest")
    if shared.isEmpty():
        rows = cut_lineage(texts.select(id_col, "_digest", sha256(F.col("_text")).alias("text_sha256")), "dedup-rows")
        out = join_sized(rows, classes, "_digest", "group_size")
    else:
        by_text = _merge(docs, F.col(id_col), salts, digest, id_col).select(
            "_digest", "_text", F.col("_win").alias("keep_id"), "group_size")
        out = texts.join(by_text, ["_digest", "_text"]).withColumn("text_sha256", sha256(F.col("_text")))
    return out.select(id_col, "keep_id", F.col("group_size").cast("long"),
                      F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
