"""Corpus pipeline: from raw documents to token ids in five stages, each a whole-table job on what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` stores each result in the shared folder and
reads it back for the next stage. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossloom.llm import bpe, exact_dedup, jaccard_join, quality_cnn, source_mix
from lossloom.llm.common import bounded_batches, importable, table
from lossloom.sources.store import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the byte network scores below its threshold."""
    bounded_batches(spark)  # a row travels with its whole text twice
    net = quality_cnn.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole")  # no name in it can clash
    kept = quality_cnn.score(docs.select("doc_id", "text", whole), net, keep=("whole",)).where("predicted = 1")
    return kept.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    importable(spark)
    return exact_dedup.survivors(docs, docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least id stays, one without an id only if none has one."""
    importable(spark)
    return jaccard_join.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows that share id, source and size are taken alike."""
    importable(spark)
    return source_mix.taken(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every row."""
    importable(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mix), ("bpe", encode)]
#: Not expressible in SQL: a trained network, token ids. Tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
