"""Rows that several tests share."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"

#: Nulls, empty and very long texts, ties, repeated rows.
EDGE = [(None, "a b c d e f"), (None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (4, "other word"), (5, "x" * 200_000),
        (6, "ab " * 60_000), (7, "Ünïcode 中文 𝔘 \u0000 end"), (8, "a b c d e f"), (9, "a b c d e f")]
