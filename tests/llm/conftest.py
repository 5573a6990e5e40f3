from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_cases import SCHEMA, SF  # noqa: E402


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text[, source]) rows, with extra columns whose names clash with internal ones."""
    from lossloom.llm.common import importable

    importable(spark)

    def build(rows, extra: bool = True):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for c in ("size", "node", "kept", "score", "_text", "_salt", "keep_id", "path"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return build


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest documents table as (doc_id, text, source) rows."""
    from lossloom.llm.common import table

    return [(r["doc_id"], r["text"], r["source"]) for r in table(spark, SF, "documents").collect()]
