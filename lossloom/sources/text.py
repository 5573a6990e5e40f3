"""Headerless delimited text: positional columns, width check, safe typing and lineage.

Input is a DataFrame from ``spark.read.text`` over a folder partitioned by ``vintage_year``, or the ``stored_lines`` of one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.functions.exprs import count_if
from lossloom.sources.schemas import Layout
from lossloom.sources.store import cut_lineage


def fields(lay: Layout):
    return F.split("value", re.escape(lay.delimiter), -1)


def filled(lines: DataFrame) -> DataFrame:
    return lines.where(F.length("value") > 0)


def positional(lines: DataFrame, lay: Layout, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the right width as named text columns; empty fields stay empty strings."""
    parts = filled(lines).withColumn("_f", fields(lay)).where(F.size("_f") == len(lay.columns))
    # The width is checked, so no field needs a bounds error of its own: with them the typing of 35 columns is more code than the JVM compiles.
    return parts.select(*keep, *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(lay.names)])


def width_report(lines: DataFrame, lay: Layout) -> DataFrame:
    return filled(lines).groupBy(F.col("vintage_year").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), count_if(F.size(fields(lay)) != len(lay.columns)).alias("bad_rows"))


def malformed(lines: DataFrame, lay: Layout) -> DataFrame:
    """Rows of the wrong width with their file and row number: the quarantine table. Only these few rows are joined to the block table."""
    stored = stored_lines(lines)
    wrong = (stored.withColumn("observed", F.size(fields(lay))).where(F.col("observed") != len(lay.columns))
             .withColumn("expected", F.lit(len(lay.columns))))
    return _numbered(stored, wrong)


def reconciliation(lines: DataFrame, rows: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row: lines in, rows out, lines quarantined, and what neither accounts for (0 when nothing is lost)."""
    one = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((filled(lines), "lines"), (rows, "bronze_rows"), (quarantine, "quarantined_rows"))]
    return one[0].crossJoin(one[1]).crossJoin(one[2]).withColumn(
        "unaccounted_rows", F.col("lines") - F.col("bronze_rows") - F.col("quarantined_rows"))


def require_width(lines: DataFrame, lay: Layout) -> None:
    """Raise when any row has the wrong width, naming one; a single small aggregate decides."""
    worst = malformed(lines, lay).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_source_member", "_source_row_number", "observed")).alias("at")).first()
    if worst["n"]:
        at = worst["at"]
        raise ValueError(f"{worst['n']} rows do not have {len(lay.columns)} columns; first: {at['_source_member']} "
                         f"row {at['_source_row_number']} has {at['observed']}")


#: Splits of text files that one block table may list before it is joined by a shuffle instead of a broadcast.
MAX_BLOCKS = 1_000_000


def placed(lines: DataFrame) -> DataFrame:
    """Filled lines with their file, split and a number that rises inside the split; to be stored before it is numbered."""
    return filled(lines).select(
        "*", F.col("_metadata.file_path").alias("_source_member"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"))


def stored_lines(lines: DataFrame) -> DataFrame:
    """``placed`` lines of one scan of the text, written once; lines that were stored before come back as they are.

    Where a file is split follows settings and the cluster of the moment, so a count of one scan says nothing sure about the next one. All
    that is numbered, typed or quarantined from one stored table shares one division into splits, and the text itself is parsed once.
    """
    return lines if {"_block", "_at"} <= set(lines.columns) else cut_lineage(placed(lines), "text-lines")


def _numbered(stored: DataFrame, some: DataFrame, **per_file: Column) -> DataFrame:
    """Row numbers of some of the stored lines, from the per-split table: its first number and the rows of the splits before it in the file.

    ``per_file`` are columns made of the file path; they are evaluated once per split and not once per line.
    """
    per_block = stored.groupBy("_source_member", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source_member").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    shift = cut_lineage(per_block.select("_source_member", "_block", first, *[v.alias(n) for n, v in per_file.items()]), "text-blocks")
    shift = F.broadcast(shift) if shift.count() <= MAX_BLOCKS else shift
    return (some.join(shift, ["_source_member", "_block"])
            .withColumn("_source_row_number", (F.col("_at") + F.col("_shift")).cast("long")).drop("_block", "_at", "_shift"))


def with_row_numbers(lines: DataFrame, **per_file: Column) -> DataFrame:
    """File path and 1-based row number inside the file, without moving the text.

    Inside a split the numbers of ``monotonically_increasing_id`` rise by one per line. A table with one row per split, broadcast when it has at
    most MAX_BLOCKS rows, shifts them to positions in the file. Lines and table come from the same stored scan.
    """
    stored = stored_lines(lines)
    return _numbered(stored, stored, **per_file)


def safe_types(df: DataFrame, lay: Layout) -> DataFrame:
    """Declared types; text that does not parse becomes null instead of failing the job.

    Empty text, which most amounts are, is null before the cast: parsing it as a number costs an exception a field.
    """
    return df.withColumns({n: F.nullif(F.col(n), F.lit("")).try_cast(t) for n, t in lay.columns if t != "string"})


def bronze(lines: DataFrame, lay: Layout, ingested_at: str) -> DataFrame:
    """Typed rows with lineage columns."""
    # The pattern tries every start and end in the path, some 30 microseconds a line if taken from each of them.
    numbered = with_row_numbers(lines, _source_zip=F.regexp_extract("_source_member", r"([^/]+)/[^/]+$", 1))
    rows = positional(numbered, lay, ("vintage_year", "_source_zip", "_source_member", "_source_row_number"))
    return safe_types(rows, lay).select(
        *lay.names, F.col("vintage_year").cast("long").alias("_source_year"),
        "_source_zip", "_source_member",
        F.lit(ingested_at).alias("_ingested_at"), F.lit(lay.version).alias("_schema_version"), "_source_row_number")
