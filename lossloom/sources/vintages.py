"""Loan tables that are partitioned by vintage and bucketed by loan, and what a delivery changed in them.

A table is rebuilt for some vintages by replacing their partition folders alone. Its bucketing and columns are stored
beside it, so that another session reads it in the same layout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossloom.sources.store import loan_co_location

VINTAGE = "vintage_year"


def _fs(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _fs(spark, path)
    return fs.exists(folder)


def drop_vintages(spark: SparkSession, path: str, years: Iterable[int], column: str = VINTAGE) -> None:
    for year in years:
        fs, folder = _fs(spark, f"{path}/{column}={year}")
        fs.delete(folder, True)


def folder_stamps(spark: SparkSession, path: str, column: str = VINTAGE) -> DataFrame:
    """One row per partition folder: vintage and a stamp of the names and sizes of its files. No file is opened.

    Every write of Spark names its files anew, so a replaced partition has another stamp.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "vintage int, stamp string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    name = F.xxhash64(F.element_at(F.split("path", "/"), -1), "length").cast("decimal(38,0)")
    return files.groupBy(F.col(column).cast("int").alias("vintage")).agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum("length").cast("string"), F.sum(name).cast("string")).alias("stamp"))


@dataclass(frozen=True)
class Changes:
    """Vintages whose sources are new or differ from the last build, those that are no longer there, and the present stamps."""

    changed: tuple[int, ...]
    gone: tuple[int, ...]
    stamps: tuple[tuple[int, str], ...]


def changes(spark: SparkSession, sources: dict[str, str], state: str, settings: str = "") -> Changes:
    """``sources`` maps a folder to its partition column; ``settings`` is what else the result depends on. One row per vintage reaches the driver."""
    now: dict[int, list[str]] = {}
    for path, column in sorted(sources.items()):
        for r in folder_stamps(spark, path, column).collect():
            now.setdefault(r["vintage"], [hashlib.md5(settings.encode()).hexdigest()]).append(f"{path.rsplit('/', 1)[-1]}={r['stamp']}")
    stamps = {v: ";".join(parts) for v, parts in now.items()}
    before = {r["vintage"]: r["stamp"] for r in spark.read.parquet(state).collect()} if exists(spark, state) else {}
    return Changes(tuple(sorted(v for v, s in stamps.items() if before.get(v) != s)), tuple(sorted(set(before) - set(stamps))), tuple(sorted(stamps.items())))


def remember(spark: SparkSession, found: Changes, state: str, skipped: Iterable[int] = ()) -> None:
    """Call it when all tables are written: a build that failed before is then repeated. The stamps of ``skipped`` vintages stay as they were."""
    stamps = {v: s for v, s in found.stamps if v not in set(skipped)}
    if skipped and exists(spark, state):
        stamps |= {r["vintage"]: r["stamp"] for r in spark.read.parquet(state).collect() if r["vintage"] in set(skipped)}
    spark.createDataFrame(sorted(stamps.items()), "vintage int, stamp string").coalesce(1).write.mode("overwrite").parquet(state)


def closed_over_loans(loans: DataFrame, years: Iterable[int]) -> list[int]:
    """``years`` and all vintages tied to them by a loan that appears in both, directly or through others.

    Windows run over all rows of a loan, so such vintages are rebuilt together. Pairs of vintages reach the driver, not loans.
    """
    span = loans.groupBy("loan_id").agg(F.array_sort(F.collect_set(VINTAGE)).alias("v")).where(F.size("v") > 1)
    pairs = span.select(F.col("v")[0].alias("a"), F.explode("v").alias("b")).where("a <> b").distinct().collect()
    found = set(years)
    while True:
        more = {y for p in pairs if found & set(p) for y in p} - found
        if not more:
            return sorted(found)
        found |= more


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _table(path: str) -> str:
    return f"lossloom_{hashlib.md5(path.encode()).hexdigest()[:10]}_{path.rsplit('/', 1)[-1]}"


def is_loan_table(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}.layout")


def open_loan_table(spark: SparkSession, path: str) -> DataFrame:
    """The table in its layout: joins and windows on the loan start from its files."""
    table = _table(path)
    if not spark.catalog.tableExists(table):
        layout = spark.read.parquet(f"{path}.layout").first()
        spark.sql(f"CREATE TABLE {table} ({layout['columns']}) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY ({VINTAGE}) "
                  f"CLUSTERED BY (loan_id) SORTED BY (loan_id) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
        if spark.conf.get("spark.sql.catalogImplementation") == "hive":
            spark.catalog.recoverPartitions(table)
    return spark.table(table)


def write_loan_table(df: DataFrame, path: str, years: Iterable[int] | None = None) -> DataFrame:
    """Write all of ``df``, or with ``years`` only these vintages' folders; ``df`` must then hold no others.

    A vintage of ``years`` for which ``df`` has no row loses its folder. All folders of one write appear when it has succeeded. Without
    ``years`` the former table is deleted first, as an overwrite does; its bucketing may differ.
    """
    spark = df.sparkSession
    df = df.select(*[c for c in df.columns if c != VINTAGE], F.col(VINTAGE).cast("int").alias(VINTAGE))
    if years is None:
        spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
        fs, folder = _fs(spark, path)
        fs.delete(folder, True)
        layout = (int(spark.conf.get("spark.sql.shuffle.partitions")), df._jdf.schema().toDDL().replace(" NOT NULL", ""))
        spark.createDataFrame([layout], "buckets int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}.layout")
    table = open_loan_table(spark, path)
    if years is not None and not list(years):
        return table
    if years is not None and df.columns != table.columns:
        raise ValueError(f"{path}: columns changed; rebuild the whole table")
    before = dict(folder_stamps(spark, path).collect())  # one row per partition folder
    buckets = spark.read.parquet(f"{path}.layout").first()["buckets"]
    with loan_co_location(spark), _dynamic_overwrite(spark):
        df.repartition(buckets, "loan_id").write.mode("overwrite").insertInto(_table(path))
    after = dict(folder_stamps(spark, path).collect())
    # A dynamic overwrite leaves folders alone for which no row came; they hold what is no longer there.
    drop_vintages(spark, path, [v for v in years or () if v in before and after[v] == before[v]])
    spark.catalog.refreshTable(_table(path))
    return spark.table(_table(path))
