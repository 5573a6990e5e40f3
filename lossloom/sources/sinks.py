"""Partitioned tables and small reports on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException


def existing_years(spark: SparkSession, path: str, column: str = "vintage_year") -> DataFrame:
    """Partition years present under a table folder; empty when the folder does not exist yet."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{column} bigint")
    return table.select(F.col(column).cast("long").alias(column)).distinct()


def partition_years(spark: SparkSession, path: str, column: str = "vintage_year") -> list[int]:
    """Years of the partition folders right under a path, from a listing: no file is read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = [f.getPath().getName() for f in found if f.isDirectory()]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{column}="))


def missing_years(spark: SparkSession, path: str, wanted: DataFrame, column: str = "vintage_year") -> DataFrame:
    return wanted.select(F.col(column).cast("long").alias(column)).distinct().join(
        existing_years(spark, path, column), column, "left_anti")


def require_years(spark: SparkSession, path: str, years: list[int], column: str = "vintage_year") -> None:
    have = {r[0] for r in existing_years(spark, path, column).collect()}  # one value per partition folder
    gone = sorted(set(years) - have)
    if gone:
        raise ValueError(f"{path} has no partition for {gone}")


def write_partitions(df: DataFrame, path: str, column: str = "vintage_year", force: bool = False) -> None:
    """Write by partition; without ``force`` partitions already present stay as they are, with it they are replaced.

    The commit protocol publishes each partition only when the whole job has succeeded.
    """
    if not force:
        df = df.join(existing_years(df.sparkSession, path, column), column, "left_anti")
    # Every column but the partition takes part, so no sentinel or hot value gathers in one task; the slots follow the session.
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(F.col(column), F.pmod(F.xxhash64(*[c for c in df.columns if c != column]), F.lit(slots)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy(column).parquet(path))


def round_trip(df: DataFrame, path: str, column: str = "vintage_year") -> DataFrame:
    """Rows sent to and found in each partition after a write."""
    sent = df.groupBy(column).agg(F.count(F.lit(1)).alias("written_rows"))
    found = df.sparkSession.read.parquet(path).groupBy(F.col(column).cast("long").alias(column)).agg(
        F.count(F.lit(1)).alias("stored_rows"))
    return sent.join(found, column, "full_outer").select(
        column, F.coalesce("written_rows", F.lit(0)).alias("written_rows"),
        F.coalesce("stored_rows", F.lit(0)).alias("stored_rows"))


def write_report(df: DataFrame, path: str) -> None:
    """Aggregate report as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
