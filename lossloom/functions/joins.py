"""Joins of loan tables, and the as-of lookup without an inequality join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def loan_join(left: DataFrame, right: DataFrame, on: Column | Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the loans, as a merge join.

    Spark sizes a table by its files; few columns of packed loan months look small enough to broadcast, and fill the driver when read.
    """
    return left.join(right.hint("merge"), on if isinstance(on, Column) else list(on), how)


def with_attributes(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """Rows with the attributes of their loan in their vintage, where there are any.

    The year is compared after the loan is met: as a key it would ask for an exchange and an order of its own, which loan tables do not have.
    """
    keys = ["loan_id", "vintage_year"]
    right = attributes.withColumnsRenamed({"loan_id": "_loan", "vintage_year": "_year"})
    same = (F.col("loan_id") == F.col("_loan")) & (F.col("vintage_year") - F.col("_year") == 0)
    return loan_join(rows, right, same, "left").select(*keys, *[c for c in [*rows.columns, *attributes.columns] if c not in keys])


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to all shuffle partitions, before windows over it.

    Adaptive execution sizes a task by the packed bytes it reads; rows of loan months unpack to thirty times that, so merged partitions would spill.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def latest_on_or_before(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str,
                        payload: Sequence[str]) -> DataFrame:
    """Attach to each left row the payload of the last right row of the same key dated on or before it.

    Both sides are stacked and the payload is carried forward by one ordered window, so the work is one shuffle on
    ``key`` and linear in the rows. On equal dates the right row sorts first (0 before 1), which gives <=.
    """
    cols = left.columns
    nulls = [F.lit(None).cast(left.schema[x].dataType).alias(x) for x in cols if x != key]
    a = left.select(*cols, F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("_p"),
                    F.col(left_date).alias("_d"), F.lit(1).alias("_side"))
    b = right.select(key, *nulls, F.struct(*payload).alias("_p"), F.col(right_date).alias("_d"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt_by(a.unionByName(b), key).withColumn("_l", F.last("_p", ignorenulls=True).over(w)).where("_side = 1")
    return filled.select(*cols, *[F.col(f"_l.{x}").alias(x) for x in payload])


def in_interval(d: Column, start: Column, end: Column) -> Column:
    """start <= d < end with an open end when null."""
    return (start <= d) & (end.isNull() | (d < end))
