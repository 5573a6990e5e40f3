"""Discrete hazard curves. Curve tables hold one row per rating (or scenario, date and rating) and month: small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.functions.exprs import clip

DOUBLINGS = 10
HALVINGS = 60


def cumulative_of(hazards: Column, factor: Column) -> Column:
    """Cumulative probability of a hazard array scaled by ``factor``, each hazard capped at 1."""
    survival = F.aggregate(hazards, F.lit(1.0), lambda s, h: s * (1 - F.least(F.lit(1.0), h * factor)))
    return 1 - survival


def hazard_scale(hazards: Column, target: Column) -> Column:
    """Factor that brings the cumulative probability of ``hazards`` to ``target``, by doubling and then bisection.

    A target of 0 (or no hazards) gives 0. An unreachable target gives the last doubling, as the search ends there.
    """
    goal = clip(target, 0.0, 1.0)
    start = F.aggregate(
        F.sequence(F.lit(1), F.lit(DOUBLINGS)), F.lit(1.0),
        lambda hi, _: F.when(cumulative_of(hazards, hi) < goal, hi * 2).otherwise(hi))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = cumulative_of(hazards, mid) < goal
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("lo"), start.alias("hi")), halve)
    return F.when((F.size(hazards) == 0) | (goal == 0), F.lit(0.0)).otherwise(found["hi"])


def with_survival(df: DataFrame, keys: Sequence[str], hazard: str = "conditional_pd") -> DataFrame:
    """Marginal, cumulative and survival columns from the monthly hazard of each curve."""
    cum = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("survival_probability", F.product(1 - F.col(hazard)).over(cum))
    prev = F.coalesce(F.lag("survival_probability").over(Window.partitionBy(*keys).orderBy("month")), F.lit(1.0))
    return df.withColumns({"hazard": F.col(hazard), "marginal_pd": prev * F.col(hazard),
                           "cumulative_pd": 1 - F.col("survival_probability")})
