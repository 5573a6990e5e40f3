"""Data-quality reports over Bronze and Silver tables.

Distinct counts go through grouped keys: each level of the grouping combines map-side, so no task ever holds the
distinct set of a whole year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.functions.exprs import count_if, month_index, tagged_rows
from lossloom.functions.joins import loan_join
from lossloom.operators.silver import RULES


def _year() -> Column:
    return F.col("_source_year").cast("long").alias("year")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def _per_loan(df: DataFrame, checks: dict[str, Column], period: str | None = None) -> DataFrame:
    """Rows, distinct ids (null counts as one), repeated keys and check counts per year."""
    keys = ["loan_id"] + ([period] if period else [])
    first = df.groupBy(_year(), *keys).agg(F.count(F.lit(1)).alias("n"), *[count_if(x).alias(k) for k, x in checks.items()])
    if period:
        first = first.groupBy("year", "loan_id").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"), F.min(period).alias("lo"), F.max(period).alias("hi"),
            *[F.sum(k).alias(k) for k in checks])
    extra = [F.sum("pairs").alias("pairs"), F.min("lo").alias("lo"), F.max("hi").alias("hi")] if period else []
    return first.groupBy("year").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids"), *extra,
                                     *[F.sum(k).alias(k) for k in checks])


def bronze_metrics(origination: DataFrame, performance: DataFrame) -> DataFrame:
    o = _per_loan(origination, {"null_ids": _blank("loan_id")})
    p = _per_loan(performance, {"null_ids": _blank("loan_id"), "null_periods": _blank("period")}, "period")
    none = F.lit(None).cast("long")
    first = o.select(
        "year", F.lit("origination").alias("dataset"), F.col("n").alias("row_count"), F.col("ids").alias("unique_loan_count"),
        (F.col("n") - F.col("ids")).alias("duplicate_loan_ids"), none.alias("unique_loan_period_count"),
        none.alias("duplicate_loan_periods"), F.col("null_ids").alias("null_loan_ids"), none.alias("null_periods"),
        F.lit(None).cast("string").alias("min_period"), F.lit(None).cast("string").alias("max_period"))
    second = p.select(
        "year", F.lit("performance").alias("dataset"), F.col("n").alias("row_count"), F.col("ids").alias("unique_loan_count"),
        none.alias("duplicate_loan_ids"), F.col("pairs").alias("unique_loan_period_count"),
        (F.col("n") - F.col("pairs")).alias("duplicate_loan_periods"), F.col("null_ids").alias("null_loan_ids"),
        "null_periods", F.col("lo").alias("min_period"), F.col("hi").alias("max_period"))
    return first.unionByName(second)


def referential(origination: DataFrame, performance: DataFrame) -> DataFrame:
    """Loans present on one side only, both directions from one outer grouping."""
    sides = (origination.select("loan_id", F.lit(1).alias("o"), F.lit(0).alias("p"))
             .unionByName(performance.select("loan_id", F.lit(0).alias("o"), F.lit(1).alias("p"))))
    per_loan = sides.groupBy("loan_id").agg(F.max("o").alias("o"), F.max("p").alias("p"))
    return per_loan.agg(count_if((F.col("p") == 1) & (F.col("o") == 0)).alias("performance_unmatched"),
                        count_if((F.col("o") == 1) & (F.col("p") == 0)).alias("origination_unmatched"))


def _outside(c: str, lo: float, hi: float) -> Column:
    return ~F.col(c).between(lo, hi)


ORIGINATION_CHECKS = {
    "null_loan_ids": ("ERROR", lambda: _blank("loan_id")),
    "invalid_original_upb": ("WARNING", lambda: F.col("original_upb") <= 0),
    "invalid_credit_score": ("WARNING", lambda: _outside("credit_score", 300, 850)),
    "invalid_dti": ("WARNING", lambda: _outside("original_debt_to_income_ratio", 1, 65)),
    "invalid_ltv": ("WARNING", lambda: _outside("original_loan_to_value", 1, 998)),
    "invalid_cltv": ("WARNING", lambda: _outside("original_combined_loan_to_value", 1, 998)),
    "invalid_first_payment_date": ("WARNING", lambda: F.col("first_payment_date").isNull()),
    "first_payment_before_origination": ("WARNING", lambda: F.col("first_payment_date") < F.col("origination_month")),
    "maturity_before_first_payment": ("WARNING", lambda: F.col("maturity_date") < F.col("first_payment_date")),
}
PERFORMANCE_CHECKS = {
    "null_loan_ids": ("ERROR", lambda: _blank("loan_id")),
    "null_period": ("ERROR", lambda: F.col("period").isNull()),
    "negative_current_upb": ("WARNING", lambda: F.col("current_actual_upb") < 0),
    "invalid_current_interest_rate": ("WARNING", lambda: _outside("current_interest_rate", 0, 30)),
    "invalid_remaining_maturity": ("WARNING", lambda: F.col("remaining_months_to_legal_maturity") < 0),
    "unknown_delinquency_status": ("WARNING", lambda: F.col("delinquency_status_type") == "UNKNOWN_SPECIAL_STATUS"),
}


def _check_rows(totals: DataFrame, dataset: str, counted: list[tuple[str, str, Column]]) -> DataFrame:
    rows = [[F.lit(dataset), F.lit(sev), F.lit(name), x.cast("long")] for sev, name, x in counted]
    return tagged_rows(totals, ["year"], rows, ["dataset", "severity", "check", "value"])


def origination_checks(silver: DataFrame) -> DataFrame:
    t = _per_loan(silver, {k: f() for k, (_, f) in ORIGINATION_CHECKS.items()})
    rows = [("INFO", "row_count", F.col("n")), ("INFO", "unique_loan_count", F.col("ids")),
            ("ERROR", "duplicate_loan_ids", F.col("n") - F.col("ids"))]
    return _check_rows(t, "origination", rows + [(s, k, F.col(k)) for k, (s, _) in ORIGINATION_CHECKS.items()])


def performance_checks(silver: DataFrame) -> DataFrame:
    t = _per_loan(silver, {k: f() for k, (_, f) in PERFORMANCE_CHECKS.items()}, "period")
    rows = [("INFO", "row_count", F.col("n")), ("INFO", "unique_loan_count", F.col("ids")),
            ("ERROR", "duplicate_loan_periods", F.col("n") - F.col("pairs"))]
    return _check_rows(t, "performance", rows + [(s, k, F.col(k)) for k, (s, _) in PERFORMANCE_CHECKS.items()])


def normalization_summary(silver: DataFrame, dataset: str) -> DataFrame:
    fields = [f for f in RULES if f"{f}_status" in silver.columns]

    def n(f: str, s: str) -> Column:
        return count_if(F.col(f"{f}_status") == s)

    aggs = [F.count(F.lit(1)).alias("n")]
    for f in fields:
        aggs += [n(f, "VALID_VALUE").alias(f"{f}_v"), n(f, "INVALID").alias(f"{f}_i"),
                 n(f, "STRUCTURAL_NOT_AVAILABLE").alias(f"{f}_s")]
    totals = silver.groupBy(_year()).agg(*aggs)
    rows = [[F.lit(dataset), F.lit(f), F.col("n"), F.col(f"{f}_v"), F.col("n") - F.col(f"{f}_v"),
             F.col("n") - F.col(f"{f}_v"), F.col(f"{f}_i"), F.lit(0).cast("long"), F.col(f"{f}_s")] for f in fields]
    return tagged_rows(totals, ["year"], rows, [
        "dataset", "field", "source_rows", "valid_values", "normalized_nulls", "sentinel_values", "invalid_values",
        "conversion_failures", "structural_missing"])


#: Base-two logarithm of the buckets of a distinct sketch; 14 gives a relative standard error near 0.8%.
SKETCH_BITS = 14


def _reported(silver: DataFrame) -> list[str]:
    return [c for c in silver.columns if not c.startswith("_") and not c.endswith("_status")]


def field_sketches(silver: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Rows, filled values and a mergeable distinct sketch per year and field, from one read that does not multiply the rows.

    Stored by year, the table grows by the new years only; ``merged_availability`` reports from it without the rows.
    """
    fields = list(fields or _reported(silver))
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in fields:
        marked = F.concat(F.lit("="), F.col(f).cast("string"))  # a sketch takes no notice of an empty text, which is a value here
        aggs += [F.count(f).alias(f"{f}_c"), F.hll_sketch_agg(marked, SKETCH_BITS).alias(f"{f}_k")]
    rows = [[F.lit(f), F.col("n"), F.col(f"{f}_c"), F.col(f"{f}_k")] for f in fields]
    return tagged_rows(silver.groupBy("_source_year").agg(*aggs), ["_source_year"], rows, ["field", "row_count", "non_null_count", "sketch"])


def _level(by_year: bool) -> Column:
    return _year() if by_year else F.lit(None).cast("long").alias("year")


def _shares(t: DataFrame, dataset: str) -> DataFrame:
    return t.select(F.lit(dataset).alias("dataset"), "year", "field", "row_count", "non_null_count",
                    (F.col("non_null_count") / F.col("row_count")).alias("non_null_pct"), "distinct_count")


def merged_availability(sketches: DataFrame, dataset: str, by_year: bool = True) -> DataFrame:
    """Non-null share and estimated distinct values of every field by year, or of all years together (year null)."""
    estimate = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("long")
    return _shares(sketches.groupBy(_level(by_year), "field").agg(
        F.sum("row_count").alias("row_count"), F.sum("non_null_count").alias("non_null_count"), estimate.alias("distinct_count")), dataset)


def field_values(silver: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Rows of every distinct value by year and field, from one read that multiplies the rows by the fields."""
    long = silver.unpivot(["_source_year"], [F.col(f).cast("string").alias(f) for f in fields or _reported(silver)], "field", "v")
    return long.groupBy(_year(), "field", "v").agg(F.count(F.lit(1)).alias("n"))


def _all_years(values: DataFrame) -> DataFrame:
    return values.groupBy(F.lit(None).cast("long").alias("year"), "field", "v").agg(F.sum("n").alias("n"))


def distinct_counts(values: DataFrame, by_year: bool = True) -> DataFrame:
    """Distinct values by year, or of all years together (year null), from ``field_values``; a field without a value has no row."""
    filled = values.where("v IS NOT NULL")
    return (filled if by_year else _all_years(filled)).groupBy("year", "field").agg(F.count(F.lit(1)).alias("distinct_count"))


def availability(silver: DataFrame, dataset: str, fields: Sequence[str] | None = None, exact: bool = False, by_year: bool = True) -> DataFrame:
    """Non-null share and distinct values of every field by year, or of all years together (year null).

    Distinct counts are estimated from one sketch per field. ``exact=True`` counts the distinct values instead.
    """
    if not exact:
        return merged_availability(field_sketches(silver, fields), dataset, by_year)
    values = field_values(silver, fields)
    return _shares((values if by_year else _all_years(values)).groupBy("year", "field").agg(
        F.sum("n").alias("row_count"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("non_null_count"),
        F.count("v").alias("distinct_count")), dataset)


def temporal_gaps(silver_performance: DataFrame) -> DataFrame:
    w = Window.partitionBy("loan_id").orderBy("period")
    gap = month_index("period") - F.lag(month_index("period")).over(w)
    per_loan = (silver_performance.select("loan_id", gap.alias("gap")).where("gap > 1")
                .groupBy("loan_id").agg(F.sum(F.col("gap") - 1).alias("missing"), F.max(F.col("gap") - 1).alias("widest")))
    t = per_loan.agg(F.count(F.lit(1)).alias("loans"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
                     F.coalesce(F.max("widest"), F.lit(0)).alias("widest"))
    return tagged_rows(t, [], [[F.lit("loans_with_month_gaps"), F.col("loans").cast("long")],
                               [F.lit("total_missing_months"), F.col("missing").cast("long")],
                               [F.lit("max_gap_months"), F.col("widest").cast("long")]], ["metric", "value"])


def without_performance(origination: DataFrame, performance: DataFrame) -> DataFrame:
    seen = performance.select("_source_year", "loan_id").distinct()
    sent = origination.select("_source_year", "loan_id", "first_payment_date", "maturity_date", "origination_month",
                              "original_upb", "seller_name", "property_state", "loan_purpose")
    return loan_join(sent, seen, ["_source_year", "loan_id"], "left_anti").orderBy("_source_year", "loan_id")


def silver_summary(origination: DataFrame, performance: DataFrame) -> DataFrame:
    o = (origination.groupBy("loan_id").agg(F.count(F.lit(1)).alias("n"))
         .agg(F.sum("n").alias("origination_rows"), F.count("loan_id").alias("origination_unique_loans")))
    p = (performance.groupBy("loan_id", "period").agg(F.count(F.lit(1)).alias("n"))
         .groupBy("loan_id").agg(F.sum("n").alias("n"), F.count("period").alias("k"), F.min("period").alias("lo"),
                                 F.max("period").alias("hi"))
         .agg(F.sum("n").alias("performance_rows"), F.count("loan_id").alias("performance_unique_loans"),
              F.sum(F.when(F.col("loan_id").isNotNull(), F.col("k")).otherwise(0)).alias("performance_unique_loan_periods"),
              F.min("lo").alias("min_period"), F.max("hi").alias("max_period")))
    return o.crossJoin(p)  # two single-row aggregates
