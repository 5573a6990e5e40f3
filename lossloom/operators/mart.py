"""Point-in-time mart: one row per loan and reporting month, built only from that month and earlier ones.

Every window partitions by loan and orders by calendar month number, so the whole mart costs one shuffle and one sort.
A loan holds at most one row per calendar month (see ``primary_key_report``), which bounds each window partition by the
length of the reporting history, whatever the size of the portfolio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.functions.exprs import count_if, flag, month_diff, month_index, ratio_if_positive, tagged_rows, unpivot
from lossloom.functions.joins import with_attributes
from lossloom.functions.ranks import exact_quantiles
from lossloom.sources.schemas import layout_for

STATIC_NAMES = {
    "origination_month": "origination_date",
    "credit_score": "original_credit_score",
    "original_debt_to_income_ratio": "original_dti",
    "original_loan_to_value": "original_ltv",
    "original_combined_loan_to_value": "original_cltv",
}
MONTH_NAMES = {
    "period": "as_of_date",
    "loan_age": "loan_age_source",
    "remaining_months_to_legal_maturity": "remaining_months_to_maturity_source",
    "delinquency_status_type": "delinquency_status_category",
    "current_loan_delinquency_status": "delinquency_status_raw",
}
LINEAGE = ("_source_year", "_source_zip", "_source_member", "_ingested_at", "_schema_version", "_silver_processed_at", "_source_row_number")
LAGS = {
    "delinquency_months": ("delinquency_months_lag_", (1, 3, 6, 12)),
    "current_actual_upb": ("current_upb_lag_", (1, 3, 6, 12)),
    "current_interest_rate": ("current_interest_rate_lag_", (1, 12)),
}
POPULATION_FEATURES = ("months_on_book_derived", "current_upb_to_original_upb", "max_delinquency_months_to_date",
                       "months_since_last_delinquency", "observed_months_to_date", "delinquency_months_lag_1",
                       "current_upb_lag_12")
DISTRIBUTION_FEATURES = POPULATION_FEATURES[:5]


def by_loan() -> Window:
    return Window.partitionBy("loan_id").orderBy("month_index")


def to_date() -> Window:
    return by_loan().rowsBetween(Window.unboundedPreceding, 0)


def loan_static(origination: DataFrame) -> DataFrame:
    """Origination attributes (and their missing-value statuses) under their mart names; no lineage."""
    out = origination.withColumnsRenamed(STATIC_NAMES)
    if "_source_year" in out.columns:
        out = out.withColumnRenamed("_source_year", "vintage_year")
    fields = {STATIC_NAMES.get(n, n) for n in (*layout_for("origination", 2012).names, "origination_month")} | {"vintage_year"}
    return out.select(*[c for c in out.columns if c in fields or c.endswith("_status")])


def panel_base(performance: DataFrame, static: DataFrame) -> DataFrame:
    """Performance rows with the loan attributes the month features need."""
    perf = performance
    if "vintage_year" not in perf.columns:
        perf = perf.withColumnRenamed("_source_year", "vintage_year")
    if "month_index" not in perf.columns:
        perf = perf.withColumn("month_index", month_index("period").cast("long"))
    kept = ["origination_date", "first_payment_date", "maturity_date", "original_upb", "original_interest_rate"]
    return with_attributes(perf.withColumnsRenamed(MONTH_NAMES), static.select("loan_id", "vintage_year", *kept))


def _lag_columns() -> dict[str, Column]:
    cols = {}
    for source, (prefix, months) in LAGS.items():
        for k in months:
            cols[f"{prefix}{k}"] = F.max(source).over(by_loan().rangeBetween(-k, -k))
    return cols


def calendar_lags(df: DataFrame) -> DataFrame:
    """Value exactly k calendar months earlier, null when that month was not reported."""
    return df.withColumns(_lag_columns())


def _count_columns() -> dict[str, Column]:
    first = F.min("month_index").over(to_date())
    return {
        "observed_months_to_date": F.row_number().over(by_loan()).cast("long"),
        "calendar_months_since_first_observation": F.col("month_index") - first + 1,
    }


def observation_counts(df: DataFrame) -> DataFrame:
    return df.withColumns(_count_columns())


def reporting_gaps(df: DataFrame) -> DataFrame:
    """A gap lies behind a row exactly when more calendar months than reported months have passed."""
    seen = F.count(F.lit(1)).over(to_date())
    return df.withColumn("has_reporting_gap_to_date", F.col("month_index") - F.min("month_index").over(to_date()) + 1 > seen)


def _history_columns() -> dict[str, Column]:
    dq = F.col("delinquency_months")
    w = to_date()

    def months_at(k: int):
        return F.sum(F.when(dq >= k, 1).otherwise(0)).over(w)

    # Text deliveries leave an absent code blank rather than null.
    given = [F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull() for c in ("borrower_assistance_status_code", "payment_deferral_flag")]
    assisted = given[0] | given[1]
    return {
        "max_delinquency_months_to_date": F.max(dq).over(w),
        "months_delinquent_to_date": F.sum(F.when(dq > 0, 1).otherwise(0)).over(w),
        **{f"months_{k}plus_delinquent_to_date": months_at(k) for k in (1, 2, 3)},
        "ever_modified_to_date": F.max(flag(F.col("modification_flag") == "Y")).over(w),
        "current_assistance_flag": assisted,
        "ever_assistance_to_date": F.max(assisted).over(w),
    }


def history(df: DataFrame) -> DataFrame:
    """Cumulative delinquency, modification and assistance history, the current month included."""
    return df.withColumns(_history_columns())


def _recency_columns() -> dict[str, Column]:
    def since(cond):
        return F.col("month_index") - F.max(F.when(cond, F.col("month_index"))).over(to_date())

    return {
        "months_since_last_delinquency": since(F.col("delinquency_months") > 0),
        "months_since_last_modification": since(F.col("modification_flag") == "Y"),
    }


def recency(df: DataFrame) -> DataFrame:
    return df.withColumns(_recency_columns())


def delinquency_entries(df: DataFrame) -> DataFrame:
    """Needs the one-month lag: an entry is a move from exactly 0 last month to above 0."""
    entry = flag((F.col("delinquency_months_lag_1") == 0) & (F.col("delinquency_months") > 0))
    return df.withColumns({
        "delinquency_event_current_month": entry,
        "delinquency_events_to_date": F.sum(entry.cast("long")).over(to_date()),
    })


def _trailing_columns() -> dict[str, Column]:
    dq = F.col("delinquency_months")
    cols = {}
    for k in (3, 6, 12):
        w = by_loan().rangeBetween(-(k - 1), 0)
        cols[f"max_delinquency_last_{k}m"] = F.max(dq).over(w)
        cols[f"months_delinquent_last_{k}m"] = F.sum(F.when(dq > 0, 1).otherwise(0)).over(w)
    return cols


def trailing_windows(df: DataFrame) -> DataFrame:
    return df.withColumns(_trailing_columns())


def derived_ratios(df: DataFrame) -> DataFrame:
    upb, rate = F.col("current_actual_upb"), F.col("current_interest_rate")
    cols = {
        "current_upb_to_original_upb": ratio_if_positive(upb, "original_upb"),
        "principal_reduction_to_date": F.col("original_upb") - upb,
        "interest_rate_change_from_origination": rate - F.col("original_interest_rate"),
        "rate_change_1m": rate - F.col("current_interest_rate_lag_1"),
        "rate_change_12m": rate - F.col("current_interest_rate_lag_12"),
    }
    for k in (1, 3, 6, 12):
        change = upb - F.col(f"current_upb_lag_{k}")
        cols[f"upb_change_{k}m"] = change
        cols[f"upb_change_pct_{k}m"] = ratio_if_positive(change, f"current_upb_lag_{k}")
    return df.withColumns(cols)


def tenure(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "months_on_book_derived": month_diff("first_payment_date", "as_of_date") + 1,
        "months_since_origination": month_diff("origination_date", "as_of_date"),
        "months_to_contractual_maturity": month_diff("as_of_date", "maturity_date"),
    })


def loan_month(performance: DataFrame, static: DataFrame) -> DataFrame:
    """The complete loan-month mart.

    All features that read only source columns are computed by one window operator; the entry counter, which reads a
    lag, takes a second one on the same order.
    """
    df = panel_base(performance, static)
    gap = F.col("month_index") - F.min("month_index").over(to_date()) + 1 > F.count(F.lit(1)).over(to_date())
    df = df.withColumns(_lag_columns() | _count_columns() | _history_columns() | _recency_columns() | _trailing_columns()
                        | {"has_reporting_gap_to_date": gap})
    for step in (delinquency_entries, derived_ratios, tenure):
        df = step(df)
    return df.drop("origination_date", "first_payment_date", "maturity_date", "original_upb", "original_interest_rate")


def analytical(month: DataFrame, static: DataFrame) -> DataFrame:
    """Month rows with all loan attributes; lineage columns come from the month side only."""
    return with_attributes(month, static.drop(*LINEAGE))


def validation(static: DataFrame, month: DataFrame, view: DataFrame) -> DataFrame:
    """One row of key counts, duplicates and date bounds.

    Rows are first reduced to one per (loan, month), which gives duplicates and distinct keys in the same pass.
    """
    keys = month.groupBy("loan_id", "as_of_date").agg(F.count(F.lit(1)).alias("n"))
    per_loan = keys.groupBy("loan_id").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), count_if(F.col("n") > 1).alias("dup"),
        F.min("as_of_date").alias("lo"), F.max("as_of_date").alias("hi"))
    m = per_loan.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("loan_month_rows"),
        F.count(F.lit(1)).alias("loan_month_distinct_loans"),
        F.coalesce(F.sum("keys"), F.lit(0)).alias("loan_month_unique_keys"),
        F.min("lo").alias("min_as_of_date"), F.max("hi").alias("max_as_of_date"),
        F.coalesce(F.sum("dup"), F.lit(0)).alias("primary_key_duplicate_count"))
    s = (static.groupBy("loan_id").agg(F.count(F.lit(1)).alias("n"), F.min("vintage_year").alias("a"),
                                       F.max("vintage_year").alias("b"))
         .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("loan_static_rows"),
              F.count(F.lit(1)).alias("loan_static_unique_loans"),
              count_if(F.col("a") != F.col("b")).alias("cross_vintage_duplicate_loan_ids")))
    v = view.agg(F.count(F.lit(1)).alias("analytical_view_rows"))
    return s.crossJoin(m).crossJoin(v)  # three single-row aggregates


def vintage_profile(month: DataFrame) -> DataFrame:
    """Per-vintage counts; the median runs over months per loan, an integer bounded by the history length."""
    loans = month.groupBy("vintage_year", "loan_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(flag(F.col("delinquency_months") > 0)).alias("dq"),
        F.max("ever_modified_to_date").alias("mod"), F.max("has_reporting_gap_to_date").alias("gap"),
        F.min("as_of_date").alias("lo"), F.max("as_of_date").alias("hi"))
    return loans.groupBy("vintage_year").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique_loans"),
        F.min("lo").alias("min_as_of_date"), F.max("hi").alias("max_as_of_date"),
        F.avg("n").alias("avg_observed_months_per_loan"), F.median("n").alias("median_observed_months_per_loan"),
        F.max("n").alias("max_observed_months_per_loan"), count_if(F.col("dq")).alias("loans_ever_delinquent"),
        count_if(F.col("mod")).alias("loans_ever_modified"), count_if(F.col("gap")).alias("loans_with_reporting_gaps"))


def feature_population(month: DataFrame, features=POPULATION_FEATURES) -> DataFrame:
    """Non-null share per feature and vintage, all features in one aggregate."""
    wide = month.groupBy("vintage_year").agg(F.count(F.lit(1)).alias("_n"), *[F.count(f).alias(f) for f in features])
    rows = [[F.lit(f), F.col(f), F.col(f) / F.col("_n")] for f in features]
    return tagged_rows(wide.withColumnRenamed("vintage_year", "year"), ["year"], rows,
                       ["feature", "non_null_count", "non_null_pct"])


def feature_distribution(month: DataFrame, features=DISTRIBUTION_FEATURES) -> DataFrame:
    """Range, mean, exact median and tail quantiles, and null rate per feature."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in features:
        aggs += [F.min(f).alias(f"{f}_mn"), F.max(f).alias(f"{f}_mx"), F.avg(f).alias(f"{f}_av"), F.count(f).alias(f"{f}_c")]
    rows = [[F.lit(f), F.col(f"{f}_mn").cast("double"), F.col(f"{f}_mx").cast("double"), F.col(f"{f}_av"),
             1 - F.col(f"{f}_c") / F.col("_n")] for f in features]
    stats = tagged_rows(month.agg(*aggs), [], rows, ["feature", "min", "max", "mean", "null_rate"])
    q = exact_quantiles(unpivot(month, [], features, "feature", "value"), ["feature"], "value", [0.5, 0.01, 0.99])
    return stats.join(q, "feature", "left").select(
        "feature", "min", "max", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p01"),
        F.col("q")[2].alias("p99"), "null_rate")
