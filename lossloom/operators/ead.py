"""Exposure at default: observations, balance projections, ratio model and backtests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossloom.config import EAD
from lossloom.functions.exprs import clip, count_if, flag, safe_div
from lossloom.functions.joins import latest_on_or_before, loan_join
from lossloom.functions.ranks import exact_quantiles
from lossloom.operators import ml_pipeline
from lossloom.operators.features import forbid_outcomes
from lossloom.operators.lgd import ltv_band, split_by
from lossloom.operators.targets import entry_exposure, entry_exposure_source

# Predictors, outcome columns, methods, segments and the columns of the view that observations need.
NUMERIC = ("current_actual_upb", "current_interest_rate", "remaining_months_to_maturity", "original_term", "original_upb",
           "current_upb_to_original_upb", "estimated_loan_to_value", "delinquency_months", "max_delinquency_months_to_date",
           "months_delinquent_to_date", "months_since_last_delinquency", "months_since_origination", "months_to_horizon",
           "current_non_interest_bearing_upb", "current_interest_bearing_upb")
CATEGORICAL = ("rating", "current_ltv_band", "modification_flag", "ever_modified_to_date", "ever_assistance_to_date", "current_assistance_flag",
               "property_state", "property_type", "occupancy_status", "loan_purpose", "channel")
OUTCOMES = frozenset({"ead_at_default", "ead_ratio", "ead_ratio_model_target", "future_default_date", "default_reason", "months_to_default",
                      "event_type", "zero_balance_code", "target_observable"})
METHODS = {"current_balance": "predicted_ead_current_balance", "contractual_amortization": "predicted_ead_contractual",
           "empirical_model": "predicted_ead_empirical_model"}
SEGMENTS = {"months_to_default": "months_to_default_band", "rating": "rating", "observation_year": "observation_year",
            "current_ltv_band": "current_ltv_band", "balance_band": "balance_band"}
VIEW = ("current_actual_upb", "current_interest_rate", "remaining_months_to_maturity_source", "months_to_contractual_maturity",
        "original_loan_term", "original_upb", "current_upb_to_original_upb", "estimated_loan_to_value", "delinquency_months",
        "max_delinquency_months_to_date", "months_delinquent_to_date", "months_since_last_delinquency", "months_since_origination",
        "current_non_interest_bearing_upb", "current_interest_bearing_upb", "modification_flag", "ever_modified_to_date",
        "ever_assistance_to_date", "current_assistance_flag", "property_state", "property_type", "occupancy_status", "loan_purpose", "channel",
        "zero_balance_code")


def contractual_balance(upb: Column, annual_rate_pct: Column, remaining: Column, horizon: Column) -> Column:
    """Balance of a level-payment loan after ``horizon`` months; 0 at and after maturity, straight line at a zero rate."""
    r = F.greatest(annual_rate_pct, F.lit(0.0)) / 100 / 12
    n = F.greatest(remaining, F.lit(0)).cast("double")
    h = F.least(F.greatest(horizon, F.lit(0)), n).cast("double")
    grown = F.pow(1 + r, h)
    payment = upb * r / (1 - F.pow(1 + r, -n))
    annuity = upb * grown - payment * ((grown - 1) / r)
    linear = upb - upb / n * h
    value = F.when((n <= 0) | (h >= n), F.lit(0.0)).when(r > 0, annuity).otherwise(linear)
    known = upb.isNotNull() & annual_rate_pct.isNotNull() & remaining.isNotNull() & horizon.isNotNull()
    return F.when(known, F.greatest(value, F.lit(0.0))).otherwise(F.lit(0.0))


def maturity_months(source: str = "remaining_months_to_maturity_source", contractual: str = "months_to_contractual_maturity") -> Column:
    return F.coalesce(F.nullif(F.col(source), F.lit(0)), F.nullif(F.col(contractual), F.lit(0)))


def chosen_targets(targets: DataFrame, cfg: EAD) -> DataFrame:
    """Future defaults and, unless the settings leave them out, all other future exits."""
    life = targets.where("eligible_for_lifetime_pd").select(
        "loan_id", "as_of_date", "event_default", "event_prepayment_or_exit", "event_type", "first_default_date",
        "future_first_non_default_exit_date", "future_first_non_default_exit_reason", "months_to_default_from_observation")
    return life.where("event_default OR event_prepayment_or_exit" if cfg.include_exits else "event_default")


def observations(view: DataFrame, targets: DataFrame, events: DataFrame, cfg: EAD) -> DataFrame:
    """Open loan-months with their future event and, for defaults, the exposure at that default."""
    m = view.where((F.col("current_actual_upb") > 0) & F.nullif(F.col("zero_balance_code"), F.lit("")).isNull()).select(
        "loan_id", "vintage_year", "as_of_date", *VIEW)
    t = chosen_targets(targets, cfg)
    df = loan_join(m, t, ["loan_id", "as_of_date"])
    at = view.select("loan_id", F.col("as_of_date").alias("first_default_date"),
                     entry_exposure(F.col("current_actual_upb"), F.col("current_upb_lag_1")).alias("_ead"),
                     entry_exposure_source(F.col("current_actual_upb"), F.col("current_upb_lag_1")).alias("_src"))
    e = events.select("loan_id", F.col("default_entry_date").alias("first_default_date"), "default_episode_id", "default_reason")
    found = loan_join(e, at, ["loan_id", "first_default_date"], "left")
    df = loan_join(df, found, ["loan_id", "first_default_date"], "left")
    dflt = F.col("event_default")
    upb = F.col("current_actual_upb")
    return df.withColumns({
        "remaining_months_to_maturity": maturity_months(), "original_term": F.col("original_loan_term"),
        "current_ltv_band": ltv_band("estimated_loan_to_value"),
        "balance_band": F.when(upb <= 100000, "<=100k").when(upb <= 250000, "100k-250k").when(upb <= 500000, "250k-500k").otherwise(">500k"),
        "future_default_date": F.when(dflt, F.col("first_default_date")), "ead_at_default": F.when(dflt, F.col("_ead")),
        "ead_at_default_source": F.when(dflt, F.coalesce("_src", F.lit("unavailable"))),
        "months_to_default": F.when(dflt, F.col("months_to_default_from_observation")),
        "event_type": F.when(dflt, "DEFAULT").otherwise(F.col("event_type"))}).drop("_ead", "_src", "first_default_date")


def with_rating(obs: DataFrame, preds: DataFrame) -> DataFrame:
    p = preds.select("loan_id", F.col("as_of_date").alias("_pd_date"), "rating")
    return latest_on_or_before(obs, p, "loan_id", "as_of_date", "_pd_date", ["rating"])


def with_targets(obs: DataFrame, cfg: EAD) -> DataFrame:
    m = F.col("months_to_default")
    ok = (F.col("event_type") == "DEFAULT") & F.col("ead_at_default").isNotNull() & flag(F.col("current_actual_upb") > 0)
    df = obs.withColumns({"observation_year": F.year("as_of_date").cast("long"), "split": split_by("as_of_date", cfg),
                          "target_observable": ok, "months_to_horizon": m})
    df = df.withColumn("ead_ratio", F.when(F.col("target_observable"), F.col("ead_at_default") / F.col("current_actual_upb")))
    band = (F.when(m.isNull() | (m < 0), F.lit(None)).when(m <= 3, "0-3").when(m <= 6, "4-6").when(m <= 12, "7-12").when(m <= 24, "13-24")
            .when(m <= 60, "25-60").otherwise("60+"))
    return df.withColumns({"ead_ratio_model_target": clip("ead_ratio", cfg.lower, cfg.upper), "months_to_default_band": band})


def validated_predictors(predictors: Sequence[str] = NUMERIC + CATEGORICAL) -> list[str]:
    return forbid_outcomes(list(predictors), OUTCOMES)


def fit_ratio_model(obs: DataFrame):
    """Feature pipeline and linear model of the exposure ratio, fitted on observable TRAIN rows."""
    train = obs.where(F.col("target_observable") & (F.col("split") == "TRAIN"))
    pipe = ml_pipeline.fit_features(train, NUMERIC, CATEGORICAL)
    return pipe, ml_pipeline.fit_linear(pipe.transform(train), "ead_ratio_model_target")


def with_ratio(obs: DataFrame, ratio: Column, cfg: EAD) -> DataFrame:
    df = obs.withColumn("predicted_ead_ratio_empirical", clip(ratio, cfg.lower, cfg.upper))
    return df.withColumn("predicted_ead_empirical_model", clip(F.col("predicted_ead_ratio_empirical") * F.col("current_actual_upb"), 0.0))


def baselines(obs: DataFrame) -> DataFrame:
    return obs.withColumns({
        "predicted_ead_current_balance": clip("current_actual_upb", 0.0),
        "predicted_ead_contractual": contractual_balance(
            F.col("current_actual_upb"), F.col("current_interest_rate"), F.col("remaining_months_to_maturity"),
            F.coalesce("months_to_default", F.lit(0)))})


PROFILE_TERMS = ("vintage_year", "as_of_date", "current_actual_upb", "current_interest_rate", "remaining_months_to_maturity", "months_to_horizon")


def latest_open(obs: DataFrame) -> DataFrame:
    """Latest open row of each loan, with all its columns."""
    return obs.where("current_actual_upb > 0").groupBy("loan_id").agg(F.max_by(F.struct(*[c for c in obs.columns if c != "loan_id"]), "as_of_date").alias("x")).select("loan_id", "x.*")


def profile_terms(latest: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return latest.select("loan_id", *PROFILE_TERMS, *extra)


def profile_base(obs: DataFrame) -> DataFrame:
    """Latest open row of each loan, as far as the profiles need it."""
    return latest_open(obs.select("loan_id", *PROFILE_TERMS))


def profiles(base: DataFrame, ratio: Column, cfg: EAD) -> DataFrame:
    """Exposure by month 0..max under the three methods; the modelled one starts at the current balance."""
    upb = F.col("current_actual_upb")
    df = base.withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(cfg.max_months)))).withColumn("months_to_horizon", F.col("month"))
    return df.select(
        "loan_id", "vintage_year", "as_of_date", "month", clip(upb, 0.0).alias("ead_current_balance"),
        contractual_balance(upb, F.col("current_interest_rate"), F.col("remaining_months_to_maturity"), F.col("month")).alias("ead_contractual"),
        F.when(F.col("month") == 0, upb).otherwise(clip(clip(ratio, cfg.lower, cfg.upper) * upb, 0.0)).alias("ead_modelled"))


def _metrics(floor: float) -> list[Column]:
    a, p = F.col("ead_at_default"), F.col("p")
    safe = F.abs(a) >= floor
    return [F.count(F.lit(1)).alias("rows"), F.avg(a).alias("actual_mean_ead"), F.avg(p).alias("predicted_mean_ead"),
            safe_div(F.avg(a), F.avg(p)).alias("oe_ratio"), F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
            F.avg(F.when(safe, F.abs(a - p) / a)).alias("mape")]


def _long(scored: DataFrame, keep: Sequence[str]) -> DataFrame:
    return scored.where("target_observable").unpivot([*keep, "ead_at_default"], [F.col(c).alias(m) for m, c in METHODS.items()], "method", "p")


def backtest_splits(scored: DataFrame, cfg: EAD) -> DataFrame:
    return _long(scored, ["split"]).groupBy("method", "split").agg(*_metrics(cfg.mape_floor))


def backtest_segments(scored: DataFrame, cfg: EAD) -> DataFrame:
    tags = F.array(*[F.struct(F.lit(n).alias("segment"), F.col(c).cast("string").alias("segment_value")) for n, c in SEGMENTS.items()])
    long = _long(scored.withColumn("_t", tags), ["split", "_t"]).select("*", F.explode("_t").alias("k")).select(
        "method", "split", "ead_at_default", "p", "k.*").where("segment_value IS NOT NULL")
    return long.groupBy("method", "split", "segment", "segment_value").agg(*_metrics(cfg.mape_floor))


def ratio_distribution(scored: DataFrame) -> DataFrame:
    d = scored.where("target_observable").withColumn("_g", F.lit(1))
    r = F.col("ead_ratio")
    t = d.groupBy("_g").agg(F.count(F.lit(1)).alias("observable_defaults"), F.avg(r).alias("ead_ratio_mean"),
                            *[F.avg(c.cast("int")).alias(n) for n, c in (("ead_ratio_below_0_pct", r < 0), ("ead_ratio_above_1_pct", r > 1),
                                                                        ("ead_ratio_above_2_pct", r > 2))])
    q = exact_quantiles(d, ["_g"], "ead_ratio", [0.5, 0.05, 0.95])
    return t.join(q, "_g").select("*", F.col("q")[0].alias("ead_ratio_median"), F.col("q")[1].alias("ead_ratio_p05"),
                                  F.col("q")[2].alias("ead_ratio_p95")).drop("_g", "q")


def population_summary(scored: DataFrame) -> DataFrame:
    per_loan = scored.groupBy("split", "event_type", "loan_id").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("target_observable")).alias("d"), F.sum("current_actual_upb").alias("u"))
    return per_loan.groupBy("split", "event_type").agg(
        F.sum("n").alias("observations"), F.count(F.lit(1)).alias("loans"), F.sum("d").alias("observable_defaults"),
        (F.sum("u") / F.sum("n")).alias("mean_current_upb"))


def profile_validation(p: DataFrame) -> DataFrame:
    zero = F.col("month") == 0

    def same(c: str) -> Column:
        return F.avg(F.when(zero, (F.round("ead_current_balance", 6) == F.round(c, 6)).cast("int")))

    negative = (F.col("ead_current_balance") < 0) | (F.col("ead_contractual") < 0) | (F.col("ead_modelled") < 0)
    return p.agg(F.count(F.lit(1)).alias("profile_rows"), count_if(zero).alias("month_zero_rows"),
                 same("ead_contractual").alias("month_zero_current_equals_contractual"),
                 same("ead_modelled").alias("month_zero_current_equals_modelled"), count_if(negative).alias("negative_ead_rows"))


def target_reconciliation(scored: DataFrame) -> DataFrame:
    return scored.where("target_observable").groupBy("ead_at_default_source").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("ead_at_default").alias("actual_mean_ead"), F.sum("ead_at_default").alias("actual_sum_ead"))


def mean_profile(base: DataFrame, ratio: Column, cfg: EAD, by: Sequence[str] = ()) -> DataFrame:
    """Mean exposure per month over the rows of ``profile_base`` under the three methods of ``profiles``, without a row per loan and month.

    Every method is linear in the current balance: balances are added up per terms (rate and remaining months, and the columns
    ``by`` that ``ratio`` reads besides months_to_horizon), and the months are laid out for these sums alone.
    """
    terms = ["current_interest_rate", "remaining_months_to_maturity", *[c for c in by if c not in ("current_interest_rate", "remaining_months_to_maturity")]]
    sums = base.groupBy(*terms).agg(F.sum("current_actual_upb").alias("_upb"), F.count(F.lit(1)).alias("_n"))
    df = sums.withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(cfg.max_months)))).withColumn("months_to_horizon", F.col("month"))
    unit = contractual_balance(F.lit(1.0), F.col("current_interest_rate"), F.col("remaining_months_to_maturity"), F.col("month"))
    modelled = F.when(F.col("month") == 0, F.lit(1.0)).otherwise(clip(clip(ratio, cfg.lower, cfg.upper), 0.0))
    parts = {"ead_current_balance": F.lit(1.0), "ead_contractual": unit, "ead_modelled": modelled}
    return df.groupBy("month").agg(*[(F.sum(F.col("_upb") * u) / F.sum("_n")).alias(c) for c, u in parts.items()])
