"""Fixed-coefficient demo score on the panel, so that later stages do not depend on a fitted model."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom.operators import ead, lgd, macro, pd_framework, scenario, scorecard
from lossloom.operators.features import features_for

FEATURES = features_for("behavioural_scoring")
CATEGORIES = ("channel", "property_state", "occupancy_status")
# Demo coefficients.
INTERCEPT = -1.2
COEFS = {"x_delinquency": 0.9, "x_ltv": 0.02, "x_score": -0.004, "x_age": 0.01}


def frame(t) -> DataFrame:
    view = t("analytical").select("*", F.coalesce("delinquency_months", F.lit(0)).alias("x_delinquency"),
                                  (F.col("original_ltv") - 75).alias("x_ltv"),
                                  (F.col("original_credit_score") - 720).alias("x_score"),
                                  F.col("months_since_origination").alias("x_age"))
    # Nine digits: balances that are equal on paper must share a bin on every engine.
    view = view.withColumn("current_upb_to_original_upb", F.round("current_upb_to_original_upb", 9))
    return scorecard.model_frame(t("dev"), view, [*FEATURES, *CATEGORIES, *COEFS])


def scored(t) -> DataFrame:
    """Scores rounded to 9 digits, so that equal risk gives equal scores on every engine."""
    s = scorecard.score_rows(t("frame"), INTERCEPT, COEFS, t.cfg.scorecard)
    s = s.withColumn("predicted_pd_raw", F.round("predicted_pd_raw", 9))
    s = s.withColumn("score", F.round(scorecard.points(F.col("predicted_pd_raw"), t.cfg.scorecard), 6))
    return s.select("loan_id", "as_of_date", "split", "observation_year", "vintage_year", "target", "sample_weight",
                    "predicted_pd_raw", "linear_predictor", "score")


# Demo recalibration.
CAL_INTERCEPT = 0.1
CAL_SLOPE = 0.9


def calibrated(t) -> DataFrame:
    cal = pd_framework.Calibration("logistic", CAL_INTERCEPT, CAL_SLOPE)
    return cal.apply(t("scored")).withColumn(pd_framework.PD, F.round(pd_framework.PD, 9))


def predictions(t) -> DataFrame:
    edges = pd_framework.boundary_edges(t("calibrated"), t.cfg.pd)
    return t("calibrated").withColumn("rating", pd_framework.rating_of(pd_framework.PD, edges))


def lifetime(t) -> DataFrame:
    return pd_framework.lifetime_curves(pd_framework.event_foundation(t("preds"), t("targets")), t("preds"), t.cfg.pd)


# Demo macro models and asset correlation.
RHO = 0.12
FACTOR = macro.LinearModel(0.9, {"unemployment_rate": -0.03, "unemployment_rate_change": -0.05, "house_price_index_yoy": 0.02,
                                 "real_gdp_yoy": 0.02, "mortgage_rate": -0.01, "mortgage_rate_change": -0.02})
SATELLITE = macro.LinearModel(-1.0, {"unemployment_rate": 0.01, "unemployment_rate_change": 0.02, "house_price_index_yoy": -0.01,
                                     "real_gdp_yoy": -0.01, "mortgage_rate": 0.005, "mortgage_rate_change": 0.01})


def monthly_series(t) -> DataFrame:
    """Four macro-like monthly series from the order book."""
    o = t.raw("orders").where(F.col("o_orderdate").isNotNull())
    m = o.groupBy(F.trunc("o_orderdate", "MM").alias("date")).agg(
        (100 * F.avg((F.col("o_orderstatus") == "P").cast("int"))).alias("unemployment_rate"),
        F.avg("o_totalprice").alias("house_price_index"), F.count(F.lit(1)).cast("double").alias("real_gdp"),
        (100 * F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int"))).alias("mortgage_rate"))
    return m.unpivot(["date"], [c for c in m.columns if c != "date"], "series", "value")


def macro_table(t) -> DataFrame:
    cfg = macro.MacroConfig()
    return macro.aligned(macro.quarterly(monthly_series(t), cfg.series),
                         ["unemployment_rate", "house_price_index_yoy", "real_gdp_yoy", "mortgage_rate"], cfg.start)


def history(t) -> DataFrame:
    ttc = t("portfolio_ttc").select(F.col("portfolio_ttc_pd").alias("ttc_pd"))
    return macro.historical_default_rate(t("preds")).crossJoin(ttc)  # one-row right side


def macro_frame(t) -> DataFrame:
    return macro.model_frame(history(t), t("macro"), RHO, macro.MacroConfig().epsilon)


def macro_fits(t) -> DataFrame:
    return macro.with_fits(macro_frame(t), FACTOR, SATELLITE, F.col("ttc_pd"), RHO)


def scenario_pd(t, cfg: macro.MacroConfig | None = None) -> DataFrame:
    paths = macro.scenario_paths(t("macro"), cfg or macro.MacroConfig())
    return macro.scenario_pd(t("rating_ttc"), macro.scenario_factors(paths, FACTOR, SATELLITE), RHO)


def macro_what_if(t, cfg: macro.MacroConfig) -> DataFrame:
    """Weighted PD under other shocks with the same fitted models."""
    return macro.weighted_pd(scenario_pd(t, cfg))


# Demo LGD components, in SQL both engines read, and the stress window of the downturn overlay.
LGD_SQL = {
    "p_raw": "1 / (1 + exp(-(0.8e0 + 0.01e0 * (original_ltv - 75) - 0.02e0 * coalesce(months_delinquent_to_date_at_default, 0))))",
    "cure": "0.02e0 + 0.0005e0 * coalesce(estimated_loan_to_value_at_default, 70)",
    "other": "0.3e0 + 0.002e0 * (original_ltv - 50)",
}
STRESS = (date(1998, 1, 1), date(1998, 12, 1))


def lgd_scored(t) -> DataFrame:
    df = t("episodes").withColumns({
        "predicted_cure_probability_raw": F.round(F.expr(LGD_SQL["p_raw"]), 9), "predicted_cure_lgd": F.round(F.expr(LGD_SQL["cure"]), 9),
        "predicted_non_cure_lgd": F.round(F.expr(LGD_SQL["other"]), 9)})
    df = df.withColumn("predicted_cure_probability", F.round(lgd.recalibrated(F.col("predicted_cure_probability_raw"), 0.1, 0.9), 9))
    df = lgd.combine(df)
    return lgd.with_downturn(df, lgd.downturn_factors(df, "historical_stress", STRESS))


# Demo exposure ratio and the severe what-if scenario.
EAD_RATIO = "1.02e0 - 0.0005e0 * months_to_horizon"
SEVERE = scenario.Scenario(
    name="severe", unemployment=2.0, hpi=-10.0, gdp=-2.0, mortgage_rate=1.0, rho_override=0.15,
    weights={"BASE": 0.4, "DOWNSIDE": 0.5, "UPSIDE": 0.1}, relative_pd=1.5, dpd=1, hold_stage2=3, downgrade_share=0.2, late_1m_share=0.1,
    late_2m_share=0.05, default_share=0.03, lgd_method="downturn", overlay_points=5.0, ead_multiplier=1.05)


def ead_scored(t) -> DataFrame:
    o = ead.observations(t("analytical"), t("targets"), t("events"), t.cfg.ead)
    o = ead.baselines(ead.with_targets(ead.with_rating(o, t("preds")), t.cfg.ead))
    ratio = F.expr(EAD_RATIO.replace("months_to_horizon", "coalesce(months_to_horizon, 0)"))
    return ead.with_ratio(o, ratio, t.cfg.ead)


def macro_with_factor(t) -> DataFrame:
    """Macro table with the systematic factor implied by history, where there is any."""
    z = macro.with_systematic_factor(history(t), "systematic_factor", "observed_default_rate", "ttc_pd", F.lit(RHO), macro.MacroConfig().epsilon)
    return t("macro").join(z.select("date", "systematic_factor"), "date", "left")


def factor_paths(t) -> DataFrame:
    return macro.scenario_factors(macro.scenario_paths(t("macro"), macro.MacroConfig()), FACTOR, SATELLITE)
