"""Loss given default: episode resolution, economic loss, component models and their diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.config import LGD
from lossloom.functions.exprs import clip, count_if, expit, flag, logit, month_diff, safe_div, tagged_rows
from lossloom.functions.joins import latest_on_or_before, loan_join
from lossloom.functions.ranks import exact_quantiles, ranking_metrics
from lossloom.operators.features import forbid_outcomes
from lossloom.operators.targets import entry_exposure, entry_exposure_source

# Cash-flow fields, columns known at default, outcome columns and recency weightings.
RECOVERIES = ("net_sale_proceeds", "mi_recoveries", "non_mi_recoveries")
COSTS = ("total_expenses", "delinquent_accrued_interest", "bankruptcy_cramdown_costs")
MODIFICATION_COSTS = ("cumulative_modification_costs",)
RECONCILED = ("zero_balance_removal_upb", *RECOVERIES, "total_expenses", "delinquent_accrued_interest")
OUTCOMES = frozenset({
    *RECOVERIES, *COSTS, *MODIFICATION_COSTS, "actual_loss", "zero_balance_removal_upb", "resolution_type", "resolution_date",
    "months_to_resolution", "resolved_flag", "cured_flag", "realized_lgd_raw", "realized_lgd_model_target", "economic_loss",
    "reconstructed_actual_loss", "discounted_recoveries", "discounted_costs"})
TARGET = "realized_lgd_model_target"
AT_DEFAULT = ("current_interest_rate", "estimated_loan_to_value", "current_upb_to_original_upb", "delinquency_months",
              "max_delinquency_months_to_date", "months_delinquent_to_date", "months_since_last_delinquency",
              "months_since_origination", "ever_modified_to_date", "ever_assistance_to_date")
STATIC = ("original_credit_score", "original_dti", "original_ltv", "original_cltv", "original_upb", "original_interest_rate",
          "mortgage_insurance_percentage", "property_state", "property_type", "occupancy_status", "loan_purpose", "channel")
# Predictors of the component models.
NUMERIC = (
    "ead_at_default", "current_interest_rate_at_default", "estimated_loan_to_value_at_default", "current_upb_to_original_upb_at_default",
    "delinquency_months_at_default", "max_delinquency_months_to_date_at_default", "months_delinquent_to_date_at_default",
    "months_since_last_delinquency_at_default", "months_since_origination_at_default", "original_credit_score", "original_dti", "original_ltv",
    "original_cltv", "original_upb", "original_interest_rate", "mortgage_insurance_percentage")
CATEGORICAL = (
    "rating_at_default", "default_reason", "property_state", "property_type", "occupancy_status", "loan_purpose", "channel",
    "ever_modified_to_date_at_default", "ever_assistance_to_date_at_default")
CURE_LGD_NUMERIC = (
    "estimated_loan_to_value_at_default", "original_ltv", "original_cltv", "ead_at_default",
    "months_since_origination_at_default", "current_interest_rate_at_default", "original_interest_rate",
    "delinquency_months_at_default", "max_delinquency_months_to_date_at_default", "months_delinquent_to_date_at_default",
    "months_since_last_delinquency_at_default", "current_upb_to_original_upb_at_default")
CURE_LGD_CATEGORICAL = ("rating_at_default", "default_reason", "ever_modified_to_date_at_default",
                        "ever_assistance_to_date_at_default")
TERMINAL = ("zero_balance_code", "zero_balance_removal_upb", *RECOVERIES, "total_expenses", "legal_costs",
            "maintenance_and_preservation_costs", "taxes_and_insurance", "miscellaneous_expenses", "actual_loss",
            "cumulative_modification_costs", "current_period_modification_costs", "bankruptcy_cramdown_costs",
            "delinquent_accrued_interest")
# Resolution labels of zero-balance codes.
RESOLUTIONS = {"09": "REO_FORECLOSURE", "03": "SHORT_SALE_OR_CHARGE_OFF", "02": "THIRD_PARTY_SALE"}
OTHER_TERMINAL = ("01", "15", "16", "96")
WEIGHTINGS = (("none", None), ("linear_recency", None), ("exponential_recency", 12), ("exponential_recency", 24),
              ("exponential_recency", 36))
KEY = ("loan_id", "default_episode_id")


def episode_base(events: DataFrame, month: DataFrame, static: DataFrame) -> DataFrame:
    """One row per episode with what was known in the entry month."""
    m = month.select("loan_id", F.col("as_of_date").alias("default_date"),
                     entry_exposure(F.col("current_actual_upb"), F.col("current_upb_lag_1")).alias("ead_at_default"),
                     entry_exposure_source(F.col("current_actual_upb"), F.col("current_upb_lag_1")).alias("ead_at_default_source"),
                     *[F.col(c).alias(f"{c}_at_default") for c in AT_DEFAULT])
    e = events.select("loan_id", "vintage_year", "default_episode_id", F.col("default_entry_date").alias("default_date"),
                      "cure_date", "default_reason", "default_due_to_delinquency", "default_due_to_credit_event", "redefault_flag")
    out = loan_join(e, m, ["loan_id", "default_date"], "left")
    out = loan_join(out, static.select("loan_id", "vintage_year", *STATIC), ["loan_id", "vintage_year"], "left")
    return out.withColumn("ead_at_default_source", F.coalesce("ead_at_default_source", F.lit("unavailable")))


def first_terminal(base: DataFrame, month: DataFrame, cfg: LGD) -> DataFrame:
    """First closing row inside the resolution horizon of each episode.

    Only closing rows take part in the range join, at most one or two per loan.
    """
    closing = month.where(F.nullif(F.col("zero_balance_code"), F.lit("")).isNotNull()).select(
        "loan_id", F.col("as_of_date").alias("terminal_date"), *[c for c in TERMINAL if c != "net_sale_proceeds"],
        F.nullif(F.col("net_sale_proceeds"), F.lit("U")).try_cast("double").alias("net_sale_proceeds"))
    pairs = loan_join(base.select(*KEY, "default_date"), closing, ["loan_id"]).where(
        (F.col("terminal_date") >= F.col("default_date"))
        & (F.col("terminal_date") <= F.add_months("default_date", cfg.horizon_months)))
    first = pairs.groupBy(*KEY).agg(F.min_by(F.struct("terminal_date", *TERMINAL), "terminal_date").alias("t"))
    return first.select(*KEY, "t.*")


def rating_at_default(base: DataFrame, preds: DataFrame) -> DataFrame:
    return latest_on_or_before(base, preds.select("loan_id", F.col("as_of_date").alias("pd_date"), F.col("rating").alias("rating_at_default")),
                               "loan_id", "default_date", "pd_date", ["rating_at_default"])


def ltv_band(ltv: str) -> Column:
    v = F.col(ltv)
    return (F.when(v.isNull(), "UNKNOWN").when(v <= 60, "<=60").when(v <= 80, "60-80").when(v <= 100, "80-100").otherwise(">100"))


def resolve(rated: DataFrame, terminal: DataFrame) -> DataFrame:
    df = loan_join(rated, terminal, KEY, "left")
    cure = F.col("cure_date").isNotNull() & (F.col("terminal_date").isNull() | (F.col("cure_date") <= F.col("terminal_date")))
    kind = F.when(cure, "CURE")
    for code, label in RESOLUTIONS.items():
        kind = kind.when(F.col("zero_balance_code") == code, label)
    kind = kind.when(F.col("zero_balance_code").isin(*OTHER_TERMINAL), "OTHER_DOCUMENTED_TERMINAL").otherwise("UNRESOLVED")
    df = df.withColumns({"resolution_date": F.when(cure, F.col("cure_date")).otherwise(F.col("terminal_date")),
                         "resolution_type": kind})
    resolved = F.col("resolution_type") != "UNRESOLVED"
    return df.withColumns({
        "resolved_flag": resolved, "cured_flag": F.col("resolution_type") == "CURE",
        "months_to_resolution": F.when(resolved, month_diff("default_date", "resolution_date")),
        "current_ltv_band": ltv_band("estimated_loan_to_value_at_default")})


def _total(cols: Sequence[str], absolute: bool = False) -> Column:
    expr = F.lit(0.0)
    for c in cols:
        v = F.coalesce(F.col(c), F.lit(0.0))
        expr = expr + (F.abs(v) if absolute else v)
    return expr


def economic_loss(df: DataFrame, cfg: LGD) -> DataFrame:
    """Discounted loss over exposure. Recoveries carry a negative sign in the source, so they are added."""
    rate = F.col("current_interest_rate_at_default")
    if cfg.fallback_rate is not None:
        rate = F.coalesce(rate, F.lit(cfg.fallback_rate))
    rate = F.coalesce(rate, F.col("original_interest_rate"), F.lit(0.0)) / 100 / 12
    months = F.greatest(F.coalesce("months_to_resolution", F.lit(0)), F.lit(0))
    closed = flag(F.col("zero_balance_removal_upb") > 0) & F.col("resolved_flag")
    df = df.withColumns({
        "discount_factor_to_resolution": F.pow(1 + rate, -months),
        "signed_recoveries": _total(RECOVERIES), "_costs": _total(COSTS), "_mod": _total(MODIFICATION_COSTS),
        "_observed": _total(RECOVERIES + COSTS + MODIFICATION_COSTS, absolute=True),
        "reconstructed_actual_loss": _total(RECONCILED),
        "lgd_exposure_basis": F.when(closed, F.col("zero_balance_removal_upb")).otherwise(F.col("ead_at_default")),
        "lgd_exposure_basis_source": F.when(closed, "zero_balance_removal_upb").otherwise(F.col("ead_at_default_source"))})
    d = F.col("discount_factor_to_resolution")
    df = df.withColumns({
        "discounted_recoveries": F.col("signed_recoveries") * d, "discounted_costs": F.col("_costs") * d,
        "model_costs": F.col("_costs") + F.col("_mod"), "discounted_model_costs": (F.col("_costs") + F.col("_mod")) * d,
        "cure_lgd_fallback_used": F.col("cured_flag") & (F.col("_observed") == 0) & F.col("actual_loss").isNull()})
    loss = F.coalesce("lgd_exposure_basis", F.lit(0.0)) + F.col("discounted_recoveries") + F.col("discounted_model_costs")
    df = df.withColumn("economic_loss", F.when(F.col("cure_lgd_fallback_used"), F.col("ead_at_default") * cfg.cure_fallback_lgd)
                       .otherwise(loss))
    raw = F.when(F.col("resolved_flag") & (F.col("lgd_exposure_basis") > 0), F.col("economic_loss") / F.col("lgd_exposure_basis"))
    df = df.withColumn("realized_lgd_raw", raw)
    return df.withColumn(TARGET, clip("realized_lgd_raw", cfg.lower, cfg.upper)).drop("_costs", "_mod", "_observed")


def split_by(on: str, cfg) -> Column:
    d = F.col(on)
    return (F.when(d <= F.lit(cfg.train_end), "TRAIN").when(d <= F.lit(cfg.validation_end), "VALIDATION")
            .when(d <= F.lit(cfg.oot_end), "OOT").otherwise("OUT_OF_TIME"))


def episodes(events: DataFrame, month: DataFrame, static: DataFrame, preds: DataFrame, cfg: LGD) -> DataFrame:
    """Resolved episodes with loss targets and temporal splits."""
    base = episode_base(events, month, static)
    df = economic_loss(resolve(rating_at_default(base, preds), first_terminal(base, month, cfg)), cfg)
    return df.withColumns({"default_year": F.year("default_date").cast("long"), "split": split_by("default_date", cfg)})


def validated_predictors(predictors: Sequence[str] = NUMERIC + CATEGORICAL) -> list[str]:
    return forbid_outcomes(list(predictors), OUTCOMES)


def supervised(eps: DataFrame) -> DataFrame:
    return eps.where(F.col("resolved_flag") & (F.col("ead_at_default") > 0))


def _recency(method: str, decay_months: int | None) -> Column:
    """Weight before scaling of a row with its age in days to the newest (``_d1``) and oldest (``_d0``) default."""
    age = F.date_diff("_d1", "default_date") / F.lit(30.4375)
    if method == "none":
        return F.lit(1.0)
    if method == "linear_recency":
        return 1 + (1 - age / F.greatest(F.date_diff("_d1", "_d0") / F.lit(30.4375), F.lit(1.0)))
    if method == "exponential_recency":
        return F.exp(-age / F.lit(float(decay_months or 24)))
    raise ValueError(f"unknown temporal weighting: {method}")


def with_temporal_weights(train: DataFrame, weightings: Sequence[tuple[str, int | None]]) -> DataFrame:
    """Recency weights with mean 1, one column ``w_<label>`` per weighting; two one-row aggregates serve all of them."""
    labels = [f"w_{weight_label(m, d)}" for m, d in weightings]
    newest = train.agg(F.max("default_date").alias("_d1"), F.min("default_date").alias("_d0"))
    df = train.crossJoin(newest).withColumns({c: _recency(m, d) for c, (m, d) in zip(labels, weightings, strict=True)})  # one-row right side
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in labels])
    return df.crossJoin(means).withColumns({c: F.col(c) / F.col(f"_m_{c}") for c in labels}).drop("_d0", "_d1", *[f"_m_{c}" for c in labels])


def with_temporal_weight(train: DataFrame, method: str, decay_months: int | None, out: str = "w") -> DataFrame:
    """One weighting under a name of choice."""
    return with_temporal_weights(train, [(method, decay_months)]).withColumnRenamed(f"w_{weight_label(method, decay_months)}", out)


def weight_label(method: str, decay: int | None) -> str:
    return f"{method}_{decay}m" if method == "exponential_recency" else method


def bounded_logit(x: Column | str) -> Column:
    return logit(clip(x, 1e-4, 1 - 1e-4))


def mean_ratio(actual: Column, predicted: Column) -> Column:
    """Ratio of means; 1 when either is missing or the prediction is 0."""
    return F.coalesce(safe_div(F.avg(actual), F.avg(predicted)), F.lit(1.0))


def segment_factors(eps: DataFrame, prediction: str, minimum: int = 50, pull: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """Validation ratio per rating shrunk to the overall ratio, for ratings with enough rows; plus the overall row (null).

    ``keys`` gives separate calibrators, for instance one per candidate model.
    """
    v = eps.where((F.col("split") == "VALIDATION") & F.col("resolved_flag") & ~F.col("cured_flag"))
    ratio = mean_ratio(F.col(TARGET), F.col(prediction))
    whole = v.groupBy(*keys).agg(ratio.alias("global_factor"))
    seg = v.where(F.col("rating_at_default").isNotNull()).groupBy(*keys, "rating_at_default").agg(
        F.count(F.lit(1)).alias("rows"), ratio.alias("segment_factor")).where(F.col("rows") >= minimum)
    share = F.col("rows") / (F.col("rows") + pull)
    seg = (seg.join(whole, list(keys)) if keys else seg.crossJoin(whole)).withColumn(
        "factor", share * F.col("segment_factor") + (1 - share) * F.col("global_factor"))
    return seg.select(*keys, "rating_at_default", "factor").unionByName(
        whole.select(*keys, F.lit(None).cast("string").alias("rating_at_default"), F.col("global_factor").alias("factor")))


def apply_segment_factors(eps: DataFrame, factors: DataFrame, prediction: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Scale predictions by their rating's factor, else by the overall one (1 when there was no validation row)."""
    seg = F.broadcast(factors.where("rating_at_default IS NOT NULL").withColumnRenamed("factor", "_f"))  # one row per grade and key
    whole = factors.where("rating_at_default IS NULL").select(*keys, F.col("factor").alias("_g"))
    df = eps.join(seg, [*keys, "rating_at_default"], "left")
    df = df.join(F.broadcast(whole), list(keys), "left") if keys else df.crossJoin(whole)  # one row per key
    return df.withColumn(out, clip(F.col(prediction) * F.coalesce("_f", "_g", F.lit(1.0)), 0.0, 1.0)).drop("_f", "_g")


def combine(eps: DataFrame, cure_p: str = "predicted_cure_probability", cure_lgd: str = "predicted_cure_lgd",
            other_lgd: str = "predicted_non_cure_lgd") -> DataFrame:
    """Expected LGD of the two branches, scaled to the validation mean and clipped."""
    p = F.col(cure_p)
    df = eps.withColumn("predicted_lgd_uncalibrated", p * F.col(cure_lgd) + (1 - p) * F.col(other_lgd))
    factor = df.where((F.col("split") == "VALIDATION") & F.col("resolved_flag")).agg(
        mean_ratio(F.col(TARGET), F.col("predicted_lgd_uncalibrated")).alias("expected_lgd_calibration_factor"))
    df = df.crossJoin(factor)  # one-row right side
    return df.withColumn("predicted_lgd", clip(F.col("predicted_lgd_uncalibrated") * F.col("expected_lgd_calibration_factor"), 0.0, 1.0))


def accuracy(actual: Column, predicted: Column) -> list[Column]:
    e = actual - predicted
    return [safe_div(F.avg(actual), F.avg(predicted)).alias("oe_ratio"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")]


def compare(df: DataFrame, prediction: str, where: Column, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy per candidate and split of long predictions, one aggregate for all candidates."""
    y, p = F.col(TARGET), F.col(prediction)
    return df.where(where).groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(y).alias("realized_mean"), F.avg(p).alias("predicted_mean"), *accuracy(y, p))


def compare_cure(df: DataFrame, probability: str, keys: Sequence[str] = ("model",)) -> DataFrame:
    r = df.where("resolved_flag").withColumns({"_y": F.col("cured_flag").cast("int"), "_one": F.lit(1.0)})
    y, p = F.col("_y"), F.col(probability)
    g = [*keys, "split"]
    t = r.groupBy(*g).agg(F.count(F.lit(1)).alias("rows"), F.avg((p - y) * (p - y)).alias("brier"),
                          F.avg(y).alias("observed_cure_rate"), F.avg(p).alias("predicted_cure_rate"))
    auc = ranking_metrics(r, g, probability, "_y", "_one").select(*g, F.col("roc_auc").alias("auc"))
    return t.join(auc, g).withColumn("calibration_error", F.col("predicted_cure_rate") - F.col("observed_cure_rate"))


def combined_ranking(df: DataFrame, cures: dict[str, str], severities: dict[str, str], cure_lgd: str = "predicted_cure_lgd",
                     preferred: tuple[str, str] | None = None, digits: int | None = None) -> DataFrame:
    """All pairs of cure and severity candidates ranked on validation rows, in two aggregates for the whole grid.

    ``preferred`` names one pair to use instead of the grid when both exist; ``digits`` rounds the criteria, so that
    summation noise cannot order equal candidates.
    """
    pairs = [(a, b) for a in cures for b in severities]
    if preferred and preferred in pairs:
        pairs = [preferred]
    v = df.where((F.col("split") == "VALIDATION") & F.col("resolved_flag"))
    y = F.col(TARGET)

    def raw(a: str, b: str) -> Column:
        return F.col(cures[a]) * F.col(cure_lgd) + (1 - F.col(cures[a])) * F.col(severities[b])

    scale = v.agg(*[mean_ratio(y, raw(a, b)).alias(f"f{i}") for i, (a, b) in enumerate(pairs)])
    v = v.crossJoin(scale)  # one-row right side
    aggs = []
    for i, (a, b) in enumerate(pairs):
        p = clip(raw(a, b) * F.col(f"f{i}"), 0.0, 1.0)
        other = F.when(~F.col("cured_flag"), F.lit(1))
        aggs.append(F.struct(
            F.lit(a).alias("cure_model"), F.lit(b).alias("severity_model"),
            F.first(f"f{i}").alias("expected_lgd_calibration_factor"),
            F.abs(safe_div(F.avg(y), F.avg(p)) - 1).alias("validation_abs_oe_error"),
            F.abs(F.avg(F.col(cures[a])) - F.avg(F.col("cured_flag").cast("int"))).alias("validation_cure_abs_calibration_error"),
            F.abs(mean_ratio(other * y, other * F.col(severities[b])) - 1).alias("validation_non_cure_abs_oe_error"),
            F.avg(F.abs(y - p)).alias("validation_mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("validation_rmse")).alias(f"c{i}"))
    one = v.agg(*aggs)
    rows = one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(pairs))])).alias("c")).select("c.*")
    if digits is not None:
        rows = rows.withColumns({f.name: F.round(f.name, digits) for f in rows.schema if f.dataType.typeName() == "double"})
    order = Window.partitionBy(F.lit(0)).orderBy(  # one row per candidate pair
        "validation_abs_oe_error", "validation_cure_abs_calibration_error", "validation_non_cure_abs_oe_error",
        "validation_mae", "validation_rmse", "cure_model", "severity_model")
    return rows.withColumn("selection_rank", F.row_number().over(order).cast("long"))


def downturn_factors(eps: DataFrame, method: str, stress: tuple[date, date], quantile: float = 0.75) -> DataFrame:
    """Overlay per rating: stressed over average realised LGD, at least 1."""
    r = eps.where(F.col("resolved_flag") & F.col("rating_at_default").isNotNull())
    if method == "none":
        return eps.select("rating_at_default").where("rating_at_default IS NOT NULL").distinct().withColumn(
            "downturn_overlay_factor", F.lit(1.0))
    if method == "historical_stress":
        inside = F.col("default_date").between(F.lit(stress[0]), F.lit(stress[1]))
        t = r.groupBy("rating_at_default").agg(F.avg(TARGET).alias("base"), F.avg(F.when(inside, F.col(TARGET))).alias("high"))
    elif method == "quantile":
        q = exact_quantiles(r, ["rating_at_default"], TARGET, [quantile])
        t = r.groupBy("rating_at_default").agg(F.avg(TARGET).alias("base")).join(q, "rating_at_default", "left").withColumn(
            "high", F.col("q")[0])
    else:
        raise ValueError(f"unknown downturn method: {method}")
    return t.select("rating_at_default", F.greatest(F.lit(1.0), F.coalesce(safe_div("high", "base"), F.lit(1.0))).alias("downturn_overlay_factor"))


def with_downturn(scored: DataFrame, factors: DataFrame) -> DataFrame:
    df = scored.join(F.broadcast(factors), "rating_at_default", "left")  # one row per grade
    return df.withColumn("downturn_overlay_factor", F.coalesce("downturn_overlay_factor", F.lit(1.0))).withColumns({
        "lgd_base": F.col("predicted_lgd"),
        "lgd_downturn": clip(F.col("predicted_lgd") * F.col("downturn_overlay_factor"), 0.0, 1.0)})


def model_metrics(scored: DataFrame) -> DataFrame:
    """Expected LGD, cure, cure severity and other severity per split, all from one grouped pass plus the cure AUC."""
    r = scored.where("resolved_flag")
    y = F.col(TARGET)
    parts = {"expected_lgd": ("all_resolved", F.lit(True), "predicted_lgd"),
             "cure_lgd": ("cured_resolved", F.col("cured_flag"), "predicted_cure_lgd"),
             "non_cure_severity": ("non_cure_resolved", ~F.col("cured_flag"), "predicted_non_cure_lgd")}
    aggs = []
    for m, (_, cond, pred) in parts.items():
        p, k = F.col(pred), F.when(cond, F.lit(1))
        aggs += [F.count(k).alias(f"{m}_n"), F.avg(k * F.abs(y - p)).alias(f"{m}_mae"),
                 F.sqrt(F.avg(k * (y - p) * (y - p))).alias(f"{m}_rmse"), F.avg(k * y).alias(f"{m}_y"), F.avg(k * p).alias(f"{m}_p")]
    t = r.groupBy("split").agg(*aggs, F.avg(F.col("cured_flag").cast("int")).alias("oc"),
                               F.avg("predicted_cure_probability").alias("pc"))
    b = r.withColumns({"_y": F.col("cured_flag").cast("int"), "_one": F.lit(1.0)})
    t = t.join(ranking_metrics(b, ["split"], "predicted_cure_probability", "_y", "_one").select("split", "roc_auc"), "split")
    none = F.lit(None).cast("double")
    rows = [[F.lit(m), F.lit(pop), F.col(f"{m}_n"), F.col(f"{m}_mae"), F.col(f"{m}_rmse"), F.col(f"{m}_y"), F.col(f"{m}_p"), none]
            for m, (pop, _, _) in parts.items()]
    rows.append([F.lit("cure"), F.lit("all_resolved"), F.when((F.col("oc") > 0) & (F.col("oc") < 1), F.col("expected_lgd_n")).otherwise(0),
                 none, none, F.col("oc"), F.col("pc"), F.col("roc_auc")])
    return tagged_rows(t, ["split"], rows, ["model", "population", "rows", "mae", "rmse", "realized_mean", "predicted_mean",
                                           "roc_auc"]).where("rows > 0")


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias(out))


def backtest_splits(scored: DataFrame) -> DataFrame:
    k = F.when(F.col("resolved_flag"), F.lit(1))
    y, p = k * F.col(TARGET), k * F.col("predicted_lgd")
    t = scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("default_episodes"), F.count(k).alias("resolved_defaults"),
        count_if(~F.col("resolved_flag")).alias("unresolved_defaults"), F.avg(k * F.col("cured_flag").cast("int")).alias("cure_rate"),
        F.avg(y).alias("realized_mean_lgd"), F.avg(p).alias("predicted_lgd"), *accuracy(y, p))
    return t.join(medians(scored.where("resolved_flag"), ["split"], TARGET, "realized_median_lgd"), "split", "left")


def decomposition(scored: DataFrame) -> DataFrame:
    y, cured = F.col(TARGET), F.col("cured_flag")
    branch = F.col("predicted_cure_probability") * F.col("predicted_cure_lgd") + (
        1 - F.col("predicted_cure_probability")) * F.col("predicted_non_cure_lgd")
    t = scored.where("resolved_flag").groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(cured.cast("int")).alias("observed_p_cure"),
        F.avg(F.when(cured, y)).alias("observed_lgd_cure"), F.avg((~cured).cast("int")).alias("observed_p_non_cure"),
        F.avg(F.when(~cured, y)).alias("observed_lgd_non_cure"), F.avg(y).alias("observed_combined_lgd"),
        F.avg("predicted_cure_probability").alias("predicted_p_cure"), F.avg("predicted_cure_lgd").alias("predicted_lgd_cure"),
        (1 - F.avg("predicted_cure_probability")).alias("predicted_p_non_cure"),
        F.avg("predicted_non_cure_lgd").alias("predicted_lgd_non_cure"), F.avg(branch).alias("predicted_branch_elgd"),
        F.avg("expected_lgd_calibration_factor").alias("expected_lgd_calibration_factor"),
        F.avg("predicted_lgd").alias("predicted_combined_lgd"))
    t = t.withColumn("calibrated_branch_elgd", F.col("predicted_branch_elgd") * F.col("expected_lgd_calibration_factor"))
    return t.withColumn("branch_reconciliation_difference", F.col("calibrated_branch_elgd") - F.col("predicted_combined_lgd"))


def _drift_psi(cells: DataFrame) -> DataFrame:
    """PSI of each split against TRAIN from (feature, split, bucket, n) counts, over the buckets of either side."""
    total = F.sum("n").over(Window.partitionBy("feature", "split"))  # buckets or categories of one feature
    s = cells.withColumn("s", F.col("n") / total)
    train = s.where("split = 'TRAIN'").select("feature", "bucket", F.col("s").alias("e"))
    splits = cells.select("feature", "split").distinct()
    grid = s.select("feature", "bucket").distinct().join(splits, "feature")
    t = grid.join(s.select("feature", "split", "bucket", "s"), ["feature", "split", "bucket"], "left").join(
        train, ["feature", "bucket"], "left")
    a, e = F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(1e-6)), F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(1e-6))
    return t.groupBy("feature", "split").agg(F.sum((a - e) * F.ln(a / e)).alias("psi_vs_train"))


def numeric_drift(eps: DataFrame, features: Sequence[str]) -> DataFrame:
    """Stability, missing rate and quartiles of numeric predictors per split against TRAIN quantile bins."""
    long = eps.unpivot(["split"], [F.col(f).cast("double").alias(f) for f in features], "feature", "value")
    counts = long.groupBy("feature", "split", "value").agg(F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(long.where("split = 'TRAIN'"), ["feature"], "value", [i / 10 for i in range(11)])
    e = F.array_distinct("q")
    inner = F.when(F.size(e) > 1, F.slice(e, F.lit(2), F.size(e) - 2)).otherwise(e)
    edges = q.select("feature", inner.alias("e"))
    bucket = F.when(F.col("value").isNull(), -1).otherwise(F.size(F.filter("e", lambda x: x < F.col("value"))))
    cells = counts.join(edges, "feature", "left").withColumn("e", F.coalesce("e", F.array().cast("array<double>"))).groupBy(
        "feature", "split", bucket.cast("string").alias("bucket")).agg(F.sum("n").alias("n"))
    stats = counts.groupBy("feature", "split").agg(
        safe_div(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)), F.sum("n")).alias("missing_rate"),
        safe_div(F.sum(F.col("value") * F.col("n")), F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean"))
    quart = exact_quantiles(long, ["feature", "split"], "value", [0.25, 0.5, 0.75])
    train = stats.where("split = 'TRAIN'").select("feature", F.col("missing_rate").alias("train_missing_rate"), F.col("mean").alias("train_mean"))
    t = _drift_psi(cells).join(stats, ["feature", "split"]).join(quart, ["feature", "split"], "left").join(train, "feature", "left")
    return t.select("feature", F.lit("numeric").alias("feature_type"), "split", "psi_vs_train", "missing_rate", "train_missing_rate",
                    "mean", "train_mean", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"),
                    (F.col("psi_vs_train") >= 0.25).alias("unstable_flag"))


def categorical_drift(eps: DataFrame, features: Sequence[str], feature_type: str = "predictor") -> DataFrame:
    long = eps.unpivot(["split"], [F.coalesce(F.col(f).cast("string"), F.lit("__MISSING__")).alias(f) for f in features],
                       "feature", "bucket")
    cells = long.groupBy("feature", "split", "bucket").agg(F.count(F.lit(1)).alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("k"), "bucket"))
    stats = cells.groupBy("feature", "split").agg(
        (F.sum(F.when(F.col("bucket") == "__MISSING__", F.col("n")).otherwise(0)) / F.sum("n")).alias("missing_rate"),
        top["bucket"].alias("top_category"), (-top["k"] / F.sum("n")).alias("top_category_share"))
    train = stats.where("split = 'TRAIN'").select("feature", F.col("missing_rate").alias("train_missing_rate"))
    t = _drift_psi(cells).join(stats, ["feature", "split"]).join(train, "feature", "left")
    return t.select("feature", F.lit(feature_type).alias("feature_type"), "split", "psi_vs_train", "missing_rate",
                    "train_missing_rate", "top_category", "top_category_share", (F.col("psi_vs_train") >= 0.25).alias("unstable_flag"))


def observed_predicted(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = scored.where("resolved_flag").dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("resolved_defaults"), F.avg(TARGET).alias("realized_lgd"), F.avg("predicted_lgd").alias("predicted_lgd"))
    return t.withColumn("oe_ratio", safe_div("realized_lgd", "predicted_lgd"))


def recovery_timing(eps: DataFrame) -> DataFrame:
    """Months are bounded integers, so the median is a plain percentile."""
    m = F.col("months_to_resolution")
    return eps.where("resolved_flag").groupBy("split", "resolution_type").agg(
        F.count(m).alias("count"), F.avg(m).alias("mean"), F.median(m).alias("median"), F.min(m).alias("min"), F.max(m).alias("max"))


def resolution_distribution(eps: DataFrame) -> DataFrame:
    return eps.groupBy("resolution_type").agg(F.count(F.lit(1)).alias("default_episodes"), F.avg(TARGET).alias("realized_lgd"))


def range_diagnostics(eps: DataFrame) -> DataFrame:
    r = eps.where("resolved_flag").withColumn("_g", F.lit(1))
    v = F.col("realized_lgd_raw")
    t = r.groupBy("_g").agg(
        F.count(F.lit(1)).alias("resolved_defaults"), F.avg(v).alias("raw_lgd_mean"),
        F.avg(flag(v < 0).cast("int")).alias("raw_lgd_below_0_pct"), F.avg(flag(v > 1).cast("int")).alias("raw_lgd_above_1_pct"),
        F.sum(F.when(v < 0, v).otherwise(0.0)).alias("raw_lgd_below_0_amount"),
        F.sum(F.when(v > 1, v).otherwise(0.0)).alias("raw_lgd_above_1_amount"))
    return t.join(medians(r, ["_g"], "realized_lgd_raw", "raw_lgd_median"), "_g", "left").drop("_g")


def actual_loss_reconciliation(eps: DataFrame) -> DataFrame:
    a, r, e = F.col("actual_loss"), F.col("reconstructed_actual_loss"), F.col("economic_loss")
    return eps.where(a.isNotNull() & F.col("resolved_flag")).agg(
        F.count(F.lit(1)).alias("rows_with_actual_loss"), F.sum(a).alias("actual_loss_sum"), F.sum(r).alias("reconstructed_actual_loss_sum"),
        F.sum(r - a).alias("reconstructed_difference_sum"), F.avg(r - a).alias("reconstructed_difference_mean"),
        F.corr(r, a).alias("reconstructed_correlation"), F.sum(e).alias("economic_loss_sum"),
        F.sum(e - a).alias("economic_difference_sum"), F.avg(e - a).alias("economic_difference_mean"),
        F.corr(e, a).alias("economic_correlation"))


# Cash-flow component, kind and treatment.
# The audited components and their types. How each enters the target is told in our own words.
COMPONENTS = {
    "zero_balance_removal_upb": ("TERMINAL_VALUE", "balance that the realised loss is measured against"),
    "ead_at_default": ("POINT_IN_TIME", "stands in where no terminal balance is known"),
    "net_sale_proceeds": ("TERMINAL_VALUE", "lowers the loss, sign as delivered"),
    "mi_recoveries": ("TERMINAL_VALUE", "lowers the loss, sign as delivered"),
    "non_mi_recoveries": ("TERMINAL_VALUE", "lowers the loss, sign as delivered"),
    "total_expenses": ("TERMINAL_VALUE", "raises the loss"),
    "delinquent_accrued_interest": ("TERMINAL_VALUE", "unpaid interest at the exit"),
    "bankruptcy_cramdown_costs": ("TERMINAL_VALUE", "raises the economic loss only"),
    "cumulative_modification_costs": ("CUMULATIVE", "last running total, never summed over months"),
    "actual_loss": ("VALIDATION_ONLY", "compared with the result, not an input of it"),
}


def component_audit(eps: DataFrame) -> DataFrame:
    aggs = []
    for c in COMPONENTS:
        v = F.col(c)
        aggs += [F.count(v).alias(f"{c}_n"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{c}_s"), count_if(v < 0).alias(f"{c}_neg"),
                 count_if(v > 0).alias(f"{c}_pos")]
    used = {*RECONCILED, "bankruptcy_cramdown_costs", *MODIFICATION_COSTS}
    rows = [[F.lit(c), F.lit(kind), F.lit(how), F.col(f"{c}_n"), F.col(f"{c}_s"), F.col(f"{c}_neg"), F.col(f"{c}_pos"),
             F.lit(c in RECONCILED), F.lit(c in used)] for c, (kind, how) in COMPONENTS.items()]
    return tagged_rows(eps.agg(*aggs), [], rows, ["component", "component_type", "treatment", "non_null_rows", "sum", "negative_rows",
                                                  "positive_rows", "used_in_loss_reconciliation", "used_in_economic_lgd"])


def cashflow_summary(eps: DataFrame) -> DataFrame:
    cols = (*RECOVERIES, *COSTS, "actual_loss")
    aggs = [x for c in cols for x in (F.count(c).alias(f"{c}_n"), F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_s"), F.avg(c).alias(f"{c}_m"))]
    return tagged_rows(eps.agg(*aggs), [], [[F.lit(c), F.col(f"{c}_n"), F.col(f"{c}_s"), F.col(f"{c}_m")] for c in cols],
                       ["component", "non_null_rows", "sum", "mean_non_null"])


def distribution(eps: DataFrame) -> DataFrame:
    """Raw LGD by resolution, default year and cure flag, stacked: each row is tagged once per dimension."""
    r = eps.where("resolved_flag")
    tags = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in (
        ("resolution_type", "resolution_type"), ("default_year", "default_year"), ("cure_non_cure", "cured_flag"))])
    t = r.select(F.explode(tags).alias("k"), "realized_lgd_raw", TARGET).select("k.*", "realized_lgd_raw", TARGET)
    v = F.col("realized_lgd_raw")
    s = t.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(v).alias("raw_lgd_mean"), F.avg(TARGET).alias("model_target_mean"),
        F.avg(flag(v < 0).cast("int")).alias("raw_lgd_below_0_pct"), F.avg(flag(v > 1).cast("int")).alias("raw_lgd_above_1_pct"))
    return s.join(medians(t, ["dimension", "value"], "realized_lgd_raw", "raw_lgd_median"), ["dimension", "value"], "left")


def segmentation(scored: DataFrame, variables: Sequence[str], minimum: int = 50) -> DataFrame:
    long = scored.where("resolved_flag").unpivot([TARGET, "predicted_lgd"], [F.col(v).cast("string").alias(v) for v in variables],
                                                 "segment_variable", "segment_value").where("segment_value IS NOT NULL")
    t = long.groupBy("segment_variable", "segment_value").agg(
        F.count(F.lit(1)).alias("resolved_defaults"), F.avg(TARGET).alias("realized_lgd"), F.avg("predicted_lgd").alias("predicted_lgd"))
    return t.withColumn("accepted_segment", F.col("resolved_defaults") >= minimum)


def cure_ltv_audit(scored: DataFrame) -> DataFrame:
    """Cure LGD against loan-to-value: missingness per split, band table and overall correlation."""
    v = F.col("estimated_loan_to_value_at_default")
    band = (F.when(v.isNull(), "MISSING").when(v <= 60, "<=60").when(v <= 80, "60-80").when(v <= 100, "80-100")
            .when(v <= 120, "100-120").otherwise(">120"))
    cure = scored.where(F.col("resolved_flag") & F.col("cured_flag")).select(
        "split", v.alias("ltv"), band.alias("band"), F.col(TARGET).alias("y"), F.col("predicted_cure_lgd").alias("p"))
    stats = [F.count(F.lit(1)).alias("rows"), count_if(F.col("ltv").isNull()).alias("missing_ltv_rows"),
             F.avg(F.col("ltv").isNull().cast("int")).alias("missing_ltv_rate"), F.avg("ltv").alias("mean_ltv"),
             F.median("ltv").alias("median_ltv"), F.avg("y").alias("actual_cure_lgd"), F.avg("p").alias("predicted_cure_lgd")]
    whole = cure.groupBy(F.lit("split_missingness").alias("section"), "split", F.lit("ALL").alias("ltv_band")).agg(*stats)
    bands = cure.groupBy(F.lit("ltv_band").alias("section"), "split", F.col("band").alias("ltv_band")).agg(*stats)
    both = F.when(F.col("ltv").isNotNull() & F.col("y").isNotNull(), F.lit(1))
    rel = cure.agg(F.lit("relationship").alias("section"), F.lit("ALL").alias("split"), F.lit("correlation").alias("ltv_band"),
                   F.count(both).alias("rows"), count_if(F.col("ltv").isNull()).alias("missing_ltv_rows"),
                   F.avg(F.col("ltv").isNull().cast("int")).alias("missing_ltv_rate"), F.avg(both * F.col("ltv")).alias("mean_ltv"),
                   F.median(both * F.col("ltv")).alias("median_ltv"), F.avg(both * F.col("y")).alias("actual_cure_lgd"),
                   F.corr(both * F.col("ltv"), both * F.col("y")).alias("predicted_cure_lgd"))
    return whole.unionByName(bands).unionByName(rel)


def population_summary(scored: DataFrame) -> DataFrame:
    """Episodes, resolved episodes and cure rate."""
    return scored.agg(F.count(F.lit(1)).alias("episodes"), count_if(F.col("resolved_flag")).alias("resolved"),
                      count_if(F.col("cured_flag")).alias("cured"),
                      safe_div(count_if(F.col("cured_flag")), count_if(F.col("resolved_flag"))).alias("cure_rate"))


def recalibrated(p: Column, intercept: float, slope: float) -> Column:
    return expit(F.lit(intercept) + F.lit(slope) * logit(clip(p, 1e-6, 1 - 1e-6)))
