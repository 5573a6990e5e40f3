"""Macro overlay on LGD: quarterly regime table, multiplicative overlay, scenario LGD by rating."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.functions.exprs import clip, quarter_end, safe_div, tagged_rows
from lossloom.operators.lgd import TARGET, accuracy

FEATURES = ("unemployment_rate", "house_price_index_yoy", "real_gdp_yoy", "mortgage_rate", "systematic_factor")


@dataclass(frozen=True)
class OverlayConfig:
    weights: Mapping[str, float] = field(default_factory=lambda: {
        "unemployment_rate": 1.0, "house_price_index_yoy": -1.0, "real_gdp_yoy": -0.5, "mortgage_rate": 0.25, "systematic_factor": -0.5})
    floor: float = 0.0
    cap: float | None = None
    hpi_shocks: tuple[float, ...] = (-20.0, -10.0, -5.0, 0.0, 5.0, 10.0, 20.0)
    unemployment_shocks: tuple[float, ...] = (-1.0, 0.0, 1.0)


@dataclass(frozen=True)
class Overlay:
    slope: float
    train_intercept: float
    intercept: float
    means: Mapping[str, float]
    stds: Mapping[str, float]

    def multiplier(self, cfg: OverlayConfig, shifts: Mapping[str, Column] | None = None) -> Column:
        index = F.lit(0.0)
        for f, w in cfg.weights.items():
            v = F.col(f) + (shifts or {}).get(f, F.lit(0.0))
            index = index + F.lit(w) * F.coalesce((v - F.lit(self.means[f])) / F.lit(self.stds[f]), F.lit(0.0))
        return clip(F.exp(F.lit(self.intercept) + F.lit(self.slope) * index), cfg.floor, cfg.cap)


def with_macro(eps: DataFrame, macro: DataFrame) -> DataFrame:
    """Episodes with the macro values of their default quarter."""
    return eps.withColumn("date", quarter_end("default_date")).join(macro.select("date", *FEATURES), "date", "left")


def regimes(eps: DataFrame, macro: DataFrame, cfg: OverlayConfig) -> DataFrame:
    """Quarter x split aggregates with macro values, observed over predicted, and a stress index over the table itself."""
    y, cured = F.col(TARGET), F.col("cured_flag")

    def share(c: str) -> Column:
        return F.avg(F.col(c).cast("int"))

    g = eps.groupBy(quarter_end("default_date").alias("date"), "split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(y).alias("realized_lgd"), F.avg("predicted_lgd").alias("predicted_lgd"),
        share("cured_flag").alias("cure_rate"), F.avg(F.when(cured, y)).alias("cure_lgd"), F.avg(F.when(~cured, y)).alias("non_cure_lgd"),
        F.avg("estimated_loan_to_value_at_default").alias("average_ltv"), F.avg("current_upb_to_original_upb_at_default").alias("average_current_upb_ratio"),
        share("default_due_to_delinquency").alias("delinquency_default_share"), share("default_due_to_credit_event").alias("credit_event_default_share"),
        F.avg(F.when(F.col("rating_at_default") == "R5", 1.0).otherwise(0.0)).alias("r5_share"))
    t = g.join(macro.select("date", *FEATURES), "date", "left").withColumn("structural_oe_ratio", safe_div("realized_lgd", "predicted_lgd"))
    whole = Window.partitionBy(F.lit(0))  # one row per quarter and split
    index = F.lit(0.0)
    for f, w in cfg.weights.items():
        sd = F.stddev_samp(f).over(whole)
        sd = F.when(sd > 0, sd).otherwise(1.0)
        index = index + F.lit(w) * F.coalesce((F.col(f) - F.avg(f).over(whole)) / sd, F.lit(0.0))
    return t.withColumn("stress_index", index)


def fit(history: DataFrame) -> DataFrame:
    """One row: TRAIN slope (not below 0) and intercept, VALIDATION intercept by mass balance, TRAIN means and deviations."""
    ok = F.col("structural_oe_ratio").isNotNull() & F.col("stress_index").isNotNull()
    train, val = (F.col("split") == "TRAIN") & ok, (F.col("split") == "VALIDATION") & ok
    x = F.when(train, F.col("stress_index"))
    y = F.when(train, F.ln(F.greatest("structural_oe_ratio", F.lit(1e-6))))
    raw = F.covar_pop(x, y) / F.greatest(F.var_pop(x), F.lit(1e-12))
    slope = F.when(F.count(x) < 2, 0.0).otherwise(F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)))
    in_train = F.col("split") == "TRAIN"
    stats = [s for f in FEATURES for s in (F.avg(F.when(in_train, F.col(f))).alias(f"mean_{f}"), F.stddev_samp(F.when(in_train, F.col(f))).alias(f"sd_{f}"))]
    one = history.agg(slope.alias("slope"), F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.count(x).alias("_n"), *stats)
    one = one.withColumn("train_intercept", F.when(F.col("_n") < 2, 0.0).otherwise(F.col("_y") - F.col("slope") * F.col("_x")))
    v = history.where(val).crossJoin(one.select(F.col("slope").alias("_s")))  # one-row right side
    mass = v.agg(F.count(F.lit(1)).alias("_v"), F.sum(F.col("realized_lgd") * F.col("rows")).alias("_a"),
                 F.sum(F.col("predicted_lgd") * F.exp(F.col("_s") * F.col("stress_index")) * F.col("rows")).alias("_b"))
    t = one.crossJoin(mass)  # two single-row aggregates
    inter = F.when(F.col("_v") == 0, F.col("train_intercept")).otherwise(
        F.ln(F.greatest("_a", F.lit(1e-6)) / F.greatest("_b", F.lit(1e-6))))
    sds = {f"sd_{f}": F.when(F.col(f"sd_{f}") > 0, F.col(f"sd_{f}")).otherwise(1.0) for f in FEATURES}
    return t.withColumns({"validation_intercept": inter} | sds).drop("_x", "_y", "_n", "_v", "_a", "_b")


def overlay(fitted: DataFrame) -> Overlay:
    r = fitted.first()
    return Overlay(r["slope"], r["train_intercept"], r["validation_intercept"], {f: r[f"mean_{f}"] or 0.0 for f in FEATURES},
                   {f: r[f"sd_{f}"] for f in FEATURES})


def apply_overlay(eps: DataFrame, macro: DataFrame, o: Overlay, cfg: OverlayConfig) -> DataFrame:
    """Both branches scaled by the calibration factor and the overlay, clipped and recombined."""
    df = with_macro(eps, macro).withColumn("macro_overlay", o.multiplier(cfg))
    k = F.col("expected_lgd_calibration_factor") * F.col("macro_overlay")
    df = df.withColumns({"cure_lgd_forward_adjusted": clip(F.col("predicted_cure_lgd") * k, 0.0, 1.0),
                         "non_cure_lgd_forward_adjusted": clip(F.col("predicted_non_cure_lgd") * k, 0.0, 1.0)})
    p = F.col("predicted_cure_probability")
    return df.withColumn("lgd_forward_adjusted", p * F.col("cure_lgd_forward_adjusted") + (1 - p) * F.col("non_cure_lgd_forward_adjusted"))


def rating_base(eps: DataFrame) -> DataFrame:
    k = F.col("expected_lgd_calibration_factor")
    return eps.where("rating_at_default IS NOT NULL").groupBy(F.col("rating_at_default").alias("rating")).agg(
        F.avg("predicted_lgd").alias("lgd_base_structural"), F.avg("predicted_cure_probability").alias("predicted_cure_probability"),
        F.avg(clip(F.col("predicted_cure_lgd") * k, 0.0, 1.0)).alias("predicted_cure_lgd"),
        F.avg(clip(F.col("predicted_non_cure_lgd") * k, 0.0, 1.0)).alias("predicted_non_cure_lgd"),
        F.avg(TARGET).alias("observed_lgd"), F.count(F.lit(1)).alias("rows"))


def scenario_lgd(base: DataFrame, paths: DataFrame, multiplier: Column) -> DataFrame:
    """Scenario x quarter x rating LGD from the overlay multiplier of the path."""
    t = paths.withColumn("macro_overlay", multiplier).crossJoin(base)  # scenario quarters x grades
    m = F.col("macro_overlay")
    t = t.withColumns({"scenario_cure_lgd": clip(F.col("predicted_cure_lgd") * m, 0.0, 1.0),
                       "scenario_non_cure_lgd": clip(F.col("predicted_non_cure_lgd") * m, 0.0, 1.0)})
    p = F.col("predicted_cure_probability")
    t = t.withColumn("lgd_scenario", p * F.col("scenario_cure_lgd") + (1 - p) * F.col("scenario_non_cure_lgd"))
    return t.withColumn("weighted_lgd", F.col("lgd_scenario") * F.col("scenario_weight"))


def cumulative_hpi(paths: DataFrame) -> DataFrame:
    growth = 1 + F.coalesce("house_price_index_yoy", F.lit(0.0)) / 100 / 4
    w = Window.partitionBy("scenario").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # quarters of one scenario
    return paths.withColumn("cumulative_hpi_change", F.product(growth).over(w) - 1)


def stressed_ltv_lgd(eps: DataFrame, paths: DataFrame, cure_lgd: Column) -> DataFrame:
    """Scenario LGD by rating with each episode's LTV restated by cumulative house prices and its cure LGD rescored.

    ``cure_lgd`` reads the column stressed_ltv. The path, a few rows per scenario, rides along as one array column and
    is expanded per episode inside the task, so partial sums per rating leave it and not episodes.
    """
    cols = ("scenario", "date", "scenario_weight", "cumulative_hpi_change")
    path = cumulative_hpi(paths).agg(F.collect_list(F.struct(*cols)).alias("_path"))  # quarters x scenarios entries
    df = eps.where("rating_at_default IS NOT NULL").select(
        F.col("rating_at_default").alias("rating"), "estimated_loan_to_value_at_default", "predicted_lgd", "predicted_cure_probability",
        "predicted_non_cure_lgd", "expected_lgd_calibration_factor").crossJoin(path)  # one-row right side
    df = df.withColumn("_s", F.explode("_path")).drop("_path").select("*", "_s.*")
    ltv = clip(F.col("estimated_loan_to_value_at_default") / F.greatest(1 + F.col("cumulative_hpi_change"), F.lit(0.05)), 0.0, 300.0)
    df = df.withColumn("stressed_ltv", ltv).withColumn("cure", clip(cure_lgd, 0.0, 1.0))
    p = F.col("predicted_cure_probability")
    df = df.withColumn("l", clip((p * F.col("cure") + (1 - p) * F.col("predicted_non_cure_lgd")) * F.col("expected_lgd_calibration_factor"), 0.0, 1.0))
    t = df.groupBy(*cols, "rating").agg(
        F.avg("predicted_lgd").alias("lgd_base_structural"), F.avg(p).alias("predicted_cure_probability"), F.avg("cure").alias("scenario_cure_lgd"),
        F.avg("predicted_non_cure_lgd").alias("scenario_non_cure_lgd"), F.avg("stressed_ltv").alias("mean_stressed_ltv"), F.avg("l").alias("lgd_scenario"))
    return t.withColumn("weighted_lgd", F.col("lgd_scenario") * F.col("scenario_weight"))


def weighted(lgds: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return lgds.groupBy(*extra, "date", "rating").agg(F.sum("weighted_lgd").alias("probability_weighted_lgd"),
                                                      F.sum("scenario_weight").alias("scenario_weight_sum"),
                                                      F.first("lgd_base_structural").alias("lgd_base_structural"))


def sensitivity(eps: DataFrame, base: DataFrame, paths: DataFrame, o: Overlay, cfg: OverlayConfig) -> DataFrame:
    """Mean weighted LGD over a grid of house price and unemployment shifts of the scenario paths."""
    grid = F.array(*[F.struct(F.lit(h).alias("hpi_shock"), F.lit(u).alias("unemployment_shock")) for h in cfg.hpi_shocks for u in cfg.unemployment_shocks])
    shifted = paths.withColumn("_g", F.explode(grid)).select("*", "_g.*")
    m = o.multiplier(cfg, {"house_price_index_yoy": F.col("hpi_shock"), "unemployment_rate": F.col("unemployment_shock")})
    keys = ["hpi_shock", "unemployment_shock"]
    t = weighted(scenario_lgd(base, shifted, m), keys).groupBy(*keys).agg(F.avg("probability_weighted_lgd").alias("mean_probability_weighted_lgd"))
    return t.crossJoin(eps.agg(F.avg("predicted_lgd").alias("mean_structural_lgd")))  # one-row right side


RELATED = (*FEATURES, "average_ltv", "r5_share", "delinquency_default_share")
RELATED_TARGETS = ("cure_rate", "cure_lgd", "non_cure_lgd", "realized_lgd")


def relationships(history: DataFrame) -> DataFrame:
    """Correlation of every feature with every target in one aggregate."""
    pairs = [(f, t) for f in RELATED for t in RELATED_TARGETS]
    aggs = []
    for i, (f, t) in enumerate(pairs):
        both = F.when(F.col(f).isNotNull() & F.col(t).isNotNull(), F.lit(1.0))
        aggs += [F.corr(both * F.col(f), both * F.col(t)).alias(f"c{i}"), F.count(both).alias(f"n{i}")]
    rows = [[F.lit(f), F.lit(t), F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")), F.col(f"n{i}")] for i, (f, t) in enumerate(pairs)]
    return tagged_rows(history.agg(*aggs), [], rows, ["feature", "target", "correlation", "rows"])


def backtest(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    y, b, a = F.col(TARGET), F.col("predicted_lgd"), F.col("lgd_forward_adjusted")

    def named(p: Column, tag: str) -> list[Column]:
        oe, mae, rmse = accuracy(y, p)
        return [oe.alias(f"{tag}_oe"), mae.alias(f"{tag}_mae"), rmse.alias(f"{tag}_rmse")]

    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(y).alias("actual_mean_lgd"), F.avg(b).alias("base_predicted_mean"),
                                     F.avg(a).alias("forward_adjusted_predicted_mean"), *named(b, "base"), *named(a, "forward_adjusted"))


def cure_diagnostics(scored: DataFrame) -> DataFrame:
    c = F.col("cured_flag")
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(c, 1)).alias("cure_rows"), F.avg(c.cast("int")).alias("cure_rate"),
        F.avg(F.when(c, F.col(TARGET))).alias("realized_cure_lgd"), F.avg(F.when(c, F.col("predicted_cure_lgd"))).alias("predicted_cure_lgd"),
        F.avg("house_price_index_yoy").alias("average_hpi_yoy"), F.avg("estimated_loan_to_value_at_default").alias("average_ltv"),
        F.avg("systematic_factor").alias("average_systematic_factor"))


def ordering(lgds: DataFrame) -> DataFrame:
    """Whether the downside is at least the base and the base at least the upside, per date and rating."""
    t = lgds.groupBy("date", "rating").pivot("scenario", ["BASE", "DOWNSIDE", "UPSIDE"]).agg(F.avg("lgd_scenario"))
    return t.withColumn("ordered", F.coalesce((F.col("DOWNSIDE") >= F.col("BASE")) & (F.col("BASE") >= F.col("UPSIDE")), F.lit(False)))
