"""Macro series, one-factor PD conditioning and scenario curves.

Series, scenarios and ratings are small by nature (quarters x scenarios x grades); the loan-level table enters only
through grouped default rates and leaves through the curve join of the loss engine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.functions.curves import hazard_scale
from lossloom.functions.exprs import clip, expit, logit, month_index, quarter_end, safe_div, with_norm_cdf, with_norm_ppf
from lossloom.operators.pd_framework import first_year_hazards, scaled_curves

FEATURES = ("unemployment_rate", "unemployment_rate_change", "house_price_index_yoy", "real_gdp_yoy", "mortgage_rate",
            "mortgage_rate_change")
# Series whose rise weakens the economy.
WEAKENING = frozenset({"unemployment_rate", "unemployment_rate_change", "mortgage_rate", "mortgage_rate_change"})


@dataclass(frozen=True)
class Series:
    aggregation: str = "mean"  # or "last"
    transform: str = "level"  # or "yoy_pct"


@dataclass(frozen=True)
class MacroConfig:
    start: date = date(1995, 1, 1)
    series: Mapping[str, Series] = field(default_factory=lambda: {
        "unemployment_rate": Series(), "house_price_index": Series(transform="yoy_pct"),
        "real_gdp": Series("last", "yoy_pct"), "mortgage_rate": Series()})
    epsilon: float = 1e-6
    rho_override: float | None = None
    rho_min: float = 0.01
    rho_max: float = 0.25
    rho_steps: int = 100
    ridge_strength: float = 1.0
    scenario_start: date = date(2000, 9, 30)
    quarters: int = 12
    weights: Mapping[str, float] = field(default_factory=lambda: {"BASE": 0.55, "UPSIDE": 0.15, "DOWNSIDE": 0.30})
    shocks: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: {
        "BASE": {},
        "UPSIDE": {"unemployment_rate": -0.5, "house_price_index_yoy": 3.0, "real_gdp_yoy": 1.0, "mortgage_rate": -0.25},
        "DOWNSIDE": {"unemployment_rate": 2.0, "house_price_index_yoy": -10.0, "real_gdp_yoy": -3.0, "mortgage_rate": 1.5}})
    stress: tuple[date, date] = (date(1998, 1, 1), date(1999, 12, 31))

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1) > 1e-9:
            raise ValueError("scenario weights must sum to 1")
        if set(self.weights) != set(self.shocks):
            raise ValueError("every scenario needs a weight and a shock")


@dataclass(frozen=True)
class LinearModel:
    intercept: float
    coefs: Mapping[str, float]

    def apply(self) -> Column:
        expr = F.lit(float(self.intercept))
        for f, b in self.coefs.items():
            expr = expr + F.lit(float(b)) * F.col(f)
        return expr


def quarterly(monthly: DataFrame, series: Mapping[str, Series]) -> DataFrame:
    """Long (series, date, value) observations to one value per series and quarter end, transformed."""
    q = monthly.groupBy("series", quarter_end("date").alias("quarter")).agg(
        F.avg("value").alias("mean"), F.max_by("value", "date").alias("last"))
    value, change = F.lit(None).cast("double"), F.lit(False)
    name = F.col("series")
    for s, spec in series.items():
        here = F.col("series") == s
        value = F.when(here, F.col("mean" if spec.aggregation == "mean" else "last")).otherwise(value)
        if spec.transform == "yoy_pct":
            change = change | here
            name = F.when(here, F.lit(f"{s}_yoy")).otherwise(name)
    q = q.select("series", "quarter", value.alias("v"), change.alias("yoy"), name.alias("name"))
    year_ago = F.max("v").over(Window.partitionBy("series").orderBy("_m").rangeBetween(-12, -12))
    q = q.withColumn("_m", month_index("quarter")).withColumn("_p", year_ago)
    return q.select(F.col("name").alias("series"), F.col("quarter").alias("date"),
                    F.when(F.col("yoy"), (safe_div("v", "_p") - 1) * 100).otherwise(F.col("v")).alias("value"))


def aligned(long: DataFrame, names: Sequence[str], start: date) -> DataFrame:
    """One row per quarter with all series, gaps filled forward, then first differences of the two rates.

    The ordered window runs over quarters only, a table bounded by the calendar.
    """
    wide = long.groupBy("date").agg(*[F.max(F.when(F.col("series") == n, F.col("value"))).alias(n) for n in names])
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    fill = w.rowsBetween(Window.unboundedPreceding, 0)
    wide = wide.select("date", *[F.last(n, ignorenulls=True).over(fill).alias(n) for n in names])
    wide = wide.where(F.col("date") >= F.lit(start))
    return wide.withColumns({f"{n}_change": F.col(n) - F.lag(n).over(w) for n in ("unemployment_rate", "mortgage_rate")
                             if n in names})


def historical_default_rate(preds: DataFrame) -> DataFrame:
    return preds.groupBy(quarter_end("as_of_date").alias("date")).agg(
        F.avg("target").alias("observed_default_rate"), F.count(F.lit(1)).alias("observations"))


def check_rho(rho: float) -> None:
    if not 0 < rho < 1:
        raise ValueError(f"rho must be between 0 and 1, got {rho}")


def with_vasicek_pd(df: DataFrame, out: str, ttc: Column | str, factor: Column | str, rho: float) -> DataFrame:
    """Add the PD in the state of the economy given by the systematic factor (higher is better)."""
    check_rho(rho)
    f = F.col(factor) if isinstance(factor, str) else factor
    df = with_norm_ppf(df, "_n", clip(ttc, 1e-8, 1 - 1e-8))
    return with_norm_cdf(df, out, (F.col("_n") - F.lit(rho ** 0.5) * f) / F.lit((1 - rho) ** 0.5)).drop("_n")


def with_systematic_factor(df: DataFrame, out: str, observed: Column | str, ttc: Column | str, rho: Column,
                           eps: float) -> DataFrame:
    """Add the factor that makes the one-factor PD equal the observed rate."""
    df = with_norm_ppf(df, "_no", clip(observed, eps, 1 - eps))
    df = with_norm_ppf(df, "_nt", clip(ttc, eps, 1 - eps))
    return df.withColumn(out, (F.col("_nt") - F.sqrt(1 - rho) * F.col("_no")) / F.sqrt(rho)).drop("_no", "_nt")


def rho_grid(history: DataFrame, cfg: MacroConfig) -> DataFrame:
    """Standard deviation of the implied factor for each correlation on the grid; the one closest to 1 is selected."""
    if cfg.rho_override is not None:
        check_rho(cfg.rho_override)
        return history.sparkSession.range(1).select(
            F.lit(float(cfg.rho_override)).alias("rho"), F.lit(None).cast("double").alias("factor_std"),
            F.lit(0.0).alias("objective"), F.lit(True).alias("selected"))
    step = (cfg.rho_max - cfg.rho_min) / (cfg.rho_steps - 1)
    rho = F.lit(cfg.rho_min) + F.col("i") * F.lit(step)
    t = history.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cfg.rho_steps - 1)))).withColumn("rho", rho)
    t = with_systematic_factor(t, "z", "observed_default_rate", "ttc_pd", F.col("rho"), cfg.epsilon)
    grid = t.groupBy("i", "rho").agg(F.stddev_samp("z").alias("factor_std"))
    grid = grid.withColumn("objective", F.abs(F.col("factor_std") - 1))
    best = F.min(F.struct("objective", "i")).over(Window.partitionBy(F.lit(0)))  # rho_steps rows
    return grid.withColumn("selected", best["i"] == F.col("i")).drop("i")


def selected_rho(grid: DataFrame) -> float:
    return float(grid.where("selected").first()["rho"])


def model_frame(history: DataFrame, macro: DataFrame, rho: float, eps: float, features: Sequence[str] = FEATURES) -> DataFrame:
    h = with_systematic_factor(history, "systematic_factor", "observed_default_rate", "ttc_pd", F.lit(rho), eps)
    return h.join(macro, "date").dropna(subset=[*features, "systematic_factor"])


def nonnegative_least_squares(gram: np.ndarray, moment: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """Active-set solution of min b'Gb - 2m'b for b >= 0; G is features x features."""
    n = len(moment)
    b, free = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(30 * n):
        slope = moment - gram @ b
        open_slots = ~free & (slope > tol * max(1.0, float(np.abs(moment).max())))
        if not open_slots.any():
            break
        free[int(np.argmax(np.where(open_slots, slope, -np.inf)))] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(gram[np.ix_(free, free)], moment[free], rcond=None)[0]
            if (trial[free] > 0).all():
                b = trial
                break
            down = free & (trial <= 0)
            step = min(b[i] / (b[i] - trial[i]) for i in np.flatnonzero(down))
            b = b + step * (trial - b)
            free &= b > tol
            b[~free] = 0.0
    return b


def fit_factor_model(frame: DataFrame, features: Sequence[str] = FEATURES, target: str = "systematic_factor") -> LinearModel:
    """Least squares with every feature signed so that it can only help when the economy strengthens.

    One aggregate gives the centred second moments; the features x features problem is solved on the driver.
    """
    signs = {f: -1.0 if f in WEAKENING else 1.0 for f in features}
    cols = [*features, target]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    r = frame.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols],
                  *[F.covar_pop(a, b).alias(f"c_{a}__{b}") for a, b in pairs]).first()
    cov = {p: r[f"c_{p[0]}__{p[1]}"] for p in pairs}
    cov |= {(b, a): v for (a, b), v in cov.items()}
    gram = np.array([[signs[a] * signs[b] * cov[(a, b)] for b in features] for a in features])
    moment = np.array([signs[a] * cov[(a, target)] for a in features])
    beta = nonnegative_least_squares(gram, moment)
    coefs = {f: float(signs[f] * x) + 0.0 for f, x in zip(features, beta)}
    return LinearModel(float(r[f"m_{target}"] - sum(coefs[f] * r[f"m_{f}"] for f in features)), coefs)


def fit_satellite(frame: DataFrame, strength: float, features: Sequence[str] = FEATURES) -> LinearModel:
    """Ridge regression of the logit default rate; Spark scales the label, hence the factor on the penalty."""
    y = frame.withColumn("_y", logit(clip("observed_default_rate", 1e-6, 1 - 1e-6)))
    s = y.agg(F.stddev_pop("_y").alias("sd"), F.count(F.lit(1)).alias("n")).first()
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(y)
    m = LinearRegression(featuresCol="_x", labelCol="_y", regParam=(1 / strength) * (s["sd"] or 1.0) / s["n"], elasticNetParam=0.0,
                         standardization=False, solver="normal").fit(data)
    return LinearModel(float(m.intercept), dict(zip(features, map(float, m.coefficients))))


def variance_inflation(frame: DataFrame, features: Sequence[str] = FEATURES) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix, capped as for an R2 of 1 - 1e-6."""
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(frame)
    corr = Correlation.corr(data, "_x").first()[0].toArray()
    inv = np.diag(np.linalg.pinv(np.nan_to_num(corr, nan=0.0)))
    return {f: float(min(max(v, 1.0), 1e6)) for f, v in zip(features, inv)}


def with_fits(frame: DataFrame, factor: LinearModel, satellite: LinearModel, ttc: Column, rho: float) -> DataFrame:
    """Both models applied to history with their residuals."""
    df = frame.withColumns({"vasicek_systematic_factor": factor.apply(), "satellite_pit_pd": expit(satellite.apply())})
    df = with_vasicek_pd(df, "vasicek_pit_pd", ttc, "vasicek_systematic_factor", rho)
    o = F.col("observed_default_rate")
    return df.withColumns({"factor_residual": F.col("systematic_factor") - F.col("vasicek_systematic_factor"),
                           "vasicek_residual": o - F.col("vasicek_pit_pd"), "satellite_residual": o - F.col("satellite_pit_pd")})


def diagnostics(fits: DataFrame) -> DataFrame:
    prev = F.lag("factor_residual").over(Window.partitionBy(F.lit(0)).orderBy("date"))  # one row per quarter
    e, s = F.col("factor_residual"), F.col("satellite_residual")
    return fits.withColumn("_prev", prev).agg(
        F.sqrt(F.avg(e * e)).alias("factor_rmse"), F.avg(F.abs(e)).alias("factor_mae"),
        F.sqrt(F.avg(s * s)).alias("satellite_rmse"), F.avg(F.abs(s)).alias("satellite_mae"),
        F.avg(s * s).alias("satellite_brier"),
        F.corr(F.when(F.col("_prev").isNotNull(), e), "_prev").alias("factor_residual_autocorrelation_lag1"))


def backtest(fits: DataFrame) -> DataFrame:
    out = []
    for m in ("vasicek", "satellite"):
        r = F.col(f"{m}_residual")
        out += [F.sqrt(F.avg(r * r)).alias(f"{m}_rmse"), F.avg(F.abs(r)).alias(f"{m}_mae"), F.avg(r * r).alias(f"{m}_brier")]
    return fits.agg(*out)


def stress_slice(fits: DataFrame, cfg: MacroConfig) -> DataFrame:
    return fits.where(F.col("date").between(F.lit(cfg.stress[0]), F.lit(cfg.stress[1])))


def scenario_paths(macro: DataFrame, cfg: MacroConfig, features: Sequence[str] = FEATURES) -> DataFrame:
    """Latest quarter moved linearly to the full shock over the horizon; changes are the shock per quarter."""
    latest = macro.dropna(subset=list(features)).agg(F.max_by(F.struct(*features), "date").alias("b"))
    rows = [(s, float(w), float(sh.get(f, 0.0)), f) for s, w in cfg.weights.items() for sh in [cfg.shocks[s]]
            for f in ("unemployment_rate", "house_price_index_yoy", "real_gdp_yoy", "mortgage_rate")]
    shocks = macro.sparkSession.createDataFrame(rows, "scenario string, scenario_weight double, shock double, f string")
    wide = shocks.groupBy("scenario", "scenario_weight").agg(
        *[F.max(F.when(F.col("f") == f, F.col("shock"))).alias(f"s_{f}") for f in {r[3] for r in rows}])
    steps = wide.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(cfg.quarters))))
    t = steps.crossJoin(latest)  # scenarios x quarters against one row
    when = F.last_day(F.add_months(F.lit(cfg.scenario_start), (F.col("step") - 1) * 3))
    cols = []
    for f in features:
        if f.endswith("_change"):
            cols.append((F.col(f"s_{f.removesuffix('_change')}") / cfg.quarters).alias(f))
        else:
            cols.append((F.col(f"b.{f}") + F.col(f"s_{f}") * (F.col("step") / cfg.quarters)).alias(f))
    return t.select("scenario", when.alias("date"), "scenario_weight", *cols)


def scenario_factors(paths: DataFrame, factor: LinearModel, satellite: LinearModel) -> DataFrame:
    return paths.withColumns({"systematic_factor": factor.apply(), "satellite_portfolio_pd": expit(satellite.apply())})


def scenario_pd(rating_ttc: DataFrame, factors: DataFrame, rho: float) -> DataFrame:
    t = factors.select("scenario", "date", "systematic_factor", "scenario_weight").crossJoin(
        rating_ttc.select("rating", F.col("rating_ttc_pd").alias("ttc_pd")))  # quarters x scenarios x grades
    t = with_vasicek_pd(t, "pit_pd_12m", "ttc_pd", "systematic_factor", rho)
    return t.withColumn("weighted_pd_12m", F.col("pit_pd_12m") * F.col("scenario_weight"))


def weighted_pd(spd: DataFrame) -> DataFrame:
    return spd.groupBy("date", "rating").agg(F.first("ttc_pd").alias("ttc_pd"), F.sum("weighted_pd_12m").alias("weighted_pd_12m"),
                                             F.sum("scenario_weight").alias("scenario_weight_sum"))


def scenario_lifetime(lifetime: DataFrame, spd: DataFrame) -> DataFrame:
    """Base lifetime curve of each rating rescaled to the scenario's 12-month PD."""
    keys = ["scenario", "date", "rating"]
    t = spd.join(first_year_hazards(lifetime, ["rating"]), "rating")
    factors = t.select(*keys, "scenario_weight", hazard_scale(F.col("hazards"), F.col("pit_pd_12m")).alias("factor"))
    c = scaled_curves(lifetime, factors, keys)
    w = F.col("scenario_weight")
    return c.withColumns({"weighted_marginal_pd": F.col("marginal_pd") * w, "weighted_cumulative_pd": F.col("cumulative_pd") * w})


def weighted_lifetime(curves: DataFrame, survival_floor: float = 0.0) -> DataFrame:
    """Weight-averaged curve; its hazard is 0 once survival has fallen to the floor."""
    g = curves.groupBy("date", "rating", "month").agg(
        F.sum("weighted_marginal_pd").alias("marginal_pd"), F.sum("weighted_cumulative_pd").alias("cumulative_pd"),
        F.sum("scenario_weight").alias("scenario_weight_sum"))
    prev = F.lag(F.greatest(F.lit(0.0), 1 - F.col("cumulative_pd"))).over(Window.partitionBy("date", "rating").orderBy("month"))
    g = g.withColumns({"survival_probability": 1 - F.col("cumulative_pd"), "_p": F.coalesce(prev, F.lit(1.0))})
    cond = F.when(F.col("_p") > survival_floor, F.col("marginal_pd") / F.col("_p")).otherwise(F.lit(0.0))
    return g.withColumn("conditional_pd", cond).withColumn("hazard", F.col("conditional_pd")).drop("_p")
