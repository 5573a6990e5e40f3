"""Calibrated PD, rating scale, through-the-cycle anchors, lifetime curves, transitions and backtests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.config import PDFramework
from lossloom.functions.curves import hazard_scale, with_survival
from lossloom.functions.exprs import bucket, clip, count_if, expit, logit, safe_div, wavg
from lossloom.functions.isotonic import fit_isotonic, interpolated
from lossloom.functions.joins import loan_join
from lossloom.functions.ranks import exact_quantiles
from lossloom.operators import metrics
from lossloom.operators.metrics import binary_metrics
from lossloom.operators.scorecard import fit_logistic
from lossloom.sources.store import cut_lineage, loan_co_location

PD = "pd_calibrated_12m"


@dataclass(frozen=True)
class Calibration:
    method: str
    intercept: float = 0.0
    slope: float = 1.0
    slope_was_clipped: bool = False
    blocks: DataFrame | None = None

    def apply(self, df: DataFrame, raw: str = "predicted_pd_raw") -> DataFrame:
        p = clip(raw, 1e-6, 1 - 1e-6)
        df = df.withColumn("pd_raw", p)
        if self.method == "none":
            return df.withColumn(PD, p)
        if self.method == "logistic":
            return df.withColumn(PD, expit(F.lit(self.intercept) + F.lit(self.slope) * logit(p)))
        return interpolated(df, "pd_raw", self.blocks, PD)


def fit_calibration(scored: DataFrame, cfg: PDFramework, raw: str = "predicted_pd_raw") -> Calibration:
    """Fitted on VALIDATION rows only."""
    if cfg.calibration == "none":
        return Calibration("none")
    fit = scored.where("split = 'VALIDATION'").withColumn("_p", clip(raw, 1e-6, 1 - 1e-6))
    if fit.isEmpty():
        raise ValueError("no VALIDATION rows to calibrate on")
    if cfg.calibration == "logistic":
        a, (b,) = fit_logistic(fit.withColumn("_l", logit("_p")), ["_l"], "target", "sample_weight")
        return Calibration("logistic", a, max(b, 0.0), b < 0)
    if cfg.calibration != "isotonic":
        raise ValueError(f"unknown calibration: {cfg.calibration}")
    # One row per distinct score gives the same fit as all rows.
    w = F.col("sample_weight").cast("double")
    cells = fit.groupBy(F.col("_p").alias("x")).agg(F.sum(w).alias("w"), F.sum(w * F.col("target")).alias("wy"))
    return Calibration("isotonic", blocks=fit_isotonic(cells))


def calibration_error(df: DataFrame, groups: Sequence[str], pd: str, bins: int = 10) -> DataFrame:
    """Weighted gap between observed and predicted rates over equal-width classes, 1.0 falling in the last."""
    cls = F.least(F.lit(bins - 1), F.floor(F.col(pd) * bins))
    cells = df.groupBy(*groups, cls.alias("_c")).agg(
        F.sum("sample_weight").alias("w"), F.sum(F.col("target") * F.col("sample_weight")).alias("y"),
        F.sum(F.col(pd) * F.col("sample_weight")).alias("p"))
    return cells.groupBy(*groups).agg((F.sum(F.abs(F.col("y") - F.col("p"))) / F.sum("w")).alias("ece"))


def calibration_metrics(preds: DataFrame) -> DataFrame:
    """Raw against calibrated accuracy per split, both from one stacked table."""
    long = preds.unpivot(["split", "target", "sample_weight"], [F.col("pd_raw").alias("raw"), F.col(PD).alias("calibrated")],
                         "pd_type", "p").withColumn("p", clip("p", 1e-8, 1 - 1e-8))
    keys = ["split", "pd_type"]
    return binary_metrics(long, keys, "p").join(calibration_error(long, keys, "p"), keys)


def boundary_edges(preds: DataFrame, cfg: PDFramework) -> list[float]:
    """Distinct TRAIN quantiles with the ends opened to 0 and 1."""
    q = exact_quantiles(preds.where("split = 'TRAIN'").withColumn("_g", F.lit(1)), ["_g"], PD,
                        [i / cfg.grades for i in range(cfg.grades + 1)]).first()
    inner = sorted(set(q["q"]))[1:-1] if q else []
    return [0.0, *inner, 1.0]


def grade_labels(edges: Sequence[float]) -> list[str]:
    return [f"R{i}" for i in range(1, len(edges))]


def boundary_table(spark, edges: Sequence[float]) -> DataFrame:
    rows = list(zip(grade_labels(edges), map(float, edges[:-1]), map(float, edges[1:])))
    return spark.createDataFrame(rows, "rating string, lower_pd double, upper_pd double")


def rating_of(pd: Column | str, edges: Sequence[float]) -> Column:
    return bucket(pd, edges, grade_labels(edges), closed="right", lowest=True)


def rating_summary(preds: DataFrame, min_share: float = 0.02, min_defaults: float = 20) -> DataFrame:
    """Population, bad rate and PD range per rating with the population and default floors."""
    w = F.col("sample_weight")
    s = preds.groupBy("rating").agg(
        F.count(F.lit(1)).alias("population"), F.sum(F.col("target") * w).alias("defaults"),
        wavg("target", w).alias("observed_bad_rate"), wavg(PD, w).alias("mean_pd"), F.min(PD).alias("min_pd"),
        F.max(PD).alias("max_pd"))
    floor = F.sum("population").over(Window.partitionBy()) * F.lit(min_share)  # one row per rating
    return s.withColumn("minimum_population_threshold", floor).withColumns({
        "passes_minimum_population": F.col("population") >= F.col("minimum_population_threshold"),
        "passes_minimum_defaults": F.col("defaults") >= F.lit(min_defaults)}).orderBy("mean_pd")


def anchor_rows(preds: DataFrame, cfg: PDFramework) -> DataFrame:
    a, b = cfg.anchor
    return preds.where(F.col("as_of_date").between(F.lit(a), F.lit(b)))


def portfolio_ttc(preds: DataFrame, cfg: PDFramework) -> DataFrame:
    a, b = cfg.anchor
    return anchor_rows(preds, cfg).agg(
        F.lit(a).alias("anchor_start"), F.lit(b).alias("anchor_end"), wavg("target", "sample_weight").alias("portfolio_ttc_pd"),
        F.count(F.lit(1)).alias("observations"))


def rating_ttc(preds: DataFrame, cfg: PDFramework) -> DataFrame:
    return anchor_rows(preds, cfg).groupBy("rating").agg(
        wavg("target", "sample_weight").alias("rating_ttc_pd"), F.count(F.lit(1)).alias("observations"))


def pit_ttc(preds: DataFrame, portfolio: DataFrame) -> DataFrame:
    by_year = preds.groupBy(F.year("as_of_date").alias("observation_year")).agg(
        wavg("target", "sample_weight").alias("observed_12m_default_rate"), wavg(PD, "sample_weight").alias("mean_calibrated_pd"))
    t = by_year.crossJoin(portfolio.select(F.col("portfolio_ttc_pd").alias("ttc_pd")))  # one-row right side
    return t.withColumn("pit_to_ttc_ratio", safe_div("mean_calibrated_pd", "ttc_pd"))


def event_foundation(preds: DataFrame, targets: DataFrame) -> DataFrame:
    """Rated rows with their events. Both sides hold a row per loan and month."""
    found = targets.select("loan_id", "as_of_date", "months_until_event", "event_default", "event_prepayment_or_exit",
                           "event_censored", "event_type")
    return loan_join(preds.select("loan_id", "as_of_date", "rating"), found, ["loan_id", "as_of_date"])


def empirical_hazards(events: DataFrame, cfg: PDFramework) -> DataFrame:
    """Smoothed monthly default hazard per rating from one histogram of event months, which is stored: all that follows reads only that."""
    top = cfg.max_months + 1
    month = F.least(F.greatest("months_until_event", F.lit(0)), F.lit(top)).cast("int")
    hist = events.groupBy("rating", month.alias("month")).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("event_default")).alias("d"))
    with loan_co_location(events.sparkSession):
        hist = cut_lineage(hist, "event-months")
    grid = hist.select("rating").distinct().select("rating", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("month"))
    dense = grid.join(hist, ["rating", "month"], "left").fillna(0, ["n", "d"])
    later = Window.partitionBy("rating").orderBy("month").rowsBetween(0, Window.unboundedFollowing)
    dense = dense.withColumn("at_risk", F.sum("n").over(later)).where(F.col("month").between(1, cfg.max_months))
    s = cfg.hazard_smoothing
    hazard = F.when(F.col("at_risk") > 0, (F.col("d") + s) / (F.col("at_risk") + 2 * s)).otherwise(F.lit(0.0))
    return dense.select("rating", "month", hazard.alias("conditional_pd"))


def first_year_hazards(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hazards of months 1-12 as an array in month order; twelve entries per curve."""
    pairs = F.sort_array(F.collect_list(F.struct("month", "conditional_pd")))
    return curves.where(F.col("month") <= 12).groupBy(*keys).agg(
        F.transform(pairs, lambda x: x["conditional_pd"]).alias("hazards"))


def scaled_curves(curves: DataFrame, factors: DataFrame, keys: Sequence[str]) -> DataFrame:
    scaled = curves.select(*[c for c in ("rating", "month", "conditional_pd")]).join(factors, "rating")
    scaled = scaled.withColumn("conditional_pd", F.least(F.lit(1.0), F.col("conditional_pd") * F.col("factor"))).drop("factor")
    return with_survival(scaled, keys)


def reconcile_factors(curves: DataFrame, preds: DataFrame) -> DataFrame:
    """Factor per rating that makes the 12-month cumulative PD equal the mean calibrated PD."""
    goal = preds.groupBy("rating").agg(wavg(PD, "sample_weight").alias("goal"))
    t = first_year_hazards(curves, ["rating"]).join(goal, "rating")
    return t.select("rating", hazard_scale(F.col("hazards"), F.col("goal")).alias("factor"))


def lifetime_curves(events: DataFrame, preds: DataFrame, cfg: PDFramework) -> DataFrame:
    base = empirical_hazards(events, cfg)
    return scaled_curves(base, reconcile_factors(base, preds), ["rating"])


def transitions(preds: DataFrame, months: int, default_state: str = "DEFAULT") -> DataFrame:
    """Rating moves to the row exactly ``months`` later, row-normalised, with an absorbing default state.

    The later row is read by a calendar range window on the loan, so there is no self-join.
    """
    mi = F.year("as_of_date") * 12 + F.month("as_of_date")
    w = Window.partitionBy("loan_id").orderBy("_mi").rangeBetween(months, months)
    state = F.when(F.col("target") == 1, F.lit(default_state)).otherwise(F.col("rating"))
    moved = (preds.select("loan_id", mi.alias("_mi"), F.col("rating").alias("rating_from"), state.alias("_s"))
             .withColumn("to_state", F.max("_s").over(w)).where("to_state IS NOT NULL"))
    counts = moved.groupBy("rating_from", "to_state").agg(F.count(F.lit(1)).alias("count"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy("rating_from"))  # one row per state
    absorbing = preds.sparkSession.range(1).select(
        F.lit(default_state).alias("rating_from"), F.lit(default_state).alias("to_state"),
        F.lit(0).cast("long").alias("count"), F.lit(1.0).alias("probability"))
    return counts.withColumn("probability", share).unionByName(absorbing).select(
        F.lit(months).cast("long").alias("months"), "rating_from", "to_state", "count", "probability")


def grade_number(c: Column | str) -> Column:
    """Integer after the leading R; null for other states."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(v.rlike(r"^R\d+$"), F.substring(v, 2, 9).try_cast("int"))


def transition_summary(matrix: DataFrame, default_state: str = "DEFAULT") -> DataFrame:
    rows = matrix.where(F.col("rating_from") != default_state)
    n = F.col("count")
    step = grade_number("to_state") - grade_number("rating_from")
    dflt = F.col("to_state") == default_state

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))

    return rows.groupBy("months", "rating_from").agg(
        (1 - total(~dflt & (step == 0)) / F.sum(n)).alias("migration_rate"),
        (total(~dflt & (step < 0)) / F.sum(n)).alias("upgrade_rate"),
        (total(dflt | (step > 0)) / F.sum(n)).alias("downgrade_rate"),
        (total(dflt) / F.sum(n)).alias("default_transition_rate"), F.sum(n).alias("transitions"))


def _backtest(preds: DataFrame, keys: list[Column | str]) -> DataFrame:
    w, y, p = F.col("sample_weight"), F.col("target"), F.col(PD)
    return preds.groupBy(*keys).agg(F.sum(y * w).alias("observed_defaults"), F.sum(p * w).alias("expected_defaults"),
                                    F.sum(w).alias("_n"), wavg((y - p) * (y - p), w).alias("brier")).withColumn(
        "oe_ratio", safe_div("observed_defaults", "expected_defaults"))


def backtest(preds: DataFrame, min_defaults: float = 20) -> DataFrame:
    """Observed against expected per rating and year with a 95% binomial band."""
    t = _backtest(preds, ["rating", F.year("as_of_date").alias("observation_year")])
    rate = F.coalesce(safe_div("expected_defaults", "_n"), F.lit(0.0))
    half = F.lit(1.96) * F.sqrt(F.greatest(F.coalesce(safe_div(rate * (1 - rate), F.col("_n")), F.lit(0.0)), F.lit(0.0)))
    return t.select("rating", "observation_year", "observed_defaults", "expected_defaults", "oe_ratio",
                    F.greatest(F.lit(0.0), rate - half).alias("binomial_lower"),
                    F.least(F.lit(1.0), rate + half).alias("binomial_upper"), "brier",
                    (F.col("observed_defaults") < F.lit(float(min_defaults))).alias("insufficient_defaults"))


def backtest_splits(preds: DataFrame) -> DataFrame:
    return _backtest(preds, ["split"]).drop("_n")


def calibration_curve(preds: DataFrame, k: int = 10) -> DataFrame:
    return metrics.calibration_curve(preds, PD, k, "bucket").select("split", "bucket", "observed_bad_rate", "predicted_bad_rate", "rows")
