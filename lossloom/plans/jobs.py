"""One job per stage over stored tables: read inputs, build, write outputs.

Paths are folders under ``root``; every job takes the session, the root and optional settings, and returns the tables it
wrote by name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossloom.config import Settings
from lossloom.operators import (development, ead, ecl, lgd, lgd_overlay, macro, mart, metrics, pd_framework, quality, scenario, scorecard, silver,
                                staging, targets)
from lossloom.operators.features import features_for
from lossloom.operators.ml_pipeline import with_prediction
from lossloom.sources import sinks, text, vintages
from lossloom.sources.schemas import layout_for
from lossloom.sources.store import own_cuts

Tables = dict[str, DataFrame]


class Job:
    """Stored tables of one run folder."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), settings or Settings()

    def __enter__(self) -> Job:
        self._cuts = own_cuts(self.spark)
        self._cuts.__enter__()
        return self

    def __exit__(self, *error) -> None:
        """Everything a job stores is under ``root``, so the intermediate tables it wrote itself can go."""
        self._cuts.__exit__(*error)

    def read(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return vintages.open_loan_table(self.spark, path) if vintages.is_loan_table(self.spark, path) else self.spark.read.parquet(path)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.read(name)

    def write_loans(self, name: str, df: DataFrame, years: list[int] | None = None) -> DataFrame:
        """A table by vintage and loan; with ``years`` only their folders are replaced."""
        return vintages.write_loan_table(df, f"{self.root}/{name}", years)

    @contextmanager
    def stale(self, stage: str, sources: dict[str, str], settings: object, changed_only: bool, skipped: set[int] = frozenset()) -> Iterator[vintages.Changes]:
        """What a stage has to rebuild, by the files of its sources; all but ``skipped`` counts as built when the block ends without an error."""
        state = f"{self.root}/vintage_state/{stage}"
        found = vintages.changes(self.spark, {f"{self.root}/{p}": c for p, c in sources.items()}, state, repr(settings))
        yield found if changed_only else replace(found, changed=tuple(v for v, _ in found.stamps if v not in skipped))
        vintages.remember(self.spark, found, state, skipped)

    def report(self, name: str, df: DataFrame) -> DataFrame:
        sinks.write_report(df, f"{self.root}/reports/{name}")
        return df

    def reports(self, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            self.report(name, df)


def run_ingestion(job: Job, text_root: str, ingested_at: str, force: bool = False, quarantine: bool = False) -> Tables:
    """Delimited text under text_root/<dataset>/vintage_year=YYYY to typed Bronze partitions.

    A bad row width fails the job, or with ``quarantine`` goes to quarantine/<dataset>; either way no line is lost unseen.
    """
    out = {}
    for dataset in ("origination", "performance"):
        lines = job.spark.read.text(f"{text_root}/{dataset}")
        years = sinks.partition_years(job.spark, f"{text_root}/{dataset}")
        layouts = {layout_for(dataset, y) for y in years}
        if len(layouts) != 1:
            raise ValueError(f"{dataset}: read years of one layout at a time")
        lay = layouts.pop()
        lines = text.stored_lines(lines)
        if quarantine:
            job.write(f"quarantine/{dataset}", text.malformed(lines, lay))
        else:
            text.require_width(lines, lay)
        path = f"{job.root}/bronze/{dataset}"
        sinks.write_partitions(text.bronze(lines, lay, ingested_at), path, "_source_year", force)
        out[dataset] = job.read(f"bronze/{dataset}")
    job.report("bronze_metrics", quality.bronze_metrics(out["origination"], out["performance"]))
    job.report("referential", quality.referential(out["origination"], out["performance"]))
    return out


def _sketches(job: Job, dataset: str, table: DataFrame, force: bool, found: vintages.Changes | None) -> DataFrame:
    """Field sketches by year; only years without any, or those that changed, are read, all of them with ``force``."""
    path = f"{job.root}/silver_sketches/{dataset}"
    have = set() if force else {r[0] for r in sinks.existing_years(job.spark, path, "_source_year").collect()}  # one value per partition folder
    if found is not None:
        vintages.drop_vintages(job.spark, path, found.gone, "_source_year")
        have -= set(found.changed)
    fresh = table.where(~F.col("_source_year").isin(list(have))) if have else table
    sinks.write_partitions(quality.field_sketches(fresh), path, "_source_year", True)
    return job.read(f"silver_sketches/{dataset}")


def run_silver_build(job: Job, force: bool = False, changed_only: bool = False) -> Tables:
    """Missing years, with ``force`` all, or with ``changed_only`` those whose Bronze files changed since this job last built them."""
    folders = {d: (f"{job.root}/bronze/{d}", f"{job.root}/silver/{d}") for d in ("origination", "performance")}
    kept = set()
    if not (force or changed_only):
        kept = {y for _, path in folders.values() if vintages.exists(job.spark, path) for y in sinks.partition_years(job.spark, path, "_source_year")}
    with job.stale("silver", {"bronze/origination": "_source_year", "bronze/performance": "_source_year"}, None, changed_only, kept) as found:
        for dataset, clean in (("origination", silver.origination), ("performance", silver.performance)):
            bronze, path = job.read(f"bronze/{dataset}"), folders[dataset][1]
            if changed_only:
                sinks.write_partitions(clean(bronze.where(F.col("_source_year").isin(list(found.changed)))), path, "_source_year", True)
                held = sinks.partition_years(job.spark, folders[dataset][0], "_source_year")
                vintages.drop_vintages(job.spark, path, {*found.gone, *found.changed} - set(held), "_source_year")
            else:
                sinks.write_partitions(clean(bronze), path, "_source_year", force)
    o, p = job.read("silver/origination"), job.read("silver/performance")
    for name, df in (("origination_checks", quality.origination_checks(o)), ("performance_checks", quality.performance_checks(p)),
                     ("temporal_gaps", quality.temporal_gaps(p)), ("silver_summary", quality.silver_summary(o, p)),
                     ("without_performance", quality.without_performance(o, p))):
        job.report(name, df)
    sketches = {d: _sketches(job, d, x, force, found if changed_only else None) for d, x in (("origination", o), ("performance", p))}
    job.report("availability", reduce(DataFrame.unionByName, [quality.merged_availability(s, d, by_year) for d, s in sketches.items() for by_year in (True, False)]))
    return {"origination": o, "performance": p}


def run_mart_build(job: Job, changed_only: bool = False) -> Tables:
    """Static and monthly loan tables; with ``changed_only`` for the vintages whose Silver files changed and those that share a loan with them."""
    with job.stale("mart", {"silver/origination": "_source_year", "silver/performance": "_source_year"}, None, changed_only) as found:
        o, p = job.read("silver/origination"), job.read("silver/performance")
        loans = p.select("loan_id", F.col("_source_year").alias(vintages.VINTAGE))
        years = touched = None
        if changed_only and vintages.is_loan_table(job.spark, f"{job.root}/loan_index"):
            touched = sorted({*found.changed, *found.gone})
            loans = loans.where(F.col(vintages.VINTAGE).isin(touched))
            # Ties of the former delivery count as well: a loan that left a vintage changes its rows in the others.
            years = vintages.closed_over_loans(job.read("loan_index").unionByName(loans), touched)
            o, p = (x.where(F.col("_source_year").isin(years)) for x in (o, p))
        static = job.write_loans("loan_static", mart.loan_static(o), years)
        job.write_loans("loan_month", mart.loan_month(p, static if years is None else static.where(F.col(vintages.VINTAGE).isin(years))), years)
        job.write_loans("loan_index", loans.distinct(), touched)
    static, month = job.read("loan_static"), job.read("loan_month")
    for name, df in (("loan_month_profile", mart.vintage_profile(month)), ("feature_population", mart.feature_population(month)),
                     ("feature_distribution", mart.feature_distribution(month)),
                     ("mart_validation", mart.validation(static, month, mart.analytical(month, static)))):
        job.report(name, df)
    return {"loan_static": static, "loan_month": month}


def run_target_build(job: Job, changed_only: bool = False) -> Tables:
    """Labels and default episodes; with ``changed_only`` for the vintages of the monthly table that were rebuilt, all when the definition changed."""
    with job.stale("targets", {"loan_month": vintages.VINTAGE}, job.cfg.default, changed_only) as found:
        month, years = job.read("loan_month"), None
        if changed_only and vintages.is_loan_table(job.spark, f"{job.root}/default_events"):
            years = sorted({*found.changed, *found.gone})  # the monthly table is already closed over shared loans
            month = month.where(F.col(vintages.VINTAGE).isin(years))
        state = targets.row_state(month, job.cfg.default)
        tg = job.write_loans("pd_12m_targets", targets.targets(state, job.cfg.default), years)
        ev = job.write_loans("default_events", targets.default_events(state, job.cfg.default), years)
    job.report("default_summary", targets.default_summary(tg, ev))
    job.report("target_observability", targets.observability(tg))
    return {"pd_12m_targets": tg, "default_events": ev}


def run_vintage_update(job: Job) -> Tables:
    """Silver, mart and targets after a delivery: only changed vintages are read and rewritten, with the same result as a full build."""
    run_silver_build(job, changed_only=True)
    return run_mart_build(job, changed_only=True) | run_target_build(job, changed_only=True)


def run_development_sample_build(job: Job) -> Tables:
    dev = job.write("development", development.sample(job.read("pd_12m_targets"), job.cfg.development))
    job.report("split_profile", development.split_profile(dev))
    job.report("sample_profile", development.sample_profile(dev))
    return {"development": dev}


def run_scorecard(job: Job, categories: Sequence[str] = ()) -> Tables:
    """Bins and coefficients from TRAIN, scores for all splits. ``categories`` are binned by value beside the numeric features of the use."""
    use = "application_scoring" if job.cfg.development.population == "application" else "behavioural_scoring"
    features = features_for(use)
    view = mart.analytical(job.read("loan_month"), job.read("loan_static"))
    frame = job.write("model_frame", scorecard.model_frame(job.read("development"), view, [*features, *categories]))
    train = frame.where("split = 'TRAIN'")
    bins = scorecard.fit_bins(train, features, categories, job.cfg.scorecard)
    woe = scorecard.transform(frame, bins)
    names = [f"{f}_woe" for f in (*features, *categories)]
    a, b = scorecard.fit_logistic(woe.where("split = 'TRAIN'"), names, "target", "sample_weight")
    scored = scorecard.score_rows(woe, a, dict(zip(names, b)), job.cfg.scorecard)
    scored = job.write("scored_rows", scorecard.with_bands(scored, job.cfg.scorecard))
    job.write("bin_table", scorecard.bin_table(job.spark, bins, job.cfg.scorecard.suspicious_iv))
    job.write("coefficients", scorecard.coefficient_table(job.spark, a, dict(zip(names, b))))
    pd = "predicted_pd_raw"
    job.reports({"scorecard_metrics": metrics.binary_metrics(scored, ["split"], pd), "scorecard_deciles": metrics.decile_table(scored),
                 "scorecard_roc": metrics.roc_curve(scored, ["split"]), "scorecard_calibration": metrics.calibration_curve(scored),
                 "scorecard_lift": metrics.lift_table(scored), "scorecard_psi": metrics.psi_table(scored, ["score", *features]),
                 "scorecard_yearly": metrics.yearly(scored), "scorecard_bands": metrics.band_summary(scored)})
    return {"scored_rows": scored}


def compare_scorecards(runs: dict[str, Job]) -> DataFrame:
    """Accuracy of the stored scores of several run folders, by run and split."""
    return metrics.compare_runs({name: metrics.binary_metrics(job.read("scored_rows"), ["split"], "predicted_pd_raw") for name, job in runs.items()})


def run_pd_framework(job: Job) -> Tables:
    scored = job.read("scored_rows")
    calibrated = job.write("calibrated", pd_framework.fit_calibration(scored, job.cfg.pd).apply(scored))
    edges = pd_framework.boundary_edges(calibrated, job.cfg.pd)
    preds = job.write("pd_predictions", calibrated.withColumn("rating", pd_framework.rating_of(pd_framework.PD, edges)))
    found = pd_framework.event_foundation(preds, job.read("pd_12m_targets"))
    out = {"portfolio_ttc": pd_framework.portfolio_ttc(preds, job.cfg.pd), "rating_ttc": pd_framework.rating_ttc(preds, job.cfg.pd),
           "lifetime_curves": pd_framework.lifetime_curves(found, preds, job.cfg.pd)}
    written = {k: job.write(k, v) for k, v in out.items()}
    one, twelve = (pd_framework.transitions(preds, m) for m in (1, 12))
    job.reports({"pd_calibration_metrics": pd_framework.calibration_metrics(preds), "pd_rating_summary": pd_framework.rating_summary(preds),
                 "pd_pit_ttc": pd_framework.pit_ttc(preds, written["portfolio_ttc"]), "pd_hazards": pd_framework.empirical_hazards(found, job.cfg.pd),
                 "pd_transitions_1m": one, "pd_transitions_12m": twelve, "pd_transition_summary": pd_framework.transition_summary(twelve),
                 "pd_backtest": pd_framework.backtest(preds), "pd_backtest_splits": pd_framework.backtest_splits(preds),
                 "pd_calibration_curve": pd_framework.calibration_curve(preds)})
    return {"pd_predictions": preds} | written


def run_forward_looking(job: Job, series: DataFrame, cfg: macro.MacroConfig) -> Tables:
    """Macro table, correlation, both macro models and the scenario curves, from long (series, date, value) observations."""
    names = [f"{s}_yoy" if x.transform == "yoy_pct" else s for s, x in cfg.series.items()]
    table = job.write("macro", macro.aligned(macro.quarterly(series, cfg.series), names, cfg.start))
    ttc = job.read("portfolio_ttc").select(F.col("portfolio_ttc_pd").alias("ttc_pd"))
    history = macro.historical_default_rate(job.read("pd_predictions")).crossJoin(ttc)  # one-row right side
    grid = job.write("rho_grid", macro.rho_grid(history, cfg))
    rho = macro.selected_rho(grid)
    frame = macro.model_frame(history, table, rho, cfg.epsilon)
    factor, satellite = macro.fit_factor_model(frame), macro.fit_satellite(frame, cfg.ridge_strength)
    fits = job.write("macro_fits", macro.with_fits(frame, factor, satellite, F.col("ttc_pd"), rho))
    models = [(m, f, b) for m, x in (("factor", factor), ("satellite", satellite)) for f, b in (("INTERCEPT", x.intercept), *x.coefs.items())]
    implied = macro.with_systematic_factor(history, "systematic_factor", "observed_default_rate", "ttc_pd", F.lit(rho), cfg.epsilon)
    with_factor = job.write("macro_with_factor", table.join(implied.select("date", "systematic_factor"), "date", "left"))
    factors = job.write("scenario_factors", macro.scenario_factors(macro.scenario_paths(table, cfg), factor, satellite))
    spd = job.write("scenario_pd", macro.scenario_pd(job.read("rating_ttc"), factors, rho))
    curves = job.write("scenario_curves", macro.scenario_lifetime(job.read("lifetime_curves"), spd))
    weighted = job.write("weighted_curves", macro.weighted_lifetime(curves))
    job.reports({"macro_models": job.spark.createDataFrame(models, "model string, feature string, coefficient double"), "macro_diagnostics": macro.diagnostics(fits),
                 "macro_backtest": macro.backtest(fits), "macro_backtest_stress": macro.backtest(macro.stress_slice(fits, cfg)), "weighted_pd": macro.weighted_pd(spd),
                 "macro_inflation": job.spark.createDataFrame([(f, float(v)) for f, v in macro.variance_inflation(frame).items()], "feature string, vif double")})
    return {"macro": table, "rho_grid": grid, "macro_fits": fits, "macro_with_factor": with_factor, "scenario_factors": factors, "scenario_pd": spd,
            "scenario_curves": curves, "weighted_curves": weighted}


def simulate_macro_scenario(table: DataFrame, rating_ttc: DataFrame, factor: macro.LinearModel, satellite: macro.LinearModel, rho: float,
                            cfg: macro.MacroConfig) -> DataFrame:
    """Scenario PDs for any shocks with models already fitted."""
    return macro.scenario_pd(rating_ttc, macro.scenario_factors(macro.scenario_paths(table, cfg), factor, satellite), rho)


def run_lgd_framework(job: Job) -> Tables:
    """Episodes, all candidates, the pair of cure and severity model that ranks first on VALIDATION, combined LGD and downturn overlay."""
    from lossloom.plans import lgd_models
    cfg = job.cfg.lgd
    eps = job.write("lgd_episodes_raw", lgd.episodes(job.read("default_events"), job.read("loan_month"), job.read("loan_static"),
                                                     job.read("pd_predictions"), cfg))
    cure, cure_p_table = lgd_models.cure_challengers(eps)
    severity, sev_table = lgd_models.severity_challengers(eps)
    cure_lgd, cure_table = lgd_models.cure_lgd_candidates(eps)
    key = ["loan_id", "default_episode_id"]
    cures = {c.removeprefix("p_"): c for c in cure.columns if c.startswith("p_")}
    names = sorted(r[0] for r in sev_table.select("model").distinct().collect())  # one row per candidate
    severities = {n: f"s_{i}" for i, n in enumerate(names)}
    wide = severity.groupBy(*key).agg(*[F.max(F.when(F.col("model") == n, F.col("p"))).alias(c) for n, c in severities.items()])
    best_cure_lgd = cure_table.where("selected").select("model").distinct()  # one row
    df = eps.join(cure.select(*key, *[c for c in cure.columns if c.startswith(("p_", "raw_"))]), key).join(wide, key)
    df = job.write("lgd_candidates", df.join(cure_lgd.join(best_cure_lgd, "model").select(*key, F.col("p").alias("predicted_cure_lgd")), key))
    ranks = None
    for name, column in cures.items():  # one aggregate per cure candidate keeps the plan small
        part = lgd.combined_ranking(df, {name: column}, severities).drop("selection_rank")
        ranks = part if ranks is None else ranks.unionByName(part)
    ranks = job.write("lgd_selection", ranks)
    criteria = ("validation_abs_oe_error", "validation_cure_abs_calibration_error", "validation_non_cure_abs_oe_error", "validation_mae", "validation_rmse")
    best = ranks.orderBy(*[F.asc_nulls_last(c) for c in criteria], "cure_model", "severity_model").first()
    scored = lgd.combine(df.withColumns({
        "predicted_cure_probability_raw": F.col(f"raw_{best['cure_model']}"), "predicted_cure_probability": F.col(cures[best["cure_model"]]),
        "predicted_non_cure_lgd": F.col(severities[best["severity_model"]])}).drop(*cures.values(), *severities.values()))
    out = job.write("lgd_episodes", lgd.with_downturn(scored, lgd.downturn_factors(scored, cfg.downturn_method, cfg.downturn_window, cfg.downturn_quantile)))
    job.reports({"lgd_cure_candidates": cure_p_table, "lgd_severity_candidates": sev_table, "lgd_cure_lgd_candidates": cure_table, "lgd_model_metrics": lgd.model_metrics(out),
                 "lgd_backtest_splits": lgd.backtest_splits(out), "lgd_decomposition": lgd.decomposition(out), "lgd_recovery_timing": lgd.recovery_timing(out),
                 "lgd_resolutions": lgd.resolution_distribution(out), "lgd_loss_reconciliation": lgd.actual_loss_reconciliation(out),
                 "lgd_numeric_drift": lgd.numeric_drift(out, lgd.NUMERIC), "lgd_categorical_drift": lgd.categorical_drift(out, lgd.CATEGORICAL),
                 "lgd_segmentation": lgd.segmentation(out, lgd.CATEGORICAL), "lgd_cure_ltv_audit": lgd.cure_ltv_audit(out), "lgd_cashflows": lgd.cashflow_summary(out),
                 "lgd_component_audit": lgd.component_audit(out), "lgd_distribution": lgd.distribution(out), "lgd_population": lgd.population_summary(out)})
    return {"lgd_episodes": out, "lgd_selection": ranks}


def run_lgd_forward_looking(job: Job, cfg: lgd_overlay.OverlayConfig, cure_lgd: Column | None = None) -> Tables:
    """Overlay on resolved episodes, scenario and weighted LGD by rating, shift grid and backtests, from the tables of ``run_forward_looking``.

    With ``cure_lgd``, a column over stressed_ltv, the scenario LGD with restated loan-to-value is written as well.
    """
    eps, paths = job.read("lgd_episodes").where("resolved_flag"), job.read("scenario_factors")
    with_factor = job.read("macro_with_factor")
    history = job.write("lgd_regimes", lgd_overlay.regimes(eps, with_factor, cfg))
    o = lgd_overlay.overlay(job.write("lgd_overlay_fit", lgd_overlay.fit(history)))
    forward = job.write("lgd_forward", lgd_overlay.apply_overlay(eps, with_factor, o, cfg))
    base = job.write("lgd_rating_base", lgd_overlay.rating_base(eps))
    by_scenario = job.write("lgd_scenario", lgd_overlay.scenario_lgd(base, paths, o.multiplier(cfg)))
    out = {"lgd_forward": forward, "lgd_scenario": by_scenario, "lgd_weighted": job.write("lgd_weighted", lgd_overlay.weighted(by_scenario))}
    if cure_lgd is not None:
        out["lgd_stressed_ltv"] = job.write("lgd_stressed_ltv", lgd_overlay.stressed_ltv_lgd(eps, paths, cure_lgd))
    job.reports({"lgd_sensitivity": lgd_overlay.sensitivity(eps, base, paths, o, cfg), "lgd_relationships": lgd_overlay.relationships(history),
                 "lgd_forward_backtest": lgd_overlay.backtest(forward, ["split"]), "lgd_forward_backtest_rating": lgd_overlay.backtest(forward, ["split", "rating_at_default"]),
                 "lgd_cure_diagnostics": lgd_overlay.cure_diagnostics(forward), "lgd_scenario_order": lgd_overlay.ordering(by_scenario)})
    return out


def simulate_lgd_scenario(eps: DataFrame, paths: DataFrame, o: lgd_overlay.Overlay, cfg: lgd_overlay.OverlayConfig, cure_lgd: Column | None = None) -> DataFrame:
    """Weighted LGD on other paths: by the overlay, or with ``cure_lgd`` (a column over stressed_ltv) by restated loan-to-value."""
    if cure_lgd is not None:
        return lgd_overlay.weighted(lgd_overlay.stressed_ltv_lgd(eps, paths, cure_lgd))
    return lgd_overlay.weighted(lgd_overlay.scenario_lgd(lgd_overlay.rating_base(eps), paths, o.multiplier(cfg)))


def run_ead_framework(job: Job) -> Tables:
    view = mart.analytical(job.read("loan_month"), job.read("loan_static"))
    obs = ead.observations(view, job.read("pd_12m_targets"), job.read("default_events"), job.cfg.ead)
    obs = job.write("ead_observations", ead.baselines(ead.with_targets(ead.with_rating(obs, job.read("pd_predictions")), job.cfg.ead)))
    pipe, model = ead.fit_ratio_model(obs)

    def ratio_at(df: DataFrame, name: str, months: Column) -> DataFrame:
        """The model's ratio with another horizon; all other predictors as they are."""
        moved = df.withColumnRenamed("months_to_horizon", "_kept").withColumn("months_to_horizon", months)
        done = with_prediction(model, pipe.transform(moved), name).drop("features", "months_to_horizon")
        return done.withColumnRenamed("_kept", "months_to_horizon")

    scored = ead.with_ratio(with_prediction(model, pipe.transform(obs), "_ratio"), F.col("_ratio"), job.cfg.ead)
    scored = job.write("ead_scored", scored.drop("features", "_ratio"))
    # The model is linear in the horizon, so two of its values give the ratio of every month.
    latest = ead.latest_open(obs)
    latest = ratio_at(ratio_at(latest, "ratio_at_start", F.lit(0.0)), "_next", F.lit(1.0))
    base = job.write("ead_profile_base", ead.profile_terms(latest.withColumn("ratio_per_month", F.col("_next") - F.col("ratio_at_start")), ("ratio_at_start", "ratio_per_month")))
    ratio = F.col("ratio_at_start") + F.col("ratio_per_month") * F.col("months_to_horizon")
    profiles = job.write("ead_profiles", ead.profiles(base, ratio, job.cfg.ead))
    job.reports({"ead_backtest_splits": ead.backtest_splits(scored, job.cfg.ead), "ead_backtest_segments": ead.backtest_segments(scored, job.cfg.ead),
                 "ead_ratio_distribution": ead.ratio_distribution(scored), "ead_population": ead.population_summary(scored),
                 "ead_target_reconciliation": ead.target_reconciliation(scored), "ead_profile_validation": ead.profile_validation(profiles),
                 "ead_mean_profile": ead.mean_profile(base, ratio, job.cfg.ead, ("ratio_at_start", "ratio_per_month"))})
    return {"ead_scored": scored, "ead_profiles": profiles}


def run_staging(job: Job) -> Tables:
    base = staging.staging_base(job.read("pd_predictions"), job.read("loan_month"), job.read("loan_static"), job.read("pd_12m_targets"),
                                job.read("default_events"))
    staged = job.write("staging", staging.allocate(base, job.cfg.staging))
    job.reports({"stage_distribution": staging.distribution(staged), "stage_by_year_rating": staging.distribution_by_year_rating(staged),
                 "threshold_sensitivity": staging.sensitivity(staged, job.cfg.staging), "triggers": staging.trigger_distribution(staged),
                 "trigger_exclusivity": staging.trigger_exclusivity(staged), "stage3_audit": staging.stage3_audit(staged),
                 "pd_changes": staging.pd_change_distribution(staged), "reference_lags": staging.reference_lag(staged), "stage_migrations": staging.migrations(staged)})
    return {"staging": staged}


def simulate_sicr_thresholds(staged: DataFrame, settings: Settings, **overrides) -> DataFrame:
    return staging.simulate(staged, settings.staging, **overrides)


def simulate_ecl(job: Job, **overrides) -> DataFrame:
    """Loan-level losses under changed settings, nothing written."""
    cfg = replace(job.cfg.ecl, **overrides)
    return ecl.run(job.read("staging"), job.read("loan_month"), job.read("loan_static"), job.read("lgd_episodes"), job.read("scenario_curves"), cfg)


def run_ecl(job: Job) -> Tables:
    out = job.write("ecl", simulate_ecl(job))
    for k in ("stage", "rating", "vintage_year", "property_state"):
        job.report(f"ecl_by_{k}", ecl.summary(out, [k]))
    job.reports({"downturn_sensitivity": ecl.downturn_sensitivity(out), "ecl_scenarios": ecl.scenario_summary(out), "ecl_reconciliation": ecl.reconciliation(out),
                 "ecl_explainability": ecl.explainability(out), "ecl_alignment_warnings": ecl.alignment_warnings(out, job.cfg.ecl), "ecl_kpis": ecl.kpis(out)})
    return {"ecl": out}


def run_scenario(job: Job, s: scenario.Scenario, base_rho: float | None = None) -> Tables:
    book = scenario.state(job.read("staging"), job.read("loan_month"), job.read("loan_static"), job.read("lgd_episodes"), job.cfg.ecl)
    curves = ecl.selected_curves(job.read("scenario_curves"), job.cfg.ecl.reporting_date)
    out = job.write(f"scenario_{s.name}", scenario.stressed(book, curves, s, job.cfg.ecl, base_rho))
    job.report(f"scenario_{s.name}_waterfall", scenario.waterfall(book, curves, s, job.cfg.ecl, base_rho))
    return {s.name: out}


def compare_scenarios(job: Job, scenarios: list[scenario.Scenario]) -> DataFrame:
    out = None
    for s in scenarios:
        part = scenario.outcome(job.read("ecl"), job.read(f"scenario_{s.name}"), s)
        out = part if out is None else out.unionByName(part)
    return out
