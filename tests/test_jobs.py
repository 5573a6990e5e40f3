"""The jobs end to end on delimited text with blanks, sentinels and rows of the wrong width."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lossloom.config import Settings
from lossloom.operators import ead, lgd_overlay, macro, mart, scenario
from lossloom.plans import demo, jobs
from lossloom.sources import text
from lossloom.sources.schemas import layout_for
from lossloom.sources.store import Stages

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    t = Stages(spark, SF_DIR)
    for dataset, name in (("origination", "raw_orig"), ("performance", "raw_perf")):
        t(name).write.partitionBy("vintage_year").text(f"{root}/text/{dataset}")
    return t, jobs.Job(spark, f"{root}/run", Settings()), f"{root}/text"


def test_text_to_exposure(run, spark):
    t, job, source = run
    with pytest.raises(ValueError, match="columns; first"):
        jobs.run_ingestion(job, source, "2001-09-01T00:00:00+00:00")
    bronze = jobs.run_ingestion(job, source, "2001-09-01T00:00:00+00:00", quarantine=True)
    lines = spark.read.text(f"{source}/performance")
    bad = job.read("quarantine/performance").count()
    assert bad > 0 and lines.count() == bronze["performance"].count() + bad
    jobs.run_silver_build(job)
    sketches = {r[0] for r in job.read("silver_sketches/performance").select("_source_year").distinct().collect()}
    assert sketches == {r[0] for r in job.read("silver/performance").select("_source_year").distinct().collect()}
    jobs.run_silver_build(job)  # a second run finds every year sketched
    report = spark.read.option("header", True).csv(f"{job.root}/reports/availability")
    assert report.where("year IS NULL AND field = 'loan_id' AND dataset = 'origination'").first()["row_count"] == str(job.read("silver/origination").count())
    m = jobs.run_mart_build(job)
    view = mart.analytical(m["loan_month"], m["loan_static"])
    job.write("analytical", view)
    assert len(view.columns) == len(set(view.columns)) and job.read("analytical").count() == m["loan_month"].count()
    # Blank codes of the text are missing, as nulls of the panel are.
    share = {n: df.agg(F.avg(F.col("current_assistance_flag").cast("int"))).first()[0] for n, df in (("text", m["loan_month"]), ("panel", t("mart")))}
    assert 0 < share["text"] < 0.2 and abs(share["text"] - share["panel"]) < 0.01
    jobs.run_target_build(job)
    assert jobs.run_development_sample_build(job)["development"].count() > 0
    scored = jobs.run_scorecard(job, ("channel",))["scored_rows"]
    assert job.read("coefficients").where("feature = 'channel_woe' OR feature = 'channel'").count() == 1
    compared = jobs.compare_scorecards({"first": job, "again": job})
    assert compared.count() == 2 * scored.select("split").distinct().count()
    jobs.run_pd_framework(job)
    lgd = jobs.run_lgd_framework(job)
    assert lgd["lgd_selection"].count() > 10 and lgd["lgd_episodes"].where("lgd_downturn < lgd_base OR lgd_base IS NULL").count() == 0
    jobs.run_staging(job)
    for name in ("scorecard_roc", "scorecard_psi", "pd_transitions_12m", "pd_backtest", "lgd_model_metrics", "lgd_component_audit", "stage_migrations"):
        assert spark.read.option("header", True).csv(f"{job.root}/reports/{name}").count() > 0
    scored = jobs.run_ead_framework(job)["ead_scored"]
    assert scored.where("predicted_ead_empirical_model IS NULL").count() == 0
    life = job.read("pd_12m_targets").where("eligible_for_lifetime_pd AND (event_default OR event_prepayment_or_exit)")
    open_ = job.read("loan_month").where("current_actual_upb > 0 AND coalesce(zero_balance_code, '') = ''")
    assert scored.count() == life.join(open_, ["loan_id", "as_of_date"]).count()
    loans = scored.where("current_actual_upb > 0").select("loan_id").distinct().count()
    assert job.read("ead_profiles").count() == loans * (job.cfg.ead.max_months + 1)
    check = spark.read.option("header", True).csv(f"{job.root}/reports/ead_profile_validation").first()
    assert int(check["month_zero_rows"]) == loans and check["negative_ead_rows"] == "0" and float(check["month_zero_current_equals_modelled"]) == 1.0
    assert spark.read.option("header", True).csv(f"{job.root}/reports/ead_mean_profile").count() == job.cfg.ead.max_months + 1
    # The ratio of a profile at the horizon of its own row is the model's ratio of that row.
    base = job.read("ead_profile_base").join(scored.select("loan_id", "as_of_date", "predicted_ead_ratio_empirical"), ["loan_id", "as_of_date"])
    line = F.col("ratio_at_start") + F.col("ratio_per_month") * F.col("months_to_horizon")
    off = F.abs(F.least(F.greatest(line, F.lit(job.cfg.ead.lower)), F.lit(job.cfg.ead.upper)) - F.col("predicted_ead_ratio_empirical"))
    assert base.where("months_to_horizon IS NOT NULL").count() > 0 and base.where("months_to_horizon IS NOT NULL").where(off > 1e-6).count() == 0


def test_macro_to_stressed_loss(run, spark):
    """Goes on from the tables of the test before."""
    t, job, _ = run

    def report(name):
        return spark.read.option("header", True).csv(f"{job.root}/reports/{name}")

    out = jobs.run_forward_looking(job, demo.monthly_series(t), macro.MacroConfig())
    grades = job.read("rating_ttc").select("rating").distinct().count()
    assert out["weighted_curves"].count() * out["scenario_pd"].select("scenario").distinct().count() == out["scenario_curves"].count()
    assert out["scenario_pd"].select("rating").distinct().count() == grades
    assert out["scenario_pd"].where("pit_pd_12m < 0 OR pit_pd_12m > 1 OR pit_pd_12m IS NULL").count() == 0
    for name in ("macro_models", "macro_diagnostics", "macro_backtest", "macro_backtest_stress", "macro_inflation", "weighted_pd"):
        assert report(name).count() > 0, name

    cure = F.expr("0.02e0 + 0.0005e0 * coalesce(stressed_ltv, 70)")
    lgds = jobs.run_lgd_forward_looking(job, lgd_overlay.OverlayConfig(), cure)
    assert set(lgds) == {"lgd_forward", "lgd_scenario", "lgd_weighted", "lgd_stressed_ltv"}
    assert lgds["lgd_forward"].count() == job.read("lgd_episodes").where("resolved_flag").count()
    assert lgds["lgd_weighted"].where("abs(scenario_weight_sum - 1) > 1e-9").count() == 0 and lgds["lgd_stressed_ltv"].count() > 0
    for name in ("lgd_sensitivity", "lgd_relationships", "lgd_forward_backtest", "lgd_forward_backtest_rating", "lgd_cure_diagnostics", "lgd_scenario_order",
                 "lgd_numeric_drift", "lgd_categorical_drift", "lgd_segmentation", "lgd_cure_ltv_audit"):
        assert report(name).count() > 0, name
    eps = job.read("lgd_episodes").where("resolved_flag")
    o = lgd_overlay.overlay(job.read("lgd_overlay_fit"))
    same = jobs.simulate_lgd_scenario(eps, job.read("scenario_factors"), o, lgd_overlay.OverlayConfig()).join(
        lgds["lgd_weighted"].select("date", "rating", F.col("probability_weighted_lgd").alias("stored")), ["date", "rating"])
    assert same.count() == lgds["lgd_weighted"].count() and same.where("abs(probability_weighted_lgd - stored) > 1e-9").count() == 0
    assert jobs.simulate_lgd_scenario(eps, job.read("scenario_factors"), o, lgd_overlay.OverlayConfig(), cure).count() == lgds["lgd_weighted"].count()

    loss = jobs.run_ecl(job)["ecl"]
    assert loss.count() > 0 and loss.where("ecl_weighted IS NULL OR ecl_weighted < 0").count() == 0
    total = loss.agg(F.sum("ecl_weighted")).first()[0]
    assert abs(float(report("ecl_kpis").first()["weighted_ecl"]) / total - 1) < 1e-9
    for name in ("ecl_scenarios", "ecl_reconciliation", "ecl_explainability", "ecl_alignment_warnings", "downturn_sensitivity"):
        assert report(name).count() > 0, name
    calm = scenario.Scenario(name="calm")
    hard = scenario.Scenario(name="hard", relative_pd=1.5, lgd_method="downturn", ead_multiplier=1.05)
    for s in (calm, hard):
        jobs.run_scenario(job, s)
        assert report(f"scenario_{s.name}_waterfall").count() > 0
    rows = {r["scenario"]: r for r in jobs.compare_scenarios(job, [calm, hard]).collect()}
    assert abs(rows["calm"]["delta_ecl"]) < 1e-6 * total and rows["hard"]["delta_ecl"] > 0


def test_every_loan_has_a_profile(run):
    t, _, _ = run
    base = ead.profile_base(t("ead"))
    assert base.count() == t("ead").where("current_actual_upb > 0").select("loan_id").distinct().count()


def test_row_numbers_need_no_shuffle_of_the_text(run, spark):
    t, _, source = run
    lines = spark.read.text(f"{source}/performance")
    rows = text.with_row_numbers(lines)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0] and "Window" not in plan
    per_file = rows.groupBy("_source_member").agg(F.count(F.lit(1)).alias("n"), F.min("_source_row_number").alias("lo"), F.max("_source_row_number").alias("hi"),
                                                  F.countDistinct("_source_row_number").alias("d")).collect()
    assert all(r["lo"] == 1 and r["hi"] == r["n"] == r["d"] for r in per_file)
    one = text.malformed(lines, layout_for("performance", 1995)).first()
    path = one["_source_member"].removeprefix("file://").removeprefix("file:")
    with open(path) as f:
        assert f.read().split("\n")[one["_source_row_number"] - 1] == one["value"]
