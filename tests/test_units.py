"""Operators on small hand-made tables with known answers."""

from __future__ import annotations

import math
import random
import re
from datetime import date
from statistics import NormalDist

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lossloom.config import DefaultDefinition, Development, ECL, Scorecard, Staging, Windows
from lossloom.functions.curves import hazard_scale, with_survival
from lossloom.functions.exprs import with_norm_cdf, with_norm_ppf
from lossloom.functions.joins import latest_on_or_before
from lossloom.functions.ranks import exact_quantiles, global_rank, ranking_metrics, running_totals
from lossloom.operators import development, ead, ecl, lgd, macro, mart, quality, scenario, scorecard, silver, staging, targets
from lossloom.operators.features import REGISTRY, counts_by, features_by_availability, forbid_outcomes
from lossloom.plans import jobs
from lossloom.sources import schemas, sinks, store, text

CFG = DefaultDefinition(reporting_cutoff=date(2027, 3, 1))


def state_frame(spark):
    """Six loans: default, prepayment, censored, cure and redefault after a gap, credit event, loss field only."""
    rows = [("L1", 1, 0, None), ("L1", 2, 0, None), ("L1", 3, 3, None), ("L2", 1, 0, None), ("L2", 2, 0, "01"), ("L3", 11, 0, None),
            ("L4", 1, 3, None), ("L4", 2, 0, None), ("L4", 3, 0, None), ("L4", 4, 0, None), ("L4", 6, 3, None), ("L5", 1, 0, "09"),
            ("L6", 1, 0, None)]
    data = [(k, 2026, date(2026, m, 1), 2026 * 12 + m, d, str(d), z, None, False) for k, m, d, z in rows]
    return spark.createDataFrame(data, "loan_id string, vintage_year long, as_of_date date, month_index long, delinquency_months long, "
                                 "delinquency_status_raw string, zero_balance_code string, zero_balance_effective_date date, "
                                 "has_reporting_gap_to_date boolean")


def test_targets(spark):
    t = {(r.loan_id, r.as_of_date.month): r for r in targets.targets(targets.row_state(state_frame(spark), CFG), CFG).collect()}
    assert t["L1", 1].default_next_12m == 1 and t["L1", 1].months_to_default_from_observation == 2
    assert t["L1", 3].default_flag and not t["L1", 3].eligible_for_12m_pd and t["L1", 3].default_next_12m is None
    assert t["L2", 1].event_type == "Prepaid or Matured" and t["L2", 1].default_next_12m == 0
    assert t["L3", 11].default_next_12m is None and not t["L3", 11].target_12m_observable
    assert t["L5", 1].default_reason == "REO_DISPOSITION"
    assert not t["L6", 1].default_flag


def test_episodes(spark):
    e = targets.default_events(targets.row_state(state_frame(spark), CFG), CFG).where("loan_id = 'L4'").orderBy("default_episode_id").collect()
    assert [(r.default_entry_date.month, r.cure_date and r.cure_date.month, r.redefault_flag) for r in e] == [(1, 3, False), (6, None, True)]
    strict = DefaultDefinition(reporting_cutoff=date(2027, 3, 1), cure_counting="strict")
    e = targets.default_events(targets.row_state(state_frame(spark), strict), strict).where("loan_id = 'L4'").orderBy("default_episode_id").collect()
    assert e[0].cure_date.month == 4


def test_future_moves_labels_only(spark):
    base = state_frame(spark)
    changed = base.withColumn("delinquency_months", F.when((F.col("loan_id") == "L1") & (F.month("as_of_date") == 3), 0).otherwise(F.col("delinquency_months")))
    a, b = (targets.targets(targets.row_state(x, CFG), CFG).where("loan_id = 'L1' AND month(as_of_date) = 1").first() for x in (base, changed))
    assert a.default_flag == b.default_flag and a.eligible_for_12m_pd == b.eligible_for_12m_pd
    assert a.default_next_12m == 1 and b.default_next_12m == 0


def perf_frame(spark, rows):
    cols = ("loan_id string, vintage_year long, period date, loan_age long, remaining_months_to_legal_maturity long, current_actual_upb double, "
            "current_interest_rate double, delinquency_months long, current_loan_delinquency_status string, delinquency_status_type string, "
            "modification_flag string, payment_deferral_flag string, borrower_assistance_status_code string")
    data = [(k, 2026, date(2026, m, 1), m, 300, u, 5.0, d, str(d), "N", mod, None, None) for k, m, u, d, mod in rows]
    static = spark.createDataFrame([(k, 2026, date(2025, 12, 1), date(2026, 1, 1), date(2055, 12, 1), 100.0, 5.0) for k in ("L1", "L2")],
                                   "loan_id string, vintage_year long, origination_date date, first_payment_date date, maturity_date date, "
                                   "original_upb double, original_interest_rate double")
    return spark.createDataFrame(data, cols), static


def test_mart_uses_the_calendar_and_no_future(spark):
    rows = [("L1", 1, 100.0, 0, None), ("L1", 3, 90.0, 2, "Y"), ("L2", 2, 80.0, 0, None)]
    perf, static = perf_frame(spark, rows)
    m = {(r.loan_id, r.as_of_date.month): r for r in mart.loan_month(perf, static).collect()}
    r = m["L1", 3]
    assert r.delinquency_months_lag_1 is None and r.has_reporting_gap_to_date and r.max_delinquency_months_to_date == 2
    assert r.months_since_last_delinquency == 0 and r.months_since_last_modification == 0 and r.max_delinquency_last_3m == 2
    assert not m["L1", 1].has_reporting_gap_to_date and m["L1", 1].months_on_book_derived == 1
    later, _ = perf_frame(spark, rows + [("L1", 4, 10.0, 9, None)])
    again = {(x.loan_id, x.as_of_date.month): x for x in mart.loan_month(later, static).collect()}
    assert again["L1", 3] == r


def test_running_totals_and_quantiles(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 97).cast("double").alias("v"))
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 1.0]).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.1, 0.5, 1.0)))).alias("q")).collect()}
    assert all(got[g] == pytest.approx(want[g]) for g in want)
    d = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    bad = running_totals(d, ["g"], ["v"], ["n"]).withColumn("x", F.sum("n").over(w)).where("x <> n_cum")
    assert bad.isEmpty()
    r = global_rank(df.withColumn("k", F.monotonically_increasing_id()), ["g"], "v", ["k"])
    assert r.groupBy("g").agg(F.countDistinct("rn").alias("a"), F.max("rn").alias("b"), F.first("n").alias("n")).where("a <> n OR b <> n").isEmpty()
    prev = F.lag("v").over(Window.partitionBy("g").orderBy("rn"))
    assert r.withColumn("p", prev).where("p > v").isEmpty()


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0, 0.01, 1.0), (1, 0, 0.2, 2.0), (1, 1, 0.5, 1.0), (1, 1, 0.9, 2.0)], "g int, y int, p double, w double")
    r = ranking_metrics(df, ["g"], "p", "y", "w").first()
    assert (r.roc_auc, r.gini, r.ks, r.pr_auc) == pytest.approx((1.0, 1.0, 1.0, 1.0))


def test_bins_are_monotone_and_frozen(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") >= 50, 1).otherwise(0).alias("target"), F.lit(1.0).alias("sample_weight"))
    bins = scorecard.fit_bins(df, ["x"], [], Scorecard())["x"]
    rates = [b.bad_rate for b in bins]
    assert rates == sorted(rates) and all(math.isfinite(b.woe) for b in bins)
    out = scorecard.transform(df.unionByName(df.limit(1).withColumn("x", F.lit(None).cast("double"))), {"x": bins})
    assert out.where("x IS NULL").first().x_woe == bins[0].woe and out.where("x_woe IS NULL").isEmpty()


def test_small_bins_join_their_neighbour():
    bins = [scorecard.Bin("f", "", n, 1.0, n - 1.0, i, i + 1) for i, n in enumerate((50, 1, 40, 1))]
    got = scorecard.merge_small(bins, 92, Scorecard(min_bin_pct=0.05))
    assert [b.rows for b in got] == [50, 42] and got[-1].upper == 4


def test_windows_must_not_overlap():
    with pytest.raises(ValueError):
        Windows(train=(date(2020, 1, 1), date(2021, 1, 1)), validation=(date(2020, 6, 1), date(2021, 6, 1)), oot=(date(2022, 1, 1), date(2022, 2, 1)))


def test_sampling_is_deterministic(spark):
    df = spark.range(4000).select(F.col("id").alias("loan_id"), F.lit(date(1996, 3, 1)).alias("as_of_date"), F.lit("TRAIN").alias("split"),
                                  F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("default_next_12m"))
    cfg = Development(sampling="random_nondefault", nondefault_fraction=0.25)
    s = development.sampling(df, cfg).where("deterministic_random <= sampling_probability")
    a, b = s.groupBy("default_next_12m").count().collect(), s.groupBy("default_next_12m").count().collect()
    counts = {r[0]: r[1] for r in a}
    assert sorted(a) == sorted(b) and counts[1] == 400 and 800 < counts[0] < 1000


def test_normal_functions(spark):
    xs = [-6.0, -1.5, 0.0, 0.3, 2.0, 7.5]
    for r in with_norm_cdf(spark.createDataFrame([(x,) for x in xs], "x double"), "y", "x").collect():
        assert r.y == pytest.approx(NormalDist().cdf(r.x), abs=1e-12)
    for r in with_norm_ppf(spark.createDataFrame([(p,) for p in (1e-6, 0.01, 0.2, 0.5, 0.98, 0.9999)], "p double"), "y", "p").collect():
        assert r.y == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-7, abs=1e-9)


def test_factor_inverts_pd(spark):
    df = spark.createDataFrame([(0.02, 0.05)], "ttc double, obs double")
    z = macro.with_systematic_factor(df, "z", "obs", "ttc", F.lit(0.1), 1e-6)
    assert macro.with_vasicek_pd(z, "p", "ttc", "z", 0.1).first().p == pytest.approx(0.05, rel=1e-6)
    with pytest.raises(ValueError):
        macro.with_vasicek_pd(z, "p", "ttc", "z", 1.5)


def test_nnls_matches_plain_least_squares_when_it_is_positive():
    import numpy as np
    g, b = np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([1.0, -2.0])
    # With the second coefficient held at 0 the first solves 2 x = 1.
    assert macro.nonnegative_least_squares(g, g @ b) == pytest.approx([0.5, 0.0], abs=1e-9)
    assert macro.nonnegative_least_squares(g, g @ np.array([1.0, 2.0])) == pytest.approx([1.0, 2.0])


def test_hazard_scale_and_survival(spark):
    df = spark.createDataFrame([([0.01] * 12, 0.2), ([0.01] * 12, 0.0)], "h array<double>, goal double").withColumn("f", hazard_scale(F.col("h"), F.col("goal")))
    f = [r.f for r in df.orderBy("goal").collect()]
    assert f[0] == 0.0 and 1 - (1 - 0.01 * f[1]) ** 12 == pytest.approx(0.2)
    c = spark.range(1, 25).select(F.lit("R1").alias("rating"), F.col("id").alias("month"), F.lit(0.02).alias("conditional_pd"))
    last = with_survival(c, ["rating"]).orderBy(F.desc("month")).first()
    assert last.cumulative_pd == pytest.approx(1 - 0.98 ** 24) and last.marginal_pd == pytest.approx(0.98 ** 23 * 0.02)


def test_annuity(spark):
    df = spark.createDataFrame([(100.0, 12.0, 2, 1), (100.0, 0.0, 4, 1), (100.0, 6.0, 2, 2)], "b double, r double, n int, h int")
    got = [r[0] for r in df.select(ead.contractual_balance(*[F.col(c) for c in "brnh"])).collect()]
    assert got == pytest.approx([50.248756, 75.0, 0.0], abs=1e-6)


def test_leakage_guard():
    with pytest.raises(ValueError):
        forbid_outcomes(["original_ltv", "actual_loss"], lgd.OUTCOMES)
    assert lgd.validated_predictors() and ead.validated_predictors()


def test_latest_on_or_before(spark):
    a = spark.createDataFrame([(1, date(2026, 3, 1)), (1, date(2026, 1, 1)), (2, date(2026, 1, 1))], "k int, d date")
    b = spark.createDataFrame([(1, date(2026, 2, 1), "R1"), (1, date(2026, 3, 1), "R2")], "k int, pd date, rating string")
    got = {(r.k, r.d.month): r.rating for r in latest_on_or_before(a, b, "k", "d", "pd", ["rating"]).collect()}
    assert got == {(1, 3): "R2", (1, 1): None, (2, 1): None}


def staged(spark, pds, months=None, default=()):
    months = months or list(range(1, len(pds) + 1))
    rows = [("A", date(2026, m, 1), 100.0, p, "R1", 0, False, False, False, m in default, date(2026, 1, 1), 0.01, "R1") for m, p in zip(months, pds)]
    df = spark.createDataFrame(rows, "loan_id string, as_of_date date, ead_current double, pd_current double, rating_current string, delinquency_months int, "
                               "ever_modified_to_date boolean, ever_assistance_to_date boolean, current_assistance_flag boolean, active_default_state boolean, "
                               "sicr_reference_date date, sicr_reference_pd double, sicr_reference_rating string")
    return [r.stage for r in staging.allocate(df, Staging()).orderBy("as_of_date").collect()]


def test_stage_cure_path(spark):
    assert staged(spark, [0.03, 0.012, 0.011, 0.010]) == [2, 2, 2, 1]
    assert staged(spark, [0.03, 0.012, 0.011], months=[1, 3, 4]) == [2, 1, 1]  # a gap ends the hold
    assert staged(spark, [0.03, 0.012, 0.011], default=(2,)) == [2, 3, 1]


def ecl_inputs(spark):
    loans = spark.createDataFrame([(i, s, "R1", 100.0, 0.5, 6.0, 24) for i, s in ((1, 1), (2, 2), (3, 3))],
                                  "loan_id int, stage int, rating string, ead double, lgd double, current_interest_rate double, remaining_months_to_maturity int")
    curves = spark.createDataFrame([(s, "R1", m, p, w) for s, p, w in (("BASE", 0.01, 0.5), ("DOWNSIDE", 0.02, 0.3), ("UPSIDE", 0.005, 0.2)) for m in range(1, 25)],
                                   "scenario string, rating string, month int, marginal_pd double, scenario_weight double")
    return loans, curves


def test_unit_loss_equals_the_month_loop(spark):
    loans, curves = ecl_inputs(spark)
    got = {r.stage: r for r in ecl.score(loans, curves, ECL()).collect()}

    def loop(h, pd):
        r, n = 0.06 / 12, 24
        return sum(pd * 50 * ((1 + r) ** n - (1 + r) ** m) / ((1 + r) ** n - 1) * (1 + r) ** -m for m in range(1, h + 1))

    assert got[1].ecl_base == pytest.approx(loop(12, 0.01)) and got[2].ecl_downside == pytest.approx(loop(24, 0.02))
    assert got[3].ecl_base == pytest.approx(50.0) and got[2].ecl_weighted == pytest.approx(loop(24, 0.01 * 0.5 + 0.02 * 0.3 + 0.005 * 0.2))
    with pytest.raises(ValueError):
        ecl.scenario_weights(curves.where("scenario <> 'BASE'"))


def test_pick_shares_takes_the_exact_number(spark):
    df = spark.range(2000).withColumnRenamed("id", "loan_id").withColumn("stage", F.when(F.col("loan_id") < 500, 3).otherwise(1))
    out = scenario.pick_shares(df, F.col("stage") != 3, {"a": 0.1, "b": 0.0333, "none": 0.0, "all": 1.0}, 7)
    r = out.agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in ("a", "b", "none", "all")], F.count(F.lit(1)).alias("n")).first()
    assert (r.a, r.b, r.none, r["all"], r.n) == (150, 50, 0, 1500, 2000)
    assert out.where("a AND stage = 3").isEmpty()


def test_shocks_raise_the_scale():
    s = scenario.Scenario
    assert scenario.pd_scale(s(), 0.1) == 1.0 and scenario.pd_scale(s(unemployment=2.0), 0.1) > scenario.pd_scale(s(unemployment=1.0), 0.1)
    with pytest.raises(ValueError):
        s(weights={"BASE": 0.5})


def test_silver_rules(spark):
    df = spark.createDataFrame([("F26Q3000001", 9999, "202601", "RA", 2026), ("bad", 700, "202613", "3", 2026), ("F26Q1000002", None, "2026", "zz", 2026)],
                               "loan_id string, credit_score int, d string, current_loan_delinquency_status string, _source_year int")
    r = df.select(silver.status("credit_score").alias("s"), silver.without_sentinels("credit_score").alias("v"), silver.month_from_text("d").alias("d"),
                  silver.delinquency_months().alias("m"), silver.delinquency_type().alias("t"), silver.month_from_loan_id().alias("o")).collect()
    assert [x.s for x in r] == ["NOT_AVAILABLE", "VALID_VALUE", "NOT_APPLICABLE"] and [x.v for x in r] == [None, 700, None]
    assert [x.d for x in r] == [date(2026, 1, 1), None, None] and [x.m for x in r] == [None, 3, None]
    assert [x.t for x in r] == ["REO_ACQUISITION", "NUMERIC_DELINQUENCY_STATUS", "UNKNOWN_SPECIAL_STATUS"]
    assert [x.o for x in r] == [date(2026, 7, 1), None, date(2026, 1, 1)]


def test_text_ingest(spark, tmp_path):
    folder = tmp_path / "vintage_year=2026"
    folder.mkdir()
    (folder / "a.txt").write_text("A|1|x\n\nB||y\nC|zz|\n")
    lay = schemas.layout("t", "v1", (("id", "string"), ("n", "bigint"), ("note", "string")))
    rows = text.bronze(spark.read.text(str(tmp_path)), lay, "now").orderBy("_source_row_number").collect()
    assert [(r.id, r.n, r.note, r._source_row_number, r._source_year) for r in rows] == [("A", 1, "x", 1, 2026), ("B", None, "y", 2, 2026), ("C", None, "", 3, 2026)]
    (folder / "b.txt").write_text("D|1\n")
    with pytest.raises(ValueError, match="row 1 has 2"):
        text.require_width(spark.read.text(str(tmp_path)), lay)
    with pytest.raises(ValueError):
        schemas.layout_for("performance", 1980)


def test_partitioned_sink_keeps_and_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_partitions(spark.createDataFrame([(1, 2001), (2, 2002)], "x int, vintage_year int"), path)
    sinks.write_partitions(spark.createDataFrame([(9, 2001), (3, 2003)], "x int, vintage_year int"), path)
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    sinks.write_partitions(spark.createDataFrame([(9, 2001)], "x int, vintage_year int"), path, force=True)
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [2, 3, 9]
    with pytest.raises(ValueError):
        sinks.require_years(spark, path, [2001, 2010])


def test_feature_registry_selects_by_availability_and_counts_classes():
    assert features_by_availability("HISTORICAL_TO_DATE") == ["max_delinquency_months_to_date", "months_since_last_delinquency"]
    assert counts_by("leakage") == {"SAFE_ORIGINATION": 6, "SAFE_AS_OF_DATE": 5, "OUTCOME_RESTRICTED": 3, "TECHNICAL_ONLY": 1}
    assert sum(counts_by("availability").values()) == len(REGISTRY)


def test_logistic_fit_on_cells_meets_the_score_equations(spark):
    import random

    rng = random.Random(11)
    rows = []
    for _ in range(3000):
        a, b = rng.choice([-1.0, 0.2, 1.5]), rng.choice([-0.7, 0.0, 0.9])
        rows.append((a, b, int(rng.random() < 1 / (1 + math.exp(1.5 - 0.8 * a + 0.4 * b))), rng.choice([1.0, 3.0])))
    df = spark.createDataFrame(rows, "a double, b double, y int, w double")
    for c in (1.0, 0.01):
        b0, coefs = scorecard.fit_logistic(df, ["a", "b"], "y", "w", c)
        res = [(w * (1 / (1 + math.exp(-(b0 + coefs[0] * a + coefs[1] * b))) - y), a, b) for a, b, y, w in rows]
        assert abs(sum(r for r, _, _ in res)) < 1e-6
        assert abs(sum(r * a for r, a, _ in res) + coefs[0] / c) < 1e-6 and abs(sum(r * b for r, _, b in res) + coefs[1] / c) < 1e-6
    apart = spark.createDataFrame([(float(i), int(i >= 5), 1.0) for i in range(10)], "a double, y int, w double")
    b0, (b1,) = scorecard.fit_logistic(apart, ["a"], "y", "w")  # separable: the penalty keeps the slope finite
    assert 0 < b1 < 50 and scorecard.fit_logistic(df.where("y = 1"), ["a", "b"], "y", "w")[1] == [0.0, 0.0]
    assert scorecard.fit_logistic(df.limit(0), ["a"], "y", "w") == (0.0, [0.0])


def test_unit_loss_matches_a_sum_over_months(spark):
    cfg = ECL(reporting_date=date(2027, 1, 1))
    months = 60
    pd_of = {("R1", "BASE"): 0.002, ("R1", "DOWN"): 0.004, ("R2", "BASE"): 0.01, ("R2", "DOWN"): 0.03}
    curves = spark.createDataFrame([(g, s, m, p * 0.98**m) for (g, s), p in pd_of.items() for m in range(1, months + 1)], "rating string, scenario string, month int, marginal_pd double")
    loans = [(i, g, stage, n, rate) for i, (g, stage, n, rate) in enumerate(
        (g, stage, n, rate) for g in ("R1", "R2", "R9", None) for stage in (1, 2, 3) for n in (0, 5, 48, None) for rate in (0.0, 4.5, None, -1.0))]
    df = spark.createDataFrame(loans, "loan_id int, rating string, stage int, remaining_months_to_maturity int, current_interest_rate double")
    sets = [ecl.UnitLoss("u_", "rating", "stage", {"BASE": "BASE", "DOWN": "DOWN"}), ecl.UnitLoss("x_", "rating", "stage", {"BASE": "DOWN"})]
    out = ecl.with_unit_loss(df, curves, sets, cfg)
    assert out.columns == [*df.columns, "u_BASE", "u_DOWN", "x_BASE"] and out.count() == len(loans)
    plan = out._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "CrossJoin" not in plan
    for r in out.collect():
        n, rate = max(r["remaining_months_to_maturity"] or 0, 0), max(r["current_interest_rate"] or 0.0, 0.0) / 1200
        h = min(n, cfg.stage1_months) if r["stage"] == 1 else min(n, cfg.max_months) if r["stage"] == 2 else 0
        for s, c in (("u_BASE", "BASE"), ("u_DOWN", "DOWN"), ("x_BASE", "DOWN")):
            p, want = pd_of.get((r["rating"], c), 0.0), 0.0
            for m in range(1, h + 1):
                left = ((1 + rate)**n - (1 + rate)**m) / ((1 + rate)**n - 1) if rate else 1 - m / n
                want += p * 0.98**m * left / (1 + rate)**m
            assert r[s] == pytest.approx(want, abs=1e-12)


def test_feature_pipeline_matches_the_ml_stages(spark):
    import random

    from pyspark.ml.functions import vector_to_array

    from lossloom.operators import ml_pipeline

    rng = random.Random(12)
    rows = [(i, None if rng.random() < 0.2 else rng.gauss(3, 2), 5.0, None, rng.choice(["a", "a", "b", " ", None, "c"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, x double, same double, none double, g string")
    two = ml_pipeline.fit_features(df.withColumn("h", F.lit("only")), ["x"], ["g", "h"])  # columns of unlike many levels
    assert len(two.transform(df.withColumn("h", F.lit("only"))).first()["features"]) == 1 + 3 + 1
    pipe = ml_pipeline.fit_features(df, ["x", "same", "none"], ["g"])
    known = [r[1] for r in rows if r[1] is not None]
    mean = sum(known) / len(known)
    std = (sum((v - mean) ** 2 for v in known) / (len(rows) - 1)) ** 0.5
    assert pipe.categorical == {"g": tuple(sorted(("a", "b", "c"), key=lambda g: -(sum(r[4] == g for r in rows) + (g == "a") * 1000)))}
    levels = pipe.categorical["g"]
    other = spark.createDataFrame([(1000, 7.0, 5.0, 1.0, "new"), (1001, None, None, None, None)], df.schema)
    for r in pipe.transform(df.unionByName(other)).select("*", vector_to_array("features").alias("f")).collect():
        g = (r["g"] or "").strip() or levels[0]
        one = [float(g == x) for x in levels]
        assert r["f"] == pytest.approx([((mean if r["x"] is None else r["x"]) - mean) / std, 0.0, *one])
    assert [c for c in pipe.transform(df).columns if c not in df.columns] == ["features"]


def test_row_numbers_hold_when_the_split_size_changes(spark, tmp_path):
    (tmp_path / "vintage_year=2026").mkdir()
    bad = {7, 1500, 3999}
    (tmp_path / "vintage_year=2026" / "a.txt").write_text("".join(f"{i}|x{'|y' if i not in bad else ''}\n" for i in range(1, 4001)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    lay = schemas.layout("t", "v1", (("id", "bigint"), ("a", "string"), ("b", "string")))
    try:
        spark.conf.set(key, "9000")
        lines = spark.read.text(str(tmp_path))
        rows, wrong = text.with_row_numbers(lines), text.malformed(lines, lay)
        spark.conf.set(key, "2500")  # the file is split otherwise from here on
        got = sorted((r._source_row_number, int(r.value.split("|")[0])) for r in rows.collect())
        assert got == [(i, i) for i in range(1, 4001)]
        assert sorted(r._source_row_number for r in wrong.collect()) == sorted(bad)
        stored = text.stored_lines(lines)
        assert text.stored_lines(stored) is stored and stored.select("_block").distinct().count() > 5
    finally:
        spark.conf.set(key, before)


def test_typing_of_lines_is_compiled_and_reads_each_path_once(spark, tmp_path, capsys):
    lay = schemas.layout_for("performance", 1995)
    (tmp_path / "vintage_year=1996").mkdir()
    row = ["F1", "199601", "n/a", "0", "7", "", *[""] * (len(lay.names) - 6)]
    (tmp_path / "vintage_year=1996" / "a.txt").write_text("\n".join(["|".join(row), "too|short", "|".join(row[:4] + ["x", "12"] + row[6:])]))
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        df = text.bronze(spark.read.text(str(tmp_path)), lay, "now")
        df.explain("codegen")
    finally:
        spark.conf.set(key, before)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000  # the JVM interprets longer methods for ever
    assert "regexp_extract" not in df._jdf.queryExecution().executedPlan().toString()  # a path is searched once per split
    got = [(r._source_zip, r._source_row_number, r.current_actual_upb, r.loan_age, r.remaining_months_to_legal_maturity) for r in df.collect()]
    assert sorted(got) == [("vintage_year=1996", 1, None, 7, None), ("vintage_year=1996", 3, None, None, 12)]


def test_months_are_read_without_a_date_parser(spark):
    texts = ["199901", "199912", "199900", "199913", "000001", "000101", "19990", "1999011", "1999 1", " 19991", "+19991", "-19991", "199901\n", "abcdef", "", None]
    out = spark.createDataFrame([(x,) for x in texts], "x string").repartition(1).select("x", silver.month_from_text("x").cast("string").alias("d"))
    assert {r["x"]: r["d"] for r in out.collect() if r["d"]} == {"199901": "1999-01-01", "199912": "1999-12-01", "000001": "0000-01-01", "000101": "0001-01-01"}
    assert "timestamp" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("probation", [1, 3])
def test_probation_counts_clean_months_since_the_last_hit(spark, probation):
    rng = random.Random(7)
    rows, want = [], {}
    for loan in range(60):
        month = after = run = 0
        last = None
        for _ in range(rng.randint(1, 30)):
            month += rng.choice([1, 1, 1, 1, 2, 5])
            raw, s3 = rng.random() < 0.2, rng.random() < 0.1
            clean = not (raw or s3)
            if raw or s3 or (last is not None and month - last != 1):
                after, run = raw and not s3, 0
            run += clean
            last = month
            rows.append((loan, date(2000 + month // 12, month % 12 + 1, 1), raw, s3))
            want[rows[-1][:2]] = (raw or (bool(after) and clean and run < probation)) and not s3
    df = spark.createDataFrame(rows, "loan_id long, as_of_date date, sicr_raw_flag boolean, stage3_flag boolean").repartition(3)
    out = staging.cure_probation(df, Staging(probation_months=probation))
    assert {(r["loan_id"], r["as_of_date"]): r["sicr_flag"] for r in out.collect()} == want and out.columns == [*df.columns, "sicr_flag"]


def test_field_sketches_merge_over_years(spark):
    rows = [(2000 + i % 3, i % 500, None, ("", f"c{i % 7}")[i % 4 // 2] if i % 2 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "_source_year int, a long, b double, c string").repartition(4)
    sketches = quality.field_sketches(df)
    assert sketches.count() == 9 and sketches.where("sketch IS NULL").count() == 0
    for by_year in (True, False):
        near = {(r.year, r.field): r for r in quality.merged_availability(sketches, "d", by_year).collect()}
        exact = {(r.year, r.field): r for r in quality.availability(df, "d", exact=True, by_year=by_year).collect()}
        assert near.keys() == exact.keys() and len(near) == (9 if by_year else 3)
        for k, e in exact.items():
            assert near[k][:6] == e[:6] and abs(near[k].distinct_count - e.distinct_count) <= 0.03 * e.distinct_count
    plan = quality.availability(df, "d")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Generate explode") == 1  # rows are not multiplied; only the year totals are laid out by field
    assert quality.field_sketches(df.limit(0)).count() == 0


def test_jobs_clear_their_own_cuts_only(spark, tmp_path):
    df = spark.range(10)
    with jobs.Job(spark, f"{tmp_path}/a"):
        mine = store.cut_lineage(df, "mine")
        with jobs.Job(spark, f"{tmp_path}/b"):
            theirs = store.cut_lineage(df, "theirs")
            assert theirs.count() == 10
        assert mine.count() == 10
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            theirs.count()
    shared = store.cut_lineage(df, "shared")
    with jobs.Job(spark, f"{tmp_path}/a"):
        pass
    assert shared.count() == 10
