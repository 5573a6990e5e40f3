"""Impairment stages: default state, significant-increase triggers, cure probation and their diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.config import Staging
from lossloom.functions.exprs import count_if, flag, month_diff, month_index, safe_div, tagged_rows
from lossloom.functions.joins import dealt_by, in_interval, latest_on_or_before, loan_join, with_attributes
from lossloom.functions.ranks import exact_quantiles
from lossloom.operators.pd_framework import grade_number
from lossloom.operators.targets import entry_exposure

TRIGGERS = ("sicr_relative_pd", "sicr_absolute_pd", "sicr_rating_downgrade", "sicr_dpd_backstop", "sicr_other_credit_deterioration")
MONTH = ("loan_id", "as_of_date", "vintage_year", "current_actual_upb", "current_upb_lag_1", "delinquency_months", "ever_modified_to_date",
         "ever_assistance_to_date", "current_assistance_flag")
BASE = ("loan_id", "as_of_date", "vintage_year", "ead_current", "pd_current", "rating_current", "delinquency_months", "ever_modified_to_date",
        "ever_assistance_to_date", "current_assistance_flag", "origination_date", "default_entry_event", "default_episode_id",
        "default_entry_date", "cure_date", "default_reason", "active_default_state")


def _spans(events: DataFrame) -> DataFrame:
    return events.select("loan_id", "default_episode_id", "default_entry_date", "cure_date", F.col("default_reason").alias("_reason"))


def _ead(entry: Column) -> Column:
    upb = F.col("current_actual_upb")
    return F.when(flag(entry), entry_exposure(upb, F.col("current_upb_lag_1"))).otherwise(upb)


def with_active_episode(df: DataFrame, events: DataFrame, how: str = "left") -> DataFrame:
    """Interval join entry <= date < cure: an equi join on the loan with the dates as residual.

    Episodes of a loan do not overlap, so no row can match twice.
    """
    e = _spans(events).withColumnRenamed("loan_id", "_loan")
    cond = (df["loan_id"] == F.col("_loan")) & in_interval(df["as_of_date"], F.col("default_entry_date"), F.col("cure_date"))
    return loan_join(df, e, cond, how).drop("_loan").withColumnRenamed("_reason", "default_reason")


def scored_rows(preds: DataFrame, month: DataFrame, static: DataFrame, targets: DataFrame, events: DataFrame) -> DataFrame:
    p = preds.select("loan_id", "as_of_date", F.col("pd_calibrated_12m").alias("pd_current"), F.col("rating").alias("rating_current"))
    # Loan tables lie in the order of loan and date; the joins on both come first, those on the loan alone keep its order.
    df = loan_join(p, month.select(*MONTH), ["loan_id", "as_of_date"])
    df = loan_join(df, targets.select("loan_id", "as_of_date", "default_flag"), ["loan_id", "as_of_date"], "left")
    df = with_active_episode(with_attributes(df, static.select("loan_id", "vintage_year", "origination_date")), events)
    return df.withColumns({
        "ead_current": _ead(F.col("default_entry_date") == F.col("as_of_date")),
        "default_entry_event": flag(F.col("default_flag")), "active_default_state": F.col("default_episode_id").isNotNull()}).select(*BASE)


def unscored_default_months(preds: DataFrame, month: DataFrame, static: DataFrame, events: DataFrame) -> DataFrame:
    """Months inside an open episode that have no prediction of their own."""
    df = with_active_episode(month.select(*MONTH), events, "inner")
    df = loan_join(df, preds.select("loan_id", "as_of_date"), ["loan_id", "as_of_date"], "left_anti")
    df = with_attributes(df, static.select("loan_id", "vintage_year", "origination_date"))
    entry = F.col("as_of_date") == F.col("default_entry_date")
    return df.withColumns({"ead_current": _ead(entry), "default_entry_event": entry, "active_default_state": F.lit(True)})


def default_rows(preds: DataFrame, month: DataFrame, static: DataFrame, events: DataFrame) -> DataFrame:
    """Those months with the last prediction on or before them."""
    p = preds.select("loan_id", F.col("as_of_date").alias("_pd_date"), F.col("pd_calibrated_12m").alias("pd_current"),
                     F.col("rating").alias("rating_current"))
    return latest_on_or_before(unscored_default_months(preds, month, static, events), p, "loan_id", "as_of_date", "_pd_date",
                               ["pd_current", "rating_current"]).select(*BASE)


def with_reference(rows: DataFrame) -> DataFrame:
    """First rated row of each loan as the reference point, taken over the loan's own window."""
    ok = F.col("pd_current").isNotNull() & F.col("rating_current").isNotNull()
    first = F.min(F.when(ok, F.struct("as_of_date", "pd_current", "rating_current"))).over(Window.partitionBy("loan_id"))
    df = rows.withColumn("_r", first)
    return df.withColumns({
        "sicr_reference_date": F.col("_r.as_of_date"), "sicr_reference_pd": F.col("_r.pd_current"),
        "sicr_reference_rating": F.col("_r.rating_current"),
        "months_origination_to_reference": month_diff("origination_date", "_r.as_of_date")}).drop("_r")


def staging_base(preds: DataFrame, month: DataFrame, static: DataFrame, targets: DataFrame, events: DataFrame) -> DataFrame:
    rows = scored_rows(preds, month, static, targets, events).unionByName(default_rows(preds, month, static, events))
    # One order by loan and date serves this window and those of the cure probation.
    return with_reference(dealt_by(rows, "loan_id").sortWithinPartitions("loan_id", "as_of_date"))


def changes(df: DataFrame) -> DataFrame:
    cur, ref = F.col("pd_current"), F.col("sicr_reference_pd")
    return df.withColumns({
        "pd_origination": ref, "rating_origination": F.col("sicr_reference_rating"),
        "pd_relative_change": F.when(ref > 0, cur / ref), "pd_absolute_change": cur - ref,
        "rating_notch_change": grade_number("rating_current") - grade_number("sicr_reference_rating"),
        "origination_baseline_available": flag(ref.isNotNull() & (F.col("sicr_reference_date") <= F.col("as_of_date"))),
        "stage3_flag": F.col("active_default_state")})


def triggers(df: DataFrame, cfg: Staging) -> DataFrame:
    """Trigger flags; a threshold of None switches its trigger off, and the low-risk exemption clears all of them."""
    base = F.col("origination_baseline_available")
    no = F.lit(False)
    other = no
    if cfg.other_deterioration:
        if cfg.include_modification:
            other = other | flag(F.col("ever_modified_to_date"))
        if cfg.include_assistance:
            other = other | flag(F.col("ever_assistance_to_date")) | flag(F.col("current_assistance_flag"))
    low = no if cfg.low_risk_max_rating is None else flag(grade_number("rating_current") <= int(cfg.low_risk_max_rating[1:]))
    raw = {
        "sicr_relative_pd": no if cfg.relative_pd_increase is None else base & (F.col("pd_relative_change") >= cfg.relative_pd_increase),
        "sicr_absolute_pd": no if cfg.absolute_pd_increase is None else base & (F.col("pd_absolute_change") >= cfg.absolute_pd_increase),
        "sicr_rating_downgrade": no if cfg.downgrade_notches is None else F.col("rating_notch_change") >= cfg.downgrade_notches,
        "sicr_dpd_backstop": no if cfg.dpd_backstop_months is None else F.coalesce("delinquency_months", F.lit(0)) >= cfg.dpd_backstop_months,
        "sicr_other_credit_deterioration": other}
    df = df.withColumn("low_credit_risk_exemption", low)
    df = df.withColumns({k: flag(v) & ~F.col("low_credit_risk_exemption") for k, v in raw.items()})
    any_trigger = F.lit(False)
    for c in TRIGGERS:
        any_trigger = any_trigger | F.col(c)
    return df.withColumn("sicr_raw_flag", any_trigger)


def cure_probation(df: DataFrame, cfg: Staging) -> DataFrame:
    """Hold stage 2 until enough consecutive clean months; a gap, a trigger or a default starts the count again.

    A trigger always opens a group, so whether a group follows a trigger is the value of its first row; rows before the first group follow none.
    Clean months of a group are those of the loan so far less those before the group, so that all windows share one order.
    """
    raw, s3 = F.col("sicr_raw_flag"), F.col("stage3_flag")
    if cfg.probation_months == 0:
        return df.withColumn("sicr_flag", raw & ~s3)
    w = Window.partitionBy("loan_id").orderBy("as_of_date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    clean, mi = ~(raw | s3), month_index("as_of_date")
    gap = F.coalesce(mi - F.lag(mi).over(w) != 1, F.lit(False))
    df = df.withColumns({"_reset": ~clean | gap, "_clean": F.sum(clean.cast("int")).over(so_far)})
    df = df.withColumns({
        "_before": F.coalesce(F.max(F.when(F.col("_reset"), F.col("_clean") - clean.cast("int"))).over(so_far), F.lit(0)),
        "_after": F.coalesce(F.last(F.when(F.col("_reset"), raw & ~s3), ignorenulls=True).over(so_far), F.lit(False))})
    held = F.col("_after") & clean & (F.col("_clean") - F.col("_before") < cfg.probation_months)
    return df.withColumn("sicr_flag", (raw | held) & ~s3).drop("_reset", "_clean", "_before", "_after")


def stages(df: DataFrame, cfg: Staging) -> DataFrame:
    reason = F.concat_ws("|", *[F.when(F.col(c), F.lit(c)) for c in TRIGGERS])
    df = df.withColumn("sicr_reason", F.when(reason == "", "NO_SICR").otherwise(reason))
    held = F.col("sicr_flag") & ~F.col("sicr_raw_flag")
    if cfg.probation_reason:
        df = df.withColumn("sicr_reason", F.when(held, cfg.probation_reason).otherwise(F.col("sicr_reason")))
    return df.withColumns({
        "stage": F.when(F.col("stage3_flag"), 3).when(F.col("sicr_flag"), 2).otherwise(1),
        "stage_reason": F.when(F.col("stage3_flag"), "DEFAULT").when(F.col("sicr_flag"), F.col("sicr_reason")).otherwise("NO_SICR")})


def allocate(base: DataFrame, cfg: Staging) -> DataFrame:
    return stages(cure_probation(triggers(changes(base), cfg), cfg), cfg)


def _simulated(rel, notches, dpd, absolute=None) -> Column:
    s2 = F.col("sicr_other_credit_deterioration")
    base = F.col("origination_baseline_available")
    if rel is not None:
        s2 = s2 | flag(base & (F.col("pd_relative_change") >= rel))
    if absolute is not None:
        s2 = s2 | flag(base & (F.col("pd_absolute_change") >= absolute))
    if notches is not None:
        s2 = s2 | flag(F.col("rating_notch_change") >= notches)
    if dpd is not None:
        s2 = s2 | (F.coalesce("delinquency_months", F.lit(0)) >= dpd)
    return F.when(F.col("stage3_flag"), 3).when(s2 & ~F.col("low_credit_risk_exemption"), 2).otherwise(1)


def sensitivity(staged: DataFrame, cfg: Staging) -> DataFrame:
    """Stage 2 size and migration rate for every threshold setting of the grid.

    Settings become columns, so all of them share one window sort and one aggregate and the rows are not multiplied.
    """
    grid = [(r, n, d) for r in cfg.grid_relative for n in cfg.grid_notches for d in cfg.grid_dpd]
    w = Window.partitionBy("loan_id").orderBy("as_of_date")
    df = staged.select("loan_id", "as_of_date", "ead_current", *[_simulated(*g).alias(f"s{i}") for i, g in enumerate(grid)])
    df = df.select("ead_current", *[f"s{i}" for i in range(len(grid))], *[F.lag(f"s{i}").over(w).alias(f"p{i}") for i in range(len(grid))])
    aggs = []
    for i in range(len(grid)):
        s, p = F.col(f"s{i}"), F.col(f"p{i}")
        aggs += [count_if(s == 2).alias(f"n{i}"), F.sum(F.when(s == 2, F.coalesce("ead_current", F.lit(0.0))).otherwise(0.0)).alias(f"e{i}"),
                 F.coalesce(F.avg((s != p).cast("int")), F.lit(0.0)).alias(f"m{i}")]
    rows = [[F.lit(float(r)), F.lit(n), F.lit(d), F.col(f"n{i}"), F.col(f"e{i}"), F.col(f"m{i}")] for i, (r, n, d) in enumerate(grid)]
    return tagged_rows(df.agg(*aggs), [], rows, ["relative_pd_increase", "rating_downgrade_notches", "dpd_backstop_months", "stage2_count",
                                                 "stage2_ead", "migration_rate"])


def by_group(df: DataFrame, keys: Sequence[str | Column], names: Sequence[str], averages: bool = True) -> DataFrame:
    """Rows, distinct loans and exposure per key, grouped through the loan."""
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("ead_current").alias("ead"), F.count("ead_current").alias("_ne"),
            F.sum("pd_current").alias("_sp"), F.count("pd_current").alias("_np")]
    g = df.groupBy(*keys, "loan_id").agg(*sums).groupBy(*names)
    t = g.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("loans"), F.coalesce(F.sum("ead"), F.lit(0.0)).alias("ead"),
              *([safe_div(F.sum("_sp"), F.sum("_np")).alias("avg_pd"), safe_div(F.sum("ead"), F.sum("_ne")).alias("avg_ead")] if averages else []))
    return t


def simulate(staged: DataFrame, cfg: Staging, **overrides) -> DataFrame:
    """Stage counts under one other threshold setting."""
    c = replace(cfg, **overrides)
    stage = _simulated(c.relative_pd_increase, c.downgrade_notches, c.dpd_backstop_months, c.absolute_pd_increase)
    if c.dpd_backstop_months is not None:
        stage = F.when(stage == 1, F.when(F.col("sicr_dpd_backstop") & ~F.col("low_credit_risk_exemption"), 2).otherwise(1)).otherwise(stage)
    return by_group(staged.withColumn("_s", stage), [F.col("_s").alias("stage")], ["stage"], averages=False)


def distribution(staged: DataFrame) -> DataFrame:
    return by_group(staged, ["stage"], ["stage"])


def distribution_by_year_rating(staged: DataFrame) -> DataFrame:
    rated = staged.where("rating_current IS NOT NULL")
    return by_group(rated, [F.year("as_of_date").alias("year"), "rating_current", "stage"], ["year", "rating_current", "stage"])


def _trigger_count() -> Column:
    n = F.lit(0)
    for c in TRIGGERS:
        n = n + F.col(c).cast("int")
    return n


def _flag_totals(staged: DataFrame, conds: dict[str, Column], label: str) -> DataFrame:
    aggs = []
    for k, cond in conds.items():
        aggs += [count_if(cond).alias(f"{k}_n"), F.coalesce(F.sum(F.when(cond, F.col("ead_current"))), F.lit(0.0)).alias(f"{k}_e")]
    return tagged_rows(staged.agg(*aggs), [], [[F.lit(k), F.col(f"{k}_n"), F.col(f"{k}_e")] for k in conds], [label, "rows", "ead"])


def trigger_distribution(staged: DataFrame) -> DataFrame:
    return _flag_totals(staged, {c: F.col(c) for c in TRIGGERS} | {"multiple_trigger_overlap": _trigger_count() > 1}, "trigger")


def trigger_exclusivity(staged: DataFrame) -> DataFrame:
    """Rows with exactly one, several or no trigger, then every combination that occurs."""
    n = _trigger_count()
    conds = {f"only_{c}": F.col(c) & (n == 1) for c in TRIGGERS} | {"overlap_two_or_more": n > 1, "no_stage2_trigger": n == 0}
    combo = F.concat_ws("+", *[F.when(F.col(c), F.lit(c)) for c in TRIGGERS])
    each = staged.groupBy(F.when(combo == "", "none").otherwise(combo).alias("trigger_set")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("ead_current"), F.lit(0.0)).alias("ead"))
    return _flag_totals(staged, conds, "trigger_set").unionByName(each)


def stage3_audit(staged: DataFrame) -> DataFrame:
    """Entries, active months and episode durations; durations are month counts, so the median is a plain percentile."""
    entry, active = F.col("default_entry_event"), F.col("active_default_state")
    t = staged.agg(count_if(entry).alias("e"), F.sum(F.when(entry, F.col("ead_current"))).alias("ee"), count_if(active).alias("a"),
                   F.sum(F.when(active, F.col("ead_current"))).alias("ae"))
    ep = staged.where(active).groupBy("loan_id", "default_episode_id", "default_entry_date", "cure_date").agg(F.count(F.lit(1)).alias("n"))
    s = ep.agg(F.avg("n").alias("avg"), F.median("n").alias("med"), count_if(F.col("cure_date").isNotNull()).alias("c"),
               count_if(F.col("cure_date").isNull()).alias("u"))
    none = F.lit(None).cast("double")
    rows = [("stage3_entries", "e", F.col("ee")), ("stage3_active_rows", "a", F.col("ae")), ("average_months_in_stage3", "avg", none),
            ("median_months_in_stage3", "med", none), ("cured_stage3_episodes", "c", none), ("unresolved_or_terminal_stage3_episodes", "u", none)]
    return tagged_rows(t.crossJoin(s), [], [[F.lit(m), F.col(c).cast("double"), e] for m, c, e in rows], ["metric", "value", "ead"])


QUANTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
CHANGE_BANDS = ((0, 1, "0-1x"), (1, 1.5, "1-1.5x"), (1.5, 2, "1.5-2x"), (2, 3, "2-3x"), (3, 5, "3-5x"), (5, 10, "5-10x"), (10, None, ">10x"))


def pd_change_distribution(staged: DataFrame) -> DataFrame:
    v = F.col("pd_relative_change")
    distinct = staged.groupBy("pd_current").agg(F.max("rating_current").alias("_r")).agg(F.count("pd_current").cast("double").alias("u"))
    grades = staged.groupBy("rating_current").agg(F.lit(1)).agg(F.count("rating_current").cast("double").alias("g"))
    bands = staged.agg(*[count_if((v >= lo) & ((v < hi) if hi is not None else F.lit(True))).alias(f"b{i}") for i, (lo, hi, _) in enumerate(CHANGE_BANDS)])
    q = exact_quantiles(staged.withColumn("_g", F.lit(1)), ["_g"], "pd_relative_change", QUANTILES)
    one = distinct.crossJoin(grades).crossJoin(bands).crossJoin(q)  # four single-row aggregates
    rows = [[F.lit("unique_pd_current_values"), F.lit("all"), F.col("u")], [F.lit("unique_active_rating_grades"), F.lit("all"), F.col("g")]]
    rows += [[F.lit("pd_relative_change_quantile"), F.lit(f"q{p:.2f}"), F.col("q")[i]] for i, p in enumerate(QUANTILES)]
    rows += [[F.lit("pd_relative_change_bucket_rows"), F.lit(n), F.col(f"b{i}").cast("double")] for i, (_, _, n) in enumerate(CHANGE_BANDS)]
    return tagged_rows(one, [], rows, ["metric", "bucket", "value"])


LAG_BANDS = ("0m", "1m", "2-3m", "4-6m", ">6m")


def reference_lag(staged: DataFrame) -> DataFrame:
    """All bands are listed even when empty; rows without a reference form their own band when there are any."""
    v = F.col("months_origination_to_reference")
    band = (F.when(v.isNull(), "unavailable").when(v <= 0, "0m").when(v <= 1, "1m").when(v <= 3, "2-3m").when(v <= 6, "4-6m").otherwise(">6m"))
    t = by_group(staged, [band.alias("reference_lag_band")], ["reference_lag_band"], averages=False)
    names = staged.sparkSession.createDataFrame([(b,) for b in LAG_BANDS], "reference_lag_band string")
    return names.join(t, "reference_lag_band", "full_outer").fillna(0)


def migrations(staged: DataFrame) -> DataFrame:
    prev = F.lag("stage").over(Window.partitionBy("loan_id").orderBy("as_of_date"))
    m = staged.select("stage", "ead_current", prev.alias("p")).where("p IS NOT NULL")
    name = F.concat(F.lit("Stage "), F.col("p").cast("string"), F.lit("->"), F.col("stage").cast("string"))
    return m.groupBy(name.alias("migration")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("ead_current"), F.lit(0.0)).alias("ead"))


def reference_diagnostics(staged: DataFrame) -> DataFrame:
    gone, lag = ~F.col("origination_baseline_available"), F.col("months_origination_to_reference")
    per_loan = staged.groupBy("loan_id").agg(F.count(F.lit(1)).alias("n"), count_if(gone).alias("g"))
    a = per_loan.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("loans"), F.sum("g").alias("rows_without_reference"),
                     count_if(F.col("g") > 0).alias("loans_without_reference"))
    b = staged.agg(F.avg(lag).alias("avg_months_origination_to_reference"), F.median(lag).alias("median_months_origination_to_reference"))
    return a.crossJoin(b)  # two single-row aggregates
