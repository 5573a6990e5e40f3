"""Queries over the point-in-time mart, default states, labels and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossloom.functions.joins import loan_join
from lossloom.operators import mart, targets
from lossloom.plans.registry import query

KEY = ("loan_id", "as_of_date")
STATIC_R6 = "original_upb original_interest_rate"


def base(t):
    return mart.panel_base(t("perf"), t("static"))


@query("mt01_loan_static", "SELECT * FROM x_static", r6=STATIC_R6, ints="vintage_year original_ltv original_cltv original_dti")
def _(t):
    return t("static")


@query("mt02_panel_base", """
SELECT p.loan_id, p.vintage_year, period AS as_of_date, current_actual_upb, original_upb, origination_date, maturity_date
FROM x_perf p LEFT JOIN x_static s ON s.loan_id = p.loan_id AND s.vintage_year = p.vintage_year""",
       r6="current_actual_upb original_upb")
def _(t):
    return base(t).select("loan_id", "vintage_year", "as_of_date", "current_actual_upb", "original_upb",
                          "origination_date", "maturity_date")


LAG_COLS = [f"{p}{k}" for p, ks in mart.LAGS.values() for k in ks]


@query("mt03_calendar_lags", """
SELECT b.loan_id, b.period AS as_of_date,
       a.delinquency_months AS delinquency_months_lag_1, c.delinquency_months AS delinquency_months_lag_3,
       d.delinquency_months AS delinquency_months_lag_6, e.delinquency_months AS delinquency_months_lag_12,
       a.current_actual_upb AS current_upb_lag_1, c.current_actual_upb AS current_upb_lag_3,
       d.current_actual_upb AS current_upb_lag_6, e.current_actual_upb AS current_upb_lag_12,
       a.current_interest_rate AS current_interest_rate_lag_1, e.current_interest_rate AS current_interest_rate_lag_12
FROM x_perf b
LEFT JOIN x_perf a ON a.loan_id = b.loan_id AND a.month_index = b.month_index - 1
LEFT JOIN x_perf c ON c.loan_id = b.loan_id AND c.month_index = b.month_index - 3
LEFT JOIN x_perf d ON d.loan_id = b.loan_id AND d.month_index = b.month_index - 6
LEFT JOIN x_perf e ON e.loan_id = b.loan_id AND e.month_index = b.month_index - 12""",
       r6=" ".join(c for c in LAG_COLS if not c.startswith("delinquency")))
def _(t):
    return mart.calendar_lags(base(t)).select(*KEY, *LAG_COLS)


def month_query(name: str, cols: str, step, *, r6: str = "") -> None:
    sql = f"SELECT loan_id, as_of_date, {', '.join(cols.split())} FROM x_mart"
    ints = " ".join(c for c in cols.split() if c.startswith(("months", "max_", "observed", "calendar", "delinquency_events")))
    query(name, sql, r6=r6, ints=ints)(lambda t: step(base(t)).select(*KEY, *cols.split()))


month_query("mt04_reporting_gaps", "has_reporting_gap_to_date", mart.reporting_gaps)
month_query("mt05_observation_counts", "observed_months_to_date calendar_months_since_first_observation",
            mart.observation_counts)
month_query("mt06_history", "max_delinquency_months_to_date months_delinquent_to_date months_1plus_delinquent_to_date "
            "months_2plus_delinquent_to_date months_3plus_delinquent_to_date ever_modified_to_date ever_assistance_to_date",
            mart.history)
month_query("mt07_recency", "months_since_last_delinquency months_since_last_modification", mart.recency)
month_query("mt08_delinquency_entries", "delinquency_event_current_month delinquency_events_to_date",
            lambda b: mart.delinquency_entries(mart.calendar_lags(b)))
month_query("mt09_trailing_windows", " ".join(f"max_delinquency_last_{k}m months_delinquent_last_{k}m" for k in (3, 6, 12)),
            mart.trailing_windows)
RATIOS = ("current_upb_to_original_upb principal_reduction_to_date interest_rate_change_from_origination rate_change_1m "
          "rate_change_12m " + " ".join(f"upb_change_{k}m upb_change_pct_{k}m" for k in (1, 3, 6, 12)))
month_query("mt10_derived_ratios", RATIOS, lambda b: mart.derived_ratios(mart.calendar_lags(b)), r6=RATIOS)
month_query("mt11_tenure", "months_on_book_derived months_since_origination months_to_contractual_maturity", mart.tenure)
month_query("mt12_current_assistance", "current_assistance_flag", mart.history)


@query("mt13_analytical_view", """
SELECT loan_id, as_of_date, vintage_year, current_actual_upb, original_credit_score, original_ltv, property_state, channel
FROM x_analytical""", r6="current_actual_upb", ints="original_credit_score original_ltv")
def _(t):
    return t("analytical").select("loan_id", "as_of_date", "vintage_year", "current_actual_upb", "original_credit_score",
                                  "original_ltv", "property_state", "channel")


@query("mt14_mart_validation", """
SELECT (SELECT count(*) FROM x_static) AS loan_static_rows,
       (SELECT count(DISTINCT loan_id) FROM x_static) AS loan_static_unique_loans,
       (SELECT count(*) FROM (SELECT loan_id FROM x_static GROUP BY loan_id HAVING count(DISTINCT vintage_year) > 1))
           AS cross_vintage_duplicate_loan_ids,
       count(*) AS loan_month_rows, count(DISTINCT loan_id) AS loan_month_distinct_loans,
       count(DISTINCT (loan_id, as_of_date)) AS loan_month_unique_keys,
       min(as_of_date) AS min_as_of_date, max(as_of_date) AS max_as_of_date,
       (SELECT count(*) FROM (SELECT 1 FROM x_mart GROUP BY loan_id, as_of_date HAVING count(*) > 1))
           AS primary_key_duplicate_count,
       (SELECT count(*) FROM x_analytical) AS analytical_view_rows
FROM x_mart""")
def _(t):
    return mart.validation(t("static"), t("mart"), t("analytical"))


@query("mt15_vintage_profile", """
SELECT vintage_year, sum(n) AS rows, count(*) AS unique_loans, min(lo) AS min_as_of_date, max(hi) AS max_as_of_date,
       avg(n) AS avg_observed_months_per_loan, median(n) AS median_observed_months_per_loan,
       max(n) AS max_observed_months_per_loan, sum(dq) AS loans_ever_delinquent, sum(md) AS loans_ever_modified,
       sum(gap) AS loans_with_reporting_gaps
FROM (SELECT vintage_year, loan_id, count(*) AS n, min(as_of_date) AS lo, max(as_of_date) AS hi,
             max(coalesce(delinquency_months > 0, false)::INT) AS dq, max(ever_modified_to_date::INT) AS md,
             max(has_reporting_gap_to_date::INT) AS gap
      FROM x_mart GROUP BY ALL) GROUP BY vintage_year""",
       ints="rows max_observed_months_per_loan loans_ever_delinquent loans_ever_modified loans_with_reporting_gaps",
       r6="avg_observed_months_per_loan median_observed_months_per_loan")
def _(t):
    return mart.vintage_profile(t("mart"))


@query("mt16_feature_population", " UNION ALL ".join(
    f"SELECT vintage_year AS year, '{f}' AS feature, count({f}) AS non_null_count, count({f}) / count(*) AS non_null_pct "
    f"FROM x_mart GROUP BY vintage_year" for f in mart.POPULATION_FEATURES), r6="non_null_pct")
def _(t):
    return mart.feature_population(t("mart"))


@query("mt17_feature_distribution", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, min({f})::DOUBLE AS min, max({f})::DOUBLE AS max, avg({f}) AS mean, "
    f"quantile_cont({f}::DOUBLE, 0.5) AS median, quantile_cont({f}::DOUBLE, 0.01) AS p01, "
    f"quantile_cont({f}::DOUBLE, 0.99) AS p99, 1 - count({f}) / count(*) AS null_rate FROM x_mart"
    for f in mart.DISTRIBUTION_FEATURES), r6="min max mean median p01 p99 null_rate")
def _(t):
    return mart.feature_distribution(t("mart"))


STATE = ("loan_id, as_of_date, default_due_to_delinquency, default_due_to_credit_event, default_flag, default_reason, "
         "non_default_exit_flag, non_default_exit_reason, terminal_exit_flag")


@query("tg01_row_state", f"SELECT {STATE} FROM x_state")
def _(t):
    return t("state").select(*STATE.split(", "))


@query("tg02_past_flags", "SELECT loan_id, as_of_date, ever_default_to_date, terminal_exit_to_date FROM x_future")
def _(t):
    return targets.past_flags(t("state")).select(*KEY, "ever_default_to_date", "terminal_exit_to_date")


@query("tg03_future_dates", """SELECT loan_id, as_of_date, first_default_date, next_default AS future_first_default_date,
next_exit AS future_first_non_default_exit_date FROM x_future""")
def _(t):
    return targets.future_events(t("state")).select(*KEY, "first_default_date", "future_first_default_date",
                                                    "future_first_non_default_exit_date")


@query("tg04_future_exit_reason", """SELECT loan_id, as_of_date,
next_exit_reason AS future_first_non_default_exit_reason FROM x_event""")
def _(t):
    return targets.future_events(t("state")).select(*KEY, "future_first_non_default_exit_reason")


def target_query(name: str, cols: str, ints: str = "") -> None:
    query(name, f"SELECT loan_id, as_of_date, {', '.join(cols.split())} FROM x_targets", ints=ints)(
        lambda t: t("targets").select(*KEY, *cols.split()))


target_query("tg05_competing_event", "event_type event_default event_prepayment_or_exit event_censored months_until_event",
             "months_until_event")
target_query("tg06_twelve_month_label", "eligible_for_12m_pd default_next_12m target_12m_observable", "default_next_12m")
target_query("tg07_lifetime_fields", "eligible_for_lifetime_pd months_to_first_default ever_default "
             "months_to_default_from_observation", "months_to_first_default months_to_default_from_observation")


@query("tg08_clean_streaks", "SELECT loan_id, as_of_date, clean_months AS consecutive_non_default_months FROM x_streak",
       ints="consecutive_non_default_months")
def _(t):
    return targets.clean_streaks(t("state"), t.cfg.default).select(*KEY, "consecutive_non_default_months")


@query("tg09_cure_candidates", "SELECT loan_id, as_of_date, cure_candidate AS cure_date_candidate FROM x_cure")
def _(t):
    d = t.cfg.default
    return targets.cure_candidates(targets.clean_streaks(t("state"), d), d).select(*KEY, "cure_date_candidate")


@query("tg10_episode_entries", "SELECT loan_id, as_of_date, opens AS is_episode_entry FROM x_opening")
def _(t):
    d = t.cfg.default
    rows = targets.default_rows(targets.cure_candidates(targets.clean_streaks(t("state"), d), d))
    return rows.select(*KEY, "is_episode_entry")


@query("tg11_default_episodes", "SELECT * FROM x_events", ints="default_episode_id")
def _(t):
    return t("events")


def _tag(metric: str, day: str, unit: str, when: str, reason: str = "NULL", event: str = "NULL") -> str:
    return (f"{{'metric': CASE WHEN {when} THEN '{metric}' END, 'year': year({day})::VARCHAR, 'reason': {reason}::VARCHAR, "
            f"'event_type': {event}::VARCHAR, 'unit': {unit}::VARCHAR}}")


_row, _loan, _episode = "(loan_id, as_of_date)", "loan_id", "(loan_id, default_episode_id)"
_target_tags = ", ".join([
    _tag("observations", "as_of_date", _row, "true"), _tag("eligible_12m_observations", "as_of_date", _row, "eligible_for_12m_pd"),
    _tag("observable_12m_targets", "as_of_date", _row, "target_12m_observable"),
    _tag("censored_12m_targets", "as_of_date", _row, "eligible_for_12m_pd AND NOT target_12m_observable"),
    _tag("defaults", "as_of_date", _loan, "as_of_date = first_default_date", "default_reason"),
    _tag("non_default_exits", "future_first_non_default_exit_date", _loan, "event_prepayment_or_exit", "future_first_non_default_exit_reason", "event_type")])
_event_tags = ", ".join([_tag("cures", "cure_date", _episode, "cure_date IS NOT NULL", "default_reason"),
                         _tag("redefaults", "redefault_date", _episode, "redefault_flag", "default_reason")])


@query("tg12_default_summary", f"""
SELECT k.metric, k.year, k.reason, k.event_type, count(DISTINCT k.unit) AS count
FROM (SELECT unnest([{_target_tags}]) AS k FROM x_targets UNION ALL SELECT unnest([{_event_tags}]) FROM x_events)
WHERE k.metric IS NOT NULL GROUP BY ALL""")
def _(t):
    return targets.default_summary(t("targets"), t("events"))


@query("tg13_target_observability", """
SELECT year(as_of_date) AS observation_year, count(*) AS observations,
       count(*) FILTER (eligible_for_12m_pd) AS eligible_observations,
       count(*) FILTER (target_12m_observable) AS observable_12m_targets,
       count(*) FILTER (eligible_for_12m_pd AND NOT target_12m_observable) AS censored_12m_targets,
       count(*) FILTER (default_next_12m = 1) AS positive_12m_targets,
       count(*) FILTER (default_next_12m = 0) AS negative_12m_targets,
       count(*) FILTER (default_next_12m = 1) / nullif(count(*) FILTER (target_12m_observable), 0) AS observable_12m_bad_rate
FROM x_targets GROUP BY ALL""", ints="observation_year", r6="observable_12m_bad_rate")
def _(t):
    return targets.observability(t("targets"))


@query("tg14_target_validation", """
SELECT count(*) AS pd_12m_rows, count(DISTINCT (loan_id, as_of_date)) AS pd_12m_unique_keys,
       count(*) FILTER (eligible_for_12m_pd) AS eligible_12m_observations,
       count(*) FILTER (default_next_12m = 1) AS positive_12m_targets,
       count(*) FILTER (default_next_12m = 0) AS negative_12m_targets,
       count(*) FILTER (eligible_for_12m_pd AND NOT target_12m_observable) AS censored_12m_targets,
       (SELECT count(*) FROM x_events) AS default_event_rows,
       (SELECT count(DISTINCT loan_id) FROM x_events) AS loans_with_default_events,
       (SELECT count(cure_date) FROM x_events) AS cures,
       (SELECT count(*) FILTER (redefault_flag) FROM x_events) AS redefaults
FROM x_targets""", ints="pd_12m_rows eligible_12m_observations positive_12m_targets negative_12m_targets "
       "censored_12m_targets default_event_rows cures redefaults")
def _(t):
    return targets.validation(t("targets"), t("events"))


@query("tg15_entry_exposure", """
SELECT e.loan_id, e.default_episode_id, coalesce(nullif(m.current_actual_upb, 0), m.current_upb_lag_1) AS ead_at_default,
       CASE WHEN m.current_actual_upb > 0 THEN 'current_actual_upb'
            WHEN m.current_upb_lag_1 > 0 THEN 'prior_month_current_upb' ELSE 'unavailable' END AS ead_at_default_source
FROM x_events e LEFT JOIN x_mart m ON m.loan_id = e.loan_id AND m.as_of_date = e.default_entry_date""",
       ints="default_episode_id", r6="ead_at_default")
def _(t):
    m = t("mart").select("loan_id", F.col("as_of_date").alias("default_entry_date"), "current_actual_upb", "current_upb_lag_1")
    upb, prior = F.col("current_actual_upb"), F.col("current_upb_lag_1")
    return loan_join(t("events"), m, ["loan_id", "default_entry_date"], "left").select(
        "loan_id", "default_episode_id", targets.entry_exposure(upb, prior).alias("ead_at_default"),
        targets.entry_exposure_source(upb, prior).alias("ead_at_default_source"))
