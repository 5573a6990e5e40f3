"""Queries over calibration, ratings, lifetime curves and transitions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lossloom.operators import pd_framework as pdf
from lossloom.plans import demo
from lossloom.plans.q_scorecard import accuracy_sql, decile_sql, ranking_sql
from lossloom.plans.registry import query
from lossloom.plans.sqlchain import cte

GRADES = 5
cte("x_cal", f"""
SELECT *, least(greatest(predicted_pd_raw, 1e-6), 1 - 1e-6) AS pd_raw,
       round(1 / (1 + exp(-({demo.CAL_INTERCEPT}e0 + {demo.CAL_SLOPE}e0 * ln(least(greatest(predicted_pd_raw, 1e-6), 1 - 1e-6)
             / (1 - least(greatest(predicted_pd_raw, 1e-6), 1 - 1e-6)))))), 9) AS pd_calibrated_12m
FROM x_scored""")
cte("x_grade_edges", """
SELECT row_number() OVER (ORDER BY e) AS k, e, count(*) OVER () AS n FROM (
  SELECT DISTINCT unnest(quantile_cont(pd_calibrated_12m, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS e FROM x_cal WHERE split = 'TRAIN')""")
cte("x_boundaries", """
SELECT 'R' || k AS rating, CASE WHEN k = 1 THEN 0e0 ELSE e END AS lower_pd, CASE WHEN k = n - 1 THEN 1e0 ELSE nxt END AS upper_pd
FROM (SELECT *, lead(e) OVER (ORDER BY k) AS nxt FROM x_grade_edges) WHERE nxt IS NOT NULL""")
cte("x_preds", """
SELECT c.*, b.rating FROM x_cal c LEFT JOIN x_boundaries b
  ON (c.pd_calibrated_12m > b.lower_pd OR (b.rating = 'R1' AND c.pd_calibrated_12m >= 0)) AND c.pd_calibrated_12m <= b.upper_pd""")
cte("x_portfolio_ttc", """
SELECT DATE '1995-01-01' AS anchor_start, DATE '1997-12-01' AS anchor_end,
       sum(target * sample_weight) / sum(sample_weight) AS portfolio_ttc_pd, count(*) AS observations
FROM x_preds WHERE as_of_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-01'""")
cte("x_rating_ttc", """
SELECT rating, sum(target * sample_weight) / sum(sample_weight) AS rating_ttc_pd, count(*) AS observations
FROM x_preds WHERE as_of_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-01' GROUP BY rating""")
cte("x_found", """
SELECT p.loan_id, p.as_of_date, p.rating, t.months_until_event, t.event_default, t.event_prepayment_or_exit, t.event_censored,
       t.event_type
FROM x_preds p JOIN x_targets t ON t.loan_id = p.loan_id AND t.as_of_date = p.as_of_date""")
cte("x_hazard", """
SELECT r.rating, m.month::INT AS month,
       CASE WHEN count(*) FILTER (f.months_until_event >= m.month) > 0
            THEN (count(*) FILTER (f.months_until_event = m.month AND f.event_default) + 0.5e0)
                 / (count(*) FILTER (f.months_until_event >= m.month) + 1) ELSE 0 END AS conditional_pd
FROM (SELECT DISTINCT rating FROM x_found) r, (SELECT unnest(generate_series(1, 360)) AS month) m
JOIN (SELECT rating, months_until_event, event_default FROM x_found) f ON f.rating = r.rating
GROUP BY ALL""")


def survival_sql(keys: str, source: str) -> str:
    """Marginal, cumulative and survival from conditional_pd."""
    return f"""
SELECT *, conditional_pd AS hazard, coalesce(lag(survival_probability) OVER (PARTITION BY {keys} ORDER BY month), 1) * conditional_pd
              AS marginal_pd, 1 - survival_probability AS cumulative_pd
FROM (SELECT *, product(1 - conditional_pd) OVER (PARTITION BY {keys} ORDER BY month ROWS UNBOUNDED PRECEDING) AS survival_probability
      FROM {source})"""


def bisect_sql(name: str, source: str, keys: str) -> None:
    """CTEs ``name``: factor per key for rows (keys, hazards, goal), doubling and then bisecting row by row."""
    cum = "(1 - list_product(list_transform(hazards, lambda h: 1 - least(1e0, h * {f}))))"
    cte(f"{name}_start", f"""
SELECT *, (SELECT coalesce(min(f), 1024e0) FROM (SELECT unnest([1e0, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) AS f)
           WHERE {cum.format(f='f')} >= goal) AS hi FROM ({source})""")
    cte(f"{name}", f"""
WITH RECURSIVE b AS (
  SELECT {keys}, hazards, goal, 0 AS step, 0e0 AS lo, hi FROM {name}_start
  UNION ALL
  SELECT {keys}, hazards, goal, step + 1, CASE WHEN {cum.format(f='(lo + hi) / 2')} < goal THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN {cum.format(f='(lo + hi) / 2')} < goal THEN hi ELSE (lo + hi) / 2 END
  FROM b WHERE step < 60)
SELECT {keys}, CASE WHEN goal = 0 THEN 0 ELSE hi END AS factor FROM b WHERE step = 60""")


bisect_sql("x_factor", """
SELECT h.rating, list(h.conditional_pd ORDER BY h.month) AS hazards, any_value(g.goal) AS goal
FROM x_hazard h JOIN (SELECT rating, sum(pd_calibrated_12m * sample_weight) / sum(sample_weight) AS goal FROM x_preds GROUP BY rating) g
  ON g.rating = h.rating WHERE h.month <= 12 GROUP BY h.rating""", "rating")
cte("x_lifetime", survival_sql("rating", """(
SELECT h.rating, h.month, least(1, h.conditional_pd * f.factor) AS conditional_pd FROM x_hazard h JOIN x_factor f ON f.rating = h.rating)"""))
CURVE_R6 = "conditional_pd hazard marginal_pd cumulative_pd survival_probability"


@query("pd01_calibration_fit")
def _(t):
    """All three methods fitted on VALIDATION, compared by mean prediction per split."""
    out = None
    for method in ("none", "logistic", "isotonic"):
        cal = pdf.fit_calibration(t("scored"), replace(t.cfg.pd, calibration=method))
        part = cal.apply(t("scored")).groupBy("split").agg(
            F.lit(method).alias("method"), F.avg("predicted_pd_raw").alias("raw"), F.avg(pdf.PD).alias("calibrated"),
            F.avg("target").alias("observed"))
        out = part if out is None else out.unionByName(part)
    return out


@query("pd01_score_equations", " UNION ALL ".join(
    f"SELECT '{m}' AS method, sum(sample_weight) AS weight, sum(sample_weight * target) AS bads, true AS balanced FROM x_scored WHERE split = 'VALIDATION'"
    for m in ("logistic", "isotonic")), r6="weight bads")
def _(t):
    """Either calibration reproduces the weighted number of bads of the rows it was fitted on."""
    out = None
    for method in ("logistic", "isotonic"):
        p = pdf.fit_calibration(t("scored"), replace(t.cfg.pd, calibration=method)).apply(t("scored")).where("split = 'VALIDATION'")
        part = p.agg(F.lit(method).alias("method"), F.sum("sample_weight").alias("weight"), F.sum(F.col("sample_weight") * F.col("target")).alias("bads"),
                     F.sum(F.col("sample_weight") * F.col(pdf.PD)).alias("_p"))
        part = part.select("method", "weight", "bads", (F.abs(F.col("_p") - F.col("bads")) < 1e-4 * F.col("weight")).alias("balanced"))
        out = part if out is None else out.unionByName(part)
    return out


def ece_sql(pd: str) -> str:
    return f"""
SELECT split, sum(abs(y - p)) / sum(w) AS ece FROM (
  SELECT split, least(9, floor({pd} * 10)) AS c, sum(sample_weight) AS w, sum(target * sample_weight) AS y, sum({pd} * sample_weight) AS p
  FROM x_preds GROUP BY ALL) GROUP BY split"""


@query("pd02_calibration_metrics", " UNION ALL ".join(f"""
SELECT r.split, '{name}' AS pd_type, roc_auc, 2 * roc_auc - 1 AS gini, ks, pr_auc, brier, log_loss, observed_bad_rate,
       predicted_bad_rate, ece
FROM ({ranking_sql('split', col, 'x_preds')}) r JOIN ({accuracy_sql('split', col, 'x_preds')}) a ON a.split = r.split
JOIN ({ece_sql(col)}) e ON e.split = r.split""" for name, col in (("raw", "pd_raw"), ("calibrated", "pd_calibrated_12m"))),
       r6="roc_auc gini ks pr_auc brier log_loss observed_bad_rate predicted_bad_rate ece")
def _(t):
    return pdf.calibration_metrics(t("preds"))


@query("pd03_rating_boundaries", "SELECT * FROM x_boundaries", r6="lower_pd upper_pd")
def _(t):
    return pdf.boundary_table(t.spark, pdf.boundary_edges(t("calibrated"), t.cfg.pd))


@query("pd04_ratings", "SELECT loan_id, as_of_date, pd_calibrated_12m, rating FROM x_preds", r6="pd_calibrated_12m")
def _(t):
    return t("preds").select("loan_id", "as_of_date", "pd_calibrated_12m", "rating")


@query("pd05_rating_summary", """
SELECT *, sum(population) OVER () * 0.02e0 AS minimum_population_threshold,
       population >= sum(population) OVER () * 0.02e0 AS passes_minimum_population, defaults >= 20 AS passes_minimum_defaults
FROM (SELECT rating, count(*) AS population, sum(target * sample_weight) AS defaults,
             sum(target * sample_weight) / sum(sample_weight) AS observed_bad_rate,
             sum(pd_calibrated_12m * sample_weight) / sum(sample_weight) AS mean_pd, min(pd_calibrated_12m) AS min_pd,
             max(pd_calibrated_12m) AS max_pd FROM x_preds GROUP BY rating)""",
       r6="defaults observed_bad_rate mean_pd min_pd max_pd minimum_population_threshold")
def _(t):
    return pdf.rating_summary(t("preds"))


@query("pd06_portfolio_ttc", "SELECT * FROM x_portfolio_ttc", r6="portfolio_ttc_pd")
def _(t):
    return t("portfolio_ttc")


@query("pd06_rating_ttc", "SELECT * FROM x_rating_ttc", r6="rating_ttc_pd")
def _(t):
    return t("rating_ttc")


@query("pd07_pit_ttc", """
SELECT year(as_of_date) AS observation_year, sum(target * sample_weight) / sum(sample_weight) AS observed_12m_default_rate,
       sum(pd_calibrated_12m * sample_weight) / sum(sample_weight) AS mean_calibrated_pd,
       any_value(portfolio_ttc_pd) AS ttc_pd,
       sum(pd_calibrated_12m * sample_weight) / sum(sample_weight) / any_value(portfolio_ttc_pd) AS pit_to_ttc_ratio
FROM x_preds, x_portfolio_ttc GROUP BY year(as_of_date)""", ints="observation_year",
       r6="observed_12m_default_rate mean_calibrated_pd ttc_pd pit_to_ttc_ratio")
def _(t):
    return pdf.pit_ttc(t("preds"), t("portfolio_ttc"))


@query("pd08_event_foundation", "SELECT * FROM x_found", ints="months_until_event")
def _(t):
    return pdf.event_foundation(t("preds"), t("targets"))


@query("pd09_empirical_hazards", survival_sql("rating", "x_hazard"), ints="month", r6=CURVE_R6)
def _(t):
    base = pdf.empirical_hazards(pdf.event_foundation(t("preds"), t("targets")), t.cfg.pd)
    return pdf.with_survival(base, ["rating"])


@query("pd10_lifetime_curves", "SELECT * FROM x_lifetime", ints="month", r6=CURVE_R6)
def _(t):
    return t("lifetime")


def transition_sql(months: int) -> str:
    return f"""
SELECT {months}::BIGINT AS months, rating_from, to_state, n AS count, n / sum(n) OVER (PARTITION BY rating_from) AS probability
FROM (SELECT a.rating AS rating_from, CASE WHEN b.target = 1 THEN 'DEFAULT' ELSE b.rating END AS to_state, count(*) AS n
      FROM x_preds a JOIN x_preds b ON b.loan_id = a.loan_id AND b.as_of_date = a.as_of_date + INTERVAL {months} MONTH GROUP BY ALL)
UNION ALL SELECT {months}, 'DEFAULT', 'DEFAULT', 0, 1"""


cte("x_moves", transition_sql(1) + " UNION ALL " + transition_sql(12))


def moves(t):
    return pdf.transitions(t("preds"), 1).unionByName(pdf.transitions(t("preds"), 12))


@query("pd11_transitions", "SELECT * FROM x_moves", r6="probability")
def _(t):
    return moves(t)


@query("pd12_transition_summary", """
SELECT months, rating_from, 1 - sum(CASE WHEN to_state = rating_from THEN count ELSE 0 END) / sum(count) AS migration_rate,
       sum(CASE WHEN to_state < rating_from AND to_state <> 'DEFAULT' THEN count ELSE 0 END) / sum(count) AS upgrade_rate,
       sum(CASE WHEN to_state > rating_from OR to_state = 'DEFAULT' THEN count ELSE 0 END) / sum(count) AS downgrade_rate,
       sum(CASE WHEN to_state = 'DEFAULT' THEN count ELSE 0 END) / sum(count) AS default_transition_rate,
       sum(count) AS transitions
FROM x_moves WHERE rating_from <> 'DEFAULT' GROUP BY ALL""", ints="transitions",
       r6="migration_rate upgrade_rate downgrade_rate default_transition_rate")
def _(t):
    return pdf.transition_summary(moves(t))


@query("pd13_backtest", """
SELECT rating, observation_year, y AS observed_defaults, p AS expected_defaults, y / nullif(p, 0) AS oe_ratio,
       greatest(0, r - 1.96e0 * sqrt(greatest(r * (1 - r) / n, 0))) AS binomial_lower,
       least(1, r + 1.96e0 * sqrt(greatest(r * (1 - r) / n, 0))) AS binomial_upper, brier, y < 20 AS insufficient_defaults
FROM (SELECT *, p / n AS r FROM (
  SELECT rating, year(as_of_date) AS observation_year, sum(target * sample_weight) AS y, sum(pd_calibrated_12m * sample_weight) AS p,
         sum(sample_weight) AS n, sum((target - pd_calibrated_12m) ** 2 * sample_weight) / sum(sample_weight) AS brier
  FROM x_preds GROUP BY ALL))""", ints="observation_year",
       r6="observed_defaults expected_defaults oe_ratio binomial_lower binomial_upper brier")
def _(t):
    return pdf.backtest(t("preds"))


@query("pd13_backtest_splits", """
SELECT split, sum(target * sample_weight) AS observed_defaults, sum(pd_calibrated_12m * sample_weight) AS expected_defaults,
       sum((target - pd_calibrated_12m) ** 2 * sample_weight) / sum(sample_weight) AS brier,
       sum(target * sample_weight) / sum(pd_calibrated_12m * sample_weight) AS oe_ratio
FROM x_preds GROUP BY split""", r6="observed_defaults expected_defaults brier oe_ratio")
def _(t):
    return pdf.backtest_splits(t("preds"))


@query("pd14_calibration_curve", f"""
SELECT split, decile AS bucket, sum(target * sample_weight) / sum(sample_weight) AS observed_bad_rate,
       sum(pd_calibrated_12m * sample_weight) / sum(sample_weight) AS predicted_bad_rate, count(*) AS rows
FROM ({decile_sql('x_preds', 'pd_calibrated_12m')}) GROUP BY ALL""", r6="observed_bad_rate predicted_bad_rate")
def _(t):
    return pdf.calibration_curve(t("preds"))
