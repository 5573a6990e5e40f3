"""Queries over the macro overlay on LGD."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossloom.operators import lgd_overlay as ov
from lossloom.plans import demo
from lossloom.plans.q_macro import RHO, factor_sql
from lossloom.plans.registry import query
from lossloom.plans.sqlchain import cte, qend

CFG = ov.OverlayConfig()
FE = ", ".join(ov.FEATURES)
Y = "realized_lgd_model_target"

cte("x_macroz", f"""
SELECT m.*, h.systematic_factor FROM x_macro m LEFT JOIN ({factor_sql(f'{RHO}e0', 'x_history')}) h ON h.date = m.date""")
cte("x_res", "SELECT * FROM x_lgd WHERE resolved_flag")
cte("x_regime0", f"""
SELECT g.*, {', '.join('m.' + f for f in ov.FEATURES)}, realized_lgd / nullif(predicted_lgd, 0) AS structural_oe_ratio
FROM (SELECT {qend('default_date')} AS date, split, count(*) AS rows, avg({Y}) AS realized_lgd, avg(predicted_lgd) AS predicted_lgd,
             avg(cured_flag::INT) AS cure_rate, avg({Y}) FILTER (cured_flag) AS cure_lgd, avg({Y}) FILTER (NOT cured_flag) AS non_cure_lgd,
             avg(estimated_loan_to_value_at_default) AS average_ltv, avg(current_upb_to_original_upb_at_default) AS average_current_upb_ratio,
             avg(default_due_to_delinquency::INT) AS delinquency_default_share, avg(default_due_to_credit_event::INT) AS credit_event_default_share,
             avg(coalesce(rating_at_default = 'R5', false)::INT) AS r5_share FROM x_res GROUP BY 1, 2) g
LEFT JOIN x_macroz m ON m.date = g.date""")


def index_sql(mean, sd) -> str:
    return " + ".join(f"{w}e0 * coalesce(({f} - {mean(f)}) / {sd(f)}, 0)" for f, w in CFG.weights.items())


cte("x_regime", f"""SELECT *, {index_sql(lambda f: f'(avg({f}) OVER ())', lambda f: f'coalesce(nullif(stddev_samp({f}) OVER (), 0), 1)')} AS stress_index
FROM x_regime0""")
cte("x_overlay", f"""
WITH s AS (SELECT greatest(coalesce(covar_pop(ln(greatest(structural_oe_ratio, 1e-6)), stress_index) / greatest(var_pop(stress_index), 1e-12), 0), 0) AS slope,
                  avg(ln(greatest(structural_oe_ratio, 1e-6))) AS y, avg(stress_index) AS x FROM x_regime WHERE split = 'TRAIN' AND structural_oe_ratio IS NOT NULL),
m AS (SELECT {', '.join(f"avg({f}) AS mean_{f}, coalesce(nullif(stddev_samp({f}), 0), 1) AS sd_{f}" for f in ov.FEATURES)} FROM x_regime WHERE split = 'TRAIN')
SELECT slope, y - slope * x AS train_intercept, m.*,
       (SELECT ln(greatest(sum(realized_lgd * rows), 1e-6) / greatest(sum(predicted_lgd * exp(s.slope * stress_index) * rows), 1e-6))
        FROM x_regime WHERE split = 'VALIDATION') AS validation_intercept FROM s, m""")


def multiplier_sql(shift=None) -> str:
    terms = " + ".join(f"{w}e0 * coalesce(({f} + {(shift or {}).get(f, '0e0')} - mean_{f}) / sd_{f}, 0)" for f, w in CFG.weights.items())
    return f"greatest(exp(validation_intercept + slope * ({terms})), 0)"


cte("x_adjusted", f"""
SELECT *, predicted_cure_probability * cure_lgd_forward_adjusted + (1 - predicted_cure_probability) * non_cure_lgd_forward_adjusted AS lgd_forward_adjusted
FROM (SELECT *, least(predicted_cure_lgd * expected_lgd_calibration_factor * macro_overlay, 1) AS cure_lgd_forward_adjusted,
             least(predicted_non_cure_lgd * expected_lgd_calibration_factor * macro_overlay, 1) AS non_cure_lgd_forward_adjusted
      FROM (SELECT e.*, {FE}, {multiplier_sql()} AS macro_overlay
            FROM x_res e LEFT JOIN x_macroz m ON m.date = {qend('e.default_date')}, x_overlay))""")
cte("x_rbase", f"""
SELECT rating_at_default AS rating, avg(predicted_lgd) AS lgd_base_structural, avg(predicted_cure_probability) AS pc,
       avg(least(predicted_cure_lgd * expected_lgd_calibration_factor, 1)) AS cl, avg(least(predicted_non_cure_lgd * expected_lgd_calibration_factor, 1)) AS nl
FROM x_res WHERE rating_at_default IS NOT NULL GROUP BY ALL""")


def slgd_sql(paths: str, mult: str) -> str:
    return f"""
SELECT *, pc * scenario_cure_lgd + (1 - pc) * scenario_non_cure_lgd AS lgd_scenario,
       (pc * scenario_cure_lgd + (1 - pc) * scenario_non_cure_lgd) * scenario_weight AS weighted_lgd
FROM (SELECT *, least(cl * macro_overlay, 1) AS scenario_cure_lgd, least(nl * macro_overlay, 1) AS scenario_non_cure_lgd
      FROM (SELECT p.*, b.*, {mult} AS macro_overlay FROM {paths} p, x_rbase b, x_overlay))"""


cte("x_slgd", slgd_sql("x_factors", multiplier_sql()))
cte("x_hpi", """
SELECT *, product(1 + coalesce(house_price_index_yoy, 0) / 100 / 4) OVER (PARTITION BY scenario ORDER BY date ROWS UNBOUNDED PRECEDING) - 1
           AS cumulative_hpi_change FROM x_factors""")


def resolved(t):
    return t("lgd").where("resolved_flag")


def history(t):
    return ov.regimes(resolved(t), demo.macro_with_factor(t), CFG)


def fitted(t):
    return ov.overlay(ov.fit(history(t)))


REG_R6 = ("realized_lgd predicted_lgd cure_rate cure_lgd non_cure_lgd average_ltv average_current_upb_ratio delinquency_default_share "
          "credit_event_default_share r5_share structural_oe_ratio stress_index " + " ".join(ov.FEATURES))


@query("lf01_regimes", "SELECT * FROM x_regime", r6=REG_R6)
def _(t):
    return history(t)


FIT_R6 = "slope train_intercept validation_intercept " + " ".join(f"{p}_{f}" for f in ov.FEATURES for p in ("mean", "sd"))


@query("lf02_overlay_fit", "SELECT * FROM x_overlay", r6=FIT_R6)
def _(t):
    return ov.fit(history(t))


LF3 = "loan_id default_episode_id macro_overlay cure_lgd_forward_adjusted non_cure_lgd_forward_adjusted lgd_forward_adjusted".split()


def adjusted(t):
    return ov.apply_overlay(resolved(t), demo.macro_with_factor(t), fitted(t), CFG)


@query("lf03_adjusted_lgd", f"SELECT {', '.join(LF3)} FROM x_adjusted", ints="default_episode_id", r6=" ".join(LF3[2:]))
def _(t):
    return adjusted(t).select(*LF3)


LF4 = "scenario date rating lgd_base_structural macro_overlay scenario_cure_lgd scenario_non_cure_lgd lgd_scenario weighted_lgd".split()


def by_rating(t):
    return ov.scenario_lgd(ov.rating_base(resolved(t)), demo.factor_paths(t), fitted(t).multiplier(CFG))


@query("lf04_scenario_lgd", f"SELECT {', '.join(LF4)} FROM x_slgd", r6=" ".join(LF4[3:]))
def _(t):
    return by_rating(t).select(*LF4)


LF5 = "lgd_base_structural predicted_cure_probability scenario_cure_lgd scenario_non_cure_lgd mean_stressed_ltv lgd_scenario weighted_lgd"


@query("lf05_cumulative_hpi", "SELECT scenario, date, cumulative_hpi_change FROM x_hpi", r6="cumulative_hpi_change")
def _(t):
    return ov.cumulative_hpi(demo.factor_paths(t)).select("scenario", "date", "cumulative_hpi_change")


@query("lf05_stressed_ltv_lgd", """
SELECT *, lgd_scenario * scenario_weight AS weighted_lgd FROM (
SELECT scenario, date, rating, scenario_weight, cumulative_hpi_change, avg(predicted_lgd) AS lgd_base_structural, avg(p) AS predicted_cure_probability,
       avg(cure) AS scenario_cure_lgd, avg(predicted_non_cure_lgd) AS scenario_non_cure_lgd, avg(ltv) AS mean_stressed_ltv,
       avg(least(greatest((p * cure + (1 - p) * predicted_non_cure_lgd) * f, 0), 1)) AS lgd_scenario
FROM (SELECT *, least(greatest(0.02e0 + 0.0005e0 * coalesce(ltv, 70), 0), 1) AS cure
      FROM (SELECT h.scenario, h.date, h.scenario_weight, h.cumulative_hpi_change, e.rating_at_default AS rating, e.predicted_lgd, e.predicted_non_cure_lgd,
                   e.predicted_cure_probability AS p, e.expected_lgd_calibration_factor AS f,
                   CASE WHEN e.estimated_loan_to_value_at_default IS NOT NULL THEN
                     least(greatest(e.estimated_loan_to_value_at_default / greatest(1 + h.cumulative_hpi_change, 0.05e0), 0), 300e0) END AS ltv
            FROM x_res e, x_hpi h WHERE e.rating_at_default IS NOT NULL)) GROUP BY ALL)""", r6="cumulative_hpi_change " + LF5)
def _(t):
    return ov.stressed_ltv_lgd(resolved(t), demo.factor_paths(t), F.expr("0.02e0 + 0.0005e0 * coalesce(stressed_ltv, 70)"))


@query("lf06_weighted_lgd", """SELECT date, rating, sum(weighted_lgd) AS probability_weighted_lgd, sum(scenario_weight) AS scenario_weight_sum,
any_value(lgd_base_structural) AS lgd_base_structural FROM x_slgd GROUP BY ALL""", r6="probability_weighted_lgd scenario_weight_sum lgd_base_structural")
def _(t):
    return ov.weighted(by_rating(t))


@query("lf06_sensitivity_grid", f"""
SELECT hpi_shock, unemployment_shock, avg(w) AS mean_probability_weighted_lgd, (SELECT avg(predicted_lgd) FROM x_res) AS mean_structural_lgd
FROM (SELECT hpi_shock, unemployment_shock, date, rating, sum(weighted_lgd) AS w FROM ({slgd_sql('''(SELECT f.*, h.hpi_shock, u.unemployment_shock FROM x_factors f,
  (SELECT unnest([-20e0, -10, -5, 0, 5, 10, 20]) AS hpi_shock) h, (SELECT unnest([-1e0, 0, 1]) AS unemployment_shock) u)''',
  multiplier_sql({'house_price_index_yoy': 'hpi_shock', 'unemployment_rate': 'unemployment_shock'}))}) GROUP BY ALL) GROUP BY ALL""",
       r6="mean_probability_weighted_lgd mean_structural_lgd")
def _(t):
    return ov.sensitivity(resolved(t), ov.rating_base(resolved(t)), demo.factor_paths(t), fitted(t), CFG)


@query("lf07_relationships", " UNION ALL ".join(f"""SELECT '{f}' AS feature, '{y}' AS target, CASE WHEN isfinite(corr({f}, {y})) THEN corr({f}, {y}) END AS correlation,
count(*) FILTER ({f} IS NOT NULL AND {y} IS NOT NULL) AS rows FROM x_regime""" for f in ov.RELATED for y in ov.RELATED_TARGETS), r6="correlation")
def _(t):
    return ov.relationships(history(t))


BT = f"""count(*) AS rows, avg({Y}) AS actual_mean_lgd, avg(predicted_lgd) AS base_predicted_mean, avg(lgd_forward_adjusted) AS forward_adjusted_predicted_mean,
  avg({Y}) / nullif(avg(predicted_lgd), 0) AS base_oe, avg({Y}) / nullif(avg(lgd_forward_adjusted), 0) AS forward_adjusted_oe,
  avg(abs({Y} - predicted_lgd)) AS base_mae, avg(abs({Y} - lgd_forward_adjusted)) AS forward_adjusted_mae,
  sqrt(avg(({Y} - predicted_lgd) ** 2)) AS base_rmse, sqrt(avg(({Y} - lgd_forward_adjusted) ** 2)) AS forward_adjusted_rmse FROM x_adjusted"""
BT_R6 = ("actual_mean_lgd base_predicted_mean forward_adjusted_predicted_mean base_oe forward_adjusted_oe base_mae forward_adjusted_mae base_rmse "
         "forward_adjusted_rmse")


@query("lf08_backtest", f"SELECT split, rating_at_default, {BT} GROUP BY ALL", r6=BT_R6)
def _(t):
    return ov.backtest(adjusted(t), ["split", "rating_at_default"])


@query("lf08_cure_diagnostics", f"""
SELECT split, count(*) AS rows, count(*) FILTER (cured_flag) AS cure_rows, avg(cured_flag::INT) AS cure_rate, avg({Y}) FILTER (cured_flag) AS realized_cure_lgd,
       avg(predicted_cure_lgd) FILTER (cured_flag) AS predicted_cure_lgd, avg(house_price_index_yoy) AS average_hpi_yoy,
       avg(estimated_loan_to_value_at_default) AS average_ltv, avg(systematic_factor) AS average_systematic_factor FROM x_adjusted GROUP BY split""",
       r6="cure_rate realized_cure_lgd predicted_cure_lgd average_hpi_yoy average_ltv average_systematic_factor")
def _(t):
    return ov.cure_diagnostics(adjusted(t))


@query("lf09_scenario_ordering", """
SELECT *, coalesce(DOWNSIDE >= BASE AND BASE >= UPSIDE, false) AS ordered FROM (
  SELECT date, rating, avg(lgd_scenario) FILTER (scenario = 'BASE') AS BASE, avg(lgd_scenario) FILTER (scenario = 'DOWNSIDE') AS DOWNSIDE,
         avg(lgd_scenario) FILTER (scenario = 'UPSIDE') AS UPSIDE FROM x_slgd GROUP BY ALL)""", r6="BASE DOWNSIDE UPSIDE")
def _(t):
    return ov.ordering(by_rating(t))
