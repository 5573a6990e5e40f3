"""Queries over macro series, the one-factor model and scenario PD curves."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lossloom.functions.exprs import clip, logit, quarter_end
from lossloom.operators import macro
from lossloom.plans import demo
from lossloom.plans.q_pd import CURVE_R6, bisect_sql, survival_sql
from lossloom.plans.registry import query
from lossloom.plans.sqlchain import cte, qend
from lossloom.functions import exprs

CFG = macro.MacroConfig()
NAMES = ["unemployment_rate", "house_price_index_yoy", "real_gdp_yoy", "mortgage_rate"]
FEATS = list(macro.FEATURES)

cte("x_series", """
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, 100 * avg((o_orderstatus = 'P')::INT) AS u, avg(o_totalprice) AS h,
                  count(*)::DOUBLE AS g, 100 * avg((o_orderpriority = '1-URGENT')::INT) AS r
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL)
SELECT 'unemployment_rate' AS series, date, u AS value FROM m UNION ALL SELECT 'house_price_index', date, h FROM m
UNION ALL SELECT 'real_gdp', date, g FROM m UNION ALL SELECT 'mortgage_rate', date, r FROM m""")
cte("x_quarterly", f"""
WITH q AS (SELECT series, {qend('date')} AS date, CASE WHEN series = 'real_gdp' THEN arg_max(value, date) ELSE avg(value) END AS v
           FROM x_series GROUP BY 1, 2)
SELECT a.series || CASE WHEN a.series IN ('house_price_index', 'real_gdp') THEN '_yoy' ELSE '' END AS series, a.date,
       CASE WHEN a.series IN ('house_price_index', 'real_gdp') THEN (a.v / b.v - 1) * 100 ELSE a.v END AS value
FROM q a LEFT JOIN q b ON b.series = a.series AND b.date = last_day((a.date - INTERVAL 12 MONTH)::DATE)""")
cte("x_macro", """
WITH w AS (SELECT date, """ + ", ".join(f"max(value) FILTER (series = '{n}') AS {n}" for n in NAMES) + """ FROM x_quarterly GROUP BY date),
f AS (SELECT date, """ + ", ".join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {n}" for n in NAMES) + """ FROM w)
SELECT *, unemployment_rate - lag(unemployment_rate) OVER (ORDER BY date) AS unemployment_rate_change,
       mortgage_rate - lag(mortgage_rate) OVER (ORDER BY date) AS mortgage_rate_change
FROM f WHERE date >= DATE '1995-01-01'""")


def horner(x: str, ks) -> str:
    out = f"{ks[0]!r}::DOUBLE"
    for k in ks[1:]:
        out = f"({out} * {x} + {k!r}::DOUBLE)"
    return out


def ppf(p: str) -> str:
    def tail(q: str) -> str:
        return f"{horner(q, exprs.PPF_C)} / ({horner(q, exprs.PPF_D)} * {q} + 1)"

    q, r = f"({p} - 0.5e0)", f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    lo = f"sqrt(-2 * ln(CASE WHEN {p} > 0 AND {p} < 0.02425e0 THEN {p} END))"
    hi = f"sqrt(-2 * ln(CASE WHEN {p} < 1 AND {p} > 0.97575e0 THEN 1 - {p} END))"
    return (f"CASE WHEN {p} < 0.02425e0 THEN {tail(lo)} WHEN {p} > 0.97575e0 THEN -({tail(hi)}) "
            f"ELSE {horner(r, exprs.PPF_A)} * {q} / ({horner(r, exprs.PPF_B)} * {r} + 1) END")


def cdf(x: str) -> str:
    a = f"abs({x})"
    t = f"(exp(-{a} * {a} / 2) * {horner(a, exprs.CDF_P)} / {horner(a, exprs.CDF_Q)})"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {a} >= 7.07e0 THEN CASE WHEN {x} > 0 THEN 1e0 ELSE 0e0 END "
            f"WHEN {x} > 0 THEN 1 - {t} ELSE {t} END")


def clipped(x: str, eps: str = "1e-6") -> str:
    return f"least(greatest({x}, {eps}), 1 - {eps})"


def vasicek_sql(ttc: str, z: str, rho: str, source: str, keep: str = "*") -> str:
    """Nested so that each polynomial sees a plain column name."""
    return f"""
SELECT * EXCLUDE (_t, _x), {cdf('_x')} AS pit FROM (
  SELECT *, ({ppf('_t')} - sqrt({rho}) * {z}) / sqrt(1 - {rho}) AS _x FROM (
    SELECT {keep}, {clipped(ttc, '1e-8')} AS _t FROM {source}))"""


def factor_sql(rho: str, source: str) -> str:
    return f"""
SELECT * EXCLUDE (_o, _t), ({ppf('_t')} - sqrt(1 - {rho}) * ({ppf('_o')})) / sqrt({rho}) AS systematic_factor FROM (
  SELECT *, {clipped('observed_default_rate')} AS _o, {clipped('ttc_pd')} AS _t FROM {source})"""


cte("x_history", f"""
SELECT {qend('as_of_date')} AS date, avg(target) AS observed_default_rate, count(*) AS observations,
       (SELECT portfolio_ttc_pd FROM x_portfolio_ttc) AS ttc_pd FROM x_preds GROUP BY ALL""")
cte("x_rho_grid", f"""
WITH g AS ({factor_sql('rho', '''(SELECT h.*, i, 0.01e0 + i * (0.24e0 / 99) AS rho
FROM x_history h, (SELECT unnest(generate_series(0, 99)) AS i))''')})
SELECT rho, factor_std, abs(factor_std - 1) AS objective,
       i = first_value(i) OVER (ORDER BY abs(factor_std - 1), i) AS selected
FROM (SELECT i, rho, stddev_samp(systematic_factor) AS factor_std FROM g GROUP BY ALL)""")
RHO = demo.RHO
cte("x_model_frame", f"""
SELECT h.*, m.* EXCLUDE (date) FROM ({factor_sql(f'{RHO}e0', 'x_history')}) h JOIN x_macro m ON m.date = h.date
WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATS)}""")


def linear_sql(m: macro.LinearModel) -> str:
    return f"{m.intercept}e0 + " + " + ".join(f"{b}e0 * {f}" for f, b in m.coefs.items())


cte("x_fits", f"""
SELECT *, systematic_factor - vasicek_systematic_factor AS factor_residual, observed_default_rate - pit AS vasicek_residual,
       observed_default_rate - satellite_pit_pd AS satellite_residual
FROM ({vasicek_sql('ttc_pd', 'vasicek_systematic_factor', f'{RHO}e0', f'''(SELECT *, {linear_sql(demo.FACTOR)} AS vasicek_systematic_factor,
1 / (1 + exp(-({linear_sql(demo.SATELLITE)}))) AS satellite_pit_pd FROM x_model_frame)''')})""")


def shock_sql(cfg: macro.MacroConfig) -> str:
    return " UNION ALL ".join(
        f"SELECT '{s}' AS scenario, {w}e0 AS scenario_weight, " + ", ".join(
            f"{float(cfg.shocks[s].get(n, 0.0))}e0 AS s_{n}" for n in NAMES) for s, w in cfg.weights.items())


def path_sql(cfg: macro.MacroConfig) -> str:
    cols = [f"s_{f.removesuffix('_change')} / 12e0 AS {f}" if f.endswith("_change") else f"b.{f} + s_{f} * (step / 12e0) AS {f}"
            for f in FEATS]
    return f"""
SELECT scenario, last_day((DATE '2000-09-30' + to_months(((step - 1) * 3)::INT))::DATE) AS date, scenario_weight, {', '.join(cols)}
FROM ({shock_sql(cfg)}), (SELECT unnest(generate_series(1, 12)) AS step),
     (SELECT * FROM x_macro WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATS)} ORDER BY date DESC LIMIT 1) b"""


def factors_sql(paths: str) -> str:
    return f"""SELECT *, {linear_sql(demo.FACTOR)} AS systematic_factor, 1 / (1 + exp(-({linear_sql(demo.SATELLITE)}))) AS satellite_portfolio_pd
FROM {paths}"""


def spd_sql(factors: str) -> str:
    return f"""SELECT * RENAME (pit AS pit_pd_12m), pit * scenario_weight AS weighted_pd_12m FROM ({vasicek_sql(
        'ttc_pd', 'systematic_factor', f'{RHO}e0', f"""(SELECT scenario, date, rating, rating_ttc_pd AS ttc_pd, systematic_factor,
scenario_weight FROM {factors}, x_rating_ttc)""")})"""


cte("x_paths", path_sql(CFG))
cte("x_factors", factors_sql("x_paths"))
cte("x_spd", spd_sql("x_factors"))
bisect_sql("x_sfactor", """
SELECT s.scenario, s.date, s.rating, s.scenario_weight, s.pit_pd_12m AS goal, l.hazards
FROM x_spd s JOIN (SELECT rating, list(conditional_pd ORDER BY month) AS hazards FROM x_lifetime WHERE month <= 12 GROUP BY rating) l
  ON l.rating = s.rating""", "scenario, date, rating, scenario_weight")
cte("x_curves", f"""
SELECT *, marginal_pd * scenario_weight AS weighted_marginal_pd, cumulative_pd * scenario_weight AS weighted_cumulative_pd
FROM ({survival_sql('scenario, date, rating', '''(SELECT f.scenario, f.date, f.rating, f.scenario_weight, l.month,
least(1, l.conditional_pd * f.factor) AS conditional_pd FROM x_sfactor f JOIN x_lifetime l ON l.rating = f.rating)''')})""")

MACRO_R6 = " ".join(FEATS)


@query("ma01_quarterly_series", "SELECT * FROM x_quarterly", r6="value")
def _(t):
    return macro.quarterly(demo.monthly_series(t), CFG.series)


@query("ma02_aligned_series", "SELECT * FROM x_macro", r6=MACRO_R6)
def _(t):
    return t("macro")


@query("ma03_historical_default_rate", "SELECT date, observed_default_rate, observations FROM x_history", r6="observed_default_rate")
def _(t):
    return macro.historical_default_rate(t("preds"))


@query("ma04_vasicek_pit_pd", f"""
SELECT loan_id, as_of_date, pit AS pit_pd FROM ({vasicek_sql('pd_calibrated_12m', 'z', f'{RHO}e0', f'''(
SELECT p.loan_id, p.as_of_date, p.pd_calibrated_12m, f.systematic_factor AS z
FROM x_preds p JOIN ({factor_sql(f"{RHO}e0", "x_history")}) f ON f.date = {qend('p.as_of_date')})''')})""", r6="pit_pd")
def _(t):
    z = macro.with_systematic_factor(demo.history(t), "z", "observed_default_rate", "ttc_pd", F.lit(RHO), CFG.epsilon)
    p = t("preds").withColumn("date", quarter_end("as_of_date")).join(z.select("date", "z"), "date")
    return macro.with_vasicek_pd(p, "pit_pd", "pd_calibrated_12m", "z", RHO).select("loan_id", "as_of_date", "pit_pd")


@query("ma05_systematic_factor", f"SELECT date, observed_default_rate, systematic_factor FROM ({factor_sql(f'{RHO}e0', 'x_history')})",
       r6="observed_default_rate systematic_factor")
def _(t):
    z = macro.with_systematic_factor(demo.history(t), "systematic_factor", "observed_default_rate", "ttc_pd", F.lit(RHO), CFG.epsilon)
    return z.select("date", "observed_default_rate", "systematic_factor")


@query("ma06_rho_grid", "SELECT * FROM x_rho_grid", r6="rho factor_std objective")
def _(t):
    return macro.rho_grid(demo.history(t), CFG)


def coefficient_rows(t, name: str, m: macro.LinearModel):
    rows = [(name, "INTERCEPT", m.intercept)] + [(name, f, b) for f, b in m.coefs.items()]
    return t.spark.createDataFrame(rows, "model string, feature string, coefficient double")


@query("ma07_factor_regression")
def _(t):
    return coefficient_rows(t, "vasicek_factor", macro.fit_factor_model(demo.macro_frame(t)))


@query("ma08_satellite_ridge")
def _(t):
    return coefficient_rows(t, "macro_satellite", macro.fit_satellite(demo.macro_frame(t), CFG.ridge_strength))


def optimality_sql(features, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS quarters, {columns} FROM x_fits" for f in features)


@query("ma07_optimality", optimality_sql(macro.FEATURES, "true AS sign_kept, true AS optimal"))
def _(t):
    """Karush-Kuhn-Tucker conditions: a used feature is uncorrelated with the residual, an unused one could only help with the wrong sign."""
    f, m = demo.macro_frame(t), macro.fit_factor_model(demo.macro_frame(t))
    r = F.col("systematic_factor") - m.apply()
    one = f.agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(r, F.col(c)).alias(f"g_{c}") for c in macro.FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in macro.FEATURES]).first()
    rows = []
    for c, b in m.coefs.items():
        sign = -1.0 if c in macro.WEAKENING else 1.0
        slope = sign * one[f"g_{c}"] / (one[f"s_{c}"] or 1.0)
        rows.append((c, one["n"], sign * b >= 0, abs(slope) < 1e-6 if b else slope < 1e-6))
    return t.spark.createDataFrame(rows, "feature string, quarters long, sign_kept boolean, optimal boolean")


@query("ma08_optimality", optimality_sql(("INTERCEPT", *macro.FEATURES), "true AS optimal"))
def _(t):
    """Ridge normal equations: the residual sum is 0, and times a feature it is the penalty times the coefficient."""
    f, m = demo.macro_frame(t), macro.fit_satellite(demo.macro_frame(t), CFG.ridge_strength)
    r = logit(clip("observed_default_rate", 1e-6, 1 - 1e-6)) - m.apply()
    one = f.agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("e"), *[F.sum(r * F.col(c)).alias(f"g_{c}") for c in macro.FEATURES]).first()
    rows = [("INTERCEPT", one["n"], abs(one["e"]) < 1e-6 * one["n"])]
    rows += [(c, one["n"], abs(one[f"g_{c}"] - b / CFG.ridge_strength) < 1e-6 * max(1.0, abs(one[f"g_{c}"]))) for c, b in m.coefs.items()]
    return t.spark.createDataFrame(rows, "feature string, quarters long, optimal boolean")


@query("ma09_variance_inflation")
def _(t):
    v = macro.variance_inflation(demo.macro_frame(t))
    return t.spark.createDataFrame(list(v.items()), "feature string, vif double")


@query("ma09_diagnostics", """
WITH e AS (SELECT factor_residual AS e, lag(factor_residual) OVER (ORDER BY date) AS p, satellite_residual AS s FROM x_fits)
SELECT sqrt(avg(e * e)) AS factor_rmse, avg(abs(e)) AS factor_mae, sqrt(avg(s * s)) AS satellite_rmse, avg(abs(s)) AS satellite_mae,
       avg(s * s) AS satellite_brier, corr(e, p) AS factor_residual_autocorrelation_lag1 FROM e""",
       r6="factor_rmse factor_mae satellite_rmse satellite_mae satellite_brier factor_residual_autocorrelation_lag1")
def _(t):
    return macro.diagnostics(demo.macro_fits(t))


@query("ma10_scenario_paths", "SELECT * FROM x_paths", r6=MACRO_R6)
def _(t):
    return macro.scenario_paths(t("macro"), CFG)


@query("ma11_scenario_factors", "SELECT * FROM x_factors", r6=MACRO_R6 + " systematic_factor satellite_portfolio_pd")
def _(t):
    return macro.scenario_factors(macro.scenario_paths(t("macro"), CFG), demo.FACTOR, demo.SATELLITE)


SPD_R6 = "ttc_pd systematic_factor pit_pd_12m weighted_pd_12m"


@query("ma12_scenario_pd", "SELECT * FROM x_spd", r6=SPD_R6)
def _(t):
    return t("scenario_pd")


@query("ma12_weighted_pd", """SELECT date, rating, any_value(ttc_pd) AS ttc_pd, sum(weighted_pd_12m) AS weighted_pd_12m,
sum(scenario_weight) AS scenario_weight_sum FROM x_spd GROUP BY ALL""", r6="ttc_pd weighted_pd_12m scenario_weight_sum")
def _(t):
    return macro.weighted_pd(t("scenario_pd"))


@query("ma13_scenario_lifetime", "SELECT * FROM x_curves", ints="month", r6=CURVE_R6 + " weighted_marginal_pd weighted_cumulative_pd")
def _(t):
    return t("curves")


@query("ma14_weighted_lifetime", """
SELECT * EXCLUDE (p), CASE WHEN p > 1e-6 THEN marginal_pd / p ELSE 0 END AS conditional_pd,
       CASE WHEN p > 1e-6 THEN marginal_pd / p ELSE 0 END AS hazard, 1 - cumulative_pd AS survival_probability
FROM (SELECT *, greatest(0, coalesce(1 - lag(cumulative_pd) OVER (PARTITION BY date, rating ORDER BY month), 1)) AS p
      FROM (SELECT date, rating, month, sum(weighted_marginal_pd) AS marginal_pd, sum(weighted_cumulative_pd) AS cumulative_pd,
                   sum(scenario_weight) AS scenario_weight_sum FROM x_curves GROUP BY ALL))""", ints="month",
       r6=CURVE_R6 + " scenario_weight_sum")
def _(t):
    return macro.weighted_lifetime(t("curves"), 1e-6)


BT = ", ".join(f"sqrt(avg({m}_residual ** 2)) AS {m}_rmse, avg(abs({m}_residual)) AS {m}_mae, avg({m}_residual ** 2) AS {m}_brier"
               for m in ("vasicek", "satellite"))


@query("ma15_historical_backtest", f"""
SELECT 'ALL' AS window, {BT} FROM x_fits
UNION ALL SELECT 'STRESS', {BT} FROM x_fits WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'""",
       r6=" ".join(f"{m}_{k}" for m in ("vasicek", "satellite") for k in ("rmse", "mae", "brier")))
def _(t):
    fits = demo.macro_fits(t)
    whole = macro.backtest(fits).select(F.lit("ALL").alias("window"), "*")
    return whole.unionByName(macro.backtest(macro.stress_slice(fits, CFG)).select(F.lit("STRESS").alias("window"), "*"))


WHAT_IF = replace(CFG, shocks={"BASE": {"unemployment_rate": 0.5}, "UPSIDE": {"house_price_index_yoy": 6.0},
                               "DOWNSIDE": {"unemployment_rate": 4.0, "real_gdp_yoy": -6.0}})


@query("ma16_macro_what_if", f"""
SELECT date, rating, sum(weighted_pd_12m) AS weighted_pd_12m, sum(scenario_weight) AS scenario_weight_sum, any_value(ttc_pd) AS ttc_pd
FROM ({spd_sql(f'({factors_sql(f"({path_sql(WHAT_IF)})")})')}) GROUP BY ALL""", r6="weighted_pd_12m scenario_weight_sum ttc_pd")
def _(t):
    return demo.macro_what_if(t, WHAT_IF)
