"""Queries over default episodes and the loss-given-default tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossloom.functions.exprs import expit, tagged_rows
from lossloom.operators import joint_fits, lgd, ml_pipeline
from lossloom.plans import demo, lgd_models
from lossloom.plans.q_scorecard import ranking_sql
from lossloom.plans.registry import query
from lossloom.plans.sqlchain import cte, mdiff
from lossloom.sources.store import cut_lineage

_at = ", ".join(f"m.{c} AS {c}_at_default" for c in lgd.AT_DEFAULT)
# The exposure is the first positive balance of the default month and the month before it.
cte("x_entry", """
SELECT loan_id, as_of_date AS day, [x for x in [{'upb': current_actual_upb, 'src': 'current_actual_upb'}, {'upb': current_upb_lag_1, 'src': 'prior_month_current_upb'}]
       if x.upb > 0][1] AS first_positive FROM x_mart""")
cte("x_ep_base", f"""
SELECT e.* EXCLUDE (default_entry_date, redefault_date), e.default_entry_date AS default_date,
       coalesce(x.first_positive.upb, CASE WHEN m.current_actual_upb = 0 THEN m.current_upb_lag_1 ELSE coalesce(m.current_actual_upb, m.current_upb_lag_1) END)
           AS ead_at_default,
       coalesce(x.first_positive.src, 'unavailable') AS ead_at_default_source, {_at}, {', '.join('s.' + c for c in lgd.STATIC)}
FROM x_events e LEFT JOIN x_mart m ON (m.loan_id, m.as_of_date) = (e.loan_id, e.default_entry_date)
LEFT JOIN x_entry x ON (x.loan_id, x.day) = (e.loan_id, e.default_entry_date)
LEFT JOIN x_static s ON (s.loan_id, s.vintage_year) = (e.loan_id, e.vintage_year)""")
cte("x_exits", f"""
SELECT loan_id AS exit_loan, as_of_date AS terminal_date,
       {', '.join("TRY_CAST(nullif(net_sale_proceeds, 'U') AS DOUBLE) AS net_sale_proceeds" if c == 'net_sale_proceeds' else c for c in lgd.TERMINAL)}
FROM x_mart WHERE length(zero_balance_code) > 0""")
cte("x_terminal", """
SELECT e.loan_id, e.default_episode_id, t.* EXCLUDE (exit_loan)
FROM x_ep_base e ASOF JOIN x_exits t ON t.exit_loan = e.loan_id AND e.default_date <= t.terminal_date
WHERE t.terminal_date <= e.default_date + INTERVAL 60 MONTH""")
cte("x_rated", """
SELECT e.*, p.rating AS rating_at_default FROM x_ep_base e ASOF LEFT JOIN x_preds p ON p.loan_id = e.loan_id AND e.default_date >= p.as_of_date""")
cte("x_kinds", """
SELECT code, coalesce(nullif(default_reason, 'REO_DISPOSITION'), CASE WHEN default_reason IS NULL THEN 'OTHER_DOCUMENTED_TERMINAL' ELSE 'REO_FORECLOSURE' END)
           AS kind FROM x_codes""")
# The earliest way out of an episode, a cure before anything else on the same day.
cte("x_outcome", """
SELECT loan_id, default_episode_id, min(day) AS resolution_date, arg_min(kind, day + later * INTERVAL 1 HOUR) AS resolution_type
FROM (SELECT loan_id, default_episode_id, cure_date AS day, 0 AS later, 'CURE' AS kind FROM x_ep_base WHERE cure_date IS NOT NULL
      UNION ALL SELECT loan_id, default_episode_id, terminal_date, 1, coalesce(kind, 'UNRESOLVED') FROM x_terminal LEFT JOIN x_kinds ON code = zero_balance_code)
GROUP BY ALL""")
cte("x_bands", "SELECT * FROM (VALUES (60, '<=60'), (80, '60-80'), (100, '80-100'), (1000000, '>100')) AS b(top, band)")
cte("x_resolved", f"""
SELECT r.*, t.* EXCLUDE (loan_id, default_episode_id), o.resolution_date, coalesce(o.resolution_type, 'UNRESOLVED') AS resolution_type,
       coalesce(o.resolution_type, 'UNRESOLVED') <> 'UNRESOLVED' AS resolved_flag, coalesce(o.resolution_type = 'CURE', false) AS cured_flag,
       CASE WHEN o.resolution_type <> 'UNRESOLVED' THEN {mdiff('r.default_date', 'o.resolution_date')} END AS months_to_resolution,
       coalesce(b.band, 'UNKNOWN') AS current_ltv_band
FROM x_rated r
LEFT JOIN x_terminal t USING (loan_id, default_episode_id)
LEFT JOIN x_outcome o ON o.loan_id = r.loan_id AND o.default_episode_id = r.default_episode_id
ASOF LEFT JOIN x_bands b ON r.estimated_loan_to_value_at_default <= b.top""")


def total(cols) -> str:
    return " + ".join(f"coalesce({c}, 0e0)" for c in cols)


cte("x_episodes", f"""
SELECT *, CASE WHEN resolved_flag AND lgd_exposure_basis > 0 THEN economic_loss / lgd_exposure_basis END AS realized_lgd_raw,
       CASE WHEN resolved_flag AND lgd_exposure_basis > 0 THEN least(greatest(economic_loss / lgd_exposure_basis, 0), 1.5e0) END
           AS realized_lgd_model_target,
       year(default_date)::BIGINT AS default_year,
       CASE WHEN default_date <= DATE '1997-12-01' THEN 'TRAIN' WHEN default_date <= DATE '1998-12-01' THEN 'VALIDATION'
            WHEN default_date <= DATE '2000-08-01' THEN 'OOT' ELSE 'OUT_OF_TIME' END AS split
FROM (SELECT *, CASE WHEN cure_lgd_fallback_used THEN 0 ELSE coalesce(lgd_exposure_basis, 0) + discounted_recoveries + discounted_model_costs END
                 AS economic_loss
  FROM (SELECT *, signed_recoveries * d AS discounted_recoveries, costs * d AS discounted_costs, (costs + mods) * d AS discounted_model_costs,
               cured_flag AND observed = 0 AND actual_loss IS NULL AS cure_lgd_fallback_used
    FROM (SELECT *, pow(1 + coalesce(current_interest_rate_at_default, original_interest_rate, 0) / 100 / 12,
                        -greatest(coalesce(months_to_resolution, 0), 0)) AS d,
                 {total(lgd.RECOVERIES)} AS signed_recoveries, {total(lgd.COSTS)} AS costs, {total(lgd.MODIFICATION_COSTS)} AS mods,
                 {' + '.join(f'abs(coalesce({c}, 0e0))' for c in lgd.RECOVERIES + lgd.COSTS + lgd.MODIFICATION_COSTS)} AS observed,
                 {total(lgd.RECONCILED)} AS reconstructed_actual_loss,
                 CASE WHEN resolved_flag AND zero_balance_removal_upb > 0 THEN zero_balance_removal_upb ELSE ead_at_default END
                     AS lgd_exposure_basis,
                 CASE WHEN resolved_flag AND zero_balance_removal_upb > 0 THEN 'zero_balance_removal_upb' ELSE ead_at_default_source END
                     AS lgd_exposure_basis_source
          FROM x_resolved)))""")

cte("x_pred0", f"""
SELECT *, round({demo.LGD_SQL['p_raw']}, 9) AS predicted_cure_probability_raw, round({demo.LGD_SQL['cure']}, 9) AS predicted_cure_lgd,
       round({demo.LGD_SQL['other']}, 9) AS predicted_non_cure_lgd
FROM x_episodes""")
cte("x_pred1", """
SELECT *, p * predicted_cure_lgd + (1 - p) * predicted_non_cure_lgd AS predicted_lgd_uncalibrated
FROM (SELECT *, p AS predicted_cure_probability
      FROM (SELECT *, round(1 / (1 + exp(-(0.1e0 + 0.9e0 * ln(predicted_cure_probability_raw / (1 - predicted_cure_probability_raw))))), 9) AS p
            FROM x_pred0))""")
cte("x_pred2", """
SELECT * EXCLUDE (p), f AS expected_lgd_calibration_factor, least(greatest(predicted_lgd_uncalibrated * f, 0), 1) AS predicted_lgd
FROM x_pred1, (SELECT coalesce(avg(realized_lgd_model_target) / avg(predicted_lgd_uncalibrated), 1) AS f FROM x_pred1
               WHERE split = 'VALIDATION' AND resolved_flag)""")
cte("x_downturn", """
SELECT rating_at_default, greatest(1, coalesce(avg(realized_lgd_model_target) FILTER (default_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-01')
                                               / nullif(avg(realized_lgd_model_target), 0), 1)) AS downturn_overlay_factor
FROM x_pred2 WHERE resolved_flag AND rating_at_default IS NOT NULL GROUP BY rating_at_default""")
cte("x_lgd", """
SELECT p.*, coalesce(d.downturn_overlay_factor, 1) AS downturn_overlay_factor, p.predicted_lgd AS lgd_base,
       least(greatest(p.predicted_lgd * coalesce(d.downturn_overlay_factor, 1), 0), 1) AS lgd_downturn
FROM x_pred2 p LEFT JOIN x_downturn d ON d.rating_at_default = p.rating_at_default""")

BASE_COLS = ["loan_id", "default_episode_id", "default_date", "ead_at_default", "ead_at_default_source",
             "estimated_loan_to_value_at_default", "months_since_origination_at_default", "original_ltv", "channel"]


def base(t):
    return lgd.episode_base(t("events"), t("mart"), t("static"))


@query("lg01_episode_base", f"SELECT {', '.join(BASE_COLS)} FROM x_ep_base", r6="ead_at_default",
       ints="default_episode_id estimated_loan_to_value_at_default months_since_origination_at_default original_ltv")
def _(t):
    return base(t).select(*BASE_COLS)


TERM_COLS = ["loan_id", "default_episode_id", "terminal_date", "zero_balance_code", "net_sale_proceeds", "total_expenses", "actual_loss",
             "delinquent_accrued_interest"]


@query("lg02_first_terminal", f"SELECT {', '.join(TERM_COLS)} FROM x_terminal", ints="default_episode_id",
       r6="net_sale_proceeds total_expenses actual_loss delinquent_accrued_interest")
def _(t):
    return lgd.first_terminal(base(t), t("mart"), t.cfg.lgd).select(*TERM_COLS)


@query("lg03_rating_at_default", "SELECT loan_id, default_episode_id, default_date, rating_at_default FROM x_rated", ints="default_episode_id")
def _(t):
    return lgd.rating_at_default(base(t), t("preds")).select("loan_id", "default_episode_id", "default_date", "rating_at_default")


RES_COLS = ["loan_id", "default_episode_id", "resolution_date", "resolution_type", "resolved_flag", "cured_flag", "months_to_resolution",
            "current_ltv_band"]


@query("lg04_resolution", f"SELECT {', '.join(RES_COLS)} FROM x_resolved", ints="default_episode_id months_to_resolution")
def _(t):
    b = base(t)
    return lgd.resolve(lgd.rating_at_default(b, t("preds")), lgd.first_terminal(b, t("mart"), t.cfg.lgd)).select(*RES_COLS)


LOSS_COLS = ["loan_id", "default_episode_id", "lgd_exposure_basis", "lgd_exposure_basis_source", "discounted_recoveries", "discounted_costs",
             "discounted_model_costs", "reconstructed_actual_loss", "cure_lgd_fallback_used", "economic_loss", "realized_lgd_raw",
             "realized_lgd_model_target"]


@query("lg05_economic_loss", f"SELECT {', '.join(LOSS_COLS)} FROM x_episodes", ints="default_episode_id",
       r6="lgd_exposure_basis discounted_recoveries discounted_costs discounted_model_costs reconstructed_actual_loss economic_loss "
          "realized_lgd_raw realized_lgd_model_target")
def _(t):
    return t("episodes").select(*LOSS_COLS)


@query("lg06_temporal_split", "SELECT loan_id, default_episode_id, default_year, split FROM x_episodes", ints="default_episode_id default_year")
def _(t):
    return t("episodes").select("loan_id", "default_episode_id", "default_year", "split")


PREDICTORS = [*lgd.NUMERIC, *lgd.CATEGORICAL]


@query("lg07_leakage_guard", " UNION ALL ".join(f"SELECT '{c}' AS predictor, count({c}) AS non_null_rows FROM x_episodes" for c in PREDICTORS))
def _(t):
    """Fill of every predictor that passes the guard; an outcome field in the list raises before any job runs."""
    names = lgd.validated_predictors(PREDICTORS)
    wide = t("episodes").agg(*[F.count(c).alias(c) for c in names])
    return wide.unpivot([], names, "predictor", "non_null_rows")


def cure_line(t):
    """Training rows with balanced weights, and the cure model fitted on them."""
    sup = lgd.supervised(t("episodes")).where("split = 'TRAIN'")
    pipe = ml_pipeline.fit_features(sup, lgd.NUMERIC, lgd.CATEGORICAL)
    train = joint_fits.with_class_balance(sup.withColumns({"y": F.col("cured_flag").cast("int"), "w": F.lit(1.0)}), "y", ["w"])
    train = cut_lineage(pipe.arrays(train), "cure_line")
    return pipe, train, joint_fits.fit_logistic(train, {"m": joint_fits.Fit("x", "y", "w", 1.0)})["m"]


@query("lg08_feature_pipeline")
def _(t):
    pipe, _train, line = cure_line(t)
    return pipe.arrays(t("episodes")).withColumn("p", expit(line.predict("x"))).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("p").alias("predicted_cure_rate"))


BALANCED = """CASE WHEN sum(cured_flag::INT) OVER () IN (0, count(*) OVER ()) THEN 1e0
WHEN cured_flag THEN count(*) OVER () / (2 * sum(cured_flag::INT) OVER ()) ELSE count(*) OVER () / (2 * (count(*) OVER () - sum(cured_flag::INT) OVER ())) END"""


@query("lg08_score_equation", f"""
SELECT count(*) AS rows, avg(w * cured_flag::INT) AS observed, avg(w * cured_flag::INT) AS predicted
FROM (SELECT *, {BALANCED} AS w FROM x_episodes WHERE resolved_flag AND ead_at_default > 0 AND split = 'TRAIN')""", r6="observed predicted")
def _(t):
    """A logistic model with a free intercept reproduces the weighted cure rate of the rows it was fitted on."""
    _pipe, train, line = cure_line(t)
    return train.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("w") * F.col("y")).alias("observed"),
                     F.avg(F.col("w") * expit(line.predict("x"))).alias("predicted"))


def weight_sql(expr: str, label: str) -> str:
    return f"""
SELECT loan_id, default_episode_id, '{label}' AS weighting, w / avg(w) OVER () AS w
FROM (SELECT loan_id, default_episode_id, {expr} AS w
      FROM (SELECT *, (max(default_date) OVER () - default_date) / 30.4375e0 AS age FROM x_episodes
            WHERE resolved_flag AND ead_at_default > 0 AND split = 'TRAIN'))"""


@query("lg09_temporal_weights", weight_sql("1e0", "none") + " UNION ALL " + weight_sql("1 + (1 - age / greatest(max(age) OVER (), 1))", "linear_recency")
       + "".join(" UNION ALL " + weight_sql(f"exp(-age / {m}e0)", f"exponential_recency_{m}m") for m in (12, 24, 36)),
       ints="default_episode_id", r6="w")
def _(t):
    train = lgd.supervised(t("episodes")).where("split = 'TRAIN'")
    out = None
    for m, d in lgd.WEIGHTINGS:
        part = lgd.with_temporal_weight(train, m, d).select("loan_id", "default_episode_id", F.lit(lgd.weight_label(m, d)).alias("weighting"), "w")
        out = part if out is None else out.unionByName(part)
    return out


@query("lg10_cure_challengers")
def _(t):
    return lgd_models.cure_challengers(t("episodes"))[1]


def by_weighting(inner: str, select: str) -> str:
    """One SELECT per weighting over training rows that carry their weight w."""
    exprs = {"none": "1e0", "linear_recency": "1 + (1 - age / greatest(max(age) OVER (), 1))"}
    exprs |= {f"exponential_recency_{m}m": f"exp(-age / {m}e0)" for m in (12, 24, 36)}
    return " UNION ALL ".join(f"""
SELECT '{label}' AS weighting, {select} FROM (SELECT *, raw / avg(raw) OVER () AS w FROM (SELECT *, {e} AS raw FROM (
SELECT *, (max(default_date) OVER () - default_date) / 30.4375e0 AS age FROM x_episodes WHERE resolved_flag AND ead_at_default > 0 AND split = 'TRAIN' {inner})))"""
                              for label, e in exprs.items())


@query("lg10_score_equations", by_weighting("", "count(*) AS rows, avg(w * b * cured_flag::INT) AS observed, avg(w * b * cured_flag::INT) AS predicted").replace(
    "SELECT *, raw / avg(raw) OVER () AS w", f"SELECT *, raw / avg(raw) OVER () AS w, {BALANCED} AS b"), r6="observed predicted")
def _(t):
    """Each cure challenger reproduces the weighted cure rate of its training rows."""
    scored, _table = lgd_models.cure_challengers(t("episodes"))
    rows = lgd.with_temporal_weights(lgd.supervised(t("episodes")).where("split = 'TRAIN'"), lgd.WEIGHTINGS)
    rows = joint_fits.with_class_balance(rows.withColumn("y", F.col("cured_flag").cast("int")), "y", [f"w_{n}" for n in lgd_models.LABELS])
    key = ["loan_id", "default_episode_id"]
    rows = rows.join(scored.select(*key, *[f"raw_{n}" for n in lgd_models.LABELS]), key)
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(f"w_{n}") * F.col(c)).alias(f"{k}_{n}") for n in lgd_models.LABELS
                                                       for k, c in (("o", "y"), ("p", f"raw_{n}"))])
    return tagged_rows(sums, [], [[F.lit(n), F.col("rows"), F.col(f"o_{n}"), F.col(f"p_{n}")] for n in lgd_models.LABELS],
                       ["weighting", "rows", "observed", "predicted"])


LTV = "coalesce(original_ltv, avg(original_ltv) OVER ())"


def normal_sql(inner: str) -> str:
    y, cross = "avg(w * realized_lgd_model_target)", "avg(w * ltv * realized_lgd_model_target) / 100"
    return by_weighting(inner, f"count(*) AS rows, {y} AS observed, {y} AS predicted, {cross} AS observed_by_ltv, {cross} AS predicted_by_ltv").replace(
        "SELECT *, raw / avg(raw) OVER () AS w", f"SELECT *, raw / avg(raw) OVER () AS w, {LTV} AS ltv")


def normal_equations(rows, pairs: dict[str, tuple[str, str]]):
    """Weighted means of outcome and prediction, plain and times the imputed loan-to-value, per (weight column, prediction column)."""
    rows = rows.crossJoin(rows.agg(F.avg("original_ltv").alias("_ltv"))).withColumn("ltv", F.coalesce(F.col("original_ltv").cast("double"), "_ltv") / 100)
    aggs = [F.avg(F.col(w) * F.col(v) * x).alias(f"{k}_{n}") for n, (w, p) in pairs.items()
            for k, v, x in (("o", lgd.TARGET, F.lit(1.0)), ("p", p, F.lit(1.0)), ("ol", lgd.TARGET, F.col("ltv")), ("pl", p, F.col("ltv")))]
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    return tagged_rows(sums, [], [[F.lit(n), F.col("rows"), *[F.col(f"{k}_{n}") for k in ("o", "p", "ol", "pl")]] for n in pairs],
                       ["weighting", "rows", "observed", "predicted", "observed_by_ltv", "predicted_by_ltv"])


NORMAL = "observed predicted observed_by_ltv predicted_by_ltv"


@query("lg11_normal_equations", normal_sql("AND NOT cured_flag"), r6=NORMAL)
def _(t):
    """Residuals of each linear severity model are orthogonal to the intercept and to a predictor, under its own weights."""
    train = lgd.supervised(t("episodes")).where("split = 'TRAIN' AND NOT cured_flag")
    lines = lgd_models.severity_lines(t("episodes")).select("loan_id", "default_episode_id", *[f"linear_{n}" for n in lgd_models.LABELS])
    rows = lgd.with_temporal_weights(train, lgd.WEIGHTINGS).join(lines, ["loan_id", "default_episode_id"])
    return normal_equations(rows, {n: (f"w_{n}", f"linear_{n}") for n in lgd_models.LABELS})


@query("lg13_normal_equations", normal_sql("AND cured_flag").split(" UNION ALL ")[0], r6=NORMAL)
def _(t):
    """The same for the unweighted cure severity."""
    train = lgd.supervised(t("episodes")).where("split = 'TRAIN' AND cured_flag").withColumn("one", F.lit(1.0))
    lines = lgd_models.cure_lgd_lines(t("episodes")).select("loan_id", "default_episode_id", "bounded_regression")
    return normal_equations(train.join(lines, ["loan_id", "default_episode_id"]), {"none": ("one", "bounded_regression")})


@query("lg11_severity_challengers")
def _(t):
    return lgd_models.severity_challengers(t("episodes"))[1]


@query("lg12_segment_calibrator", """
WITH v AS (SELECT * FROM x_pred2 WHERE split = 'VALIDATION' AND resolved_flag AND NOT cured_flag),
g AS (SELECT coalesce(avg(realized_lgd_model_target) / nullif(avg(predicted_non_cure_lgd), 0), 1) AS g FROM v)
SELECT rating_at_default, n / (n + 100) * f + (1 - n / (n + 100)) * g AS factor
FROM (SELECT rating_at_default, count(*) AS n, coalesce(avg(realized_lgd_model_target) / nullif(avg(predicted_non_cure_lgd), 0), 1) AS f
      FROM v WHERE rating_at_default IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), g
UNION ALL SELECT NULL, g FROM g""", r6="factor")
def _(t):
    return lgd.segment_factors(t("lgd"), "predicted_non_cure_lgd", minimum=5)


@query("lg12_segment_calibrated", """
WITH v AS (SELECT * FROM x_pred2 WHERE split = 'VALIDATION' AND resolved_flag AND NOT cured_flag),
g AS (SELECT coalesce(avg(realized_lgd_model_target) / nullif(avg(predicted_non_cure_lgd), 0), 1) AS g FROM v),
s AS (SELECT rating_at_default, n / (n + 100) * f + (1 - n / (n + 100)) * g AS factor
      FROM (SELECT rating_at_default, count(*) AS n, avg(realized_lgd_model_target) / avg(predicted_non_cure_lgd) AS f
            FROM v WHERE rating_at_default IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), g)
SELECT loan_id, default_episode_id, least(greatest(predicted_non_cure_lgd * coalesce(s.factor, g), 0), 1) AS calibrated
FROM x_pred2 p LEFT JOIN s ON s.rating_at_default = p.rating_at_default, g""", ints="default_episode_id", r6="calibrated")
def _(t):
    f = lgd.segment_factors(t("lgd"), "predicted_non_cure_lgd", minimum=5)
    return lgd.apply_segment_factors(t("lgd"), f, "predicted_non_cure_lgd", "calibrated").select("loan_id", "default_episode_id", "calibrated")


@query("lg13_cure_lgd_candidates")
def _(t):
    return lgd_models.cure_lgd_candidates(t("episodes"))[1]


@query("lg14_combined_lgd", """SELECT loan_id, default_episode_id, predicted_cure_probability, predicted_lgd_uncalibrated,
expected_lgd_calibration_factor, predicted_lgd FROM x_pred2""", ints="default_episode_id",
       r6="predicted_cure_probability predicted_lgd_uncalibrated expected_lgd_calibration_factor predicted_lgd")
def _(t):
    return t("lgd").select("loan_id", "default_episode_id", "predicted_cure_probability", "predicted_lgd_uncalibrated",
                           "expected_lgd_calibration_factor", "predicted_lgd")


def pair_sql(a: str, acol: str, b: str, bcol: str) -> str:
    return f"""
SELECT '{a}' AS cure_model, '{b}' AS severity_model, f AS expected_lgd_calibration_factor, abs(avg(y) / avg(p) - 1) AS validation_abs_oe_error,
       abs(avg(c) - avg(cured_flag::INT)) AS validation_cure_abs_calibration_error,
       abs(avg(y) FILTER (NOT cured_flag) / avg(s) FILTER (NOT cured_flag) - 1) AS validation_non_cure_abs_oe_error,
       avg(abs(y - p)) AS validation_mae, sqrt(avg((y - p) ** 2)) AS validation_rmse
FROM (SELECT *, least(greatest(u * f, 0), 1) AS p
      FROM (SELECT realized_lgd_model_target AS y, cured_flag, {acol} AS c, {bcol} AS s, {acol} * predicted_cure_lgd + (1 - {acol}) * {bcol} AS u,
                   avg(realized_lgd_model_target) OVER () / avg({acol} * predicted_cure_lgd + (1 - {acol}) * {bcol}) OVER () AS f
            FROM x_pred2 WHERE split = 'VALIDATION' AND resolved_flag)) GROUP BY f"""


CURES = {"raw": "predicted_cure_probability_raw", "recalibrated": "predicted_cure_probability"}
SEVERITIES = {"linear": "predicted_non_cure_lgd", "half": "half_severity"}
RANK_R6 = ("expected_lgd_calibration_factor validation_abs_oe_error validation_cure_abs_calibration_error "
           "validation_non_cure_abs_oe_error validation_mae validation_rmse")
_pairs = " UNION ALL ".join(pair_sql(a, ac, b, "(predicted_non_cure_lgd / 2)" if b == "half" else bc)
                            for a, ac in CURES.items() for b, bc in SEVERITIES.items())


@query("lg14_candidate_ranking", f"""
SELECT *, row_number() OVER (ORDER BY validation_abs_oe_error, validation_cure_abs_calibration_error, validation_non_cure_abs_oe_error,
                             validation_mae, validation_rmse, cure_model, severity_model) AS selection_rank
FROM (SELECT cure_model, severity_model, {', '.join(f'round({c}, 9) AS {c}' for c in RANK_R6.split())} FROM ({_pairs}))""", r6=RANK_R6)
def _(t):
    df = t("lgd").withColumn("half_severity", F.col("predicted_non_cure_lgd") / 2)
    return lgd.combined_ranking(df, CURES, SEVERITIES, digits=9)


@query("lg15_downturn_overlay", "SELECT * FROM x_downturn", r6="downturn_overlay_factor")
def _(t):
    return lgd.downturn_factors(t("lgd"), "historical_stress", demo.STRESS)


@query("lg15_downturn_quantile", """
SELECT rating_at_default, greatest(1, coalesce(quantile_cont(realized_lgd_model_target, 0.75) / nullif(avg(realized_lgd_model_target), 0), 1))
           AS downturn_overlay_factor
FROM x_pred2 WHERE resolved_flag AND rating_at_default IS NOT NULL GROUP BY rating_at_default""", r6="downturn_overlay_factor")
def _(t):
    return lgd.downturn_factors(t("lgd"), "quantile", demo.STRESS)


@query("lg15_downturn_lgd", "SELECT loan_id, default_episode_id, lgd_base, lgd_downturn FROM x_lgd", ints="default_episode_id", r6="lgd_base lgd_downturn")
def _(t):
    return t("lgd").select("loan_id", "default_episode_id", "lgd_base", "lgd_downturn")


Y = "realized_lgd_model_target"


def metric_sql(model: str, pop: str, cond: str, pred: str) -> str:
    return f"""
SELECT split, '{model}' AS model, '{pop}' AS population, count(*) AS rows, avg(abs({Y} - {pred})) AS mae, sqrt(avg(({Y} - {pred}) ** 2)) AS rmse,
       avg({Y}) AS realized_mean, avg({pred}) AS predicted_mean, NULL::DOUBLE AS roc_auc
FROM x_pred2 WHERE resolved_flag AND {cond} GROUP BY split"""


cte("x_cure_rows", "SELECT *, cured_flag::INT AS y, 1e0 AS one FROM x_pred2 WHERE resolved_flag")


@query("lg16_model_metrics", " UNION ALL ".join([
    metric_sql("expected_lgd", "all_resolved", "true", "predicted_lgd"), metric_sql("cure_lgd", "cured_resolved", "cured_flag", "predicted_cure_lgd"),
    metric_sql("non_cure_severity", "non_cure_resolved", "NOT cured_flag", "predicted_non_cure_lgd"), f"""
SELECT a.split, 'cure', 'all_resolved', n, NULL, NULL, oc, pc, roc_auc
FROM ({ranking_sql('split', 'predicted_cure_probability', 'x_cure_rows', 'y', 'one')}) a
JOIN (SELECT split, count(*) AS n, avg(y) AS oc, avg(predicted_cure_probability) AS pc FROM x_cure_rows GROUP BY split) b ON b.split = a.split
WHERE oc > 0 AND oc < 1"""]), r6="mae rmse realized_mean predicted_mean roc_auc")
def _(t):
    return lgd.model_metrics(t("lgd"))


@query("lg17_backtest_splits", f"""
SELECT split, count(*) AS default_episodes, count(*) FILTER (resolved_flag) AS resolved_defaults,
       count(*) FILTER (NOT resolved_flag) AS unresolved_defaults, avg(cured_flag::INT) FILTER (resolved_flag) AS cure_rate,
       avg({Y}) FILTER (resolved_flag) AS realized_mean_lgd, median({Y}) FILTER (resolved_flag) AS realized_median_lgd,
       avg(predicted_lgd) FILTER (resolved_flag) AS predicted_lgd,
       avg({Y}) FILTER (resolved_flag) / avg(predicted_lgd) FILTER (resolved_flag) AS oe_ratio,
       avg(abs({Y} - predicted_lgd)) FILTER (resolved_flag) AS mae, sqrt(avg(({Y} - predicted_lgd) ** 2) FILTER (resolved_flag)) AS rmse
FROM x_pred2 GROUP BY split""", r6="cure_rate realized_mean_lgd realized_median_lgd predicted_lgd oe_ratio mae rmse")
def _(t):
    return lgd.backtest_splits(t("lgd"))


DEC_R6 = ("observed_p_cure observed_lgd_cure observed_p_non_cure observed_lgd_non_cure observed_combined_lgd predicted_p_cure predicted_lgd_cure "
          "predicted_p_non_cure predicted_lgd_non_cure predicted_branch_elgd expected_lgd_calibration_factor calibrated_branch_elgd "
          "predicted_combined_lgd branch_reconciliation_difference")


@query("lg18_component_decomposition", f"""
SELECT *, predicted_branch_elgd * expected_lgd_calibration_factor AS calibrated_branch_elgd,
       predicted_branch_elgd * expected_lgd_calibration_factor - predicted_combined_lgd AS branch_reconciliation_difference
FROM (SELECT split, count(*) AS rows, avg(cured_flag::INT) AS observed_p_cure, avg({Y}) FILTER (cured_flag) AS observed_lgd_cure,
             1 - avg(cured_flag::INT) AS observed_p_non_cure, avg({Y}) FILTER (NOT cured_flag) AS observed_lgd_non_cure,
             avg({Y}) AS observed_combined_lgd, avg(predicted_cure_probability) AS predicted_p_cure, avg(predicted_cure_lgd) AS predicted_lgd_cure,
             1 - avg(predicted_cure_probability) AS predicted_p_non_cure, avg(predicted_non_cure_lgd) AS predicted_lgd_non_cure,
             avg(predicted_lgd_uncalibrated) AS predicted_branch_elgd, any_value(expected_lgd_calibration_factor) AS expected_lgd_calibration_factor,
             avg(predicted_lgd) AS predicted_combined_lgd
      FROM x_pred2 WHERE resolved_flag GROUP BY split)""", r6=DEC_R6)
def _(t):
    return lgd.decomposition(t("lgd"))


DRIFT_NUM = [*lgd.NUMERIC, "default_year"]
DRIFT_CAT = [*lgd.CATEGORICAL, "current_ltv_band"]


def psi_cells_sql(cells: str) -> str:
    """PSI per feature and split from (feature, split, bucket) rows."""
    return f"""
psi AS (SELECT g.feature, g.split, sum((a - e) * ln(a / e)) AS psi_vs_train FROM (
  SELECT b.feature, b.bucket, s.split,
         greatest(coalesce(sum(c.n) / any_value(s.n), 0), 1e-6) AS a, greatest(coalesce(sum(tr.n) / any_value(s.tn), 0), 1e-6) AS e
  FROM (SELECT DISTINCT feature, bucket FROM {cells}) b
  JOIN (SELECT feature, split, sum(n) AS n, any_value(tn) AS tn FROM (
          SELECT *, sum(CASE WHEN split = 'TRAIN' THEN n ELSE 0 END) OVER (PARTITION BY feature) AS tn FROM {cells}) GROUP BY ALL) s ON s.feature = b.feature
  LEFT JOIN {cells} c ON c.feature = b.feature AND c.bucket = b.bucket AND c.split = s.split
  LEFT JOIN {cells} tr ON tr.feature = b.feature AND tr.bucket = b.bucket AND tr.split = 'TRAIN' GROUP BY ALL) g GROUP BY ALL)"""


@query("lg19_numeric_drift", f"""
WITH long AS MATERIALIZED ({' UNION ALL '.join(f"SELECT split, '{c}' AS feature, {c}::DOUBLE AS value FROM x_episodes" for c in DRIFT_NUM)}),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q
          FROM long WHERE split = 'TRAIN' AND value IS NOT NULL GROUP BY feature),
cells AS MATERIALIZED (
  SELECT l.feature, l.split, CASE WHEN l.value IS NULL THEN -1 WHEN len(e.q) > 1 THEN len(list_filter(e.q[2:len(e.q) - 1], lambda x: x < l.value))
         ELSE len(list_filter(e.q, lambda x: x < l.value)) END AS bucket, count(*) AS n
  FROM long l LEFT JOIN edges e ON e.feature = l.feature GROUP BY ALL),
{psi_cells_sql('cells')},
stats AS (SELECT feature, split, 1 - count(value) / count(*) AS missing_rate, avg(value) AS mean, quantile_cont(value, 0.25) AS p25,
                 quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75 FROM long GROUP BY ALL)
SELECT s.feature, 'numeric' AS feature_type, s.split, psi_vs_train, s.missing_rate, t.missing_rate AS train_missing_rate, s.mean,
       t.mean AS train_mean, s.p25, s.median, s.p75, psi_vs_train >= 0.25 AS unstable_flag
FROM stats s JOIN psi ON psi.feature = s.feature AND psi.split = s.split JOIN stats t ON t.feature = s.feature AND t.split = 'TRAIN'""",
       r6="psi_vs_train missing_rate train_missing_rate mean train_mean p25 median p75")
def _(t):
    return lgd.numeric_drift(t("episodes"), DRIFT_NUM)


def cat_drift_sql(cols, kind: str) -> str:
    return f"""
(WITH cells AS MATERIALIZED (SELECT feature, split, bucket, count(*) AS n FROM (
  {' UNION ALL '.join(f"SELECT split, '{c}' AS feature, coalesce({c}::VARCHAR, '__MISSING__') AS bucket FROM x_episodes" for c in cols)}) GROUP BY ALL),
{psi_cells_sql('cells')},
stats AS (SELECT feature, split, coalesce(sum(n) FILTER (bucket = '__MISSING__'), 0) / sum(n) AS missing_rate,
                 arg_min(bucket, (-n, bucket)) AS top_category, max(n) / sum(n) AS top_category_share FROM cells GROUP BY ALL)
SELECT s.feature, '{kind}' AS feature_type, s.split, psi_vs_train, s.missing_rate, t.missing_rate AS train_missing_rate, s.top_category,
       s.top_category_share, psi_vs_train >= 0.25 AS unstable_flag
FROM stats s JOIN psi ON psi.feature = s.feature AND psi.split = s.split JOIN stats t ON t.feature = s.feature AND t.split = 'TRAIN')"""


@query("lg19_categorical_drift", f"SELECT * FROM {cat_drift_sql(DRIFT_CAT, 'predictor')} UNION ALL SELECT * FROM "
       f"{cat_drift_sql(['resolution_type'], 'outcome_diagnostic')}", r6="psi_vs_train missing_rate train_missing_rate top_category_share")
def _(t):
    return lgd.categorical_drift(t("episodes"), DRIFT_CAT).unionByName(
        lgd.categorical_drift(t("episodes"), ["resolution_type"], "outcome_diagnostic"))


def op_sql(keys: str) -> str:
    return f"""
SELECT {keys}, count(*) AS resolved_defaults, avg({Y}) AS realized_lgd, avg(predicted_lgd) AS predicted_lgd,
       avg({Y}) / nullif(avg(predicted_lgd), 0) AS oe_ratio
FROM x_pred2 WHERE resolved_flag AND {' AND '.join(k.strip() + ' IS NOT NULL' for k in keys.split(','))} GROUP BY ALL"""


@query("lg20_observed_predicted", op_sql("split, rating_at_default"), r6="realized_lgd predicted_lgd oe_ratio")
def _(t):
    return lgd.observed_predicted(t("lgd"), ["split", "rating_at_default"])


@query("lg20_observed_predicted_year", op_sql("default_year, resolution_type"), ints="default_year", r6="realized_lgd predicted_lgd oe_ratio")
def _(t):
    return lgd.observed_predicted(t("lgd"), ["default_year", "resolution_type"])


@query("lg21_recovery_timing", """
SELECT split, resolution_type, count(months_to_resolution) AS count, avg(months_to_resolution) AS mean, median(months_to_resolution) AS median,
       min(months_to_resolution) AS min, max(months_to_resolution) AS max
FROM x_episodes WHERE resolved_flag GROUP BY ALL""", ints="min max", r6="mean median")
def _(t):
    return lgd.recovery_timing(t("episodes"))


@query("lg22_resolution_distribution", f"""
SELECT resolution_type, count(*) AS default_episodes, avg({Y}) AS realized_lgd FROM x_episodes GROUP BY ALL""", r6="realized_lgd")
def _(t):
    return lgd.resolution_distribution(t("episodes"))


@query("lg22_range_diagnostics", """
SELECT count(*) AS resolved_defaults, avg(realized_lgd_raw) AS raw_lgd_mean, median(realized_lgd_raw) AS raw_lgd_median,
       count(*) FILTER (realized_lgd_raw < 0) / count(*) AS raw_lgd_below_0_pct, count(*) FILTER (realized_lgd_raw > 1) / count(*) AS raw_lgd_above_1_pct,
       coalesce(sum(realized_lgd_raw) FILTER (realized_lgd_raw < 0), 0) AS raw_lgd_below_0_amount,
       coalesce(sum(realized_lgd_raw) FILTER (realized_lgd_raw > 1), 0) AS raw_lgd_above_1_amount
FROM x_episodes WHERE resolved_flag""", r6="raw_lgd_mean raw_lgd_median raw_lgd_below_0_pct raw_lgd_above_1_pct raw_lgd_below_0_amount "
       "raw_lgd_above_1_amount")
def _(t):
    return lgd.range_diagnostics(t("episodes"))


@query("lg23_actual_loss_reconciliation", """
SELECT count(*) AS rows_with_actual_loss, sum(actual_loss) AS actual_loss_sum, sum(reconstructed_actual_loss) AS reconstructed_actual_loss_sum,
       sum(reconstructed_actual_loss - actual_loss) AS reconstructed_difference_sum,
       avg(reconstructed_actual_loss - actual_loss) AS reconstructed_difference_mean, corr(reconstructed_actual_loss, actual_loss) AS reconstructed_correlation,
       sum(economic_loss) AS economic_loss_sum, sum(economic_loss - actual_loss) AS economic_difference_sum,
       avg(economic_loss - actual_loss) AS economic_difference_mean, corr(economic_loss, actual_loss) AS economic_correlation
FROM x_episodes WHERE actual_loss IS NOT NULL AND resolved_flag""", r6="reconstructed_correlation economic_correlation",
       r2="actual_loss_sum reconstructed_actual_loss_sum reconstructed_difference_sum reconstructed_difference_mean economic_loss_sum "
          "economic_difference_sum economic_difference_mean")
def _(t):
    return lgd.actual_loss_reconciliation(t("episodes"))


_used = {*lgd.RECONCILED, "bankruptcy_cramdown_costs", *lgd.MODIFICATION_COSTS}


@query("lg24_component_audit", " UNION ALL ".join(f"""
SELECT '{c}' AS component, '{k}' AS component_type, '{h}' AS treatment, count({c}) AS non_null_rows, coalesce(sum({c}), 0) AS sum,
       count(*) FILTER ({c} < 0) AS negative_rows, count(*) FILTER ({c} > 0) AS positive_rows,
       {str(c in lgd.RECONCILED).lower()} AS used_in_loss_reconciliation, {str(c in _used).lower()} AS used_in_economic_lgd FROM x_episodes"""
    for c, (k, h) in lgd.COMPONENTS.items()), r2="sum")
def _(t):
    return lgd.component_audit(t("episodes"))


@query("lg24_cashflow_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS component, count({c}) AS non_null_rows, coalesce(sum({c}), 0) AS sum, avg({c}) AS mean_non_null FROM x_episodes"
    for c in (*lgd.RECOVERIES, *lgd.COSTS, "actual_loss")), r2="sum mean_non_null")
def _(t):
    return lgd.cashflow_summary(t("episodes"))


@query("lg25_distribution", " UNION ALL ".join(f"""
SELECT '{d}' AS dimension, {c}::VARCHAR AS value, count(*) AS rows, avg(realized_lgd_raw) AS raw_lgd_mean, median(realized_lgd_raw) AS raw_lgd_median,
       avg({Y}) AS model_target_mean, count(*) FILTER (realized_lgd_raw < 0) / count(*) AS raw_lgd_below_0_pct,
       count(*) FILTER (realized_lgd_raw > 1) / count(*) AS raw_lgd_above_1_pct
FROM x_episodes WHERE resolved_flag GROUP BY ALL""" for d, c in (("resolution_type", "resolution_type"), ("default_year", "default_year"),
                                                              ("cure_non_cure", "cured_flag"))),
       r6="raw_lgd_mean raw_lgd_median model_target_mean raw_lgd_below_0_pct raw_lgd_above_1_pct")
def _(t):
    return lgd.distribution(t("episodes"))


SEGMENTS = ("rating_at_default", "current_ltv_band", "default_reason")


@query("lg26_segmentation", " UNION ALL ".join(f"""
SELECT '{v}' AS segment_variable, {v} AS segment_value, count(*) AS resolved_defaults, count(*) >= 50 AS accepted_segment, avg({Y}) AS realized_lgd,
       avg(predicted_lgd) AS predicted_lgd FROM x_pred2 WHERE resolved_flag AND {v} IS NOT NULL GROUP BY ALL""" for v in SEGMENTS),
       r6="realized_lgd predicted_lgd")
def _(t):
    return lgd.segmentation(t("lgd"), SEGMENTS)


LTV = "estimated_loan_to_value_at_default"
_audit = f"""count(*) AS rows, count(*) - count({LTV}) AS missing_ltv_rows, 1 - count({LTV}) / count(*) AS missing_ltv_rate, avg({LTV}) AS mean_ltv,
median({LTV}) AS median_ltv, avg({Y}) AS actual_cure_lgd, avg(predicted_cure_lgd) AS predicted_cure_lgd FROM x_pred2 WHERE resolved_flag AND cured_flag"""


@query("lg27_cure_ltv_audit", f"""
SELECT 'split_missingness' AS section, split, 'ALL' AS ltv_band, {_audit} GROUP BY split
UNION ALL
SELECT 'ltv_band', split, CASE WHEN {LTV} IS NULL THEN 'MISSING' WHEN {LTV} <= 60 THEN '<=60' WHEN {LTV} <= 80 THEN '60-80' WHEN {LTV} <= 100 THEN '80-100'
       WHEN {LTV} <= 120 THEN '100-120' ELSE '>120' END, {_audit} GROUP BY ALL
UNION ALL
SELECT 'relationship', 'ALL', 'correlation', count(*) FILTER ({LTV} IS NOT NULL AND {Y} IS NOT NULL), count(*) - count({LTV}), 1 - count({LTV}) / count(*),
       avg({LTV}) FILTER ({Y} IS NOT NULL), median({LTV}) FILTER ({Y} IS NOT NULL), avg({Y}) FILTER ({LTV} IS NOT NULL), corr({LTV}, {Y})
FROM x_pred2 WHERE resolved_flag AND cured_flag""", r6="missing_ltv_rate mean_ltv median_ltv actual_cure_lgd predicted_cure_lgd")
def _(t):
    return lgd.cure_ltv_audit(t("lgd"))


@query("mo03_lgd_population", """
SELECT count(*) AS episodes, count(*) FILTER (resolved_flag) AS resolved, count(*) FILTER (cured_flag) AS cured,
       count(*) FILTER (cured_flag) / nullif(count(*) FILTER (resolved_flag), 0) AS cure_rate FROM x_pred2""", r6="cure_rate")
def _(t):
    return lgd.population_summary(t("lgd"))
