"""Queries over the development sample, the WOE scorecard and its performance tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lossloom.functions.exprs import clip, expit, logit
from lossloom.operators import development as dev
from lossloom.operators import metrics, scorecard
from lossloom.plans import demo
from lossloom.plans.demo import CATEGORIES, FEATURES
from lossloom.plans.registry import query
from lossloom.plans.sqlchain import cte

SPLIT = """CASE WHEN as_of_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-01' THEN 'TRAIN'
    WHEN as_of_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-01' THEN 'VALIDATION'
    WHEN as_of_date BETWEEN DATE '1999-01-01' AND DATE '2000-08-01' THEN 'OOT' ELSE 'EXCLUDED' END"""
ELIGIBLE = ("eligible_for_12m_pd AND target_12m_observable AND default_next_12m IS NOT NULL "
            "AND as_of_date <= DATE '2000-08-01'")
IN_SPAN = "as_of_date BETWEEN DATE '1995-01-01' AND DATE '2000-08-01'"

cte("x_window", f"SELECT *, {ELIGIBLE} AS ok, {SPLIT} AS split, year(as_of_date) AS observation_year FROM x_targets WHERE {IN_SPAN}")
cte("x_dev", """
SELECT loan_id, as_of_date, split, 'monthly' AS snapshot_frequency, 'behavioural' AS population,
       ok AS development_eligible_12m, default_next_12m,
       ok AND (default_next_12m = 1 OR split <> 'EXCLUDED') AS sample_selected,
       CASE WHEN ok THEN 1e0 END AS sampling_probability, CASE WHEN ok THEN 1e0 END AS sample_weight,
       target_12m_observable, event_censored, event_type, observation_year
FROM x_window""")
cte("x_frame", """
SELECT d.loan_id, d.as_of_date, d.split, d.observation_year, d.default_next_12m AS target, d.sample_weight,
       a.* EXCLUDE (loan_id, as_of_date, current_upb_to_original_upb),
       round(current_upb_to_original_upb, 9) AS current_upb_to_original_upb
FROM x_dev d JOIN x_analytical a ON a.loan_id = d.loan_id AND a.as_of_date = d.as_of_date
WHERE d.development_eligible_12m AND d.sample_selected AND d.split IN ('TRAIN', 'VALIDATION', 'OOT')""")
cte("x_scored", """
SELECT loan_id, as_of_date, split, observation_year, vintage_year, target, sample_weight, predicted_pd_raw, linear_predictor,
       round(600e0 + (50e0 / ln(2e0)) * (ln((1 - predicted_pd_raw) / predicted_pd_raw) - ln(20e0)), 6) AS score
FROM (SELECT *, round(1 / (1 + exp(-linear_predictor)), 9) AS predicted_pd_raw
      FROM (SELECT *, -1.2e0 + 0.9e0 * coalesce(delinquency_months, 0) + 0.02e0 * (original_ltv - 75)
                      + -0.004e0 * (original_credit_score - 720) + 0.01e0 * months_since_origination AS linear_predictor
            FROM x_frame))""")


@query("ds01_snapshots", """
SELECT 'monthly' AS frequency, count(*) AS rows FROM x_window
UNION ALL SELECT 'quarter_end', count(*) FROM x_window WHERE month(as_of_date) IN (3, 6, 9, 12)
UNION ALL SELECT 'year_end', count(*) FROM x_window WHERE month(as_of_date) = 12""")
def _(t):
    out = None
    for f in dev.SNAPSHOT_MONTHS:
        part = dev.snapshots(t("targets"), replace(t.cfg.development, snapshot=f)).agg(
            F.lit(f).alias("frequency"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("ds02_temporal_split", f"SELECT loan_id, as_of_date, {SPLIT} AS split FROM x_targets WHERE {IN_SPAN}")
def _(t):
    cfg = t.cfg.development
    return dev.snapshots(t("targets"), cfg).select("loan_id", "as_of_date", dev.split_of(cfg.windows).alias("split"))


@query("ds03_eligibility", "SELECT loan_id, as_of_date, ok AS development_eligible_12m FROM x_window")
def _(t):
    cfg = t.cfg.development
    return dev.eligible(dev.snapshots(t("targets"), cfg), cfg).select("loan_id", "as_of_date", "development_eligible_12m")


@query("ds04_application_population", """
SELECT loan_id, as_of_date, split FROM (
  SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY as_of_date) AS r FROM x_window WHERE month(as_of_date) IN (3, 6, 9, 12))
WHERE r = 1""")
def _(t):
    cfg = replace(t.cfg.development, population="application", snapshot="quarter_end")
    return dev.population(dev.eligible(dev.snapshots(t("targets"), cfg), cfg), cfg).select(
        "loan_id", "as_of_date", F.col("raw_split").alias("split"))


@query("ds05_loan_disjoint", """
SELECT loan_id, as_of_date, CASE WHEN k = min(k) OVER (PARTITION BY loan_id) THEN split ELSE 'EXCLUDED' END AS split
FROM (SELECT *, CASE split WHEN 'TRAIN' THEN 0 WHEN 'VALIDATION' THEN 1 WHEN 'OOT' THEN 2 END AS k
      FROM x_window WHERE month(as_of_date) IN (3, 6, 9, 12))""")
def _(t):
    return dev.sample(t("targets"), replace(t.cfg.development, loan_disjoint=True, snapshot="quarter_end")).select("loan_id", "as_of_date", "split")


@query("ds06_stratified_sampling", """
SELECT loan_id, as_of_date, split, ok AND (default_next_12m = 1 OR (split <> 'EXCLUDED' AND u <= p)) AS sample_selected,
       CASE WHEN ok THEN p END AS sampling_probability, CASE WHEN ok THEN 1 / p END AS sample_weight
FROM (SELECT *, CASE WHEN coalesce(default_next_12m = 1, false) OR split = 'EXCLUDED' OR goods <= 20 THEN 1e0 ELSE 0.25e0 END AS p
      FROM (SELECT *, count(*) FILTER (default_next_12m = 0) OVER (PARTITION BY split, observation_year) AS goods,
                   ('0x' || substr(md5(loan_id || '|' || as_of_date || '|20260927'), 1, 8))::BIGINT / 4294967296e0 AS u
            FROM x_window WHERE month(as_of_date) IN (3, 6, 9, 12)))""", r6="sampling_probability sample_weight")
def _(t):
    cfg = replace(t.cfg.development, snapshot="quarter_end", sampling="stratified_nondefault", nondefault_fraction=0.25,
                  min_nondefaults_per_stratum=20)
    return dev.sample(t("targets"), cfg).select("loan_id", "as_of_date", "split", "sample_selected", "sampling_probability",
                                                "sample_weight")


@query("ds07_split_profile", """
SELECT split, observation_year, count(*) AS rows, count(DISTINCT loan_id) AS loans,
       count(*) FILTER (development_eligible_12m) AS eligible_rows,
       count(*) FILTER (development_eligible_12m AND default_next_12m = 1) AS defaults,
       count(*) FILTER (development_eligible_12m AND default_next_12m = 0) AS nondefaults,
       count(*) FILTER (development_eligible_12m AND default_next_12m = 1)
         / nullif(count(*) FILTER (development_eligible_12m), 0) AS bad_rate,
       count(*) FILTER (NOT target_12m_observable) AS censored_rows,
       count(*) FILTER (NOT development_eligible_12m) AS excluded_rows,
       count(*) FILTER (development_eligible_12m AND default_next_12m = 0)
         / nullif(count(*) FILTER (development_eligible_12m AND default_next_12m = 1), 0) AS nondefault_to_default_ratio
FROM x_dev GROUP BY ALL""", ints="observation_year rows eligible_rows defaults nondefaults censored_rows excluded_rows",
       r6="bad_rate nondefault_to_default_ratio")
def _(t):
    return dev.split_profile(t("dev"))


DEV_SETS = """sets AS (SELECT loan_id, bool_or(split = 'TRAIN') AS a, bool_or(split = 'VALIDATION') AS b, bool_or(split = 'OOT') AS c
FROM x_dev WHERE development_eligible_12m GROUP BY loan_id)"""


@query("ds08_sample_profile", f"""
WITH {DEV_SETS}
SELECT 'rows' AS metric, split, count(*)::DOUBLE AS value FROM x_dev GROUP BY ALL
UNION ALL SELECT 'loans', split, count(DISTINCT loan_id) FROM x_dev GROUP BY ALL
UNION ALL SELECT 'selected_rows', split, count(*) FILTER (sample_selected) FROM x_dev GROUP BY ALL
UNION ALL SELECT 'defaults', split, count(*) FILTER (development_eligible_12m AND default_next_12m = 1) FROM x_dev GROUP BY ALL
UNION ALL SELECT 'nondefaults', split, count(*) FILTER (development_eligible_12m AND default_next_12m = 0) FROM x_dev GROUP BY ALL
UNION ALL SELECT 'loans_in_multiple_splits', 'ALL', count(*) FILTER (a::INT + b::INT + c::INT > 1) FROM sets
UNION ALL SELECT 'train_validation_overlap', 'ALL', count(*) FILTER (a AND b) FROM sets
UNION ALL SELECT 'train_oot_overlap', 'ALL', count(*) FILTER (a AND c) FROM sets
UNION ALL SELECT 'validation_oot_overlap', 'ALL', count(*) FILTER (b AND c) FROM sets""")
def _(t):
    return dev.sample_profile(t("dev"))


@query("ds09_sample_validation", """
SELECT split, count(*) AS rows, count(DISTINCT loan_id) AS loans, count(*) FILTER (default_next_12m = 1) AS defaults,
       avg(default_next_12m) AS bad_rate
FROM x_dev WHERE development_eligible_12m GROUP BY split""", ints="rows defaults", r6="bad_rate")
def _(t):
    return dev.validation(t("dev"))


@query("sc01_model_frame", "SELECT loan_id, as_of_date, split, observation_year, target, vintage_year, "
       + ", ".join(FEATURES) + " FROM x_frame", ints="observation_year target",
       r6="current_actual_upb current_upb_to_original_upb")
def _(t):
    return t("frame").select("loan_id", "as_of_date", "split", "observation_year", "target", "vintage_year", *FEATURES)


cte("x_train_long", " UNION ALL ".join(
    f"SELECT loan_id, as_of_date, '{f}' AS feature, {f}::DOUBLE AS value, target, sample_weight FROM x_frame WHERE split = 'TRAIN'"
    for f in FEATURES))
cte("x_edges", """
SELECT feature, e AS lower, lead(e) OVER (PARTITION BY feature ORDER BY e) AS upper FROM (
  SELECT DISTINCT feature, unnest(q) AS e FROM (
    SELECT feature, quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q
    FROM x_train_long WHERE value IS NOT NULL GROUP BY feature))""")
cte("x_bins", """
SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY lower) - 1 AS bin,
       CASE WHEN lower > min(lower) OVER (PARTITION BY feature) THEN lower END AS lower,
       CASE WHEN upper < max(upper) OVER (PARTITION BY feature) THEN upper END AS upper
FROM (SELECT feature, lower, upper FROM x_edges WHERE upper IS NOT NULL
      UNION ALL SELECT feature, min(lower), max(lower) FROM x_edges GROUP BY feature HAVING count(*) = 1)""")
cte("x_binned", """
SELECT l.*, coalesce(b.bin, -1) AS bin, b.lower, b.upper
FROM x_train_long l LEFT JOIN x_bins b ON b.feature = l.feature AND l.value IS NOT NULL
     AND (b.lower IS NULL OR l.value > b.lower) AND (b.upper IS NULL OR l.value <= b.upper)""")
cte("x_bin_counts", """
SELECT feature, bin, any_value(lower) AS lower, any_value(upper) AS upper, count(*) AS rows,
       sum(CASE WHEN target = 1 THEN sample_weight ELSE 0 END) AS events,
       sum(CASE WHEN target = 0 THEN sample_weight ELSE 0 END) AS non_events
FROM x_binned GROUP BY feature, bin""")
cte("x_train_totals", """
SELECT sum(CASE WHEN target = 1 THEN sample_weight ELSE 0 END) AS e, sum(CASE WHEN target = 0 THEN sample_weight ELSE 0 END) AS n
FROM x_frame WHERE split = 'TRAIN'""")
WOE_SQL = """ln(((non_events + 0.5e0) / (n + 1)) / ((events + 0.5e0) / (e + 1)))"""
IV_SQL = f"""((non_events + 0.5e0) / (n + 1) - (events + 0.5e0) / (e + 1)) * {WOE_SQL}"""
cte("x_woe", f"SELECT b.*, {WOE_SQL} AS woe, {IV_SQL} AS iv FROM x_bin_counts b, x_train_totals")


def train(t):
    return t("frame").where("split = 'TRAIN'")


def finite(x: float):
    return F.lit(None).cast("double") if x in (scorecard.INF, -scorecard.INF) else F.lit(x)


def raw_bins(t):
    """Unmerged numeric bins with their ends; the ends come from the fitted edges."""
    edges = scorecard.numeric_edges(train(t), FEATURES, t.cfg.scorecard.max_bins)
    counts = scorecard.numeric_counts(train(t), edges)
    lower, upper = F.lit(None).cast("double"), F.lit(None).cast("double")
    for f, e in edges.items():
        for i in range(len(e) - 1):
            here = (F.col("feature") == f) & (F.col("bin") == i)
            lower, upper = F.when(here, finite(e[i])).otherwise(lower), F.when(here, finite(e[i + 1])).otherwise(upper)
    return counts.select("feature", "bin", lower.alias("lower"), upper.alias("upper"), "rows", "events", "non_events")


def train_totals(t):
    return train(t).agg(*scorecard.event_sums(train(t)))


@query("sc02_quantile_bins", "SELECT * FROM x_bin_counts", ints="bin", r6="lower upper events non_events")
def _(t):
    return raw_bins(t)


def fitted(t, **change):
    return scorecard.fit_bins(train(t), FEATURES, CATEGORIES, replace(t.cfg.scorecard, **change))


@query("sc03_merged_small_bins")
def _(t):
    return scorecard.bin_table(t.spark, fitted(t, min_bin_pct=0.08, monotonic=False), t.cfg.scorecard.suspicious_iv)


@query("sc04_monotone_bins")
def _(t):
    return scorecard.bin_table(t.spark, fitted(t), t.cfg.scorecard.suspicious_iv)


def recount_sql(flags: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS rows, sum(CASE WHEN target = 1 THEN sample_weight ELSE 0 END) AS events, {flags} "
                              "FROM x_frame WHERE split = 'TRAIN'" for f in FEATURES)


def recounted(t, bins, **checks):
    """What merging must keep and reach: every TRAIN row in one bin, and the stated property of the numeric bins."""
    rows = [(f, sum(b.rows for b in bins[f]), float(sum(b.events for b in bins[f])), *[bool(c([b for b in bins[f] if b.label != scorecard.MISSING])) for c in checks.values()])
            for f in FEATURES]
    return t.spark.createDataFrame(rows, "feature string, rows long, events double, " + ", ".join(f"{n} boolean" for n in checks))


@query("sc03_bins_recount", recount_sql("true AS large_enough"), r6="events")
def _(t):
    floor = max(1, int(train(t).count() * 0.08))
    return recounted(t, fitted(t, min_bin_pct=0.08, monotonic=False), large_enough=lambda bs: len(bs) == 1 or all(b.rows >= floor for b in bs))


@query("sc04_bins_recount", recount_sql("true AS monotone"), r6="events")
def _(t):
    def monotone(bs):
        rates = [b.bad_rate for b in bs]
        return len(bs) <= 2 or rates in (sorted(rates), sorted(rates, reverse=True))

    return recounted(t, fitted(t), monotone=monotone)


CAT_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, coalesce({f}, '__MISSING__') AS category, count(*) AS rows, "
    f"sum(CASE WHEN target = 1 THEN sample_weight ELSE 0 END) AS events, "
    f"sum(CASE WHEN target = 0 THEN sample_weight ELSE 0 END) AS non_events FROM x_frame WHERE split = 'TRAIN' GROUP BY ALL"
    for f in CATEGORIES)


@query("sc05_category_bins", f"""
SELECT feature, CASE WHEN rows < least THEN 'RARE' WHEN category = '__MISSING__' THEN 'MISSING' ELSE category END AS bin_label,
       sum(rows) AS rows, sum(events) AS events, sum(non_events) AS non_events
FROM ({CAT_SQL}), (SELECT greatest(1, floor(count(*) * 0.04e0)) AS least FROM x_frame WHERE split = 'TRAIN') GROUP BY ALL""",
       ints="rows", r6="events non_events")
def _(t):
    counts = scorecard.category_counts(train(t), CATEGORIES)
    return scorecard.category_bins(counts, train(t).count(), replace(t.cfg.scorecard, rare_category_pct=0.04))


@query("sc06_woe_iv", "SELECT feature, bin, events, non_events, woe, iv FROM x_woe", ints="bin", r6="events non_events woe iv")
def _(t):
    return scorecard.woe_table(raw_bins(t), train_totals(t), t.cfg.scorecard).select(
        "feature", "bin", "events", "non_events", "woe", "iv")


_woe_joins = "\n".join(
    f"LEFT JOIN x_woe w{i} ON w{i}.feature = '{f}' AND (({f} IS NULL AND w{i}.bin = -1) OR ({f} IS NOT NULL AND w{i}.bin >= 0 "
    f"AND (w{i}.lower IS NULL OR {f} > w{i}.lower) AND (w{i}.upper IS NULL OR {f} <= w{i}.upper)))"
    for i, f in enumerate(FEATURES))
_woe_cols = ", ".join(f"coalesce(w{i}.woe, (SELECT woe FROM x_woe WHERE feature = '{f}' AND bin = 0)) AS {f}_woe"
                      for i, f in enumerate(FEATURES))


@query("sc07_woe_transform", f"SELECT loan_id, as_of_date, {_woe_cols} FROM x_frame {_woe_joins}",
       r6=" ".join(f"{f}_woe" for f in FEATURES))
def _(t):
    cfg = replace(t.cfg.scorecard, min_bin_pct=0.0, monotonic=False)
    bins = scorecard.fit_bins(train(t), FEATURES, (), cfg)
    return scorecard.transform(t("frame"), bins).select("loan_id", "as_of_date", *[f"{f}_woe" for f in FEATURES])


def fitted_model(t):
    bins = fitted(t)
    names = [f"{f}_woe" for f in bins]
    woe = scorecard.transform(t("frame"), bins)
    intercept, coefs = scorecard.fit_logistic(woe.where("split = 'TRAIN'"), names, "target", "sample_weight")
    return bins, woe, intercept, dict(zip(names, coefs))


@query("sc08_logistic_fit")
def _(t):
    _, _, a, b = fitted_model(t)
    return scorecard.coefficient_table(t.spark, a, b)


def balance_table(df, groups, pd, features=None, penalty=None):
    """First-order conditions of a weighted logistic fit: the weighted residuals times each regressor, less the penalty, must vanish."""
    terms = {"INTERCEPT": F.lit(1.0), **{f: F.col(f) for f in features or ()}}
    r = F.col("sample_weight") * (F.col("target") - pd)
    sums = df.groupBy(*groups).agg(F.sum("sample_weight").alias("weight"), *[F.sum(r * x).alias(f"_{n}") for n, x in terms.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), (F.abs(F.col(f"_{n}") - F.lit(float((penalty or {}).get(n, 0.0)))) < 1e-4 * F.col("weight")).alias("balanced"))
                               for n in terms]))
    return sums.select(*groups, "weight", rows.alias("p")).select(*groups, "weight", "p.*")


@query("sc08_score_equations", " UNION ALL ".join(
    f"SELECT '{p}' AS parameter, sum(sample_weight) AS weight, true AS balanced FROM x_frame WHERE split = 'TRAIN'"
    for p in ("INTERCEPT", *[f"{f}_woe" for f in (*FEATURES, *CATEGORIES)])), r6="weight")
def _(t):
    _, woe, a, b = fitted_model(t)
    pd = 1 / (1 + F.exp(-scorecard.linear_predictor(a, b)))
    return balance_table(woe.where("split = 'TRAIN'"), [], pd, list(b), b)


@query("sc13_score_equations", """
SELECT split, 'INTERCEPT' AS parameter, sum(sample_weight) AS weight, true AS balanced FROM x_scored GROUP BY ALL""", r6="weight")
def _(t):
    """The calibration line of each split reproduces its weighted number of bads."""
    a, b = F.lit(None).cast("double"), F.lit(None).cast("double")
    for s in dev.SPLITS:
        i, k = scorecard.calibration_line(t("scored").where(F.col("split") == s), "predicted_pd_raw", "target", "sample_weight")
        a, b = F.when(F.col("split") == s, F.lit(i)).otherwise(a), F.when(F.col("split") == s, F.lit(k)).otherwise(b)
    x = clip("predicted_pd_raw", 1e-6, 1 - 1e-6)
    return balance_table(t("scored"), ["split"], expit(a + b * logit(x)))


@query("sc09_scores", "SELECT loan_id, as_of_date, linear_predictor, predicted_pd_raw, score FROM x_scored",
       r6="linear_predictor predicted_pd_raw score")
def _(t):
    return demo.scored(t).select("loan_id", "as_of_date", "linear_predictor", "predicted_pd_raw", "score")


cte("x_band_edges", """
SELECT row_number() OVER (ORDER BY e) AS k, e AS lower, lead(e) OVER (ORDER BY e) AS upper, count(*) OVER () AS n FROM (
  SELECT DISTINCT unnest(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e
  FROM x_scored WHERE split = 'TRAIN')""")
cte("x_banded", """
SELECT s.*, 'B' || lpad(b.k::VARCHAR, 2, '0') AS score_band
FROM x_scored s LEFT JOIN x_band_edges b ON b.upper IS NOT NULL AND (b.k = 1 OR s.score > b.lower) AND (b.k = b.n - 1 OR s.score <= b.upper)""")


@query("sc10_score_bands", "SELECT loan_id, as_of_date, score_band FROM x_banded")
def _(t):
    return scorecard.with_bands(t("scored"), t.cfg.scorecard).select("loan_id", "as_of_date", "score_band")


def ranked_sql(group: str, pd: str, table: str, target: str = "target", weight: str = "sample_weight") -> str:
    return f"""
SELECT {group}, {pd}, bad, good, sum(bad) OVER g AS bad_all, sum(good) OVER g AS good_all,
       sum(bad) OVER up AS bad_cum, sum(good) OVER up AS good_cum, sum(bad) OVER down AS bad_above, sum(good) OVER down AS good_above
FROM (SELECT {group}, {pd}, sum(CASE WHEN {target} = 1 THEN {weight} ELSE 0 END) AS bad,
             sum(CASE WHEN {target} = 0 THEN {weight} ELSE 0 END) AS good FROM {table} GROUP BY ALL)
WINDOW g AS (PARTITION BY {group}), up AS (PARTITION BY {group} ORDER BY {pd} ROWS UNBOUNDED PRECEDING),
       down AS (PARTITION BY {group} ORDER BY {pd} DESC ROWS UNBOUNDED PRECEDING)"""


def ranking_sql(group: str, pd: str, table: str, target: str = "target", weight: str = "sample_weight") -> str:
    return f"""
SELECT {group}, CASE WHEN max(bad_all) > 0 AND max(good_all) > 0
                     THEN sum(bad * (good_cum - good / 2)) / (max(bad_all) * max(good_all)) ELSE 0.5e0 END AS roc_auc,
       CASE WHEN max(bad_all) > 0 AND max(good_all) > 0
            THEN max(abs(bad_cum / bad_all - good_cum / good_all)) ELSE 0 END AS ks,
       coalesce(sum(bad * bad_above / (bad_above + good_above)) / nullif(max(bad_all), 0), 0) AS pr_auc
FROM ({ranked_sql(group, pd, table, target, weight)}) GROUP BY {group}"""


def accuracy_sql(group: str, pd: str, table: str, target: str = "target", weight: str = "sample_weight") -> str:
    q = f"least(greatest({pd}, 1e-8), 1 - 1e-8)"
    return f"""
SELECT {group}, sum(({target} - {pd}) ** 2 * {weight}) / sum({weight}) AS brier,
       sum(CASE WHEN {target} = 1 THEN -ln({q}) ELSE -ln(1 - {q}) END * {weight}) / sum({weight}) AS log_loss,
       sum({target} * {weight}) / sum({weight}) AS observed_bad_rate, sum({pd} * {weight}) / sum({weight}) AS predicted_bad_rate
FROM {table} GROUP BY {group}"""


METRIC_R6 = "roc_auc gini pr_auc brier log_loss observed_bad_rate predicted_bad_rate"


@query("sc11_binary_metrics", f"""
SELECT r.split, roc_auc, 2 * roc_auc - 1 AS gini, pr_auc, brier, log_loss, observed_bad_rate, predicted_bad_rate
FROM ({ranking_sql('split', 'predicted_pd_raw', 'x_scored')}) r JOIN ({accuracy_sql('split', 'predicted_pd_raw', 'x_scored')}) a
  ON a.split = r.split""", r6=METRIC_R6)
def _(t):
    return metrics.binary_metrics(t("scored"), ["split"], "predicted_pd_raw").drop("ks")


@query("sc12_weighted_ks", f"SELECT split, ks FROM ({ranking_sql('split', 'predicted_pd_raw', 'x_scored')})", r6="ks")
def _(t):
    return metrics.ranking_metrics(t("scored"), ["split"], "predicted_pd_raw", "target", "sample_weight").select("split", "ks")


@query("sc13_calibration_line")
def _(t):
    rows = []
    for s in dev.SPLITS:
        rows.append((s, *scorecard.calibration_line(t("scored").where(F.col("split") == s), "predicted_pd_raw", "target", "sample_weight")))
    return t.spark.createDataFrame(rows, "split string, calibration_intercept double, calibration_slope double")


@query("sc14_confusion", """
SELECT split, sum(CASE WHEN predicted_pd_raw >= 0.3e0 AND target = 1 THEN sample_weight ELSE 0 END) AS true_positive,
       sum(CASE WHEN predicted_pd_raw >= 0.3e0 AND target = 0 THEN sample_weight ELSE 0 END) AS false_positive,
       sum(CASE WHEN predicted_pd_raw < 0.3e0 AND target = 0 THEN sample_weight ELSE 0 END) AS true_negative,
       sum(CASE WHEN predicted_pd_raw < 0.3e0 AND target = 1 THEN sample_weight ELSE 0 END) AS false_negative
FROM x_scored GROUP BY split""", r6="true_positive false_positive true_negative false_negative")
def _(t):
    return metrics.confusion(t("scored"), ["split"], 0.3)


def decile_sql(table: str, pd: str, group: str = "split") -> str:
    h = "('0x' || substr(md5(loan_id || '|' || as_of_date), 1, 8))::BIGINT"
    return f"""
SELECT *, greatest(1, ceil((rn - 1) * 10 / greatest(n - 1, 1)))::BIGINT AS decile
FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {pd}, {h}, loan_id, as_of_date) AS rn,
             count(*) OVER (PARTITION BY {group}) AS n FROM {table})"""


cte("x_deciled", decile_sql("x_scored", "predicted_pd_raw"))


@query("sc15_decile_table", """
SELECT split, decile, count(*) AS rows, sum(target * sample_weight) / sum(sample_weight) AS weighted_bad_rate,
       sum(predicted_pd_raw * sample_weight) / sum(sample_weight) AS weighted_predicted_pd,
       min(score) AS min_score, max(score) AS max_score FROM x_deciled GROUP BY ALL""",
       r6="weighted_bad_rate weighted_predicted_pd min_score max_score")
def _(t):
    return metrics.decile_table(t("scored"))


@query("sc16_roc_curve", f"""
SELECT split, good_above / good_all AS fpr, bad_above / bad_all AS tpr, predicted_pd_raw AS threshold
FROM ({ranked_sql('split', 'predicted_pd_raw', 'x_scored')}) WHERE bad_all > 0 AND good_all > 0""", r6="fpr tpr threshold")
def _(t):
    return metrics.roc_curve(t("scored"), ["split"])


@query("sc16_calibration_curve", """
SELECT split, decile AS bin, count(*) AS rows, sum(target * sample_weight) / sum(sample_weight) AS observed_bad_rate,
       sum(predicted_pd_raw * sample_weight) / sum(sample_weight) AS predicted_bad_rate FROM x_deciled GROUP BY ALL""",
       r6="observed_bad_rate predicted_bad_rate")
def _(t):
    return metrics.calibration_curve(t("scored"))


@query("sc16_lift", """
SELECT split, bin, sum(bad) OVER c / sum(bad) OVER g AS cumulative_capture_rate,
       (sum(bad) OVER c / sum(w) OVER c) / (sum(bad) OVER g / sum(w) OVER g) AS lift
FROM (SELECT split, decile AS bin, sum(target * sample_weight) AS bad, sum(sample_weight) AS w FROM x_deciled GROUP BY ALL)
WINDOW g AS (PARTITION BY split), c AS (PARTITION BY split ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)""",
       r6="cumulative_capture_rate lift")
def _(t):
    return metrics.lift_table(t("scored"))


def psi_sql(table: str, columns) -> str:
    long = " UNION ALL ".join(f"SELECT split, '{c}' AS feature, {c}::DOUBLE AS value FROM {table} WHERE {c} IS NOT NULL" for c in columns)
    return f"""
WITH long AS ({long}),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q
          FROM long WHERE split = 'TRAIN' GROUP BY feature),
placed AS (SELECT l.feature, l.split, len(list_filter(e.q[2:len(e.q) - 1], lambda x: x <= l.value)) AS bucket
           FROM long l JOIN edges e ON e.feature = l.feature),
cells AS (SELECT feature, bucket, count(*) FILTER (split = 'TRAIN') AS b, count(*) FILTER (split = 'VALIDATION') AS v,
                 count(*) FILTER (split = 'OOT') AS o FROM placed GROUP BY ALL),
shares AS (SELECT feature, greatest(b / sum(b) OVER w, 1e-6) AS b, greatest(v / sum(v) OVER w, 1e-6) AS v,
                  greatest(o / sum(o) OVER w, 1e-6) AS o FROM cells WINDOW w AS (PARTITION BY feature))
SELECT feature, 'TRAIN_TO_VALIDATION' AS comparison, sum((v - b) * ln(v / b)) AS psi FROM shares GROUP BY feature
UNION ALL SELECT feature, 'TRAIN_TO_OOT', sum((o - b) * ln(o / b)) FROM shares GROUP BY feature"""


@query("sc17_score_psi", psi_sql("x_scored", ["score", "predicted_pd_raw"]), r6="psi")
def _(t):
    return metrics.psi_table(t("scored"), ["score", "predicted_pd_raw"])


@query("sc17_feature_psi", psi_sql("x_frame", FEATURES), r6="psi")
def _(t):
    return metrics.psi_table(t("frame"), FEATURES)


@query("sc18_yearly_performance", f"""
SELECT r.observation_year, c.rows, observed_bad_rate AS bad_rate, predicted_bad_rate, 2 * roc_auc - 1 AS gini, ks
FROM ({ranking_sql('observation_year', 'predicted_pd_raw', 'x_scored')}) r
JOIN ({accuracy_sql('observation_year', 'predicted_pd_raw', 'x_scored')}) a ON a.observation_year = r.observation_year
JOIN (SELECT observation_year, count(*) AS rows FROM x_scored GROUP BY ALL) c ON c.observation_year = r.observation_year""",
       ints="observation_year", r6="bad_rate predicted_bad_rate gini ks")
def _(t):
    return metrics.yearly(t("scored"))


@query("sc19_iv_ranking", "SELECT feature, sum(iv) AS iv, sum(iv) > 0.5 AS suspicious_high_iv FROM x_woe GROUP BY feature", r6="iv")
def _(t):
    table = scorecard.woe_table(raw_bins(t), train_totals(t), t.cfg.scorecard)
    return (table.groupBy("feature").agg(F.sum("iv").alias("iv"))
            .withColumn("suspicious_high_iv", F.col("iv") > t.cfg.scorecard.suspicious_iv).orderBy(F.desc("iv")))


@query("sc20_band_summary", """
SELECT split, score_band, count(*) AS rows, sum(target * sample_weight) / sum(sample_weight) AS bad_rate,
       sum(predicted_pd_raw * sample_weight) / sum(sample_weight) AS predicted_bad_rate,
       min(score) AS min_score, max(score) AS max_score FROM x_banded GROUP BY ALL""",
       r6="bad_rate predicted_bad_rate min_score max_score")
def _(t):
    return metrics.band_summary(scorecard.with_bands(t("scored"), t.cfg.scorecard))


@query("sc21_compare_runs", f"""
SELECT 'behavioural' AS run_id, split, roc_auc, ks FROM ({ranking_sql('split', 'predicted_pd_raw', 'x_scored')})
UNION ALL
SELECT 'balance_only', split, roc_auc, ks FROM ({ranking_sql('split', 'current_upb_to_original_upb', 'x_frame')})""", r6="roc_auc ks")
def _(t):
    runs = {"behavioural": (t("scored"), "predicted_pd_raw"), "balance_only": (t("frame"), "current_upb_to_original_upb")}
    return metrics.compare_runs({
        k: metrics.ranking_metrics(df, ["split"], col, "target", "sample_weight").select("split", "roc_auc", "ks")
        for k, (df, col) in runs.items()})
