"""Expected credit loss per loan and scenario.

The loss of a performing loan is EAD x LGD x a unit loss that depends only on rating, interest rate, remaining term and
horizon. With a level payment the amortised, discounted balance is a difference of two powers, so the sum over months
reduces to running sums of the PD curve per (rating, rate): loans are never multiplied by months.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.config import ECL
from lossloom.functions.exprs import clip, count_if, safe_div, tagged_rows
from lossloom.functions.joins import loan_join
from lossloom.operators.ead import maturity_months
from lossloom.sources.store import cut_lineage

LGD_COLUMNS = {"base": "lgd_base", "downturn": "lgd_downturn"}


def population(staging: DataFrame, month: DataFrame, static: DataFrame, cfg: ECL) -> DataFrame:
    """Staged loans with exposure on the reporting date; the date filter reaches both scans."""
    on = F.col("as_of_date") == F.lit(cfg.reporting_date)
    s = staging.where(on).withColumn("ead", F.col("ead_current")).withColumn("rating", F.col("rating_current"))
    m = month.where(on).select("loan_id", "as_of_date", "current_actual_upb", "current_interest_rate",
                               F.coalesce(maturity_months(), F.lit(0)).alias("remaining_months_to_maturity"))
    df = loan_join(s, m, ["loan_id", "as_of_date"], "left")
    df = loan_join(df, static.select("loan_id", "vintage_year", "property_state"), ["loan_id", "vintage_year"], "left")
    return df.where(F.coalesce("ead", "current_actual_upb", F.lit(0.0)) > 0)


def curve_date(curves: DataFrame, reporting: date) -> DataFrame:
    """First curve date on or after the reporting date, else the latest: one row."""
    d = F.col("date")
    return curves.agg(F.coalesce(F.min(F.when(d >= F.lit(reporting), d)), F.max(d)).alias("date"))


def selected_curves(curves: DataFrame, reporting: date) -> DataFrame:
    return curves.join(curve_date(curves, reporting), "date")


def scenario_weights(curves: DataFrame) -> dict[str, float]:
    """Weight per scenario, or an error when they do not sum to 1; one row per scenario."""
    rows = curves.groupBy("scenario").agg(F.first("scenario_weight").alias("w")).collect()
    weights = {r["scenario"]: float(r["w"]) for r in sorted(rows, key=lambda r: r["scenario"])}
    if abs(sum(weights.values()) - 1) > 1e-8:
        raise ValueError(f"scenario weights must sum to 1, got {sum(weights.values()):.8f}")
    return weights


def with_lgds(pop: DataFrame, episodes: DataFrame, methods: Mapping[str, str]) -> DataFrame:
    """One LGD column per name: that of the active episode, else the rating mean, else the portfolio mean, clipped to 0..1.

    All columns come from one join to the episodes and one pair of aggregates over them.
    """
    cols = {out: LGD_COLUMNS[m] for out, m in methods.items()}
    own = episodes.select("loan_id", "default_episode_id", *[F.col(c).alias(f"_own_{o}") for o, c in cols.items()])
    grade = (episodes.where("rating_at_default IS NOT NULL").groupBy(F.col("rating_at_default").alias("rating"))
             .agg(*[F.avg(c).alias(f"_grade_{o}") for o, c in cols.items()]))
    whole = episodes.agg(*[F.avg(c).alias(f"_all_{o}") for o, c in cols.items()])
    df = loan_join(pop, own, ["loan_id", "default_episode_id"], "left").join(grade, "rating", "left").crossJoin(whole)  # one-row right side
    return df.withColumns({o: clip(F.coalesce(f"_own_{o}", f"_grade_{o}", f"_all_{o}"), 0.0, 1.0) for o in cols}).drop(
        *[f"_{k}_{o}" for o in cols for k in ("own", "grade", "all")])


def loss_rate() -> Column:
    return F.greatest(F.coalesce("current_interest_rate", F.lit(0.0)), F.lit(0.0)) / 100 / 12


@dataclass(frozen=True)
class UnitLoss:
    """One set of unit-loss columns: ``prefix`` before each scenario, the rating and stage columns it reads, and the curve of each scenario."""

    prefix: str
    rating: str
    stage: str
    curves: Mapping[str, str]


def curve_arrays(curves: DataFrame, names: Sequence[str], cfg: ECL) -> DataFrame:
    """One row per rating with its curve as an array by month: marginal PD, running sum of it and of month x PD, for every curve name."""
    aggs = [F.sum(F.when(F.col("scenario") == s, F.col("marginal_pd")).otherwise(0.0)).alias(f"p_{s}") for s in names]
    wide = curves.where(F.col("month").between(1, cfg.max_months)).groupBy("rating", "month").agg(*aggs)
    w = Window.partitionBy("rating").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # one curve
    sums = {f"{k}_{s}": F.sum(F.col(f"p_{s}") * x).over(w) for s in names for k, x in (("c", F.lit(1)), ("m", F.col("month")))}
    point = F.struct("month", *[f"{k}_{s}" for s in names for k in "pcm"])
    return wide.withColumns(sums).groupBy("rating").agg(F.sort_array(F.collect_list(point)).alias("curve"))


def _unit(curve: Column, r: Column, n: Column, h: Column, name: str) -> Column:
    """Loss per unit of exposure and severity over the first ``h`` months of a level-payment balance, discounted at its own rate.

    With a rate the balance falls as (g - (1+r)^m) / (g - 1), g being (1+r)^n, so the sum needs the plain and the discounted PD only.
    """
    part = F.filter(curve, lambda x: x["month"] <= h)
    end = F.get(part, F.size(part) - 1)
    v = 1 / (1 + r)
    discounted = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x[f"p_{name}"] * F.pow(v, x["month"]))
    grown = F.pow(1 + r, n.cast("double"))
    level = (grown * discounted - end[f"c_{name}"]) / (grown - 1)
    flat = end[f"c_{name}"] - end[f"m_{name}"] / n
    return F.coalesce(F.when((n > 0) & (r > 0), level).when(n > 0, flat), F.lit(0.0))


def with_unit_loss(loans: DataFrame, curves: DataFrame, sets: Sequence[UnitLoss], cfg: ECL) -> DataFrame:
    """Add the unit-loss columns of all ``sets``: for stages 1 and 2 of rated loans, 0 for other stages or without a curve.

    A unit loss depends on rating, rate, horizon and remaining term alone. The book is reduced to its distinct contracts, each is
    evaluated once by folding its rating's curve, and the loans take all sets back in one join. Work grows with the contracts, which
    are never more than the loans, and not with curve points times rates.
    """
    names = sorted({c for u in sets for c in u.curves.values()})
    n = F.greatest(F.coalesce("remaining_months_to_maturity", F.lit(0)), F.lit(0)).cast("long")

    def horizon(stage: str) -> Column:
        return F.when(F.col(stage) == 1, F.least(n, F.lit(cfg.stage1_months))).when(F.col(stage) == 2, F.least(n, F.lit(cfg.max_months))).otherwise(0).cast("long")

    terms = [loss_rate().alias("r"), n.alias("n")]
    for i, u in enumerate(sets):
        terms += [F.coalesce(F.col(u.rating), F.lit("")).alias(f"g{i}"), horizon(u.stage).alias(f"h{i}")]
    keyed = loans.withColumn("_contract", F.struct(*terms))
    units = keyed.select("_contract").distinct().select("_contract", "_contract.*")
    arrays = curve_arrays(curves, names, cfg)
    for i in range(len(sets)):
        units = units.join(arrays.select(F.col("rating").alias(f"g{i}"), F.col("curve").alias(f"curve{i}")), f"g{i}", "left")
    values = [_unit(F.col(f"curve{i}"), F.col("r"), F.col("n"), F.col(f"h{i}"), c).alias(f"{u.prefix}{s}") for i, u in enumerate(sets) for s, c in u.curves.items()]
    units = cut_lineage(units.select("_contract", F.struct(*values).alias("_units")), "unit-losses")
    return loan_join(keyed, units, ["_contract"], "left").select(*loans.columns, "_units.*")


def loss(unit: Column, ead: Column, lgd: Column, stage: Column) -> Column:
    return F.greatest(F.when(stage == 3, ead * lgd).otherwise(ead * lgd * unit), F.lit(0.0))


def weighted(columns: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for s, w in weights.items():
        total = total + columns[s] * F.lit(w)
    return total


def finish(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted loss, coverage, exceedance flag and the stage horizon."""
    df = df.withColumn("ecl_weighted", weighted({s: F.col(f"ecl_{s.lower()}") for s in weights}, weights))
    n = F.col("remaining_months_to_maturity")
    return df.withColumns({
        "coverage_ratio": F.when(F.col("ead") > 0, F.col("ecl_weighted") / F.col("ead")).otherwise(0.0),
        "ecl_exceeds_ead": F.col("ecl_weighted") > F.col("ead"),
        "stage_horizon_months": F.when(F.col("stage") == 1, F.least(n, F.lit(12))).when(F.col("stage") == 2, n).otherwise(0).cast("long")})


def score(state: DataFrame, curves: DataFrame, cfg: ECL, lgds: Mapping[str, str] | None = None) -> DataFrame:
    """Loss per scenario and weighted; ``lgds`` adds totals under other LGD columns without another pass."""
    weights = scenario_weights(curves)
    names = list(weights)
    df = with_unit_loss(state, curves, [UnitLoss("unit_", "rating", "stage", {s: s for s in names})], cfg)
    df = df.withColumns({f"ecl_{s.lower()}": loss(F.col(f"unit_{s}"), F.col("ead"), F.col("lgd"), F.col("stage")) for s in names})
    for out, lgd in (lgds or {}).items():
        df = df.withColumn(out, weighted({s: loss(F.col(f"unit_{s}"), F.col("ead"), F.col(lgd), F.col("stage")) for s in names}, weights))
    return finish(df.drop(*[f"unit_{s}" for s in names]), weights)


def run(staging: DataFrame, month: DataFrame, static: DataFrame, episodes: DataFrame, curves: DataFrame, cfg: ECL) -> DataFrame:
    """Loan-level losses on the reporting date under the base LGD, with the downturn total alongside."""
    pop = population(staging, month, static, cfg)
    state = with_lgds(pop, episodes, {"lgd": cfg.lgd_method, "lgd_downturn": "downturn"})
    chosen = selected_curves(curves, cfg.reporting_date)
    df = score(state, chosen, cfg, {"ecl_weighted_downturn": "lgd_downturn"})
    anchor = curve_date(curves, cfg.reporting_date).withColumnRenamed("date", "pd_scenario_anchor_date")
    return df.crossJoin(anchor).withColumn("pd_horizon_start_date", F.lit(cfg.reporting_date))  # one-row right side


def calendar_month(reporting: Column, horizon: Column) -> Column:
    return F.add_months(reporting, horizon.cast("int"))


def _scenarios(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith("ecl_") and c not in ("ecl_weighted", "ecl_exceeds_ead", "ecl_weighted_downturn"))


def summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loans, exposure and losses per key; grouped through the loan for the distinct count."""
    sums = ["ead", "ecl_weighted", *_scenarios(df)]
    per_loan = df.groupBy(*keys, "loan_id").agg(*[F.sum(c).alias(c) for c in sums], count_if(F.col("ecl_exceeds_ead")).alias("ecl_exceeds_ead"))
    t = per_loan.groupBy(*keys).agg(F.count(F.lit(1)).alias("loans"), F.sum("ead").alias("total_ead"), F.sum("ecl_weighted").alias("weighted_ecl"),
                                    *[F.sum(c).alias(c) for c in _scenarios(df)], F.sum("ecl_exceeds_ead").alias("ecl_exceeds_ead"))
    return t.withColumn("coverage_ratio", safe_div("weighted_ecl", "total_ead"))


def scenario_summary(df: DataFrame) -> DataFrame:
    names = [*_scenarios(df), "ecl_weighted"]
    one = df.agg(*[F.sum(c).alias(c) for c in names])
    return tagged_rows(one, [], [[F.lit(c.removeprefix("ecl_").upper()), F.col(c)] for c in names], ["scenario", "ecl"])


def reconciliation(df: DataFrame) -> DataFrame:
    one = df.agg(F.sum("ead").alias("total_ead"), F.sum("ecl_base").alias("base_ecl"), F.sum("ecl_weighted").alias("weighted_ecl"),
                 safe_div(F.sum("ecl_weighted"), F.sum("ead")).alias("coverage_ratio"),
                 count_if(F.col("ecl_exceeds_ead")).cast("double").alias("ecl_exceeds_ead_loans"))
    return tagged_rows(one, [], [[F.lit(c), F.col(c)] for c in one.columns], ["metric", "value"])


def downturn_sensitivity(df: DataFrame) -> DataFrame:
    one = df.agg(F.sum("ecl_weighted").alias("b"), F.sum("ecl_weighted_downturn").alias("d"), F.sum("ead").alias("e"))
    rows = [("structural_base", F.col("b")), ("downturn_sensitivity", F.col("d")), ("increment", F.col("d") - F.col("b"))]
    return tagged_rows(one, [], [[F.lit(n), v, safe_div(v, F.col("e"))] for n, v in rows], ["lgd_method", "weighted_ecl", "coverage_ratio"])


def explainability(df: DataFrame) -> DataFrame:
    return df.groupBy("stage").agg(  # one row per loan on a reporting date, so the loan count is the row count
        F.count(F.lit(1)).alias("loans"), F.sum("ead").alias("stage_allocation"), F.sum("ecl_base").alias("pd_contribution"),
        F.avg("lgd").alias("lgd_contribution"), F.sum("ead").alias("ead_contribution"), F.avg("coverage_ratio").alias("discounting"),
        F.sum("ecl_weighted").alias("scenario_weighting"))


def alignment_warnings(df: DataFrame, cfg: ECL) -> DataFrame:
    one = df.agg(count_if(F.col("pd_scenario_anchor_date") != F.lit(cfg.reporting_date)).alias("a"), count_if(F.col("rating").isNull()).alias("r"),
                 count_if(F.col("ecl_exceeds_ead")).alias("x"))
    rows = [("pd_scenario_anchor_after_reporting_date", "a"), ("missing_rating", "r"), ("ecl_exceeds_ead", "x")]
    t = tagged_rows(one, [], [[F.lit(n), F.col(c)] for n, c in rows], ["warning", "rows"])
    return t.where((F.col("warning") != "pd_scenario_anchor_after_reporting_date") | (F.col("rows") > 0))


def kpis(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("ead").alias("total_ead"), F.sum("ecl_weighted").alias("weighted_ecl"),
                  F.coalesce(safe_div(F.sum("ecl_weighted"), F.sum("ead")), F.lit(0.0)).alias("coverage_ratio"))
