"""What-if scenarios on a reporting-date book: shocks to the portfolio, staging, curves, LGD and EAD."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.config import ECL
from lossloom.functions.exprs import clip, flag, tagged_rows, uniform_hash
from lossloom.functions.joins import loan_join
from lossloom.operators import ecl
from lossloom.operators.pd_framework import grade_number
from lossloom.operators.staging import TRIGGERS

SLOTS = 65536


@dataclass(frozen=True)
class Scenario:
    name: str = "what_if"
    unemployment: float = 0.0
    hpi: float = 0.0
    gdp: float = 0.0
    mortgage_rate: float = 0.0
    rho_override: float | None = None
    weights: Mapping[str, float] | None = None
    relative_pd: float | None = None
    absolute_pd: float | None = None
    notches: int | None = None
    dpd: int | None = None
    hold_stage2: int | None = None
    downgrade_share: float = 0.0
    late_1m_share: float = 0.0
    late_2m_share: float = 0.0
    default_share: float = 0.0
    seed: int = 1729
    lgd_method: str = "base"
    overlay_points: float = 0.0
    ead_multiplier: float = 1.0
    worst_grade: int = 5

    def __post_init__(self) -> None:
        if self.weights is not None and abs(sum(self.weights.values()) - 1) > 1e-8:
            raise ValueError("scenario weights must sum to 1")


def state(staging: DataFrame, month: DataFrame, static: DataFrame, episodes: DataFrame, cfg: ECL) -> DataFrame:
    """Reporting-date book with both LGDs and the starting values kept beside the working ones."""
    pop = ecl.population(staging, month, static, cfg)
    df = ecl.with_lgds(pop, episodes, {"lgd": cfg.lgd_method, "lgd_downturn": "downturn"})
    return df.withColumns({"base_stage": F.col("stage"), "base_rating": F.col("rating"), "base_ead": F.col("ead"), "base_lgd": F.col("lgd"),
                           "lgd_base": F.col("lgd")})


def pick_shares(df: DataFrame, eligible: Column, shares: Mapping[str, float], seed: int, key: str = "loan_id") -> DataFrame:
    """Flag exactly round(n x share) eligible rows per name, lowest salted hash first.

    A histogram of hash slots gives the slot where the quota runs out; only the rows of that one slot are ranked.
    """
    names = list(shares)
    cols = {f"_u_{n}": uniform_hash(F.lit(seed), F.lit(n), key) for n in names}
    base = df.withColumn("_ok", eligible).withColumns(cols)
    long = base.where("_ok").unpivot([key], [F.col(f"_u_{n}").alias(n) for n in names], "name", "u").withColumn(
        "slot", F.floor(F.col("u") * SLOTS))
    hist = long.groupBy("name", "slot").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("name")  # at most SLOTS rows per name
    share = F.lit(None).cast("double")
    for n in names:
        share = F.when(F.col("name") == n, F.lit(float(shares[n]))).otherwise(share)
    quota = F.bround(F.sum("n").over(w) * share).cast("long")
    cum = F.sum("n").over(w.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    cells = hist.select("name", "slot", "n", cum.alias("cum"), quota.alias("quota"))
    full = cells.where("cum <= quota").select("name", "slot")
    partly = cells.where("cum > quota AND cum - n < quota").select("name", "slot", (F.col("quota") - F.col("cum") + F.col("n")).alias("rest"))
    edge = long.join(partly, ["name", "slot"])
    edge = edge.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("u", key))).where("rn <= rest")
    chosen = long.join(full, ["name", "slot"], "left_semi").select(key, "name").unionByName(edge.select(key, "name"))
    flags = chosen.groupBy(key).agg(*[F.max(F.col("name") == n).alias(n) for n in names])
    out = loan_join(df, flags, [key], "left")
    return out.withColumns({n: flag(F.col(n)) for n in names})


def portfolio_shock(df: DataFrame, s: Scenario) -> DataFrame:
    """Downgrade, delay or default a fixed share of the loans outside stage 3."""
    shares = {"_down": s.downgrade_share, "_late1": s.late_1m_share, "_late2": s.late_2m_share, "_dflt": s.default_share}
    out = pick_shares(df, F.col("stage") != 3, shares, s.seed) if any(shares.values()) else df.withColumns({k: F.lit(False) for k in shares})
    g = grade_number("rating")
    worse = F.when(g.isNotNull(), F.concat(F.lit("R"), F.least(g + 1, F.lit(s.worst_grade)).cast("string"))).otherwise(F.col("rating"))
    late = F.col("delinquency_months")
    for k, m in (("_late1", 1), ("_late2", 2), ("_dflt", 3)):
        late = F.when(F.col(k), F.greatest(F.coalesce(late, F.lit(0)), F.lit(m))).otherwise(late)
    out = out.withColumns({"rating": F.when(F.col("_down"), worse).otherwise(F.col("rating")), "delinquency_months": late,
                           "active_default_state": F.col("active_default_state") | F.col("_dflt")})
    return out.withColumns({
        "rating_current": F.when(F.col("_down"), F.col("rating")).otherwise(F.col("rating_current")),
        "rating_notch_change": grade_number("rating") - grade_number("rating_origination"),
        "portfolio_rating_downgrade_shock": F.col("_down"),
        "portfolio_delinquency_shock": F.col("_late1") | F.col("_late2") | F.col("_dflt")}).drop(*shares)


def staging_controls(df: DataFrame, s: Scenario) -> DataFrame:
    """Re-stage with overridden thresholds; unset ones keep the stored flags. Without any setting the stages stay."""
    if all(x is None for x in (s.relative_pd, s.absolute_pd, s.notches, s.dpd, s.hold_stage2)):
        return df.withColumn("stage3_flag", F.col("stage") == 3)
    base = F.col("origination_baseline_available")
    new = {
        "sicr_relative_pd": F.col("sicr_relative_pd") if s.relative_pd is None else base & (F.col("pd_relative_change") >= s.relative_pd),
        "sicr_absolute_pd": F.col("sicr_absolute_pd") if s.absolute_pd is None else base & (F.col("pd_absolute_change") >= s.absolute_pd),
        "sicr_rating_downgrade": F.col("sicr_rating_downgrade") if s.notches is None else F.col("rating_notch_change") >= s.notches,
        "sicr_dpd_backstop": F.col("sicr_dpd_backstop") if s.dpd is None else F.coalesce("delinquency_months", F.lit(0)) >= s.dpd}
    df = df.withColumns({k: flag(v) for k, v in new.items()} | {"stage3_flag": flag(F.col("active_default_state"))})
    hit = F.lit(False)
    for c in TRIGGERS:
        hit = hit | flag(F.col(c))
    if s.hold_stage2:
        hit = hit | (F.col("base_stage") == 2)
    df = df.withColumn("sicr_flag", hit & ~F.col("stage3_flag"))
    return df.withColumns({
        "stage": F.when(F.col("stage3_flag"), 3).when(F.col("sicr_flag"), 2).otherwise(1),
        "stage_reason": F.when(F.col("stage3_flag"), "DEFAULT").when(F.col("sicr_flag"), "SCENARIO_SICR").otherwise("NO_SICR")})


def pd_scale(s: Scenario, base_rho: float | None) -> float:
    rho = 0.5 * (s.rho_override - base_rho) / base_rho if s.rho_override is not None and base_rho else 0.0
    return max(1 + 0.08 * s.unemployment - 0.01 * s.hpi - 0.04 * s.gdp + 0.03 * s.mortgage_rate + rho, 0.01)


def macro_controls(curves: DataFrame, s: Scenario, base_rho: float | None) -> DataFrame:
    w = F.col("scenario_weight")
    for name, value in (s.weights or {}).items():
        w = F.when(F.col("scenario") == name, F.lit(float(value))).otherwise(w)
    return curves.withColumns({"marginal_pd": clip(F.col("marginal_pd") * F.lit(pd_scale(s, base_rho)), 0.0, 1.0), "scenario_weight": w})


def lgd_control(s: Scenario) -> Column:
    return clip(F.col("lgd_downturn" if s.lgd_method == "downturn" else "lgd_base") + s.overlay_points / 100, 0.0, 1.0)


def ead_control(s: Scenario) -> Column:
    return clip(F.col("base_ead") * s.ead_multiplier, 0.0)


def stressed(st: DataFrame, curves: DataFrame, s: Scenario, cfg: ECL, base_rho: float | None) -> DataFrame:
    """All controls applied and the book scored again."""
    df = staging_controls(portfolio_shock(st, s), s)
    return ecl.score(df.withColumns({"lgd": lgd_control(s), "ead": ead_control(s)}), macro_controls(curves, s, base_rho), cfg)


def comparison(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    def named(df: DataFrame, p: str) -> DataFrame:
        t = ecl.summary(df, keys)
        new = {"total_ead": "ead", "weighted_ecl": "ecl"}
        return t.select(*keys, *[F.col(c).alias(f"{p}_{new.get(c, c)}") for c in t.columns if c not in keys])

    j = named(before, "baseline").join(named(after, "stressed"), list(keys), "full_outer")
    j = j.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in j.columns if c not in keys])
    d = F.col("stressed_ecl") - F.col("baseline_ecl")
    return j.withColumns({"delta_ead": F.col("stressed_ead") - F.col("baseline_ead"), "delta_ecl": d,
                          "delta_ecl_pct": F.when(F.col("baseline_ecl") != 0, d / F.col("baseline_ecl")).otherwise(0.0)})


def waterfall(st: DataFrame, curves: DataFrame, s: Scenario, cfg: ECL, base_rho: float | None) -> DataFrame:
    """Loss after each step PD, stage, LGD, EAD, all from one pass over the book and one aggregate.

    The PD step already carries the portfolio downgrades, so the order of the steps matters.
    """
    shocked = macro_controls(curves, s, base_rho)
    w0, w1 = ecl.scenario_weights(curves), ecl.scenario_weights(shocked)
    names = list(w0)
    df = staging_controls(portfolio_shock(st, s), s)
    # The shocked curves stand beside the others under marked names; all three sets come back in one join.
    both = curves.unionByName(shocked.withColumn("scenario", F.concat(F.lit("shocked_"), "scenario")))
    base, hit = {n: n for n in names}, {n: f"shocked_{n}" for n in names}
    df = ecl.with_unit_loss(df, both, [ecl.UnitLoss("b_", "base_rating", "base_stage", base), ecl.UnitLoss("p_", "rating", "base_stage", hit),
                                       ecl.UnitLoss("s_", "rating", "stage", hit)], cfg)

    def total(prefix: str, weights, ead: Column, lgd: Column, stage: str) -> Column:
        return F.sum(ecl.weighted({n: ecl.loss(F.col(f"{prefix}{n}"), ead, lgd, F.col(stage)) for n in names}, weights))

    e, g = F.col("base_ead"), F.col("base_lgd")
    one = df.agg(total("b_", w0, e, g, "base_stage").alias("t0"), total("p_", w1, e, g, "base_stage").alias("t1"),
                 total("s_", w1, e, g, "stage").alias("t2"), total("s_", w1, e, lgd_control(s), "stage").alias("t3"),
                 total("s_", w1, ead_control(s), lgd_control(s), "stage").alias("t4"))
    steps = ("PD / macro effect", "Stage migration effect", "LGD effect", "EAD effect")
    rows = [[F.lit(n), F.col(f"t{i}"), F.col(f"t{i + 1}"), F.col(f"t{i + 1}") - F.col(f"t{i}")] for i, n in enumerate(steps)]
    residual = (F.col("t4") - F.col("t0")) - sum((r[3] for r in rows), F.lit(0.0))
    rows.append([F.lit("interaction / residual"), F.col("t4"), F.col("t4") + residual, residual])
    return tagged_rows(one, [], rows, ["driver", "starting_ecl", "ending_ecl", "effect"])


def outcome(before: DataFrame, after: DataFrame, s: Scenario) -> DataFrame:
    b = before.agg(F.sum("ead").alias("baseline_ead"), F.sum("ecl_weighted").alias("baseline_ecl"))
    a = after.agg(F.sum("ead").alias("stressed_ead"), F.sum("ecl_weighted").alias("stressed_ecl"))
    t = b.crossJoin(a)  # two single-row aggregates
    d = F.col("stressed_ecl") - F.col("baseline_ecl")
    return t.select(F.lit(s.name).alias("scenario"), "*", d.alias("delta_ecl"), F.when(F.col("baseline_ecl") != 0, d / F.col("baseline_ecl"))
                    .otherwise(0.0).alias("delta_ecl_pct"))
