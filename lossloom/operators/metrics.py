"""Model performance tables: discrimination, calibration, stability. Grouping keys are arguments throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.functions.exprs import clip, safe_div, unpivot, wavg
from lossloom.functions.ranks import class_sums, exact_quantiles, ranking_metrics, score_totals


def log_loss_term(y: Column, p: Column) -> Column:
    q = clip(p, 1e-8, 1 - 1e-8)
    return F.when(y == 1, -F.ln(q)).otherwise(-F.ln(1 - q))


def binary_metrics(df: DataFrame, groups: Sequence[str], pd: str, target: str = "target", weight: str = "sample_weight") -> DataFrame:
    """Weighted discrimination and accuracy per group."""
    y, p, w = F.col(target), F.col(pd), F.col(weight)
    sums = df.groupBy(*groups).agg(
        wavg((y - p) * (y - p), w).alias("brier"), wavg(log_loss_term(y, p), w).alias("log_loss"),
        wavg(y, w).alias("observed_bad_rate"), wavg(p, w).alias("predicted_bad_rate"))
    return ranking_metrics(df, groups, pd, target, weight).join(sums, list(groups))


def confusion(df: DataFrame, groups: Sequence[str], cutoff: float, pd: str = "predicted_pd_raw", target: str = "target",
              weight: str = "sample_weight") -> DataFrame:
    high, y = F.col(pd) >= cutoff, F.col(target)

    def w(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(weight)).otherwise(0.0))

    return df.groupBy(*groups).agg(w(high & (y == 1)).alias("true_positive"), w(high & (y == 0)).alias("false_positive"),
                                   w(~high & (y == 0)).alias("true_negative"), w(~high & (y == 1)).alias("false_negative"))


def decile_sums(df: DataFrame, groups: Sequence[str], pd: str, k: int = 10, bounds: str | None = None) -> DataFrame:
    """Rows, weight, weighted bads and weighted prediction per group and decile of the prediction, with the range of ``bounds``."""
    w = F.col("sample_weight")
    sums = {"w": w, "bad": F.col("target") * w, "expected": F.col(pd) * w}
    low, high = ({f"{x}_{bounds}": F.col(bounds)} if bounds else None for x in ("min", "max"))
    return class_sums(df, groups, pd, ["loan_id", "as_of_date"], sums, low, high, k)


def decile_table(df: DataFrame, pd: str = "predicted_pd_raw", k: int = 10) -> DataFrame:
    return decile_sums(df, ["split"], pd, k, "score").select(
        "split", F.col("class").alias("decile"), "rows", safe_div("bad", "w").alias("weighted_bad_rate"),
        safe_div("expected", "w").alias("weighted_predicted_pd"), "min_score", "max_score")


def roc_curve(df: DataFrame, groups: Sequence[str], pd: str = "predicted_pd_raw") -> DataFrame:
    """One point per distinct prediction, so the order of ties cannot matter."""
    t = score_totals(df, groups, pd, "target", "sample_weight")
    above_bad = F.col("bad_all") - F.col("bad_cum") + F.col("bad")
    above_good = F.col("good_all") - F.col("good_cum") + F.col("good")
    return t.where("bad_all > 0 AND good_all > 0").select(
        *groups, (above_good / F.col("good_all")).alias("fpr"), (above_bad / F.col("bad_all")).alias("tpr"),
        F.col(pd).alias("threshold"))


def calibration_curve(df: DataFrame, pd: str = "predicted_pd_raw", k: int = 10, name: str = "bin") -> DataFrame:
    return decile_sums(df, ["split"], pd, k).select(
        "split", F.col("class").alias(name), "rows", safe_div("bad", "w").alias("observed_bad_rate"), safe_div("expected", "w").alias("predicted_bad_rate"))


def lift_table(df: DataFrame, pd: str = "predicted_pd_raw", k: int = 10, descending: bool = True) -> DataFrame:
    """Cumulative capture and lift over deciles, riskiest first; ``descending=False`` starts at the safest."""
    bins = decile_sums(df, ["split"], pd, k).select("split", F.col("class").alias("bin"), "bad", "w")
    order = F.col("bin").desc() if descending else F.col("bin").asc()
    cum = Window.partitionBy("split").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # k rows per split
    whole = Window.partitionBy("split")
    return bins.select("split", "bin", safe_div(F.sum("bad").over(cum), F.sum("bad").over(whole)).alias("cumulative_capture_rate"),
                       safe_div(F.sum("bad").over(cum) / F.sum("w").over(cum),
                                F.sum("bad").over(whole) / F.sum("w").over(whole)).alias("lift"))


def psi_table(df: DataFrame, values: Sequence[str], base: str = "TRAIN", against: Sequence[str] = ("VALIDATION", "OOT"),
              bins: int = 10) -> DataFrame:
    """Population stability of each column against the base split over the base split's quantile bins.

    Works on counts per distinct value, so bin lookup happens once per value and not once per row.
    """
    long = unpivot(df, ["split"], values, "feature", "value").where("value IS NOT NULL AND NOT isnan(value)")
    counts = long.groupBy("feature", "split", "value").agg(F.count(F.lit(1)).alias("n"))
    edges = exact_quantiles(long.where(F.col("split") == base), ["feature"], "value", [i / bins for i in range(bins + 1)])
    inner = edges.select("feature", F.array_distinct("q").alias("e")).select(
        "feature", F.when(F.size("e") > 2, F.slice("e", F.lit(2), F.size("e") - 2)).otherwise(F.array().cast("array<double>")).alias("e"))
    placed = counts.join(inner, "feature").withColumn("bucket", F.size(F.filter("e", lambda x: x <= F.col("value"))))

    def n(s: str) -> Column:
        return F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0))

    cells = placed.groupBy("feature", "bucket").agg(n(base).alias("b"), *[n(s).alias(s) for s in against])
    w = Window.partitionBy("feature")  # at most ``bins`` rows per feature

    def share(c: str) -> Column:
        return F.greatest(safe_div(F.col(c), F.sum(c).over(w)), F.lit(1e-6))

    terms = cells.select("feature", *[((share(s) - share("b")) * F.ln(share(s) / share("b"))).alias(s) for s in against])
    sums = terms.groupBy("feature").agg(*[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in against])
    return sums.unpivot(["feature"], list(against), "_s", "psi").select(
        "feature", F.concat(F.lit(f"{base}_TO_"), F.col("_s")).alias("comparison"), "psi")


def yearly(df: DataFrame, pd: str = "predicted_pd_raw") -> DataFrame:
    m = binary_metrics(df, ["observation_year"], pd)
    n = df.groupBy("observation_year").agg(F.count(F.lit(1)).alias("rows"))
    return m.join(n, "observation_year").select(
        "observation_year", "rows", F.col("observed_bad_rate").alias("bad_rate"), "predicted_bad_rate", "gini", "ks")


def band_summary(df: DataFrame, band: str = "score_band", pd: str = "predicted_pd_raw") -> DataFrame:
    return df.groupBy("split", band).agg(
        F.count(F.lit(1)).alias("rows"), wavg("target", "sample_weight").alias("bad_rate"),
        wavg(pd, "sample_weight").alias("predicted_bad_rate"), F.min("score").alias("min_score"),
        F.max("score").alias("max_score"))


def compare_runs(tables: dict[str, DataFrame]) -> DataFrame:
    """Metric tables of several runs stacked under their run id."""
    out = None
    for run, t in tables.items():
        part = t.select(F.lit(run).alias("run_id"), *t.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
