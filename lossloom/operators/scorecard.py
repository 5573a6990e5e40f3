"""WOE scorecard: binning on TRAIN, frozen transform, logistic fit and scoring.

Only bin tables (at most a dozen rows per feature) and coefficients ever reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossloom.config import Scorecard
from lossloom.functions.exprs import bucket, clip, logit, unpivot
from lossloom.functions.joins import loan_join
from lossloom.functions.ranks import exact_quantiles
from lossloom.sources.store import cut_lineage

INF = float("inf")
MISSING = "MISSING"
RARE = "RARE"


@dataclass(frozen=True)
class Bin:
    feature: str
    label: str
    rows: int
    events: float
    non_events: float
    lower: float | None = None
    upper: float | None = None
    categories: tuple[str, ...] | None = None
    woe: float = 0.0
    iv: float = 0.0

    @property
    def total(self) -> float:
        return self.events + self.non_events

    @property
    def bad_rate(self) -> float:
        return self.events / self.total if self.total else 0.0

    def with_next(self, other: Bin) -> Bin:
        return replace(self, upper=other.upper, rows=self.rows + other.rows, events=self.events + other.events,
                       non_events=self.non_events + other.non_events)


def model_frame(dev: DataFrame, view: DataFrame, features: Sequence[str]) -> DataFrame:
    """Selected development rows with their features as of the same month."""
    chosen = dev.where(F.col("development_eligible_12m") & F.col("sample_selected")
                       & F.col("split").isin("TRAIN", "VALIDATION", "OOT"))
    rows = chosen.select("loan_id", "as_of_date", "split", "observation_year", F.col("default_next_12m").alias("target"),
                         "sample_weight", "sampling_probability")
    return loan_join(rows, view.select("loan_id", "as_of_date", "vintage_year", *features), ["loan_id", "as_of_date"])


def numeric_edges(train: DataFrame, features: Sequence[str], max_bins: int) -> dict[str, list[float]]:
    """Distinct quantile edges per feature with open ends."""
    probs = [i / max_bins for i in range(max_bins + 1)]
    q = exact_quantiles(unpivot(train, [], features, "feature", "value"), ["feature"], "value", probs)
    cuts = {r["feature"]: sorted(set(r["q"])) for r in q.collect()}  # features x (bins + 1) numbers
    out = {}
    for f in features:
        inner = cuts.get(f, [])[1:-1]
        out[f] = [-INF, *inner, INF]
    return out


def bin_number(feature: str, edges: Sequence[float]) -> Column:
    """0-based right-closed bin, null when missing."""
    v = F.col(feature).cast("double")
    return bucket(v, edges, list(range(len(edges) - 1)))


def event_sums(df: DataFrame, target: str = "target", weight: str = "sample_weight") -> list[Column]:
    w = F.col(weight)
    return [F.count(F.lit(1)).alias("rows"),
            F.sum(F.when(F.col(target) == 1, w).otherwise(0.0)).alias("events"),
            F.sum(F.when(F.col(target) == 0, w).otherwise(0.0)).alias("non_events")]


def numeric_counts(train: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Rows and weighted events per feature and bin (-1 for missing): one aggregate for all features."""
    cols = {f"_b_{f}": F.coalesce(bin_number(f, e), F.lit(-1)) for f, e in edges.items()}
    wide = train.select("target", "sample_weight", *[x.alias(n) for n, x in cols.items()])
    long = wide.unpivot(["target", "sample_weight"], list(cols), "feature", "bin")
    return long.groupBy(F.substring("feature", 4, 200).alias("feature"), "bin").agg(*event_sums(long))


def category_counts(train: DataFrame, features: Sequence[str]) -> DataFrame:
    long = train.unpivot(["target", "sample_weight"],
                         [F.coalesce(F.col(f).cast("string"), F.lit("__MISSING__")).alias(f) for f in features],
                         "feature", "category")
    return long.groupBy("feature", "category").agg(*event_sums(long))


def category_bins(counts: DataFrame, total_rows: int, cfg: Scorecard) -> DataFrame:
    """Rare categories share one bin; missing keeps its own."""
    least = max(1, int(total_rows * cfg.rare_category_pct))
    label = (F.when((F.col("category") == "__MISSING__") & (F.col("rows") >= least), MISSING)
             .when(F.col("rows") >= least, F.col("category")).otherwise(RARE))
    return counts.groupBy("feature", label.alias("bin_label")).agg(
        F.sum("rows").alias("rows"), F.sum("events").alias("events"), F.sum("non_events").alias("non_events"))


def woe_columns(events: Column, non_events: Column, all_events: Column, all_non_events: Column, smoothing: float):
    bad = (events + smoothing) / (all_events + 2 * smoothing)
    good = (non_events + smoothing) / (all_non_events + 2 * smoothing)
    woe = F.ln(good / bad)
    return woe, (good - bad) * woe


def woe_table(bins: DataFrame, totals: DataFrame, cfg: Scorecard) -> DataFrame:
    """WOE and information value per bin; ``totals`` is the one-row sum of events and non-events."""
    t = bins.crossJoin(totals.select(F.col("events").alias("_e"), F.col("non_events").alias("_n")))
    woe, iv = woe_columns(F.col("events"), F.col("non_events"), F.col("_e"), F.col("_n"), cfg.smoothing)
    return t.withColumns({"woe": woe, "iv": iv}).drop("_e", "_n")


def merge_small(bins: list[Bin], total_rows: int, cfg: Scorecard) -> list[Bin]:
    """Join bins below the population floor to the next one (the last to the one before), rescanning from the start."""
    floor = max(1, int(total_rows * cfg.min_bin_pct))
    while len(bins) > 1:
        at = next((i for i, b in enumerate(bins) if b.rows < floor), None)
        if at is None:
            break
        at = min(at, len(bins) - 2)
        bins = [*bins[:at], bins[at].with_next(bins[at + 1]), *bins[at + 2:]]
    return bins


def merge_monotone(bins: list[Bin]) -> list[Bin]:
    """Join the closest neighbours until the bad rate is monotone or two bins remain."""
    while len(bins) > 2:
        steps = [b.bad_rate - a.bad_rate for a, b in zip(bins, bins[1:])]
        if all(s >= 0 for s in steps) or all(s <= 0 for s in steps):
            break
        at = min(range(len(steps)), key=lambda i: abs(steps[i]))
        bins = [*bins[:at], bins[at].with_next(bins[at + 1]), *bins[at + 2:]]
    return bins


def scored_bin(b: Bin, events: float, non_events: float, smoothing: float) -> Bin:
    bad = (b.events + smoothing) / (events + 2 * smoothing)
    good = (b.non_events + smoothing) / (non_events + 2 * smoothing)
    woe = math.log(good / bad)
    return replace(b, woe=woe, iv=(good - bad) * woe)


def fit_bins(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], cfg: Scorecard) -> dict[str, list[Bin]]:
    """Fitted bins per feature. The table is read twice: once for the edges, once for the counts."""
    out: dict[str, list[Bin]] = {}
    total = train.agg(*event_sums(train)).first()
    n = total["rows"]
    if numeric:
        edges = numeric_edges(train, numeric, cfg.max_bins)
        got: dict[str, dict[int, object]] = {}
        for r in numeric_counts(train, edges).collect():  # at most max_bins + 1 rows per feature
            got.setdefault(r["feature"], {})[r["bin"]] = r
        for f in numeric:
            rows = got.get(f, {})
            bins = [Bin(f, "", r["rows"], r["events"], r["non_events"], edges[f][i], edges[f][i + 1])
                    for i, r in sorted(rows.items()) if i >= 0]
            bins = merge_small(bins, n, cfg)
            if cfg.monotonic:
                bins = merge_monotone(bins)
            bins = [replace(b, label=f"bin_{i}") for i, b in enumerate(bins)]
            if -1 in rows:
                r = rows[-1]
                bins.append(Bin(f, MISSING, r["rows"], r["events"], r["non_events"]))
            out[f] = bins
    if categorical:
        least = max(1, int(n * cfg.rare_category_pct))
        counts = category_counts(train, categorical)
        # Frequent categories are at most 1 / rare_category_pct per feature; the rare rest is summed on the cluster.
        frequent = counts.where(F.col("rows") >= least).collect()
        rare = {r["feature"]: r for r in counts.where(F.col("rows") < least).groupBy("feature").agg(
            F.sum("rows").alias("rows"), F.sum("events").alias("events"), F.sum("non_events").alias("non_events")).collect()}
        for f in categorical:
            named = sorted((r for r in frequent if r["feature"] == f), key=lambda r: r["category"])
            bins = [Bin(f, r["category"], r["rows"], r["events"], r["non_events"], categories=(r["category"],))
                    for r in named if r["category"] != "__MISSING__"]
            if f in rare:
                r = rare[f]
                bins.append(Bin(f, RARE, r["rows"], r["events"], r["non_events"], categories=()))
            bins += [Bin(f, MISSING, r["rows"], r["events"], r["non_events"]) for r in named if r["category"] == "__MISSING__"]
            out[f] = bins
    return {f: [scored_bin(b, total["events"], total["non_events"], cfg.smoothing) for b in bins] for f, bins in out.items()}


def woe_of(feature: str, bins: Sequence[Bin]) -> Column:
    """Frozen WOE of a feature; values no bin covers take the first bin's WOE, unseen categories the rare bin's."""
    v = F.col(feature)
    expr = F.when(F.lit(False), F.lit(None).cast("double"))
    fallback = bins[0].woe if bins else 0.0
    unseen = fallback
    for b in bins:
        if b.label == MISSING and b.categories is None and b.lower is None:
            expr = expr.when(v.isNull(), F.lit(b.woe))
        elif b.categories is not None:
            if b.label == RARE:
                unseen = b.woe
            if b.categories:
                expr = expr.when(v.cast("string").isin(*b.categories), F.lit(b.woe))
        else:
            expr = expr.when((v.cast("double") > F.lit(b.lower)) & (v.cast("double") <= F.lit(b.upper)), F.lit(b.woe))
    return expr.when(v.isNull(), F.lit(fallback)).otherwise(F.lit(unseen))


def transform(df: DataFrame, bins: Mapping[str, Sequence[Bin]], suffix: str = "_woe") -> DataFrame:
    return df.withColumns({f"{f}{suffix}": woe_of(f, b) for f, b in bins.items()})


def bin_table(spark, bins: Mapping[str, Sequence[Bin]], suspicious_iv: float) -> DataFrame:
    rows = []
    for f, bs in bins.items():
        total_iv = sum(b.iv for b in bs)
        for b in bs:
            ends = [None if x is None or math.isinf(x) else float(x) for x in (b.lower, b.upper)]
            rows.append((f, b.label, *ends, list(b.categories) if b.categories is not None else None, b.label == MISSING,
                         int(b.rows), b.events, b.non_events, b.total, b.bad_rate, b.woe, b.iv, total_iv > suspicious_iv))
    return spark.createDataFrame(rows, "feature string, bin_label string, lower double, upper double, categories array<string>, "
                                 "missing boolean, rows long, events double, non_events double, total double, "
                                 "bad_rate double, woe double, iv double, suspicious_high_iv boolean")


def fit_logistic(df: DataFrame, features: Sequence[str], target: str, weight: str, c: float = 1.0, steps: int = 50, tol: float = 1e-10) -> tuple[float, list[float]]:
    """Intercept and coefficients of a weighted logistic model with an L2 penalty of 1/(2C) on the coefficients.

    Rows are read once: they become cells, one per distinct combination of the features with its weights of ones and zeros (a few
    thousand for binned features). Newton steps run over the cells; a step is one aggregate of a few dozen sums and is
    halved while the loss does not fall. (0, 0...) without any weight; a log-odds of the one outcome there is, clipped, without both.
    """
    x, k = [F.col(f"x{i}") for i in range(len(features))], len(features)
    y, w = F.col(target).cast("double"), F.col(weight).cast("double")
    cells = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], (y * w).alias("one"), ((1 - y) * w).alias("zero"))
    cells = cut_lineage(cells.groupBy(*[f"x{i}" for i in range(k)]).agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")), "logistic-cells")
    start = cells.agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).first()
    one, zero = start["one"] or 0.0, start["zero"] or 0.0
    if one <= 0 or zero <= 0:
        share = min(max(one / (one + zero), 1e-8), 1 - 1e-8) if one + zero > 0 else 0.5
        return math.log(share / (1 - share)), [0.0] * k
    design, penalty = [F.lit(1.0), *x], np.array([0.0] + [1.0 / c] * k)

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Penalised loss, its gradient and its Hessian."""
        lp = F.lit(float(beta[0]))
        for b, f in zip(beta[1:], x, strict=True):
            lp = lp + F.lit(float(b)) * f
        p = 1 / (1 + F.exp(-F.col("lp")))
        # ln(1 + e^-|lp|) does not overflow; the rest is linear in lp.
        soft = F.log1p(F.exp(-F.abs("lp")))
        loss = F.col("one") * (soft + F.greatest(-F.col("lp"), F.lit(0.0))) + F.col("zero") * (soft + F.greatest("lp", F.lit(0.0)))
        rows = cells.withColumn("lp", lp).withColumn("p", p).withColumn("loss", loss)
        rows = rows.withColumns({"res": (F.col("one") + F.col("zero")) * F.col("p") - F.col("one"), "curv": (F.col("one") + F.col("zero")) * F.col("p") * (1 - F.col("p"))})
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        got = rows.agg(F.sum("loss"), *[F.sum(F.col("res") * d) for d in design], *[F.sum(F.col("curv") * design[i] * design[j]) for i, j in pairs]).first()
        hess = np.zeros((k + 1, k + 1))
        for (i, j), v in zip(pairs, got[k + 2:], strict=True):
            hess[i, j] = hess[j, i] = v
        return got[0] + float(penalty @ beta**2) / 2, np.array(got[1:k + 2]) + penalty * beta, hess + np.diag(penalty)

    beta = np.array([math.log(one / zero)] + [0.0] * k)
    loss, grad, hess = sums(beta)
    for _ in range(steps):
        step = np.linalg.lstsq(hess, grad, rcond=None)[0]
        scale = 1.0
        while True:
            tried = sums(beta - scale * step)
            if tried[0] <= loss + 1e-12 * abs(loss) or scale < 1e-6:
                break
            scale /= 2
        beta = beta - scale * step
        loss, grad, hess = tried
        if np.abs(scale * step).max() <= tol * max(1.0, np.abs(beta).max()):
            break
    return float(beta[0]), [float(b) for b in beta[1:]]


def linear_predictor(intercept: float, coefs: Mapping[str, float]) -> Column:
    expr = F.lit(float(intercept))
    for f, b in coefs.items():
        expr = expr + F.lit(float(b)) * F.col(f)
    return expr


def points(pd: Column, cfg: Scorecard) -> Column:
    odds = (1 - pd) / clip(pd, 1e-8, 1 - 1e-8)
    return F.lit(cfg.base_score) + F.lit(cfg.pdo / math.log(2)) * (F.ln(odds) - F.lit(math.log(cfg.base_odds)))


def score_rows(frame: DataFrame, intercept: float, coefs: Mapping[str, float], cfg: Scorecard) -> DataFrame:
    lp = linear_predictor(intercept, coefs)
    df = frame.withColumn("linear_predictor", lp).withColumn("predicted_pd_raw", 1 / (1 + F.exp(-F.col("linear_predictor"))))
    return df.withColumn("score", points(F.col("predicted_pd_raw"), cfg))


def band_edges(df: DataFrame, score: str, bands: int) -> list[float]:
    q = exact_quantiles(df.withColumn("_g", F.lit(1)), ["_g"], score, [i / bands for i in range(bands + 1)]).first()
    return [-INF, *sorted(set(q["q"]))[1:-1], INF] if q else [-INF, INF]


def band_labels(edges: Sequence[float], prefix: str = "B", width: int = 2) -> list[str]:
    return [f"{prefix}{i:0{width}d}" for i in range(1, len(edges))]


def with_bands(scored: DataFrame, cfg: Scorecard, score: str = "score") -> DataFrame:
    edges = band_edges(scored.where("split = 'TRAIN'"), score, cfg.bands)
    return scored.withColumn("score_band", bucket(score, edges, band_labels(edges)))


def coefficient_table(spark, intercept: float, coefs: Mapping[str, float]) -> DataFrame:
    rows = [("INTERCEPT", intercept, math.exp(intercept), None, None)]
    rows += [(f, b, math.exp(b), "negative", b <= 0) for f, b in coefs.items()]
    return spark.createDataFrame(rows, "feature string, coefficient double, odds_ratio double, sign_expected string, "
                                 "sign_matches_woe_expectation boolean")


def calibration_line(df: DataFrame, pd: str, target: str, weight: str) -> tuple[float, float]:
    """Intercept and slope of a logistic model on the logit of the prediction; (0, 0) without both outcomes."""
    if df.agg(F.min(target).alias("a"), F.max(target).alias("b")).where("a < b").isEmpty():
        return 0.0, 0.0
    x = df.withColumn("_l", logit(clip(pd, 1e-6, 1 - 1e-6)))
    a, b = fit_logistic(x, ["_l"], target, weight)
    return a, b[0]


