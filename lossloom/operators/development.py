"""Development sample: snapshot dates, temporal splits, eligibility and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.config import Development, Windows
from lossloom.functions.exprs import count_if, flag, safe_div, tagged_rows, uniform_hash
from lossloom.functions.joins import loan_join

SPLITS = ("TRAIN", "VALIDATION", "OOT")
SNAPSHOT_MONTHS = {"monthly": tuple(range(1, 13)), "quarter_end": (3, 6, 9, 12), "year_end": (12,)}


def snapshots(targets: DataFrame, cfg: Development) -> DataFrame:
    """Rows on snapshot months inside the overall date span; the span reaches the parquet scan as a filter."""
    if cfg.snapshot not in SNAPSHOT_MONTHS:
        raise ValueError(f"unknown snapshot frequency: {cfg.snapshot}")
    spans = cfg.windows.named()
    df = targets.where(F.col("as_of_date").between(F.lit(min(a for _, a, _ in spans)), F.lit(max(b for _, _, b in spans))))
    return df if cfg.snapshot == "monthly" else df.where(F.month("as_of_date").isin(*SNAPSHOT_MONTHS[cfg.snapshot]))


def split_of(windows: Windows, on: str = "as_of_date") -> Column:
    expr = F.when(F.lit(False), F.lit(None))
    for name, a, b in windows.named():
        expr = expr.when(F.col(on).between(F.lit(a), F.lit(b)), F.lit(name))
    return expr.otherwise("EXCLUDED")


def eligible(df: DataFrame, cfg: Development) -> DataFrame:
    ok = (F.col("eligible_for_12m_pd") & F.col("target_12m_observable") & F.col("default_next_12m").isNotNull()
          & (F.col("as_of_date") <= F.lit(cfg.full_horizon_cutoff)))
    return df.withColumns({"development_eligible_12m": ok, "raw_split": split_of(cfg.windows)})


def population(df: DataFrame, cfg: Development) -> DataFrame:
    """All rows for behavioural use; the first row of each loan for application use."""
    if cfg.population == "behavioural":
        return df
    if cfg.population != "application":
        raise ValueError(f"unknown population: {cfg.population}")
    first = df.groupBy("loan_id").agg(F.min("as_of_date").alias("as_of_date"))
    return loan_join(df, first, ["loan_id", "as_of_date"], "left_semi")


def assign_split(df: DataFrame, cfg: Development) -> DataFrame:
    """Keep the window split, or with ``loan_disjoint`` only the earliest split of each loan."""
    if not cfg.loan_disjoint:
        return df.withColumn("split", F.col("raw_split"))
    rank = F.lit(None).cast("int")
    for i, s in enumerate(SPLITS):
        rank = F.when(F.col("raw_split") == s, i).otherwise(rank)
    ranked = df.withColumn("_rank", rank)
    first = F.min("_rank").over(Window.partitionBy("loan_id"))
    keep = F.col("_rank") == first
    return ranked.withColumn("split", F.when(keep, F.col("raw_split")).otherwise("EXCLUDED")).drop("_rank")


def sampling(df: DataFrame, cfg: Development) -> DataFrame:
    """Keep probability per row. Defaults are always kept; a stratum at or below the minimum is kept whole."""
    draw = uniform_hash("loan_id", "as_of_date", F.lit(cfg.seed))
    fraction = F.lit(float(cfg.nondefault_fraction))
    one = F.lit(1.0)
    bad = F.col("default_next_12m") == 1
    if cfg.sampling == "none":
        return df.withColumns({"deterministic_random": one, "sampling_probability": one})
    if cfg.sampling == "random_nondefault":
        return df.withColumns({"deterministic_random": draw,
                               "sampling_probability": F.when(bad, one).otherwise(fraction)})
    if cfg.sampling != "stratified_nondefault":
        raise ValueError(f"unknown sampling: {cfg.sampling}")
    # Counts per split and year are joined back: a window would gather a whole stratum in one task.
    keyed = df.withColumn("_y", F.year("as_of_date"))
    counts = keyed.groupBy("split", "_y").agg(count_if(F.col("default_next_12m") == 0).alias("_goods"))
    p = (F.when(bad | (F.col("split") == "EXCLUDED"), one)
         .when(F.col("_goods") <= cfg.min_nondefaults_per_stratum, one).otherwise(fraction))
    return (keyed.join(counts, ["split", "_y"]).withColumns({"deterministic_random": draw, "sampling_probability": p})
            .drop("_y", "_goods"))


def sample(targets: DataFrame, cfg: Development) -> DataFrame:
    df = sampling(assign_split(population(eligible(snapshots(targets, cfg), cfg), cfg), cfg), cfg)
    ok = F.col("development_eligible_12m")
    bad = F.col("default_next_12m") == 1
    picked = F.when(~ok, False).when(bad, True).when(F.col("split") == "EXCLUDED", False).otherwise(
        F.col("deterministic_random") <= F.col("sampling_probability"))
    return df.select(
        "loan_id", "as_of_date", "split", F.lit(cfg.snapshot).alias("snapshot_frequency"),
        F.lit(cfg.population).alias("population"), "development_eligible_12m", "default_next_12m",
        picked.alias("sample_selected"), F.when(ok, F.col("sampling_probability")).alias("sampling_probability"),
        F.when(ok, 1 / F.col("sampling_probability")).alias("sample_weight"), "target_12m_observable", "event_censored",
        "event_type", F.year("as_of_date").alias("observation_year"))


def _counts() -> dict[str, Column]:
    ok, y = F.col("development_eligible_12m"), F.col("default_next_12m")
    return {"rows": F.count(F.lit(1)), "eligible": count_if(ok), "bads": count_if(ok & (y == 1)),
            "goods": count_if(ok & (y == 0)), "censored": count_if(~F.col("target_12m_observable")),
            "selected": count_if(F.col("sample_selected"))}


def _by_loan(dev: DataFrame, *keys: str) -> DataFrame:
    """Counts with distinct loans, grouped through the loan so that no task holds a distinct set."""
    per_loan = dev.groupBy(*keys, "loan_id").agg(*[v.alias(k) for k, v in _counts().items()])
    return per_loan.groupBy(*keys).agg(F.count(F.lit(1)).alias("loans"), *[F.sum(k).alias(k) for k in _counts()])


def split_profile(dev: DataFrame) -> DataFrame:
    t = _by_loan(dev, "split", "observation_year")
    return t.select("split", "observation_year", "rows", "loans", F.col("eligible").alias("eligible_rows"),
                    F.col("bads").alias("defaults"), F.col("goods").alias("nondefaults"),
                    safe_div("bads", "eligible").alias("bad_rate"), F.col("censored").alias("censored_rows"),
                    (F.col("rows") - F.col("eligible")).alias("excluded_rows"),
                    safe_div("goods", "bads").alias("nondefault_to_default_ratio"))


OVERLAPS = {"train_validation_overlap": ("TRAIN", "VALIDATION"), "train_oot_overlap": ("TRAIN", "OOT"),
            "validation_oot_overlap": ("VALIDATION", "OOT")}


def overlaps(dev: DataFrame) -> DataFrame:
    """One row: loans seen in more than one split, and in each pair of splits."""
    per_loan = dev.where("development_eligible_12m").groupBy("loan_id").agg(
        *[F.max(flag(F.col("split") == s)).alias(s) for s in SPLITS])
    many = sum((F.col(s).cast("int") for s in SPLITS), F.lit(0)) > 1
    return per_loan.agg(count_if(many).alias("loans_in_multiple_splits"),
                        *[count_if(F.col(a) & F.col(b)).alias(k) for k, (a, b) in OVERLAPS.items()])


def sample_profile(dev: DataFrame) -> DataFrame:
    t = _by_loan(dev, "split")
    rows = [[F.lit(n), F.col(c).cast("double")] for n, c in (
        ("rows", "rows"), ("loans", "loans"), ("selected_rows", "selected"), ("defaults", "bads"), ("nondefaults", "goods"))]
    per_split = tagged_rows(t, ["split"], rows, ["metric", "value"])
    o = overlaps(dev)
    rest = tagged_rows(o, [], [[F.lit(c), F.lit("ALL"), F.col(c).cast("double")] for c in o.columns],
                       ["metric", "split", "value"])
    return per_split.unionByName(rest)


def validation(dev: DataFrame) -> DataFrame:
    t = _by_loan(dev.where("development_eligible_12m"), "split")
    return t.select("split", "rows", "loans", F.col("bads").alias("defaults"), safe_div("bads", "rows").alias("bad_rate"))
