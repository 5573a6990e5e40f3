"""Cumulative sums, quantiles and ranks that never put a whole group into one task.

A window ordered over a whole split or feature would gather that group in a single partition. Here each group is
first cut into value ranges by approximate splitters (only the balance depends on them, never the result), totals are
accumulated over the few ranges, and the ordered window runs inside one range at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.functions.exprs import safe_div, uniform_hash
from lossloom.sources.store import cut_lineage

#: Most groups whose cut points and range offsets are sent to every task; more groups are joined by a shuffle.
MAX_GROUPS = 10_000
MOST_RANGES = 4096


def ranges_of(df: DataFrame) -> int:
    """Value ranges per group: four to a shuffle partition, so that they grow with the cluster the session is set up for."""
    return min(MOST_RANGES, max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _matching(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Inner join on ``keys``, null equal to null; keeps the left columns and the right ones that are not keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(F.broadcast(renamed) if small else renamed, on).drop(*[f"_r_{k}" for k in keys])


def _cuts_below(value: Column | str, ranges: int) -> Column:
    """How many of the ascending ``_cuts``, fewer than ``ranges``, lie below a value: found by halving, as their number grows with the input."""
    v = F.col(value) if isinstance(value, str) else value
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.col("_cuts"), at + step - 1) < v, at + step).otherwise(at))


def in_ranges(df: DataFrame, groups: Sequence[str], value: str, ranges: int | None = None) -> tuple[DataFrame, bool]:
    """Rows with ``_range``, and whether the groups are few enough for broadcasts. One row per group reaches the driver, MAX_GROUPS at most."""
    n = ranges or ranges_of(df)
    cuts = df.groupBy(*groups).agg(F.percentile_approx(value, [i / n for i in range(1, n)], 32 * n).alias("_cuts"))
    rows = cuts.limit(MAX_GROUPS + 1).collect()
    small = len(rows) <= MAX_GROUPS
    if small:
        cuts = df.sparkSession.createDataFrame(rows, cuts.schema)
    placed = _matching(df, cuts, groups, small)
    return placed.withColumn("_range", _cuts_below(value, n)).drop("_cuts"), small


def running_totals(df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add ``<s>_cum`` (ascending, inclusive, nulls first) and ``<s>_all`` for each column in ``sums``.

    ``df`` must be unique on groups + order. The first order column must be numeric; it defines the ranges. Null groups are groups like any
    other. Rows move once, to (groups, range): cut points and offsets have one row per group and per group and range, and are broadcast.
    """
    g = list(groups)
    placed, small = in_ranges(df, g, order[0])
    per_range = placed.groupBy(*g, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*g).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    offsets = per_range.select(
        *g, "_range",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"{s}_all") for s in sums])
    inside = Window.partitionBy(*g, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _matching(placed, offsets, [*g, "_range"], small)
    return out.select(
        *df.columns,
        *[(F.col(f"_o_{s}") + F.sum(s).over(inside)).alias(f"{s}_cum") for s in sums],
        *[F.col(f"{s}_all") for s in sums])


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """One row per group with an array of linearly interpolated quantiles of the non-null values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, groups, [value], ["_n"])
    picks = []
    for i, p in enumerate(probs):
        pos = (F.col("_n_all") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_n_cum") - F.col("_n") <= at) & (at < F.col("_n_cum"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{side}{i}"))
    wide = ranked.groupBy(*groups).agg(F.first("_n_all").alias("_n_all"), *picks)
    values = []
    for i, p in enumerate(probs):
        pos = (F.col("_n_all") - 1) * F.lit(float(p))
        values.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos)))
    return wide.select(*groups, F.array(*values).alias(out))


def global_rank(df: DataFrame, groups: Sequence[str], order: str, ties: Sequence[str]) -> DataFrame:
    """Add ``rn`` (1-based rank inside the group) and ``n`` (group size).

    Ties on ``order`` are broken by a hash of ``ties`` and then by ``ties``, so that one value shared by a large part
    of the table is still split over many tasks.
    """
    g = list(groups)
    h = df.withColumn("_h", uniform_hash(*ties)).withColumn("_slot", F.floor(F.col("_h") * ranges_of(df)))
    cells = h.groupBy(*g, order, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(cells, g, [order, "_slot"], ["_n"]).select(
        *g, order, "_slot", (F.col("_n_cum") - F.col("_n")).alias("_before"), F.col("_n_all").alias("n"))
    w = Window.partitionBy(*g, order, "_slot").orderBy("_h", *ties)
    return (_matching(h, placed, [*g, order, "_slot"], small=False)
            .withColumn("rn", F.col("_before") + F.row_number().over(w))
            .select(*df.columns, "rn", "n"))


def rank_decile(rn: str = "rn", n: str = "n", k: int = 10):
    """Equal-frequency class 1..k of a 1-based rank, with right-closed edges at the linear quantiles of 1..n."""
    pos = F.ceil((F.col(rn) - 1) * k / F.greatest(F.col(n) - 1, F.lit(1)))
    return F.greatest(F.lit(1), pos).cast("long")


def class_sums(df: DataFrame, groups: Sequence[str], order: str, ties: Sequence[str], sums: dict[str, Column], lows: dict[str, Column] | None = None,
               highs: dict[str, Column] | None = None, k: int = 10) -> DataFrame:
    """One row per group and equal-frequency ``class`` 1..k with ``rows`` and the given sums, minima and maxima.

    The classes are those of ``rank_decile`` over ``global_rank``, but rows are not ranked one by one. They are first summed up per value
    range; a range whose first and last rank fall into one class goes into it whole. Only the rows of ranges that an edge
    crosses, at most k - 1 per group, are sent on and ranked inside their range.
    """
    g = list(groups)
    parts = {**{n: (F.sum, c) for n, c in sums.items()}, **{n: (F.min, c) for n, c in (lows or {}).items()}, **{n: (F.max, c) for n, c in (highs or {}).items()}}
    placed, small = in_ranges(df, g, order)
    placed = placed.withColumnRenamed("_range", "_span")
    cells = placed.groupBy(*g, "_span").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(n) for n, (f, c) in parts.items()])
    run = Window.partitionBy(*g).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"_under": F.coalesce(F.sum("rows").over(run), F.lit(0)), "_all": F.sum("rows").over(Window.partitionBy(*g))})
    cells = cells.withColumns({"_first": F.col("_under") + 1, "_last": F.col("_under") + F.col("rows")})
    cells = cut_lineage(cells.withColumns({"class": rank_decile("_first", "_all", k), "_to": rank_decile("_last", "_all", k)}), "class-cells")
    crossed = cells.where(F.col("class") < F.col("_to")).select(*g, "_span", "_under", "_all")
    ranked = global_rank(_matching(placed, crossed, [*g, "_span"], small), [*g, "_span"], order, ties)
    ranked = ranked.withColumn("rn", F.col("_under") + F.col("rn")).withColumn("class", rank_decile("rn", "_all", k))
    edges = ranked.groupBy(*g, "class").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(n) for n, (f, c) in parts.items()])
    whole = cells.where(F.col("class") == F.col("_to")).select(*g, "class", "rows", *parts)
    return whole.unionByName(edges).groupBy(*g, "class").agg(F.sum("rows").alias("rows"), *[f(n).alias(n) for n, (f, _) in parts.items()])


def score_totals(df: DataFrame, groups: Sequence[str], score: str, target: str, weight: str) -> DataFrame:
    """Weighted bads and goods per distinct score with running totals: the base of every ranking metric."""
    t = df.groupBy(*groups, score).agg(
        F.sum(F.when(F.col(target) == 1, F.col(weight)).otherwise(0.0)).alias("bad"),
        F.sum(F.when(F.col(target) == 0, F.col(weight)).otherwise(0.0)).alias("good"))
    return running_totals(t, groups, [score], ["bad", "good"])


def ranking_metrics(df: DataFrame, groups: Sequence[str], score: str, target: str, weight: str) -> DataFrame:
    """AUC (ties count half), Gini, KS and average precision per group, from one table of distinct scores."""
    t = score_totals(df, groups, score, target, weight)
    bad_above = F.col("bad_all") - F.col("bad_cum") + F.col("bad")
    good_above = F.col("good_all") - F.col("good_cum") + F.col("good")
    area = F.sum(F.col("bad") * (F.col("good_cum") - F.col("good") / 2))
    ks = F.max(F.abs(safe_div("bad_cum", "bad_all") - safe_div("good_cum", "good_all")))
    m = t.groupBy(*groups).agg(
        area.alias("_area"), F.first("bad_all").alias("_b"), F.first("good_all").alias("_g"), ks.alias("_ks"),
        F.sum(F.col("bad") * safe_div(bad_above, bad_above + good_above)).alias("_ap"))
    both = (F.col("_b") > 0) & (F.col("_g") > 0)
    auc = F.when(both, F.col("_area") / (F.col("_b") * F.col("_g"))).otherwise(F.lit(0.5))
    return m.select(*groups, auc.alias("roc_auc"), (2 * auc - 1).alias("gini"),
                    F.when(both, F.col("_ks")).otherwise(F.lit(0.0)).alias("ks"),
                    F.coalesce(safe_div("_ap", "_b"), F.lit(0.0)).alias("pr_auc"))
