"""Weighted isotonic regression over value ranges.

The fit is the lower convex hull of the points (running weight, running weighted target) over ascending scores: a block
ends at each corner and its slope is the block's value. Each range finds the corners of its own points; the corners
that survive are those of the hull of all ranges. Only a skeleton of each range (corners 1, 2, 4, 8, ... from either
end) is looked at in one place: corners on or above the skeleton's hull go, and the rounds end when the skeleton is
its own hull. Inside a range corners always stay convex, and both outermost corners are in the skeleton, so that no
violation can be left then; until then each round removes at least one corner, and mostly half of what has to go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.functions.ranks import in_ranges
from lossloom.sources.store import cut_lineage

#: Most knots that are sent to every task as two arrays; a fit with more is looked up range by range.
MAX_KNOTS = 1_000_000


def lower_hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of the strict corners of the lower convex hull of points with ascending x; both ends are corners."""
    kept: list[int] = []
    for i, (xi, yi) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (y[b] - y[a]) * (xi - x[b]) < (yi - y[b]) * (x[b] - x[a]):
                break
            kept.pop()
        kept.append(i)
    return kept


def _range_corners(placed: DataFrame, before: dict[int, tuple[float, float]]) -> DataFrame:
    """Corners of every range's own points; the origin starts the first range."""
    first = min(before)

    def corners(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("x")
        w0, y0 = before[int(key[0])]
        x, w, y = cells["x"].to_numpy(), w0 + cells["w"].cumsum().to_numpy(), y0 + cells["wy"].cumsum().to_numpy()
        if key[0] == first:
            x, w, y = np.r_[np.nan, x], np.r_[0.0, w], np.r_[0.0, y]
        at = lower_hull(w, y)
        return pd.DataFrame({"_range": key[0], "x": x[at], "cw": w[at], "cy": y[at]})

    return placed.groupBy("_range").applyInPandas(corners, "_range int, x double, cw double, cy double")


def _skeleton(corners: DataFrame) -> pd.DataFrame:
    """At most two corners per range and power of two, in order."""
    up = F.row_number().over(Window.partitionBy("_range").orderBy("cw"))
    n = F.count(F.lit(1)).over(Window.partitionBy("_range"))
    ranked = corners.withColumns({"_i": up, "_n": n})
    power = [i.bitwiseAND(i - 1) == 0 for i in (F.col("_i"), F.col("_n") - F.col("_i") + 1)]
    return ranked.where(power[0] | power[1]).select("cw", "cy").toPandas().sort_values("cw", ignore_index=True)


def _below(corners: DataFrame, hull_w: np.ndarray, hull_y: np.ndarray, dropped: np.ndarray) -> DataFrame:
    """Corners that may still be corners of all points: those not above the hull of the skeleton."""
    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[(p["cy"] <= np.interp(p["cw"], hull_w, hull_y)) & ~p["cw"].isin(dropped)]

    return corners.mapInPandas(keep, corners.schema)


def fit_isotonic(cells: DataFrame, ranges: int | None = None) -> DataFrame:
    """Blocks (lo, hi, y, w) of the non-decreasing weighted least-squares fit of ``cells`` (x, w, wy).

    ``cells`` has one row per distinct score x with the sum of weights w and of weighted targets wy. Cells without a score or without a
    positive weight take no part; no cell left, no block. ``ranges`` does not change the result.
    """
    spark = cells.sparkSession
    cells = cells.where("x IS NOT NULL AND w > 0").select(F.col("x").cast("double"), F.col("w").cast("double"), F.col("wy").cast("double"))
    placed, _ = in_ranges(cells.withColumn("_g", F.lit(1)), ["_g"], "x", ranges)
    placed = cut_lineage(placed.select(F.col("_range").cast("int"), "x", "w", "wy"), "isotonic-cells")
    totals = placed.groupBy("_range").agg(F.sum("w"), F.sum("wy")).orderBy("_range").collect()  # one row per range
    if not totals:
        return spark.createDataFrame([], "lo double, hi double, y double, w double")
    before, w, wy = {}, 0.0, 0.0
    for r, dw, dy in totals:
        before[r] = (w, wy)
        w, wy = w + dw, wy + dy
    corners = cut_lineage(_range_corners(placed, before), "isotonic-corners")
    while True:
        points = _skeleton(corners)
        pw, py = points["cw"].to_numpy(), points["cy"].to_numpy()
        at = lower_hull(pw, py)
        if len(at) == len(points):
            break
        corners = cut_lineage(_below(corners, pw[at], py[at], np.delete(pw, at)), "isotonic-corners")
    ends = corners.where("x IS NOT NULL AND NOT isnan(x)")  # without the origin
    firsts = dict(ends.groupBy("_range").agg(F.min("x")).collect())  # one row per range
    after, coming = {}, None
    for r in sorted(before, reverse=True):
        after[r] = coming
        coming = firsts.get(r, coming)

    def sums(key: tuple, part: pd.DataFrame, stops: pd.DataFrame) -> pd.DataFrame:
        """Cells go to the block that the next corner ends, in this range or a later one."""
        known = np.sort(stops["x"].to_numpy())
        if after[int(key[0])] is not None:
            known = np.r_[known, after[int(key[0])]]
        end = known[np.searchsorted(known, part["x"].to_numpy())]
        g = part.assign(end=end).groupby("end")
        return g.agg(lo=("x", "min"), hi=("x", "max"), w=("w", "sum"), wy=("wy", "sum")).reset_index()

    # Block values come from their own cells, not from differences of running totals, which lose digits on large tables.
    parts = placed.groupBy("_range").cogroup(ends.groupBy("_range")).applyInPandas(sums, "end double, lo double, hi double, w double, wy double")
    blocks = parts.groupBy("end").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("wy") / F.sum("w")).alias("y"), F.sum("w").alias("w"))
    return cut_lineage(blocks.select("lo", "hi", "y", "w"), "isotonic-blocks")


def knots(blocks: DataFrame) -> DataFrame:
    """Points (x, y) between which the fit is a straight line."""
    return blocks.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), "y")


def interpolated(df: DataFrame, column: str, blocks: DataFrame, out: str, max_knots: int = MAX_KNOTS) -> DataFrame:
    """Add the fitted value of ``column``: the block's value, a straight line between blocks, the outermost value beyond them.

    Null stays null. Up to ``max_knots`` knots travel to the tasks; more are joined by value range, over distinct scores.
    """
    at = knots(blocks)
    n = at.count()
    if n == 0:
        return df.withColumn(out, F.lit(None).cast("double"))
    if n <= max_knots:
        table = at.toPandas().sort_values("x")
        xs, ys = table["x"].to_numpy(), table["y"].to_numpy()

        @F.pandas_udf("double")
        def lookup(v: pd.Series) -> pd.Series:
            return pd.Series(np.interp(v, xs, ys)).where(v.notna().to_numpy())

        return df.withColumn(out, lookup(F.col(column).cast("double")))
    scores = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")).distinct()
    values = _between(at, scores).withColumnsRenamed({"x": "_score", "y": out})
    return df.join(values, F.col(column).cast("double") == F.col("_score"), "left").drop("_score")


def _between(at: DataFrame, scores: DataFrame) -> DataFrame:
    """Fitted value per distinct score, from the nearest knots on both sides; knots of other ranges are carried over."""
    both = at.select("x", F.struct("x", "y").alias("knot")).unionByName(scores.select("x", F.lit(None).cast("struct<x: double, y: double>").alias("knot")))
    placed, _ = in_ranges(both.withColumn("_g", F.lit(1)), ["_g"], "x")
    placed = cut_lineage(placed.select("_range", "x", "knot"), "isotonic-scores")
    ends = placed.groupBy("_range").agg(F.min("knot").alias("lo"), F.max("knot").alias("hi"))  # one row per range
    order = Window.orderBy("_range")
    ends = ends.select("_range", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"),
                       F.min("lo").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    inside = Window.partitionBy("_range").orderBy("x")
    rows = placed.join(F.broadcast(ends), "_range").withColumns({
        "_a": F.coalesce(F.max("knot").over(inside.rangeBetween(Window.unboundedPreceding, 0)), "_prev"),
        "_b": F.coalesce(F.min("knot").over(inside.rangeBetween(0, Window.unboundedFollowing)), "_next")})
    return rows.where("knot IS NULL").select("x", _line(F.col("x"), F.coalesce("_a", "_b"), F.coalesce("_b", "_a")).alias("y"))


def _line(x: Column, a: Column, b: Column) -> Column:
    return F.when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * F.try_divide(x - a["x"], b["x"] - a["x"]))

