"""The fit by value ranges against plain pooling of adjacent violators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossloom.functions.isotonic import fit_isotonic, interpolated, lower_hull


def pooled(x, w, wy):
    """Blocks by plain pooling: [lo, hi, value, weight]."""
    stack = []
    for xi, wi, yi in sorted(zip(x, w, wy)):
        stack.append([xi, xi, wi, yi])
        while len(stack) > 1 and stack[-2][3] / stack[-2][2] >= stack[-1][3] / stack[-1][2]:
            last = stack.pop()
            stack[-1] = [stack[-1][0], last[1], stack[-1][2] + last[2], stack[-1][3] + last[3]]
    return [(lo, hi, y / w, w) for lo, hi, w, y in stack]


def cases():
    rng = np.random.default_rng(5)
    n = 600
    x = np.round(np.sort(rng.random(n)), 9)
    w = rng.integers(1, 9, n).astype(float)
    yield "noise", x, w, w * rng.integers(0, 2, n)
    yield "rising", x, w, w * (rng.random(n) < x)
    yield "falling", x, w, w * (1 - x)
    yield "strictly rising", x, w, w * x
    yield "one late drop", x, w, w * np.where(np.arange(n) < n - 1, x, -50.0)
    yield "one early peak", x, w, w * np.where(np.arange(n) > 0, x, 900.0)
    yield "equal", x, w, w * 0.25
    yield "one score", x[:1], w[:1], w[:1] * 0.5


@pytest.mark.parametrize("ranges, names", [(2, {"noise"}), (7, {"noise", "falling", "one late drop", "one early peak", "equal", "one score"}), (40, {"noise", "strictly rising"})])
def test_blocks_equal_plain_pooling(spark, ranges, names):
    for name, x, w, wy in cases():
        if name not in names:
            continue
        df = spark.createDataFrame(pd.DataFrame({"x": x, "w": w, "wy": wy}))
        # Neighbours of one value may be kept as one block or two; compare the fitted value of every score.
        got = interpolated(df, "x", fit_isotonic(df, ranges), "y").orderBy("x").toPandas()["y"].to_numpy()
        want = np.concatenate([[v] * int(((x >= lo) & (x <= hi)).sum()) for lo, hi, v, _ in pooled(x, w, wy)])
        assert np.allclose(got, want, atol=1e-9), name
        assert (np.diff(got) > -1e-9).all(), name


def test_lines_between_blocks_and_the_lookup_by_range(spark):
    _, x, w, wy = next(c for c in cases() if c[0] == "rising")
    blocks = fit_isotonic(spark.createDataFrame(pd.DataFrame({"x": x, "w": w, "wy": wy})))
    knots = sorted({(p, b["y"]) for b in blocks.collect() for p in (b["lo"], b["hi"])})
    scores = [None, -1.0, 0.0, 0.31, 0.31, 0.5, 0.77123, 1.0, 5.0, *x[:9].tolist()]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id int, s double")
    for limit in (10**6, 3):
        got = {r["id"]: r["v"] for r in interpolated(df, "s", blocks, "v", max_knots=limit).collect()}
        assert len(got) == len(scores)
        for i, s in enumerate(scores):
            assert got[i] is None if s is None else abs(got[i] - np.interp(s, *zip(*knots))) < 1e-9


def test_cells_without_score_or_weight_take_no_part(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (0.5, 0.0, 0.0), (0.2, 2.0, 1.0), (0.3, 2.0, 0.0)], "x double, w double, wy double")
    assert [tuple(r) for r in fit_isotonic(df).collect()] == [(0.2, 0.3, 0.25, 4.0)]
    none = fit_isotonic(df.where("x > 9"))
    assert none.count() == 0 and interpolated(df, "x", none, "y").where("y IS NOT NULL").count() == 0


def test_hull_keeps_strict_corners_only():
    x, y = np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 2, 1, 5])
    assert lower_hull(x, y) == [0, 3, 4]


def test_totals_are_kept(spark):
    _, x, w, wy = next(cases())
    df = spark.createDataFrame(pd.DataFrame({"x": x, "w": w, "wy": wy}))
    b = fit_isotonic(df, 9).agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    assert np.allclose([b[0], b[1]], [w.sum(), wy.sum()])
