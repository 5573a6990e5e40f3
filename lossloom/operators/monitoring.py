"""Traffic-light status of model metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metric, bounds of green and amber; None leaves a side open.
BANDS: Mapping[str, tuple[float | None, float | None, float | None, float | None]] = {
    "scorecard_auc": (0.75, None, 0.65, None),
    "scorecard_psi": (None, 0.10, None, 0.25),
    "oe_ratio": (0.80, 1.25, 0.60, 1.50),
    "brier": (None, 0.02, None, 0.05),
    "mae": (None, 0.05, None, 0.15),
}


def with_status(metrics: DataFrame, bands: Mapping[str, tuple] = BANDS) -> DataFrame:
    """Add GREEN, AMBER or RED to (metric, value) rows; metrics without bounds get null."""
    v = F.col("value")

    def inside(lo, hi):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (v >= lo)
        if hi is not None:
            cond = cond & (v <= hi)
        return cond

    status = F.lit(None).cast("string")
    for m, (g0, g1, a0, a1) in bands.items():
        light = F.when(inside(g0, g1), "GREEN").when(inside(a0, a1), "AMBER").otherwise("RED")
        status = F.when(F.col("metric") == m, light).otherwise(status)
    return metrics.withColumn("status", status)
