"""Headline timings on two input folders; prints one JSON line.

The smaller folder comes first and warms the code up. Besides seconds, every line of the published baseline gets a rate: rows of
the larger folder per second, and of the increment between the two, which leaves fixed costs out.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lossloom.plans.catalog import REGISTRY
from lossloom.session import build_session
from lossloom.sources.store import Stages, stages_for

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
SMALL_DIR = os.environ.get("BENCH_SMALL_DIR", os.path.join(os.path.dirname(SF_DIR), "sf0.01"))
# Stage builds, each from the stored stages before it, then fits and reports over them.
STAGES = ("loans", "perf", "mart", "targets", "events", "dev", "frame", "scored", "preds", "portfolio_ttc", "rating_ttc", "lifetime", "macro",
          "scenario_pd", "curves", "episodes", "lgd", "staging", "ead", "book", "ecl")
QUERIES = ("tg13_target_observability", "sc08_logistic_fit", "sc11_binary_metrics", "sc15_decile_table", "pd11_transitions",
           "lg17_backtest_splits", "ea05_ratio_model", "si09_sensitivity_grid", "ec08_summary_stage", "sl07_rescored", "sl09_waterfall")
# Line of the baseline: the steps it takes here and the stage whose rows it counts.
LINES = {
    "gold_mart": (("stage_mart",), "mart"),
    "scorecard": (("stage_dev", "stage_frame", "sc08_logistic_fit", "stage_scored", "sc11_binary_metrics", "sc15_decile_table"), "frame"),
    "pd_framework": (("stage_preds", "stage_portfolio_ttc", "stage_rating_ttc", "stage_lifetime", "pd11_transitions"), "preds"),
    "lgd": (("stage_episodes", "stage_lgd", "lg17_backtest_splits"), "episodes"),
    "ead": (("stage_ead", "ea05_ratio_model"), "ead"),
    "staging": (("stage_staging", "si09_sensitivity_grid"), "staging"),
    "ecl": (("stage_book", "stage_ecl", "ec08_summary_stage"), "book"),
    "scenario_severe": (("sl07_rescored", "sl09_waterfall"), "book"),
}


def measure(spark, folder: str) -> tuple[dict[str, float], dict[str, int]]:
    t: Stages = stages_for(spark, folder)
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - start, 3)
        print(folder, name, took[name], file=sys.stderr, flush=True)

    for name in STAGES:
        timed(f"stage_{name}", lambda name=name: t(name))
    for name in QUERIES:
        if name in REGISTRY:
            timed(name, lambda name=name: REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save())
    return took, {s: t(s).count() for s in {s for _, s in LINES.values()}}


def main() -> None:
    spark = build_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    small, small_rows = measure(spark, SMALL_DIR)
    took, rows = measure(spark, SF_DIR)
    rates = {}
    for line, (steps, stage) in LINES.items():
        big, low = (sum(x.get(s, 0.0) for s in steps) for x in (took, small))
        rates[line] = {"rows": rows[stage], "rows_per_sec": round(rows[stage] / big),
                       "increment_rows_per_sec": round((rows[stage] - small_rows[stage]) / (big - low)) if big > low else None}
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1],
                      "small_total": round(sum(small.values()), 3), "rates": rates}))


if __name__ == "__main__":
    main()
