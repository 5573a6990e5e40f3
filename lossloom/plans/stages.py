"""The stage graph: which function builds each stage table from which others, and how it is laid out.

"loan" stages are bucketed on loan_id, "plain" stages are ordinary parquet, "lazy" stages are not written,
"text" stages are text files by vintage year.
"""

from __future__ import annotations

from lossloom.operators import development, ecl, lgd, macro, mart, pd_framework, quality, scenario, silver, staging, targets
from lossloom.plans import demo
from lossloom.sources import panel, rawdemo, text
from lossloom.sources.schemas import layout_for

INGESTED_AT = "2001-09-01T00:00:00+00:00"

BUILDERS: dict[str, tuple] = {
    "loans": (lambda t: panel.loans(t.spark, t.sf_dir), "loan"),
    "perf": (lambda t: panel.performance(t.spark, t.sf_dir, t("loans")), "loan"),
    "raw_orig": (lambda t: rawdemo.origination_lines(t("loans")), "text"),
    "raw_perf": (lambda t: rawdemo.performance_lines(t("perf"), t("loans")), "text"),
    "lines_orig": (lambda t: text.placed(t("raw_orig")), "plain"),
    "lines_perf": (lambda t: text.placed(t("raw_perf")), "plain"),
    "bronze_orig": (lambda t: text.bronze(t("lines_orig"), layout_for("origination", 1995), INGESTED_AT), "plain"),
    "bronze_perf": (lambda t: text.bronze(t("lines_perf"), layout_for("performance", 1995), INGESTED_AT), "plain"),
    "quarantine_orig": (lambda t: text.malformed(t("lines_orig"), layout_for("origination", 1995)), "plain"),
    "quarantine_perf": (lambda t: text.malformed(t("lines_perf"), layout_for("performance", 1995)), "plain"),
    "silver_orig": (lambda t: silver.origination(t("bronze_orig")), "lazy"),
    "silver_perf": (lambda t: silver.performance(t("bronze_perf")), "lazy"),
    "sketch_orig": (lambda t: quality.field_sketches(t("silver_orig")), "plain"),
    "sketch_perf": (lambda t: quality.field_sketches(t("silver_perf")), "plain"),
    "static": (lambda t: mart.loan_static(t("loans")), "lazy"),
    "mart": (lambda t: mart.loan_month(t("perf"), t("static")), "loan"),
    "analytical": (lambda t: mart.analytical(t("mart"), t("static")), "lazy"),
    "state": (lambda t: targets.row_state(t("mart"), t.cfg.default), "lazy"),
    "targets": (lambda t: targets.targets(t("state"), t.cfg.default), "loan"),
    "dev": (lambda t: development.sample(t("targets"), t.cfg.development), "loan"),
    "frame": (demo.frame, "loan"),
    "scored": (demo.scored, "loan"),
    "calibrated": (demo.calibrated, "lazy"),
    "preds": (demo.predictions, "loan"),
    "portfolio_ttc": (lambda t: pd_framework.portfolio_ttc(t("preds"), t.cfg.pd), "plain"),
    "rating_ttc": (lambda t: pd_framework.rating_ttc(t("preds"), t.cfg.pd), "plain"),
    "lifetime": (demo.lifetime, "plain"),
    "macro": (demo.macro_table, "plain"),
    "scenario_pd": (demo.scenario_pd, "plain"),
    "curves": (lambda t: macro.scenario_lifetime(t("lifetime"), t("scenario_pd")), "plain"),
    "events": (lambda t: targets.default_events(t("state"), t.cfg.default), "loan"),
    "episodes": (lambda t: lgd.episodes(t("events"), t("mart"), t("static"), t("preds"), t.cfg.lgd), "loan"),
    "lgd": (demo.lgd_scored, "loan"),
    "staging": (lambda t: staging.allocate(staging.staging_base(t("preds"), t("mart"), t("static"), t("targets"), t("events")),
                                           t.cfg.staging), "loan"),
    "ead": (demo.ead_scored, "loan"),
    "book": (lambda t: scenario.state(t("staging"), t("mart"), t("static"), t("lgd"), t.cfg.ecl), "loan"),
    "ecl": (lambda t: ecl.run(t("staging"), t("mart"), t("static"), t("lgd"), t("curves"), t.cfg.ecl), "loan"),
}
