"""A delivery for one vintage rewrites its own folders only, with the result of a full build."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lossloom.config import Settings
from lossloom.plans import jobs
from lossloom.sources import vintages
from lossloom.sources.store import Stages

TABLES = ("loan_static", "loan_month", "pd_12m_targets", "default_events")
AT = "2001-09-01T00:00:00+00:00"


def digest(df):
    names = sorted(c for c in df.columns if not c.startswith("_"))
    return tuple(df.select(F.xxhash64(*names).cast("decimal(38,0)").alias("h")).agg(F.count("h"), F.sum("h")).first())


def stamps(job, name):
    return dict(vintages.folder_stamps(job.spark, f"{job.root}/{name}").collect())


@pytest.fixture(scope="module")
def delivered(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vintages")
    t = Stages(spark, "/root/testdata/sf0.001")
    years = sorted(r[0] for r in t("raw_perf").select("vintage_year").distinct().collect())
    changed = years[len(years) // 2]
    for dataset, name in (("origination", "raw_orig"), ("performance", "raw_perf")):
        t(name).write.partitionBy("vintage_year").text(f"{root}/text/{dataset}")
        part = t(name).where(F.col("vintage_year") == changed)
        if dataset == "performance":
            part = part.where(F.pmod(F.xxhash64("value"), F.lit(4)) > 0)  # the corrected delivery has fewer months
        part.write.partitionBy("vintage_year").text(f"{root}/again/{dataset}")
    job = jobs.Job(spark, f"{root}/run", Settings())
    jobs.run_ingestion(job, f"{root}/text", AT, quarantine=True)
    jobs.run_silver_build(job)
    jobs.run_mart_build(job)
    jobs.run_target_build(job)
    return job, f"{root}/again", changed


def test_update_equals_full_build(delivered):
    job, again, changed = delivered
    before, digests = {t: stamps(job, t) for t in TABLES}, {t: digest(job.read(t)) for t in TABLES}
    jobs.run_vintage_update(job)
    assert {t: stamps(job, t) for t in TABLES} == before  # nothing was delivered
    jobs.run_ingestion(job, again, AT, force=True, quarantine=True)
    jobs.run_silver_build(job)  # leaves years alone that are there, and does not count them as built
    jobs.run_vintage_update(job)
    for t in TABLES:
        now = stamps(job, t)
        assert {v for v in now if now[v] != before[t].get(v)} == {changed}, t
    updated = {t: digest(job.read(t)) for t in TABLES}
    assert updated["loan_month"] != digests["loan_month"] and updated["loan_static"] == digests["loan_static"]
    jobs.run_silver_build(job, force=True)
    jobs.run_mart_build(job)
    jobs.run_target_build(job)
    assert {t: digest(job.read(t)) for t in TABLES} == updated

    vintages.drop_vintages(job.spark, f"{job.root}/bronze/origination", [changed], "_source_year")
    vintages.drop_vintages(job.spark, f"{job.root}/bronze/performance", [changed], "_source_year")
    jobs.run_vintage_update(job)
    for t in TABLES:
        assert set(stamps(job, t)) == set(before[t]) - {changed}, t


def test_tables_serve_loan_joins_without_a_shuffle(delivered, spark):
    from lossloom.sources.store import loan_co_location

    job, _, _ = delivered
    with loan_co_location(spark):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = job.read("loan_month").join(job.read("pd_12m_targets").drop("vintage_year"), ["loan_id", "as_of_date"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_vintages_that_share_loans_are_rebuilt_together(spark):
    loans = spark.createDataFrame([("a", 2001), ("a", 2002), ("b", 2002), ("b", 2004), ("c", 2003), ("d", 2001), ("d", 2001)], "loan_id string, vintage_year int")
    assert vintages.closed_over_loans(loans, [2001]) == [2001, 2002, 2004]
    assert vintages.closed_over_loans(loans, [2003]) == [2003]
    assert vintages.closed_over_loans(loans, []) == []


def test_another_definition_makes_all_vintages_stale(delivered, spark):
    job, _, _ = delivered
    source, state = {f"{job.root}/loan_month": vintages.VINTAGE}, f"{job.root}/vintage_state/targets"
    assert vintages.changes(spark, source, state, repr(job.cfg.default)).changed == ()
    assert len(vintages.changes(spark, source, state, "other").changed) == len(stamps(job, "loan_month"))
