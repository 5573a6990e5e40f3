"""Plans and task sizes that must not depend on how small a table looks."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lossloom.config import EAD, ECL, LGD, PDFramework, Staging
from lossloom.functions import joins
from lossloom.operators import ead, ecl, lgd, mart, pd_framework, staging
from lossloom.plans.catalog import REGISTRY
from lossloom.sources import panel, schemas, store, text


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_loan_months_are_not_broadcast_for_hazards(spark):
    days = [date(2000, m, 1) for m in range(1, 13)]
    preds = spark.createDataFrame([(k, d, "R1" if k % 2 else "R2") for k in range(4) for d in days], "loan_id long, as_of_date date, rating string")
    events = spark.createDataFrame([(k, d, 13 - d.month, k < 2, False, k >= 2, "DEFAULT") for k in range(4) for d in days],
                                   "loan_id long, as_of_date date, months_until_event int, event_default boolean, event_prepayment_or_exit boolean, "
                                   "event_censored boolean, event_type string")
    found = pd_framework.event_foundation(preds, events)
    assert "Broadcast" not in plan_of(found) and found.count() == 48
    cfg = PDFramework(max_months=12)
    hazards = pd_framework.empirical_hazards(found, cfg)
    assert "event-months" in plan_of(hazards) and "months_until_event" not in plan_of(hazards)
    s = cfg.hazard_smoothing
    got = {(r["rating"], r["month"]): r["conditional_pd"] for r in hazards.collect()}
    # Each rating holds two loans, one of which defaults; month m is reached by the rows that wait m months or more.
    assert got == {(g, m): (1 + s) / (2 * (13 - m) + 2 * s) for g in ("R1", "R2") for m in range(1, 13)}


def looks_small(spark, columns, rows=2):
    """Rows of the named columns whose size Spark knows, as it does of a table's files."""
    def value(c):
        if c.endswith(("date", "month")):
            return F.expr("date_add(date'2000-01-01', cast(id as int))")
        return F.col("id") == 1 if c.endswith(("flag", "event", "default", "_to_date")) else F.col("id").cast("string") if "code" in c or "rating" in c else F.col("id")

    return spark.range(rows).select(*[value(c).alias(c) for c in dict.fromkeys(columns.split() if isinstance(columns, str) else columns)])


JOINS = {
    "staging": lambda d: staging.staging_base(
        d("loan_id as_of_date pd_calibrated_12m rating"), d(staging.MONTH), d("loan_id vintage_year origination_date"), d("loan_id as_of_date default_flag"),
        d("loan_id default_episode_id default_entry_date cure_date default_reason")),
    "episodes": lambda d: lgd.first_terminal(lgd.episode_base(
        d("loan_id vintage_year default_episode_id default_entry_date cure_date default_reason default_due_to_delinquency default_due_to_credit_event redefault_flag"),
        d(["loan_id", "as_of_date", "current_actual_upb", "current_upb_lag_1", *lgd.AT_DEFAULT]), d(["loan_id", "vintage_year", *lgd.STATIC])),
        d(["loan_id", "as_of_date", "zero_balance_code", *lgd.TERMINAL]), LGD()),
    "book": lambda d: ecl.population(
        d("loan_id as_of_date vintage_year ead_current rating_current"),
        d("loan_id as_of_date current_actual_upb current_interest_rate remaining_months_to_maturity_source months_to_contractual_maturity"),
        d("loan_id vintage_year property_state"), ECL()),
    "months": lambda d: mart.analytical(d("loan_id vintage_year as_of_date"), d("loan_id vintage_year origination_date")),
}


@pytest.mark.parametrize("name", JOINS)
def test_loan_tables_are_not_broadcast(spark, name):
    plan = plan_of(JOINS[name](lambda columns: looks_small(spark, columns)))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_unit_losses_are_not_broadcast(spark):
    curves = spark.createDataFrame([(s, "R1", m, 0.01 * m) for s in ("BASE", "DOWNSIDE") for m in (1, 2)], "scenario string, rating string, month int, marginal_pd double")
    rows = [(1, "R1", 1, 2, 0.0), (2, "R1", 1, 2, 0.0), (3, "R1", 2, 4, 0.0), (4, None, 2, 2, 0.0), (5, "R1", 3, 2, 0.0), (6, "R1", 2, None, None)]
    loans = spark.createDataFrame(rows, "loan_id long, rating string, stage int, remaining_months_to_maturity int, current_interest_rate double")
    out = ecl.with_unit_loss(loans, curves, [ecl.UnitLoss("u_", "rating", "stage", {"BASE": "BASE"})], ECL())
    assert "SortMergeJoin" in plan_of(out) and "Broadcast" not in plan_of(out)
    # The balance falls with each month: 0.01 / 2 over two months, 0.01 * 3 / 4 + 0.02 / 2 over four.
    want = {1: 0.005, 2: 0.005, 3: 0.0175, 4: 0.0, 5: 0.0, 6: 0.0}
    assert {r["loan_id"]: round(r["u_BASE"], 9) for r in out.collect()} == want


@pytest.fixture
def partitions(spark):
    """Sets the session's shuffle partitions and puts the old number back."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    yield lambda n=None: int(spark.conf.get(key)) if n is None else spark.conf.set(key, str(n))
    spark.conf.set(key, before)


def tables(spark, root, loans: int) -> str:
    days = [datetime(1995, 1, 5), datetime(1995, 8, 9), datetime(1996, 2, 3)]
    orders = [(10 * k + i, k, "P", 1.0, d, "1-URGENT") for k in range(loans) for i, d in enumerate(days)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
                                  "o_orderpriority string").write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame([(k, 1, 5.0, "AUTO") for k in range(loans)],
                          "c_custkey long, c_nationkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{root}/customer.parquet")
    spark.createDataFrame([(1, "PERU")], "n_nationkey long, n_name string").write.parquet(f"{root}/nation.parquet")
    return str(root)


def test_the_panel_is_dealt_to_all_partitions(spark, partitions, tmp_path):
    root = tables(spark, tmp_path, 40)
    partitions(16)
    perf = panel.performance(spark, root, panel.loans(spark, root))
    per_task = [r["count"] for r in perf.groupBy(F.spark_partition_id().alias("p"), "loan_id").count().groupBy("p").count().collect()]
    assert len(per_task) > 8 and max(per_task) < 10


@pytest.mark.parametrize("build", [
    JOINS["staging"],
    lambda d: joins.latest_on_or_before(d("loan_id as_of_date"), d("loan_id pd_date rating"), "loan_id", "as_of_date", "pd_date", ["rating"])])
def test_windows_over_loans_keep_their_partitions(spark, partitions, build):
    partitions(16)
    rows = build(lambda columns: looks_small(spark, columns, 60))
    tasks = [r["_task"] for r in rows.withColumn("_task", F.spark_partition_id()).collect()]
    assert len(tasks) == 60 and len(set(tasks)) > 8


def test_partitions_follow_the_orders(spark, partitions, tmp_path, monkeypatch):
    root = tables(spark, tmp_path, 40)
    partitions(2)
    store.stages_for(spark, root)
    assert partitions() == 2
    monkeypatch.setattr(store, "ORDERS_PER_PARTITION", 10)
    store.stages_for(spark, root)
    assert partitions() == 12
    partitions(20)
    store.stages_for(spark, root)
    assert partitions() == 20


def test_generated_methods_stay_compilable(spark, tmp_path):
    root, key = tables(spark, tmp_path, 4), "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    store.stages_for(spark, root)
    assert int(spark.conf.get(key)) <= 8000
    spark.conf.set(key, "3000")  # someone's own limit stays
    store.stages_for(spark, root)
    assert spark.conf.get(key) == "3000"
    spark.conf.unset(key)


def test_loan_files_are_met_in_their_order(spark, tmp_path):
    t = store.Stages(spark, tables(spark, tmp_path, 40))
    with store.loan_co_location(spark):
        both = joins.loan_join(t("targets").select("loan_id", "as_of_date", "default_flag"), t("mart"), ["loan_id", "as_of_date"])
        plan = plan_of(mart.analytical(both.drop("default_flag"), t("static")))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    got = t("mart").groupBy("loan_id").count().collect()
    assert len(got) == 40 and both.count() == sum(r["count"] for r in got)
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


def test_future_events_are_read_once(spark):
    columns = ("event_default", "event_prepayment_or_exit", "event_type")
    rows = [(1, True, False, "DEFAULT"), (2, False, True, "Prepaid or Matured"), (3, False, False, "CENSORED")]
    tg = spark.createDataFrame(rows, f"loan_id long, {columns[0]} boolean, {columns[1]} boolean, {columns[2]} string").withColumns(
        {"eligible_for_lifetime_pd": F.lit(True), "as_of_date": F.lit(date(2000, 1, 1)), "first_default_date": F.lit(None).cast("date"),
         "future_first_non_default_exit_date": F.lit(None).cast("date"), "future_first_non_default_exit_reason": F.lit(None).cast("string"),
         "months_to_default_from_observation": F.lit(None).cast("long")})
    for exits, want in ((True, {1, 2}), (False, {1})):
        out = ead.chosen_targets(tg, replace(EAD(), include_exits=exits))
        assert {r["loan_id"] for r in out.collect()} == want and "Union" not in plan_of(out)


def test_attributes_belong_to_the_vintage(spark):
    rows = spark.createDataFrame([(1, 2000, "a"), (1, 2001, "b"), (2, None, "c"), (None, 2000, "d"), (3, 2000, "e")], "loan_id long, vintage_year long, x string")
    own = spark.createDataFrame([(1, 2000, "A"), (1, 2001, "B"), (2, 2000, "C"), (None, 2000, "D"), (3, 2000, "E"), (3, 2000, "F")],
                                "loan_id long, vintage_year long, y string")
    out = joins.with_attributes(rows, own)
    assert out.columns == ["loan_id", "vintage_year", "x", "y"] and "vintage_year ASC" not in plan_of(out)
    assert sorted((r["x"], r["y"] or "-") for r in out.collect()) == [("a", "A"), ("b", "B"), ("c", "-"), ("d", "-"), ("e", "E"), ("e", "F")]


def test_staging_sorts_its_rows_once(spark):
    base = JOINS["staging"](lambda columns: looks_small(spark, columns, 60))
    assert "vintage_year ASC" not in plan_of(base)
    staged = plan_of(staging.cure_probation(base.withColumns({"sicr_raw_flag": F.col("loan_id") > 5, "stage3_flag": F.col("active_default_state")}), Staging()))
    assert staged.split("Union", 1)[0].count("Sort [loan_id") == 1


def test_availability_lays_out_the_rows_once(spark, tmp_path):
    out = REGISTRY["dq06_availability_sketched"].run(spark, tables(spark, tmp_path, 40))
    assert "Expand" not in plan_of(out)  # the values are stored; both levels start from them
    rows = out.collect()
    assert {r["year"] for r in rows} == {1995, None} and all(r["distinct_within_bound"] for r in rows)
    empty = [r for r in rows if r["non_null_count"] == 0]
    assert empty and len(rows) == len({(r["dataset"], r["year"], r["field"]) for r in rows})


def test_empty_fields_are_not_parsed(spark):
    lay = schemas.Layout("t", "v1", (("a", "double"), ("b", "long"), ("c", "string")))
    rows = [("", "", ""), (" 7 ", "7", "7"), ("n/a", " ", "x"), (None, None, None)]
    stored = spark.createDataFrame(rows, "a string, b string, c string").repartition(1)  # not evaluated while planning
    typed = text.safe_types(stored, lay)
    assert {tuple(r) for r in typed.collect()} == {(None, None, ""), (7.0, 7, "7"), (None, None, "x"), (None, None, None)}
    assert plan_of(typed).count("null else try_cast") >= 2
