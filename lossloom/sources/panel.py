"""Demo loan panel derived from the customer, nation and orders tables.

A customer is a loan, the months between its first and last order are its reporting life, and months without an order
are missed payments. The result has the column layout of cleaned (Silver) origination and performance tables, so that
everything downstream is the same code that would run on real loan data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lossloom.functions.exprs import month_date, month_index
from lossloom.functions.joins import loan_join

GRACE_MONTHS = 9  # months without an order before a payment counts as missed
TERM_MONTHS = 360

# Last-row exit code by customer key class; class 6 stays open.
EXIT_CODES = ("09", "03", "02", "01", "01", "15")


def active_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order months per customer with the customer's first and last month and the neighbouring order months."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pending = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    months = (orders.where(F.col("o_custkey").isNotNull() & F.col("o_orderdate").isNotNull())
              .groupBy(F.col("o_custkey").alias("loan_id"), month_index("o_orderdate").alias("mi"))
              .agg(F.max(pending).alias("pend")))
    # Order months are narrow and few, the rows made of them are not: a shuffle sized by their bytes would put the panel into one task.
    months = months.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "loan_id")
    w = Window.partitionBy("loan_id").orderBy("mi")
    life = Window.partitionBy("loan_id")
    return months.select(
        "loan_id", "mi", "pend",
        F.lead("mi").over(w).alias("next_mi"),
        F.coalesce((F.lag("mi").over(w) == F.col("mi") - 1) & F.lag("pend").over(w), F.lit(False)).alias("prev_pend"),
        F.min("mi").over(life).alias("m0"), F.max("mi").over(life).alias("m1"))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned origination rows: one per customer that ever ordered."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    span = (orders.where(F.col("o_custkey").isNotNull() & F.col("o_orderdate").isNotNull())
            .groupBy(F.col("o_custkey").alias("loan_id"))
            .agg(F.min(month_index("o_orderdate")).alias("m0")))
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_custkey", "loan_id")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("loan_id")
    ltv = 50 + (k * 17) % 50
    return (loan_join(span, cust, ["loan_id"]).join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        "loan_id",
        F.floor((F.col("m0") - 1) / 12).cast("long").alias("vintage_year"),
        month_date("m0").alias("origination_month"),
        month_date(F.col("m0") + 1).alias("first_payment_date"),
        month_date(F.col("m0") + TERM_MONTHS).alias("maturity_date"),
        (620 + (k * 37) % 200).alias("credit_score"),
        F.lit(None).cast("long").alias("vantagescore_4"),
        F.when(k % 3 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("first_time_homebuyer_flag"),
        (15 + (k * 13) % 40).alias("original_debt_to_income_ratio"),
        ltv.alias("original_loan_to_value"),
        (ltv + (k % 4) * 5).alias("original_combined_loan_to_value"),
        F.floor(100000 + F.col("c_acctbal") * 10).cast("double").alias("original_upb"),
        (F.lit(3.0) + (k % 40) / F.lit(10.0)).alias("original_interest_rate"),
        F.lit(TERM_MONTHS).cast("long").alias("original_loan_term"),
        (1 + k % 2).alias("number_of_borrowers"),
        F.lit(1).cast("long").alias("number_of_units"),
        F.when(k % 10 == 0, F.lit("I")).otherwise(F.lit("P")).alias("occupancy_status"),
        F.when(k % 5 == 0, F.lit("CO")).otherwise(F.lit("SF")).alias("property_type"),
        F.when(k % 2 == 0, F.lit("P")).otherwise(F.lit("N")).alias("loan_purpose"),
        F.col("c_mktsegment").alias("channel"),
        F.when(ltv > 80, F.lit(25)).otherwise(F.lit(0)).cast("long").alias("mortgage_insurance_percentage"),
        F.col("n_name").alias("property_state"),
    ))


def performance(spark: SparkSession, sf_dir: str, loans: DataFrame) -> DataFrame:
    """Cleaned monthly performance rows.

    Each order month is expanded to the months up to the next order, so the last payment month needs no join. The month
    after a pending urgent order goes unreported (a reporting gap), except the closing month.
    """
    act = active_months(spark, sf_dir)
    spine = act.withColumn("m", F.explode(F.sequence("mi", F.coalesce(F.col("next_mi"), F.col("mi") + 1) - 1)))
    unreported = F.when(F.col("m") == F.col("mi"), F.col("prev_pend")).otherwise(
        (F.col("m") == F.col("mi") + 1) & F.col("pend"))
    spine = spine.where(~unreported | (F.col("m") == F.col("m1")))
    # A merge keeps the rows where they were dealt; a broadcast of either side need not.
    base = loan_join(spine, loans.select("loan_id", "original_upb", "original_interest_rate", "original_loan_to_value"), ["loan_id"])
    k, m = F.col("loan_id"), F.col("m")
    missed = F.greatest(F.lit(0), m - F.col("mi") - GRACE_MONTHS)
    raw = F.when(m == F.col("m0"), "XX").when(missed >= 20, "RA").otherwise(missed.cast("string"))
    code = F.lit(None).cast("string")
    for i, v in enumerate(EXIT_CODES):
        code = F.when(k % 7 == i, F.lit(v)).otherwise(code)

    def scheduled(at):
        """Whole-currency balance after linear repayment."""
        return F.floor(F.col("original_upb") * (F.lit(1.0) - (at - F.col("m0")) / F.lit(360.0))).cast("double")

    def part(share):
        return F.when(loss_exit, F.floor(F.col("prior") * F.lit(share)).cast("double"))

    w = Window.partitionBy("loan_id").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    df = base.select(
        "loan_id", "m", "m0", "m1", "mi", "original_interest_rate", "original_upb", "original_loan_to_value",
        raw.alias("raw"), missed.cast("long").alias("missed"),
        F.when(m == F.col("m1"), code).alias("zb"),
        scheduled(m).alias("sched"), scheduled(m - 1).alias("prior"))
    modified = F.when((F.col("missed") == 6) & (F.col("raw") == "6"), F.lit("Y"))
    loss_exit = F.col("zb").isin("02", "03", "09")
    df = df.withColumn("modification_flag", modified).withColumn(
        "was_modified", F.max(F.when(F.col("modification_flag") == "Y", 1).otherwise(0)).over(w) > 0)
    upb = F.when(F.col("zb").isNotNull(), F.lit(0.0)).otherwise(F.col("sched"))
    return df.select(
        "loan_id",
        F.floor((F.col("m0") - 1) / 12).cast("long").alias("vintage_year"),
        month_date("m").alias("period"),
        F.col("m").cast("long").alias("month_index"),
        (F.col("m") - F.col("m0")).cast("long").alias("loan_age"),
        (F.col("m0") + TERM_MONTHS - F.col("m")).cast("long").alias("remaining_months_to_legal_maturity"),
        upb.alias("current_actual_upb"),
        (F.col("original_interest_rate") - F.when(F.col("was_modified"), 0.5).otherwise(0.0)).alias("current_interest_rate"),
        F.when(F.col("raw").rlike(r"^\d+$"), F.col("missed")).alias("delinquency_months"),
        F.col("raw").alias("current_loan_delinquency_status"),
        F.when(F.col("raw").rlike(r"^\d+$"), "NUMERIC_DELINQUENCY_STATUS").when(F.col("raw") == "RA", "REO_ACQUISITION")
        .otherwise("INITIAL_OR_UNKNOWN_STATUS").alias("delinquency_status_type"),
        "modification_flag",
        F.when(F.col("raw") == "4", F.lit("Y")).alias("payment_deferral_flag"),
        F.when((F.col("raw") == "8") & (k % 2 == 0), F.lit("F")).alias("borrower_assistance_status_code"),
        F.lit(None).cast("string").alias("delinquency_due_to_disaster"),
        F.lit(0.0).alias("current_non_interest_bearing_upb"),
        upb.alias("current_interest_bearing_upb"),
        F.col("zb").alias("zero_balance_code"),
        F.when(F.col("zb").isNotNull(), month_date("m")).alias("zero_balance_effective_date"),
        F.lit(None).cast("date").alias("defect_settlement_date"),
        month_date("mi").alias("due_date_of_last_paid_installment"),
        F.when(loss_exit, -(k % 3) * F.lit(1000.0) + F.lit(0.0)).alias("mi_recoveries"),
        F.when(loss_exit, (-F.floor(F.col("prior") * F.lit(0.6))).cast("string")).alias("net_sale_proceeds"),
        F.when(loss_exit, F.lit(0.0)).alias("non_mi_recoveries"),
        part(0.05).alias("total_expenses"),
        part(0.01).alias("legal_costs"),
        part(0.02).alias("maintenance_and_preservation_costs"),
        part(0.015).alias("taxes_and_insurance"),
        part(0.005).alias("miscellaneous_expenses"),
        part(0.4).alias("actual_loss"),
        F.when(F.col("was_modified"), F.lit(500.0)).alias("cumulative_modification_costs"),
        F.when(F.col("modification_flag") == "Y", F.lit(500.0)).alias("current_period_modification_costs"),
        F.lit(None).cast("double").alias("bankruptcy_cramdown_costs"),
        F.when(k % 11 != 0, F.round(F.col("original_loan_to_value") * F.col("sched") / F.col("original_upb"))
               .cast("long")).alias("estimated_loan_to_value"),
        F.lit(None).cast("string").alias("mortgage_insurance_cancellation_indicator"),
        F.lit(None).cast("string").alias("servicer_name"),
        F.when(F.col("zb").isNotNull(), F.col("prior")).alias("zero_balance_removal_upb"),
        part(0.03).alias("delinquent_accrued_interest"),
    )
