"""Delimited text rendered from the demo panel, with the sentinels and faults a real delivery has.

The column expressions are plain SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom.sources.schemas import layout_for

TEXT_ID = ("concat('F', lpad(CAST(l.vintage_year % 100 AS STRING), 2, '0'), 'Q', "
           "CAST(quarter(l.origination_month) AS STRING), lpad(CAST(l.loan_id AS STRING), 7, '0'))")


def whole(x: str) -> str:
    return f"coalesce(CAST(CAST(floor({x}) AS BIGINT) AS STRING), '')"


def text(x: str) -> str:
    return f"coalesce(CAST({x} AS STRING), '')"


def yyyymm(d: str) -> str:
    return f"coalesce(CAST(year({d}) * 100 + month({d}) AS STRING), '')"


ORIGINATION = {
    "credit_score": f"CASE WHEN l.loan_id % 13 = 0 THEN '9999' ELSE {text('l.credit_score')} END",
    "first_payment_date": f"CASE WHEN l.loan_id % 47 = 0 THEN '199513' ELSE {yyyymm('l.first_payment_date')} END",
    "first_time_homebuyer_flag": text("l.first_time_homebuyer_flag"),
    "maturity_date": yyyymm("l.maturity_date"),
    "mortgage_insurance_percentage": text("l.mortgage_insurance_percentage"),
    "number_of_units": text("l.number_of_units"),
    "occupancy_status": text("l.occupancy_status"),
    "original_combined_loan_to_value": f"CASE WHEN l.loan_id % 19 = 0 THEN '999' ELSE {text('l.original_combined_loan_to_value')} END",
    "original_debt_to_income_ratio": f"CASE WHEN l.loan_id % 17 = 0 THEN '999' ELSE {text('l.original_debt_to_income_ratio')} END",
    "original_upb": f"CASE WHEN l.loan_id % 53 = 0 THEN 'n/a' ELSE {whole('l.original_upb')} END",
    "original_loan_to_value": text("l.original_loan_to_value"),
    "original_interest_rate": text("l.original_interest_rate"),
    "channel": text("l.channel"),
    "property_state": text("l.property_state"),
    "property_type": text("l.property_type"),
    "loan_id": TEXT_ID,
    "loan_purpose": text("l.loan_purpose"),
    "original_loan_term": text("l.original_loan_term"),
    "number_of_borrowers": text("l.number_of_borrowers"),
    "seller_name": "concat('Seller ', CAST(l.loan_id % 9 AS STRING))",
    "property_valuation_method": "CASE l.loan_id % 3 WHEN 0 THEN '' WHEN 1 THEN '7' ELSE '2' END",
    "vantagescore_4": "CASE WHEN l.loan_id % 2 = 0 THEN '9999' ELSE '' END",
}
PERFORMANCE = {
    "loan_id": TEXT_ID,
    "period": yyyymm("p.period"),
    "current_actual_upb": f"CASE WHEN l.loan_id % 23 = 0 THEN 'n/a' ELSE {whole('p.current_actual_upb')} END",
    "current_loan_delinquency_status": "CASE WHEN l.loan_id % 37 = 0 AND month(p.period) = 1 THEN '' "
    "WHEN l.loan_id % 41 = 0 AND month(p.period) = 2 THEN 'Q9' ELSE p.current_loan_delinquency_status END",
    "loan_age": text("p.loan_age"),
    "remaining_months_to_legal_maturity": text("p.remaining_months_to_legal_maturity"),
    "modification_flag": text("p.modification_flag"),
    "zero_balance_code": text("p.zero_balance_code"),
    "zero_balance_effective_date": yyyymm("p.zero_balance_effective_date"),
    "current_interest_rate": text("p.current_interest_rate"),
    "due_date_of_last_paid_installment": f"CASE WHEN l.loan_id % 43 = 0 THEN '199913' ELSE {yyyymm('p.due_date_of_last_paid_installment')} END",
    "net_sale_proceeds": "CASE WHEN p.net_sale_proceeds IS NOT NULL AND l.loan_id % 5 = 0 THEN 'U' "
    f"ELSE {whole('CAST(p.net_sale_proceeds AS DOUBLE)')} END",
    "actual_loss": whole("p.actual_loss"),
    "payment_deferral_flag": text("p.payment_deferral_flag"),
    "estimated_loan_to_value": "coalesce(CAST(p.estimated_loan_to_value AS STRING), '999')",
    "zero_balance_removal_upb": whole("p.zero_balance_removal_upb"),
    "borrower_assistance_status_code": text("p.borrower_assistance_status_code"),
    "current_interest_bearing_upb": whole("p.current_interest_bearing_upb"),
    "mortgage_insurance_cancellation_indicator": "CASE l.loan_id % 4 WHEN 0 THEN '7' WHEN 1 THEN '9' WHEN 2 THEN '' ELSE 'N' END",
    "servicer_name": "CASE WHEN l.loan_id % 29 = 0 AND p.zero_balance_code IS NOT NULL THEN 'Bank|Branch' ELSE 'Bank' END",
}


#: Loans delivered with performance; the others are originations alone.
HAS_PERFORMANCE = "l.loan_id % 59 <> 0"


def line_sql(dataset: str) -> str:
    exprs = ORIGINATION if dataset == "origination" else PERFORMANCE
    names = layout_for(dataset, 1995).names
    return "concat_ws('|', " + ", ".join(exprs.get(n, "''") for n in names) + ")"


def origination_lines(loans: DataFrame) -> DataFrame:
    return loans.alias("l").select(F.expr(line_sql("origination")).alias("value"), "l.vintage_year")


def performance_lines(perf: DataFrame, loans: DataFrame) -> DataFrame:
    return (perf.alias("p").join(loans.alias("l"), F.col("p.loan_id") == F.col("l.loan_id")).where(HAS_PERFORMANCE)
            .select(F.expr(line_sql("performance")).alias("value"), "l.vintage_year"))
