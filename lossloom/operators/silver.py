"""Cleaning: sentinel taxonomy, dates and delinquency statuses. Narrow projections only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sentinels:
    """Codes that mean "no value" and what each means; before ``structural_before`` they mean the field did not exist."""

    codes: tuple[tuple[str, str], ...]
    structural_before: int | None = None


# Codes of the published layout per field.
RULES: dict[str, Sentinels] = {
    "credit_score": Sentinels((("9999", "NOT_AVAILABLE"),)),
    "vantagescore_4": Sentinels((("9999", "NOT_AVAILABLE"),), 2026),
    "original_debt_to_income_ratio": Sentinels((("999", "NOT_AVAILABLE"),)),
    "original_loan_to_value": Sentinels((("999", "NOT_AVAILABLE"),)),
    "original_combined_loan_to_value": Sentinels((("999", "NOT_AVAILABLE"),)),
    "property_valuation_method": Sentinels((("", "STRUCTURAL_NOT_AVAILABLE"), ("7", "NOT_AVAILABLE")), 2020),
    "estimated_loan_to_value": Sentinels((("999", "UNKNOWN"),), 2017),
    "net_sale_proceeds": Sentinels((("U", "UNKNOWN"), ("", "NOT_APPLICABLE"))),
    "mortgage_insurance_cancellation_indicator": Sentinels((("7", "NOT_APPLICABLE"), ("9", "NOT_DISCLOSED"))),
}
STATUSES = ("VALID_VALUE", "UNKNOWN", "NOT_APPLICABLE", "NOT_AVAILABLE", "NOT_DISCLOSED", "STRUCTURAL_NOT_AVAILABLE",
            "INVALID")
ORIGINATION_FIELDS = tuple(RULES)[:6]
PERFORMANCE_FIELDS = tuple(RULES)[6:]
DIGITS = r"^\d+$"


def status(field: str, year: str = "_source_year") -> Column:
    rule = RULES[field]
    text = F.col(field).cast("string")
    expr = F.when(F.col(field).isNull(), "NOT_APPLICABLE")
    for code, meaning in rule.codes:
        if rule.structural_before is not None:
            meaning_by_year = F.when(F.col(year) < rule.structural_before, "STRUCTURAL_NOT_AVAILABLE").otherwise(meaning)
            expr = expr.when(text == code, meaning_by_year)
        else:
            expr = expr.when(text == code, meaning)
    return expr.otherwise("VALID_VALUE")


def without_sentinels(field: str) -> Column:
    codes = [code for code, _ in RULES[field].codes]
    return F.when(~F.col(field).cast("string").isin(*codes), F.col(field))


def month_from_text(field: Column | str) -> Column:
    """YYYYMM text to the first of that month; anything else is null. A general date parser takes several times as long."""
    v = F.col(field) if isinstance(field, str) else field
    known = (F.length(v) == 6) & v.rlike("^[0-9]{4}(0[1-9]|1[0-2])$")
    return F.when(known, F.make_date(F.substring(v, 1, 4).try_cast("int"), F.substring(v, 5, 2).try_cast("int"), F.lit(1)))


def delinquency_months(field: str = "current_loan_delinquency_status") -> Column:
    return F.when(F.col(field).rlike(DIGITS), F.col(field).try_cast("bigint"))


def delinquency_type(field: str = "current_loan_delinquency_status") -> Column:
    v = F.col(field)
    return (F.when(v.rlike(DIGITS), "NUMERIC_DELINQUENCY_STATUS").when(v == "RA", "REO_ACQUISITION")
            .when(v == "XX", "INITIAL_OR_UNKNOWN_STATUS").when(v.isNull() | (v == ""), "MISSING_STATUS")
            .otherwise("UNKNOWN_SPECIAL_STATUS"))


def month_from_loan_id(field: str = "loan_id", century: str = "20") -> Column:
    """Origination quarter coded in the id (letter, two-digit year, Q, quarter) as its first month."""
    pattern = r"^[A-Z](\d{2})Q([1-4])"
    year, quarter = F.regexp_extract(field, pattern, 1), F.regexp_extract(field, pattern, 2)
    return F.when(year != "", F.make_date(F.concat(F.lit(century), year).try_cast("int"),
                                          quarter.try_cast("int") * 3 - 2, F.lit(1)))


def _clean(df: DataFrame, fields: tuple[str, ...], dates: tuple[str, ...], extra: dict[str, Column]) -> DataFrame:
    out = df.withColumns({f"{f}_status": status(f) for f in fields})
    return out.withColumns({f: without_sentinels(f) for f in fields} | {d: month_from_text(d) for d in dates} | extra)


def origination(bronze: DataFrame) -> DataFrame:
    return _clean(bronze, ORIGINATION_FIELDS, ("first_payment_date", "maturity_date"),
                  {"origination_month": month_from_loan_id()})


def performance(bronze: DataFrame) -> DataFrame:
    return _clean(bronze, PERFORMANCE_FIELDS,
                  ("period", "defect_settlement_date", "zero_balance_effective_date", "due_date_of_last_paid_installment"),
                  {"delinquency_months": delinquency_months(), "delinquency_status_type": delinquency_type()})
