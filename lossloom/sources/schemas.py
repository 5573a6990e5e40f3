"""Column layouts of the delimited source files, by dataset and vintage year."""

from __future__ import annotations

from dataclasses import dataclass

# Column names and types in file order.
ORIGINATION_V1 = (
    ("credit_score", "bigint"),
    ("first_payment_date", "string"),
    ("first_time_homebuyer_flag", "string"),
    ("maturity_date", "string"),
    ("metropolitan_statistical_area", "string"),
    ("mortgage_insurance_percentage", "bigint"),
    ("number_of_units", "bigint"),
    ("occupancy_status", "string"),
    ("original_combined_loan_to_value", "bigint"),
    ("original_debt_to_income_ratio", "bigint"),
    ("original_upb", "double"),
    ("original_loan_to_value", "bigint"),
    ("original_interest_rate", "double"),
    ("channel", "string"),
    ("prepayment_penalty_mortgage_flag", "string"),
    ("amortization_type", "string"),
    ("property_state", "string"),
    ("property_type", "string"),
    ("postal_code", "string"),
    ("loan_id", "string"),
    ("loan_purpose", "string"),
    ("original_loan_term", "bigint"),
    ("number_of_borrowers", "bigint"),
    ("seller_name", "string"),
    ("super_conforming_flag", "string"),
    ("pre_harp_loan_id", "string"),
    ("special_eligibility_program", "string"),
    ("harp_indicator", "string"),
    ("property_valuation_method", "string"),
    ("interest_only_indicator", "string"),
    ("vantagescore_4", "bigint"),
)
PERFORMANCE_V1 = (
    ("loan_id", "string"),
    ("period", "string"),
    ("current_actual_upb", "double"),
    ("current_loan_delinquency_status", "string"),
    ("loan_age", "bigint"),
    ("remaining_months_to_legal_maturity", "bigint"),
    ("defect_settlement_date", "string"),
    ("modification_flag", "string"),
    ("zero_balance_code", "string"),
    ("zero_balance_effective_date", "string"),
    ("current_interest_rate", "double"),
    ("current_non_interest_bearing_upb", "double"),
    ("due_date_of_last_paid_installment", "string"),
    ("mi_recoveries", "double"),
    ("net_sale_proceeds", "string"),
    ("non_mi_recoveries", "double"),
    ("total_expenses", "double"),
    ("legal_costs", "double"),
    ("maintenance_and_preservation_costs", "double"),
    ("taxes_and_insurance", "double"),
    ("miscellaneous_expenses", "double"),
    ("actual_loss", "double"),
    ("cumulative_modification_costs", "double"),
    ("interest_rate_step_indicator", "string"),
    ("payment_deferral_flag", "string"),
    ("estimated_loan_to_value", "bigint"),
    ("zero_balance_removal_upb", "double"),
    ("delinquent_accrued_interest", "double"),
    ("delinquency_due_to_disaster", "string"),
    ("borrower_assistance_status_code", "string"),
    ("current_period_modification_costs", "double"),
    ("current_interest_bearing_upb", "double"),
    ("mortgage_insurance_cancellation_indicator", "string"),
    ("servicer_name", "string"),
    ("bankruptcy_cramdown_costs", "double"),
)


@dataclass(frozen=True)
class Layout:
    dataset: str
    version: str
    columns: tuple[tuple[str, str], ...]
    delimiter: str = "|"

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]


def layout(dataset: str, version: str, columns: tuple[tuple[str, str], ...]) -> Layout:
    if len({n for n, _ in columns}) != len(columns):
        raise ValueError(f"{dataset} {version}: column names repeat")
    return Layout(dataset, version, columns)


@dataclass(frozen=True)
class LayoutPeriod:
    first_year: int
    last_year: int
    layout: Layout


# The demo panel covers 1995-2001; the published layout starts in 2012.
PERIODS = tuple(
    LayoutPeriod(a, b, layout(name, "v1", columns))
    for name, columns in (("origination", ORIGINATION_V1), ("performance", PERFORMANCE_V1))
    for a, b in ((1995, 2001), (2012, 2026)))


def layout_for(dataset: str, year: int, periods: tuple[LayoutPeriod, ...] = PERIODS) -> Layout:
    for p in periods:
        if p.layout.dataset == dataset and p.first_year <= year <= p.last_year:
            return p.layout
    raise ValueError(f"no {dataset} layout is registered for {year}")
