"""Registry of mart fields: when each is known, what it may be used for, and its leakage class."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom.functions.exprs import tagged_rows

SAFE = ("SAFE_ORIGINATION", "SAFE_AS_OF_DATE")


@dataclass(frozen=True)
class Feature:
    name: str
    availability: str
    uses: tuple[str, ...]
    leakage: str


# Field, availability, allowed uses, leakage class.
REGISTRY: tuple[Feature, ...] = tuple(Feature(n, a, tuple(u.split()), k) for n, a, u, k in (
    ("original_credit_score", "ORIGINATION", "application_scoring pd reporting", "SAFE_ORIGINATION"),
    ("original_dti", "ORIGINATION", "application_scoring pd reporting", "SAFE_ORIGINATION"),
    ("original_ltv", "ORIGINATION", "application_scoring pd lgd_predictor reporting", "SAFE_ORIGINATION"),
    ("original_cltv", "ORIGINATION", "application_scoring pd lgd_predictor reporting", "SAFE_ORIGINATION"),
    ("original_upb", "ORIGINATION", "application_scoring pd ead reporting", "SAFE_ORIGINATION"),
    ("original_interest_rate", "ORIGINATION", "application_scoring pd ead reporting", "SAFE_ORIGINATION"),
    ("current_actual_upb", "CURRENT_PERIOD", "behavioural_scoring pd ead reporting", "SAFE_AS_OF_DATE"),
    ("delinquency_months", "CURRENT_PERIOD", "behavioural_scoring pd sicr reporting", "SAFE_AS_OF_DATE"),
    ("max_delinquency_months_to_date", "HISTORICAL_TO_DATE", "behavioural_scoring pd sicr reporting", "SAFE_AS_OF_DATE"),
    ("months_since_last_delinquency", "HISTORICAL_TO_DATE", "behavioural_scoring pd sicr reporting", "SAFE_AS_OF_DATE"),
    ("current_upb_to_original_upb", "CURRENT_PERIOD", "behavioural_scoring pd ead reporting", "SAFE_AS_OF_DATE"),
    ("actual_loss", "TERMINAL_EVENT", "lgd_outcome reporting", "OUTCOME_RESTRICTED"),
    ("net_sale_proceeds", "TERMINAL_EVENT", "lgd_outcome reporting", "OUTCOME_RESTRICTED"),
    ("total_expenses", "TERMINAL_EVENT", "lgd_outcome reporting", "OUTCOME_RESTRICTED"),
    ("_gold_processed_at", "TECHNICAL", "reporting", "TECHNICAL_ONLY"),
))


def features_for(use: str, *, include_restricted: bool = False) -> list[str]:
    return [f.name for f in REGISTRY if use in f.uses and (include_restricted or f.leakage in SAFE)]


def features_by_availability(availability: str) -> list[str]:
    return [f.name for f in REGISTRY if f.availability == availability]


def counts_by(attribute: str) -> dict[str, int]:
    return dict(Counter(getattr(f, attribute) for f in REGISTRY))


def availability_summary(view: DataFrame) -> DataFrame:
    """Per availability the registered fields and how often they are filled in the analytical view, one aggregate for all."""
    known = counts_by("availability")
    filled = {a: [n for n in features_by_availability(a) if n in view.columns] for a in known}
    counts = view.agg(*[F.count(n).alias(n) for names in filled.values() for n in names])
    rows = [[F.lit(a), F.lit(known[a]), sum((F.col(n) for n in names), F.lit(0).cast("long"))] for a, names in filled.items()]
    return tagged_rows(counts, [], rows, ["availability", "n_features", "non_null_count"])


def usable_population(view: DataFrame, use: str) -> DataFrame:
    """How well each field allowed for a use is filled in the analytical view, one aggregate for all."""
    known = {f.name: f for f in REGISTRY}
    names = features_for(use)
    counts = view.agg(*[F.count(n).alias(n) for n in names])
    rows = [[F.lit(n), F.lit(known[n].availability), F.lit(known[n].leakage), F.col(n)] for n in names]
    return tagged_rows(counts, [], rows, ["feature", "availability", "leakage_risk", "non_null_count"])


def forbid_outcomes(predictors: list[str], outcomes: frozenset[str]) -> list[str]:
    """The predictors, or an error naming those only known after the outcome."""
    leaks = sorted(set(predictors) & outcomes)
    if leaks:
        raise ValueError(f"outcome fields are not allowed as predictors: {leaks}")
    return predictors
