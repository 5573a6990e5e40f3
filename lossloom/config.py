"""Typed settings for every operator; the defaults describe the bundled demo panel (see sources/panel.py)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

# Zero-balance codes of the monthly performance layout and their meaning.
DEFAULT_EXIT_REASONS: Mapping[str, str] = {
    "09": "REO_DISPOSITION",
    "03": "SHORT_SALE_OR_CHARGE_OFF",
    "02": "THIRD_PARTY_SALE",
}
NON_DEFAULT_EXITS: Mapping[str, str] = {
    "01": "Prepaid or Matured",
    "15": "Whole Loan Sale",
    "16": "Reperforming Loan Securitization",
    "96": "Defect prior to other termination event",
}


@dataclass(frozen=True)
class DefaultDefinition:
    reporting_cutoff: date = date(2001, 8, 1)
    delinquency_threshold_months: int = 3
    target_horizon_months: int = 12
    probation_months: int = 3
    # "reference": the default row itself counts as the first month of the clean run; "strict": it does not.
    cure_counting: str = "reference"
    credit_event_statuses: tuple[str, ...] = ("RA",)
    default_exits: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_EXIT_REASONS))
    other_exits: Mapping[str, str] = field(default_factory=lambda: dict(NON_DEFAULT_EXITS))


@dataclass(frozen=True)
class Windows:
    """Inclusive split windows, in time order."""

    train: tuple[date, date] = (date(1995, 1, 1), date(1997, 12, 1))
    validation: tuple[date, date] = (date(1998, 1, 1), date(1998, 12, 1))
    oot: tuple[date, date] = (date(1999, 1, 1), date(2000, 8, 1))

    def __post_init__(self) -> None:
        spans = [self.train, self.validation, self.oot]
        if any(a > b for a, b in spans) or any(x[1] >= y[0] for x, y in zip(spans, spans[1:])):
            raise ValueError("split windows must be ordered and must not overlap")

    def named(self) -> list[tuple[str, date, date]]:
        return [("TRAIN", *self.train), ("VALIDATION", *self.validation), ("OOT", *self.oot)]


@dataclass(frozen=True)
class Development:
    windows: Windows = field(default_factory=Windows)
    full_horizon_cutoff: date = date(2000, 8, 1)
    population: str = "behavioural"  # or "application"
    snapshot: str = "quarter_end"  # or "monthly", "year_end"
    loan_disjoint: bool = False
    sampling: str = "none"  # or "random_nondefault", "stratified_nondefault"
    seed: int = 20260927
    nondefault_fraction: float = 1.0
    min_nondefaults_per_stratum: int = 0


@dataclass(frozen=True)
class Scorecard:
    max_bins: int = 10
    min_bin_pct: float = 0.02
    monotonic: bool = True
    rare_category_pct: float = 0.01
    smoothing: float = 0.5
    suspicious_iv: float = 0.5
    base_score: float = 600.0
    pdo: float = 50.0
    base_odds: float = 20.0
    bands: int = 10


@dataclass(frozen=True)
class PDFramework:
    calibration: str = "logistic"  # or "none", "isotonic"
    grades: int = 5
    anchor: tuple[date, date] = (date(1995, 1, 1), date(1997, 12, 1))
    max_months: int = 360
    hazard_smoothing: float = 0.5


@dataclass(frozen=True)
class Staging:
    relative_pd_increase: float | None = 2.0
    absolute_pd_increase: float | None = None
    downgrade_notches: int | None = 3
    dpd_backstop_months: int | None = 1
    other_deterioration: bool = False
    include_modification: bool = True
    include_assistance: bool = True
    low_risk_max_rating: str | None = None
    probation_months: int = 3
    # "CURE_PROBATION" labels rows held in stage 2 only by probation; None keeps "NO_SICR" for them.
    probation_reason: str | None = None
    grid_relative: tuple[float, ...] = (1.5, 2.0, 3.0)
    grid_notches: tuple[int, ...] = (2, 3, 4)
    grid_dpd: tuple[int, ...] = (1, 2)


@dataclass(frozen=True)
class LGD:
    horizon_months: int = 60
    train_end: date = date(1997, 12, 1)
    validation_end: date = date(1998, 12, 1)
    oot_end: date = date(2000, 8, 1)
    fallback_rate: float | None = None
    cure_fallback_lgd: float = 0.0
    lower: float = 0.0
    upper: float = 1.5
    downturn_method: str = "historical_stress"  # or "quantile", "none"
    downturn_window: tuple[date, date] = (date(1998, 1, 1), date(1998, 12, 1))
    downturn_quantile: float = 0.75


@dataclass(frozen=True)
class EAD:
    train_end: date = date(1997, 12, 1)
    validation_end: date = date(1998, 12, 1)
    oot_end: date = date(2000, 8, 1)
    include_exits: bool = True
    lower: float = 0.0
    upper: float = 2.0
    max_months: int = 360
    mape_floor: float = 1000.0


@dataclass(frozen=True)
class ECL:
    reporting_date: date = date(2000, 8, 1)
    lgd_method: str = "base"  # or "downturn"
    stage1_months: int = 12
    max_months: int = 360


@dataclass(frozen=True)
class Settings:
    default: DefaultDefinition = field(default_factory=DefaultDefinition)
    development: Development = field(default_factory=lambda: Development(snapshot="monthly"))
    scorecard: Scorecard = field(default_factory=Scorecard)
    pd: PDFramework = field(default_factory=PDFramework)
    staging: Staging = field(default_factory=Staging)
    lgd: LGD = field(default_factory=LGD)
    ead: EAD = field(default_factory=EAD)
    ecl: ECL = field(default_factory=ECL)
