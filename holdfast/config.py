"""Settings of the operators. Every default is a fixed value the results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DecisionSettings:
    """Economics of one retention action and the limits on discounts."""

    customer_value: float = 100.0
    cost_discount: float = 10.0
    cost_contact: float = 2.0
    discount_uplift: float = 0.3
    contact_uplift: float = 0.1
    max_discount_budget: float | None = 10.0
    max_discount_rate: float | None = 0.2
    min_expected_profit: float = 0.0


@dataclass(frozen=True)
class DriftSettings:
    enabled: bool = True
    min_samples: int = 50
    p_value_threshold: float = 0.01
    stat_threshold: float = 0.10
    #: The KS p-value is exact while both sample sizes multiply to no more than this, and the large-sample series beyond.
    exact_cells: int = 1_000_000


@dataclass(frozen=True)
class RetrainThresholds:
    min_samples: int = 20
    min_f1: float = 0.60
    min_recall: float = 0.65
    min_roc_auc: float = 0.75
    max_brier_score: float = 0.22


@dataclass(frozen=True)
class CostSettings:
    enabled: bool = True
    currency: str = "EUR"
    estimated_hourly_rate: float = 0.35
    daily_runs: int = 30
    weekly_runs: int = 4
    drift_runs: int = 8


@dataclass(frozen=True)
class LabelSettings:
    min_delay_days: int = 30
    max_delay_days: int = 60


# Feature configuration of the churn model.
NUMERIC_FEATURES = ("tenure", "monthlycharges", "totalcharges")
CATEGORICAL_FEATURES = (
    "gender",
    "seniorcitizen",
    "partner",
    "dependents",
    "phoneservice",
    "multiplelines",
    "internetservice",
    "onlinesecurity",
    "onlinebackup",
    "deviceprotection",
    "techsupport",
    "streamingtv",
    "streamingmovies",
    "contract",
    "paperlessbilling",
    "paymentmethod",
)
CONFIGURED_STEPS = ("clean_names", "cast_numeric_types", "encode_categoricals", "drop_configured", "cast_ohe_to_bool")
DEFAULT_STEPS = ("cast_numeric_types", "encode_categoricals", "drop_configured", "clean_names")


@dataclass(frozen=True)
class FeatureSettings:
    enabled_steps: tuple[str, ...] = CONFIGURED_STEPS
    cast_to_numeric: tuple[str, ...] = ("totalcharges",)
    numeric_columns: tuple[str, ...] = NUMERIC_FEATURES
    categorical_columns: tuple[str, ...] = CATEGORICAL_FEATURES
    drop_columns: tuple[str, ...] = ("customerid",)


@dataclass(frozen=True)
class ServingSettings:
    """Tracked and ignored paths, latency bounds in seconds, summary window."""

    track_paths: tuple[str, ...] = ("/predict", "/health")
    ignored_paths: tuple[str, ...] = ("/metrics", "/monitoring/summary", "/docs", "/openapi.json", "/redoc")
    latency_bounds: tuple[float, ...] = (0.005, 0.010, 0.025, 0.050, 0.100, 0.250, 0.500, 1.000, 3.000, 5.000)
    summary_window_seconds: int = 900


# Profit floors and uplift assumptions of the policy sweeps.
PROFIT_FLOORS = (0.0, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0, 15.0, 20.0, 25.0, 30.0)
DISCOUNT_UPLIFTS = (0.1, 0.2, 0.3, 0.4)
CONTACT_UPLIFTS = (0.05, 0.1, 0.15)


@dataclass(frozen=True)
class ModelSettings:
    kind: str = "gradient_boosting"
    n_estimators: int = 200
    max_depth: int = 3
    learning_rate: float = 0.05
    seed: int = 42
    extra: dict = field(default_factory=dict)
