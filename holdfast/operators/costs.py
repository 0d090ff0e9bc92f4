"""Training costs: cost of a run, a window of recent runs, and monthly scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import CostSettings
from holdfast.functions.scalars import number_column, round_even


def with_run_cost(runs: DataFrame, duration: str = "training_duration_seconds", s: CostSettings = CostSettings()) -> DataFrame:
    """Estimated cost of each run from its duration and the hourly rate."""
    hours = F.col(duration) / 3600.0
    cost = hours * s.estimated_hourly_rate if s.enabled else F.lit(0.0)
    return runs.withColumns(
        {
            duration: round_even(F.col(duration), 3),
            "estimated_training_cost": round_even(cost, 6),
            "cost_currency": F.lit(s.currency),
        }
    )


def cost_window(
    runs: DataFrame,
    as_of: Column,
    window_days: int = 7,
    start: str = "start_time",
    cost: str = "estimated_training_cost",
    duration: str = "training_duration_seconds",
    currency: str = "cost_currency",
    s: CostSettings = CostSettings(),
) -> DataFrame:
    """Runs, totals and averages of the last ``window_days``. No runs give a row of zeros."""
    recent = runs.where(F.col(start) >= as_of - F.expr(f"INTERVAL {int(window_days)} DAYS"))
    spent = F.coalesce(number_column(runs, cost), F.lit(0.0)) if cost in runs.columns else F.lit(0.0)
    took = F.coalesce(number_column(runs, duration), F.lit(0.0)) if duration in runs.columns else F.lit(0.0)
    newest = (
        F.max_by(F.col(currency), F.when(F.col(currency).isNotNull(), F.col(start))) if currency in runs.columns else F.lit(None).cast("string")
    )
    n = F.count("*")
    total_cost, total_time = F.coalesce(F.sum(spent), F.lit(0.0)), F.coalesce(F.sum(took), F.lit(0.0))
    return recent.agg(
        F.lit(int(window_days)).alias("window_days"),
        n.alias("run_count"),
        round_even(total_cost, 6).alias("total_training_cost"),
        round_even(total_time, 3).alias("total_training_duration_seconds"),
        round_even(F.coalesce(F.try_divide(total_cost, n), F.lit(0.0)), 6).alias("avg_training_cost"),
        round_even(F.coalesce(F.try_divide(total_time, n), F.lit(0.0)), 3).alias("avg_training_duration_seconds"),
        F.coalesce(newest, F.lit(s.currency)).alias("currency"),
    )


def monthly_scenarios(window: DataFrame, s: CostSettings = CostSettings()) -> DataFrame:
    """(scenario, runs_per_month, estimated_monthly_cost) from the window's average cost."""
    plans = (("daily_retraining", s.daily_runs), ("weekly_retraining", s.weekly_runs), ("drift_triggered_retraining", s.drift_runs))
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(runs).alias("runs_per_month"),
                round_even(F.col("avg_training_cost") * runs, 6).alias("estimated_monthly_cost"),
            )
            for name, runs in plans
        ]
    )
    return window.select(F.explode(table).alias("r")).select("r.*")


def cost_band(window: DataFrame, s: CostSettings = CostSettings()) -> DataFrame:
    """How heavy daily retraining would be: none, low (below 1 a month), moderate (below 20) or material."""
    monthly = round_even(F.col("avg_training_cost") * s.daily_runs, 6)
    band = (
        F.when(F.col("run_count") == 0, "none").when(monthly < 1, "low").when(monthly < 20, "moderate").otherwise("material")
    )
    advice = (
        F.when(band == "none", "No recent training runs, so there is no cost estimate.")
        .when(band == "low", "Training is cheap; daily retraining is affordable.")
        .when(band == "moderate", "Daily retraining is affordable; weekly or event-based retraining saves money.")
        .otherwise("Training costs matter; tie retraining to business impact and monitoring.")
    )
    return window.withColumns({"cost_band": band, "interpretation": advice})
