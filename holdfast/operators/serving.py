"""Request statistics. The same functions serve batch tables and streams, except where noted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.config import ServingSettings
from holdfast.functions.scalars import is_success, round_even, tracked_path

PERCENTILES = (0.5, 0.95, 0.99)


def tracked_requests(events: DataFrame, s: ServingSettings = ServingSettings()) -> DataFrame:
    """Requests that count: ignored paths dropped, untracked ones named 'other', methods in upper case."""
    return events.where(~F.col("path").isin(*s.ignored_paths)).withColumns(
        {"path": tracked_path(F.col("path"), s.track_paths), "method": F.upper("method"), "latency_ms": round_even(F.col("latency_ms"), 2)}
    )


def request_counters(events: DataFrame, time: Column | None = None) -> DataFrame:
    """Requests, successes and errors by method, path and status (and time window, if given)."""
    keys = [F.col("method"), F.col("path"), F.col("status_code")]
    if time is not None:
        keys.insert(0, time)
    ok = is_success(F.col("status_code"))
    return events.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("errors")
    )


def latency_buckets(events: DataFrame, bounds: Sequence[float] = ServingSettings().latency_bounds, keys: Sequence[str] = ("method", "path")) -> DataFrame:
    """Cumulative latency histogram: (keys..., le, n) for each bound in seconds, and +Inf."""
    seconds = F.col("latency_ms") / 1000.0
    counts = events.groupBy(*keys).agg(
        *[F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("all"), F.sum(seconds).alias("latency_sum")
    )
    cells = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return counts.select(*keys, F.explode(F.array(*cells)).alias("c"), "latency_sum").select(*keys, "c.le", "c.n", "latency_sum")


def _to_windows(panes: DataFrame, slides: int, slide_seconds: int) -> DataFrame:
    """Copy pane rows into each of the ``slides`` windows that cover them."""
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(slides - 1)), lambda i: F.timestamp_seconds(F.unix_timestamp("pane") - i * slide_seconds)
    )
    return panes.withColumn("window_start", F.explode(starts))


def sliding_summary(events: DataFrame, ts: str = "ts", window_seconds: int = 900, slide_seconds: int = 300) -> DataFrame:
    """Exact batch summary of every sliding window: totals, rates, latency percentiles, average and maximum.

    Rows are first counted per (pane, latency, status), where a pane is one slide; only these counts are copied
    into the overlapping windows. Latency is rounded to two decimals first, so a window holds a limited number of distinct
    values however many requests it saw. Percentiles are nearest-rank with a half-even index.
    """
    if window_seconds % slide_seconds:
        raise ValueError("The window must be a whole number of slides.")
    moment = F.col(ts).cast("timestamp")
    pane = F.timestamp_seconds(F.floor(F.unix_timestamp(moment) / slide_seconds) * slide_seconds)
    ok = is_success(F.col("status_code"))
    hundredths = (F.bround(F.col("latency_ms") * 100) / 100).alias("latency_ms")
    panes = events.groupBy(pane.alias("pane"), hundredths).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    slides = window_seconds // slide_seconds
    values = _to_windows(panes, slides, slide_seconds).groupBy("window_start", "latency_ms").agg(
        F.sum("n").alias("n"), F.sum("ok").alias("ok")
    )
    by_value = W.partitionBy("window_start").orderBy("latency_ms")
    whole = W.partitionBy("window_start")
    ranked = values.select("*", F.sum("n").over(by_value).alias("upto"), F.sum("n").over(whole).alias("total"))

    def percentile(p: float) -> Column:
        place = F.bround((F.col("total") - 1) * F.lit(p)).cast("bigint")
        return round_even(F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place), F.col("latency_ms"))), 2)

    n, good = F.sum("n"), F.sum("ok")
    return ranked.groupBy("window_start").agg(
        n.alias("requests_total"),
        good.alias("success_total"),
        (n - good).alias("error_total"),
        round_even(good / n, 4).alias("success_rate"),
        round_even((n - good) / n, 4).alias("error_rate"),
        *[percentile(p).alias(f"p{round(p * 100)}") for p in PERCENTILES],
        # Whole hundredths add up exactly, whatever the order of rows.
        round_even(F.sum(F.bround(F.col("latency_ms") * 100).cast("bigint") * F.col("n")) / n / 100, 2).alias("avg_ms"),
        round_even(F.max("latency_ms"), 2).alias("max_ms"),
    )


def sliding_counts(events: DataFrame, key: str, ts: str = "ts", window_seconds: int = 900, slide_seconds: int = 300) -> DataFrame:
    """Requests by window and status code or path."""
    moment = F.col(ts).cast("timestamp")
    pane = F.timestamp_seconds(F.floor(F.unix_timestamp(moment) / slide_seconds) * slide_seconds)
    panes = events.groupBy(pane.alias("pane"), key).agg(F.count("*").alias("n"))
    return _to_windows(panes, window_seconds // slide_seconds, slide_seconds).groupBy("window_start", key).agg(F.sum("n").alias("requests"))
