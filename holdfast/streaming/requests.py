"""Live request statistics and per-batch quality checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast.functions.scalars import is_success, round_even
from holdfast.operators.quality import quality_status
from holdfast.operators.serving import PERCENTILES, request_counters


def live_counters(events: DataFrame, ts: str = "ts", window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Requests, successes and errors by window, method, path and status. ``ts`` must be a timestamp."""
    watched = events.withWatermark(ts, delay)
    return request_counters(watched, F.window(ts, window).alias("window"))


def live_summary(events: DataFrame, ts: str = "ts", window: str = "15 minutes", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Exact sliding summary of a stream: totals, rates, nearest-rank percentiles, average, maximum, and requests by status and by path.

    Two chained aggregations. The first counts requests by pane (one slide), latency in hundredths, status and path; the second brings the panes of a window
    together. State holds counts of distinct values, not requests. A window comes out once, when the watermark has passed its end; its row equals that of the batch summary over
    the same requests. ``window`` must be a whole number of ``slide``s. Requests without a latency, a status or a path are counted under a missing one.
    """
    hundredths = F.bround(F.col("latency_ms") * 100).cast("bigint")
    panes = (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, slide).alias("pane"), hundredths.alias("value"), F.col("status_code").cast("int").alias("status"), F.col("path"))
        .agg(F.count("*").alias("n"))
    )
    counts = panes.groupBy(F.window(F.window_time("pane"), window, slide).alias("window")).agg(F.collect_list(F.struct("value", "n", "status", "path")).alias("cells"))
    return _summary_of(counts.select(F.col("window.start").alias("window_start"), "cells"))


def _summary_of(windows: DataFrame) -> DataFrame:
    """Summary rows from windows with an array of cells (value, n, status, path): latency in hundredths and how many requests had it.

    The work on a window grows with its cells, but for their sorting: each array is read by one pass that carries what it needs, and what later fields share is a
    column of its own. Nothing but the current cell and the running state stands inside a pass, as Spark evaluates that once for each cell; the state, which Spark copies
    each time, has no arrays.
    """
    names = [f"p{round(p * 100)}" for p in PERCENTILES]
    zero, unset = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    cells = F.col("cells")

    def count(acc: Column, c: Column) -> Column:
        good, timed = F.when(is_success(c.status), c.n).otherwise(0), F.when(c.value.isNotNull(), c.n).otherwise(0)
        return F.struct((acc.n + c.n).alias("n"), (acc.good + good).alias("good"), (acc.timed + timed).alias("timed"))

    counted = windows.select(
        "window_start",
        F.aggregate(cells, F.struct(zero.alias("n"), zero.alias("good"), zero.alias("timed")), count).alias("all"),
        F.sort_array(F.transform(F.filter(cells, lambda c: c.value.isNotNull()), lambda c: F.struct(c.value.alias("value"), c.n.alias("n")))).alias("by_value"),
        *[_sorted_by("cells", x).alias(f"by_{x}") for x in ("status", "path")],
    ).select("*", *[_starts("by_" + x).alias(f"{x}_starts") for x in ("status", "path")])

    places = {x: F.bround((F.col("all.timed") - 1) * F.lit(p)).cast("bigint") for x, p in zip(names, PERCENTILES)}
    start = F.struct(
        zero.alias("seen"), zero.alias("weighted"), unset.alias("largest"), *[place.alias(f"{x}_place") for x, place in places.items()], *[unset.alias(x) for x in names]
    )

    def step(acc: Column, c: Column) -> Column:
        # The value that holds the place is the first one whose running total passes it.
        seen = acc.seen + c.n
        held = [F.when(acc[x].isNull() & (seen > acc[f"{x}_place"]), c.value).otherwise(acc[x]).alias(x) for x in names]
        return F.struct(
            seen.alias("seen"), (acc.weighted + c.value * c.n).alias("weighted"), c.value.alias("largest"), *[acc[f"{x}_place"].alias(f"{x}_place") for x in names], *held
        )

    ranked = counted.withColumn("ranked", F.aggregate("by_value", start, step))
    n, good, found = F.col("all.n"), F.col("all.good"), F.col("ranked")
    return ranked.select(
        "window_start",
        n.alias("requests_total"),
        good.alias("success_total"),
        (n - good).alias("error_total"),
        round_even(good / n, 4).alias("success_rate"),
        round_even((n - good) / n, 4).alias("error_rate"),
        *[(found[x] / 100).alias(x) for x in names],
        round_even(F.try_divide(found.weighted, F.col("all.timed")) / 100, 2).alias("avg_ms"),
        (found.largest / 100).alias("max_ms"),
        *[_counts("by_" + x, f"{x}_starts").alias(f"requests_by_{x}") for x in ("status", "path")],
    )


def _sorted_by(cells: str, field: str) -> Column:
    """(key, n) of each cell by key, the field's value as text. A missing value cannot be a key of a map."""
    return F.sort_array(F.transform(cells, lambda c: F.struct(F.coalesce(c[field].cast("string"), F.lit("")).alias("key"), c.n.alias("n"))))


def _starts(pairs: str) -> Column:
    """Where in sorted pairs a key begins, from 0."""
    return F.filter(F.transform(pairs, lambda c, i: F.when((i == 0) | ~F.get(pairs, i - 1).key.eqNullSafe(c.key), i)), lambda i: i.isNotNull())


def _counts(pairs: str, starts: str) -> Column:
    """Requests by key as a map in the keys' order; both arguments are names of columns, so that nothing is computed again for each key."""

    def entry(start: Column, i: Column) -> Column:
        run = F.slice(pairs, start + 1, F.coalesce(F.get(starts, i + 1), F.size(pairs)) - start)
        return F.struct(F.get(pairs, start).key.alias("key"), F.aggregate(run, F.lit(0).cast("bigint"), lambda n, c: n + c.n).alias("n"))

    return F.map_from_entries(F.transform(starts, entry))


def watch_quality(
    requests: DataFrame,
    known: DataFrame,
    features: Sequence[str],
    checkpoint: str,
    history: str,
    on_error: Callable[[Exception], None] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Quality row of each micro-batch into a history table. A failed check goes to ``on_error``; without one it stops the stream, and the batch
    is checked again at the next start."""
    columns = list(requests.columns)

    def check(batch: DataFrame, batch_id: int) -> None:
        try:
            row = quality_status(batch, known, features, columns=columns).withColumn("batch_id", F.lit(batch_id))
            # One folder per micro-batch, so a replayed batch replaces its own row.
            row.write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
        except Exception as error:  # noqa: BLE001
            if on_error is None:
                raise
            on_error(error)

    writer = requests.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
