"""Time the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "flagship_labeled_profit",
    "classification_metrics",
    "batch_report",
    "roc_auc",
    "best_threshold",
    "ks_drift",
    "chi2_drift",
    "unseen_categories",
    "batch_decision",
    "rate_discounts",
    "profit_curve",
    "uplift_grid",
    "latest_label",
    "pending_labels",
    "quarantine_batches",
    "one_hot",
    "stratified_split",
    "describe_numeric",
    "correlation",
    "latency_percentiles",
    "sliding_summary",
    "cost_window",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))

    from holdfast.plans.catalog import QUERIES
    from holdfast.session import get_session

    spark = get_session("bench", master=f"local[{cpus}]", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths and the file cache before the clock.
    QUERIES["confusion"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
