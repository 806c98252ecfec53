"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

HEADLINE = [
    "windows_by_device_and_risk",
    "phone_window_features",
    "device_window_spectra",
    "dataset_window_features",
    "every_sample_windows",
    "cleaned_stream",
    "retained_samples",
    "gyro_hold_at_acc",
    "device_connectivity",
    "fall_event_outcomes",
    "emergency_dispatch_outbox",
    "direct_alert_cooldown",
    "dashboard_summary",
    "classifier_evaluation",
    "stream_device_windows",
    "stream_inference",
    "linear_table_scores",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from strideframe.plans import catalogue
    from strideframe.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
