"""Registered queries agree with their SQL on the smallest tables (a sample here; all by ``strideframe.check``)."""

import pytest

from strideframe.check import compare
from strideframe.plans import catalogue


def test_every_check_belongs_to_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", [
    "windows_by_device_and_risk", "cleaned_stream", "gyro_hold_at_acc", "fall_event_outcomes",
    "emergency_dispatch_outbox", "classifier_evaluation", "dashboard_summary", "stream_cooldown",
])
def test_query_equals_sql(spark, sf, name):
    ok, note = compare(spark, sf, name)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["risk_level", "device_id", "windows", "jerk_max"]


def test_one_exchange_for_windows(spark, sf):
    """Samples are shuffled once, by device; windows and features stay in that partitioning."""
    from strideframe.operators.windows import PHONE_RULE
    from strideframe.plans.sensor_queries import stream_features

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = stream_features(spark, sf, PHONE_RULE, ["acc_mag_max", "jerk_max"])
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("Exchange hashpartitioning") == 1, text
