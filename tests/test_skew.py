"""Results must not depend on whether a key was split: every ordered operator, with and without a tiny limit."""

import pytest
from pyspark.sql import functions as F

from strideframe.operators import asof, cleaning, devices, features, lifecycle, ordered, windows
from strideframe.plans.views import SENSOR_ORDER, actions, falls, raw_sensor, sensor_along, table

KEYS = ["device_id"]
FEW = ["acc_mag_mean", "acc_x_median", "gyro_mag_dom_freq", "jerk_max", "jerk_mean", "post_impact_immobility"]


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """A third of all rows on one device, some of it at one instant."""
    df = raw_sensor(spark, sf)
    return df.withColumn(
        "device_id", F.when(F.col("seq_c") % 3 == 0, F.lit(0)).otherwise(F.col("device_id")).cast("long")
    ).withColumn("acc_x", F.when(F.col("seq_c") % 7 > 0, F.col("acc_x"))).cache()


def rows(df):
    shown = df.select(*[
        F.round(f.name, 9).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema
    ])
    return sorted(map(tuple, shown.collect()), key=repr)


def test_only_large_keys_are_split(skewed):
    hot = ordered.hot_keys(skewed, KEYS, sensor_along(), 1000)
    assert [r["device_id"] for r in hot.collect()] == [0]
    chunks = ordered.chunked(skewed, KEYS, sensor_along(), hot).groupBy("device_id", "_chunk").count()
    assert chunks.where("device_id = 0").agg(F.max("count")).first()[0] <= 2000
    assert chunks.where("device_id <> 0 AND _chunk <> -1").count() == 0


def test_uneven_order_is_cut_finer(spark):
    df = spark.range(4000).select(
        F.lit(1).alias("k"), F.when(F.col("id") < 3900, F.col("id")).otherwise(F.col("id") * 10_000).alias("t")
    )
    hot = ordered.hot_keys(df, ["k"], F.col("t"), 200)
    densest = ordered.chunked(df, ["k"], F.col("t"), hot).groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert densest <= 400


def test_numbered(skewed):
    one = ordered.numbered(skewed, KEYS, SENSOR_ORDER, sensor_along()).drop("_chunk")
    many = ordered.numbered(skewed, KEYS, SENSOR_ORDER, sensor_along(), limit=50).drop("_chunk")
    assert rows(one) == rows(many)


def test_null_order_comes_first_in_split_keys(spark):
    df = spark.range(60).select(
        F.when(F.col("id") < 40, "hot").otherwise("blank").alias("k"), F.col("id").alias("v"),
        F.when((F.col("id") < 40) & (F.col("id") % 5 > 0), F.col("id") * F.col("id")).alias("t"),
    )
    args = (df, ["k"], ["t", "v"], F.col("t"))
    held = {"h": F.when(F.col("v") % 3 == 0, F.col("v"))}
    whole, split = (ordered.numbered(*args, limit=n).drop("_chunk") for n in (1000, 8))
    assert rows(whole) == rows(split)
    for forward in (True, False):
        whole, split = (ordered.carried(*args, held, limit=n, forward=forward) for n in (1000, 8))
        assert rows(whole) == rows(split)
    whole, split = (ordered.lagged(*args, {"p": F.col("v")}, limit=n) for n in (1000, 8))
    assert rows(whole) == rows(split)


@pytest.mark.parametrize("forward", [True, False])
def test_carried(skewed, forward):
    held = {"h": F.col("acc_x")}
    one = ordered.carried(skewed, KEYS, SENSOR_ORDER, sensor_along(), held, forward=forward)
    many = ordered.carried(skewed, KEYS, SENSOR_ORDER, sensor_along(), held, limit=40, forward=forward)
    assert rows(one) == rows(many)


def test_lagged(skewed):
    prev = {"p": F.col("acc_x"), "q": F.col("seq_a")}
    one = ordered.lagged(skewed, KEYS, SENSOR_ORDER, sensor_along(), prev)
    many = ordered.lagged(skewed, KEYS, SENSOR_ORDER, sensor_along(), prev, limit=40)
    assert rows(one) == rows(many)


@pytest.mark.parametrize(
    "rule", [windows.PHONE_RULE, windows.REPLAY_RULE, windows.DEVICE_RULE, windows.WindowRule(16, 4, 3, "front")]
)
def test_window_features(skewed, rule):
    filled = skewed.fillna(0.5, ["acc_x"])
    one = features.stream_features(filled, KEYS, SENSOR_ORDER, sensor_along(), rule, FEW)
    many = features.stream_features(
        filled, KEYS, SENSOR_ORDER, sensor_along(), rule, FEW, limit=100, block_rows=160
    )
    assert rows(one) == rows(many)


def test_fill_and_hold_and_sessions(spark, sf, skewed):
    a = cleaning.fill_gaps(skewed, KEYS, SENSOR_ORDER, sensor_along())
    b = cleaning.fill_gaps(skewed, KEYS, SENSOR_ORDER, sensor_along(), limit=30)
    assert rows(a) == rows(b)
    ev = table(spark, sf, "events").withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")))
    held = {"g": F.when(F.col("event_type") == "view", F.col("value"))}
    args = (ev, ["user_id"], ["ts", "event_id"], ordered.micros("ts"), F.col("event_type") == "click", held)
    assert rows(asof.sample_hold(*args)) == rows(asof.sample_hold(*args, limit=20))
    one = devices.connectivity(ev, ["user_id"], ["ts", "event_id"], 6 * 3600.0)
    assert rows(one) == rows(devices.connectivity(ev, ["user_id"], ["ts", "event_id"], 6 * 3600.0, limit=20))


def test_dispatches(spark, sf):
    acts = actions(spark, sf).withColumn("event_id", F.when(F.col("seq") % 3 == 0, 1).otherwise(F.col("event_id")))
    fell = falls(spark, sf)
    one = lifecycle.dispatches(fell, acts, 21600.0)
    assert rows(one) == rows(lifecycle.dispatches(fell, acts, 21600.0, limit=10))
    assert rows(lifecycle.note_lines(fell, acts)) == rows(lifecycle.note_lines(fell, acts, limit=10))
