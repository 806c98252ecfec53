import pytest
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators import cleaning, devices, windows
from strideframe.sources import readers


def test_gaps_infinities_and_spikes(spark):
    rows = [("w", 0, "0.1", "0.2", 0.0), ("w", 1, "NaN", "0.2", 0.1), ("w", 2, "0.3", None, 0.0),
            ("w", 3, "Infinity", "0.4", 50.0), ("w", 4, "25", "0.5", 0.0)]
    df = spark.createDataFrame(rows, "window_id string, step int, acc_x string, acc_y string, gyro_x double")
    out = cleaning.clean_stream(df).orderBy("step").collect()
    assert [r["acc_x"] for r in out] == [0.1, 0.1, 0.3, 0.3, 16.0]
    assert [r["acc_y"] for r in out] == [0.2, 0.2, 0.2, 0.4, 0.5]
    assert max(r["gyro_x"] for r in out) == 35.0


def test_units(spark):
    df = spark.createDataFrame(
        [(9.80665, "m/s2", 1.0), (0.98, "g", 1.0), (0.98, None, 1.0), (9.80665, "MS^-2", 1.0), (2.0, "", 1.0)],
        "acc_z double, unit string, gyro_x double").withColumns({a: F.col("acc_z") for a in ("acc_x", "acc_y")})
    out = cleaning.normalise_units(df).collect()
    assert [r["acc_z"] for r in out] == pytest.approx([1.0, 0.98, 0.98, 1.0, 2.0])
    assert all(r["gyro_x"] == 1.0 for r in out)
    assert cleaning.standardise_units(df.select("acc_z"), acc_in_ms2=True, gyro_in_deg=True).columns == ["acc_z"]


def test_packets(spark):
    texts = [
        '{"type":"sensor_data","accelerometer":{"x":1,"y":2,"z":3}}',
        '{"accelerometer":{"x":1,"y":2,"z":3},"gyroscope":{"x":"a","y":0,"z":0}}',
        '{"accelerometer":{"x":9.80665,"y":2},"gyroscope":{"x":0.5,"y":0,"z":0}}',
        "{oops", '{"type":"ping"}', "[1]",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "no int, value string")
    good, bad = readers.split_rejects(readers.parse_packets(df))
    assert {r["no"] for r in bad.collect()} >= {3}
    flat = cleaning.normalise_units(cleaning.packet_samples(cleaning.route(good, "sensor_data"))).collect()
    assert [r["no"] for r in flat] == [2]
    assert flat[0]["acc_x"] == pytest.approx(1.0) and flat[0]["acc_z"] == 0.0 and flat[0]["unit"] == "m/s2"
    assert [r["no"] for r in cleaning.route(good, "ping").collect()] == [4]


def test_window_requests(spark):
    def request(n, last=None):
        one = ",".join(f'"{a}":{[0.5] * (last if last is not None and a == "gyro_z" else n)}' for a in S.AXES)
        return "{" + one + "}"

    df = spark.createDataFrame([(f"[{request(8)},{request(7)},{request(8, 9)}]",)], "value string")
    out = [r["reject_reason"] for r in readers.parse_window_requests(df, many=True).collect()]
    assert out[0] is None and "at least 8 samples, got 7" in out[1] and "identical length" in out[2]


def test_retention_and_status(spark):
    df = spark.range(1000).select(
        F.lit(1).cast("long").alias("user_id"), F.lit("a").alias("device_id"), (F.col("id") * 0.02).alias("at"),
        F.timestamp_micros(F.col("id") * 20_000).alias("ts"))
    other = df.where("at < 0.4").withColumns({"user_id": F.lit(None).cast("long"), "device_id": F.lit("b")})
    both = df.unionByName(other)
    keyed = both.withColumn("k", devices.stream_key())
    kept = windows.retained(keyed, ["k"], [F.desc("ts")])
    a = kept.where("k = '1_a'").agg(F.count("*"), F.min("at")).first()
    assert (a[0], round(a[1], 6)) == (250, 15.0)
    status = {r["device_id"]: r for r in devices.device_status(both).collect()}
    assert (status["a"]["samples_received"], status["a"]["buffer_seconds"]) == (1000, 5.0)
    assert (status["b"]["samples_received"], status["b"]["buffer_samples"]) == (20, 20)
    assert devices.visible_to(devices.device_status(both), 9).count() == 1
    assert devices.visible_to(devices.device_status(both), 9, is_admin=True).count() == 2


def test_raw_counts(spark):
    df = spark.createDataFrame([(4096, 328)], "a int, g int")
    out = cleaning.decode_raw_counts(df, ["a"] * 3, ["g"] * 3).first()
    assert out["acc_x"] == 1.0 and out["gyro_z"] == pytest.approx(10 * 3.141592653589793 / 180)
