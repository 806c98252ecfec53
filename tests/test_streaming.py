"""Several micro-batches give what one batch job gives."""

import json
import random
import tracemalloc
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators import lifecycle, windows
from strideframe.sources import writers
from strideframe.streaming import jobs, processors, sinks
from strideframe.streaming.processors import DeviceBuffer

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def feed(spark, tmp_path, batches, schema):
    """One file per micro-batch, in order."""
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


SAMPLES = ("user_id long, device_id string, ts timestamp, seq long, "
           + ", ".join(f"{a} double" for a in S.AXES) + ", lat double, lon double")


def sample(user, device, i, shock=False):
    v = 4.0 if shock else 0.3 + (i % 10) / 20
    lat = 37.5 if i == 30 else None
    return (user, device, T0 + timedelta(milliseconds=20 * i), i, *[v] * 6, lat, lat)


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    batches, plan = [], [("a", 1, 175), ("b", 2, 20), ("a", None, 70)]
    rows = [sample(u, d, i, shock=d == "a" and u == 1 and i >= 150) for d, u, n in plan for i in range(n)]
    for k in range(4):
        batches.append([r for r in rows if r[3] % 200 // 50 == k])
    tmp = tmp_path_factory.mktemp("stream")
    out = jobs.run_to_end(jobs.device_windows(feed(spark, tmp, batches, SAMPLES)), str(tmp / "o")).cache()
    return rows, out


def test_windows_equal_batch(spark, streamed):
    rows, out = streamed
    batch = spark.createDataFrame(rows, SAMPLES).withColumn(
        "k", F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("anon")), F.lit("_"), "device_id"))
    want = {
        (r["k"], r["win_end"]): r["acc_x"]
        for r in windows.window_arrays(batch, ["k"], ["ts", "seq"], F.col("seq")).collect()
    }
    got = {(r["stream_key"], r["n"]): r["acc_x"] for r in out.where("kind = 'window'").collect()}
    assert set(got) == {("1_a", 64 + 25 * i) for i in range(5)} | {("anon_a", 64)} and got == want


def test_ticks_and_location(streamed):
    _, out = streamed
    ticks = out.where("kind = 'tick' AND stream_key = '2_b'")
    assert sorted(r["n"] for r in ticks.collect()) == list(range(2, 21, 2))
    assert {r["lat"] for r in out.where("stream_key = '1_a' AND n > 31").collect()} == {37.5}


def test_inference_tables(spark, streamed, tmp_path):
    _, out = streamed
    tables = sinks.BatchTables(spark, str(tmp_path))
    write = tables.sink(sinks.inference_tables())
    for _ in range(2):  # a replayed batch is written once
        write(out, 0)
    assert tables.read("audit").count() == 6
    assert {(r["stream_key"], r["n"]) for r in tables.read("falls").collect()} == {("1_a", 164)}
    message = json.loads(tables.read("messages").first()["value"])
    assert message["type"] == "ACTIVITY_UPDATE" and "risk_level" in message["data"]
    tick = json.loads(tables.read("ticks").where("stream_key = '2_b' AND n = 2").first()["value"])["data"]
    assert tick["timestamp"] == "00:00:00.020" and tick["acc_x"] == 0.35 and tick["device_id"] == "2_b"


def test_tables_after_a_failure(spark, tmp_path):
    """A batch that dies between two tables is run again: no table loses or repeats a row, and none shows half a batch."""
    kind = "id long, ts timestamp"
    rows = feed(spark, tmp_path, [[(b * 10 + i, T0) for i in range(5)] for b in range(4)], kind)
    tables = sinks.BatchTables(spark, str(tmp_path / "t"))
    died = []

    def made(batch, keep):
        if batch.where("id >= 20").isEmpty() or died:
            return {"low": batch.where("id % 2 = 0"), "high": keep(batch.where("id % 2 = 1")), "all": batch}
        died.append(1)
        broken = F.when(F.col("id") > 22, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id")
        return {"low": batch.where("id % 2 = 0"), "high": batch.select(broken, "ts"), "all": batch}

    with pytest.raises(Exception, match="lost"):
        sinks.run_tables(rows, made, str(tmp_path / "t"))
    assert sorted(r.id for r in tables.read("low").collect()) == [0, 2, 4, 10, 12, 14]  # the third batch is not shown
    assert (tmp_path / "t" / "low" / "batch=2").exists() and not (tmp_path / "t" / "all" / "batch=2").exists()
    sinks.run_tables(rows, made, str(tmp_path / "t"))
    want = [b * 10 + i for b in range(4) for i in range(5)]
    assert sorted(r.id for r in tables.read("all").collect()) == want
    assert sorted(r.id for name in ("low", "high") for r in tables.read(name).collect()) == want
    tables.write(3, {"low": rows, "high": rows, "all": rows})  # committed: left alone
    assert tables.read("all").count() == 20 and sorted(r.batch for r in tables.batches().collect()) == [0, 1, 2, 3]
    assert sinks.BatchTables(spark, str(tmp_path / "none")).batches().count() == 0


class Memory:
    """State of one key without a cluster."""

    def __init__(self):
        self.rows, self.timers = None, set()

    def getValueState(self, *_):
        return Memory()

    getListState = getValueState

    def exists(self):
        return self.rows is not None

    def get(self):
        return iter(self.rows or []) if isinstance(self.rows, list) else self.rows

    def update(self, row):
        self.rows = row

    put = update

    def appendValue(self, row):
        self.rows = [*(self.rows or []), row]

    def clear(self):
        self.rows = None


def chunks(n, size, start=0):
    for a in range(start, start + n, size):
        i = np.arange(a, min(a + size, start + n))
        yield pd.DataFrame({"ts": i * 20_000, **{x: np.sin(i / 50 + j) for j, x in enumerate(S.AXES)},
                            "lat": np.where(i % 1000 == 0, i * 1.0, np.nan), "lon": np.nan})


@pytest.mark.parametrize("rule", [windows.PHONE_RULE, windows.REPLAY_RULE, windows.DEVICE_RULE, windows.WindowRule(40, 7, 3, "front")])
def test_chunks_make_no_difference(rule):
    def run(parts, size):
        buffer, out, at = DeviceBuffer(rule, 150), [], 0
        buffer.init(Memory())
        for n in parts:
            out += list(buffer.handleInputRows(("k",), chunks(n, size, at), None))
            at += n
        held = list(buffer.blocks.get())
        return pd.concat(out).sort_values(["kind", "n"], kind="stable"), buffer.counters.get(), sum(b[0] for b in held)

    whole, counters, _ = run([3000], 3000)
    for parts, size in (([3000], 64), ([1] * 90 + [10, 1900, 1000], 77), ([130, 130, 130, 2610], 1000)):
        other, own, held = run(parts, size)
        assert own[0] == 3000 and own[2] == counters[2] == 2000.0 and 150 <= held <= 2 * max(150, rule.size)
        for c in ("n", "ts", "lat"):
            assert np.array_equal(whole[c], other[c], equal_nan=True)
        assert all(np.array_equal(a, b) for a, b in zip(whole["gyro_y"], other["gyro_y"]))


def test_devices_of_a_bucket_are_apart():
    """Many devices under one key, in few calls to the state, are what each is alone."""
    def frame(n, at, shift):
        one = next(chunks(n, n, at))
        return one.assign(**{a: one[a] + shift for a in S.AXES})

    def blocks(parts, size):
        rows = pd.concat([f.assign(stream_key=k) for k, f in parts], ignore_index=True)
        for a in range(0, len(rows), size):
            some = pa.Table.from_pandas(rows[a : a + size], preserve_index=False)
            yield pd.DataFrame({"rows": [processors._packed(some.set_column(some.column_names.index("stream_key"), "stream_key", some["stream_key"].cast("string")))]})

    class Counted(Memory):
        calls = 0

        def get(self):
            Counted.calls += 1
            return super().get()

        def getValueState(self, *_):
            return Counted()

        getListState = getValueState

    names, rule = [None, *[f"d{i}" for i in range(40)]], windows.WindowRule(40, 7, 3, "front")
    together, apart, out, want = processors.DeviceBuckets(rule, 150), {k: DeviceBuffer(rule, 150) for k in names}, [], []
    together.init(Counted())
    for buffer in apart.values():
        buffer.init(Memory())
    at = dict.fromkeys(names, 0)
    for step, size in enumerate((64, 1000, 77, 4000, 50)):
        parts = [(k, frame(n, at[k], i)) for i, k in enumerate(names) if (n := (i * 37 + step * 90) % 230)]
        for sent in together.handleInputRows((0,), blocks(parts, size), None):
            out.append(pa.ipc.open_stream(sent["rows"][0]).read_all().to_pandas())
        for k, f in parts:
            want += list(apart[k].handleInputRows((k,), iter([f]), None))
            at[k] += len(f)
    order = ["stream_key", "kind", "n"]
    got, want = (pd.concat(x).sort_values(order).reset_index(drop=True) for x in (out, want))
    assert len(got) == len(want) and Counted.calls <= 2 * 5
    for c in (*order, "ts", "lat", "lon"):
        pd.testing.assert_series_equal(got[c], want[c], check_dtype=False)
    assert all(np.array_equal(x, y) for a in S.AXES for x, y in zip(got[a], want[a]))
    held = sum(len(processors._opened([b], processors._SAMPLES)) for (b,) in together.blocks.get())
    assert held <= 2 * sum(min(n, 150) for n in at.values())


def test_what_a_sample_lacks_is_null_in_its_window():
    rows = next(chunks(10, 10)).assign(stream_key="k")
    rows.loc[7, "gyro_x"] = np.nan
    buffer = processors.DeviceBuckets(windows.WindowRule(4, 4, 4, None), 4)
    buffer.init(Memory())

    def sent(part):
        return iter([pd.DataFrame({"rows": [processors._packed(part)]})])

    whole = pa.Table.from_pandas(rows, preserve_index=False)
    made = [pa.ipc.open_stream(f["rows"][0]).read_all() for f in buffer.handleInputRows((0,), sent(whole), None)]
    got = {(r["kind"], r["n"]): r for t in made for r in t.to_pylist()}
    assert got["window", 8]["gyro_x"][-1] is None and None not in got["window", 8]["gyro_x"][:3] + got["window", 8]["gyro_y"]
    assert got["tick", 8]["gyro_x"] == [None] and got["tick", 8]["lon"] is None and got["tick", 8]["lat"] == 0.0
    timeless = whole.set_column(whole.column_names.index("ts"), "ts", pa.nulls(10, pa.int64()))
    with pytest.raises(ValueError, match="time"):
        list(buffer.handleInputRows((0,), sent(timeless), None))


def test_one_device_with_very_many_samples_in_a_batch():
    buffer, made = DeviceBuffer(windows.PHONE_RULE), 0
    buffer.init(Memory())
    tracemalloc.start()
    for frame in buffer.handleInputRows(("k",), chunks(2_000_000, 10_000), None):
        made += (frame["kind"] == "window").sum()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == (2_000_000 - 64) // 25 + 1 and peak < 64 << 20
    with pytest.raises(ValueError, match="order"):
        list(buffer.handleInputRows(("k",), (c[::-1] for c in chunks(10, 10)), None))


def test_rows_of_a_batch_come_in_order(spark, tmp_path):
    """Many source tasks, shuffled rows: windows as if the samples had come one by one."""
    rows = [sample(1, "a", i) for i in range(3000)]
    spark.createDataFrame(rows, SAMPLES).orderBy(F.rand(3)).repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SAMPLES).parquet(str(tmp_path / "in"))
    out = jobs.run_to_end(jobs.device_windows(stream), str(tmp_path / "o")).where("kind = 'window'").collect()
    want = {r["win_end"]: r["acc_x"] for r in windows.window_arrays(
        spark.createDataFrame(rows, SAMPLES), ["device_id"], ["ts", "seq"], F.col("seq")).collect()}
    assert {r["n"]: r["acc_x"] for r in out} == want


def test_confirmations(spark, tmp_path):
    def row(event, at, seq, what):
        return (event, T0 + timedelta(seconds=at), seq, what)

    batches = [
        [row(1, 0, 1, "FALL"), row(2, 0, 2, "FALL"), row(3, 1, 3, "FALL"), row(5, 1, 4, "FALL")],
        [row(1, 5, 5, "OK"), row(3, 6, 6, "UNKNOWN"), row(5, 7, 7, "ACK")],
        [row(4, 20, 8, "FALL"), row(4, 40, 9, "OK")],
        [row(9, 90, 10, "FALL")],
        [row(2, 95, 11, "HELP"), row(9, 96, 12, "HELP")],
    ]
    log = feed(spark, tmp_path, batches, "event_id long, ts timestamp, seq long, what string")
    out = jobs.run_to_end(jobs.confirmations(log, 15.0, "0 seconds"), str(tmp_path / "o"))
    seen = {}
    for r in out.orderBy("ts", "seq").collect():
        seen.setdefault(r["event_id"], []).append((r["status"], r["reason"]))
    assert seen[1] == [("PENDING_CONFIRMATION", None), ("CANCELLED_BY_USER", None)]
    assert seen[2] == [("PENDING_CONFIRMATION", None), ("CONFIRMED", "TIMEOUT"), ("CONFIRMED", "MANUAL_HELP_REQUEST")]
    assert seen[3] == [("PENDING_CONFIRMATION", None)]
    assert seen[4] == [("PENDING_CONFIRMATION", None), ("CONFIRMED", "TIMEOUT"), ("CANCELLED_BY_USER", None)]
    assert seen[5] == [("PENDING_CONFIRMATION", None), ("ACKNOWLEDGED", None), ("CONFIRMED", "TIMEOUT")]
    assert seen[9] == [("PENDING_CONFIRMATION", None), ("CONFIRMED", "MANUAL_HELP_REQUEST")]


LOG = ("event_id long, ts timestamp, seq long, what string, by string, lat double, lon double, user_id long, device_id string, "
       "confidence double, risk_level string")


def random_log(rng):
    falls, acts = [], []
    for e in range(1, 40):
        at = rng.randrange(0, 3000)
        place = rng.choice([None, 10.0 + e])
        falls.append((e, T0 + timedelta(seconds=at), 0, "FALL", None, place, place, None if e % 5 == 0 else e, f"d{e % 3}", 0.9, "HIGH"))
        for _ in range(rng.randrange(5)):
            what = rng.choice(["OK", "HELP", "UNKNOWN", "ACK"])
            lat = rng.choice([None, 50.0 + len(acts)]) if what in ("OK", "HELP") else None
            acts.append((e, T0 + timedelta(seconds=at + rng.choice([-5, 0, 3, 14, 15, 16, 40, 400])), len(acts) + 1, what,
                         "op" if what == "ACK" else None, lat, lat, None, None, None, None))
    return falls, acts


def test_confirmations_in_any_order_of_arrival(spark, tmp_path):
    """Rows that come up to the lateness bound behind others give what one batch job gives."""
    rng = random.Random(9)
    falls, acts = random_log(rng)
    end = (99, T0 + timedelta(seconds=9000), 999, "UNKNOWN", *[None] * 7)
    rows = sorted(falls + acts, key=lambda r: r[1].timestamp() + rng.uniform(0, 100))
    batches = [rows[i : i + 40] for i in range(0, len(rows), 40)] + [[end]]
    out = jobs.run_to_end(jobs.confirmations(feed(spark, tmp_path, batches, LOG), 15.0, "100 seconds"), str(tmp_path / "o")).cache()
    assert out.where("status = 'LATE'").count() == 0
    fell = spark.createDataFrame(falls, LOG).withColumnsRenamed({"lat": "location_lat", "lon": "location_lon"}).drop("by")
    done = spark.createDataFrame(acts, LOG).withColumns({
        "kind": F.when(F.col("what") == "ACK", "acknowledge").otherwise("response"), "action": F.col("what")})
    want = {r.event_id: (r.status, r.location_lat) for r in lifecycle.event_outcomes(fell, done, 15.0).collect()}
    last = out.where("status <> 'NOT_OPEN'").groupBy("event_id").agg(F.max_by(F.struct("status", "lat"), F.struct("ts", "seq")).alias("s"))
    assert {r.event_id: tuple(r.s) for r in last.collect()} == want
    sent = {(r.event_id, r.ts, r.seq, r.reason, r.lat, r.device_id) for r in out.where("status = 'CONFIRMED'").collect()}
    asked = lifecycle.dispatches(fell, done, 15.0)
    early = {(r.event_id, r.seq) for r in out.where("status = 'NOT_OPEN'").collect()}
    assert sent == {(r.event_id, r.dispatched_at, r.dispatch_seq, r.reason, r.location_lat, r.device_id) for r in asked.collect()}
    before = {e[0]: e[1] for e in falls}
    assert early - {(99, 999)} == {(a[0], a[2]) for a in acts if a[1] < before[a[0]]}


def test_late_rows_and_forgotten_falls(spark, tmp_path):
    def row(event, at, seq, what):
        return (event, T0 + timedelta(seconds=at), seq, what, None, None, None, 7, "d", 0.5, "HIGH")

    batches = [[row(b * 10 + i, b * 100 + i, 1, "FALL") for i in range(10)] for b in range(8)]
    batches[3] += [row(900, 150, 2, "FALL"), row(20, 209, 3, "OK")]  # watermark 199: the first is late
    batches[5] += [row(900, 500, 4, "OK"), row(1, 500, 5, "HELP")]  # never opened; forgotten after 300 seconds
    batches[6] += [row(41, 600, 6, "HELP")]
    changes = jobs.confirmations(feed(spark, tmp_path, batches, LOG), 15.0, "10 seconds", keep=300.0)
    tables = sinks.BatchTables(spark, str(tmp_path / "t"))
    users = spark.createDataFrame([(7, "Ann", "Bob", "+1")], "id long, name string, emergency_contact_name string, emergency_contact_phone string")
    query = jobs.run_batches(changes, tables.sink(sinks.confirmation_tables(users)), str(tmp_path / "t"))
    aside = {(r.event_id, r.seq, r.code) for r in tables.read("rejects").collect()}
    assert aside == {(900, 2, "LATE"), (900, 4, "NOT_OPEN"), (1, 5, "NOT_OPEN")}
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    assert max(held) < 300 and held[-1] <= held[5]  # falls, alarms and timers of about 300 seconds
    alerts = {(r.event_id, r.reason): r for r in tables.read("alerts").collect()}
    assert alerts[41, "MANUAL_HELP_REQUEST"].message == "CRITICAL: Confirmed Fall for Ann on d. Emergency contact notified."
    assert alerts[0, "TIMEOUT"].emergency_contact == "Bob (+1)" and (20, "TIMEOUT") not in alerts
    kinds = Counter(json.loads(r.value)["type"] for r in tables.read("messages").collect())
    assert kinds["FALL_PENDING_CONFIRMATION"] == 80 and kinds["FALL_CONFIRMATION_RESOLVED"] == len(alerts) + 1


def test_connections(spark, tmp_path):
    def row(device, *seconds):
        return [(device, T0 + timedelta(seconds=s)) for s in seconds]

    batches = [row("a", 0, 5, 9) + row("b", 2), row("a", 12, 30, 31), row("b", 60) + row("a", 25), row("c", 61), row("c", 95)]
    seen = feed(spark, tmp_path, batches, "device string, ts timestamp")
    out = jobs.run_to_end(jobs.connections(seen, F.col("device"), 10.0, "5 seconds"), str(tmp_path / "o"))

    def at(t):
        return (t.replace(tzinfo=timezone.utc) - T0).total_seconds()

    got = {(r.stream_key, at(r.connected_at), at(r.last_seen), r.samples, r.connected) for r in jobs.sessions(out).collect()}
    assert got == {("a", 0, 12, 4, False), ("a", 30, 31, 2, False), ("b", 2, 2, 1, False), ("b", 60, 60, 1, False),
                   ("c", 61, 61, 1, False), ("c", 95, 95, 1, True)}
    told = sorted((r.kind, at(r.ts)) for r in out.where("stream_key = 'a' AND kind <> 'SEEN'").collect())
    assert told == [("CONNECTED", 0), ("CONNECTED", 30), ("DISCONNECTED", 22), ("DISCONNECTED", 41), ("LATE", 25)]
    messages = [json.loads(r.value)["data"] for r in writers.status_messages(out).where("stream_key = 'b'").orderBy("ts").collect()]
    assert [m["connected"] for m in messages] == [True, False, True, False] and messages[1]["samples_received"] == 1


def test_cooldown_keeps_columns(spark, tmp_path):
    batches = [[("d", T0, 1, None, 2**60 + 1), ("d", T0 + timedelta(seconds=9), 2, 0.1, None)]]
    alerts = feed(spark, tmp_path, batches, "device_id string, ts timestamp, seq long, confidence double, big long")
    out = jobs.run_to_end(jobs.cooled_down(alerts, F.col("device_id"), 5.0), str(tmp_path / "o")).orderBy("seq").collect()
    assert [(r.clock, r.device_id, r.confidence, r.big) for r in out] == [("d", "d", None, 2**60 + 1), ("d", "d", 0.1, None)]


def test_ingest_tables(spark, tmp_path):
    good = '{"accelerometer":{"x":9.80665,"y":0,"z":0},"gyroscope":{"x":1,"y":0},"timestamp":5,"device_id":"p","location":{"lat":1,"lon":2}}'
    batches = [[(good, 1), ("{broken", 1), (good, 2), (None, 1)],
               [('{"type":"fall_confirmation","event_id":4,"action":"OK"}', 9), ('{"type":"ping"}', 1), ('{"accelerometer":{"x":1}}', 1)]]
    lines = feed(spark, tmp_path, batches, "value string, sender long")
    users = spark.createDataFrame([(1,), (1,)], "id long")
    judged = jobs.judged_packets(lines, users, F.col("sender"))
    tables = sinks.run_tables(judged, sinks.ingest_tables, str(tmp_path / "t"))
    assert [(r.user_id, r.acc_x, r.gyro_z, r.lat) for r in tables.read("samples").collect()] == [(1, pytest.approx(1.0), 0.0, 1.0)]
    rejects = Counter(r.code for r in tables.read("rejects").collect())
    assert rejects == {"MALFORMED_JSON": 2, "USER_NOT_FOUND": 1, "INVALID_PACKET": 1}
    assert [(r.event_id, r.action) for r in tables.read("responses").collect()] == [(4, "OK")]


def test_cooldown_across_batches(spark, tmp_path):
    batches = [[("d", T0 + timedelta(seconds=s), s) for s in part] for part in ([0, 3], [4, 5, 9], [10, 16])]
    alerts = feed(spark, tmp_path, batches, "device_id string, ts timestamp, seq long")
    out = jobs.run_to_end(jobs.cooled_down(alerts, F.col("device_id"), 5.0), str(tmp_path / "o"))
    assert sorted(r["seq"] for r in out.collect()) == [0, 5, 10, 16]


def test_ingest(spark, tmp_path):
    texts = [
        ('{"accelerometer":{"x":9.80665,"y":0,"z":0},"gyroscope":{"x":1,"y":0,"z":0},"timestamp":1700000000500,'
         '"device_id":"p"}', 1),
        ('{"accelerometer":{"x":1,"y":0,"z":0},"gyroscope":{"x":1,"y":0,"z":0},"timestamp":1,"device_id":"p"}', 2),
        ("{broken", 1), ('{"type":"fall_confirmation","event_id":4,"action":"OK"}', 1),
    ]
    lines = feed(spark, tmp_path, [texts], "value string, sender long")
    users = spark.createDataFrame([(1,)], "id long")
    kept, _ = jobs.ingest(lines, users, F.col("sender"))
    out = jobs.run_to_end(kept.select("user_id", "device_id", "ts", "acc_x"), str(tmp_path / "o")).collect()
    assert len(out) == 1 and out[0]["acc_x"] == pytest.approx(1.0)
    assert out[0]["ts"].timestamp() % 1 == pytest.approx(0.5)
    answers = jobs.responses(spark.createDataFrame(texts, "value string, sender long")).collect()
    assert [(r["event_id"], r["action"]) for r in answers] == [(4, "OK")]


def test_score_windows_keeps_windows_without_location(spark):
    from strideframe import schemas as S
    from strideframe.streaming import jobs

    axes = {a: [0.1 * i for i in range(16)] for a in S.AXES}
    rows = [("d1", 1, None, None, *axes.values()), ("d1", 2, 1.0, 2.0, *axes.values())]
    kind = "stream_key string, n long, lat double, lon double, " + ", ".join(f"{a} array<double>" for a in S.AXES)
    from pyspark.sql import functions as F

    windows = spark.createDataFrame(rows, kind).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))

    def scorer(made):
        return made.select("stream_key", "n", "ts", "lat", "lon", *S.FEATURE_COLUMNS)

    from strideframe.operators import features

    made = features.message_features(windows, ["stream_key", "n"], S.FEATURE_COLUMNS, meta=["ts", "lat", "lon"])
    assert sorted((r.n, r.lat) for r in scorer(made).collect()) == [(1, None), (2, 1.0)]
    assert jobs.score_windows(windows).count() == 2


def test_falls_share_their_state(spark, tmp_path):
    """What the state holds and is asked grows with the buckets, not with the falls: a call a fall took minutes."""
    def row(event, at, seq, what):
        return (event, T0 + timedelta(seconds=at), seq, what, None, None, None, 7, "d", 0.5, "HIGH")

    falls = [row(None if e == 0 else e, e / 100, 0, "FALL") for e in range(4000)]
    answers = [row(None if e == 0 else e, 45 + e / 100, 1, "OK") for e in range(0, 4000, 2)] + [row(9000, 50, 1, "HELP")]
    changes = jobs.confirmations(feed(spark, tmp_path, [falls, answers, [row(9999, 900, 9, "FALL")]], LOG), 60.0, "100 seconds")
    tables = sinks.BatchTables(spark, str(tmp_path / "t"))
    users = spark.createDataFrame([(7, "Ann", "Bob", "+1")], "id long, name string, emergency_contact_name string, emergency_contact_phone string")
    query = jobs.run_batches(changes, tables.sink(sinks.confirmation_tables(users)), str(tmp_path / "t"))
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) < 4000
    got = tables.read("changes").cache()
    assert Counter(r.status for r in got.collect()) == {"PENDING_CONFIRMATION": 4001, "CANCELLED_BY_USER": 2000, "CONFIRMED": 2000}
    assert {r.event_id for r in got.where("status = 'CONFIRMED'").collect()} == set(range(1, 4000, 2))
    assert got.where("event_id IS NULL AND status = 'CANCELLED_BY_USER'").count() == 1
    assert [(r.event_id, r.code) for r in tables.read("rejects").collect()] == [(9000, "NOT_OPEN")]
