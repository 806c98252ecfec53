"""The aggregate fold against a plain step-by-step replay of every event."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from strideframe.operators import lifecycle
from strideframe.operators.lifecycle import SAFE_NOTE, USER_ACKNOWLEDGER

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
FALL = ("event_id long, user_id long, device_id string, ts timestamp, confidence double, fall_probability double,"
        " ml_activity string, risk_level string, safety_override boolean, location_lat double, location_lon double,"
        " notes string")
ACTION = ("event_id long, ts timestamp, seq long, kind string, action string, by string, note string,"
          " lat double, lon double")


def fall(event, at=0, user=1, lat=None, lon=None):
    return (event, user, "phone", T0 + timedelta(seconds=at), 0.91, 0.8, "WALKING", "HIGH", True, lat, lon, "Opened.")


def act(event, at, seq, kind="response", action=None, by=None, note=None, lat=None, lon=None):
    return (event, T0 + timedelta(seconds=at), seq, kind, action, by, note, lat, lon)


def replay(start, acts, timeout=15):
    s = dict(status="PENDING_CONFIRMATION", confirmed=False, alert_sent=False, acknowledged=False, by=None, at=None,
             dispatches=0, lat=None, lon=None, notes=["Opened."], places=[])
    due = start + timedelta(seconds=timeout)

    def confirm():
        s.update(status="CONFIRMED", confirmed=True, alert_sent=True, dispatches=s["dispatches"] + 1)
        s["places"].append((s["lat"], s["lon"]))

    for a in sorted(acts, key=lambda a: (a[1], a[2])):
        if due is not None and a[1] >= due:
            due = None
            confirm()
        _, ts, _, kind, action, by, note, lat, lon = a
        if kind == "response":
            due = None
            what = action.upper().replace(" ", "_").replace("'", "")
            ok, need = what in ("I_AM_OK", "IM_OK", "OK", "SAFE", "CANCEL"), what in ("NEED_HELP", "HELP", "CONFIRM", "FALL")
            if ok or need:
                s["lat"], s["lon"] = lat if lat is not None else s["lat"], lon if lon is not None else s["lon"]
            if ok:
                s.update(status="CANCELLED_BY_USER", confirmed=False, acknowledged=True, by=USER_ACKNOWLEDGER, at=ts)
                s["notes"].append(SAFE_NOTE)
            elif need:
                confirm()
        elif kind == "acknowledge":
            s.update(status="ACKNOWLEDGED", acknowledged=True, by=by, at=ts)
            if note:
                s["notes"].append(f"[Caregiver Note]: {note}")
        else:
            s["notes"].append(f"[{ts:%Y-%m-%d %H:%M:%S}]: {note}")
    if due is not None:
        confirm()
    return s


@pytest.mark.parametrize("seed", range(2))
def test_outcomes_against_replay(spark, seed):
    draw = random.Random(seed)
    falls, acts = [], []
    for e in range(1, 121):
        falls.append(fall(e, at=e))
        for q in range(draw.randrange(6)):
            kind = draw.choice(["response", "response", "acknowledge", "note"])
            word = draw.choice(["I'm OK", "safe", "need help", "Confirm", "what?"]) if kind == "response" else None
            lat = draw.choice([None, round(draw.uniform(-60, 60), 3)])
            acts.append(act(e, e + draw.choice([0, 3, 14, 15, 16, 40]), 1000 * e + q, kind, word,
                            "op" if kind == "acknowledge" else None,
                            f"n{q}" if kind == "note" or draw.random() < 0.5 else "", lat, lat))
    f, a = spark.createDataFrame(falls, FALL), spark.createDataFrame(acts, ACTION)
    got = {r["event_id"]: r for r in lifecycle.event_outcomes(f, a).collect()}
    notes = {r["event_id"]: r["notes"] for r in lifecycle.note_text(lifecycle.note_lines(f, a)).collect()}
    sent = {}
    for r in lifecycle.dispatches(f, a).orderBy("dispatched_at", "dispatch_seq").collect():
        sent.setdefault(r["event_id"], []).append((r["location_lat"], r["location_lon"]))
    for row in falls:
        e = row[0]
        want, have = replay(row[3], [x for x in acts if x[0] == e]), got[e]
        for k in ("status", "confirmed", "alert_sent", "acknowledged", "dispatches"):
            assert have[k] == want[k], (e, k)
        assert (have["acknowledged_by"], have["location_lat"]) == (want["by"], want["lat"]), e
        assert notes[e] == "\n".join(want["notes"]), e
        assert sent.get(e, []) == want["places"], e


def outcome(spark, falls, acts):
    f = spark.createDataFrame(falls, FALL)
    a = spark.createDataFrame(acts, ACTION)
    return f, a, lifecycle.event_outcomes(f, a).first()


def test_safe_answer_sends_nothing(spark):
    f, a, r = outcome(spark, [fall(1)], [act(1, 4, 1, action="I_AM_OK")])
    assert (r["status"], r["acknowledged"], r["dispatches"]) == ("CANCELLED_BY_USER", True, 0)
    assert lifecycle.dispatches(f, a).count() == 0


def test_help_with_contact_and_location(spark):
    f, a, r = outcome(spark, [fall(1)], [act(1, 4, 1, action="NEED_HELP", lat=37.7749, lon=-122.4194)])
    users = spark.createDataFrame([(1, "Ada", "Grace", "+1999")],
                                  "id long, name string, emergency_contact_name string, emergency_contact_phone string")
    row = lifecycle.outbox(lifecycle.contact_snapshot(lifecycle.dispatches(f, a), users)).first()
    assert (r["status"], r["alert_sent"], r["reason"]) == ("CONFIRMED", True, "MANUAL_HELP_REQUEST")
    assert row["emergency_contact"] == "Grace (+1999)" and "?q=37.7749,-122.4194" in row["sms_body"]
    assert row["alert_message"].startswith("CRITICAL: Confirmed Fall for Ada on phone.")


def test_no_answer_and_defaults(spark):
    f, a, r = outcome(spark, [fall(1, user=7)], [act(2, 1, 1, action="OK")])
    users = spark.createDataFrame([(8, "x", "", None)],
                                  "id long, name string, emergency_contact_name string, emergency_contact_phone string")
    row = lifecycle.contact_snapshot(lifecycle.dispatches(f, a), users).first()
    assert (r["status"], r["reason"]) == ("CONFIRMED", "TIMEOUT")
    assert row["emergency_contact"] == "Designated Caregiver (+15550199)"
    waiting = lifecycle.event_outcomes(f, a, as_of=F.lit(T0 + timedelta(seconds=14))).first()
    assert waiting["status"] == "PENDING_CONFIRMATION"


def test_unknown_answer_strands_the_event(spark):
    assert outcome(spark, [fall(1)], [act(1, 2, 1, action="hm")])[2]["status"] == "PENDING_CONFIRMATION"


def test_late_ok_and_acknowledge_before_timer(spark):
    r = outcome(spark, [fall(1)], [act(1, 20, 1, action="OK")])[2]
    assert (r["status"], r["alert_sent"]) == ("CANCELLED_BY_USER", True)
    r = outcome(spark, [fall(1)], [act(1, 5, 1, kind="acknowledge", by="op")])[2]
    assert (r["status"], r["acknowledged"], r["acknowledged_by"]) == ("CONFIRMED", True, "op")


def test_answers_before_the_fall_do_not_count(spark):
    from pyspark.sql import functions as F

    from strideframe.operators import lifecycle

    at = lambda s: F.expr(f"timestamp'2024-01-01 00:00:00' + interval {s} seconds")
    falls = spark.range(1).select(F.lit(1).cast("long").alias("event_id"), at(10).alias("ts"))
    early = spark.range(1).select(
        F.lit(1).cast("long").alias("event_id"), at(5).alias("ts"), F.lit(1).cast("long").alias("seq"),
        F.lit("response").alias("kind"), F.lit("OK").alias("action"),
    )
    assert lifecycle.first_resolution(falls, early, 15.0).first()["resolution"] == "TIMEOUT"
