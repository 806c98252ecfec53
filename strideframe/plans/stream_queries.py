"""The streaming jobs over the given tables, which arrive slice by slice in time; checked like their batch twins."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators import cleaning, lifecycle
from strideframe.operators.windows import PHONE_RULE
from strideframe.plans import sql_parts as Q
from strideframe.plans.lifecycle_queries import TIMEOUT, outcomes_sql, sent_sql
from strideframe.plans.registry import query
from strideframe.plans.sensor_queries import packet_text
from strideframe.plans.views import SENSOR_ORDER, actions, events, falls, raw_sensor, users
from strideframe.session import shared_dir
from strideframe.sources import writers
from strideframe.streaming import jobs, sinks

SLICES = 4
ROWS_PER_FILE = 2_000_000


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_batches(spark: SparkSession, df: DataFrame, name: str, delay: str = "0", slices: int = SLICES) -> DataFrame:
    """A derived table as a file stream of ``slices`` micro-batches along ``ts``.

    ``delay``: an expression, by how many slices a row arrives late (at the last slice at the latest).
    """
    stage, folder = fresh(spark, f"{name}-slices"), fresh(spark, name)
    t = F.unix_micros("ts")
    df.withColumn("_delay", F.expr(delay).cast("long")).write.parquet(stage)
    kept = spark.read.parquet(stage)
    first, last = kept.agg(F.min(t), F.max(t)).first()
    if first is not None:
        number = F.floor((t - first) * slices / (last - first + 1)) + F.col("_delay")
        kept = kept.withColumn("_slice", F.least(number, F.lit(slices - 1)))
    else:
        kept = kept.withColumn("_slice", F.lit(0))
    largest = kept.groupBy("_slice").count().agg(F.max("count")).first()[0] or 0
    files = max(1, -(-largest // ROWS_PER_FILE))
    # One write after another: a file stream takes files in the order of their modification times.
    for k in range(slices):
        kept.where(F.col("_slice") == k).drop("_slice", "_delay").repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def batch_sql(source: str, delay: str = "0") -> str:
    """CTEs ``arrived`` (rows of ``source`` with their micro-batch) and ``marks`` (newest time before each batch)."""
    return f"""
arrived AS (
  SELECT s.*, least({SLICES - 1}, ((epoch_us(ts) - lo) * {SLICES}) // (hi - lo + 1) + {delay}) AS batch
  FROM {source} s, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM {source})),
marks AS (
  SELECT batch, max(max(epoch_ms(ts))) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
  FROM arrived GROUP BY batch)"""


# ---- device buffers


def sensor_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.normalise_units(raw_sensor(spark, sf)).select(
        F.lit(None).cast("long").alias("user_id"), "device_id", *SENSOR_ORDER, *S.AXES,
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
    )
    return as_batches(spark, rows, "samples")


def device_windows(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.device_windows(sensor_stream(spark, sf), PHONE_RULE, order=SENSOR_ORDER)


_WINDOW_SUMS = ", ".join(f"round(sum({a} * pos), 6) AS {a}" for a in S.AXES)


@query(
    "stream_device_windows",
    f"""WITH {Q.windowed(64, 25, "front")}
SELECT 'anon_' || device_id AS stream_key, win_end AS n, {_WINDOW_SUMS} FROM w GROUP BY device_id, win_end""",
)
def stream_device_windows(spark: SparkSession, sf: str) -> DataFrame:
    kept = jobs.run_to_end(device_windows(spark, sf).where("kind = 'window'"), fresh(spark, "windows"))

    def weighted(a: str):
        places = F.sequence(F.lit(1), F.size(a))
        return F.round(F.aggregate(F.zip_with(a, places, lambda x, p: x * p), F.lit(0.0), lambda s, x: s + x), 6).alias(a)

    return kept.select("stream_key", "n", *[weighted(a) for a in S.AXES])


@query(
    "stream_live_ticks",
    f"""WITH {Q.NUMBERED} SELECT 'anon_' || device_id AS stream_key, rn AS n, round(acc_x, 4) AS acc_x,
  round(gyro_z, 4) AS gyro_z FROM s WHERE rn % 2 = 0""",
)
def stream_live_ticks(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_to_end(device_windows(spark, sf).where("kind = 'tick'"), fresh(spark, "ticks"))
    return out.select(
        "stream_key", "n", *[F.bround(F.element_at(a, 1), 4).alias(a) for a in ("acc_x", "gyro_z")]
    )


@query(
    "stream_inference",
    f"""WITH {Q.windowed(64, 25, "front")}, f AS (
  SELECT device_id, win_end, max(acc_mag) > 2.8 AND max(gyro_mag) > 2.5 AS fall, max(acc_mag) AS a
  FROM w GROUP BY device_id, win_end)
SELECT 'anon_' || device_id AS device_id, CASE WHEN fall THEN 'FALL' ELSE 'WALKING' END AS activity,
  CASE WHEN fall THEN 'HIGH' WHEN a > 2.0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, count(*) AS n FROM f GROUP BY ALL""",
)
def stream_inference(spark: SparkSession, sf: str) -> DataFrame:
    tables = sinks.run_tables(device_windows(spark, sf), sinks.inference_tables(), fresh(spark, "inference"))
    return tables.read("audit").groupBy("device_id", "activity", "risk_level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_tick_messages",
    f"""WITH {Q.NUMBERED} SELECT 'SENSOR_TICK' AS type, 'monitors' AS audience, 'anon_' || device_id AS device_id, rn AS n,
  strftime(ts, '%H:%M:%S.%g') AS at, round(acc_y, 4) AS acc_y, round(acc_mag, 3) AS acc_magnitude,
  round(gyro_x, 4) AS gyro_x, 'REAL_PHONE' AS ground_truth
FROM s WHERE rn % 2 = 0""",
)
def stream_tick_messages(spark: SparkSession, sf: str) -> DataFrame:
    tables = sinks.run_tables(device_windows(spark, sf), sinks.inference_tables(), fresh(spark, "tick-messages"))
    body = F.from_json(
        "value", "data struct<timestamp string, acc_y double, acc_magnitude double, gyro_x double, ground_truth string, device_id string>"
    )["data"]
    return tables.read("ticks").withColumn("d", body).select(
        "type", "audience", "d.device_id", "n", F.col("d.timestamp").alias("at"), "d.acc_y", "d.acc_magnitude", "d.gyro_x", "d.ground_truth",
    )


# ---- confirmations

LATE_MS = 3_600_000
KEEP_DAYS = 10


def action_log(spark: SparkSession, sf: str) -> DataFrame:
    opened = falls(spark, sf).select(
        "event_id", "ts", F.lit(0).cast("long").alias("seq"), F.lit("FALL").alias("what"),
        F.col("location_lat").alias("lat"), F.col("location_lon").alias("lon"), "user_id", "device_id", "confidence",
        "risk_level", "ml_activity", "fall_probability", "safety_override",
    )
    acts = lifecycle.classified(actions(spark, sf)).where("what <> 'NOTE'").select("event_id", "ts", "seq", "what", "by", "lat", "lon")
    return opened.unionByName(acts, allowMissingColumns=True)


def confirmed_tables(spark: SparkSession, sf: str, delay: str = "0") -> sinks.BatchTables:
    log = as_batches(spark, action_log(spark, sf), "log", delay)
    changes = jobs.confirmations(log, TIMEOUT, f"{LATE_MS} milliseconds", KEEP_DAYS * 86400.0)
    return sinks.run_tables(changes, sinks.confirmation_tables(users(spark, sf), TIMEOUT), fresh(spark, "confirmations"))


# Rows take effect up to the last watermark, and a fall is known for KEEP_DAYS.
_LAST_MS = f"(SELECT max(epoch_ms(ts)) - {LATE_MS} FROM (SELECT ts FROM falls UNION ALL SELECT ts FROM actions WHERE what <> 'NOTE'))"
_SETTLED = f"make_timestamp({_LAST_MS} * 1000)"
_KNOWN = f"ts < fall_ts + INTERVAL {KEEP_DAYS} DAY"


@query("stream_confirmations", f"WITH {outcomes_sql(_SETTLED, _KNOWN)} SELECT event_id, status, lat, lon FROM outcomes")
def stream_confirmations(spark: SparkSession, sf: str) -> DataFrame:
    changes = confirmed_tables(spark, sf).read("changes")
    # A timer has seq -1: at the same instant it precedes the answer.
    place = F.struct("ts", "seq")
    return changes.groupBy("event_id").agg(*[F.max_by(c, place).alias(c) for c in ("status", "lat", "lon")])


_LATE_BY = "CASE WHEN (event_id + seq) % 7 = 0 THEN 2 ELSE 0 END"


@query(
    "stream_late_rows",
    f"""WITH {Q.FALLS}, {Q.ACTIONS},
log AS (SELECT event_id, ts, 0 AS seq, 'FALL' AS what FROM falls
  UNION ALL SELECT event_id, ts, seq, what FROM actions WHERE what <> 'NOTE'),{batch_sql("log", _LATE_BY)},
judged AS (SELECT a.*, coalesce(epoch_us(ts) <= (newest - {LATE_MS}) * 1000, FALSE) AS late FROM arrived a JOIN marks USING (batch)),
opened AS (SELECT event_id, ts AS fall_ts FROM judged WHERE what = 'FALL' AND NOT late)
SELECT 'LATE' AS code, what, count(*) AS n FROM judged WHERE late GROUP BY ALL
UNION ALL
SELECT 'NOT_OPEN', what, count(*) FROM judged j LEFT JOIN opened o USING (event_id)
WHERE NOT late AND what <> 'FALL' AND ts <= {_SETTLED} AND (fall_ts IS NULL OR ts >= fall_ts + INTERVAL {KEEP_DAYS} DAY) GROUP BY ALL""",
)
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh row arrives two slices late: rows behind the watermark, and answers to falls it took away."""
    return confirmed_tables(spark, sf, _LATE_BY).read("rejects").groupBy("code", "what").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_alerts",
    f"""WITH {sent_sql(Q.timeline(_SETTLED, _KNOWN))}
SELECT event_id, dispatched_at AS created_at, dispatch_seq AS seq, 'CRITICAL_FALL' AS alert_type, reason,
  'CRITICAL: Confirmed Fall for ' || user_name || ' on ' || device_id || '. Emergency contact notified.' AS message,
  contact_name || ' (' || contact_phone || ')' AS emergency_contact, lat AS location_lat, lon AS location_lon
FROM sent""",
)
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return confirmed_tables(spark, sf).read("alerts").drop("contact_message")


@query(
    "stream_fall_messages",
    f"""WITH {Q.timeline(_SETTLED, _KNOWN)},
told AS (
  SELECT event_id, ts, 0 AS seq, 'FALL_PENDING_CONFIRMATION' AS type, '{{"type":"FALL_PENDING_CONFIRMATION","event":{{"id":' || event_id
    || ',"event_id":' || event_id || ',"device_id":"' || device_id || '","user_id":' || user_id || ',"timestamp":"'
    || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","confidence":' || round(confidence, 4) || ',"risk_level":"HIGH","timeout_seconds":21600.0'
    || ',"safety_override":' || (event_id % 2 = 0) || ',"ml_activity":"WALKING","ml_fall_probability":' || round(fall_probability, 4)
    || ',"message":"Possible fall detected. Are you okay?"}}}}' AS value FROM falls
  UNION ALL
  SELECT s.event_id, s.ts, s.seq, 'FALL_CONFIRMATION_RESOLVED', '{{"type":"FALL_CONFIRMATION_RESOLVED","data":{{"event_id":' || s.event_id
    || CASE WHEN what = 'OK' THEN ',"status":"CANCELLED_BY_USER","device_id":"' || device_id || '","message":"User confirmed safe. Alert cancelled."'
       ELSE ',"status":"CONFIRMED","device_id":"' || device_id || '","reason":"' || r || '","message":"Fall confirmed (' || r
         || '). Emergency alert dispatched."' END || '}}}}'
  FROM (SELECT *, CASE what WHEN 'HELP' THEN 'MANUAL_HELP_REQUEST' ELSE what END AS r FROM steps) s JOIN falls f USING (event_id)
  WHERE what IN ('OK', 'HELP', 'TIMEOUT'))
SELECT event_id, ts, seq, type, 'monitors,devices' AS audience, value FROM told""",
)
def stream_fall_messages(spark: SparkSession, sf: str) -> DataFrame:
    return confirmed_tables(spark, sf).read("messages")


# ---- direct alerts


def direct_tables(spark: SparkSession, sf: str) -> sinks.BatchTables:
    fell = falls(spark, sf).select(
        "event_id", "ts", F.col("event_id").alias("seq"), "device_id", "confidence", "fall_probability", "risk_level",
        F.lit(None).cast("string").alias("notes"),
    )
    taken = jobs.cooled_down(as_batches(spark, fell, "direct"), F.col("device_id"), 7200.0)
    return sinks.run_tables(taken, sinks.direct_alert_tables, fresh(spark, "direct-alerts"))


_WALK = f"""{Q.FALLS},
r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS k FROM falls),
walk AS (
  SELECT device_id, k, event_id, ts, ts AS last, TRUE AS take FROM r WHERE k = 1
  UNION ALL
  SELECT r.device_id, r.k, r.event_id, r.ts, CASE WHEN r.ts - w.last >= INTERVAL 2 HOUR THEN r.ts ELSE w.last END,
    r.ts - w.last >= INTERVAL 2 HOUR
  FROM walk w JOIN r ON r.device_id = w.device_id AND r.k = w.k + 1
)"""


@query("stream_cooldown", f"WITH RECURSIVE {_WALK} SELECT device_id AS clock, ts, event_id AS seq FROM walk WHERE take")
def stream_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    alerts = as_batches(spark, falls(spark, sf).select("device_id", "ts", F.col("event_id").alias("seq")), "alerts")
    return jobs.run_to_end(jobs.cooled_down(alerts, F.col("device_id"), 7200.0), fresh(spark, "cooldown")).select("clock", "ts", "seq")


@query(
    "stream_alert_messages",
    f"""WITH RECURSIVE {_WALK}
SELECT f.event_id, f.ts, 'FALL_ALERT' AS type, 'monitors,devices' AS audience,
  '{{"type":"FALL_ALERT","event":{{"id":' || f.event_id || ',"timestamp":"' || strftime(f.ts, '%Y-%m-%dT%H:%M:%S.%f')
    || '+00:00","confidence":' || round(confidence, 4) || ',"risk_level":"HIGH","status":"UNACKNOWLEDGED","device_id":"' || f.device_id
    || '","message":"[FALL DETECTED] on ' || f.device_id || '! Confidence: ' || format('{{:.1f}}', confidence * 100)
    || '%, Risk: HIGH"}}}}' AS value
FROM walk w JOIN falls f USING (event_id) WHERE take""",
)
def stream_alert_messages(spark: SparkSession, sf: str) -> DataFrame:
    return direct_tables(spark, sf).read("messages")


@query(
    "stream_system_logs",
    f"""WITH RECURSIVE {_WALK.replace(Q.FALLS + ",", Q.timeline(_SETTLED, _KNOWN) + ",")}
SELECT ts AS timestamp, 'INFO' AS level, 'FALL_ACKNOWLEDGED' AS event,
  'Fall event #' || event_id || ' acknowledged by ' || "by" || '.' AS message FROM steps WHERE what = 'ACK'
UNION ALL
SELECT w.ts, 'ALERT', 'FALL_DETECTED', 'Fall event #' || f.event_id || ' registered for ' || f.device_id || '. Confidence: '
  || format('{{:.1f}}', confidence * 100) || '%' FROM walk w JOIN falls f USING (event_id) WHERE take""",
)
def stream_system_logs(spark: SparkSession, sf: str) -> DataFrame:
    return confirmed_tables(spark, sf).read("logs").unionByName(direct_tables(spark, sf).read("logs"))


# ---- connections

GAP_HOURS = 12


def connected_tables(spark: SparkSession, sf: str) -> sinks.BatchTables:
    seen = as_batches(spark, events(spark, sf).select("user_id", "ts"), "seen")
    changes = jobs.connections(seen, F.col("user_id"), GAP_HOURS * 3600.0, f"{LATE_MS} milliseconds")
    return sinks.run_tables(changes, sinks.status_tables, fresh(spark, "connections"))


_SESSIONS = f"""g AS (SELECT *, CASE WHEN lag(ts) OVER o IS NULL OR ts - lag(ts) OVER o >= INTERVAL {GAP_HOURS} HOUR THEN 1 ELSE 0 END
    AS opens FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM g),
sessions AS (
  SELECT user_id, min(ts) AS connected_at, max(ts) AS last_seen, count(*) AS samples,
    session_no = max(session_no) OVER (PARTITION BY user_id)
      AND max(ts) + INTERVAL {GAP_HOURS} HOUR > (SELECT make_timestamp((max(epoch_ms(ts)) - {LATE_MS}) * 1000) FROM events) AS connected
  FROM n GROUP BY user_id, session_no)"""


@query(
    "stream_connection_sessions",
    f"WITH {_SESSIONS} SELECT user_id, connected_at, last_seen, samples, connected FROM sessions",
)
def stream_connection_sessions(spark: SparkSession, sf: str) -> DataFrame:
    made = jobs.sessions(connected_tables(spark, sf).read("changes"))
    return made.select(F.col("stream_key").cast("long").alias("user_id"), "connected_at", "last_seen", "samples", "connected")


@query(
    "stream_status_messages",
    f"""WITH {_SESSIONS}, told AS (
  SELECT user_id, connected_at AS ts, TRUE AS up, connected_at AS seen, 0 AS samples FROM sessions
  UNION ALL SELECT user_id, last_seen + INTERVAL {GAP_HOURS} HOUR, FALSE, last_seen, samples FROM sessions WHERE NOT connected)
SELECT CAST(user_id AS VARCHAR) AS stream_key, ts, 'DEVICE_STATUS_UPDATE' AS type, 'monitors' AS audience,
  '{{"type":"DEVICE_STATUS_UPDATE","data":{{"device_id":"' || user_id || '","connected":' || up || ',"last_seen":"'
    || strftime(seen, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00"' || CASE WHEN up THEN '' ELSE ',"samples_received":' || samples END || '}}}}' AS value
FROM told""",
)
def stream_status_messages(spark: SparkSession, sf: str) -> DataFrame:
    return connected_tables(spark, sf).read("messages")


# ---- ingest

_SENDER = "CASE WHEN user_id % 7 = 3 THEN user_id + 100000000 ELSE user_id + 1 END"


def ingested(spark: SparkSession, sf: str) -> sinks.BatchTables:
    lines = as_batches(spark, packet_text(spark, sf).withColumn("sender", F.expr(_SENDER)).drop("packet_no", "user_id"), "packets")
    judged = jobs.judged_packets(lines.select("value", "sender"), users(spark, sf), F.col("sender"))
    return sinks.run_tables(judged, sinks.ingest_tables, fresh(spark, "ingest"))


_JUDGED = f"""judged AS (
  SELECT *, CASE WHEN k = 4 THEN 'MALFORMED_JSON' WHEN k IN (0, 1, 2) THEN 'INVALID_PACKET'
    WHEN k IN (3, 5, 9, 10, 11, 12) AND c_custkey IS NULL THEN 'USER_NOT_FOUND' END AS code
  FROM (SELECT *, event_id % 13 AS k, {_SENDER} AS sender FROM events) LEFT JOIN customer ON c_custkey = sender)"""


@query(
    "stream_ingested_samples",
    f"""WITH {_JUDGED}
SELECT sender AS user_id, 'dev_' || (user_id % 7) AS device_id, make_timestamp(event_id * 20 * 1000000) AS ts,
  round(value / CASE WHEN k = 9 THEN 1 ELSE CAST(9.80665 AS DOUBLE) END, 6) AS acc_x,
  CAST(CASE WHEN k = 3 THEN 0 ELSE 0.5 END AS DOUBLE) AS gyro_y, CASE WHEN k > 10 THEN CAST(37.5 AS DOUBLE) END AS lat
FROM judged WHERE k IN (3, 5, 9, 10, 11, 12) AND code IS NULL""",
)
def stream_ingested_samples(spark: SparkSession, sf: str) -> DataFrame:
    return ingested(spark, sf).read("samples").select(
        "user_id", "device_id", "ts", F.round("acc_x", 6).alias("acc_x"), "gyro_y", "lat"
    )


@query(
    "stream_ingest_rejects",
    f"WITH {_JUDGED} SELECT sender AS user_id, code, count(*) AS n FROM judged WHERE code IS NOT NULL GROUP BY ALL",
)
def stream_ingest_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return ingested(spark, sf).read("rejects").groupBy("user_id", "code").agg(F.count(F.lit(1)).alias("n"))
