"""Monitoring: history pages, device status, connectivity, the summary."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators import devices, history, lifecycle
from strideframe.plans import sql_parts as Q
from strideframe.plans.lifecycle_queries import OUTCOMES_SQL
from strideframe.plans.registry import query
from strideframe.plans.sensor_queries import samples
from strideframe.plans.views import SENSOR_ORDER, actions, events, falls, predictions, table, users
from strideframe.schemas import FALL_EVENTS
from strideframe.session import cut
from strideframe.sources import readers, writers

# The reference day of "today" questions is always given, never taken from the clock.
AS_OF = datetime(2024, 1, 20, 15, 30)
AS_OF_SQL = "TIMESTAMP '2024-01-20 15:30:00'"
TIMEOUT = 6 * 3600.0


def fall_events(spark: SparkSession, sf: str) -> DataFrame:
    out = lifecycle.event_outcomes(falls(spark, sf), actions(spark, sf), TIMEOUT)
    return out.withColumnsRenamed({"event_id": "id", "ts": "timestamp"})


def _alerts(spark: SparkSession, sf: str, acts: DataFrame, outcomes: DataFrame) -> DataFrame:
    sent = lifecycle.dispatches(falls(spark, sf), acts, TIMEOUT, outcomes=outcomes)
    sent = lifecycle.outbox(lifecycle.contact_snapshot(sent, users(spark, sf)))
    first = lifecycle.alert_acknowledgements(sent, acts)
    one = F.struct("dispatched_at", "dispatch_seq")
    # Only an event's first alert is ever acknowledged.
    return sent.join(
        first.select("event_id", F.col("created_at").alias("dispatched_at"), "acknowledged_at"),
        ["event_id", "dispatched_at"], "left",
    ).select(
        F.xxhash64("event_id", one).alias("id"), F.col("event_id").alias("fall_event_id"), "alert_type",
        F.col("alert_message").alias("message"), F.col("dispatched_at").alias("created_at"), "acknowledged_at",
    )


_PRED_COLS = ["id", "timestamp", "activity", "confidence", "risk_level", "is_fall", "device_id"]


@query(
    "activity_history_page",
    f"""WITH {Q.PREDICTIONS} SELECT {", ".join(_PRED_COLS)} FROM predictions
WHERE activity = 'SITTING' AND risk_level = 'LOW' ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 20""",
)
def activity_history_page(spark: SparkSession, sf: str) -> DataFrame:
    found = history.matches(predictions(spark, sf), activity="sitting", risk_level="low")
    return history.page(found, limit=50, offset=20, most=500).select(*_PRED_COLS)


@query(
    "fall_history_page",
    f"""WITH {OUTCOMES_SQL} SELECT event_id AS id, user_id, ts AS timestamp, status, acknowledged FROM outcomes
WHERE status = 'CONFIRMED' ORDER BY timestamp DESC, id DESC LIMIT 50""",
)
def fall_history_page(spark: SparkSession, sf: str) -> DataFrame:
    return history.page(history.matches(fall_events(spark, sf), status="confirmed"), most=200).select(
        "id", "user_id", "timestamp", "status", "acknowledged"
    )


@query(
    "fall_detail",
    f"""WITH {OUTCOMES_SQL} SELECT event_id AS id, user_id, ts AS timestamp, status, confirmed FROM outcomes
WHERE event_id = (SELECT max(event_id) FROM falls)""",
)
def fall_detail(spark: SparkSession, sf: str) -> DataFrame:
    newest = falls(spark, sf).agg(F.max("event_id")).scalar()
    return history.lookup(fall_events(spark, sf), newest).select("id", "user_id", "timestamp", "status", "confirmed")


@query(
    "falls_today",
    f"""WITH {Q.FALLS} SELECT event_id, ts FROM falls WHERE ts >= date_trunc('day', {AS_OF_SQL})""",
)
def falls_today(spark: SparkSession, sf: str) -> DataFrame:
    return history.since_midnight(falls(spark, sf), F.lit(AS_OF), "ts").select("event_id", "ts")


@query(
    "unacknowledged_falls",
    f"WITH {OUTCOMES_SQL} SELECT event_id AS id, status FROM outcomes WHERE NOT acknowledged",
)
def unacknowledged_falls(spark: SparkSession, sf: str) -> DataFrame:
    return fall_events(spark, sf).where(~F.col("acknowledged")).select("id", "status")


@query(
    "latest_prediction",
    f"WITH {Q.PREDICTIONS} SELECT id, timestamp, activity, confidence FROM predictions ORDER BY timestamp DESC, id DESC LIMIT 1",
)
def latest_prediction(spark: SparkSession, sf: str) -> DataFrame:
    return history.latest(predictions(spark, sf), ["id", "timestamp", "activity", "confidence"])


@query(
    "dashboard_summary",
    f"""WITH {OUTCOMES_SQL}, {Q.PREDICTIONS},
newest AS (SELECT * FROM predictions ORDER BY timestamp DESC, id DESC LIMIT 1),
open_alerts AS (
  SELECT s.event_id, s.ts FROM steps s WHERE s.what IN ('HELP', 'TIMEOUT') AND NOT (
    s.step = (SELECT min(x.step) FROM steps x WHERE x.event_id = s.event_id AND x.what IN ('HELP', 'TIMEOUT'))
    AND EXISTS (SELECT 1 FROM steps k WHERE k.event_id = s.event_id AND k.what = 'ACK' AND k.step > s.step))
)
SELECT n.activity AS current_activity, round(n.confidence, 4) AS current_confidence, n.risk_level AS current_risk,
  'ONLINE' AS system_status, TRUE AS sensor_connected,
  (SELECT count(*) FROM predictions) AS total_activities_count, (SELECT count(*) FROM falls) AS total_falls_count,
  (SELECT count(*) FROM falls WHERE ts >= date_trunc('day', {AS_OF_SQL})) AS falls_today_count,
  (SELECT count(*) FROM outcomes WHERE NOT acknowledged) AS unacknowledged_falls_count,
  (SELECT max(ts) FROM falls) AS last_fall_timestamp,
  (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC) FROM
    (SELECT * FROM open_alerts ORDER BY ts DESC LIMIT 5)) AS active_alerts,
  (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY timestamp DESC) FROM
    (SELECT * FROM predictions ORDER BY timestamp DESC, id DESC LIMIT 15)) AS recent_activities
FROM newest n""",
)
def dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    # The action log and the outcomes are read by several parts of the summary: made once.
    acts = cut(actions(spark, sf))
    outcomes = cut(lifecycle.event_outcomes(falls(spark, sf), acts, TIMEOUT))
    fell = outcomes.withColumnsRenamed({"event_id": "id", "ts": "timestamp"})
    status = devices.device_status(events(spark, sf).withColumn("device_id", F.col("user_id") % 7))
    out = history.summary(predictions(spark, sf), fell, _alerts(spark, sf, acts, outcomes), status, F.lit(AS_OF))
    # The nested lists are shown by id so that the check can compare them as text.
    def ids(c: str, field: str):
        return F.array_join(F.transform(c, lambda x: x.getField(field).cast("string")), ",").alias(c)

    kept = [c for c in out.columns if c not in ("active_alerts", "recent_activities")]
    return out.select(*kept, ids("active_alerts", "fall_event_id"), ids("recent_activities", "id"))


@query(
    "device_status",
    f"""WITH {Q.RAW},
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, device_id ORDER BY ts, seq_a, seq_b, seq_c) AS rn FROM samples)
SELECT user_id, device_id, count(*) AS samples_received, least(count(*), 250) AS buffer_samples, 250 AS max_buffer_samples,
  round(least(count(*), 250) / CAST(50 AS DOUBLE), 2) AS buffer_seconds, max(ts) AS last_seen,
  date_diff('second', max(ts), TIMESTAMP '2001-12-30 00:00:00') <= 30 * 86400 AS connected,
  arg_max(seq_c, rn) FILTER (WHERE seq_b = 1) AS last_location,
  count(*) FILTER (WHERE seq_b = 1) > 0 AS has_location
FROM t WHERE user_id = 7 OR user_id IS NULL GROUP BY user_id, device_id""",
)
def device_status(spark: SparkSession, sf: str) -> DataFrame:
    df = samples(spark, sf).withColumn("loc", F.when(F.col("seq_b") == 1, F.col("seq_c")))
    mine = devices.visible_to(df, 7)
    return devices.device_status(
        mine, SENSOR_ORDER, F.lit(datetime(2001, 12, 30)), silent_after=30 * 86400.0, location="loc"
    )


@query(
    "stream_keys",
    f"""WITH {Q.RAW} SELECT coalesce(CAST(user_id AS VARCHAR), 'anon') || '_' || device_id AS stream_key,
  count(*) AS samples FROM samples GROUP BY 1""",
)
def stream_keys(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).groupBy(devices.stream_key().alias("stream_key")).agg(F.count(F.lit(1)).alias("samples"))


@query(
    "device_connectivity",
    """WITH g AS (SELECT *, row_number() OVER o AS rn,
    CASE WHEN lag(ts) OVER o IS NULL OR ts - lag(ts) OVER o >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS opens
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY rn) AS session_no FROM g)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS connected_at, max(ts) AS last_seen,
  count(*) AS samples FROM n GROUP BY user_id, session_no""",
)
def device_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    return devices.connectivity(events(spark, sf), ["user_id"], ["ts", "event_id"], 12 * 3600.0)


@query(
    "activity_frequencies",
    f"WITH {Q.PREDICTIONS} SELECT activity, count(*) AS n FROM predictions GROUP BY activity ORDER BY n DESC, activity",
)
def activity_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return history.value_counts(predictions(spark, sf), "activity")


@query(
    "distinct_counts",
    """SELECT count(*) AS samples, count(DISTINCT l_suppkey) AS subjects, count(DISTINCT l_returnflag) AS activities,
  count(DISTINCT l_orderkey) AS windows FROM lineitem""",
)
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("l_suppkey").alias("subjects"),
        F.countDistinct("l_returnflag").alias("activities"), F.countDistinct("l_orderkey").alias("windows"),
    )


@query(
    "registered_user_samples",
    f"""WITH {Q.USERS} SELECT e.event_id, CASE WHEN u.id IS NULL THEN 'USER_NOT_FOUND' END AS code
FROM events e LEFT JOIN users u ON u.id = CASE WHEN e.event_id % 7 = 0 THEN -e.user_id ELSE e.user_id END""",
)
def registered_user_samples(spark: SparkSession, sf: str) -> DataFrame:
    # Every customer is registered; the samples of some events carry ids that nobody has.
    sent = events(spark, sf).withColumn(
        "user_id", F.when(F.col("event_id") % 7 == 0, -F.col("user_id")).otherwise(F.col("user_id"))
    )
    known, unknown = readers.known_users(sent, users(spark, sf))
    return known.select("event_id", F.lit(None).cast("string").alias("code")).unionByName(
        unknown.select("event_id", "code")
    )


@query(
    "activity_update_messages",
    f"""WITH {Q.PREDICTIONS} SELECT 'ACTIVITY_UPDATE' AS type, 'monitors' AS audience,
  '{{"type":"ACTIVITY_UPDATE","data":{{"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","activity":"' || activity
  || '","confidence":' || confidence || ',"risk_level":"' || risk_level || '","is_fall":'
  || is_fall || ',"device_id":"' || device_id || '","user_id":' || user_id || '}}}}' AS value FROM predictions""",
)
def activity_update_messages(spark: SparkSession, sf: str) -> DataFrame:
    return writers.activity_messages(predictions(spark, sf))


@query(
    "schema_alignment",
    """SELECT event_id AS id, user_id, 'FALL' AS activity, CAST(NULL AS DOUBLE) AS location_lat, FALSE AS confirmed,
  '1.0.0' AS model_version FROM events WHERE event_type = 'error'""",
)
def schema_alignment(spark: SparkSession, sf: str) -> DataFrame:
    old = events(spark, sf).where("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id")
    aligned = readers.align(old, FALL_EVENTS, {"activity": "FALL", "confirmed": False, "model_version": "1.0.0"})
    return aligned.select("id", "user_id", "activity", "location_lat", "confirmed", "model_version")


@query(
    "pending_fall_events",
    f"""WITH {Q.PREDICTIONS} SELECT id, timestamp, device_id, user_id, 'FALL' AS activity, round(confidence, 4) AS confidence,
  round((id % 997) / CAST(1000 AS DOUBLE), 4) AS fall_probability, 'PENDING_CONFIRMATION' AS status, FALSE AS confirmed,
  FALSE AS alert_sent, FALSE AS acknowledged, 'Potential fall detected. Awaiting user response (21600.0s timeout).' AS notes
FROM predictions WHERE is_fall""",
)
def pending_fall_events(spark: SparkSession, sf: str) -> DataFrame:
    """The event that every prediction of a fall opens."""
    scored = predictions(spark, sf).withColumn("ml_fall_probability", (F.col("id") % 997) / 1000.0)
    return lifecycle.pending_falls(scored, TIMEOUT).select(
        "id", "timestamp", "device_id", "user_id", "activity", "confidence", "fall_probability", "status", "confirmed",
        "alert_sent", "acknowledged", "notes",
    )
