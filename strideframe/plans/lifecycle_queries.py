"""Fall events, responses, escalation and notes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators import cooldown, lifecycle
from strideframe.plans import sql_parts as Q
from strideframe.plans.registry import query
from strideframe.plans.views import actions, events, falls, users
from strideframe.sources import writers

TIMEOUT = 6 * 3600.0

_FOLD_SQL = """
folded AS (
  SELECT event_id,
    arg_max(what, step) FILTER (WHERE what IN ('OK', 'HELP', 'ACK', 'TIMEOUT')) AS last_status,
    arg_max(what, step) FILTER (WHERE what IN ('OK', 'HELP', 'TIMEOUT')) AS last_confirm,
    max(step) FILTER (WHERE what IN ('OK', 'ACK')) AS last_ack,
    count(*) FILTER (WHERE what IN ('HELP', 'TIMEOUT')) AS dispatches,
    bool_or(what = 'TIMEOUT') AS timed_out,
    arg_max(lat, step) FILTER (WHERE what IN ('OK', 'HELP') AND lat IS NOT NULL) AS lat,
    arg_max(lon, step) FILTER (WHERE what IN ('OK', 'HELP') AND lon IS NOT NULL) AS lon
  FROM steps GROUP BY event_id
),
outcomes AS (
  SELECT f.*,
    CASE x.last_status WHEN 'OK' THEN 'CANCELLED_BY_USER' WHEN 'ACK' THEN 'ACKNOWLEDGED'
      WHEN 'HELP' THEN 'CONFIRMED' WHEN 'TIMEOUT' THEN 'CONFIRMED' ELSE 'PENDING_CONFIRMATION' END AS status,
    coalesce(x.last_confirm IN ('HELP', 'TIMEOUT'), FALSE) AS confirmed,
    coalesce(x.timed_out, FALSE) AS timed_out,
    coalesce(x.dispatches, 0) AS dispatches,
    x.last_ack IS NOT NULL AS acknowledged, s.ts AS acknowledged_at,
    CASE WHEN s.what = 'OK' THEN 'User (Smartphone)' ELSE s."by" END AS acknowledged_by,
    coalesce(x.lat, f.location_lat) AS lat, coalesce(x.lon, f.location_lon) AS lon
  FROM opened f LEFT JOIN folded x USING (event_id) LEFT JOIN steps s ON s.event_id = f.event_id AND s.step = x.last_ack
)"""

OUTCOMES_SQL = f"{Q.timeline()},{_FOLD_SQL}"


def outcomes_sql(as_of: str, keep: str) -> str:
    """The same as known at ``as_of``, by actions for which ``keep`` holds."""
    return f"{Q.timeline(as_of, keep)},{_FOLD_SQL}"


@query(
    "fall_event_outcomes",
    f"""WITH {OUTCOMES_SQL}
SELECT event_id, status, confirmed, timed_out, CAST(dispatches AS BIGINT) AS dispatches, dispatches > 0 AS alert_sent,
  acknowledged, acknowledged_at, acknowledged_by, lat AS location_lat, lon AS location_lon FROM outcomes""",
)
def fall_event_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.event_outcomes(falls(spark, sf), actions(spark, sf), TIMEOUT).select(
        "event_id", "status", "confirmed", "timed_out", "dispatches", "alert_sent", "acknowledged", "acknowledged_at",
        "acknowledged_by", "location_lat", "location_lon",
    )


@query(
    "first_response_resolution",
    f"""WITH {Q.FALLS}, {Q.ACTIONS},
r AS (
  SELECT f.event_id, a.what, a.ts, row_number() OVER (PARTITION BY f.event_id ORDER BY a.ts, a.seq) AS k
  FROM falls f JOIN actions a ON a.event_id = f.event_id AND a.kind = 'response'
    AND a.ts >= f.ts AND a.ts < f.ts + INTERVAL 6 HOUR
)
SELECT f.event_id, coalesce(r.what, 'TIMEOUT') AS resolution, coalesce(r.ts, f.ts + INTERVAL 6 HOUR) AS resolved_at
FROM falls f LEFT JOIN r ON r.event_id = f.event_id AND r.k = 1""",
)
def first_response_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.first_resolution(falls(spark, sf), actions(spark, sf), TIMEOUT)


_DISPATCHED = """
located AS (
  SELECT *, last_value(CASE WHEN what IN ('OK', 'HELP') THEN lat END IGNORE NULLS) OVER o AS l1,
    last_value(CASE WHEN what IN ('OK', 'HELP') THEN lon END IGNORE NULLS) OVER o AS l2
  FROM steps WINDOW o AS (PARTITION BY event_id ORDER BY step ROWS UNBOUNDED PRECEDING)
),
sent AS (
  SELECT f.event_id, f.user_id, f.device_id, f.confidence, f.risk_level, l.ts AS dispatched_at,
    l.seq AS dispatch_seq,
    CASE WHEN l.what = 'HELP' THEN 'MANUAL_HELP_REQUEST' ELSE 'TIMEOUT' END AS reason,
    CASE WHEN l.what = 'HELP' THEN coalesce(l.l1, f.location_lat) ELSE f.location_lat END AS lat,
    CASE WHEN l.what = 'HELP' THEN coalesce(l.l2, f.location_lon) ELSE f.location_lon END AS lon,
    coalesce(u.name, 'Monitored User') AS user_name,
    coalesce(nullif(u.emergency_contact_name, ''), 'Designated Caregiver') AS contact_name,
    coalesce(nullif(u.emergency_contact_phone, ''), '+15550199') AS contact_phone
  FROM located l JOIN falls f USING (event_id) LEFT JOIN users u ON u.id = f.user_id
  WHERE l.what IN ('HELP', 'TIMEOUT')
)"""


def sent_sql(timeline: str) -> str:
    """CTEs up to ``sent``: one row per escalation."""
    return f"{Q.USERS}, {timeline},{_DISPATCHED}"


_SENT = sent_sql(Q.timeline())


def _dispatched(spark: SparkSession, sf: str) -> DataFrame:
    sent = lifecycle.dispatches(falls(spark, sf), actions(spark, sf), TIMEOUT)
    return lifecycle.outbox(lifecycle.contact_snapshot(sent, users(spark, sf)))


@query(
    "emergency_dispatch_outbox",
    f"""WITH {_SENT}
SELECT event_id, dispatched_at, reason, contact_name || ' (' || contact_phone || ')' AS emergency_contact,
  'CRITICAL: Confirmed Fall for ' || user_name || ' on ' || device_id || '. Emergency contact notified.' AS alert_message,
  'Fall detected for ' || user_name || '. Please check on them immediately.' AS contact_message,
  'EMERGENCY ALERT: Wearable monitor detected a confirmed fall for ' || user_name || '.' || chr(10) || 'Risk: '
    || risk_level || ' (' || format('{{:.1f}}', confidence * 100) || '% confidence).' || chr(10)
    || CASE WHEN lat <> 0 AND lon <> 0 THEN 'Location: https://maps.google.com/?q=' || lat || ',' || lon || chr(10)
       ELSE '' END || 'Please check on them immediately.' AS sms_body
FROM sent""",
)
def emergency_dispatch_outbox(spark: SparkSession, sf: str) -> DataFrame:
    return _dispatched(spark, sf).select(
        "event_id", "dispatched_at", "reason", "emergency_contact", "alert_message", "contact_message", "sms_body"
    )


@query(
    "fall_contact_snapshot",
    f"""WITH {Q.USERS}, {Q.FALLS}
SELECT event_id, coalesce(name, 'Monitored User') AS user_name,
  coalesce(nullif(emergency_contact_name, ''), 'Designated Caregiver') || ' ('
    || coalesce(nullif(emergency_contact_phone, ''), '+15550199') || ')' AS emergency_contact
FROM falls LEFT JOIN users ON users.id = falls.user_id""",
)
def fall_contact_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.contact_snapshot(falls(spark, sf), users(spark, sf)).select(
        "event_id", "user_name", "emergency_contact"
    )


@query(
    "alert_acknowledgements",
    f"""WITH {_SENT},
first_alert AS (
  SELECT s.event_id, min(st.step) AS step FROM sent s JOIN steps st
    ON st.event_id = s.event_id AND st.ts = s.dispatched_at AND st.seq = s.dispatch_seq
  GROUP BY s.event_id)
SELECT a.event_id, st.ts AS created_at,
  (SELECT max(k.ts) FROM steps k WHERE k.event_id = a.event_id AND k.what = 'ACK' AND k.step > a.step) AS acknowledged_at
FROM first_alert a JOIN steps st ON st.event_id = a.event_id AND st.step = a.step""",
)
def alert_acknowledgements(spark: SparkSession, sf: str) -> DataFrame:
    acts = actions(spark, sf)
    return lifecycle.alert_acknowledgements(lifecycle.dispatches(falls(spark, sf), acts, TIMEOUT), acts)


@query(
    "events_with_alerts",
    f"""WITH {_SENT},
a AS (SELECT event_id, dispatch_seq + 1 AS alert_id, reason FROM sent)
SELECT f.event_id, count(a.alert_id) AS alerts, min(a.alert_id) AS first_alert_id,
  arg_min(a.reason, a.alert_id) AS first_alert
FROM falls f LEFT JOIN a ON a.event_id = f.event_id GROUP BY f.event_id""",
)
def events_with_alerts(spark: SparkSession, sf: str) -> DataFrame:
    fell = falls(spark, sf)
    alerts = lifecycle.dispatches(fell, actions(spark, sf), TIMEOUT).select(
        "event_id", (F.col("dispatch_seq") + 1).alias("alert_id"), F.col("reason").alias("alert_message")
    )
    return lifecycle.events_with_alerts(fell.select("event_id"), alerts)


@query(
    "fall_note_lines",
    f"""WITH {Q.FALLS}, {Q.ACTIONS},
l AS (
  SELECT event_id, ts, -1 AS seq, 'OPEN' AS what, notes AS note FROM falls
  UNION ALL SELECT event_id, ts, seq, what, note FROM actions
  WHERE what = 'OK' OR what = 'NOTE' OR (what = 'ACK' AND note <> ''))
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY ts, seq) AS line_no,
  CASE what WHEN 'OK' THEN 'User verified safe: Emergency escalation cancelled.'
    WHEN 'ACK' THEN '[Caregiver Note]: ' || note
    WHEN 'NOTE' THEN '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ']: ' || note ELSE note END AS line
FROM l""",
)
def fall_note_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.note_lines(falls(spark, sf), actions(spark, sf))


@query(
    "direct_alert_cooldown",
    f"""WITH RECURSIVE {Q.FALLS},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM falls),
walk AS (
  SELECT user_id, k, event_id, ts, ts AS last, TRUE AS take FROM r WHERE k = 1
  UNION ALL
  SELECT r.user_id, r.k, r.event_id, r.ts,
    CASE WHEN r.ts - w.last >= INTERVAL 48 HOUR THEN r.ts ELSE w.last END, r.ts - w.last >= INTERVAL 48 HOUR
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1
)
SELECT f.event_id, 'UNACKNOWLEDGED' AS status,
  '[FALL DETECTED] on ' || device_id || '! Confidence: ' || format('{{:.1f}}', confidence * 100) || '%, Risk: '
    || risk_level AS alert_message,
  'Fall event #' || f.event_id || ' registered for ' || device_id || '. Confidence: '
    || format('{{:.1f}}', confidence * 100) || '%' AS log_message,
  'High-confidence fall signature (' || format('{{:.1f}}', confidence * 100) || '%) detected.' AS notes,
  round(CASE WHEN fall_probability = 0 THEN confidence ELSE fall_probability END, 6) AS fall_probability
FROM walk w JOIN falls f ON f.event_id = w.event_id WHERE w.take""",
)
def direct_alert_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    fell = falls(spark, sf).drop("notes").withColumn("notes", F.lit(None).cast("string"))
    taken = cooldown.accepted(fell, ["user_id"], "ts", "event_id", 48 * 3600.0)
    out = lifecycle.direct_alert_text(fell.join(taken.select("event_id"), "event_id", "left_semi"))
    return out.select("event_id", "status", "alert_message", "log_message", "notes",
                      F.round("fall_probability", 6).alias("fall_probability"))


@query(
    "global_cooldown",
    f"""WITH RECURSIVE {Q.FALLS},
r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM falls),
walk AS (
  SELECT event_id, ts FROM r WHERE k = 1
  UNION ALL
  SELECT n.event_id, n.ts FROM walk w, LATERAL (
    SELECT event_id, ts FROM r WHERE r.ts >= w.ts + INTERVAL 1 HOUR ORDER BY r.k LIMIT 1) n
)
SELECT event_id, ts FROM walk""",
)
def global_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    return cooldown.accepted(falls(spark, sf), [], "ts", "event_id", 3600.0)


_OUTCOME_MESSAGES = f"""WITH {OUTCOMES_SQL}
SELECT event_id, 'monitors,devices' AS audience,
  '{{"type":"FALL_CONFIRMATION_RESOLVED","data":{{"event_id":' || event_id || ',"status":"' || status
  || '","device_id":"' || device_id
  || CASE WHEN status = 'CONFIRMED' THEN CASE WHEN timed_out THEN '","reason":"TIMEOUT' ELSE '","reason":"MANUAL_HELP_REQUEST' END
     ELSE '' END || '","message":"'
  || CASE WHEN status = 'CONFIRMED' THEN 'Fall confirmed ('
       || CASE WHEN timed_out THEN 'TIMEOUT' ELSE 'MANUAL_HELP_REQUEST' END || '). Emergency alert dispatched.'
     ELSE 'User confirmed safe. Alert cancelled.' END || '"}}}}' AS value
FROM outcomes WHERE status IN ('CONFIRMED', 'CANCELLED_BY_USER')"""


@query("confirmation_messages", _OUTCOME_MESSAGES)
def confirmation_messages(spark: SparkSession, sf: str) -> DataFrame:
    done = lifecycle.confirmation_messages(lifecycle.event_outcomes(falls(spark, sf), actions(spark, sf), TIMEOUT))
    kind = "FALL_CONFIRMATION_RESOLVED"
    body = F.struct("event_id", "status", "device_id", F.when(F.col("status") == "CONFIRMED", F.col("reason")).alias("reason"), "message")
    return done.select("event_id", writers.audience(F.lit(kind)).alias("audience"),
                       writers.message(kind, body).alias("value"))


@query(
    "normalised_responses",
    """WITH t AS (SELECT *, CASE event_id % 7 WHEN 0 THEN 'I''m ok' WHEN 1 THEN 'i am ok' WHEN 2 THEN 'Need Help'
  WHEN 3 THEN 'cancel' WHEN 4 THEN 'FALL' WHEN 5 THEN 'who?' ELSE 'confirm' END AS text FROM events)
SELECT CASE WHEN event_id % 7 IN (0, 1, 3) THEN 'OK' WHEN event_id % 7 = 5 THEN 'UNKNOWN' ELSE 'HELP' END AS response,
  replace(replace(upper(text), ' ', '_'), '''', '') AS normalised, count(*) AS n FROM t GROUP BY ALL""",
)
def normalised_responses(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.array(*[F.lit(t) for t in ("I'm ok", "i am ok", "Need Help", "cancel", "FALL", "who?", "confirm")])
    raw = F.element_at(texts, (F.col("event_id") % 7 + 1).cast("int"))
    return events(spark, sf).select(
        lifecycle.response_kind(raw).alias("response"), lifecycle.normalise_action(raw).alias("normalised")
    ).groupBy("response", "normalised").agg(F.count(F.lit(1)).alias("n"))


@query(
    "latest_contact_profile",
    """WITH u AS (SELECT user_id, ts, event_id, event_type AS emergency_contact_name,
  CASE WHEN event_id % 3 > 0 THEN '+1' || event_id END AS phone_number FROM events)
SELECT user_id, arg_max(emergency_contact_name, event_ord) AS emergency_contact_name,
  arg_max(phone_number, event_ord) FILTER (WHERE phone_number IS NOT NULL) AS phone_number
FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS event_ord FROM u) GROUP BY user_id""",
)
def latest_contact_profile(spark: SparkSession, sf: str) -> DataFrame:
    updates = events(spark, sf).select(
        "user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("emergency_contact_name"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("+1"), F.col("event_id").cast("string"))).alias("phone_number"),
    )
    return lifecycle.latest_profile(updates, "user_id", ["emergency_contact_name", "phone_number"], ["phone_number"])


@query(
    "first_registration_per_email",
    """SELECT email, arg_min(event_id, ord) AS seq, min(ts) AS ts FROM (
  SELECT 'u' || (user_id % 500) || '@example.org' AS email, event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS ord
  FROM events WHERE event_type = 'signup') GROUP BY email""",
)
def first_registration_per_email(spark: SparkSession, sf: str) -> DataFrame:
    requests = events(spark, sf).where("event_type = 'signup'").select(
        F.concat(F.lit("u"), (F.col("user_id") % 500).cast("string"), F.lit("@example.org")).alias("email"),
        F.col("event_id").alias("seq"), "ts",
    )
    return lifecycle.first_registrations(requests)
