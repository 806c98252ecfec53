"""Fall events from detection to resolution, as aggregates over an append-only action log.

``falls``:   event_id, user_id, device_id, ts, confidence, fall_probability, ml_activity, risk_level, safety_override,
             acc_peak, gyro_peak, location_lat, location_lon
``actions``: event_id, ts, seq, kind ('response' | 'acknowledge' | 'note'), action, by, note, lat, lon

The final state of an event needs only the first response and the last action of each sort, so every fold is a
map-side combined aggregate: an event with very many actions costs no more than its partial results.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators.ordered import HOT_ROWS, carried, micros, numbered

DEFAULT_USER = "Monitored User"
# Wording the results must carry.
DEFAULT_CONTACT_NAME = "Designated Caregiver"
DEFAULT_CONTACT_PHONE = "+15550199"
USER_ACKNOWLEDGER = "User (Smartphone)"
SAFE_NOTE = "User verified safe: Emergency escalation cancelled."
MAP_LINK = "https://maps.google.com/?q="


def falsy(c: Column, default: Column, zero: object = None) -> Column:
    """``c or default``: NULL, the empty string and zero take the default."""
    return F.coalesce(F.nullif(c, F.lit("" if zero is None else zero)), default)


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def normalise_action(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(c), " ", "_"), "'", "")


def response_kind(c: Column) -> Column:
    """OK, HELP or UNKNOWN for a raw action text."""
    a = normalise_action(c)
    return F.when(a.isin(*S.OK_ACTIONS), "OK").when(a.isin(*S.HELP_ACTIONS), "HELP").otherwise("UNKNOWN")


def seconds(c: Column, amount: float) -> Column:
    return F.timestamp_micros(F.unix_micros(c) + int(amount * 1_000_000))


def pending_falls(predictions: DataFrame, timeout: float = S.CONFIRM_TIMEOUT_SECONDS) -> DataFrame:
    """Every prediction that is a fall opens an event: no cooldown, no merging."""
    wait = float(timeout or S.CONFIRM_TIMEOUT_SECONDS)
    return predictions.where("is_fall").withColumns({
        "activity": F.lit("FALL"),
        "confidence": F.bround("confidence", 4),
        "fall_probability": F.bround("ml_fall_probability", 4),
        "status": F.lit("PENDING_CONFIRMATION"),
        "confirmed": F.lit(False),
        "alert_sent": F.lit(False),
        "acknowledged": F.lit(False),
        "notes": F.lit(f"Potential fall detected. Awaiting user response ({wait}s timeout)."),
    })


def classified(actions: DataFrame) -> DataFrame:
    """Add ``what``: OK, HELP, UNKNOWN (responses), ACK, NOTE."""
    return actions.withColumn(
        "what",
        F.when(F.col("kind") == "acknowledge", "ACK").when(F.col("kind") == "note", "NOTE")
        .otherwise(response_kind(F.col("action"))),
    )


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.struct("ts", "seq")))


def _since_detection(falls: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions on a fall that has been detected by then; earlier ones cannot be about it."""
    detected = falls.select("event_id", F.col("ts").alias("_detected"))
    return actions.join(detected, "event_id").where("ts >= _detected").drop("_detected")


def event_outcomes(
    falls: DataFrame, actions: DataFrame, timeout: float = S.CONFIRM_TIMEOUT_SECONDS, as_of: Column | None = None
) -> DataFrame:
    """Final state per event. The timer fires unless some response (even an unknown one) comes before it."""
    what, place = F.col("what"), F.struct("ts", "seq")
    decisive = what.isin("OK", "HELP")
    log = classified(_since_detection(falls, actions))
    per_event = log.groupBy("event_id").agg(
        F.min(F.when(F.col("kind") == "response", F.col("ts"))).alias("_first_response"),
        _last(F.struct("ts", "what"), what.isin("OK", "HELP", "ACK")).alias("_last_status"),
        _last(F.struct("ts", "what"), decisive).alias("_last_confirm"),
        _last(
            F.struct(F.col("ts"), F.when(what == "OK", USER_ACKNOWLEDGER).otherwise(F.col("by")).alias("by")),
            what.isin("OK", "ACK"),
        ).alias("_last_ack"),
        F.max(F.when(what == "ACK", place)).alias("_last_caregiver"),
        F.min(F.when(what == "HELP", place)).alias("_first_help"),
        F.count_if(what == "HELP").alias("_helps"),
        _last(F.col("lat"), decisive & F.col("lat").isNotNull()).alias("_lat"),
        _last(F.col("lon"), decisive & F.col("lon").isNotNull()).alias("_lon"),
    )
    due = seconds(F.col("ts"), timeout)
    fired = F.col("_first_response").isNull() | (F.col("_first_response") >= due)
    if as_of is not None:
        fired = fired & (due <= as_of)
    out = falls.join(per_event, "event_id", "left").withColumn("timed_out", fired).withColumn("_due", due)

    def after_timer(name: str) -> Column:
        # At the same instant the timer goes first, so the action wins.
        return F.col(name).isNotNull() & (~F.col("timed_out") | (F.col(f"{name}.ts") >= F.col("_due")))

    status = (
        F.when(after_timer("_last_status"), F.element_at(
            F.create_map(*[F.lit(x) for x in ("OK", "CANCELLED_BY_USER", "HELP", "CONFIRMED", "ACK", "ACKNOWLEDGED")]),
            F.col("_last_status.what"),
        )).when(F.col("timed_out"), "CONFIRMED").otherwise("PENDING_CONFIRMATION")
    )
    confirmed = F.when(after_timer("_last_confirm"), F.col("_last_confirm.what") == "HELP").otherwise(F.col("timed_out"))
    helps = F.coalesce("_helps", F.lit(0))
    return out.withColumns({
        "status": status,
        "confirmed": confirmed,
        "reason": F.when(F.col("timed_out"), "TIMEOUT").when(helps > 0, "MANUAL_HELP_REQUEST"),
        "dispatches": helps + F.col("timed_out").cast("long"),
        "alert_sent": F.col("timed_out") | (helps > 0),
        "acknowledged": F.col("_last_ack").isNotNull(),
        "acknowledged_at": F.col("_last_ack.ts"),
        "acknowledged_by": F.col("_last_ack.by"),
        "location_lat": F.coalesce("_lat", "location_lat"),
        "location_lon": F.coalesce("_lon", "location_lon"),
    }).drop(*[c for c in out.columns if c.startswith("_")])


def first_resolution(falls: DataFrame, actions: DataFrame, timeout: float = S.CONFIRM_TIMEOUT_SECONDS) -> DataFrame:
    """How the running timer ended: the first response before it is due, or TIMEOUT.

    Only responses from the detection on count.
    """
    answers = _since_detection(falls, actions.where("kind = 'response'"))
    first = classified(answers).groupBy("event_id").agg(
        F.min_by(F.struct("ts", "what"), F.struct("ts", "seq")).alias("_first")
    )
    due = seconds(F.col("ts"), timeout)
    answered = F.col("_first.ts") < due
    return falls.join(first, "event_id", "left").select(
        "event_id",
        F.when(answered, F.col("_first.what")).otherwise("TIMEOUT").alias("resolution"),
        F.when(answered, F.col("_first.ts")).otherwise(due).alias("resolved_at"),
    )


def dispatches(
    falls: DataFrame,
    actions: DataFrame,
    timeout: float = S.CONFIRM_TIMEOUT_SECONDS,
    as_of: Column | None = None,
    limit: int = HOT_ROWS,
    outcomes: DataFrame | None = None,
) -> DataFrame:
    """One row per escalation (each HELP response, each expired timer) with the location known at that moment.
    ``outcomes``: those of the same events, if they are at hand."""
    answers = _since_detection(falls, actions.where("kind = 'response'"))
    responses = classified(answers).where(F.col("what").isin("OK", "HELP"))
    # Locations travel along the responses of an event; only HELP rows are kept.
    located = carried(
        responses, ["event_id"], ["ts", "seq"], micros("ts"),
        {"_lat": F.col("lat"), "_lon": F.col("lon")}, limit,
    ).where("what = 'HELP'").select(
        "event_id", F.col("ts").alias("dispatched_at"), F.col("seq").alias("dispatch_seq"), "_lat", "_lon",
        F.lit("MANUAL_HELP_REQUEST").alias("reason"),
    )
    if outcomes is None:
        outcomes = event_outcomes(falls, actions, timeout, as_of)
    expired = outcomes.where("timed_out").select(
        "event_id", seconds(F.col("ts"), timeout).alias("dispatched_at"), F.lit(-1).cast("long").alias("dispatch_seq"),
        F.lit(None).cast("double").alias("_lat"), F.lit(None).cast("double").alias("_lon"),
        F.lit("TIMEOUT").alias("reason"),
    )
    return (
        located.unionByName(expired).join(falls, "event_id")
        .withColumns({"location_lat": F.coalesce("_lat", "location_lat"),
                      "location_lon": F.coalesce("_lon", "location_lon")})
        .drop("_lat", "_lon")
    )


def contact_snapshot(events: DataFrame, users: DataFrame, default_user: str = DEFAULT_USER) -> DataFrame:
    """Left join to the user's contact fields, with the falsy defaults. Spark picks broadcast from the users' size."""
    contacts = users.select(
        F.col("id").alias("user_id"), F.col("name").alias("_name"),
        F.col("emergency_contact_name").alias("_contact"), F.col("emergency_contact_phone").alias("_phone"),
    )
    return (
        events.join(contacts, "user_id", "left")
        .withColumns({
            "user_name": F.coalesce("_name", F.lit(default_user)),
            "contact_name": falsy(F.col("_contact"), F.lit(DEFAULT_CONTACT_NAME)),
            "contact_phone": falsy(F.col("_phone"), F.lit(DEFAULT_CONTACT_PHONE)),
        })
        .withColumn("emergency_contact", F.format_string("%s (%s)", "contact_name", "contact_phone"))
        .drop("_name", "_contact", "_phone")
    )


def outbox(dispatched: DataFrame, sender: str = "Wearable monitor") -> DataFrame:
    """Alert, contact and text-message wording for rows of ``contact_snapshot(dispatches(...))``."""
    lat, lon = F.col("location_lat"), F.col("location_lon")
    here = F.coalesce((lat != 0) & (lon != 0), F.lit(False))
    return dispatched.withColumns({
        "alert_type": F.lit("CRITICAL_FALL"),
        "alert_message": F.concat(
            F.lit("CRITICAL: Confirmed Fall for "), "user_name", F.lit(" on "), "device_id",
            F.lit(". Emergency contact notified."),
        ),
        "contact_message": F.concat(
            F.lit("Fall detected for "), "user_name", F.lit(". Please check on them immediately."),
        ),
        "sms_body": F.concat(
            F.lit(f"EMERGENCY ALERT: {sender} detected a confirmed fall for "), "user_name", F.lit(".\nRisk: "),
            "risk_level", F.lit(" ("), percent(F.col("confidence")), F.lit(" confidence).\n"),
            F.when(here, F.concat(
                F.lit(f"Location: {MAP_LINK}"), lat.cast("string"), F.lit(","), lon.cast("string"), F.lit("\n"),
            )).otherwise(""),
            F.lit("Please check on them immediately."),
        ),
    })


def direct_alert_text(df: DataFrame) -> DataFrame:
    """Wording of the path without confirmation; ``notes`` and ``fall_probability`` take falsy defaults."""
    return df.withColumns({
        "alert_message": F.concat(
            F.lit("[FALL DETECTED] on "), "device_id", F.lit("! Confidence: "), percent(F.col("confidence")),
            F.lit(", Risk: "), "risk_level",
        ),
        "log_message": F.concat(
            F.lit("Fall event #"), F.col("event_id").cast("string"), F.lit(" registered for "), "device_id",
            F.lit(". Confidence: "), percent(F.col("confidence")),
        ),
        "notes": falsy(F.col("notes"), F.concat(
            F.lit("High-confidence fall signature ("), percent(F.col("confidence")), F.lit(") detected."),
        )),
        "fall_probability": falsy(F.col("fall_probability"), F.col("confidence"), 0.0),
        "confidence": F.bround("confidence", 4),
        "status": F.lit("UNACKNOWLEDGED"),
        "confirmed": F.lit(True),
    })


def note_lines(falls: DataFrame, actions: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """The note text of every event as numbered lines, the opening line first.

    Lines rather than one string per event keep an event with very many notes distributed; ``note_text`` joins them.
    """
    log = classified(actions)
    opening = falls.where(F.col("notes").isNotNull() & (F.col("notes") != "")).select(
        "event_id", "ts", F.lit(-1).cast("long").alias("seq"), F.lit("OPEN").alias("what"), F.col("notes").alias("note"),
    )
    added = log.where(
        (F.col("what") == "OK")
        | ((F.col("what") == "ACK") & (F.coalesce("note", F.lit("")) != ""))
        | (F.col("what") == "NOTE")
    ).select("event_id", "ts", "seq", "what", "note")
    lines = numbered(opening.unionByName(added), ["event_id"], ["ts", "seq"], micros("ts"), limit)
    opened = F.col("rn") > 1
    text = (
        F.when(F.col("what") == "OK", F.lit(SAFE_NOTE))
        .when((F.col("what") == "ACK") & opened, F.concat(F.lit("[Caregiver Note]: "), "note"))
        .when((F.col("what") == "NOTE") & opened,
              F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("]: "), "note"))
        .otherwise(F.col("note"))
    )
    return lines.select("event_id", F.col("rn").alias("line_no"), text.alias("line"))


def note_text(lines: DataFrame) -> DataFrame:
    """One text per event: for a page of events, whose lines are few."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("event_id").agg(
        F.array_join(F.transform(ordered, lambda x: x.getField("line")), "\n").alias("notes")
    )


def alert_acknowledgements(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """``acknowledged_at`` of each event's first alert: its last acknowledgement, if made after the alert existed."""
    first = alerts.groupBy("event_id").agg(F.min(F.struct("dispatched_at", "dispatch_seq")).alias("_first"))
    acks = actions.where("kind = 'acknowledge'").groupBy("event_id").agg(
        F.max(F.struct(F.col("ts").alias("dispatched_at"), F.col("seq").alias("dispatch_seq"))).alias("_ack")
    )
    return first.join(acks, "event_id", "left").select(
        "event_id", F.col("_first.dispatched_at").alias("created_at"),
        F.when(F.col("_ack") > F.col("_first"), F.col("_ack.dispatched_at")).alias("acknowledged_at"),
    )


def events_with_alerts(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """1:n: number of alerts and the first one per event (lowest id)."""
    per_event = alerts.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.min_by("alert_message", "alert_id").alias("first_alert"),
        F.min("alert_id").alias("first_alert_id"),
    )
    return events.join(per_event, "event_id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


def latest_profile(updates: DataFrame, key: str, fields: list[str], keep_old_if_null: list[str]) -> DataFrame:
    """Fold profile updates (``key, ts, seq`` and fields): the latest wins; optional fields keep the old value on NULL."""
    place = F.struct("ts", "seq")
    return updates.groupBy(key).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), place) if f in keep_old_if_null else place).alias(f) for f in fields
    ])


def first_registrations(requests: DataFrame, email: str = "email") -> DataFrame:
    """The earliest registration per email; later ones are refused."""
    whole = F.struct(*[c for c in requests.columns])
    return requests.groupBy(email).agg(F.min_by(whole, F.struct("ts", "seq")).alias("_r")).select("_r.*")


def confirmation_messages(outcomes: DataFrame) -> DataFrame:
    """FALL_CONFIRMATION_RESOLVED payload fields for resolved events."""
    resolved = outcomes.where(F.col("status").isin("CANCELLED_BY_USER", "CONFIRMED"))
    return resolved.withColumn(
        "message",
        F.when(F.col("status") == "CANCELLED_BY_USER", "User confirmed safe. Alert cancelled.").otherwise(
            F.concat(F.lit("Fall confirmed ("), F.coalesce("reason", F.lit("")),
                     F.lit("). Emergency alert dispatched."))),
    )


