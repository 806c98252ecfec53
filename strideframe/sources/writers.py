"""Sinks: sample tables, keyed feature cache, audit rows, JSON results, typed messages, idempotent batch appends."""

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.schemas import AXES, CONFIRM_TIMEOUT_SECONDS, MATRIX_FILES
from strideframe.session import cut

# Message types; the three FALL_* kinds also go to devices.
MESSAGE_TYPES = (
    "SENSOR_TICK", "ACTIVITY_UPDATE", "FALL_PENDING_CONFIRMATION", "FALL_CONFIRMATION_RESOLVED", "FALL_ALERT",
    "DEVICE_STATUS_UPDATE",
)
DEVICE_TYPES = ("FALL_PENDING_CONFIRMATION", "FALL_CONFIRMATION_RESOLVED", "FALL_ALERT")


def write_samples(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").partitionBy("split_origin")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_matrices(windows: DataFrame, order: list[str], root: str, split: str, compression: str = "none") -> None:
    """Windows (an array per axis, ``label``, ``subject``) as the text matrices that ``readers.read_matrices`` reads: line i
    of every file is window i in ``order``, whose columns must tell windows apart. They are sorted once, for all files."""
    placed = cut(windows.select(*order, *[c for c in MATRIX_FILES if c not in order]).orderBy(*order))
    for name, file in MATRIX_FILES.items():
        value = F.array_join(F.transform(name, lambda x: x.cast("string")), "  ") if name in AXES else F.col(name).cast("string")
        placed.select(value.alias("value")).write.option("compression", compression).text(f"{root}/{split}/{file.format(split=split)}")


def _stored(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The stored table, or None where nothing (complete) has been written yet."""
    try:
        return read()
    except AnalysisException:
        return None


def cached(spark: SparkSession, root: str, params: Mapping[str, object], compute: Callable[[], DataFrame]) -> DataFrame:
    """Read the materialised result for ``params``, computing it once. The path is keyed by the parameters, so other
    parameters (or another input version named in them) never read a stale result."""
    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root}/{key}"
    stored = _stored(lambda: spark.read.parquet(path))
    if stored is not None:
        return stored
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def audit_rows(predictions: DataFrame) -> DataFrame:
    """One row per inference; raw samples are not stored."""
    return predictions.select(
        "timestamp", "activity", "confidence", "risk_level", "is_fall", F.col("device_id").cast("string"),
        "model_version",
    )


def write_json(df: DataFrame, path: str) -> None:
    """Small results (metrics, comparison) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    """Stored metrics, else those of the bundle, else an empty row set."""
    stored = _stored(lambda: spark.read.json(path))
    if stored is not None:
        return stored
    return fallback if fallback is not None else spark.createDataFrame([], "accuracy double")


def message(kind: str, payload: Column, body: str = "data") -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias(body)))


def audience(kind: Column) -> Column:
    """Every message goes to monitors, fall messages to devices too."""
    return F.when(kind.isin(*DEVICE_TYPES), "monitors,devices").otherwise("monitors")


ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def activity_messages(predictions: DataFrame) -> DataFrame:
    told = predictions.withColumn("timestamp", F.date_format("timestamp", ISO_TIME))
    body = F.struct(*[c for c in (
        "timestamp", "activity", "ml_activity", "ml_fall_probability", "safety_override", "confidence", "risk_level",
        "is_fall", "device_id", "user_id", "probabilities", "features_summary",
    ) if c in predictions.columns])
    kind = F.lit("ACTIVITY_UPDATE")
    return told.select(
        kind.alias("type"), audience(kind).alias("audience"), message("ACTIVITY_UPDATE", body).alias("value")
    )


def _typed(kind: Column, value: Column, *more: str) -> list[Column]:
    return [*[F.col(c) for c in more], kind.alias("type"), audience(kind).alias("audience"), value.alias("value")]


def fall_messages(changes: DataFrame, timeout: float = CONFIRM_TIMEOUT_SECONDS) -> DataFrame:
    """FALL_PENDING_CONFIRMATION for detected falls and FALL_CONFIRMATION_RESOLVED for cancelled and confirmed ones.

    ``changes``: event_id, ts, seq, status, reason and the facts of the fall. Acknowledgements send nothing.
    """
    opened = F.struct(
        F.col("event_id").alias("id"), "event_id", "device_id", "user_id", F.date_format("ts", ISO_TIME).alias("timestamp"),
        F.bround("confidence", 4).alias("confidence"), "risk_level", F.lit(float(timeout)).alias("timeout_seconds"),
        "safety_override", "ml_activity", F.bround("fall_probability", 4).alias("ml_fall_probability"),
        F.lit("Possible fall detected. Are you okay?").alias("message"),
    )
    safe = F.col("status") == "CANCELLED_BY_USER"
    ended = F.struct("event_id", "status", "device_id", F.when(~safe, F.col("reason")).alias("reason"), F.when(
        safe, "User confirmed safe. Alert cancelled."
    ).otherwise(F.concat(F.lit("Fall confirmed ("), "reason", F.lit("). Emergency alert dispatched."))).alias("message"))
    pending = F.col("status") == "PENDING_CONFIRMATION"
    kind = F.when(pending, "FALL_PENDING_CONFIRMATION").otherwise("FALL_CONFIRMATION_RESOLVED")
    value = F.when(pending, message("FALL_PENDING_CONFIRMATION", opened, "event")).otherwise(
        message("FALL_CONFIRMATION_RESOLVED", ended)
    )
    told = changes.where(F.col("status").isin("PENDING_CONFIRMATION", "CANCELLED_BY_USER", "CONFIRMED"))
    return told.select(*_typed(kind, value, "event_id", "ts", "seq"))


def alert_messages(alerts: DataFrame) -> DataFrame:
    """FALL_ALERT for rows of ``lifecycle.direct_alert_text``; peaks are sent where the rows have them."""
    body = F.struct(
        F.col("event_id").alias("id"), F.date_format("ts", ISO_TIME).alias("timestamp"), "confidence", "risk_level", "status",
        "device_id", *[c for c in ("acc_peak", "gyro_peak") if c in alerts.columns], F.col("alert_message").alias("message"),
    )
    return alerts.select(*_typed(F.lit("FALL_ALERT"), message("FALL_ALERT", body, "event"), "event_id", "ts"))


def tick_messages(ticks: DataFrame, origin: str = "REAL_PHONE") -> DataFrame:
    """SENSOR_TICK for display ticks: stream_key, n, ts, device_id and one value per axis."""
    size = F.sqrt(F.col("acc_x") * F.col("acc_x") + F.col("acc_y") * F.col("acc_y") + F.col("acc_z") * F.col("acc_z"))

    def shown(a: str) -> Column:
        return F.bround(a, 4).alias(a)

    body = F.struct(
        F.date_format("ts", "HH:mm:ss.SSS").alias("timestamp"), *[shown(a) for a in AXES[:3]],
        F.bround(size, 3).alias("acc_magnitude"), *[shown(a) for a in AXES[3:]], F.lit(origin).alias("ground_truth"), "device_id",
    )
    return ticks.select(*_typed(F.lit("SENSOR_TICK"), message("SENSOR_TICK", body), "stream_key", "n", "ts"))


def status_messages(changes: DataFrame) -> DataFrame:
    """DEVICE_STATUS_UPDATE for devices that connected or disconnected (``jobs.connections``)."""
    up = F.col("kind") == "CONNECTED"
    body = F.struct(
        F.col("stream_key").alias("device_id"), up.alias("connected"), F.date_format("last_seen", ISO_TIME).alias("last_seen"),
        F.when(~up, F.col("samples")).alias("samples_received"),
    )
    told = changes.where(F.col("kind").isin("CONNECTED", "DISCONNECTED"))
    return told.select(*_typed(F.lit("DEVICE_STATUS_UPDATE"), message("DEVICE_STATUS_UPDATE", body), "stream_key", "ts"))


def append_once(df: DataFrame, path: str, query: str, batch_id: int) -> None:
    """Append one micro-batch. A replayed batch overwrites its own folder, so nothing is written twice."""
    df.write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch_id}")


def system_logs(df: DataFrame, level: str, event: str, message_column: str, ts: str = "timestamp") -> DataFrame:
    return df.select(
        F.col(ts).alias("timestamp"), F.lit(level).alias("level"), F.lit(event).alias("event"),
        F.col(message_column).alias("message"),
    )
