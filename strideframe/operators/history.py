"""Paged history, lookups and the monitoring summary."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(df: DataFrame, **filters: str | None) -> DataFrame:
    """Case-insensitive equality on stored upper-case columns; an argument left out does not filter."""
    for column, wanted in filters.items():
        if wanted:
            df = df.where(F.col(column) == F.upper(F.lit(wanted)))
    return df


def page(
    df: DataFrame, ts: str = "timestamp", ident: str = "id", limit: int = 50, offset: int = 0, most: int = 500
) -> DataFrame:
    """Newest first, ties by id. Spark keeps ``offset + limit`` rows per task before the final merge."""
    if not 0 <= limit <= most:
        raise ValueError(f"limit must be between 0 and {most}")
    return df.orderBy(F.desc(ts), F.desc(ident)).offset(offset).limit(limit)


def lookup(df: DataFrame, ident: int, column: str = "id") -> DataFrame:
    """One row, or none when the id is unknown."""
    return df.where(F.col(column) == ident)


def latest(df: DataFrame, columns: list[str], ts: str = "timestamp", ident: str = "id") -> DataFrame:
    """The newest row as an aggregate: one pass, no sort."""
    return df.agg(F.max_by(F.struct(*columns), F.struct(ts, ident)).alias("_r")).select("_r.*")


def since_midnight(df: DataFrame, as_of: Column, ts: str = "timestamp") -> DataFrame:
    return df.where(F.col(ts) >= F.date_trunc("day", as_of))


def summary(
    predictions: DataFrame, falls: DataFrame, alerts: DataFrame, devices: DataFrame, as_of: Column,
    open_alerts: int = 5, recent: int = 15,
) -> DataFrame:
    """One row: current state, counters and two short nested lists. One aggregate pass per table."""
    newest = F.struct("timestamp", "id")
    acts = predictions.agg(
        F.count(F.lit(1)).alias("total_activities_count"),
        F.max_by(F.struct("activity", "confidence", "risk_level"), newest).alias("_now"),
    )
    fell = falls.agg(
        F.count(F.lit(1)).alias("total_falls_count"),
        F.count_if(F.col("timestamp") >= F.date_trunc("day", as_of)).alias("falls_today_count"),
        F.count_if(~F.col("acknowledged")).alias("unacknowledged_falls_count"),
        F.max("timestamp").alias("last_fall_timestamp"),
    )
    linked = devices.agg(F.coalesce(F.bool_or("connected"), F.lit(False)).alias("sensor_connected"))
    top = page(alerts.where(F.col("acknowledged_at").isNull()), "created_at", limit=open_alerts)
    shown = page(predictions, limit=recent)

    def nested(df: DataFrame, ts: str, columns: list[str], name: str) -> DataFrame:
        item = F.struct(F.col(ts).alias("_k1"), F.col("id").alias("_k2"), F.struct(*columns).alias("row"))
        listed = F.sort_array(F.collect_list(item), asc=False)
        return df.agg(F.transform(listed, lambda x: x.getField("row")).alias(name))

    alert_list = nested(top, "created_at", ["id", "fall_event_id", "alert_type", "message"], "active_alerts")
    recent_list = nested(shown, "timestamp", ["id", "activity", "confidence", "risk_level"], "recent_activities")
    def one(df: DataFrame) -> Column:
        return df.select(F.struct("*")).scalar()

    out = acts.withColumns({"_f": one(fell), "_d": one(linked), "_a": one(alert_list), "_r": one(recent_list)})
    out = out.select("*", "_f.*", "_d.*", "_a.*", "_r.*")
    return out.select(
        F.coalesce("_now.activity", F.lit("WALKING")).alias("current_activity"),
        F.bround(F.coalesce("_now.confidence", F.lit(0.94)), 4).alias("current_confidence"),
        F.coalesce("_now.risk_level", F.lit("LOW")).alias("current_risk"),
        F.when(F.col("sensor_connected"), "ONLINE").otherwise("READY").alias("system_status"),
        "sensor_connected", "total_activities_count", "total_falls_count", "falls_today_count",
        "unacknowledged_falls_count", "last_fall_timestamp", "active_alerts", "recent_activities",
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Classes by frequency, name as tie-break."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
