"""Sensor, event, user and label views over the given tables; the queries run on these."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators.ordered import carried, micros

SENSOR_ORDER = ["ts", "seq_a", "seq_b", "seq_c"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    # The files hold TIMESTAMP_NTZ; watermarks and unix_micros need TIMESTAMP (session time zone UTC).
    times = [f.name for f in df.schema if f.dataType.simpleString().startswith("timestamp")]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else df


def sensor_along() -> Column:
    """Ascending along SENSOR_ORDER: the day in the high bits, the first sequence column below."""
    return F.shiftleft(F.unix_date(F.to_date("ts")).cast("long"), 40) + F.col("seq_a")


def raw_sensor(spark: SparkSession, sf: str) -> DataFrame:
    """Six axes per sample. Acceleration is in the unit named by ``unit``, angular rate in rad/s."""
    li = table(spark, sf, "lineitem")
    size = F.col("l_suppkey") % 10
    amp = F.sqrt(F.sqrt(F.lit(0.003) + F.lit(0.013) * size * size) * (F.lit(1.0) + (F.col("l_partkey") % 97) / 970.0))
    scale = amp * F.when(F.col("l_linestatus") == "F", F.lit(S.STANDARD_GRAVITY)).otherwise(F.lit(1.0))
    return li.select(
        F.col("l_suppkey").alias("device_id"),
        F.when(F.col("l_suppkey") % 10 > 0, F.col("l_suppkey") % 50).alias("user_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("seq_a"),
        F.col("l_linenumber").alias("seq_b"),
        F.col("l_partkey").alias("seq_c"),
        F.when(F.col("l_linestatus") == "F", "M/S2").otherwise("g").alias("unit"),
        (scale * (F.col("l_quantity") / 20.0)).alias("acc_x"),
        (scale * (F.col("l_discount") * 20.0 - 1.0)).alias("acc_y"),
        (scale * (F.col("l_extendedprice") / 50000.0)).alias("acc_z"),
        (amp * (F.col("l_tax") * 50.0 - 2.0)).alias("gyro_x"),
        (amp * ((F.col("l_partkey") % 13) / 4.0 - 1.5)).alias("gyro_y"),
        (amp * ((F.col("l_linenumber") - 4) / 2.0)).alias("gyro_z"),
        F.when(F.col("l_returnflag") == "A", "FALL")
        .when(F.col("l_returnflag") == "N", "WALKING").otherwise("SITTING").alias("activity"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def users(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("user"), c.cast("string"), F.lit("@example.org")).alias("email"),
        F.when(c % 50 == 0, "ADMIN").when(c % 3 == 0, "CAREGIVER").otherwise("PATIENT").alias("role"),
        F.when(c % 4 > 0, F.concat(F.lit("Contact "), c.cast("string"))).when(c % 8 == 0, "")
        .alias("emergency_contact_name"),
        F.when(c % 5 > 0, F.concat(F.lit("+1555"), (c + 10000).cast("string"))).alias("emergency_contact_phone"),
    )


def falls(spark: SparkSession, sf: str) -> DataFrame:
    """Every 'error' event is a detected fall."""
    e = F.col("event_id")
    return events(spark, sf).where("event_type = 'error'").select(
        "event_id", "user_id", F.concat(F.lit("dev_"), (F.col("user_id") % 7).cast("string")).alias("device_id"), "ts",
        (F.lit(0.5) + (e % 499) / 1000.0).alias("confidence"),
        F.when(e % 3 > 0, (e % 997) / 1000.0).otherwise(0.0).alias("fall_probability"),
        F.lit("WALKING").alias("ml_activity"), F.lit("HIGH").alias("risk_level"),
        (e % 2 == 0).alias("safety_override"),
        F.when(e % 4 == 0, (e % 180) / 2.0 - 45.0).alias("location_lat"),
        F.when(e % 4 == 0, (e % 360) / 2.0 - 90.0).alias("location_lon"),
        F.lit("Potential fall detected. Awaiting user response (21600.0s timeout).").alias("notes"),
    )


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """The other events act on the user's latest fall: click = safe, purchase = help, signup = an unknown answer,
    view = caregiver acknowledgement or note."""
    e = F.col("event_id")
    ev = events(spark, sf).select("event_id", "ts", "user_id", "event_type")
    tied = carried(
        ev, ["user_id"], ["ts", "event_id"], micros("ts"),
        {"fall_id": F.when(F.col("event_type") == "error", F.col("event_id"))},
    ).where("event_type <> 'error' AND fall_id IS NOT NULL")
    kind = F.col("event_type")
    located = kind.isin("click", "purchase") & (e % 2 == 0)
    return tied.select(
        F.col("fall_id").alias("event_id"), "ts", F.col("event_id").alias("seq"),
        F.when(kind != "view", "response").when(e % 2 == 0, "note").otherwise("acknowledge").alias("kind"),
        F.when(kind == "click", F.when(e % 3 == 0, "I'm OK").when(e % 3 == 1, "safe").otherwise("I_AM_OK"))
        .when(kind == "purchase", F.when(e % 2 == 0, "need help").otherwise("Confirm"))
        .when(kind == "signup", "wave").alias("action"),
        F.when(kind == "view", F.concat(F.lit("operator"), (e % 5).cast("string"))).alias("by"),
        F.when((kind == "view") & (e % 3 > 0), F.concat(F.lit("checked "), e.cast("string")))
        .when(kind == "view", "").alias("note"),
        F.when(located, (e % 170) / 2.0 - 40.0).alias("lat"),
        F.when(located & (e % 4 == 0), (e % 350) / 2.0 - 80.0).alias("lon"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.col("event_type")
    return events(spark, sf).select(
        e.alias("id"), F.col("ts").alias("timestamp"),
        F.when(kind == "error", "FALL").when(kind == "view", "SITTING").when(kind == "click", "STANDING")
        .otherwise("WALKING").alias("activity"),
        (F.lit(0.5) + (e % 499) / 1000.0).alias("confidence"),
        F.when(kind == "error", "HIGH").when(e % 5 == 0, "MEDIUM").otherwise("LOW").alias("risk_level"),
        (kind == "error").alias("is_fall"),
        F.concat(F.lit("dev_"), (F.col("user_id") % 7).cast("string")).alias("device_id"),
        F.lit("1.0.0").alias("model_version"), "user_id",
    )


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Actual and predicted activity with a fall score, for the quality metrics (every line item one case)."""
    actual = F.col("l_partkey") % 6
    wrong = (F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0
    shown = F.when(wrong, (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 6).otherwise(actual)

    def name(code: Column) -> Column:
        return F.element_at(
            F.array(*[F.lit(n) for n in ("FALL", "LAYING", "SITTING", "STANDING", "WALKING", "WALKING_UPSTAIRS")]),
            (code + 1).cast("int"),
        )

    return table(spark, sf, "lineitem").select(
        name(actual).alias("actual"), name(shown).alias("predicted"),
        F.least(F.lit(1.0), (F.col("l_quantity") + F.when(actual == 0, 14.0).otherwise(0.0)) / 64.0).alias("score"),
    )
