"""Streaming jobs built from the batch operators and the keyed processors."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strideframe import schemas as S
from strideframe.operators import cleaning, decision, features
from strideframe.operators.devices import stream_key
from strideframe.operators.windows import PHONE_RULE, WindowRule
from strideframe.session import ROCKSDB
from strideframe.sources import readers
from strideframe.streaming import processors as P

Scorer = Callable[[DataFrame], DataFrame]
#: Keys are dealt to so many buckets, whose state is kept together. A stream keeps the number it has begun with.
BUCKETS = 512


def prepare(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store; state then lives off the heap and in the checkpoint folder.

    Spark refuses to sort a stream because only a micro-batch would be sorted. That is just what ``in_order`` wants.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.unsupportedOperationCheck", "false")


def in_order(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of a micro-batch by key, and in order within a key. The keyed operator behind it adds no exchange and no sort
    of its own, and Spark's sort spills, so a key may bring any number of rows at once."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


def in_blocks(rows: DataFrame, key: str, order: Sequence[str], buckets: int = BUCKETS) -> GroupedData:
    """Rows of a micro-batch by buckets of keys, in order by key and ``order``, for a processor that gets them packed.

    A processor pays some milliseconds per key and some microseconds per row, many times what the work on most keys takes.
    """
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    blocks = in_order(dealt, "bucket", [key, *order]).mapInArrow(P.pack_blocks, P.BLOCKS_INPUT)
    return in_order(blocks, "bucket", ["at"]).groupBy("bucket")


def out_of_blocks(out: DataFrame, schema: str) -> DataFrame:
    return out.mapInArrow(P.open_blocks, schema)


def ingest(lines: DataFrame, users: DataFrame | None = None, user: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) from a stream or table of JSON messages (column ``value``).

    Parse, route, validate, keep registered users only, normalise units. Rejected are messages that are not JSON.
    """
    good, bad = readers.split_rejects(readers.parse_packets(lines))
    flat = cleaning.packet_samples(cleaning.route(good, "sensor_data"))
    if user is not None:
        flat = flat.withColumn("user_id", user)
    if users is not None:
        flat, _ = readers.known_users(flat, users)
    flat = cleaning.normalise_units(flat)
    return flat.withColumn("ts", packet_time()), bad


def packet_time() -> Column:
    return F.timestamp_micros((cleaning.epoch_seconds(F.col("timestamp")) * 1_000_000).cast("long"))


def judged_packets(lines: DataFrame, users: DataFrame, user: Column) -> DataFrame:
    """Every message with ``route`` and ``code``, in one pass, for a sink that keeps samples and rejects apart.

    ``code`` is NULL for samples of registered users and for other messages; else MALFORMED_JSON, INVALID_PACKET or
    USER_NOT_FOUND. ``users`` is static: it is read anew for every micro-batch, and Spark picks the join from its size.
    """
    parsed = readers.parse_packets(lines).withColumn("user_id", user)
    known = users.select(F.col("id").alias("user_id")).distinct().withColumn("_known", F.lit(True))
    route = F.when(F.col("_bad"), "rejected").otherwise(F.coalesce("type", F.lit("sensor_data")))
    checked = cleaning.with_packet_axes(parsed.withColumn("route", route)).join(known, "user_id", "left")
    code = F.when(F.col("_bad"), "MALFORMED_JSON").when(F.col("route") == "sensor_data", F.when(
        ~F.col("_fine"), "INVALID_PACKET"
    ).when(F.col("_known").isNull(), "USER_NOT_FOUND"))
    return cleaning.normalise_units(checked.withColumns({"code": code, "ts": packet_time()})).drop("_bad", "_fine", "_known")


def responses(lines: DataFrame) -> DataFrame:
    """User answers to pending falls out of the same message stream."""
    good, _ = readers.split_rejects(readers.parse_packets(lines))
    return cleaning.route(good, "fall_confirmation").where("event_id IS NOT NULL AND action IS NOT NULL")


def _timed(out: DataFrame, *more: str) -> DataFrame:
    """Microseconds of a processor back to timestamps."""
    return out.withColumns({c: F.timestamp_micros(c) for c in ("ts", *more)})


def _watched(rows: DataFrame, late: str) -> DataFrame:
    """Rows with ``ts`` as microseconds, behind a watermark of ``late``.

    The processor gets plain numbers, not the watched column, so Spark does not drop late rows before it sees them.
    """
    return rows.withWatermark("ts", late).withColumn("ts", F.unix_micros("ts"))


def device_windows(
    samples: DataFrame, rule: WindowRule = PHONE_RULE, retain: int = S.RETAINED_SAMPLES, tick_every: int = 2,
    order: Sequence[str] = ("ts", "seq"), buckets: int = BUCKETS,
) -> DataFrame:
    """Windows and ticks of every (user, device). ``samples``: user_id, device_id, the order columns, axes, lat, lon.
    The first order column is ``ts``."""
    prepare(samples.sparkSession)
    keyed = samples.withColumns({"stream_key": stream_key(), "ts": F.unix_micros("ts")})
    keyed = keyed.select("stream_key", *order, *[F.col(c).cast("double").alias(c) for c in (*S.AXES, "lat", "lon")])
    made = in_blocks(keyed, "stream_key", order, buckets).transformWithStateInPandas(
        statefulProcessor=P.DeviceBuckets(rule, retain, tick_every),
        outputStructType=P.BLOCKS_OUTPUT, outputMode="Append", timeMode="None",
    )
    return _timed(out_of_blocks(made, P.WINDOW_OUTPUT))


def confirmations(
    log: DataFrame, timeout: float = S.CONFIRM_TIMEOUT_SECONDS, late: str = "10 seconds", keep: float = 30 * 86400.0,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Status changes of falls, and rows put aside with status LATE or NOT_OPEN.

    ``log``: event_id, ts, seq, what; by, lat, lon and the facts of a fall where present. Rows up to ``late`` behind the
    newest one take effect in order; later ones are put aside. A fall is forgotten ``keep`` seconds after its detection.
    """
    prepare(log.sparkSession)
    wanted = {"by": "string", "lat": "double", "lon": "double"} | P.FALL_FACTS
    full = log.select(F.col("event_id").cast("long").alias("event_id"), "ts", F.col("seq").cast("long").alias("seq"), "what", *[
        (F.col(c) if c in log.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()
    ])
    changes = in_blocks(_watched(full, late), "event_id", ["ts", "seq"], buckets).transformWithStateInPandas(
        statefulProcessor=P.Confirmation(timeout, keep),
        outputStructType=P.BLOCKS_OUTPUT, outputMode="Append", timeMode="EventTime",
    )
    return _timed(out_of_blocks(changes, P.CONFIRMATION_OUTPUT)).withColumn("user_id", F.col("user_id").cast("long"))


def cooled_down(alerts: DataFrame, clock: Column, seconds: float = S.COOLDOWN_SECONDS) -> DataFrame:
    """Alerts that pass the cooldown of their clock (a device, or a literal for one clock for all): ``clock, ts, seq``
    and the other columns of ``alerts``, which travel as text, so that NULLs and types come through."""
    prepare(alerts.sparkSession)
    others = [f for f in alerts.schema if f.name not in ("clock", "ts", "seq")]
    body = F.to_json(F.struct(*[f.name for f in others])) if others else F.lit("{}")
    rows = alerts.select(clock.cast("string").alias("clock"), F.unix_micros("ts").alias("ts"), "seq", body.alias("body"))
    taken = _timed(in_order(rows, "clock", ["ts", "seq"]).groupBy("clock").transformWithStateInPandas(
        statefulProcessor=P.Cooldown(seconds),
        outputStructType=P.COOLDOWN_OUTPUT, outputMode="Append", timeMode="None",
    ))
    if not others:
        return taken.drop("body")
    return taken.withColumn("body", F.from_json("body", T.StructType(others))).select("clock", "ts", "seq", "body.*")


def connections(samples: DataFrame, key: Column, gap: float, late: str = "10 seconds") -> DataFrame:
    """CONNECTED, SEEN, DISCONNECTED and LATE rows of every device; ``gap`` seconds of silence disconnect it."""
    prepare(samples.sparkSession)
    rows = _watched(samples.select(key.cast("string").alias("stream_key"), "ts"), late)
    return _timed(in_order(rows, "stream_key", ["ts"]).groupBy("stream_key").transformWithStateInPandas(
        statefulProcessor=P.Connection(gap),
        outputStructType=P.CONNECTION_OUTPUT, outputMode="Append", timeMode="EventTime",
    ), "connected_at", "last_seen")


def sessions(changes: DataFrame) -> DataFrame:
    """``stream_key, connected_at, last_seen, samples, connected``: the last state of every session, open ones included."""
    rank = F.struct("samples", F.col("kind") == "DISCONNECTED")
    return changes.where("kind <> 'LATE'").groupBy("stream_key", "connected_at").agg(
        F.max_by("last_seen", rank).alias("last_seen"), F.max("samples").alias("samples"),
        (~F.bool_or(F.col("kind") == "DISCONNECTED")).alias("connected"),
    )


def score_windows(windows: DataFrame, scorer: Scorer | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Window messages to decisions: the same features and rules as in batch. Without a scorer the rule decides.
    ``columns``: the features that the scorer and the summary need (all unless given)."""
    columns = list(columns or S.FEATURE_COLUMNS) if scorer else ["acc_mag_max", "gyro_mag_max", "jerk_max"]
    keys, meta = ["stream_key", "n"], ["ts", "lat", "lon"]
    made = features.message_features(windows.select(*keys, *meta, *S.AXES), keys, columns, meta=meta)
    if scorer is None:
        out = decision.features_summary(decision.decide_without_model(made), tilt=False)
    else:
        out = decision.features_summary(decision.decide(scorer(features.clean_vector(made, columns))))
    return out.withColumns({"timestamp": F.col("ts"), "device_id": F.col("stream_key")})


def run_to_end(out: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process everything available, then return what was written."""
    query: StreamingQuery = (
        out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/out").outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")


def run_batches(out: DataFrame, write: Callable[[DataFrame, int], None], folder: str) -> StreamingQuery:
    """Process everything available; the finished query tells its progress."""
    query = (
        out.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
