"""Sample- and window-level queries on the sensor view."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators import asof, cleaning, decision, features, ordered, windows
from strideframe.plans import sql_parts as Q
from strideframe.plans.registry import query
from strideframe.plans.views import SENSOR_ORDER, raw_sensor, sensor_along, table
from strideframe.session import cut, shared_dir
from strideframe.sources import readers, writers

KEYS = ["device_id"]


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.normalise_units(raw_sensor(spark, sf))


def r(name: str, places: int = 6):
    return F.round(name, places).alias(name)


def stream_features(spark: SparkSession, sf: str, rule: windows.WindowRule, columns, **more) -> DataFrame:
    return features.stream_features(
        samples(spark, sf), KEYS, SENSOR_ORDER, sensor_along(), rule, columns, **more
    )


_PEAKS = ["acc_mag_max", "gyro_mag_max", "jerk_max"]
_PEAK_SQL = {n: (Q.channel_sql(n[:-4]) | Q.global_sql())[n] for n in _PEAKS}


@query(
    "windows_by_device_and_risk",
    f"""WITH {Q.windowed(64, 25, "front")}{Q.stepped("device_id, win_end")},
f AS (SELECT device_id, win_end, max(acc_mag) AS acc_max, max(gyro_mag) AS gyro_max, max(jerk) AS jerk_max
  FROM d GROUP BY device_id, win_end),
p AS (SELECT *, CASE WHEN acc_max > 2.8 AND gyro_max > 2.5 THEN 'HIGH' WHEN acc_max > 2.0 THEN 'MEDIUM' ELSE 'LOW' END
  AS risk_level FROM f)
SELECT risk_level, device_id, CAST(count(*) AS BIGINT) AS windows, round(max(jerk_max), 6) AS jerk_max
FROM p GROUP BY risk_level, device_id""",
)
def windows_by_device_and_risk(spark: SparkSession, sf: str) -> DataFrame:
    scored = decision.decide_without_model(stream_features(spark, sf, windows.PHONE_RULE, _PEAKS))
    return scored.groupBy("risk_level", "device_id").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.max("jerk_max"), 6).alias("jerk_max")
    )


_NATIVE = [c for c in S.FEATURE_COLUMNS if c not in S.SPECTRAL_COLUMNS]
_NATIVE_SQL = {k: v for c in S.CHANNELS for k, v in Q.channel_sql(c).items()} | Q.global_sql()


def _feature_check(first: int, stride: int, pad: str | None, columns: list[str]) -> str:
    chosen = {c: _NATIVE_SQL[c] for c in columns}
    return f"""WITH {Q.windowed(first, stride, pad)}{Q.stepped("device_id, win_end")}
SELECT device_id, win_end,
  {Q.rounded(chosen)}
FROM d GROUP BY device_id, win_end"""


@query("phone_window_features", _feature_check(64, 25, "front", _NATIVE))
def phone_window_features(spark: SparkSession, sf: str) -> DataFrame:
    return stream_features(spark, sf, windows.PHONE_RULE, _NATIVE).select(*KEYS, "win_end", *[r(c) for c in _NATIVE])


@query(
    "device_window_spectra",
    f"""WITH {Q.windowed(128, 64, None)}{Q.spectral(S.CHANNELS, ["device_id", "win_end"])}
SELECT device_id, win_end, channel, round(dom_freq, 6) AS dom_freq, round(spec_energy, 6) AS spec_energy,
  round(spec_entropy, 4) AS spec_entropy FROM spec""",
)
def device_window_spectra(spark: SparkSession, sf: str) -> DataFrame:
    wide = stream_features(spark, sf, windows.DEVICE_RULE, S.SPECTRAL_COLUMNS)
    per_channel = F.array(*[
        F.struct(F.lit(c).alias("channel"), r(f"{c}_dom_freq").alias("dom_freq"),
                 r(f"{c}_spec_energy").alias("spec_energy"), r(f"{c}_spec_entropy", 4).alias("spec_entropy"))
        for c in S.CHANNELS
    ])
    return wide.select("device_id", "win_end", F.inline(per_channel))


# --- ingest and cleaning -------------------------------------------------------------------------------------------

_KEY = ["device_id", "ts", "seq_a", "seq_b", "seq_c"]
_KEY_SQL = ", ".join(_KEY)


def _axes(places: int = 6):
    return [r(a, places) for a in S.AXES]


_AXES_SQL = Q.rounded({a: a for a in S.AXES})


@query("normalised_samples", f"WITH {Q.RAW} SELECT {_KEY_SQL}, {_AXES_SQL} FROM samples")
def normalised_samples(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select(*_KEY, *_axes())


@query(
    "standardised_units",
    f"""WITH {Q.RAW} SELECT {_KEY_SQL}, {Q.rounded({a: f"{a} / CAST(9.80665 AS DOUBLE)" for a in S.AXES[:3]})},
  {Q.rounded({a: f"radians({a})" for a in S.AXES[3:]})} FROM packets""",
)
def standardised_units(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.standardise_units(raw_sensor(spark, sf), acc_in_ms2=True, gyro_in_deg=True).select(*_KEY, *_axes())


@query(
    "decoded_raw_counts",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * 37) % 65536 - 32768 AS a,
  (l_orderkey * 13) % 65536 - 32768 AS b, CAST(l_quantity * 600 AS BIGINT) - 16000 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(a / CAST(4096 AS DOUBLE), 6) AS acc_x, round(b / CAST(4096 AS DOUBLE), 6) AS acc_y,
  round(c / CAST(4096 AS DOUBLE), 6) AS acc_z, round(radians(a / CAST(32.8 AS DOUBLE)), 6) AS gyro_x,
  round(radians(b / CAST(32.8 AS DOUBLE)), 6) AS gyro_y, round(radians(c / CAST(32.8 AS DOUBLE)), 6) AS gyro_z FROM c""",
)
def decoded_raw_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ((F.col("l_partkey") * 37) % 65536 - 32768).alias("a"), ((F.col("l_orderkey") * 13) % 65536 - 32768).alias("b"),
        ((F.col("l_quantity") * 600).cast("long") - 16000).alias("c"),
    )
    return cleaning.decode_raw_counts(counts, ["a", "b", "c"], ["a", "b", "c"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_axes()
    )


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Axes as text with gaps, words, NaN, infinities and spikes."""
    df = samples(spark, sf)
    text = {}
    for i, a in enumerate(S.AXES):
        k = (F.col("seq_c") + i * 5) % 23
        text[a] = (
            F.when(k == 0, "oops").when(k == 1, "NaN").when(k == 2, "Infinity").when(k == 3, "-Infinity")
            .when(k == 4, None).when(k == 5, (F.col(a) * 400).cast("string")).otherwise(F.col(a).cast("string"))
        )
    return df.withColumns(text)


_DIRTY = Q.RAW + """,
dirty AS (SELECT * REPLACE (""" + ", ".join(
    f"CASE WHEN (seq_c + {i * 5}) % 23 < 5 THEN NULL WHEN (seq_c + {i * 5}) % 23 = 5 THEN {a} * 400 ELSE {a} END AS {a}"
    for i, a in enumerate(S.AXES)
) + ") FROM samples)"


@query("coerced_axes", f"WITH {_DIRTY} SELECT {_KEY_SQL}, {_AXES_SQL} FROM dirty")
def coerced_axes(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.coerce_axes(_dirty(spark, sf)).select(*_KEY, *_axes())


def _clip_sql(a: str) -> str:
    bound = 16 if a.startswith("acc") else 35
    return f"CASE WHEN {a} > {bound} THEN {bound} WHEN {a} < -{bound} THEN -{bound} ELSE {a} END"


@query("clipped_axes", f"WITH {_DIRTY} SELECT {_KEY_SQL}, {Q.rounded({a: _clip_sql(a) for a in S.AXES})} FROM dirty")
def clipped_axes(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clip_axes(cleaning.coerce_axes(_dirty(spark, sf))).select(*_KEY, *_axes())


def _filled_sql(a: str) -> str:
    o = "PARTITION BY device_id ORDER BY ts, seq_a, seq_b, seq_c ROWS BETWEEN"
    return (f"coalesce(last_value({a} IGNORE NULLS) OVER ({o} UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({a} IGNORE NULLS) OVER ({o} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {a}")


@query(
    "cleaned_stream",
    f"""WITH {_DIRTY}, filled AS (SELECT * REPLACE ({", ".join(_filled_sql(a) for a in S.AXES)}) FROM dirty)
SELECT {_KEY_SQL}, {Q.rounded({a: _clip_sql(a) for a in S.AXES})} FROM filled""",
)
def cleaned_stream(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_stream(_dirty(spark, sf), KEYS, SENSOR_ORDER, sensor_along()).select(*_KEY, *_axes())


@query(
    "vector_magnitudes",
    f"""WITH {Q.NUMBERED} SELECT {_KEY_SQL}, round(acc_mag, 6) AS acc_mag, round(gyro_mag, 6) AS gyro_mag FROM s""",
)
def vector_magnitudes(spark: SparkSession, sf: str) -> DataFrame:
    return features.with_signals(samples(spark, sf)).select(*_KEY, r("acc_mag"), r("gyro_mag"))


def packet_text(spark: SparkSession, sf: str) -> DataFrame:
    """JSON messages of every kind and with every defect, one per event."""
    e, v = F.col("event_id"), F.col("value")
    acc = F.concat(F.lit('{"x":'), v.cast("string"), F.lit(',"y":'), (v * 2).cast("string"), F.lit(',"z":1.5}'))
    gyro = F.lit('{"x":0.25,"y":0.5,"z":-0.75}')
    head = F.concat(F.lit('"device_id":"dev_'), (F.col("user_id") % 7).cast("string"), F.lit('","timestamp":'),
                    (e * 20).cast("string"))
    k = e % 13

    def packet(*parts):
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    kind = F.lit('"type":"sensor_data"')
    a, g = F.concat(F.lit('"accelerometer":'), acc), F.concat(F.lit('"gyroscope":'), gyro)
    text = (
        F.when(k == 0, packet(kind, head, a))
        .when(k == 1, packet(kind, head, a, F.lit('"gyroscope":{}')))
        .when(k == 2, packet(kind, head, a, F.lit('"gyroscope":{"x":"fast","y":0.5,"z":1}')))
        .when(k == 3, packet(kind, head, a, F.lit('"gyroscope":{"x":0.25,"z":-0.75}')))
        .when(k == 4, F.lit('{"type":"sensor_data",'))
        .when(k == 5, packet(head, a, g))
        .when(k == 6, packet(F.lit('"type":"ping"')))
        .when(k == 7, packet(F.lit('"type":"fall_confirmation","action":"I_AM_OK"'),
                             F.concat(F.lit('"event_id":'), e.cast("string"))))
        .when(k == 8, packet(F.lit('"type":"hello"')))
        .when(k == 9, packet(kind, head, F.lit('"unit":"g"'), a, g))
        .when(k == 10, packet(kind, head, F.lit('"unit":"MS^-2"'), a, g))
        .otherwise(packet(kind, head, F.lit('"location":{"lat":37.5,"lon":-122.25}'), a, g))
    )
    return table(spark, sf, "events").select(e.alias("packet_no"), "ts", "user_id", text.alias("value"))


@query(
    "valid_packet_samples",
    """SELECT event_id AS packet_no, 'dev_' || (user_id % 7) AS device_id, CAST(event_id * 20 AS DOUBLE) AS timestamp,
  round(value / CASE WHEN k = 9 THEN 1 ELSE CAST(9.80665 AS DOUBLE) END, 6) AS acc_x,
  round(value * 2 / CASE WHEN k = 9 THEN 1 ELSE CAST(9.80665 AS DOUBLE) END, 6) AS acc_y,
  round(CAST(1.5 AS DOUBLE) / CASE WHEN k = 9 THEN 1 ELSE CAST(9.80665 AS DOUBLE) END, 6) AS acc_z,
  CAST(0.25 AS DOUBLE) AS gyro_x, CAST(CASE WHEN k = 3 THEN 0 ELSE 0.5 END AS DOUBLE) AS gyro_y,
  CAST(-0.75 AS DOUBLE) AS gyro_z, CASE WHEN k > 10 THEN CAST(37.5 AS DOUBLE) END AS lat
FROM (SELECT *, event_id % 13 AS k FROM events) WHERE k IN (3, 5, 9, 10, 11, 12)""",
)
def valid_packet_samples(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = readers.split_rejects(readers.parse_packets(packet_text(spark, sf)))
    flat = cleaning.normalise_units(cleaning.packet_samples(cleaning.route(good, "sensor_data")))
    return flat.select("packet_no", "device_id", "timestamp", *_axes(), F.col("location.lat").alias("lat"))


@query(
    "message_routes",
    """SELECT CASE WHEN k = 4 THEN 'rejected' WHEN k = 6 THEN 'ping' WHEN k = 7 THEN 'fall_confirmation'
  WHEN k = 8 THEN 'other' ELSE 'sensor_data' END AS route, count(*) AS n
FROM (SELECT event_id % 13 AS k FROM events) GROUP BY 1""",
)
def message_routes(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = readers.split_rejects(readers.parse_packets(packet_text(spark, sf)))
    parts = [bad.select(F.lit("rejected").alias("route"))]
    parts += [
        cleaning.route(good, k).select(F.lit(k).alias("route"))
        for k in ("ping", "fall_confirmation", "sensor_data", "other")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


# --- counters, retention, ticks, differences -----------------------------------------------------------------------


@query("arrival_counters", f"WITH {Q.NUMBERED} SELECT {_KEY_SQL}, rn, n_rows FROM s")
def arrival_counters(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.numbered(samples(spark, sf), KEYS, SENSOR_ORDER, sensor_along()).select(*_KEY, "rn", "n_rows")


@query("retained_samples", f"WITH {Q.NUMBERED} SELECT {_KEY_SQL}, {_AXES_SQL} FROM s WHERE rn > n_rows - 250")
def retained_samples(spark: SparkSession, sf: str) -> DataFrame:
    newest = [F.desc(c) for c in SENSOR_ORDER]
    return windows.retained(samples(spark, sf), KEYS, newest).select(*_KEY, *_axes())


@query(
    "live_ticks",
    f"""WITH {Q.NUMBERED} SELECT device_id, rn, {Q.rounded({a: a for a in S.AXES}, 4)},
  round(acc_mag, 3) AS acc_magnitude FROM s WHERE rn % 2 = 0""",
)
def live_ticks(spark: SparkSession, sf: str) -> DataFrame:
    counted = ordered.numbered(samples(spark, sf), KEYS, SENSOR_ORDER, sensor_along())
    return windows.live_ticks(counted).select("device_id", "rn", *S.AXES, "acc_magnitude")


@query(
    "first_differences",
    f"""WITH {Q.NUMBERED} SELECT device_id, rn, """ + ", ".join(
        f"round(50 * ({a} - lag({a}) OVER o), 6) AS d_{a}" for a in S.AXES
    ) + " FROM s WINDOW o AS (PARTITION BY device_id ORDER BY rn)",
)
def first_differences(spark: SparkSession, sf: str) -> DataFrame:
    hot = ordered.hot_keys(samples(spark, sf), KEYS, sensor_along())
    counted = ordered.numbered(samples(spark, sf), KEYS, SENSOR_ORDER, sensor_along(), hot=hot, find_hot=False)
    with_last = ordered.lagged(
        counted.drop("_chunk"), KEYS, SENSOR_ORDER, sensor_along(), {f"p_{a}": F.col(a) for a in S.AXES},
        hot=hot, find_hot=False,
    )
    return with_last.select(
        "device_id", "rn", *[F.round((F.col(a) - F.col(f"p_{a}")) * 50.0, 6).alias(f"d_{a}") for a in S.AXES]
    )


# --- as-of ---------------------------------------------------------------------------------------------------------


@query(
    "gyro_hold_at_acc",
    """WITH a AS (SELECT * FROM events WHERE event_type = 'click'), g AS (SELECT * FROM events WHERE event_type = 'view')
SELECT a.event_id, a.value AS acc, coalesce(g.value, 0) AS gyro
FROM a ASOF LEFT JOIN g ON a.user_id = g.user_id AND a.ts >= g.ts""",
)
def gyro_hold_at_acc(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    held = {"gyro": F.when(F.col("event_type") == "view", F.col("value"))}
    out = asof.sample_hold(both, ["user_id"], ["ts", "event_id"], ordered.micros("ts"),
                           F.col("event_type") == "click", held)
    return out.select("event_id", F.col("value").alias("acc"), "gyro")


@query(
    "fall_last_known_location",
    """WITH l AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS lat FROM events)
SELECT event_id, lat, lat / 2 AS lon FROM l WHERE event_type = 'error'""",
)
def fall_last_known_location(spark: SparkSession, sf: str) -> DataFrame:
    here = F.when(
        F.col("event_type") == "view",
        F.struct(F.col("value").alias("lat"), (F.col("value") / 2).alias("lon")),
    )
    df = table(spark, sf, "events").withColumn("location", here)
    out = asof.last_known(df, ["user_id"], ["ts", "event_id"], ordered.micros("ts"))
    return out.where("event_type = 'error'").select("event_id", "last_location.lat", "last_location.lon")


# --- windows and features ------------------------------------------------------------------------------------------

_FEW = ["acc_mag_mean", "acc_mag_max", "gyro_mag_energy", "jerk_mean", "jerk_max", "post_impact_immobility"]


def _few(spark: SparkSession, sf: str, rule: windows.WindowRule) -> DataFrame:
    return stream_features(spark, sf, rule, _FEW).select(*KEYS, "win_end", *[r(c) for c in _FEW])


@query("replay_windows_tail_padded", _feature_check(70, 10, "tail", _FEW))
def replay_windows_tail_padded(spark: SparkSession, sf: str) -> DataFrame:
    return _few(spark, sf, windows.REPLAY_RULE)


@query("device_windows_half_overlap", _feature_check(128, 64, None, _FEW))
def device_windows_half_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _few(spark, sf, windows.DEVICE_RULE)


@query("every_sample_windows", _feature_check(128, 1, None, _FEW[:3]))
def every_sample_windows(spark: SparkSession, sf: str) -> DataFrame:
    return stream_features(spark, sf, windows.EVERY_SAMPLE_RULE, _FEW[:3]).select(
        *KEYS, "win_end", *[r(c) for c in _FEW[:3]]
    )


@query(
    "window_messages",
    f"""WITH {Q.windowed(64, 25, "front")} SELECT device_id, win_end, """ + ", ".join(
        f"list(round({a}, 6) ORDER BY pos) AS {a}" for a in ("acc_x", "gyro_z")
    ) + " FROM w GROUP BY device_id, win_end",
)
def window_messages(spark: SparkSession, sf: str) -> DataFrame:
    arrays = windows.window_arrays(samples(spark, sf), KEYS, SENSOR_ORDER, sensor_along(), columns=["acc_x", "gyro_z"])
    return arrays.select(
        *KEYS, "win_end", *[F.transform(a, lambda x: F.round(x, 6)).alias(a) for a in ("acc_x", "gyro_z")]
    )


DATASET_SQL = Q.NUMBERED + """,
ds AS (
  SELECT *, device_id || '_' || ((rn - 1) // 128) AS window_id, (rn - 1) % 128 AS step, (rn - 1) % 128 + 1 AS pos FROM s
)"""


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The sensor view cut into fixed windows of 128 steps, the last one of a device shorter."""
    counted = ordered.numbered(samples(spark, sf), KEYS, SENSOR_ORDER, sensor_along())
    place = F.col("rn") - 1
    return counted.select(
        F.col("device_id").alias("subject_id"),
        F.concat_ws("_", F.col("device_id").cast("string"), F.floor(place / 128).cast("string")).alias("window_id"),
        (place % 128).alias("step"), *S.AXES, "activity", (F.col("activity") == "FALL").cast("int").alias("is_fall"),
        F.when(F.col("device_id") % 3 == 0, "test").otherwise("train").alias("split_origin"),
    )


@query(
    "dataset_window_features",
    f"""WITH {DATASET_SQL}{Q.stepped("window_id", "ds")}{Q.spectral_any(S.CHANNELS, "window_id", "ds")},
wide AS (
  SELECT window_id, {", ".join(
      f"max({s}) FILTER (WHERE channel = '{c}') AS {c}_{s}" for c in S.CHANNELS for s in S.SPECTRAL_STATS
  )} FROM spec GROUP BY window_id
),
base AS (
  SELECT window_id, arg_min(device_id, step) AS subject_id, arg_min(activity, step) AS activity,
    arg_min(CASE WHEN activity = 'FALL' THEN 1 ELSE 0 END, step) AS is_fall,
    arg_min(CASE WHEN device_id % 3 = 0 THEN 'test' ELSE 'train' END, step) AS split_origin,
  {Q.rounded(_NATIVE_SQL)}
  FROM d GROUP BY window_id
)
SELECT base.*, {", ".join(
    f"round({c}_{s}, {4 if s == 'spec_entropy' else 6}) AS {c}_{s}" for c in S.CHANNELS for s in S.SPECTRAL_STATS
)} FROM base JOIN wide USING (window_id)""",
)
def dataset_window_features(spark: SparkSession, sf: str) -> DataFrame:
    out = features.dataset_features(dataset(spark, sf))
    return out.select(*S.META_COLUMNS, *[r(c, 4 if c.endswith("spec_entropy") else 6) for c in S.FEATURE_COLUMNS])


@query(
    "matrix_windows",
    f"""WITH {Q.windowed(128, 64, None)},
place AS (SELECT *, row_number() OVER (ORDER BY device_id, win_end) - 1 AS row_idx FROM e)
SELECT CAST(w.device_id AS INTEGER) AS subject_id, 'train' AS split_origin, 'train_' || row_idx AS window_id,
  CAST(pos - 1 AS INTEGER) AS step, {_AXES_SQL},
  CASE w.device_id % 9 WHEN 1 THEN 'WALKING' WHEN 2 THEN 'WALKING_UPSTAIRS' WHEN 3 THEN 'WALKING_DOWNSTAIRS'
    WHEN 4 THEN 'SITTING' WHEN 5 THEN 'STANDING' WHEN 6 THEN 'LAYING' WHEN 7 THEN 'FALL'
    ELSE 'ACTIVITY_' || (w.device_id % 9) END AS activity, 0 AS is_fall
FROM w JOIN place USING (device_id, win_end)""",
)
def matrix_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows written as eight text matrices and read back, joined by line number."""
    rows = windows.window_arrays(samples(spark, sf), KEYS, SENSOR_ORDER, sensor_along(), windows.DEVICE_RULE)
    root = f"{shared_dir(spark)}/matrices-{uuid.uuid4().hex}"
    rows = rows.withColumns({"label": F.col("device_id") % 9, "subject": F.col("device_id")})
    writers.write_matrices(rows, ["device_id", "win_end"], root, "train", compression="gzip")
    return readers.read_matrices(spark, root, ["train"]).withColumns({a: F.round(a, 6) for a in S.AXES})


_REQUEST_SQL = f"""WITH {Q.NUMBERED},
g AS (SELECT device_id, (rn - 1) // 12 AS part, count(*) AS n, count(*) FILTER (WHERE seq_b <> 7) AS short
  FROM s GROUP BY ALL)
SELECT reject_reason, count(*) AS n FROM (
  SELECT CASE WHEN short <> n THEN 'All 6 accelerometer and gyroscope arrays must have identical length.'
    WHEN n < 8 THEN 'Window requires at least 8 samples, got ' || n || '.' END AS reject_reason FROM g)
GROUP BY reject_reason"""


def _request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """``device_id, part, body``: requests of twelve samples, the last of a device shorter; the last axis misses the samples
    of line 7."""
    counted = ordered.numbered(samples(spark, sf), KEYS, SENSOR_ORDER, sensor_along())
    lists = [F.collect_list(a).alias(a) for a in S.AXES[:5]]
    lists.append(F.collect_list(F.when(F.col("seq_b") != 7, F.col("gyro_z"))).alias("gyro_z"))
    grouped = counted.groupBy("device_id", F.floor((F.col("rn") - 1) / 12).alias("part")).agg(*lists)
    return grouped.select("device_id", "part", F.struct(*S.AXES, F.col("device_id").cast("string").alias("device_id")).alias("body"))


@query("window_requests", _REQUEST_SQL)
def window_requests(spark: SparkSession, sf: str) -> DataFrame:
    bodies = _request_bodies(spark, sf)
    requests = readers.parse_window_requests(bodies.select(F.to_json("body").alias("value")))
    return requests.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("window_request_lists", _REQUEST_SQL)
def window_request_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The same requests, sent as lists of up to five."""
    sent = _request_bodies(spark, sf).groupBy("device_id", F.floor(F.col("part") / 5)).agg(F.to_json(F.collect_list("body")).alias("value"))
    requests = readers.parse_window_requests(sent.select("value"), many=True)
    return requests.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "feature_vector_cleanup",
    """SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(0 AS DOUBLE) ELSE round(value, 6) END AS acc_sma, CAST(0 AS DOUBLE) AS gyro_sma
FROM events""",
)
def feature_vector_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 5
    df = table(spark, sf, "events").select(
        "event_id",
        F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 3, None)
        .otherwise(F.round("value", 6)).alias("acc_sma"),
    )
    return features.clean_vector(df, ["acc_sma", "gyro_sma"])


# --- decisions -----------------------------------------------------------------------------------------------------

_SCORED = f"""WITH {Q.NUMBERED},
c AS (SELECT s.*, round((seq_c % 1009) / CAST(1009 AS DOUBLE), 4) AS p FROM s),
f AS (SELECT *, (acc_mag >= 2.8 AND gyro_mag >= 2.2) OR activity = 'FALL' OR p >= 0.5 AS fall FROM c)"""


@query(
    "two_stage_decisions",
    f"""{_SCORED}
SELECT device_id, rn, fall AS is_fall, fall AND activity <> 'FALL' AS safety_override,
  CASE WHEN fall THEN 'FALL' ELSE activity END AS activity,
  CASE WHEN fall THEN 'HIGH' WHEN p >= 0.25 OR (acc_mag > 2.2 AND gyro_mag > 1.8) THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM f""",
)
def two_stage_decisions(spark: SparkSession, sf: str) -> DataFrame:
    counted = ordered.numbered(features.with_signals(samples(spark, sf)), KEYS, SENSOR_ORDER, sensor_along())
    scored = counted.select(
        "device_id", "rn", F.col("activity").alias("ml_activity"), "acc_mag", "gyro_mag",
        F.bround((F.col("seq_c") % 1009) / 1009.0, 4).alias("ml_fall_probability"),
    )
    return decision.decide(scored, "acc_mag", "gyro_mag").select(
        "device_id", "rn", "is_fall", "safety_override", "activity", "risk_level"
    )


@query(
    "rule_only_decisions",
    f"""WITH {Q.windowed(64, 25, "front")}{Q.stepped("device_id, win_end")},
f AS (SELECT device_id, win_end, {", ".join(f"{e} AS {n}" for n, e in _PEAK_SQL.items())} FROM d GROUP BY device_id, win_end),
g AS (SELECT *, acc_mag_max > 2.8 AND gyro_mag_max > 2.5 AS fall FROM f)
SELECT device_id, win_end, fall AS is_fall, CASE WHEN fall THEN 'FALL' ELSE 'WALKING' END AS activity,
  CAST(CASE WHEN fall THEN 0.88 ELSE 0.75 END AS DOUBLE) AS confidence,
  CAST(CASE WHEN fall THEN 0.88 ELSE 0.05 END AS DOUBLE) AS ml_fall_probability,
  CASE WHEN fall THEN 'HIGH' WHEN acc_mag_max > 2.0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  '1.0.0-fallback' AS model_version,
  round(acc_mag_max, 3) AS acc_peak, round(gyro_mag_max, 3) AS gyro_peak, round(jerk_max, 3) AS jerk_peak FROM g""",
)
def rule_only_decisions(spark: SparkSession, sf: str) -> DataFrame:
    scored = decision.decide_without_model(stream_features(spark, sf, windows.PHONE_RULE, _PEAKS))
    return decision.features_summary(scored, tilt=False).select(
        *KEYS, "win_end", "is_fall", "activity", "confidence", "ml_fall_probability", "risk_level", "model_version",
        F.col("features_summary.acc_mag_max").alias("acc_peak"),
        F.col("features_summary.gyro_mag_max").alias("gyro_peak"),
        F.col("features_summary.jerk_max").alias("jerk_peak"),
    )


@query(
    "activity_names",
    """SELECT CASE l_partkey % 9 WHEN 1 THEN 'WALKING' WHEN 2 THEN 'WALKING_UPSTAIRS' WHEN 3 THEN 'WALKING_DOWNSTAIRS'
  WHEN 4 THEN 'SITTING' WHEN 5 THEN 'STANDING' WHEN 6 THEN 'LAYING' WHEN 7 THEN 'FALL'
  ELSE 'ACTIVITY_' || (l_partkey % 9) END AS activity, count(*) AS n FROM lineitem GROUP BY 1""",
)
def activity_names(spark: SparkSession, sf: str) -> DataFrame:
    label = (F.col("l_partkey") % 9).cast("int")
    return table(spark, sf, "lineitem").groupBy(readers.activity_name(label).alias("activity")).agg(
        F.count(F.lit(1)).alias("n")
    )
