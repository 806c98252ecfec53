"""SQL building blocks for the check queries (the same views and windows written as plain SQL)."""

from strideframe import schemas as S

AXES = S.AXES

RAW = """raw AS (
  SELECT *, amp * CASE WHEN l_linestatus = 'F' THEN CAST(9.80665 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS scale
  FROM (
    SELECT *, sqrt(sqrt(CAST(0.003 AS DOUBLE) + CAST(0.013 AS DOUBLE) * (l_suppkey % 10) * (l_suppkey % 10))
      * (CAST(1 AS DOUBLE) + (l_partkey % 97) / CAST(970 AS DOUBLE))) AS amp FROM lineitem)
),
packets AS (
  SELECT l_suppkey AS device_id, CASE WHEN l_suppkey % 10 > 0 THEN l_suppkey % 50 END AS user_id,
    l_shipdate AS ts, l_orderkey AS seq_a, l_linenumber AS seq_b, l_partkey AS seq_c,
    CASE WHEN l_linestatus = 'F' THEN 'M/S2' ELSE 'g' END AS unit,
    scale * (l_quantity / CAST(20 AS DOUBLE)) AS acc_x,
    scale * (l_discount * CAST(20 AS DOUBLE) - CAST(1 AS DOUBLE)) AS acc_y,
    scale * (l_extendedprice / CAST(50000 AS DOUBLE)) AS acc_z,
    amp * (l_tax * CAST(50 AS DOUBLE) - CAST(2 AS DOUBLE)) AS gyro_x,
    amp * ((l_partkey % 13) / CAST(4 AS DOUBLE) - CAST(1.5 AS DOUBLE)) AS gyro_y,
    amp * ((l_linenumber - 4) / CAST(2 AS DOUBLE)) AS gyro_z,
    CASE l_returnflag WHEN 'A' THEN 'FALL' WHEN 'N' THEN 'WALKING' ELSE 'SITTING' END AS activity
  FROM raw
),
samples AS (
  SELECT device_id, user_id, ts, seq_a, seq_b, seq_c, activity, unit,
    CASE WHEN unit = 'M/S2' THEN acc_x / CAST(9.80665 AS DOUBLE) ELSE acc_x END AS acc_x,
    CASE WHEN unit = 'M/S2' THEN acc_y / CAST(9.80665 AS DOUBLE) ELSE acc_y END AS acc_y,
    CASE WHEN unit = 'M/S2' THEN acc_z / CAST(9.80665 AS DOUBLE) ELSE acc_z END AS acc_z,
    gyro_x, gyro_y, gyro_z
  FROM packets
)"""

NUMBERED = RAW + """,
s AS (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq_a, seq_b, seq_c) AS rn,
    count(*) OVER (PARTITION BY device_id) AS n_rows,
    sqrt(acc_x*acc_x + acc_y*acc_y + acc_z*acc_z) AS acc_mag,
    sqrt(gyro_x*gyro_x + gyro_y*gyro_y + gyro_z*gyro_z) AS gyro_mag
  FROM samples
)"""


def windowed(first: int, stride: int, pad: str | None, size: int = 128) -> str:
    """CTEs up to ``w``: one row per window and position, built from the window end outwards."""
    at = f"e.win_end - {size} + p.pos"
    if pad == "front":
        at = f"greatest(1, {at})"
    elif pad == "tail":
        at = f"CASE WHEN e.win_end < {size} THEN least(e.win_end, p.pos) ELSE {at} END"
    return NUMBERED + f""",
e AS (SELECT device_id, rn AS win_end FROM s WHERE rn >= {first} AND (rn - {first}) % {stride} = 0),
w AS (
  SELECT e.device_id, e.win_end, p.pos, s.* EXCLUDE (device_id)
  FROM e CROSS JOIN (SELECT unnest(generate_series(1, {size})) AS pos) p
  JOIN s ON s.device_id = e.device_id AND s.rn = {at}
)"""


def stepped(key: str, source: str = "w") -> str:
    """CTE ``d``: magnitudes of first differences inside a window, plus tilt."""

    def diff(a: str) -> str:
        return f"50 * ({a} - lag({a}) OVER o)"

    jerk = " + ".join(f"power({diff(a)}, 2)" for a in AXES[:3])
    ang = " + ".join(f"power({diff(a)}, 2)" for a in AXES[3:])
    return f""",
d AS (
  SELECT *, sqrt({jerk}) AS jerk, sqrt({ang}) AS ang,
    degrees(atan2(acc_y, sqrt(acc_x*acc_x + acc_z*acc_z))) AS pitch, degrees(atan2(-acc_x, acc_z)) AS roll,
    count(*) OVER (PARTITION BY {key}) AS n
  FROM {source} WINDOW o AS (PARTITION BY {key} ORDER BY pos)
)"""


def channel_sql(c: str) -> dict[str, str]:
    return {
        f"{c}_mean": f"avg({c})",
        f"{c}_std": f"coalesce(stddev_samp({c}), 0)",
        f"{c}_var": f"coalesce(var_samp({c}), 0)",
        f"{c}_min": f"min({c})",
        f"{c}_max": f"max({c})",
        f"{c}_median": f"median({c})",
        f"{c}_range": f"max({c}) - min({c})",
        f"{c}_rms": f"sqrt(avg({c}*{c}))",
        f"{c}_energy": f"avg({c}*{c})",
        f"{c}_p2p": f"max({c}) - min({c})",
        f"{c}_skew": f"CASE WHEN coalesce(stddev_samp({c}), 0) > 1e-7 THEN coalesce(skewness({c}), 0) ELSE 0 END",
        f"{c}_kurtosis": f"CASE WHEN coalesce(stddev_samp({c}), 0) > 1e-7 THEN"
        f" CASE WHEN count(*) > 3 THEN kurtosis({c}) ELSE kurtosis_pop({c}) END ELSE 0 END",
    }


def global_sql() -> dict[str, str]:
    return {
        "acc_sma": "sum(abs(acc_x)+abs(acc_y)+abs(acc_z)) / count(*)",
        "gyro_sma": "sum(abs(gyro_x)+abs(gyro_y)+abs(gyro_z)) / count(*)",
        "jerk_mean": "coalesce(avg(jerk), 0)",
        "jerk_std": "coalesce(stddev_samp(jerk), 0)",
        "jerk_max": "coalesce(max(jerk), 0)",
        "jerk_energy": "coalesce(avg(jerk*jerk), 0)",
        "ang_acc_mean": "coalesce(avg(ang), 0)",
        "ang_acc_max": "coalesce(max(ang), 0)",
        "pitch_mean": "avg(pitch)",
        "pitch_std": "coalesce(stddev_samp(pitch), 0)",
        "pitch_range": "max(pitch) - min(pitch)",
        "roll_mean": "avg(roll)",
        "roll_std": "coalesce(stddev_samp(roll), 0)",
        "roll_range": "max(roll) - min(roll)",
        "impact_ratio": "max(acc_mag) / (avg(acc_mag) + 1e-5)",
        "post_impact_immobility": "CASE WHEN count(*) >= 10 THEN coalesce(stddev_pop(acc_mag) FILTER"
        " (WHERE pos > n - floor(CAST(n AS DOUBLE) * CAST(0.3 AS DOUBLE))), 0) ELSE 0 END",
    }


def rounded(exprs: dict[str, str], places: int = 6) -> str:
    return ",\n  ".join(f"round({e}, {places}) AS {n}" for n, e in exprs.items())


def spectral(channels: list[str], key: list[str], source: str = "w", n: int = 128) -> str:
    """CTEs up to ``spec``: the discrete Fourier transform of every channel of every window, written out."""
    k = ", ".join(key)
    union = " UNION ALL ".join(f"SELECT {k}, pos, '{c}' AS channel, {c} AS x FROM {source}" for c in channels)
    return f""",
signal AS ({union}),
centred AS (SELECT {k}, channel, pos, x - avg(x) OVER (PARTITION BY {k}, channel) AS y FROM signal),
wave AS (
  SELECT f.k, t.pos, cos(2*pi()*f.k*(t.pos-1)/{n}) AS c, sin(2*pi()*f.k*(t.pos-1)/{n}) AS s
  FROM (SELECT unnest(generate_series(1, {n // 2})) AS k) f, (SELECT unnest(generate_series(1, {n})) AS pos) t
),
power AS (
  SELECT {k}, channel, wave.k AS bin, power(sum(y*c), 2) + power(sum(y*s), 2) AS p
  FROM centred JOIN wave USING (pos) GROUP BY {k}, channel, wave.k
),
totals AS (SELECT *, sum(p) OVER (PARTITION BY {k}, channel) AS total FROM power),
spec AS (
  SELECT {k}, channel,
    CASE WHEN max(total) > 1e-9 THEN arg_max(bin, p) * CAST(50 AS DOUBLE) / {n} ELSE 0 END AS dom_freq,
    max(total) / ({n} + 1e-9) AS spec_energy,
    CASE WHEN max(total) > 1e-9 THEN
      -sum((p/total) * log2(p/total + 1e-12)) / log2(count(*) FILTER (WHERE p > 0) + 1e-12) ELSE 0 END AS spec_entropy
  FROM totals GROUP BY {k}, channel
)"""

def spectral_any(channels: list[str], key: str, source: str) -> str:
    """The same for windows of any length (zeros below four samples)."""
    union = " UNION ALL ".join(f"SELECT {key}, pos, '{c}' AS channel, {c} AS x FROM {source}" for c in channels)
    return f""",
signal AS ({union}),
centred AS (
  SELECT {key}, channel, pos, x - avg(x) OVER o AS y, count(*) OVER o AS n FROM signal
  WINDOW o AS (PARTITION BY {key}, channel)
),
power AS (
  SELECT {key}, channel, n, k AS bin,
    power(sum(y*cos(2*pi()*k*(pos-1)/n)), 2) + power(sum(y*sin(2*pi()*k*(pos-1)/n)), 2) AS p
  FROM (SELECT *, unnest(generate_series(1, greatest(n // 2, 1))) AS k FROM centred) GROUP BY {key}, channel, n, k
),
totals AS (SELECT *, sum(p) OVER (PARTITION BY {key}, channel) AS total FROM power),
spec AS (
  SELECT {key}, channel,
    CASE WHEN n >= 4 AND max(total) > 1e-9 THEN arg_max(bin, p) * CAST(50 AS DOUBLE) / n ELSE 0 END AS dom_freq,
    CASE WHEN n >= 4 THEN max(total) / (n + 1e-9) ELSE 0 END AS spec_energy,
    CASE WHEN n >= 4 AND max(total) > 1e-9 THEN
      -sum((p/total) * log2(p/total + 1e-12)) / log2(count(*) FILTER (WHERE p > 0) + 1e-12) ELSE 0 END AS spec_entropy
  FROM totals GROUP BY {key}, channel, n
)"""


# Views on events and customer.
USERS = """users AS (
  SELECT c_custkey AS id, c_name AS name, 'user' || c_custkey || '@example.org' AS email,
    CASE WHEN c_custkey % 50 = 0 THEN 'ADMIN' WHEN c_custkey % 3 = 0 THEN 'CAREGIVER' ELSE 'PATIENT' END AS role,
    CASE WHEN c_custkey % 4 > 0 THEN 'Contact ' || c_custkey WHEN c_custkey % 8 = 0 THEN '' END AS emergency_contact_name,
    CASE WHEN c_custkey % 5 > 0 THEN '+1555' || (c_custkey + 10000) END AS emergency_contact_phone
  FROM customer
)"""

FALLS = """falls AS (
  SELECT event_id, user_id, 'dev_' || (user_id % 7) AS device_id, ts,
    CAST(0.5 AS DOUBLE) + (event_id % 499) / CAST(1000 AS DOUBLE) AS confidence,
    CASE WHEN event_id % 3 > 0 THEN (event_id % 997) / CAST(1000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS fall_probability,
    'HIGH' AS risk_level,
    CASE WHEN event_id % 4 = 0 THEN (event_id % 180) / CAST(2 AS DOUBLE) - 45 END AS location_lat,
    CASE WHEN event_id % 4 = 0 THEN (event_id % 360) / CAST(2 AS DOUBLE) - 90 END AS location_lon,
    'Potential fall detected. Awaiting user response (21600.0s timeout).' AS notes
  FROM events WHERE event_type = 'error'
)"""

ACTIONS = """tied AS (
  SELECT *, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER o AS fall_id,
    last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER o AS fall_ts
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
),
actions AS (
  SELECT fall_id AS event_id, ts, event_id AS seq,
    CASE WHEN event_type <> 'view' THEN 'response' WHEN event_id % 2 = 0 THEN 'note' ELSE 'acknowledge' END AS kind,
    CASE event_type WHEN 'click' THEN 'OK' WHEN 'purchase' THEN 'HELP' WHEN 'signup' THEN 'UNKNOWN'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'NOTE' ELSE 'ACK' END END AS what,
    CASE WHEN event_type = 'view' THEN 'operator' || (event_id % 5) END AS "by",
    CASE WHEN event_type = 'view' AND event_id % 3 > 0 THEN 'checked ' || event_id
      WHEN event_type = 'view' THEN '' END AS note,
    CASE WHEN event_type IN ('click', 'purchase') AND event_id % 2 = 0
      THEN (event_id % 170) / CAST(2 AS DOUBLE) - 40 END AS lat,
    CASE WHEN event_type IN ('click', 'purchase') AND event_id % 4 = 0
      THEN (event_id % 350) / CAST(2 AS DOUBLE) - 80 END AS lon, fall_ts
  FROM tied WHERE event_type <> 'error' AND fall_id IS NOT NULL
)"""


def timeline(as_of: str = "TIMESTAMP '9999-12-31 00:00:00'", keep: str = "TRUE") -> str:
    """The log with the timer written in as an action of its own, in order of effect, as known at ``as_of``.
    ``keep``: a condition on actions."""
    return f"""{FALLS}, {ACTIONS},
opened AS (
  SELECT f.*, f.ts + INTERVAL 6 HOUR AS due,
    (SELECT min(a.ts) FROM actions a WHERE a.event_id = f.event_id AND a.kind = 'response') AS first_response
  FROM falls f
),
timeline AS (
  SELECT event_id, ts, 1 AS late, seq, what, "by", note, lat, lon FROM actions WHERE ts <= {as_of} AND {keep}
  UNION ALL
  SELECT event_id, due, 0, -1, 'TIMEOUT', NULL, NULL, NULL, NULL FROM opened
  WHERE (first_response IS NULL OR first_response >= due) AND due <= {as_of}
),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, late, seq) AS step FROM timeline
)"""


PREDICTIONS = """predictions AS (
  SELECT event_id AS id, ts AS timestamp,
    CASE event_type WHEN 'error' THEN 'FALL' WHEN 'view' THEN 'SITTING' WHEN 'click' THEN 'STANDING' ELSE 'WALKING' END
      AS activity,
    CAST(0.5 AS DOUBLE) + (event_id % 499) / CAST(1000 AS DOUBLE) AS confidence,
    CASE WHEN event_type = 'error' THEN 'HIGH' WHEN event_id % 5 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    event_type = 'error' AS is_fall, 'dev_' || (user_id % 7) AS device_id, user_id
  FROM events
)"""

CLASS_LIST = "['FALL', 'LAYING', 'SITTING', 'STANDING', 'WALKING', 'WALKING_UPSTAIRS']"
JUDGED = f"""judged AS (
  SELECT {CLASS_LIST}[a + 1] AS actual, {CLASS_LIST}[p + 1] AS predicted,
    least(CAST(1 AS DOUBLE), (l_quantity + CASE WHEN a = 0 THEN 14 ELSE 0 END) / CAST(64 AS DOUBLE)) AS score
  FROM (
    SELECT l_quantity, l_partkey % 6 AS a,
      CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN (l_suppkey * 7 + l_linenumber) % 6 ELSE l_partkey % 6 END AS p
    FROM lineitem)
),
pairs AS (SELECT actual, predicted, count(*) AS n FROM judged GROUP BY ALL)"""
