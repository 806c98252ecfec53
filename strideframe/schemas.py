"""Schemas, canonical constants and the ordered feature list shared by batch and streaming jobs."""

from pyspark.sql import types as T

# Results depend on them.
SAMPLING_RATE = 50.0
WINDOW_SAMPLES = 128
RETAINED_SAMPLES = 250
MIN_SAMPLES = 64
STRIDE_SAMPLES = 25
STANDARD_GRAVITY = 9.80665
ACC_LIMIT_G = 16.0
GYRO_LIMIT_RAD = 35.0
COOLDOWN_SECONDS = 5.0
CONFIRM_TIMEOUT_SECONDS = 15.0
RAW_COUNTS_PER_G = 4096.0
RAW_COUNTS_PER_DEG_S = 32.8
ACTIVITY_NAMES = {
    1: "WALKING",
    2: "WALKING_UPSTAIRS",
    3: "WALKING_DOWNSTAIRS",
    4: "SITTING",
    5: "STANDING",
    6: "LAYING",
    7: "FALL",
}
MS2_UNITS = ("m/s2", "m/s^2", "ms2", "ms^-2")
OK_ACTIONS = ("I_AM_OK", "IM_OK", "OK", "SAFE", "CANCEL")
HELP_ACTIONS = ("NEED_HELP", "HELP", "CONFIRM", "FALL")

AXES = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"]
# Axis name -> file name of the public human-activity matrices, one 128-column row per window.
MATRIX_FILES = {
    "acc_x": "Inertial Signals/total_acc_x_{split}.txt",
    "acc_y": "Inertial Signals/total_acc_y_{split}.txt",
    "acc_z": "Inertial Signals/total_acc_z_{split}.txt",
    "gyro_x": "Inertial Signals/body_gyro_x_{split}.txt",
    "gyro_y": "Inertial Signals/body_gyro_y_{split}.txt",
    "gyro_z": "Inertial Signals/body_gyro_z_{split}.txt",
    "label": "y_{split}.txt",
    "subject": "subject_{split}.txt",
}
CHANNELS = ["acc_x", "acc_y", "acc_z", "acc_mag", "gyro_x", "gyro_y", "gyro_z", "gyro_mag"]
CHANNEL_STATS = [
    "mean", "std", "var", "min", "max", "median", "range", "rms", "energy", "p2p",
    "skew", "kurtosis", "dom_freq", "spec_energy", "spec_entropy",
]
SPECTRAL_STATS = ["dom_freq", "spec_energy", "spec_entropy"]
GLOBAL_FEATURES = [
    "acc_sma", "gyro_sma",
    "jerk_mean", "jerk_std", "jerk_max", "jerk_energy",
    "ang_acc_mean", "ang_acc_max",
    "pitch_mean", "pitch_std", "pitch_range",
    "roll_mean", "roll_std", "roll_range",
    "impact_ratio", "post_impact_immobility",
]
FEATURE_COLUMNS = [f"{c}_{s}" for c in CHANNELS for s in CHANNEL_STATS] + GLOBAL_FEATURES
SPECTRAL_COLUMNS = [f"{c}_{s}" for c in CHANNELS for s in SPECTRAL_STATS]
META_COLUMNS = ["window_id", "subject_id", "activity", "is_fall", "split_origin"]


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


_LONG, _INT, _DBL, _STR, _BOOL, _TS = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType(),
)
XYZ = _struct(x=_DBL, y=_DBL, z=_DBL)
# Axes of a packet are read as text so that a non-numeric axis can be told from a missing one.
XYZ_TEXT = _struct(x=_STR, y=_STR, z=_STR)
LOCATION = _struct(lat=_DBL, lon=_DBL)

SENSOR_STREAM = _struct(
    subject_id=_INT, split_origin=_STR, window_id=_STR, step=_INT,
    acc_x=_DBL, acc_y=_DBL, acc_z=_DBL, gyro_x=_DBL, gyro_y=_DBL, gyro_z=_DBL,
    activity=_STR, is_fall=_INT,
)
PACKET = _struct(
    type=_STR, version=_INT, device_id=_STR, timestamp=_DBL, unit=_STR,
    accelerometer=XYZ_TEXT, gyroscope=XYZ_TEXT, location=LOCATION,
    event_id=_LONG, action=_STR,
)
WINDOW_REQUEST = _struct(
    **{a: T.ArrayType(_DBL) for a in AXES}, device_id=_STR, sampling_rate=_DBL,
)
PREDICTIONS = _struct(
    id=_LONG, timestamp=_TS, activity=_STR, confidence=_DBL, risk_level=_STR, is_fall=_BOOL,
    device_id=_STR, model_version=_STR,
)
FALL_EVENTS = _struct(
    id=_LONG, user_id=_LONG, device_id=_STR, timestamp=_TS, activity=_STR, ml_activity=_STR,
    confidence=_DBL, fall_probability=_DBL, safety_override=_BOOL, risk_level=_STR,
    status=_STR, confirmed=_BOOL, alert_sent=_BOOL, emergency_contact=_STR,
    location_lat=_DBL, location_lon=_DBL, acknowledged=_BOOL, acknowledged_at=_TS, acknowledged_by=_STR,
    notes=_STR, acc_peak=_DBL, gyro_peak=_DBL, model_version=_STR,
)
ALERTS = _struct(
    id=_LONG, fall_event_id=_LONG, alert_type=_STR, message=_STR, created_at=_TS, acknowledged_at=_TS,
)
COMPARISON = T.StructType(
    [T.StructField("Model", _STR)]
    + [
        T.StructField(n, _DBL)
        for n in (
            "Accuracy", "Macro F1", "Fall Recall", "Fall Precision", "Weighted F1",
            "Fall FPR", "Fall FNR", "Fall ROC-AUC", "Composite Score",
        )
    ]
)
