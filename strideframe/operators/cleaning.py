"""Unit normalisation, numeric coercion, gap filling, clipping, packet and window validation."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators.ordered import HOT_ROWS, carried

_ACC, _GYRO = S.AXES[:3], S.AXES[3:]


def normalise_units(df: DataFrame, unit: str = "unit") -> DataFrame:
    """Acceleration to g where the row's unit is a metric one; NULL or other units pass; rates are left alone."""
    metric = F.coalesce(F.lower(F.col(unit)).isin(*S.MS2_UNITS), F.lit(False))
    return df.withColumns({a: F.when(metric, F.col(a) / S.STANDARD_GRAVITY).otherwise(F.col(a)) for a in _ACC})


def standardise_units(df: DataFrame, acc_in_ms2: bool = False, gyro_in_deg: bool = False) -> DataFrame:
    """Whole-table unit switch; axes that are absent are skipped."""
    changed = {}
    if acc_in_ms2:
        changed |= {a: F.col(a) / S.STANDARD_GRAVITY for a in _ACC if a in df.columns}
    if gyro_in_deg:
        changed |= {a: F.radians(a) for a in _GYRO if a in df.columns}
    return df.withColumns(changed) if changed else df


def decode_raw_counts(df: DataFrame, acc: Sequence[str], gyro: Sequence[str]) -> DataFrame:
    """Register counts to g and rad/s, written to the standard axis names."""
    return df.withColumns(
        {a: F.col(c) / S.RAW_COUNTS_PER_G for a, c in zip(_ACC, acc, strict=True)}
        | {a: F.radians(F.col(c) / S.RAW_COUNTS_PER_DEG_S) for a, c in zip(_GYRO, gyro, strict=True)}
    )


def numeric(c: Column) -> Column:
    """Unparsable, NaN and infinite values become NULL."""
    v = c.try_cast("double")
    return F.when(F.isnan(v) | v.isin(float("inf"), float("-inf")), None).otherwise(v)


def coerce_axes(df: DataFrame, axes: Sequence[str] = tuple(S.AXES)) -> DataFrame:
    return df.withColumns({a: numeric(F.col(a)) for a in axes if a in df.columns})


def clip_axes(df: DataFrame) -> DataFrame:
    def clip(name: str, bound: float) -> Column:
        # NULL in, NULL out: greatest/least alone would skip it.
        c = F.col(name)
        return F.when(c.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), c)))

    return df.withColumns(
        {a: clip(a, S.ACC_LIMIT_G) for a in _ACC if a in df.columns}
        | {a: clip(a, S.GYRO_LIMIT_RAD) for a in _GYRO if a in df.columns}
    )


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    along: Column | None = None,
    axes: Sequence[str] = tuple(S.AXES),
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Forward then backward fill per key.

    Windows (``keys=["window_id"]``) are short, so one pass per direction does. With ``along`` the keys may be
    of any length (a subject, a whole file): large ones are split and filled chunk by chunk.
    """
    present = [a for a in axes if a in df.columns]
    if along is None:
        seen = (Window.unboundedPreceding, Window.currentRow)
        past = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*seen)
        ahead = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]).rowsBetween(*seen)
        return df.withColumns({a: F.coalesce(F.last(a, True).over(past), F.last(a, True).over(ahead)) for a in present})
    held = carried(df, keys, order, along, {f"_p_{a}": F.col(a) for a in present}, limit)
    held = carried(held, keys, order, along, {f"_n_{a}": F.col(a) for a in present}, limit, forward=False)
    return held.withColumns({a: F.coalesce(f"_p_{a}", f"_n_{a}") for a in present}).select(*df.columns)


def clean_stream(
    df: DataFrame, keys: Sequence[str] = ("window_id",), order: Sequence[str] = ("step",), along: Column | None = None
) -> DataFrame:
    """Coerce, fill, clip, in that order."""
    return clip_axes(fill_gaps(coerce_axes(df), list(keys), list(order), along))


def route(packets: DataFrame, kind: str) -> DataFrame:
    """Rows of one message type; a packet without a type is a sensor packet. ``kind='other'`` is what is ignored."""
    declared = F.coalesce(F.col("type"), F.lit("sensor_data"))
    if kind == "other":
        return packets.where(~declared.isin("ping", "fall_confirmation", "sensor_data"))
    return packets.where(declared == kind)


def with_packet_axes(packets: DataFrame) -> DataFrame:
    """Adds the axes, ``unit`` and ``_fine`` to sensor packets.

    Not fine: no accelerometer or gyroscope (or an empty one), any axis present but not a number. A missing axis is 0.
    """

    def axis(group: str, part: str) -> tuple[Column, Column]:
        raw = F.col(f"{group}.{part}")
        value = raw.try_cast("double")
        return F.coalesce(value, F.lit(0.0)), raw.isNull() | value.isNotNull()

    def filled(group: str) -> Column:
        return F.coalesce(*[F.col(f"{group}.{p}") for p in "xyz"]).isNotNull()

    axes, fine = {}, filled("accelerometer") & filled("gyroscope")
    for group, names in (("accelerometer", _ACC), ("gyroscope", _GYRO)):
        for part, name in zip("xyz", names, strict=True):
            value, ok = axis(group, part)
            axes[name] = value
            fine = fine & ok
    return (
        packets.withColumns(axes | {"_fine": fine}).withColumn("unit", F.coalesce("unit", F.lit("m/s2")))
        .drop("accelerometer", "gyroscope")
    )


def packet_samples(packets: DataFrame) -> DataFrame:
    """Valid sensor packets as flat samples."""
    return with_packet_axes(packets).where("_fine").drop("_fine")


def epoch_seconds(c: Column) -> Column:
    """Packet time stamps may be seconds or milliseconds; anything above 1e11 is taken as milliseconds."""
    return F.when(c > 1e11, c / 1000.0).otherwise(c)


def window_reject_reason(axes: Sequence[str] = tuple(S.AXES), least: int = 8) -> Column:
    """NULL for a usable window request, else why it is refused."""
    sizes = [F.coalesce(F.size(a), F.lit(-1)) for a in axes]
    uneven = sizes[0] < 0
    for s in sizes[1:]:
        uneven = uneven | (s != sizes[0])
    return F.when(
        uneven, "All 6 accelerometer and gyroscope arrays must have identical length."
    ).when(
        sizes[0] < least,
        F.concat(F.lit(f"Window requires at least {least} samples, got "), sizes[0].cast("string"), F.lit(".")),
    )
