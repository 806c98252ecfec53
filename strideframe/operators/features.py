"""The 136 window features.

Samples are dealt by key and sorted, once; an Arrow pass over the sorted rows computes every feature of every window that
ends in a batch from the samples of the batch and the few before it (``functions.window_stats``). No sample is copied
per window, and medians and spectra come from the same pass as the rest. Built-in aggregates would need one row per window
and position, over five times the samples, and more than a hundred aggregates on each.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe import schemas as S
from strideframe.functions.window_stats import WindowStats
from strideframe.operators.ordered import HOT_ROWS, hot_keys
from strideframe.operators.windows import BLOCK_ROWS, PHONE_RULE, WindowRule, blocked, window_rows

_DEGREES = 180.0 / 3.141592653589793
#: Windows computed at once.
_WINDOWS = 1024


def magnitude(*parts: Column) -> Column:
    return F.sqrt(sum(p * p for p in parts))


def with_signals(df: DataFrame) -> DataFrame:
    """Per-sample signals: magnitudes, absolute sums and tilt angles in degrees."""
    ax, ay, az, gx, gy, gz = (F.col(a) for a in S.AXES)
    return df.withColumns({
        "acc_mag": magnitude(ax, ay, az),
        "gyro_mag": magnitude(gx, gy, gz),
        "_acc_abs": F.abs(ax) + F.abs(ay) + F.abs(az),
        "_gyro_abs": F.abs(gx) + F.abs(gy) + F.abs(gz),
        "_pitch": F.atan2(ay, F.sqrt(ax * ax + az * az)) * _DEGREES,
        "_roll": F.atan2(-ax, az) * _DEGREES,
    })


def _axes(columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray | None]:
    """(samples x axes, where they are known or None if all are)."""
    axes = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]) if columns else np.zeros((0, 6))
    if not any(c.null_count for c in columns):
        return axes, None
    return axes, np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])


def _starts(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Rows at which a run of equal values of ``names`` begins (NULL equals NULL)."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for name in names:
        column = batch.column(name)
        this, before = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.fill_null(pc.not_equal(this, before), False)
        differs = pc.or_(differs, pc.xor(pc.is_null(this), pc.is_null(before)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _made(kept: list[pa.Array], names: list[str], stats: WindowStats, found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*kept, *[pa.array(v) for v in found]], names=[*names, *stats.columns])


def _output(df: DataFrame, keep: Sequence[str], columns: Sequence[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keep], *more, *[T.StructField(c, T.DoubleType()) for c in columns]])


def _sliding(keys: Sequence[str], rule: WindowRule, stats: WindowStats, numbered: bool):
    """Features of the windows of sorted samples. ``numbered``: rows are of blocks and carry ``rn, _from, _to``."""
    by = [*keys, "block"] if numbered else list(keys)
    names = [*keys, "win_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = None, 0
        tail, tail_known = np.zeros((0, 6)), np.zeros((0, 6), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, by)
            firsts = [tuple(batch.column(c)[0].as_py() for c in by)]
            goes_on = firsts[0] == key
            if not goes_on:
                tail, tail_known, count = tail[:0], tail_known[:0], 0
            own, known = _axes([batch.column(a) for a in S.AXES])
            before = len(tail)
            axes = np.vstack([tail, own])
            whole = known is None and tail_known.all()
            there = np.vstack([tail_known, np.ones_like(own, bool) if known is None else known])
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(own))))
            offset = np.zeros(len(starts), np.int64)
            offset[0] = count
            first = before + starts
            first[0] = 0
            n = np.arange(len(own)) - starts[run_of] + 1 + offset[run_of]
            if numbered:
                number = batch.column("rn").to_numpy()
                due = (number >= batch.column("_from").to_numpy()) & (number <= batch.column("_to").to_numpy())
            else:
                number, due = n, n >= rule.first
            ends = np.flatnonzero(due & ((number - rule.first) % rule.stride == 0))
            signals = stats.prepared(axes, None if whole else there) if len(ends) else {}
            for at in range(0, len(ends), _WINDOWS):
                e = ends[at : at + _WINDOWS]
                rows = window_rows(rule, before + e + 1, first[run_of[e]], number[e])
                taken = pa.array(e)
                yield _made(
                    [*[batch.column(k).take(taken) for k in keys], pa.array(number[e])], names, stats, stats.of(signals, rows)
                )
            last = starts[-1]
            key = tuple(batch.column(c)[int(last)].as_py() for c in by)
            count = int(n[-1])
            cut = max(len(axes) - rule.size + 1, first[-1])
            tail, tail_known = axes[cut:], there[cut:]

    return run


def stream_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    along: Column,
    rule: WindowRule = PHONE_RULE,
    columns: Sequence[str] = tuple(S.FEATURE_COLUMNS),
    rate: float = S.SAMPLING_RATE,
    limit: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Features of every sliding window of every stream key: ``keys, win_end`` and the feature columns.

    One exchange by key. If some keys are above ``limit`` rows, samples are numbered and dealt by blocks instead.
    """
    keys, columns = list(keys), list(columns)
    base = df.select(*dict.fromkeys([*keys, *order]), *[F.col(a).cast("double").alias(a) for a in S.AXES])
    hot = hot_keys(base, keys, along, limit)
    if hot is None:
        rows = base.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *S.AXES)
    else:
        rows = blocked(base, keys, order, along, rule, limit, block_rows, hot=hot, find_hot=False)
        rows = rows.sortWithinPartitions(*keys, "block", "rn").select(*keys, "block", "rn", "_from", "_to", *S.AXES)
    out = _output(base, keys, columns, T.StructField("win_end", T.LongType()))
    return rows.mapInArrow(_sliding(keys, rule, WindowStats(columns, rate), hot is not None), out)


def _whole(window: Sequence[str], keep: Sequence[str], stats: WindowStats):
    """Features of windows whose sorted rows arrive together; ``keep`` columns come from a window's first row."""

    def finished(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = rows.combine_chunks().to_batches()[0]
        starts = _starts(batch, window)
        sizes = np.diff(np.append(starts, batch.num_rows))
        signals = stats.prepared(*_axes([batch.column(a) for a in S.AXES]))
        for size in np.unique(sizes).tolist():
            alike = starts[sizes == size]
            for at in range(0, len(alike), _WINDOWS):
                own = alike[at : at + _WINDOWS]
                taken = pa.array(own)
                yield _made(
                    [batch.column(k).take(taken) for k in keep], list(keep), stats, stats.of(signals, own[:, None] + np.arange(size))
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(_starts(batch, window)[-1])
            if held:
                edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks()
                if last == 0 and len(_starts(edge.to_batches()[0], window)) == 1:
                    held.append(batch)  # a window longer than a batch
                    continue
            done = [*held, batch.slice(0, last)]
            if sum(b.num_rows for b in done):
                yield from finished(pa.Table.from_batches(done))
            held = [batch.slice(last)]
        if held:
            yield from finished(pa.Table.from_batches(held))

    return run


def dataset_features(
    df: DataFrame,
    columns: Sequence[str] = tuple(S.FEATURE_COLUMNS),
    rate: float = S.SAMPLING_RATE,
    window: Sequence[str] = ("window_id",),
    step: str = "step",
    meta: Sequence[str] = ("subject_id", "activity", "is_fall", "split_origin"),
) -> DataFrame:
    """Features of windows already cut (``window_id, step``), with the meta columns of the first step."""
    window, columns = list(window), list(columns)
    if "split_origin" in meta and "split_origin" not in df.columns:
        df = df.withColumn("split_origin", F.lit("train"))
    keep = [*window, *meta]
    rows = df.select(*dict.fromkeys([*keep, step]), *[F.col(a).cast("double").alias(a) for a in S.AXES])
    rows = rows.repartition(*window).sortWithinPartitions(*window, step).select(*keep, *S.AXES)
    return rows.mapInArrow(_whole(window, keep, WindowStats(columns, rate)), _output(rows, keep, columns))


def message_features(
    windows: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] = tuple(S.FEATURE_COLUMNS),
    rate: float = S.SAMPLING_RATE,
    meta: Sequence[str] = (),
) -> DataFrame:
    """Features of windows given as six arrays, without any exchange; ``keys`` and ``meta`` columns are kept.

    Where an array is shorter than another, or has a NULL, the sample lacks that axis. Windows without samples are left out.
    """
    columns, keep, stats = list(columns), [*keys, *meta], WindowStats(list(columns), rate)
    zipped = F.arrays_zip(*[F.col(a).cast("array<double>").alias(a) for a in S.AXES])
    rows = windows.select(*keep, zipped.alias("_samples")).where(F.size("_samples") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("_samples")
            sizes = lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            signals = stats.prepared(*_axes(lists.flatten().flatten()))
            for size in np.unique(sizes).tolist():
                alike = np.flatnonzero(sizes == size)
                for at in range(0, len(alike), _WINDOWS):
                    own = alike[at : at + _WINDOWS]
                    yield _made(
                        [batch.column(k).take(pa.array(own)) for k in keep], list(keep), stats,
                        stats.of(signals, starts[own][:, None] + np.arange(size)),
                    )

    return rows.mapInArrow(run, _output(rows, keep, columns))


def clean_vector(df: DataFrame, columns: Sequence[str] = tuple(S.FEATURE_COLUMNS)) -> DataFrame:
    """NULL, NaN and infinities become 0.0; an absent feature column is added as 0.0."""
    bounds = [float("inf"), float("-inf")]
    fixed = {}
    for name in columns:
        if name not in df.columns:
            fixed[name] = F.lit(0.0)
            continue
        c = F.col(name)
        fixed[name] = F.when(c.isNull() | F.isnan(c) | c.isin(bounds), 0.0).otherwise(c)
    return df.withColumns(fixed)
