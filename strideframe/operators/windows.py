"""Count-based sliding windows, retention, decimation and running counters."""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators.ordered import HOT_ROWS, hot_keys, numbered

# A split key is processed in blocks of this many window ends plus the rows just before them.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class WindowRule:
    """A window of ``size`` samples ends at sample ``first``, ``first + stride``, ...; short ones may be padded."""

    size: int = S.WINDOW_SAMPLES
    first: int = S.MIN_SAMPLES
    stride: int = S.STRIDE_SAMPLES
    pad: str | None = "front"

    def __post_init__(self) -> None:
        if self.pad is None and self.first < self.size:
            raise ValueError("windows before the first full one need padding")


def window_rows(rule: WindowRule, ends: np.ndarray, first: np.ndarray, received: np.ndarray) -> np.ndarray:
    """For windows that end behind row ``ends`` the row of each of their samples, padding copies included.

    ``first``: row of the first sample at hand of the window's key; it is its very first one while ``received``, the
    number of samples of the key up to the window's end, is below the window's size.
    """
    at = ends[:, None] + np.arange(-rule.size, 0)
    if rule.pad is None or rule.first >= rule.size:
        return at
    if rule.pad == "front":
        return np.maximum(at, first[:, None])
    short = np.minimum(np.arange(rule.size), received[:, None] - 1) + first[:, None]
    return np.where(received[:, None] < rule.size, short, at)


PHONE_RULE = WindowRule()
REPLAY_RULE = WindowRule(first=70, stride=10, pad="tail")
DEVICE_RULE = WindowRule(first=128, stride=64, pad=None)
EVERY_SAMPLE_RULE = WindowRule(first=128, stride=1, pad=None)


def blocked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    along: Column,
    rule: WindowRule = PHONE_RULE,
    limit: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
    hot: DataFrame | None = None,
    find_hot: bool = True,
) -> DataFrame:
    """Number the samples and cut every key into blocks of ``block_rows`` window ends plus the rows before them.

    Rows within ``size - 1`` of the next block are copied into it, so every window lies inside the block of its end.
    Ordinary keys stay where the numbering put them (one exchange); split keys are spread over tasks by block.
    """
    keys = list(keys)
    if hot is None and find_hot:
        hot = hot_keys(df, keys, along, limit)
    rows = numbered(df, keys, order, along, limit, hot=hot, find_hot=False)
    block = F.floor((F.col("rn") - 1) / block_rows)
    reaches_next = ((F.col("rn") - 1) % block_rows > block_rows - rule.size) & (
        (block + 1) * block_rows < F.col("n_rows")
    )
    rows = rows.withColumn(
        "block", F.explode(F.when(reaches_next, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    if hot is not None:
        # Explicit, so that every operator on the blocks shares this one exchange.
        rows = rows.repartition(*keys, "block")
    first = F.greatest(F.col("block") * block_rows + 1, F.lit(rule.first))
    return rows.withColumns({
        "_from": _next_end(first, rule),
        "_to": F.least((F.col("block") + 1) * block_rows, F.col("n_rows")),
    }).drop("_chunk", "n_rows")


def _next_end(at_least: Column, rule: WindowRule) -> Column:
    return (F.lit(rule.first) + rule.stride * F.ceil((at_least - rule.first) / rule.stride)).cast("long")


def packed(
    blocks: DataFrame, keys: Sequence[str], rule: WindowRule = PHONE_RULE, columns: Sequence[str] = tuple(S.AXES)
) -> DataFrame:
    """Windows as messages: ``keys, block, win_end`` and one array of ``size`` values per column.

    A block (bounded rows) becomes one ordered array per column; windows are slices of it.
    """
    whole = blocks.groupBy(*keys, "block", "_from", "_to").agg(
        F.sort_array(F.collect_list(F.struct("rn", *columns))).alias("_s")
    )
    whole = whole.select(
        *keys, "block", "_from", "_to", F.col("_s").getItem(0).getField("rn").alias("_rn"),
        *[F.col("_s").getField(c).alias(c) for c in columns],
    )

    def cut(end: Column, c: str) -> Column:
        values = F.col(c)
        have = F.least(end, F.lit(rule.size)).cast("int")
        part = F.slice(values, (end - F.col("_rn") + 2).cast("int") - have, have)
        if rule.pad is None or rule.first >= rule.size:
            return part
        missing = rule.size - have
        if rule.pad == "front":
            return F.concat(F.array_repeat(F.element_at(part, 1), missing), part)
        return F.concat(part, F.array_repeat(F.element_at(part, -1), missing))

    ends = F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to", F.lit(rule.stride).cast("long")))
    windows = F.transform(ends, lambda e: F.struct(e.alias("win_end"), *[cut(e, c).alias(c) for c in columns]))
    return whole.select(*keys, "block", F.inline(windows))


def window_arrays(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    along: Column,
    rule: WindowRule = PHONE_RULE,
    columns: Sequence[str] = tuple(S.AXES),
    limit: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    return packed(blocked(df, keys, order, along, rule, limit, block_rows), keys, rule, columns).drop("block")


def retained(
    df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column], keep: int = S.RETAINED_SAMPLES
) -> DataFrame:
    """The last ``keep`` samples per key. Spark limits each map task to ``keep`` rows per key before the exchange."""
    latest = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_age", F.row_number().over(latest)).where(F.col("_age") <= keep).drop("_age")


def live_ticks(numbered_df: DataFrame, every: int = 2) -> DataFrame:
    """Every ``every``-th sample per device, rounded for display. Needs ``rn`` (see ``numbered``)."""
    magnitude = F.sqrt(sum(F.col(a) * F.col(a) for a in S.AXES[:3]))
    return numbered_df.where(F.col("rn") % every == 0).select(
        "*", F.bround(magnitude, 3).alias("acc_magnitude")
    ).withColumns({a: F.bround(F.col(a), 4) for a in S.AXES})
