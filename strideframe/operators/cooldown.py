"""Cooldown suppression: accept an alert only if the last accepted one of its key is old enough.

The decision depends on the last *accepted* alert, so it is a chain along time. Alerts are dealt by ranges of (key, time),
which bounds the rows of a task whatever a key or the one clock for all holds, and kept. A range may then begin in the
middle of a key. What comes before matters to it only through the moment at which the clock is free, which lies less than
one cooldown behind its first alert; so each range reports, for those few entries, where its chain would end. The reports
of a key are walked in order, one range after another, which fixes the entry of every range; then all are replayed.

NULL keys are a key; NULL times are left out.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.session import cut


def accepted(df: DataFrame, keys: Sequence[str], ts: str, ident: str, cooldown: float = S.COOLDOWN_SECONDS) -> DataFrame:
    """``keys, ident, ts`` of the accepted rows; ties on ``ts`` go to the lowest ``ident``. ``keys=[]``: one clock."""
    gap = int(round(cooldown * 1_000_000))
    by = list(keys)
    source = df.select(*by, F.unix_micros(ts).alias("_t"), F.col(ident).alias("_id")).where(F.col("_t").isNotNull())
    # One candidate per instant: rows behind the first of an instant can never be accepted.
    instants = source.groupBy(*by, "_t").agg(F.min("_id").alias("_id"))
    dealt = instants.repartitionByRange(*by, "_t").sortWithinPartitions(*by, "_t")
    dealt = cut(dealt.select(*by, "_t", "_id", F.spark_partition_id().alias("_part")))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    typed = "".join(f"`{k}` {kinds[k]}, " for k in by)
    reports = dealt.mapInPandas(_reported(by, gap), f"{typed}_part int, _entry long, _exit long")
    walk = reports.repartition(*by) if by else reports.repartition(1)  # at most two runs of every range
    entries = walk.sortWithinPartitions(*by, "_part", "_entry").mapInPandas(_entered(by, gap), "_part int, _free long")
    replayed = dealt.join(F.broadcast(entries), "_part", "left").select(*by, "_t", "_id", "_part", "_free")  # a row a task
    kept = replayed.mapInPandas(_replayed(by, gap), f"{typed}_t long, _id {kinds['_id']}")
    return kept.select(*by, F.col("_id").alias(ident), F.timestamp_micros("_t").alias(ts))


def _runs(pdf: pd.DataFrame, by: list[str], key: tuple | None) -> Iterator[tuple[tuple, bool, int, int]]:
    """(key, whether it goes on from before, start, stop) of the runs of equal keys in a batch."""
    changed = np.zeros(len(pdf), bool)
    for c in by:
        v = pdf[c]
        changed |= ((v != v.shift()) & ~(v.isna() & v.shift().isna())).to_numpy()
    changed[0] = True
    starts = np.flatnonzero(changed)
    for a, b in zip(starts, [*starts[1:], len(pdf)]):
        own = tuple(None if pd.isna(pdf[c].iat[a]) else pdf[c].iat[a] for c in by)
        yield own, key is not None and own == key, int(a), int(b)


def _ends(t: np.ndarray, gap: int) -> np.ndarray:
    """For a chain that enters at each of the ascending times, the place where it ends."""
    following, end = np.searchsorted(t, t + gap, side="left"), np.arange(len(t))
    for i in range(len(t) - 1, -1, -1):
        if following[i] < len(t):
            end[i] = end[following[i]]
    return end


def _reported(by: list[str], gap: int):
    """The chain of the first and the last key of a range: entries up to a cooldown after its first alert, and exits."""

    def report(key: tuple, part: int, t: np.ndarray) -> pd.DataFrame:
        count = min(len(t), int(np.searchsorted(t, t[0] + gap, side="left")) + 1)
        out = pd.DataFrame({"_part": np.full(count, part, np.int32), "_entry": t[:count], "_exit": t[_ends(t, gap)[:count]]})
        for k, v in zip(by, key):
            out[k] = v
        return out[[*by, "_part", "_entry", "_exit"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, held, first = None, 0, [], True  # the times of the key at hand; the first key of the range is reported
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf["_part"].iat[0])
            t = pdf["_t"].to_numpy(np.int64)
            for own, goes_on, a, b in _runs(pdf, by, key):
                if not goes_on:
                    if key is not None and first:
                        yield report(key, part, np.concatenate(held))
                        first = False
                    held = []
                key = own
                held.append(t[a:b])
        if key is not None:
            yield report(key, part, np.concatenate(held))

    return run


def _entered(by: list[str], gap: int):
    """For every range that goes on with a key, when the clock is free; reports arrive by key, range and entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, free, found = None, None, None, []
        entry, leave = [], []  # the reports of one range

        def close() -> None:
            nonlocal free
            t, e = np.concatenate(entry), np.concatenate(leave)
            if free is not None:
                found.append((part, free))
            i = 0 if free is None else int(np.searchsorted(t, free, side="left"))
            if i < len(t):
                free = int(e[i]) + gap

        for pdf in batches:
            if not len(pdf):
                continue
            parts, t, e = (pdf[c].to_numpy(np.int64) for c in ("_part", "_entry", "_exit"))
            for own, goes_on, a, b in _runs(pdf, by, key):
                if not goes_on:
                    if entry:
                        close()
                    key, part, free, entry, leave = own, None, None, [], []
                cuts = [a, *(a + 1 + np.flatnonzero(parts[a + 1 : b] != parts[a : b - 1])).tolist(), b]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    if part is not None and parts[lo] != part:
                        close()
                        entry, leave = [], []
                    part = int(parts[lo])
                    entry.append(t[lo:hi])
                    leave.append(e[lo:hi])
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["_part", "_free"]).astype({"_part": np.int32})
                found.clear()
        if entry:
            close()
        yield pd.DataFrame(found, columns=["_part", "_free"]).astype({"_part": np.int32, "_free": np.int64})

    return run


def _replayed(by: list[str], gap: int):
    """The accepted rows of a range; ``_free`` holds for its first key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, free = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            t, take = pdf["_t"].to_numpy(np.int64), []
            for own, goes_on, a, b in _runs(pdf, by, key):
                if not goes_on:
                    given = pdf["_free"].iat[a]
                    free = int(given) if key is None and not pd.isna(given) else None
                key = own
                i = a if free is None else a + int(np.searchsorted(t[a:b], free, side="left"))
                while i < b:
                    take.append(i)
                    free = int(t[i]) + gap
                    i += int(np.searchsorted(t[i:b], free, side="left"))
            yield pdf.iloc[take][[*by, "_t", "_id"]]

    return run


class CooldownFold:
    """The same rule for rows of one key arriving in time order (streams)."""

    def __init__(self, gap_us: int, last: int | None = None):
        self.gap, self.last = gap_us, last

    def feed(self, times: Iterator[int]) -> list[bool]:
        out = []
        for t in times:
            take = self.last is None or t - self.last >= self.gap
            if take:
                self.last = t
            out.append(take)
        return out
