"""The 136 features of many windows at once, from one row per sample and the rows that each window takes.

Signals are computed once per sample; a window is a row of indices into them, so overlapping windows share the samples
of an Arrow batch and no sample is copied by Spark. NULL samples are left out of every statistic; NaN is not.
"""

from collections.abc import Sequence

import numpy as np

from strideframe import schemas as S
from strideframe.functions.spectral import spectra

# A feature is one statistic of one signal; impact_ratio alone combines two.
GLOBALS = {
    "acc_sma": ("acc_abs", "mean"), "gyro_sma": ("gyro_abs", "mean"),
    "jerk_mean": ("jerk", "mean"), "jerk_std": ("jerk", "std"),
    "jerk_max": ("jerk", "max"), "jerk_energy": ("jerk", "energy"),
    "ang_acc_mean": ("ang", "mean"), "ang_acc_max": ("ang", "max"),
    "pitch_mean": ("pitch", "mean"), "pitch_std": ("pitch", "std"), "pitch_range": ("pitch", "range"),
    "roll_mean": ("roll", "mean"), "roll_std": ("roll", "std"), "roll_range": ("roll", "range"),
    "post_impact_immobility": ("acc_mag", "settled"),
}
_STEPS = {"jerk": slice(0, 3), "ang": slice(3, 6)}


def source(feature: str) -> tuple[str, str]:
    """(signal, statistic) of a feature."""
    if feature in GLOBALS:
        return GLOBALS[feature]
    for c in sorted(S.CHANNELS, key=len, reverse=True):
        if feature.startswith(f"{c}_") and feature[len(c) + 1:] in S.CHANNEL_STATS:
            return c, feature[len(c) + 1:]
    raise ValueError(f"unknown feature {feature}")


def _size(parts: np.ndarray) -> np.ndarray:
    return np.sqrt((parts * parts).sum(axis=1))


def _signal(name: str, axes: np.ndarray) -> np.ndarray:
    acc, gyro = axes[:, :3], axes[:, 3:]
    if name in S.AXES:
        return axes[:, S.AXES.index(name)]
    if name in ("acc_mag", "gyro_mag"):
        return _size(acc if name == "acc_mag" else gyro)
    if name in ("acc_abs", "gyro_abs"):
        return np.abs(acc if name == "acc_abs" else gyro).sum(axis=1)
    x, y, z = acc.T
    return np.degrees(np.arctan2(y, np.sqrt(x * x + z * z)) if name == "pitch" else np.arctan2(-x, z))


def _parts(name: str) -> slice | list[int]:
    """The axes that a signal is made of."""
    if name in S.AXES:
        return [S.AXES.index(name)]
    return slice(3, 6) if name.startswith("gyro") else slice(0, 3)


def _statistics(x: np.ndarray, known: np.ndarray | None, wanted: Sequence[str], rate: float) -> dict[str, np.ndarray]:
    """Statistics of the columns of ``x``; where ``known`` is false a value is missing. Nothing known gives 0.

    Sums run along the first axis, so each adds its samples one after another, as an aggregate over rows would.
    """
    size, rows = x.shape
    out: dict[str, np.ndarray] = {}
    if known is None:
        n, filled = np.full(rows, float(size)), x
    else:
        n, filled = known.sum(axis=0).astype(float), np.where(known, x, 0.0)
    some = np.maximum(n, 1.0)
    mean = filled.sum(axis=0) / some
    wanted = set(wanted)
    if wanted & {"std", "var", "skew", "kurtosis"}:
        centred = filled - mean
        if known is not None:
            centred[~known] = 0.0
        squares = centred * centred
        m2 = squares.sum(axis=0)
        out["var"] = m2 / np.maximum(n - 1.0, 1.0)
        out["std"] = np.sqrt(out["var"])
        moving, spread = out["std"] > 1e-7, np.where(m2 > 0, m2 / some, 1.0)
        if "skew" in wanted:
            g1 = (squares * centred).sum(axis=0) / some / spread**1.5
            unbiased = g1 * np.sqrt(n * np.maximum(n - 1, 0)) / np.maximum(n - 2, 1)
            out["skew"] = np.where(moving, np.where(n > 2, unbiased, g1), 0.0)
        if "kurtosis" in wanted:
            g2 = (squares * squares).sum(axis=0) / some / spread**2 - 3.0
            unbiased = (n - 1) / np.maximum((n - 2) * (n - 3), 1) * ((n + 1) * g2 + 6)
            out["kurtosis"] = np.where(moving, np.where(n > 3, unbiased, g2), 0.0)
    if wanted & {"min", "max", "range", "p2p"}:
        # NaN counts as the largest value.
        low = np.fmin.reduce(x if known is None else np.where(known, x, np.inf), axis=0)
        high = (x if known is None else np.where(known, x, -np.inf)).max(axis=0)
        low, high = np.where(n > 0, low, 0.0), np.where(n > 0, high, 0.0)
        out |= {"min": low, "max": high, "range": high - low, "p2p": high - low}
    if wanted & {"energy", "rms"}:
        out["energy"] = (filled * filled).sum(axis=0) / some
        out["rms"] = np.sqrt(out["energy"])
    if "median" in wanted:
        if known is None:
            out["median"] = np.median(np.ascontiguousarray(x.T), axis=1)
        else:
            last = np.sort(np.where(known, x, np.inf), axis=0)  # what is missing comes last
            at, count = np.arange(rows), n.astype(int)
            middle = last[np.maximum(count - 1, 0) // 2, at] + last[np.minimum(count // 2, size - 1), at]
            out["median"] = np.where(n > 0, middle / 2, 0.0)
    if "settled" in wanted:
        tail = slice(size - int(size * 0.3), size)
        end, seen = filled[tail], (np.ones_like(x[tail], bool) if known is None else known[tail])
        count = np.maximum(seen.sum(axis=0), 1)
        middle = end.sum(axis=0) / count
        spread = np.where(seen, (end - middle) ** 2, 0.0).sum(axis=0) / count
        out["settled"] = np.where(n >= 10, np.sqrt(spread), 0.0)
    if wanted & set(S.SPECTRAL_STATS):
        found = spectra(np.ascontiguousarray((x if known is None else np.where(known, x, np.nan)).T), rate)
        out |= {s: found[:, i] for i, s in enumerate(S.SPECTRAL_STATS)}
    out["mean"] = mean
    return out


class WindowStats:
    """Computes ``columns`` for windows given as rows of indices into the samples of a batch."""

    def __init__(self, columns: Sequence[str], rate: float = S.SAMPLING_RATE):
        self.columns, self.rate = list(columns), rate
        self.needed: dict[str, list[str]] = {}
        for c in self.columns:
            for signal, stat in ([("acc_mag", "max"), ("acc_mag", "mean")] if c == "impact_ratio" else [source(c)]):
                self.needed.setdefault(signal, []).append(stat)

    def prepared(self, axes: np.ndarray, known: np.ndarray | None) -> dict[str, tuple[np.ndarray, np.ndarray | None]]:
        """Per signal its values and where they are known; step signals from each sample and the one before it."""
        out = {}
        for signal in self.needed:
            if signal in _STEPS:
                parts = _STEPS[signal]
                change = np.zeros(len(axes))
                change[1:] = _size((axes[1:, parts] - axes[:-1, parts]) * self.rate)
                there = None if known is None else known[:, parts].all(axis=1)
                out[signal] = change, there if there is None else np.concatenate([there[:1], there[1:] & there[:-1]])
            else:
                out[signal] = _signal(signal, axes), None if known is None else known[:, _parts(signal)].all(axis=1)
        return out

    def of(self, signals: dict[str, tuple[np.ndarray, np.ndarray | None]], rows: np.ndarray) -> list[np.ndarray]:
        """One array per column. ``rows``: (windows, samples); a repeated row is a padded copy, which does not move."""
        rows = np.ascontiguousarray(rows.T)
        still = rows[1:] == rows[:-1]
        made: dict[tuple[str, str], np.ndarray] = {}
        for signal, stats in self.needed.items():
            values, there = signals[signal]
            if signal in _STEPS:
                if len(rows) < 2:
                    made |= {(signal, s): np.zeros(rows.shape[1]) for s in stats}
                    continue
                x, known = np.where(still, 0.0, values[rows[1:]]), None if there is None else there[rows[1:]] | still
            else:
                x, known = values[rows], None if there is None else there[rows]
            if known is not None and known.all():
                known = None
            found = _statistics(x, known, stats, self.rate)
            made |= {(signal, s): found[s] for s in stats}
        return [
            made["acc_mag", "max"] / (made["acc_mag", "mean"] + 1e-5) if c == "impact_ratio" else made[source(c)]
            for c in self.columns
        ]
