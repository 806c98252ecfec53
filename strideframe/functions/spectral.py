"""Spectral features of fixed-length signals: the one per-window computation Spark SQL has no function for."""

import numpy as np


def spectra(signals: np.ndarray, rate: float) -> np.ndarray:
    """Rows of (dominant frequency, spectral energy, spectral entropy) for rows of equally long signals."""
    count, n = signals.shape
    out = np.zeros((count, 3))
    if n < 4 or count == 0:
        return out
    spectrum = np.fft.rfft(signals - signals.mean(axis=1, keepdims=True), axis=1)[:, 1:]
    power = spectrum.real**2 + spectrum.imag**2
    total = power.sum(axis=1)
    out[:, 1] = total / (n + 1e-9)
    alive = total > 1e-9
    share = power[alive] / total[alive, None]
    bins = (share > 0).sum(axis=1)
    out[alive, 0] = (power[alive].argmax(axis=1) + 1) * rate / n
    out[alive, 2] = -(share * np.log2(share + 1e-12)).sum(axis=1) / np.log2(bins + 1e-12)
    return out
