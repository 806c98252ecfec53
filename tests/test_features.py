"""Window features against a plain numpy computation, and the fixed fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.functions.spectral import spectra
from strideframe.operators import decision, features, windows
from strideframe.operators.windows import WindowRule


def plain_channel(x, rate=50.0):
    n = len(x)
    std = np.std(x, ddof=1) if n > 1 else 0.0
    d = x - x.mean()
    m2, m3, m4 = (d**2).mean(), (d**3).mean(), (d**4).mean()
    skew = kurt = 0.0
    if std > 1e-7:
        g1, g2 = m3 / m2**1.5, m4 / m2**2 - 3
        skew = g1 * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else g1
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n > 3 else g2
    freq, energy, entropy = spectra(x[None, :], rate)[0]
    return dict(mean=x.mean(), std=std, var=std**2, min=x.min(), max=x.max(), median=np.median(x), range=np.ptp(x),
                p2p=np.ptp(x), rms=math.sqrt((x**2).mean()), energy=(x**2).mean(), skew=skew, kurtosis=kurt,
                dom_freq=freq, spec_energy=energy, spec_entropy=entropy)


def plain(w, rate=50.0):
    n = len(w)
    acc, gyro = w[:, :3], w[:, 3:]
    am, gm = np.sqrt((acc**2).sum(1)), np.sqrt((gyro**2).sum(1))
    out = {}
    for name, x in zip(S.CHANNELS, [*acc.T, am, *gyro.T, gm]):
        out |= {f"{name}_{k}": v for k, v in plain_channel(x, rate).items()}
    jerk = np.sqrt((np.diff(acc, axis=0) ** 2).sum(1)) * rate
    ang = np.sqrt((np.diff(gyro, axis=0) ** 2).sum(1)) * rate
    pitch = np.degrees(np.arctan2(acc[:, 1], np.hypot(acc[:, 0], acc[:, 2])))
    roll = np.degrees(np.arctan2(-acc[:, 0], acc[:, 2]))
    out |= dict(
        acc_sma=np.abs(acc).sum() / n, gyro_sma=np.abs(gyro).sum() / n, jerk_mean=jerk.mean(),
        jerk_std=jerk.std(ddof=1), jerk_max=jerk.max(), jerk_energy=(jerk**2).mean(), ang_acc_mean=ang.mean(),
        ang_acc_max=ang.max(), pitch_mean=pitch.mean(), pitch_std=pitch.std(ddof=1), pitch_range=np.ptp(pitch),
        roll_mean=roll.mean(), roll_std=roll.std(ddof=1), roll_range=np.ptp(roll),
        impact_ratio=am.max() / (am.mean() + 1e-5),
        post_impact_immobility=am[-int(n * 0.3):].std() if n >= 10 else 0.0,
    )
    return out


def as_windows(spark, named):
    rows = [(k, *[w[:, i].tolist() for i in range(6)]) for k, w in named.items()]
    return spark.createDataFrame(rows, "w string, " + ", ".join(f"{a} array<double>" for a in S.AXES))


def pulse(n=128):
    t = np.arange(n)
    shape = np.exp(-(((t - 60) / 6.0) ** 2))
    base = np.random.default_rng(3).normal(0, 0.05, (n, 6))
    return base + shape[:, None] * np.array([4.2, 3.1, -4.5, 4.8, 3.6, 2.9])


def walking(n=128):
    t = np.arange(n) / 50.0
    w = 2 * np.pi * 1.8 * t
    return np.column_stack([0.2 * np.sin(w), 0.3 * np.cos(w), 0.98 + 0.2 * np.sin(2 * w), 0.3 * np.sin(w),
                            0.2 * np.cos(w), 0.1 * np.sin(w)])


@pytest.fixture(scope="module")
def fixtures():
    draw = np.random.default_rng(0)
    return {
        "noise": draw.normal(size=(128, 6)), "short": draw.normal(size=(9, 6)), "odd": draw.normal(size=(37, 6)),
        "constant": np.tile([0.1, 0.2, 0.98, 0.0, 0.0, 0.0], (128, 1)), "pulse": pulse(), "walking": walking(),
        "shock": np.tile([3.8, 2.9, -4.2, 4.5, 3.9, 2.8], (128, 1)),
    }


def test_all_features_match_numpy(spark, fixtures):
    got = {r["w"]: r.asDict() for r in features.message_features(as_windows(spark, fixtures), ["w"]).collect()}
    assert len(S.FEATURE_COLUMNS) == 136
    for name, window in fixtures.items():
        want = plain(window)
        for c in S.FEATURE_COLUMNS:
            assert got[name][c] == pytest.approx(want[c], rel=1e-6, abs=1e-7), (name, c)
    assert all(got["constant"][f"{c}_{s}"] == 0 for c in S.CHANNELS for s in ("skew", "kurtosis"))
    assert all(math.isfinite(v) for k, v in got["constant"].items() if k != "w")


def test_two_hertz_sine():
    t = np.linspace(0, 2.56, 128)
    freq, energy, _ = spectra(np.sin(2 * np.pi * 2 * t)[None, :], 50.0)[0]
    assert abs(freq - 2.0) < 0.5 and energy > 0
    assert not spectra(np.ones((2, 3)), 50.0).any()


def test_single_bin_entropy_keeps_its_value():
    x = np.cos(np.pi * np.arange(4))  # only the last bin has power
    assert spectra(x[None, :], 50.0)[0][2] == pytest.approx(-1.0)


def test_decisions(spark, fixtures):
    made = features.message_features(as_windows(spark, fixtures), ["w"], ["acc_mag_max", "gyro_mag_max", "jerk_max"])
    ruled = {r["w"]: r for r in decision.decide_without_model(made).collect()}
    assert ruled["pulse"]["is_fall"] and ruled["pulse"]["risk_level"] == "HIGH"
    assert ruled["shock"]["activity"] == "FALL"
    assert not ruled["walking"]["is_fall"] and ruled["walking"]["risk_level"] in ("LOW", "MEDIUM")
    edge = spark.createDataFrame(
        [(2.8, 2.2, 0.0, "WALKING"), (2.79, 9.0, 0.25, "WALKING"), (0.0, 0.0, 0.5, "SITTING"), (2.3, 1.9, 0.0, "SITTING"),
         (0.0, 0.0, 0.0, "FALL")],
        "acc_mag_max double, gyro_mag_max double, ml_fall_probability double, ml_activity string")
    got = [(r["is_fall"], r["safety_override"], r["risk_level"]) for r in decision.decide(edge).collect()]
    assert got == [(True, True, "HIGH"), (False, False, "MEDIUM"), (True, True, "HIGH"), (False, False, "MEDIUM"),
                   (True, False, "HIGH")]


def test_window_ends_and_padding(spark):
    n = 95
    df = spark.range(n).select(
        F.lit("d").alias("k"), F.col("id").alias("t"), *[(F.col("id") + 1.0).alias(a) for a in S.AXES])
    got = {r["win_end"]: r["acc_x"] for r in windows.window_arrays(df, ["k"], ["t"], F.col("t")).collect()}
    assert sorted(got) == [64, 89]
    assert got[64] == [1.0] * 65 + [float(i) for i in range(2, 65)]
    assert got[89][:40] == [1.0] * 40 and len(got[89]) == 128
    tail = {r["win_end"]: r["acc_x"] for r in windows.window_arrays(
        df, ["k"], ["t"], F.col("t"), windows.REPLAY_RULE).collect()}
    assert sorted(tail) == [70, 80, 90] and tail[70][-59:] == [70.0] * 59


@pytest.mark.parametrize("rule", [WindowRule(8, 3, 2, "front"), WindowRule(8, 5, 3, "tail"), WindowRule(4, 4, 1, None)])
def test_rules_against_replay(spark, rule):
    sizes = {"a": 2, "b": 3, "c": 17, "d": 40}
    rows = [(k, i, float(i + 1)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, acc_x double")
    got = {
        (r["k"], r["win_end"]): r["acc_x"]
        for r in windows.window_arrays(df, ["k"], ["t"], F.col("t"), rule, ["acc_x"], block_rows=12).collect()
    }
    want = {}
    for k, n in sizes.items():
        for e in range(rule.first, n + 1, rule.stride):
            have = [float(v) for v in range(max(1, e - rule.size + 1), e + 1)]
            miss = rule.size - len(have)
            want[k, e] = [have[0]] * miss + have if rule.pad == "front" else have + [have[-1]] * miss
    assert got == want
