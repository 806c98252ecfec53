"""The cooldown against a plain replay, for ordinary and for split keys."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from strideframe.operators import cooldown
from strideframe.operators.cooldown import CooldownFold

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def replay(rows, gap):
    last, kept = {}, []
    for key, t, ident in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or t - last[key] >= gap:
            last[key] = t
            kept.append(ident)
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("parts", [1, 3, 40])
def test_against_replay(spark, seed, parts):
    """Keys and clocks that run over several ranges, short and long ones, ties, NULL keys."""
    draw = random.Random(seed)
    rows, t = [], 0.0
    for i in range(900):
        t += draw.choice([0.0, 0.2, 1.0, 4.9, 5.0, 30.0] if seed else [0.0, 0.001, 0.05])
        rows.append((draw.choice(["a"] * 6 + ["b", "c", None]), T0 + timedelta(seconds=t), i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for keys in (["k"], []):
            got = sorted(r["id"] for r in cooldown.accepted(df, keys, "ts", "id", 5.0).collect())
            assert got == replay([(k if keys else "", t, i) for k, t, i in rows], timedelta(seconds=5))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_alerts(spark):
    none = spark.createDataFrame([(None, None, 1)], "k string, ts timestamp, id long")
    assert cooldown.accepted(none, ["k"], "ts", "id").count() == cooldown.accepted(none, [], "ts", "id").count() == 0


def test_second_alert_inside_cooldown_is_suppressed():
    assert CooldownFold(5_000_000).feed([0, 1, 4_999_999, 5_000_000]) == [True, False, False, True]
