"""Ordered operators: split into many chunks, against one window and against plain loops."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opswatch.functions import micros
from opswatch.operators.alerts import (
    alert_recovery,
    alert_states,
    counter_increase,
    counter_rate,
    target_down,
)
from opswatch.operators.episodes import anomaly_episodes, first_detection, last_valid
from opswatch.operators.ordered import island_starts, plan_bounds, running_last, running_sum

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def us(seconds):
    return round(T0.timestamp() * 1e6) + round(seconds * 1e6)


@pytest.fixture(scope="module")
def skewed(spark):
    """One series holds most rows and one short span holds a third of them."""
    rng = random.Random(1)
    data = []
    for i in range(600):
        t = rng.choice([rng.randrange(10_000), 5_000 + rng.randrange(300)])
        data.append(("hot" if i % 3 else rng.choice(["a", "b", None]), t, i, rng.choice([None, i])))
    return spark.createDataFrame(data, "s string, t long, i long, v long").repartition(5)


def test_bounds_follow_the_rows(spark, skewed):
    bounds = plan_bounds(skewed, "t", 50)
    assert 8 <= len(bounds) <= 12 and plan_bounds(skewed, "t") == ()


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_last(spark, skewed, reverse, inclusive):
    bounds = plan_bounds(skewed, "t", 40)
    args = (skewed, ["s"], ["t", "i"], F.col("v"), "o")
    split = running_last(*args, bounds, inclusive, reverse)
    whole = running_last(*args, (), inclusive, reverse)
    assert rows(split) == rows(whole)


def test_running_sum_and_islands(spark, skewed):
    bounds = plan_bounds(skewed, "t", 40)
    split = running_sum(skewed, ["s"], ["t", "i"], F.col("v"), "o", bounds)
    whole = running_sum(skewed, ["s"], ["t", "i"], F.coalesce(F.col("v"), F.lit(0)), "o")
    zero = lambda df: rows(df.withColumn("o", F.coalesce("o", F.lit(0))))
    assert zero(split) == zero(whole)
    unique = skewed.groupBy("s", "t").agg((F.max("i") % 2 == 0).alias("even"))
    for step in (None, 60):
        args = (unique, ["s"], "t", "even", "o")
        assert rows(island_starts(*args, bounds, step)) == rows(island_starts(*args, (), step))


def plain_increase(samples, window):
    out = {}
    for t, _ in samples:
        inside = [(u, v) for u, v in samples if t - window < u <= t]
        grown = 0.0
        for (_, a), (_, b) in zip(inside, inside[1:]):
            grown += b if b < a else b - a
        out[t] = grown
    return out


def test_counter_increase(spark):
    rng = random.Random(2)
    data, want = [], {}
    for series in ("x", "y"):
        t, value, samples = 0.0, 0.0, []
        for _ in range(120):
            t += rng.choice([1, 5, 5, 5, 15, 40])
            value = 0.0 if rng.random() < 0.1 else value + rng.randrange(4)
            samples.append((t, value))
        data += [(series, at(t), v) for t, v in samples]
        want.update({(series, us(t)): g for t, g in plain_increase(samples, 30).items()})
    df = spark.createDataFrame(data, "s string, ts timestamp, value double")
    df = df.unionByName(df.limit(40))  # copies of a sample change nothing
    for target in (10, 1_000_000):
        grown = counter_increase(df, ["s"], target_rows=target)
        found = {(r.s, r.t): r.increase for r in grown.withColumn("t", micros(F.col("ts"))).collect()}
        assert found == pytest.approx(want)
    rate = counter_rate(df, ["s"]).agg(F.sum("rate")).first()[0]
    assert rate == pytest.approx(sum(want.values()) / 30)


def plain_states(points, for_, step):
    since, last, out = None, None, []
    for t, on in points:
        if not on:
            since = None
        elif since is None or t - last > step:
            since = t
        out.append("inactive" if since is None else "firing" if t - since >= for_ else "pending")
        last = t
    return out


def plain_recovery(points, states, checks, step):
    episodes, start, last, quiet = [], None, None, 0
    for (t, _), state in zip(points, states):
        if state == "firing":
            start, last, quiet = (t if start is None else start), t, 0
        elif start is not None:
            quiet += 1
            if quiet >= checks:
                episodes.append((us(start), us(last), us(t)))
                start, quiet = None, 0
    if start is not None:
        episodes.append((us(start), us(last), None))
    return episodes


@pytest.mark.parametrize("target", [25, 1_000_000])
def test_alert_states_and_recovery(spark, target):
    rng = random.Random(3)
    on, points = False, []
    for i in range(400):
        on = not on if rng.random() < 0.15 else on
        points.append((i * 5, on))
    df = spark.createDataFrame([("s", at(t), c) for t, c in points], "s string, ts timestamp, c boolean")
    states = alert_states(df, F.col("c"), ["s"], target_rows=target)
    want = plain_states(points, 5, 5)
    assert [r.state for r in states.orderBy("ts").collect()] == want
    found = alert_recovery(states, ["s"], cooldown=20, step=5, target_rows=target)
    columns = [micros(F.col(c)) for c in ("firing_at", "last_firing_at", "recovered_at")]
    got = rows(found.select(*columns))
    assert got == sorted(plain_recovery(points, want, 4, 5), key=lambda e: e[0])


def test_missing_instant_breaks_an_alert(spark):
    points = [(0, True), (5, True), (15, True), (20, True)]
    df = spark.createDataFrame([("s", at(t), c) for t, c in points], "s string, ts timestamp, c boolean")
    states = alert_states(df, F.col("c"), ["s"]).orderBy("ts")
    assert [r.state for r in states.collect()] == ["pending", "firing", "pending", "firing"]


def test_target_down(spark):
    data = [("s", at(1), 1.0), ("s", at(4), 0.0), ("s", at(6), 0.0), ("s", at(9), 1.0)]
    df = spark.createDataFrame(data, "s string, ts timestamp, value double")
    assert [r.down for r in target_down(df, ["s"]).orderBy("ts").collect()] == [True, False]


@pytest.mark.parametrize("target", [8, 1_000_000])
def test_anomaly_episodes(spark, target):
    rng = random.Random(4)
    times = sorted(round(rng.uniform(0, 600), 3) for _ in range(60)) + [601.0, 611.0, 621.001]
    runs = []
    for t in times:
        if runs and round(t - runs[-1][-1], 6) <= 10:
            runs[-1].append(t)
        else:
            runs.append([t])
    df = spark.createDataFrame([(at(t),) for t in times * 3], "ts timestamp")
    found = anomaly_episodes(df, target_rows=target)
    columns = [micros(F.col(c)) for c in ("first_anomaly", "last_anomaly", "recovered_at")]
    got = rows(found.select(*columns, "anomalies"))
    assert got == [(us(r[0]), us(r[-1]), us(r[-1] + 10), 3 * len(r)) for r in runs]


def test_grace_and_probe_start(spark):
    df = spark.createDataFrame([(at(0),)], "ts timestamp")
    found = anomaly_episodes(df, gap=2, grace=5).select(micros(F.col("recovered_at"))).first()[0]
    assert found == us(5)
    later = anomaly_episodes(df, gap=2, grace=5, probe_start="2025-01-01 00:01:00")
    assert later.select(micros(F.col("recovered_at"))).first()[0] == us(65)


@pytest.mark.parametrize("target", [10, 1_000_000])
def test_first_detection(spark, target):
    rng = random.Random(5)
    seen = [rng.randrange(500) for _ in range(80)]
    asked = [rng.randrange(600) for _ in range(20)] + [seen[0]]
    anomalies = spark.createDataFrame([(at(t),) for t in seen], "ts timestamp")
    injections = spark.createDataFrame([(at(t),) for t in asked], "injected_at timestamp")
    found = first_detection(anomalies, injections, target_rows=target)
    got = rows(found.select(micros(F.col("injected_at")), micros(F.col("detected_at"))))
    want = [(us(a), min((us(t) for t in seen if t >= a), default=None)) for a in asked]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_last_valid(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y")], "k string, o int, v string")
    assert rows(last_valid(df, "o")) == [("a", 3, None)]
    assert rows(last_valid(df, "o", ["k"])) == [("a", 3, None), ("b", 2, "y")]
    assert last_valid(df.where("o > 9"), "o").count() == 0
