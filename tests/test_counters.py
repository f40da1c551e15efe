"""Counters on the evaluation grid and on streams, against plain loops."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opswatch import sources
from opswatch.functions import micros
from opswatch.operators.alerts import counter_increase, counter_on_grid, rule_states
from opswatch.streaming.alerts import alert_transitions, counter_growth

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
EPOCH = int(T0.timestamp())
SCHEMA = "s string, ts timestamp, value double"


def samples(n=160, seed=1):
    rng = random.Random(seed)
    found = []
    for s in "abc":
        at, value = 0.0, 0.0
        for _ in range(n):
            at += rng.choice([0.0, 0.4, 1.0, 3.7, 5.0, 12.0, 29.0, 31.0, 90.0])
            value = 1.0 if rng.random() < 0.1 else value + rng.choice([0, 0, 1, 2.5])
            found.append((s, T0 + timedelta(seconds=at), value))
    return found


def brute(data, instants_of, window=30):
    """(series, second, value, growth) by looping over the samples of every range."""
    out = []
    for s in sorted({d[0] for d in data}):
        best = {}
        for _, ts, v in (d for d in data if d[0] == s):
            at = round((ts.timestamp() - EPOCH) * 1e6)
            best[at] = max(v, best.get(at, v))
        at = sorted(best)
        for t in instants_of(at):
            held = [a for a in at if t - window * 1_000_000 < a <= t]
            if held:
                values = [best[a] for a in held]
                grown = sum(b if b < a else b - a for a, b in zip(values, values[1:]))
                out.append((s, t, values[-1], round(grown, 6)))
    return out


def grid_of(at, step=5):
    width = step * 1_000_000
    return range(at[0] // width * width, at[-1] + 40_000_000, width)


def found(df):
    return rows(df.select("s", micros(F.col("ts")) - EPOCH * 1_000_000, "value", F.round("increase", 6)))


@pytest.mark.parametrize("target", [10_000, 20])
def test_growth_on_the_grid(spark, target):
    data = samples()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    assert found(counter_on_grid(df, ["s"], target_rows=target)) == brute(data, grid_of)
    assert found(counter_on_grid(df.limit(0), ["s"], target_rows=target)) == []


@pytest.mark.parametrize(("batches", "step"), [(1, 5.0), (40, 5.0), (1, None), (4, None)])
def test_a_stream_gives_the_rows_of_the_table(spark, tmp_path, batches, step):
    data = samples()
    folder = str(tmp_path / "in")
    df = spark.createDataFrame(data, SCHEMA)
    ordered = sorted(data, key=lambda d: d[1])
    size = -(-len(ordered) // batches)
    parts = [ordered[i : i + size] for i in range(0, len(ordered), size)]
    rng = random.Random(3)
    for part in [*parts, [("end", T0 + timedelta(days=2), 0.0)], [("end", T0 + timedelta(days=3), 0.0)]]:
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    grown = counter_growth(stream, ["s"], step=step, late="1 second")
    out = str(tmp_path / "out")
    query = sources.start_sink(grown, out, str(tmp_path / "cp"), trigger={"availableNow": True})
    query.awaitTermination()
    batch = counter_on_grid(df, ["s"]) if step else counter_increase(df, ["s"])
    got = spark.read.parquet(out).where("s <> 'end'")
    assert found(got) == found(batch)
    # only the closing series still has state
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_counters_feed_alerts(spark, tmp_path):
    """A stream of samples to a stream of alert changes."""
    data = [("s", T0 + timedelta(seconds=5 * i), float(min(i, 4))) for i in range(20)]
    folder, mid = str(tmp_path / "in"), str(tmp_path / "mid")
    for part in (data[:7], data[7:], [("end", T0 + timedelta(days=1), 0.0)], [("end", T0 + timedelta(days=2), 0.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    once = {"availableNow": True}
    sources.start_sink(counter_growth(stream, ["s"]), mid, str(tmp_path / "c1"), trigger=once).awaitTermination()
    grown = spark.readStream.schema(spark.read.parquet(mid).schema).parquet(mid)
    changes = alert_transitions(grown, F.col("increase") > 0, "s")
    sources.start_sink(changes, str(tmp_path / "out"), str(tmp_path / "c2"), trigger=once).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("s = 's'").orderBy("ts")
    # grows from 5 s to 20 s; the range of 30 s forgets the last growth at 50 s
    want = [(5, "pending"), (10, "firing"), (45, "inactive")]
    assert [(round(r.ts.timestamp()) - EPOCH, r.state) for r in got.collect() if r.state != "recovered"] == want


def test_rules_name_their_alerts(spark):
    up = spark.createDataFrame([("i", T0 + timedelta(seconds=5 * i), float(i > 3)) for i in range(8)], SCHEMA)
    grows = spark.createDataFrame([("i", T0 + timedelta(seconds=5 * i), float(i)) for i in range(4)], SCHEMA)
    still = spark.createDataFrame([("i", T0 + timedelta(seconds=5 * i), 3.0) for i in range(4)], SCHEMA)
    states = rule_states(grows, still, up, ["s"])
    got = {}
    for r in states.orderBy("ts").collect():
        got.setdefault(r.alert, []).append(r.state)
    assert got["ServiceDown"] == ["pending", "firing", "firing", "firing", "inactive", "inactive", "inactive", "inactive"]
    assert got["HighErrorRate"] == ["inactive"] * 9
    assert got["HighCPUUsage"] == ["inactive", "pending"] + ["firing"] * 6 + ["inactive"]
