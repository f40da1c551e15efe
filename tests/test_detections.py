"""First detections on streams, against the table form."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opswatch import sources
from opswatch.operators.episodes import first_detection
from opswatch.streaming.alerts import first_detections

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


@pytest.mark.parametrize("batches", [1, 5])
def test_first_detections_of_streams(spark, tmp_path, batches):
    rng = random.Random(6)
    data = []
    at = 0.0
    for _ in range(150):
        at += rng.choice([0.0, 0.5, 3.0, 20.0])
        data.append((rng.choice("ab"), rng.choice([1, 2]), rng.random() < 0.3, T0 + timedelta(seconds=at)))
    data.append(("c", 1, True, T0))  # never detected
    data.append(("c", 1, False, T0 + timedelta(hours=2)))  # beyond the horizon
    data.sort(key=lambda d: d[3])
    schema, folder = "host string, n int, injection boolean, ts timestamp", str(tmp_path / "in")
    size = -(-len(data) // batches)
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    for part in [*parts, *([("end", 0, False, T0 + timedelta(days=d))] for d in (2, 3))]:
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)

    def split(df):
        return df.where(~F.col("injection")), df.where("injection").withColumnRenamed("ts", "injected_at")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = first_detections(*split(stream), ["host", "n"], horizon="1 hour", late="1 second")
    out = str(tmp_path / "out")
    query = sources.start_sink(found, out, str(tmp_path / "cp"), trigger={"availableNow": True})
    query.awaitTermination()
    want = first_detection(*split(spark.createDataFrame(data, schema)), ["host", "n"])
    want = want.withColumn("detected_at", F.when(F.col("host") != "c", F.col("detected_at")))
    assert rows(spark.read.parquet(out)) == rows(want)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1
